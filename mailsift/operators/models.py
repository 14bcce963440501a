"""Linear text classifiers over the (ix, w) feature arrays.

Feature space: the TF-IDF vocabulary (0..V-1) followed by the six
engineered features (V..V+5), exactly as the original stacks them.

* multinomial naive Bayes (alpha 1, unsmoothed class prior): one grouped
  sum per (class, feature) - at most 2 x (V + 6) rows - then closed form.
  Its log-odds form is linear: coef_j = log theta_phish,j - log theta_legit,j,
  intercept = log n_phish - log n_legit.
* logistic regression (balanced class weights, L2 with C = 1) and linear SVM
  (squared hinge) by Newton steps, many at once: see ``cells``.

Every model ends as (coef[V + 6], intercept). Scoring is a map-only pass:
the coefficient vector (bounded by max_features + 6) is a constant-folded
array literal, and each row's margin is a fold over its own non-zeros.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import ENGINEERED_FEATURES, LEGITIMATE, PHISHING
from ..functions.features import engineered_features, feature_values
from ..functions.scores import clamp_confidence, predicted_label, sigmoid
from . import cells as CE
from .tfidf import PAIRS, TfidfModel

SEP = "\u0001"


def const_array(values, kind: str = "double") -> Column:
    """A driver-side list as one array literal (constant-folded by Catalyst),
    usable inside higher-order functions where subqueries are not allowed."""
    if kind == "double":
        return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")
    return F.split(F.lit(SEP.join(values)), SEP)


def model_input(tfidf: DataFrame, text_feats: Column, size: int) -> Column:
    """pairs ++ non-zero engineered features at ix = size + k."""
    vals = feature_values(text_feats)
    eng = F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(ENGINEERED_FEATURES) - 1)),
                               lambda k: F.struct((k + size).cast("int").alias("ix"),
                                                  F.element_at(vals, k + 1).alias("w"))),
                   lambda p: p["w"] != 0)
    return F.concat(F.col("pairs"), eng).cast(PAIRS)


def counted_terms(tfidf_like, df: DataFrame, text: str = "text", keep=("row_id", "label")) -> DataFrame:
    """One pass over the text: *keep, _feats (engineered struct), tc
    (term counts). Persist it to fit and transform without re-tokenising."""
    from .tfidf import doc_terms
    base = df.select(*keep, text, engineered_features(text).alias("_feats"))
    stop_words, n_max = tfidf_like
    return doc_terms(base, text, stop_words, n_max, keep=[*keep, "_feats"])


def featurise_terms(tfidf_model: TfidfModel, tc: DataFrame, keep=("row_id", "label"), engineered: bool = True) -> DataFrame:
    """featurise() from a counted_terms table."""
    t = tfidf_model.transform(None, keep=[*keep, "_feats"], tc=tc)
    pairs = model_input(t, F.col("_feats"), tfidf_model.size) if engineered else F.col("pairs")
    return t.select(*keep, pairs.alias("pairs"))


def featurise(tfidf_model: TfidfModel, df: DataFrame, text: str = "text",
              feature_text: str | None = None, keep=("row_id", "label"), engineered: bool = True,
              with_struct: bool = False) -> DataFrame:
    """*keep, pairs (TF-IDF + engineered), a row for every row of ``df``, without
    a shuffle. Engineered features are computed on ``feature_text`` (default:
    the same text)."""
    ft = feature_text or text
    keep = list(keep)
    base = df.select(*dict.fromkeys([*keep, text, ft])).withColumn("_feats", engineered_features(ft))
    t = tfidf_model.transform(base, text, keep=[*keep, "_feats"])
    pairs = model_input(t, F.col("_feats"), tfidf_model.size) if engineered else F.col("pairs")
    extra = [F.col("_feats").alias("engineered")] if with_struct else []
    return t.select(*keep, pairs.alias("pairs"), *extra)


@dataclass
class LinearModel:
    """``extra["has_margin"]`` False marks a model that gives classes only (its
    surrogate probability is then 0 or 1)."""

    name: str
    coef: list
    intercept: float
    has_proba: bool
    feature_names: list = field(default_factory=list)
    extra: dict = field(default_factory=dict)

    def margin(self, pairs: str | Column = "pairs") -> Column:
        c = const_array(self.coef)
        return F.aggregate(pairs if isinstance(pairs, Column) else F.col(pairs), F.lit(0.0),
                           lambda acc, p: acc + p["w"] * F.element_at(c, p["ix"] + 1)) + F.lit(float(self.intercept))

    def score(self, feats: DataFrame, keep=("label",)) -> DataFrame:
        """row_id, *keep, margin, predicted, phishing_confidence (null if no probabilities)."""
        m = feats.select("row_id", *keep, self.margin().alias("margin"))
        conf = sigmoid("margin") if self.has_proba else F.lit(None).cast("double")
        return m.select("*", predicted_label("margin").alias("predicted"), conf.alias("phishing_confidence"))

    def serving_confidence(self, margin: str = "margin") -> Column:
        """Probabilities when the model has them, else the clamp of the margin."""
        return sigmoid(margin) if self.has_proba else clamp_confidence(margin)

    def coefficients(self, spark) -> DataFrame:
        rows = [(i, self.feature_names[i] if i < len(self.feature_names) else None, float(c))
                for i, c in enumerate(self.coef)]
        return spark.createDataFrame(rows, "feature_ix int, feature string, coefficient double")


def feature_names(tfidf_model: TfidfModel) -> list[str]:
    return tfidf_model.feature_names() + list(ENGINEERED_FEATURES)


# ------------------------------------------------------------ naive Bayes

def nb_statistics(feats: DataFrame, label: str = "label") -> DataFrame:
    """(label, ix, total): per-class feature sums. Partial aggregation keeps
    the shuffle to at most classes x features rows per task."""
    x = feats.select(label, F.explode("pairs").alias("p"))
    return x.groupBy(label, F.col("p.ix").alias("ix")).agg(F.sum("p.w").alias("total"))


def fit_naive_bayes(feats: DataFrame, n_features: int, names: list[str] | None = None,
                    alpha: float = 1.0, label: str = "label") -> LinearModel:
    stats = nb_statistics(feats, label).collect()        # <= 2 x n_features rows
    counts = {r[0]: int(r[1]) for r in feats.groupBy(label).count().collect()}
    fc = {LEGITIMATE: [0.0] * n_features, PHISHING: [0.0] * n_features}
    for r in stats:
        fc[r[label]][r["ix"]] += float(r["total"])
    flp = {}
    for c in (LEGITIMATE, PHISHING):
        denom = sum(fc[c]) + alpha * n_features
        flp[c] = [math.log((v + alpha) / denom) for v in fc[c]]
    coef = [p - q for p, q in zip(flp[PHISHING], flp[LEGITIMATE])]
    n_p, n_l = counts.get(PHISHING, 0), counts.get(LEGITIMATE, 0)
    if n_p == 0 or n_l == 0:
        raise ValueError("naive Bayes needs both classes")
    intercept = math.log(n_p) - math.log(n_l)
    return LinearModel("Naive Bayes", coef, intercept, True, names or [],
                       {"feature_log_prob": flp, "class_count": counts})


# ------------------------------------------------------------ class weights

def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (k * n_c) as a (label, weight) table (k rows)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    everything = Window.partitionBy()  # over the k class rows only
    tot = F.sum("n_c").over(everything)
    k = F.count(F.lit(1)).over(everything)
    return counts.select(label, "n_c", (tot / (k * F.col("n_c"))).alias("weight"))


# ------------------------------------------------------------ linear models by Newton steps

LOSSES = {"Logistic Regression": CE.LOGISTIC, "Naive Bayes": CE.NAIVE_BAYES, "SVM": CE.SQUARED_HINGE}


def model_column(name: str, cell: int | None = None, balanced: bool = True, features: int | None = None, key=None) -> CE.Column:
    """The named model over a cell of a feature table; only logistic regression weighs its classes."""
    return CE.Column(key or name, LOSSES[name], cell, balanced and name == "Logistic Regression", features=features)


def as_model(fitted: CE.Fitted, name: str, names: list[str] | None = None) -> LinearModel:
    return LinearModel(name, fitted.coef.tolist(), fitted.intercept, name != "SVM", names or [], dict(fitted.extra))


def fit_models(feats: DataFrame, n_features: int, which, names: list[str] | None = None, label: str = "label",
               balanced: bool = True) -> dict[str, LinearModel]:
    """The models of ``which``, fitted together over one written feature table."""
    table = CE.cell_table(feats, n_features, label)
    fitted = CE.fit_columns(table, [model_column(w, balanced=balanced) for w in which])
    return {w: as_model(f, w, names) for w, f in zip(which, fitted)}


def fit_logistic_regression(feats: DataFrame, n_features: int, names: list[str] | None = None,
                            label: str = "label", balanced: bool = True) -> LinearModel:
    """L2 (C = 1), balanced class weights, free intercept."""
    return fit_models(feats, n_features, ("Logistic Regression",), names, label, balanced)["Logistic Regression"]


def fit_linear_svm(feats: DataFrame, n_features: int, names: list[str] | None = None, label: str = "label") -> LinearModel:
    """Squared hinge, L2 (C = 1) on the weights and the intercept."""
    return fit_models(feats, n_features, ("SVM",), names, label)["SVM"]
