"""The training job as reusable, memoised stages.

corpus (cleaned, deduplicated) -> exact stratified split -> TF-IDF fitted on
train -> features for every document -> models. Each stage that is read more
than once is a table in the shared folder, so no executor's memory grows with
it; ``checkpoint=True`` takes Spark's checkpoints instead. Counted terms are no
stage: as rows they are many times the texts, and counting again costs less.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import ENGLISH_STOP_WORDS, MAX_FEATURES, MIN_DF, NGRAM_MAX
from ..operators import corpus as C
from ..operators import models as MD
from ..operators import split as SP
from ..operators.tfidf import TfidfModel
from ..session import checkpoint_root
from ..session import materialise as stored
from ..sources import tables as S


def materialise(df: DataFrame, checkpoint: bool = False) -> DataFrame:
    if checkpoint:
        checkpoint_root(df.sparkSession)
        return df.checkpoint(eager=True)
    return stored(df, "stage")


@dataclass
class TextRun:
    spark: SparkSession
    corpus: DataFrame                      # row_id (unique), text, label; or the counted terms instead of the text
    checkpoint: bool = False
    max_features: int = MAX_FEATURES
    min_df: int = MIN_DF
    sublinear: bool = True
    engineered: bool = True
    balanced: bool = True
    _memo: dict = field(default_factory=dict)

    def _get(self, key, build):
        if key not in self._memo:
            self._memo[key] = build()
        return self._memo[key]

    @property
    def parts(self) -> DataFrame:
        def build():
            C.require_two_classes(self.corpus)
            return materialise(SP.stratified_split(self.corpus), self.checkpoint)
        return self._get("parts", build)

    @property
    def train(self) -> DataFrame:
        return self.parts.filter(F.col("part") == "train")

    @property
    def test(self) -> DataFrame:
        return self.parts.filter(F.col("part") == "test")

    @property
    def counted(self) -> bool:
        return "tc" in self.corpus.columns

    @property
    def terms(self) -> DataFrame:
        """Every document's terms (+ engineered features), counted whenever they are read."""
        return self.parts if self.counted else MD.counted_terms((ENGLISH_STOP_WORDS, NGRAM_MAX), self.parts, keep=("row_id", "label", "part"))

    @property
    def tfidf(self) -> TfidfModel:
        return self._get("tfidf", lambda: TfidfModel.fit(None if self.counted else self.train, max_features=self.max_features, min_df=self.min_df,
                                                         sublinear=self.sublinear, tc=self.train if self.counted else None))

    @property
    def names(self) -> list[str]:
        return MD.feature_names(self.tfidf) if self.engineered else self.tfidf.feature_names()

    @property
    def n_features(self) -> int:
        return self.tfidf.size + (6 if self.engineered else 0)

    @property
    def features(self) -> DataFrame:
        """row_id, label, part, pairs for every document."""
        make = MD.featurise_terms if self.counted else MD.featurise
        return self._get("features", lambda: materialise(
            make(self.tfidf, self.parts, keep=("row_id", "label", "part"), engineered=self.engineered), self.checkpoint))

    @property
    def train_features(self) -> DataFrame:
        return self.features.filter(F.col("part") == "train")

    @property
    def test_features(self) -> DataFrame:
        return self.features.filter(F.col("part") == "test")

    @property
    def nb(self) -> MD.LinearModel:
        return self._get("nb", lambda: MD.fit_naive_bayes(self.train_features, self.n_features, self.names))

    def fit(self, names) -> None:
        """Fits those of the named linear models that are missing, together."""
        missing = [n for n in names if n != "Naive Bayes" and n not in self._memo]
        if missing:
            self._memo.update(MD.fit_models(self.train_features, self.n_features, missing, self.names, balanced=self.balanced))

    @property
    def lr(self) -> MD.LinearModel:
        return self.model("Logistic Regression")

    @property
    def svm(self) -> MD.LinearModel:
        return self.model("SVM")

    def model(self, name: str) -> MD.LinearModel:
        """Fits the named model only."""
        if name == "Naive Bayes":
            return self.nb
        self.fit([name])
        return self._memo[name]

    def release(self) -> None:
        """Forgets the stages; the fitted models stay."""
        self._memo = {k: v for k, v in self._memo.items() if not isinstance(v, DataFrame)}

    def scored(self, model: MD.LinearModel | None = None) -> DataFrame:
        """row_id, actual, margin, predicted, phishing_confidence on the hold-out."""
        m = model or self.nb
        s = m.score(self.test_features, keep=("label",))
        return s.withColumnRenamed("label", "actual")

    def with_text(self, rows: DataFrame) -> DataFrame:
        """``rows`` (few, with row_id) and their text."""
        return rows.join(self.corpus.select("row_id", "text"), "row_id")


_RUNS: dict = {}


def fixture_run(spark: SparkSession, sf_dir: str) -> TextRun:
    """The text model on the fixture corpus, fitted once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        corpus = materialise(C.build_corpus(S.corpus_view(spark, sf_dir)))
        _RUNS[key] = TextRun(spark, corpus)
    return _RUNS[key]
