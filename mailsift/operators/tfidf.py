"""TF-IDF as relational operators.

fit:   terms per document are counted inside the row (no shuffle), then one
       aggregate per term (document frequency, corpus count; partial
       aggregation makes hot terms cheap), a min_df filter and a top-k by
       corpus count (tie: term) cut by a histogram. The vocabulary is bounded by ``max_features``
       and held like any fitted Spark ML model: on the driver.
       idf = ln((1 + n) / (1 + df)) + 1 with n = all training documents.
transform: sublinear tf (1 + ln tf) x idf, L2-normalised per document, as
       sorted (ix, value) arrays. Map-only: the vocabulary is a broadcast that
       the fitted counter holds, in which each row looks its own terms up before
       anything is counted. No row is exploded, shuffled or grouped.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.constants import ENGLISH_STOP_WORDS, MAX_FEATURES, MIN_DF, NGRAM_MAX
from ..functions.text import with_term_counts, with_terms
from ..session import materialise
from .rank import distributed_rank

VOCAB_SCHEMA = "term string, term_ix int, df long, corpus_tf long, idf double"
PAIRS = "array<struct<ix:int,w:double>>"


def doc_terms(df: DataFrame, text: str = "text", stop_words: Iterable[str] = ENGLISH_STOP_WORDS,
              n_max: int = NGRAM_MAX, keep: Iterable[str] = ("row_id",)) -> DataFrame:
    """keep cols + ``tc`` array<struct<term, tf>>: per-document term counts."""
    return with_term_counts(df, text, "tc", stop_words, n_max, keep=list(keep))


def each_of(df: DataFrame, array: str, keep: Iterable[str] = ()) -> DataFrame:
    """*keep, x: a row for every element of ``array``, whose elements are never null.

    An inner explode has its arrays' sizes checked by a filter, which the
    optimizer writes out over whatever made the array, once for every use of
    every step: here, the tokenising a hundred times over. An outer one has none."""
    return df.select(*keep, F.explode_outer(array).alias("x")).filter(F.col("x").isNotNull())


def term_frequencies(df: DataFrame, text: str = "text", **kw) -> DataFrame:
    """Long form (row_id, term, tf)."""
    return each_of(doc_terms(df, text, **kw), "tc", ["row_id"]).select("row_id", "x.term", "x.tf")


def document_frequencies(tc: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """(*by, term, df, corpus_tf) from a doc_terms table."""
    x = each_of(tc, "tc", by)
    return x.groupBy(*by, F.col("x.term").alias("term")).agg(
        F.count(F.lit(1)).alias("df"), F.sum("x.tf").alias("corpus_tf"))


# a fitted vocabulary is held like a fitted model: this many terms at most
MAX_VOCABULARY = 200_000
# counts are cut into bands of a 32nd of an octave
_BANDS = 32


def top_terms(stats: DataFrame, max_features: int | None, min_df: int = MIN_DF, by: Iterable[str] = ()) -> DataFrame:
    """The ``max_features`` commonest terms of each group of ``by`` (ties: the
    smaller term); None keeps all.

    A histogram of the counts on a log scale (some 1,300 bands a group) finds the
    band that holds the last place. Terms of higher bands are in without being
    sorted; only that band is ranked, over many tasks."""
    kept = stats.filter(F.col("df") >= min_df)
    if max_features is None:
        return kept
    by = list(by)
    kept = materialise(kept.withColumn("_band", F.floor(F.log2("corpus_tf") * _BANDS).cast("int")), "terms")
    above = Window.partitionBy(*by).orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = kept.groupBy(*by, "_band").agg(F.count(F.lit(1)).alias("_n")).withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0)))
    cut = (bands.filter((F.col("_above") < max_features) & (F.col("_above") + F.col("_n") >= max_features))
           .select(*by, F.col("_band").alias("_cut"), (max_features - F.col("_above")).alias("_need")).collect())  # a row a group
    names = [f.name for f in stats.schema.fields]
    if not cut:
        return kept.select(*names)
    # one row a group, as those of the histogram's window: within every broadcast
    cuts = kept.sparkSession.createDataFrame([tuple(r) for r in cut], ", ".join(
        [*(f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in by), "_cut int", "_need long"]))
    marked = kept.join(F.broadcast(cuts), by, "left") if by else kept.crossJoin(F.broadcast(cuts))
    sure = marked.filter(F.col("_cut").isNull() | (F.col("_band") > F.col("_cut")))
    last = distributed_rank(marked.filter(F.col("_band") == F.col("_cut")), [F.desc("corpus_tf"), F.asc("term")], within=by, name="_place")
    return sure.select(*names).unionByName(last.filter(F.col("_place") <= F.col("_need")).select(*names))


@dataclass
class TfidfModel:
    vocab: list  # (term, term_ix, df, corpus_tf, idf) in term_ix order
    n_docs: int
    stop_words: tuple = ENGLISH_STOP_WORDS
    n_max: int = NGRAM_MAX
    sublinear: bool = True
    use_idf: bool = True
    _made: tuple | None = field(default=None, repr=False, compare=False)

    @property
    def size(self) -> int:
        return len(self.vocab)

    @staticmethod
    def fit(df: DataFrame | None, text: str = "text", max_features: int = MAX_FEATURES,
            min_df: int = MIN_DF, stop_words: Iterable[str] = ENGLISH_STOP_WORDS,
            n_max: int = NGRAM_MAX, sublinear: bool = True, use_idf: bool = True,
            tc: DataFrame | None = None) -> "TfidfModel":
        """Fit on documents ``df`` or on already counted terms ``tc`` (one row
        per document with a ``tc`` column, as made by :func:`doc_terms`).
        ``max_features`` bounds what the driver holds."""
        if not 0 < max_features <= MAX_VOCABULARY:
            raise ValueError(f"max_features must be 1 to {MAX_VOCABULARY}")
        stop_words = tuple(stop_words)
        if tc is None:
            tc = doc_terms(df, text, stop_words, n_max)
        stats = top_terms(document_frequencies(tc), max_features, min_df)
        n_docs = tc.count()
        rows = sorted(stats.collect(), key=lambda r: r["term"])  # bounded by max_features
        return TfidfModel._of(rows, n_docs, stop_words, n_max, sublinear, use_idf)

    @staticmethod
    def fit_groups(tc: DataFrame, by: str, max_features: int = MAX_FEATURES, min_df: int = MIN_DF, **how) -> dict:
        """{value of ``by``: model}: a vocabulary for every group of counted terms,
        from one aggregate over (group, term). The driver holds groups x max_features terms.

        ``by`` may be an array: a row counts for each group in it. Terms are then
        added up by the whole array, and only the sums are dealt to its groups."""
        if not 0 < max_features <= MAX_VOCABULARY:
            raise ValueError(f"max_features must be 1 to {MAX_VOCABULARY}")
        sizes, stats = tc.groupBy(by).count(), document_frequencies(tc, (by,))
        if isinstance(tc.schema[by].dataType, ArrayType):
            sizes = sizes.select(F.explode(by).alias(by), "count").groupBy(by).agg(F.sum("count"))
            stats = (stats.select(F.explode(by).alias(by), "term", "df", "corpus_tf").groupBy(by, "term")
                     .agg(F.sum("df").alias("df"), F.sum("corpus_tf").alias("corpus_tf")))
        sizes = {r[0]: r[1] for r in sizes.collect()}  # a row a group
        stats = top_terms(stats, max_features, min_df, (by,)).collect()
        out = {}
        for group, n in sizes.items():
            mine = sorted((r for r in stats if r[by] == group), key=lambda r: r["term"])
            out[group] = TfidfModel._of(mine, n, **how)
        return out

    @staticmethod
    def _of(rows: list, n_docs: int, stop_words: Iterable[str] = ENGLISH_STOP_WORDS, n_max: int = NGRAM_MAX,
            sublinear: bool = True, use_idf: bool = True) -> "TfidfModel":
        vocab = [(r["term"], ix, int(r["df"]), int(r["corpus_tf"]), math.log((1 + n_docs) / (1 + r["df"])) + 1.0 if use_idf else 1.0)
                 for ix, r in enumerate(rows)]
        return TfidfModel(vocab, n_docs, tuple(stop_words), n_max, sublinear, use_idf)

    def vocab_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.vocab, VOCAB_SCHEMA)

    def _counter(self):
        """Counts of the vocabulary's terms, and those counts times idf, as fitted
        transformers: made once, so the vocabulary is one broadcast for all plans."""
        if self._made is None:
            from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
            from pyspark.ml.linalg import Vectors
            terms = CountVectorizerModel.from_vocabulary(self.feature_names(), inputCol="_terms", outputCol="_tf")
            self._made = terms, ElementwiseProduct(scalingVec=Vectors.dense([v[4] for v in self.vocab]), inputCol="_tf", outputCol="_tfidf")
        return self._made

    def transform(self, df: DataFrame | None, text: str = "text", keep: Iterable[str] = (),
                  tc: DataFrame | None = None) -> DataFrame:
        """*keep, pairs array<struct<ix int, w double>> (sorted by ix, L2 = 1 or empty);
        one row per row of the input, in its partition.
        ``tc``: already counted terms (with the keep columns) instead of ``df``."""
        keep = list(keep)
        if tc is not None:
            d = tc.select(*keep, F.flatten(F.transform("tc", lambda x: F.array_repeat(x["term"], x["tf"].cast("int")))).alias("_terms"))
        else:
            d = with_terms(df, text, "_terms", self.stop_words, self.n_max, keep)
        if not self.vocab:
            return d.select(*keep, F.array().cast(PAIRS).alias("pairs"))
        for step in self._counter():
            d = step.transform(d)
        # an array of one element binds its value: named columns would be inlined, and evaluated for every element
        def scaled(both: Column) -> Column:
            n, x = both["n"], both["x"]
            weight = F.zip_with(n["values"], x["values"], lambda n, x: x / n * (1.0 + F.log(n))) if self.sublinear else x["values"]
            return F.transform(F.array(F.struct(n["indices"].alias("ix"), weight.alias("w"))), normed)[0]

        def normed(p: Column) -> Column:
            length = F.sqrt(F.aggregate(p["w"], F.lit(0.0), lambda s, w: s + w * w))
            return F.transform(F.array(length), lambda z: F.zip_with(
                p["ix"], p["w"], lambda i, w: F.struct(i.alias("ix"), (w / z).alias("w"))))[0]

        both = F.struct(F.unwrap_udt("_tf").alias("n"), F.unwrap_udt("_tfidf").alias("x"))
        return d.select(*keep, F.transform(F.array(both), scaled)[0].cast(PAIRS).alias("pairs"))

    def long_form(self, df: DataFrame, text: str = "text") -> DataFrame:
        """(row_id, term_ix, weight)."""
        t = self.transform(df, text, keep=["row_id"])
        return each_of(t, "pairs", ["row_id"]).select("row_id", F.col("x.ix").alias("term_ix"), F.col("x.w").alias("weight"))

    def feature_names(self) -> list[str]:
        return [v[0] for v in self.vocab]
