"""A training corpus out of ``documents``: five of the operators in
``mailsift/llm`` in a row. Each stage reads all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm import langid, mixing, packing, secrets, simhash
from mailsift.llm.common import crc_bucket, load, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network accepts. It learns from the stage's
    own rows, without those held out."""
    model = langid.fit(docs.filter(crc_bucket("doc_id", 5) != 0))
    named = langid.identify(docs, model, lang_out="__lang", score_out="__score")
    return named.filter(langid.accepted("__lang", "__score")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: the one of smallest id, the least row of
    those that share it; a row without an id only where no row has one.

    Rows without an id are numbered after the greatest id, so they are compared
    like any other and never preferred."""
    rows = docs.withColumn("__key", F.col("doc_id"))
    unnamed = docs.filter(F.col("doc_id").isNull())
    if not unnamed.isEmpty():
        top = docs.agg(F.max("doc_id")).first()[0] or 0
        unnamed = written(unnamed.withColumn("__key", F.monotonically_increasing_id() + F.lit(top + 1)), "rows-without-id")
        rows = rows.filter(F.col("doc_id").isNotNull()).unionByName(unnamed)
    found = written(simhash.near_duplicates(rows, id_col="__key").select(F.col("__key").alias("__id"), "component_id"), "near-duplicates")
    gone = found.filter(F.col("__id") != F.col("component_id")).select("__id").distinct()
    kept = rows.join(gone, rows["__key"] == gone["__id"], "left_anti")
    again = found.filter(F.col("__id") == F.col("component_id")).groupBy("__id").count().filter("count > 1").select("__id")
    again = written(again, "repeated-ids")
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(again, kept["__key"] == again["__id"], "left_semi")
    rest = kept.join(again, kept["__key"] == again["__id"], "left_anti")
    first = once.groupBy("__key").agg(F.min(F.struct(*docs.columns)).alias("__row"))
    return rest.select(*docs.columns).unionByName(first.select("__row.*"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what the scan found replaced by a mark."""
    return secrets.redact(docs, secrets.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    crc = F.crc32("token_ids").alias("ids_crc32")
    return packing.pack_documents(docs, keep=[crc]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: A trained network and a packing search have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
