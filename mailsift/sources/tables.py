"""Readers for the driver's parquet tables and the derived fixture views.

The fixture views give the e-mail operators labelled, sourced text and
sender fields derived from the generic ``documents``/``labels``/``pages``
tables; the same derivation exists as SQL text for the DuckDB oracle.
Every column not needed downstream is pruned at the scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_NAMES = ("alpha", "beta", "gamma", "delta", "epsilon")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the session's cores if it has fewer files than these: a
    file with one row group is one task, however many splits it gets. A large
    one keeps as many tasks as splits, so no task grows with it. Tables of many
    files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, df.rdd.getNumPartitions())) if len(df.inputFiles()) < cores else df


def corpus_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, source_rank, row_no, source, raw_label, raw_text.

    Five label spellings and five pseudo-sources by doc_id % 5; trigger
    phrases planted by n_chars % 7 so exact copies stay exact copies.
    """
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"))
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    j = d.join(lab, "doc_id", "left")
    r5 = F.col("doc_id") % 5
    tox = F.col("toxic") == 1

    def pick(a, b):
        return F.when(tox, F.lit(a)).otherwise(F.lit(b))

    raw_label = (F.when(F.col("toxic").isNull(), F.lit(None).cast("string"))
                 .when(r5 == 0, pick(" Spam", "ham "))
                 .when(r5 == 1, pick("1", "0"))
                 .when(r5 == 2, pick("Phishing Email", "Safe Email"))
                 .when(r5 == 3, pick("phishing", "BENIGN"))
                 .otherwise(pick("PHISHING", "safe")))
    r7 = F.col("n_chars") % 7
    raw_text = (F.when(r7 == 0, F.concat("text", F.lit(" URGENT! verify now at http://www.secure.example.com")))
                .when(r7 == 1, F.concat(F.lit("Subject:Re "), "text"))
                .when(r7 == 2, F.concat(F.lit("Invoice payment card!!!! "), "text"))
                .when(r7 == 3, F.concat("text", F.lit(" HTTPS://portal.example.org login")))
                .otherwise(F.col("text")))
    source = F.element_at(F.array(*[F.lit(s) for s in SOURCE_NAMES]), (r5 + 1).cast("int"))
    return j.select(F.col("doc_id").alias("row_id"), r5.cast("int").alias("source_rank"), F.col("doc_id").alias("row_no"),
                    source.alias("source"), raw_label.alias("raw_label"), raw_text.alias("raw_text"))


def mail_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, sender, subject, body: one stored message per document."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    r4 = F.col("doc_id") % 4
    sid = F.col("doc_id").cast("string")
    sender = (F.when(r4 == 0, F.concat(F.lit("Desk <U"), sid, F.lit("@Mail"),
                                      (F.col("doc_id") % 10).cast("string"), F.lit(".Example.com>")))
              .when(r4 == 1, F.concat(F.lit(" user"), sid, F.lit("@sub.example.net ")))
              .when(r4 == 2, F.lit("no at sign"))
              .otherwise(F.lit(None).cast("string")))
    subject = F.when(F.col("doc_id") % 9 == 0, F.lit("")).otherwise(F.concat_ws(" ", F.lit("Note of"), "source", "lang"))
    return d.select((F.col("doc_id") + 1).alias("uid"), sender.alias("sender"),
                    subject.alias("subject"), F.col("text").alias("body"))


def trusted_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted domain list: the hosts of pages.url plus one base domain."""
    hosts = table(spark, sf_dir, "pages").select(
        F.lower(F.regexp_extract("url", r"^https?://([^/?#]+)", 1)).alias("domain"))
    extra = spark.createDataFrame([("example.net",)], "domain string")
    return hosts.unionByName(extra).distinct()
