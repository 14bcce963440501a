"""Structured Streaming scoring of arriving messages.

T1  score_stream: messages landing in a directory (Parquet, fixed schema) are
    classified once and appended, a folder for each micro-batch, so a replayed
    batch overwrites its own.
T2  one row per (mailbox, uid) under re-delivery, however late, by keyed state.
    Nothing is dropped for being late.
T3  stream_summary: running counts per prediction over the scored output, as a
    table that is replaced after every batch.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import classify_messages

STREAM_SCHEMA = ("mailbox string, uid bigint, sender string, subject string, body string, "
                 "arrival timestamp")
KEY = ["mailbox", "uid"]


def message_stream(spark: SparkSession, in_dir: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(STREAM_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(in_dir)


#: Keys are kept by RocksDB, a version a batch in the checkpoint folder; a batch writes what it changed.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def once(stream: DataFrame) -> DataFrame:
    """Each (mailbox, uid) of the stream once, however late or often it comes. The
    keys seen are keyed state without a watermark: a batch looks up its own keys
    only, and what earlier batches wrote is not read again."""
    return stream.dropDuplicates(KEY)


def score_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, tfidf, model,
                 domains: DataFrame, available_now: bool = True, max_files: int | None = None):
    """Classified messages, a folder ``batch=<n>`` for each micro-batch: a batch that
    is run again has the same state, hence the same messages, and replaces its own."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = once(message_stream(spark, in_dir, max_files))

        def per_batch(batch: DataFrame, batch_id: int):
            scored = classify_messages(tfidf, model, batch, domains).drop("margin")
            scored.write.mode("overwrite").parquet(os.path.join(out_dir, f"batch={batch_id}"))

        w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
        return w.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_summary(spark: SparkSession, scored_dir: str, summary_dir: str, checkpoint: str, available_now: bool = True):
    """Running counts per prediction of what :func:`score_stream` writes to
    ``scored_dir``; after each batch the whole (one row a class) is at
    ``summary_dir``/batch=<n>, the highest n being the latest."""
    counts = (spark.readStream.schema("mailbox string, uid bigint, prediction string, batch bigint").parquet(scored_dir)
              .groupBy("prediction").agg(F.count(F.lit(1)).alias("count")))

    def replace(table: DataFrame, batch_id: int):
        table.coalesce(1).write.mode("overwrite").parquet(os.path.join(summary_dir, f"batch={batch_id}"))

    w = (counts.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def latest_summary(spark: SparkSession, summary_dir: str) -> DataFrame:
    table = spark.read.parquet(summary_dir)
    last = table.agg(F.max("batch")).first()[0]
    return table.filter(F.col("batch") == last).drop("batch")
