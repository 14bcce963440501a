"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder (``spark.checkpoint.dir``).

    Cuts the lineage: a lost executor makes later stages read the table again
    instead of repeating what led to it.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the job's shuffle files go when it ends, not at some later collection
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def crc_bucket(column: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


#: Groups that :func:`least_per_group` takes: their cuts are broadcast.
MAX_GROUPS = 1000


def least_per_group(df: DataFrame, groups: list[str], order: list, k: int) -> DataFrame:
    """The ``k`` first rows of each group by ``order``, whose first key is a hash
    (long), so that no value of it is common; groups have no nulls.

    A count by the hash's top 12 bits finds the band that the k-th row lies in;
    only rows up to that band are ranked, k and a 4,096th of a group or so, so
    no task sorts a group, however large. More than MAX_GROUPS groups are an error.
    """
    from pyspark.sql import Window
    rows = df.withColumn("_band", F.shiftright(order[0], 52))
    counts = rows.groupBy(*groups, "_band").count()
    upto = F.sum("count").over(Window.partitionBy(*groups).orderBy("_band"))
    cuts = (counts.withColumn("_upto", upto).groupBy(*groups).agg(F.min(F.when(F.col("_upto") >= k, F.col("_band"))).alias("_cut"))
            .limit(MAX_GROUPS + 1).collect())
    if len(cuts) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups of {groups}")
    kinds = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups)
    table = df.sparkSession.createDataFrame([tuple(r) for r in cuts], f"{kinds}, _cut long")
    some = rows.join(F.broadcast(table), groups).filter(F.col("_cut").isNull() | (F.col("_band") <= F.col("_cut")))
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return some.withColumn("_rank", rank).filter(F.col("_rank") <= k).select(*df.columns)


def run_bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.r_[0, change], np.r_[change, len(keys)]


def join_skewed(left: DataFrame, right: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of ``left`` with ``right``, whose ``keys`` are unique and whose
    ``weight`` is the number of left rows that bear them.

    Keys with more than a thousandth of the left rows are fewer than 1,000, so
    these rows of ``right`` are broadcast; the others join by shuffle, where no
    key has more than a thousandth of the rows. ``weight`` is not kept.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = written(right.filter(F.col(weight) * 1000 > total).drop(weight), "hot-keys")
    light = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.drop(weight), keys)
    return left.join(F.broadcast(hot), keys).unionByName(light)
