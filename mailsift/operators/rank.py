"""Exact row numbers of a table too large for one task.

``row_number() over (order by ...)`` without a partition sorts the whole table
in one task, and with a hot partition key it sorts that key's rows in one. Here
the rows are range partitioned and sorted, each partition numbers its own rows,
and the counts of the partitions before it (one row a partition and group) give
the offset.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

# monotonically_increasing_id: partition number above, row number in the partition below this bit
_ROW_BITS = 33


def distributed_rank(df: DataFrame, order: Sequence[str | Column], within: Sequence[str] = (), name: str = "rank",
                     partitions: int | None = None) -> DataFrame:
    """``df`` with ``name`` long: 1, 2, ... in ``order`` inside each group of
    ``within`` (null is a group like any other), as ``row_number`` would give.

    Rows that tie get distinct numbers in an unspecified order. Ties are dealt
    over partitions too, so neither a hot group nor a hot value makes a large
    task. An empty table gives an empty table. The sorted rows are written once
    to the shared folder, so a retried task sees the same partitions.
    """
    taken = {c.lower() for c in df.columns}
    if name.lower() in taken or {"_tie", "_at"} & taken:
        raise ValueError(f"the table already has a column {name}, _tie or _at")
    keys = [*[F.col(f"`{g}`") for g in within], *[F.col(c) if isinstance(c, str) else c for c in order], F.col("_tie")]
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    placed = materialise(ranged.sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "rank")

    part = F.shiftright("_at", _ROW_BITS)
    groups = [f"`{g}`" for g in within]
    runs = placed.groupBy(part.alias("_part"), *groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    runs = runs.select(F.col("_part").alias("_run"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
                       (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    same = [part == F.col("_run"), *[F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]]
    joined = placed.join(materialise(runs, "rank-runs"), reduce(lambda a, b: a & b, same))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_at") + F.col("_shift")).alias(name))
