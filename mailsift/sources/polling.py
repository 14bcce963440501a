"""Polls of several mailboxes, each with a remembered position.

The position of a mailbox is its greatest delivered uid. Positions are a
published table (one row a mailbox); a poll gives the messages above them, and
:meth:`Positions.advance` publishes the next table once they are handled. It is
a compare-and-set: if another poller was faster, it fails and nothing moves, so
no message is skipped, and one that was handled is not delivered again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import durable as D

SCHEMA = "mailbox string, uid long"


@dataclass
class Positions:
    spark: SparkSession
    folder: str

    def read(self) -> tuple[int, DataFrame]:
        """(number of the table, positions)."""
        number, table = D.read_table(self.spark, self.folder)
        return number, table if table is not None else self.spark.createDataFrame([], SCHEMA)

    def poll(self, messages: DataFrame) -> tuple[int, DataFrame]:
        """(the positions' number, messages above their mailbox's position). All
        fields are kept; a null mailbox is a mailbox; null uids are never new."""
        number, seen = self.read()
        seen = seen.select(F.col("mailbox").alias("_m"), F.col("uid").alias("_seen"))
        joined = messages.join(seen, messages["mailbox"].eqNullSafe(seen["_m"]), "left")
        fresh = joined.filter(F.col("uid").isNotNull() & (F.col("_seen").isNull() | (F.col("uid") > F.col("_seen"))))
        return number, fresh.drop("_m", "_seen")

    def advance(self, number: int, handled: DataFrame) -> int:
        """Publishes the positions after ``handled``, a poll's messages. Raises
        :class:`mailsift.sources.durable.Conflict` if they moved since ``number``."""
        current, before = self.read()
        if current != number:
            raise D.Conflict(f"positions are at {current}, not {number}")
        rows = before.unionByName(handled.select("mailbox", F.col("uid").cast("long").alias("uid")))
        table = rows.filter(F.col("uid").isNotNull()).groupBy("mailbox").agg(F.max("uid").alias("uid"))
        D.publish_table(table, self.folder, number + 1)
        return number + 1
