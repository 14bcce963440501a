"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is a number of words. Whole copies of the source go first;
what remains of the budget is a subset-sum problem over its documents, solved
on the counts of documents by exact size: a proportional share of every size,
then a bounded-knapsack dynamic programme for the last words. Documents of a
size are interchangeable there, so the solution says only how many of each size
to take; which ones follows from a seeded hash of their ids.

Nothing is gathered by source but its table of sizes (one row per distinct
size). The k first documents of a size by hash are found from counts per hash
bucket, so a source that holds a third of all rows, or a size that does, is
ranked in pieces of about 1/65,536.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
SEED = 42
#: Words that the dynamic programme covers: the end of a budget, after the proportional share.
LAST_WORDS = 32_768
#: The table of sources (a row each) is the mix's configuration and is held by the driver.
MAX_SOURCES = 100_000


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: list[int], weights: list[float], budget: float = BUDGET, most: float = MOST) -> list[float]:
    """Words per source: ``budget`` times all words shared by weight; none above
    ``most`` times its own, the excess shared again by weight."""
    left, out = budget * sum(totals), [0.0] * len(totals)
    open_ = [i for i, t in enumerate(totals) if t > 0]
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= most * totals[i]]
        for i in full or open_:
            out[i] = float(most * totals[i]) if full else left * weights[i] / total
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, last_words: int = LAST_WORDS) -> np.ndarray:
    """How many documents of each size (distinct, positive) to take so that
    their words come as near to ``budget`` from below as the search finds."""
    total = int((sizes * counts).sum())
    take = np.array([int(c) * budget // total for c in counts.tolist()], np.int64)
    left, rest = counts - take, budget - int((sizes * take).sum())
    for k in np.argsort(-sizes, kind="stable").tolist():  # down to what the programme covers
        if rest <= last_words:
            break
        more = min(int(left[k]), rest // int(sizes[k]), -(-(rest - last_words) // int(sizes[k])))
        take[k] += more
        left[k] -= more
        rest -= more * int(sizes[k])
    if rest > last_words:
        return take
    # bounded knapsack: bit s of `reached` says that s words can be made; counts in binary parts
    reached, steps = 1, []
    limit = (1 << (rest + 1)) - 1
    for k in np.argsort(sizes, kind="stable").tolist():
        size, many, part = int(sizes[k]), min(int(left[k]), rest // int(sizes[k])), 1
        while many and not reached >> rest & 1:
            part = min(part, many)
            steps.append((k, part, reached))
            reached |= (reached << (size * part)) & limit
            many -= part
            part *= 2
        if reached >> rest & 1:
            break
    goal = reached.bit_length() - 1
    for k, part, before in reversed(steps):
        if not before >> goal & 1:
            take[k] += part
            goal -= int(sizes[k]) * part
    return take


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size").reset_index(drop=True)
    sizes, counts = rows["size"].to_numpy(), rows["count"].to_numpy()
    total, target = int((sizes * counts).sum()), float(rows["target"].iloc[0])
    whole = min(int(target // total), MOST) if total else 0
    some = sizes > 0
    take = np.zeros(len(rows), np.int64)
    rest = int(round(target)) - whole * total
    if total and rest > 0:
        take[some] = fit_budget(sizes[some], counts[some], min(rest, total))
    return pd.DataFrame({"_key": rows["_key"], "size": sizes, "whole": np.int32(whole), "take": take,
                         "target": target, "source_size": np.int64(total)})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED) -> DataFrame:
    """What the mix takes, one row per distinct (id, source, size): these three,
    copies long (rows that share them), whole int (times that each is taken),
    extra long (of the copies, how many are taken once more), target double,
    source_size long.

    A null text has size 0 and is never counted; a null source is a source of
    its own, the last; null ids are documents like any other. Sources take the
    weights by code point order, repeating. Other columns are not kept. An
    empty table gives an empty table. Reruns agree whatever the partitioning.
    """
    spark = docs.sparkSession
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    docs = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    rows = written(docs.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
                   .withColumn("_key", key).withColumn("_h", F.xxhash64(F.col("id"), F.lit(seed)))
                   .withColumn("_bucket", F.shiftrightunsigned("_h", 48)), "mix-rows")
    by_size = written(rows.groupBy("_key", "size").agg(F.sum("copies").alias("count")), "mix-sizes")
    totals = by_size.groupBy("_key").agg(F.sum(F.col("size") * F.col("count")).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found = sorted((k == "-", k, n) for k, n in totals)
    goal = source_targets([n for *_, n in found], [weights[i % len(weights)] for i in range(len(found))], budget, most)
    targets = spark.createDataFrame([(k, t) for (_, k, _), t in zip(found, goal)], "_key string, target double")
    plan = (by_size.join(F.broadcast(targets), "_key").groupBy("_key")
            .applyInPandas(_fit_source, "_key string, size long, whole int, take long, target double, source_size long"))
    in_order = Window.partitionBy("_key", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (rows.groupBy("_key", "size", "_bucket").agg(F.sum("copies").alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(in_order), F.lit(0))).drop("_n")
               .join(plan, ["_key", "size"]))
    inside = Window.partitionBy("_key", "size", "_bucket").orderBy("_h", "id").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("_before") + F.coalesce(F.sum("copies").over(inside), F.lit(0))
    extra = F.least(F.greatest(F.col("take") - rank, F.lit(0)), F.col("copies"))
    return (rows.join(buckets, ["_key", "size", "_bucket"]).withColumn("extra", extra)
            .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "copies", "whole", "extra",
                    "target", "source_size"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    **how) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each as often as
    the mix takes it."""
    taken = written(mix(docs, id_col, text_col, source_col, **how)
                    .select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.col("size").alias("__size"),
                            F.col("whole").alias("__whole"), F.col("extra").alias("__extra"),
                            F.col("copies").alias("__copies")), "mix")
    # what is taken grows with the documents: join by shuffle at every size
    join = lambda some: docs.withColumn("__words", word_count(text_col)).join(
        some.hint("merge"), F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).eqNullSafe(F.col("__source"))
        & (F.col("__words") == F.col("__size")))
    split = (F.col("__extra") > 0) & (F.col("__extra") < F.col("__copies"))  # at most one id of a source and size
    times = F.col("__whole") + F.when(F.col("__extra") > 0, 1).otherwise(0)
    out = join(taken.filter(~split & (times > 0))).withColumn("__times", times)
    if not taken.filter(split).isEmpty():
        nth = F.row_number().over(Window.partitionBy("__id", "__source", "__size").orderBy(F.xxhash64(text_col)))
        once = F.when(nth <= F.col("__extra"), 1).otherwise(0)
        some = join(taken.filter(split)).withColumn("__times", F.col("__whole") + once)
        out = out.unionByName(some.filter(F.col("__times") > 0))
    return out.withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[F.col(f"`{c}`") for c in docs.columns])
