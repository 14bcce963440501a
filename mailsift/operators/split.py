"""Reproducible stratified splits, folds and training prefixes.

Every row gets an ordering key ``(h, row_id)`` where ``h`` is the first 60
bits of ``md5("<row_id>:<seed>")``. "The first k rows of a class" is then a
comparison against that class's k-th key, found by :func:`exact_cutoffs`
without sorting the table:

1. count rows per (group, top 16 bits of h)   - partial aggregation, tiny output
2. running sums over the buckets of a group   - at most 65,536 rows per group
3. the bucket holding position k, and the offset inside it
4. rank only the rows of those buckets        - about n / 65,536 rows per cut

So membership (train/test, fold, prefix) is a filter over the scan: the
corpus itself is never shuffled or sorted, and no class is funnelled
through one task however large or skewed it is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CURVE_FRACTIONS, FOLDS, SPLIT_SEED, TEST_FRACTION

HASH_BITS = 60
BUCKET_BITS = 16


def order_hash(row_id_col: str = "row_id", seed: int = SPLIT_SEED):
    """60-bit non-negative key from md5 (same bits in DuckDB: first 15 hex)."""
    hexs = F.substring(F.md5(F.concat(F.col(row_id_col).cast("string"), F.lit(f":{seed}"))), 1, 15)
    return F.conv(hexs, 16, 10).cast("bigint")


def exact_cutoffs(df: DataFrame, group_cols: Sequence[str], targets: DataFrame,
                  key: str = "_h", tie: str = "row_id", bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """Key of the k-th smallest row (1-based) per group for every target.

    df: rows with ``group_cols``, ``key`` (non-negative, < 2**60) and ``tie``.
    targets: ``group_cols + [target_id, k]`` with 1 <= k <= group size; its
        size is the number of cut points (groups x cuts), never data-sized.
    returns: ``group_cols + [target_id, cut_key, cut_tie]``.
    """
    g = list(group_cols)
    shift = HASH_BITS - bucket_bits
    rows = df.select(*g, key, tie, F.shiftright(F.col(key), shift).alias("_b"))
    hist = rows.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    cum = hist.select(*g, "_b", "_n", F.coalesce(before, F.lit(0)).alias("_before"))
    bounds = (targets.join(cum, g)
              .filter((F.col("_before") < F.col("k")) & (F.col("k") <= F.col("_before") + F.col("_n")))
              .select(*g, "target_id", "_b", (F.col("k") - F.col("_before")).alias("_need")))
    # bounds has one row per target: a proven-small broadcast side
    inside = rows.join(F.broadcast(bounds), g + ["_b"])
    rn = F.row_number().over(Window.partitionBy(*g, "target_id").orderBy(key, tie))
    return (inside.withColumn("_rn", rn).filter(F.col("_rn") == F.col("_need"))
            .select(*g, "target_id", F.col(key).alias("cut_key"), F.col(tie).alias("cut_tie")))


# a label column with more values than this is not a label column
MAX_CLASSES = 16


def _class_counts(df: DataFrame, label: str) -> dict[str, int]:
    # one small action: at most one row per class
    rows = df.groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} values")
    return {r[0]: int(r[1]) for r in rows}


def _largest_remainder(counts: dict[str, int], total: int) -> dict[str, int]:
    """Split `total` over classes proportionally; leftovers go to the largest
    remainders, ties in class order."""
    n = sum(counts.values())
    keys = sorted(counts)
    base = {c: (total * counts[c]) // n for c in keys}
    rem = {c: (total * counts[c]) % n for c in keys}
    left = total - sum(base.values())
    for c in sorted(keys, key=lambda c: (-rem[c], keys.index(c)))[:left]:
        base[c] += 1
    return base


def split_quotas(counts: dict[str, int], test_size: float = TEST_FRACTION) -> dict[str, int]:
    """Per-class test quota: test = ceil(test_size * n); the train share is
    allocated first by largest remainder and the test quota is the rest."""
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    train = _largest_remainder(counts, n - n_test)
    return {c: counts[c] - train[c] for c in counts}


def stratified_split(df: DataFrame, test_size: float = TEST_FRACTION, seed: int = SPLIT_SEED,
                     label: str = "label") -> DataFrame:
    """Adds ``part`` ('train' | 'test'): exact per-class quotas, seeded."""
    spark = df.sparkSession
    counts = _class_counts(df, label)
    quotas = split_quotas(counts, test_size) if len(counts) else {}
    keyed = df.withColumn("_h", order_hash("row_id", seed))
    rows = [(c, 0, int(k)) for c, k in quotas.items() if k > 0]
    targets = spark.createDataFrame(rows, f"{label} string, target_id int, k long")
    cuts = exact_cutoffs(keyed, [label], targets)
    j = keyed.join(F.broadcast(cuts.drop("target_id")), label, "left")
    in_test = F.struct("_h", "row_id") <= F.struct("cut_key", "cut_tie")
    part = F.when(F.col("cut_key").isNotNull() & in_test, F.lit("test")).otherwise(F.lit("train"))
    return j.withColumn("part", part).drop("_h", "cut_key", "cut_tie")


def grouped_split(df: DataFrame, by: str, test_size: float = TEST_FRACTION, seed: int = SPLIT_SEED, label: str = "label") -> DataFrame:
    """:func:`stratified_split` inside every group, in one plan. ``by``: an array
    of a row's groups (ints, few of them); adds arrays ``train`` and ``test``, the
    groups in whose split the row is in that part. No row is repeated."""
    each = df.select(F.explode(by).alias("_g"), label, "row_id").withColumn("_h", order_hash("row_id", seed))
    counts: dict = {}
    for r in each.groupBy("_g", label).count().collect():  # groups x classes
        counts.setdefault(r[0], {})[r[1]] = int(r[2])
    rows = [(g, c, 0, k) for g, own in counts.items() for c, k in split_quotas(own, test_size).items() if k > 0]
    targets = df.sparkSession.createDataFrame(rows, f"_g int, {label} string, target_id int, k long")
    cuts = (exact_cutoffs(each, ["_g", label], targets).groupBy(label)  # a cut a group and class
            .agg(F.collect_list(F.struct("_g", F.col("cut_key").alias("_h"), F.col("cut_tie").alias("row_id"))).alias("_cuts")))
    joined = df.withColumn("_h", order_hash("row_id", seed)).join(F.broadcast(cuts), label, "left")
    reached = F.filter("_cuts", lambda c: F.struct("_h", "row_id") <= F.struct(c["_h"], c["row_id"]))
    over = joined.withColumn("_test", F.coalesce(F.transform(reached, lambda c: c["_g"]), F.array().cast("array<int>")))
    return (over.withColumns({"train": F.array_except(by, "_test"), "test": F.array_intersect(by, "_test")})
            .drop("_h", "_cuts", "_test"))


def fold_cut_points(counts: dict[str, int], k: int) -> list[tuple[str, int, int]]:
    """(class, boundary f, position) for boundaries floor(f * n_c / k), f = 1..k-1."""
    return [(c, f, (f * n) // k) for c, n in counts.items() for f in range(1, k)]


def stratified_folds(df: DataFrame, k: int = FOLDS, seed: int = SPLIT_SEED + 1,
                     label: str = "label") -> DataFrame:
    """Adds ``fold`` in [0, k): per class, consecutive blocks of the seeded
    order (fold = number of boundaries strictly below the row's rank), block
    sizes differing by at most one."""
    spark = df.sparkSession
    counts = _class_counts(df, label)
    points = fold_cut_points(counts, k)
    keyed = df.withColumn("_h", order_hash("row_id", seed))
    zeros = spark.createDataFrame(
        [(c, sum(1 for cc, _, p in points if cc == c and p == 0)) for c in counts], f"{label} string, _zeros int")
    targets = spark.createDataFrame([t for t in points if t[2] > 0], f"{label} string, target_id int, k long")
    cuts = exact_cutoffs(keyed, [label], targets)
    per_class = zeros.join(cuts.groupBy(label).agg(
        F.collect_list(F.struct(F.col("cut_key").alias("_h"), F.col("cut_tie").alias("row_id"))).alias("_cuts")),
        label, "left")
    j = keyed.join(F.broadcast(per_class), label, "left")          # one row per class
    me = F.struct("_h", "row_id")
    above = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<struct<_h:bigint,row_id:" + df.schema["row_id"].dataType.simpleString() + ">>")),
                            lambda c: me > c))
    return j.withColumn("fold", (F.col("_zeros") + above).cast("int")).drop("_h", "_cuts", "_zeros")


def curve_sizes(n_max: int, fractions: Sequence[float] = CURVE_FRACTIONS) -> list[int]:
    """Absolute training sizes: floor(fraction * n_max), clipped to [1, n_max], distinct."""
    sizes = sorted({min(max(int(f * n_max), 1), n_max) for f in fractions})
    return sizes


def train_prefixes(folded: DataFrame, k: int = FOLDS, fractions: Sequence[float] = CURVE_FRACTIONS,
                   seed: int = SPLIT_SEED + 2) -> DataFrame:
    """(row_id, fold, size): the row is in the first `size` training rows of
    fold `fold` (rows of every other fold, in a seeded order). Nested by
    construction. Sizes come from the training-set size of fold 0."""
    spark = folded.sparkSession
    pairs = folded.select("row_id", F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)),
                                                       lambda f: f != F.col("fold"))).alias("fold"))
    train_n = {int(r[0]): int(r[1]) for r in pairs.groupBy("fold").count().collect()}
    sizes = curve_sizes(train_n.get(0, 0), fractions) if train_n.get(0, 0) else []
    # a fold with fewer training rows than `size` uses all of them
    rows = [(f, s, min(s, train_n[f])) for f in sorted(train_n) for s in sizes]
    keyed = pairs.withColumn("_h", order_hash("row_id", seed))
    targets = spark.createDataFrame(rows, "fold int, target_id int, k long")
    cuts = exact_cutoffs(keyed, ["fold"], targets).withColumnRenamed("target_id", "size")
    j = keyed.join(F.broadcast(cuts), "fold")
    keep = F.struct("_h", "row_id") <= F.struct("cut_key", "cut_tie")
    return j.filter(keep).select("row_id", "fold", "size")


def seeded_shuffle(df: DataFrame, seq: str = "seq", seed: int = SPLIT_SEED) -> DataFrame:
    """A table in a seeded pseudo-random order (global range-partitioned sort)."""
    key = F.md5(F.concat(F.col(seq).cast("string"), F.lit(f":{seed}")))
    return df.orderBy(key, seq)

