"""distributed_rank against row_number."""
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from mailsift.operators.rank import distributed_rank


def test_equals_row_number_with_a_hot_group_and_nulls(spark):
    rnd = random.Random(3)
    rows = [(None if i % 17 == 0 else "hot" if i % 3 else f"g{i % 5}", rnd.randrange(10**9), f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long, t string").repartition(7)
    got = distributed_rank(df, ["v"], within=["g"], partitions=13)
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("v")).cast("long"))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_order_of_the_whole_table_and_descending(spark):
    df = spark.range(2000).select((F.col("id") * 7919 % 2003).alias("v"))
    got = {r["v"]: r["n"] for r in distributed_rank(df, [F.desc("v")], name="n", partitions=9).collect()}
    assert got == {v: n for n, v in enumerate(sorted(got, reverse=True), 1)}


def test_ties_are_numbered_and_spread(spark):
    df = spark.range(4000).select(F.lit("same").alias("v"), F.lit(1).alias("w"))
    ranked = distributed_rank(df, ["v"], partitions=8)
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 4001))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan  # the rows themselves never meet in one task


def test_empty(spark):
    assert distributed_rank(spark.createDataFrame([], "v long"), ["v"]).count() == 0
