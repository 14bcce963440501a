from conftest import one
from mailsift.functions import message as M


def test_sender_domain(spark):
    got = one(spark, M.sender_domain("x"), ["Bob <a@X.co.uk>", "a@b@c.com", "nobody", "> x@y <", None])
    assert got == ["x.co.uk", "c.com", "", "", ""]


def test_base_domain(spark):
    assert one(spark, M.base_domain("x"), ["mail.x.co.uk", "localhost", ""]) == ["co.uk", "localhost", ""]


def test_serving_text_and_defaults(spark):
    df = spark.createDataFrame([(" Hi ", "a@b.c", " body ")], "s string, f string, b string")
    assert df.select(M.serving_text("s", "f", "b")).first()[0] == "Subject: Hi\nFrom: a@b.c\nBody: body"
    assert one(spark, M.default_subject("x"), ["", None, "x"]) == ["(No subject)", "(No subject)", "x"]
    assert len(one(spark, M.message_body("x"), ["y" * 6000])[0]) == 6000
    assert len(one(spark, M.message_body("x", 5000), ["y" * 6000])[0]) == 5000


def test_registered_domain(spark):
    from mailsift.functions.message import registered_domain
    rules = ["com", "uk", "co.uk", "*.ck", "!www.ck", "b.c.d", "*.e.f"]
    want = {"a.co.uk": "a.co.uk", "x.a.co.uk": "a.co.uk", "co.uk": "", "uk": "", "b.ck": "", "a.b.ck": "a.b.ck", "www.ck": "www.ck", "x.www.ck": "www.ck",
            "A.COM": "a.com", "plain": "", "": "", "x.unknown": "x.unknown", "z.y.b.c.d": "y.b.c.d", "..com.": "", None: "", "q.r.e.f": "q.r.e.f", "e.f": "e.f"}
    got = one(spark, registered_domain("x", rules), list(want))
    assert dict(zip(want, got)) == want


def test_a_public_suffix_trusts_nobody(spark):
    from mailsift.operators import classify as CL
    rules = ["uk", "co.uk"]
    domains = CL.trusted_domains(spark.createDataFrame([("co.uk",), ("good.co.uk",), ("uk",)], "domain string"), suffixes=rules)
    assert [r[0] for r in domains.collect()] == ["good.co.uk"]


def test_a_list_of_any_size_moves_no_domain_to_one_task(spark):
    from mailsift.operators import classify as CL
    from pyspark.sql import functions as F
    big = spark.range(2000).select(F.concat(F.lit("d"), F.col("id").cast("string"), F.lit(".org")).alias("domain"))
    domains = CL.trusted_domains(big.unionByName(spark.createDataFrame([("often.net",)], "domain string")))
    msgs = spark.range(4000).select(F.col("id").alias("uid"), F.when(F.col("id") % 4 > 0, "often.net").when(F.col("id") % 8 == 0, "no.org").alias("sender_domain"),
                                    F.lit("").alias("base_domain"))
    assert "SortMergeJoin" not in CL.mark_trusted(msgs, domains)._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        marked = CL.mark_trusted(msgs, domains)
        by_key = marked.groupBy("trusted_sender").count()
        assert {r[0]: r[1] for r in by_key.collect()} == {True: 3000, False: 1000}
        assert marked.columns == ["uid", "sender_domain", "base_domain", "trusted_sender"]
        plan = marked._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(_k1" in plan and "_p#" in plan.split("hashpartitioning(_k1")[1].split("]")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
