import os

from pyspark.sql import functions as F

from mailsift.operators import classify as CL
from mailsift.operators.models import LinearModel
from mailsift.operators.tfidf import TfidfModel
from mailsift.session import scratch_path
from mailsift.streaming.score import latest_summary, score_stream, stream_summary

TFIDF = TfidfModel([("alpha", 0, 2, 3, 1.5), ("beta", 1, 2, 2, 1.2)], 5)
MODEL = LinearModel("Naive Bayes", [2.0, -2.0, 0, 0, 0, 0, 0, 0], 0.1, True, ["alpha", "beta"])


def test_stream_equals_batch_whatever_arrives_late_or_twice(spark):
    rows = [(box, uid, "a@b.c", "s", ("alpha" if (uid + len(box)) % 3 else "beta beta") + f" {uid}") for box in ("in", "old") for uid in range(12)]
    m = spark.createDataFrame(rows, "mailbox string, uid long, sender string, subject string, body string")
    root = scratch_path(spark, "stream-test")
    for part, hour in ((m.filter("uid < 6"), 12), (m.filter("uid >= 6"), 3), (m, 12)):  # the second comes nine hours late
        part.withColumn("arrival", F.expr(f"timestamp'2024-01-01 {hour:02d}:00:00'")).coalesce(1).write.mode("append").parquet(root + "/in")
    domains = CL.trusted_domains(spark.createDataFrame([("b.c",)], "domain string"))
    for _ in range(2):  # a second run finds nothing new
        score_stream(spark, root + "/in", root + "/out", root + "/ckpt", TFIDF, MODEL, domains, max_files=1).awaitTermination()
        stream_summary(spark, root + "/out", root + "/sum", root + "/ckpt2").awaitTermination()
    got = spark.read.parquet(root + "/out")
    key = ("mailbox", "uid", "prediction", "phishing_confidence", "trusted_sender")
    batch = CL.classify_messages(TFIDF, MODEL, m, domains)
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, batch.select(*key).collect()))
    want = {r["prediction"]: r["count"] for r in batch.groupBy("prediction").count().collect()}
    assert {r["prediction"]: r["count"] for r in latest_summary(spark, root + "/sum").collect()} == want
    assert os.path.isdir(root + "/out")


def test_messages_that_share_a_uid_stay_apart(spark):
    m = spark.createDataFrame([("in", 7, None, None, "alpha", "x1"), ("old", 7, "q@r.s", "", "beta", "x2"), ("old", 7, "q@r.s", "", "beta", "x2")],
                              "mailbox string, uid long, sender string, subject string, body string, prediction string")
    out = CL.classify_messages(TFIDF, MODEL, m, CL.trusted_domains(spark.createDataFrame([], "domain string")))
    assert sorted((r.mailbox, r.prediction) for r in out.collect()) == [("in", "phishing"), ("old", "legitimate"), ("old", "legitimate")]
    assert {"mailbox", "subject", "body"} <= set(out.columns)


def test_scoring_needs_no_shuffle(spark):
    from mailsift.operators import models as MD
    m = spark.createDataFrame([(1, "alpha")], "uid long, body string")
    scored = MD.featurise(TFIDF, m, text="body", keep=["uid"]).withColumn("margin", MODEL.margin())
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Aggregate", "Generate", "Join"))
