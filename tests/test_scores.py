from pyspark.sql import functions as F
from pytest import approx

from mailsift.functions import scores as SC


def test_clamp(spark):
    df = spark.createDataFrame([(-4.0,), (0.0,), (1.5,), (9.0,)], "m double")
    assert [r[0] for r in df.select(SC.clamp_confidence("m")).collect()] == approx([0, 0.5, 0.75, 1])


def test_rule_reason_thresholds(spark):
    rows = [("phishing", False, 0, 3, 0.30), ("phishing", True, 0, 4, 0.31), ("phishing", True, 0, 0, 0.0),
            ("legitimate", True, 5, 9, 0.9)]
    df = spark.createDataFrame(rows, "p string, t boolean, l int, e int, u double")
    feats = F.struct(F.col("l").alias("link_count"), F.lit(False).alias("has_urgent_words"),
                     F.lit(False).alias("has_account_words"), F.lit(False).alias("has_payment_words"),
                     F.col("e").alias("exclamation_count"), F.col("u").alias("uppercase_ratio"))
    got = [r[0] for r in df.select(SC.rule_reasons("p", "t", feats)).collect()]
    assert got[0] == ["Sender domain is not trusted"]
    assert got[1] == ["Excessive use of exclamation marks (!)", "High use of uppercase text"]
    assert got[2] == ["Model detected suspicious patterns"]
    assert got[3] == ["No strong phishing indicators detected", "Sender is from a trusted domain",
                      "Email appears safe based on language patterns"]


def test_attribution_sentence(spark):
    df = spark.createDataFrame([("phishing", [("a", 0.5), ("b", -0.1), ("c", 0.2), ("d", 0.1), ("e", 0.3), ("f", 0.4)]),
                                ("legitimate", [("a", -0.5)])],
                               "p string, f array<struct<feature:string,weight:double>>")
    got = [r[0] for r in df.select(SC.attribution_sentence("f", "p")).collect()]
    assert got[0] == "SHAP found the strongest phishing contribution from: a, c, d, e."
    assert got[1].startswith("SHAP did not find strong positive safe email")
