import re

from mailsift.operators import corpus as C


def _filters(df):
    """The filters of the optimized plan (their white space holds line breaks)."""
    return [node for node in re.split(r"\n[ :|]*[+:]- ", df._jdf.queryExecution().optimizedPlan().toString()) if node.startswith("Filter ")]


def _mail(spark):
    rows = [(1, "Subject:Hello", " Body  text ", "Spam"), (2, None, None, "ham"), (3, " ", "from:me", "ham"), (4, "x", "y", "other"),
            (5, None, "Body text", None), (1, "Subject:Hello", " Body  text ", "Spam")]
    return spark.createDataFrame(rows, "row_id long, subject string, body string, kind string").repartition(2)


def test_filters_do_not_repeat_the_cleaning(spark):
    spec = C.SourceSpec("mail", 0, ("subject", "body"), label_col="kind")
    done = C.finalise(C.combine([C.canonicalise(_mail(spark), spec)] * 2))
    assert _filters(done) and not any("regexp_replace" in node for node in _filters(done))
    assert sorted((r["row_id"], r["text"], r["label"]) for r in done.collect()) == sorted(
        [("0:1", "hello body text", "phishing"), ("0:1", "hello body text", "phishing"), ("0:3", "me", "legitimate")] * 2)
    stages = C.cumulative_corpora(C.valid_rows(done), 2)
    assert not any("regexp_replace" in node for node in _filters(stages))


def test_evaluated_keeps_rows_and_order_of_columns(spark):
    rows = spark.createDataFrame([("a", None, 1), (None, "b", 2), (None, None, 3)], "x string, y string, n int")
    out = C.evaluated(rows, "y", "x")
    assert out.columns == rows.columns and sorted(out.collect(), key=lambda r: r["n"]) == sorted(rows.collect(), key=lambda r: r["n"])
