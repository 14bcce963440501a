import os
from mailsift.session import scratch_path

from mailsift.sources import io as IO


def test_read_if_present_and_csv_roundtrip(spark):
    root = scratch_path(spark, "io")
    assert IO.read_if_present(spark, os.path.join(root, "missing.csv")) is None
    df = spark.createDataFrame([("line one\nline two, \"quoted\"", "spam"), ("NA", "ham"), ("x", None)],
                               "text string, label string")
    path = IO.write_table(df, root, "t", fmt="csv")
    got = IO.read_corpus(spark, path, ["text", "label"]).collect()
    assert sorted((r.text or "", r.label or "") for r in got) == [
        ("", "ham"), ("line one\nline two, \"quoted\"", "spam"), ("x", "")]
    assert IO.read_if_present(spark, path, column="text") is not None
    assert IO.read_if_present(spark, path, column="nope") is None


def test_model_roundtrip(spark):
    from mailsift.operators.models import LinearModel
    from mailsift.operators.tfidf import TfidfModel
    tf = TfidfModel([("alpha", 0, 2, 3, 1.5), ("beta", 1, 2, 2, 1.2)], 5)
    m = LinearModel("Naive Bayes", [0.1, -0.2, 0, 0, 0, 0, 0, 0], 0.3, True, ["alpha", "beta"])
    path = scratch_path(spark, "model")
    IO.save_model(spark, path, tf, m)
    tf2, m2 = IO.load_model(spark, path)
    assert tf2.vocab == tf.vocab and tf2.n_docs == 5
    assert m2.coef == m.coef and m2.intercept == m.intercept and m2.name == m.name


def test_columns_are_picked_by_name(spark):
    import pytest
    root = scratch_path(spark, "named")
    df = spark.createDataFrame([("1", "a, b", " Spam "), ("2", None, "ham")], "extra string, text string, label string")
    path = IO.write_table(df, root, "t", fmt="csv")
    assert sorted(map(tuple, IO.read_corpus(spark, path, ["label", "text"]).collect()), key=str) == [(" Spam ", "a, b"), ("ham", None)]
    assert IO.read_corpus(spark, path, ["text", "more"], optional=["more"]).columns == ["text", "more"]
    with pytest.raises(ValueError):
        IO.read_corpus(spark, path, ["text", "more"])


def test_trusted_domains_of_a_path(spark):
    root = scratch_path(spark, "domains")
    path = IO.write_table(spark.createDataFrame([(" A.org ", "1"), ("a.ORG", "2"), (None, "3")], "Domain string, n string"), root, "d", fmt="csv")
    assert [r[0] for r in IO.read_trusted_domains(spark, path).collect()] == ["a.org"]
    assert IO.read_trusted_domains(spark, root + "/none").count() == 0
    other = IO.write_table(spark.createDataFrame([("x",)], "host string"), root, "o", fmt="csv")
    assert IO.read_trusted_domains(spark, other).count() == 0


def test_raw_messages(spark):
    multi = (b"From: =?utf-8?q?J=C3=B6rg?= <j@x.org>\r\nSubject: =?iso-8859-1?q?Gr=FC=DFe?=\r\nMIME-Version: 1.0\r\n"
             b"Content-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>html</p>\r\n"
             b"--B\r\nContent-Type: text/plain\r\nContent-Disposition: attachment; filename=a.txt\r\n\r\nattached\r\n"
             b"--B\r\nContent-Type: text/plain; charset=nonsense\r\n\r\nplain <b>\xc3\xa9</b> one\r\n--B\r\n"
             b"Content-Type: text/plain\r\n\r\nplain two\r\n--B--\r\n")
    html = b"Subject: x\r\nMessage-ID: <m@x>\r\nContent-Type: text/html\r\n\r\n<html><p>only   html</p></html>"
    odd = b"Content-Type: application/json\r\n\r\n{}"
    rows = [(1, bytearray(multi)), (2, bytearray(html)), (3, bytearray(odd)), (4, None), (5, bytearray(b"Subject: long\r\n\r\n" + b"w " * 9000))]
    got = {r.uid: r for r in IO.ingest_messages(spark.createDataFrame(rows, "uid long, content binary"), mailbox="m").collect()}
    assert got[1].sender == "Jörg <j@x.org>" and got[1].subject == "Grüße" and got[1].body == "plain é one" and got[1].message_id == "1"
    assert got[2].body == "only html" and got[2].message_id == "<m@x>" and got[2].mailbox == "m"
    assert got[3].body == "{}" and got[4].body == "" and got[4].subject == "(No subject)"
    assert len(got[5].body) == 17_999
