import pytest

from mailsift.operators import corpus as C
from mailsift.plans import jobs as JB
from mailsift.plans.pipeline import TextRun
from mailsift.session import scratch_path
from mailsift.sources import io as IO


def corpus_of(spark, rows, name, rank):
    df = spark.createDataFrame(rows, "row_id long, text string, label string")
    return C.canonicalise(df, C.SourceSpec(name, rank, ("text",), label_col="label"))


def test_sources_that_share_row_numbers_stay_apart(spark):
    words = ["cheap", "pills", "offer", "meeting", "notes", "project"]
    parts = [corpus_of(spark, [(i, f"{words[i % 6]} {words[(i + k) % 6]} mail {k} {i}", "spam" if i % 2 else "ham") for i in range(20)], f"s{k}", k)
             for k in range(2)]
    corpus = C.require_unique(C.dedupe_first(C.combine(parts)))
    assert corpus.count() == 40
    run = TextRun(spark, corpus)
    assert run.features.count() == 40 and run.parts.filter("part = 'test'").count() == 8
    with pytest.raises(ValueError):
        C.require_unique(parts[0].unionByName(parts[0]))


def test_only_the_asked_model_is_fitted(spark):
    rows = [(i, f"word{i % 5} other{i % 3} more", "spam" if i % 2 else "ham") for i in range(40)]
    run = TextRun(spark, corpus_of(spark, rows, "s", 0))
    run.model("Naive Bayes")
    assert "nb" in run._memo and not {"lr", "svm"} & set(run._memo)
    one_class = TextRun(spark, corpus_of(spark, [(i, f"w{i}", "ham") for i in range(9)], "s", 0))
    with pytest.raises(ValueError):
        one_class.parts.count()


def test_dedupe_keeps_the_first_and_does_not_sort_texts(spark):
    a = corpus_of(spark, [(9, "same text", "ham"), (10, "same  text", "ham"), (2, "other", "ham"), (3, " ", "ham"), (4, "x", "?")], "s", 0)
    d = C.dedupe_first(a)
    assert sorted(r.row_id for r in d.collect()) == ["0:2", "0:9"]
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Sort [text" not in plan


def test_run_from_files(spark):
    root = scratch_path(spark, "files")
    body = lambda i: f"cheap pills offer {i}" if i % 2 else f"meeting notes project {i}"
    spam = lambda i: "Spam" if i % 2 else "ham"
    shapes = [("extra string, label string, text string", [("x", spam(i), body(i)) for i in range(20)]),
              ("subject string, body string", [("Hi", body(2 * i)) for i in range(20, 30)]),
              ("body string, subject string, z string", [(body(2 * i + 1), "Win", "z") for i in range(20, 30)]),
              ("`Email Text` string, `Email Type` string", [(body(i), "Phishing Email" if i % 2 else "Safe Email") for i in range(60, 70)]),
              ("sender string, subject string, body string, label string", [("a@b.c", "s", body(i), str(i % 2)) for i in range(70, 80)])]
    paths = [IO.write_table(spark.createDataFrame(rows, schema), root, f"f{k}", fmt="csv") for k, (schema, rows) in enumerate(shapes)]
    run, best = JB.train_from_files(spark, paths, root + "/out", models=("Naive Bayes",))
    assert run.corpus.count() == 20 + 10 + 10 + 5 + 10 and best == "Naive Bayes"
    assert spark.read.option("header", True).csv(root + "/out/model_results").count() == 1
    assert {"text", "kind", "model"} <= set(spark.read.option("header", True).csv(root + "/out/errors").columns)
    assert IO.load_model(spark, root + "/out/model")[1].name == "Naive Bayes"
