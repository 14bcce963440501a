"""The run from files with its studies, and the studies' invariants, on a small corpus."""
import random

from pyspark.sql import functions as F

from mailsift.operators import corpus as C
from mailsift.plans import jobs as JB
from mailsift.plans.pipeline import TextRun
from mailsift.session import scratch_path
from mailsift.sources import io as IO

SPECS = (C.SourceSpec("first", 0, ("text",), label_col="label"), C.SourceSpec("second", 1, ("subject", "body"), label_col="label"))


def mails(n, seed):
    rnd = random.Random(seed)
    words = {"phishing": ["prize", "verify", "account", "urgent", "click"], "legitimate": ["meeting", "notes", "project", "lunch", "report"]}
    out = []
    for i in range(n):
        label = ("phishing", "legitimate")[i % 2]
        out.append((" ".join(rnd.choice(words[label] + ["the", "mail", "today", "offer"]) for _ in range(12)) + f" n{i}", label))
    return out


def files(spark):
    root = scratch_path(spark, "small-files")
    a = spark.createDataFrame(mails(60, 1), "text string, label string")
    b = spark.createDataFrame(mails(50, 2), "body string, label string").select(F.lit("About\nit").alias("subject"), "body", "label")
    return [IO.write_table(a, root, "a", fmt="csv"), IO.write_table(b, root, "b", fmt="csv")]


def test_all_tables_of_a_run(spark):
    out = scratch_path(spark, "small-run")
    external = {"more": spark.createDataFrame([("urgent verify account", 1), ("meeting notes", 2), ("", 3)], "text string, id long")}
    run, best = JB.train_from_files(spark, files(spark), out, specs=SPECS, fmt="parquet", external=external)
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    results = {r.model: r for r in read("model_results").collect()}
    assert set(results) == set(JB.MODEL_ORDER) and best in results
    assert results[best].f1_score == max(r.f1_score for r in results.values()) >= 0.9
    wrong = read("errors").count()
    assert wrong == read("false_positives").count() + read("false_negatives").count()
    stages = read("contribution").collect()
    assert sorted((r.dataset, r.model) for r in stages) == [(d, m) for d in ("first", "first + second") for m in JB.MODEL_ORDER]
    curve = sorted(read("learning_curve").collect())
    assert [r["size"] for r in curve] == sorted({r["size"] for r in curve}) and len(curve) == 5
    assert curve[-1].validation_score >= 0.9 and all(0 <= r.train_score <= 1 for r in curve)
    assert sorted(map(tuple, read("external_more").select("id", "predicted_label").collect())) == [(1, "phishing"), (2, "legitimate")]
    tfidf, model = IO.load_model(spark, f"{out}/model")
    assert model.name == best and tfidf.vocab == run.tfidf.vocab


def test_stages_together_are_what_each_stage_alone_gives(spark):
    sources = JB.sources_from_files(spark, files(spark), SPECS)
    together = {(r.dataset, r.model): (r.accuracy, r.f1) for r in JB.contribution(sources, ["a", "a+b"]).collect()}
    for s, name in ((1, "a"), (2, "a+b")):
        run = TextRun(spark, C.finalise(sources.filter(F.col("source_rank") < s)))
        alone, _, _ = JB.compare_models(run)
        assert {m: together[name, m] for m in JB.MODEL_ORDER} == {r.model: (r.accuracy, r.f1_score) for r in alone.collect()}
    deduped = JB.contribution(sources.unionByName(sources), ["a", "a+b"], models=("Naive Bayes",), dedupe=True).collect()
    assert {(r.dataset, r.model): (r.accuracy, r.f1) for r in deduped} == {k: v for k, v in together.items() if k[1] == "Naive Bayes"}


def test_top_terms_cut_by_a_histogram(spark):
    from mailsift.operators.tfidf import top_terms
    rnd = random.Random(4)
    rows = [(g, f"t{i:05d}", 2, max(2, int(1 / (rnd.random() + 1e-4)))) for g in (1, 2) for i in range(3000)]
    stats = spark.createDataFrame(rows, "stage int, term string, df long, corpus_tf long").repartition(5)
    for k in (1, 100, 1500, 2999, 3000, 15_000):
        got = {(r.stage, r.term) for r in top_terms(stats, k, 2, ("stage",)).collect()}
        want = {(g, r[1]) for g in (1, 2) for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1]))[:k]}
        assert got == want
    one = {r.term for r in top_terms(stats.filter("stage = 1").drop("stage"), 700, 2).collect()}
    assert one == {r[1] for r in sorted((r for r in rows if r[0] == 1), key=lambda r: (-r[3], r[1]))[:700]}


def test_vocabularies_of_arrays_of_groups(spark):
    from mailsift.operators.tfidf import TfidfModel
    rows = [([1, 2], [("a", 2), ("b", 1)]), ([2], [("a", 1), ("c", 3)]), ([1, 2], [("a", 1), ("c", 1)]), ([2], [("b", 1)]), ([2], [])]
    tc = spark.createDataFrame(rows, "groups array<int>, tc array<struct<term:string,tf:bigint>>")
    got = TfidfModel.fit_groups(tc, "groups", 10, 1)
    assert set(got) == {1, 2}
    for g, model in got.items():
        alone = TfidfModel.fit(None, max_features=10, min_df=1, tc=tc.filter(F.array_contains("groups", g)))
        assert (model.vocab, model.n_docs) == (alone.vocab, alone.n_docs)


def test_stages_of_a_run_are_not_held_in_memory(spark):
    from mailsift.plans.pipeline import TextRun
    rows = [(f"0:{k}", f"offer pills {k % 5} now" if k % 2 else f"meeting notes {k % 5} today", "phishing" if k % 2 else "legitimate") for k in range(30)]
    held = set(spark.sparkContext._jsc.getPersistentRDDs())
    run = TextRun(spark, spark.createDataFrame(rows, "row_id string, text string, label string"))
    assert run.scored().count() == 6
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= held
