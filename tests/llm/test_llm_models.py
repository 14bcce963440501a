import numpy as np

from mailsift.llm import factorisation as fm
from mailsift.llm import langid
from mailsift.llm.common import crc_bucket, load

SF = "/root/testdata/sf0.01"
ODD = [(1, None, "en", 3), (2, "", None, None), (3, "12 34 !!", "en", 1), (None, "the word", "en", 0), (4, "x\0y", "en", 3), (4, "x\0y", "en", 3), (5, "é" * 70_000, "fr", 9)]


def test_pair_sum_identity():
    rnd = np.random.default_rng(0)
    m = fm.Machine(0.3, rnd.normal(size=fm.INPUTS), rnd.normal(size=(fm.INPUTS, fm.RANK)) * 0.1, np.zeros(13), np.ones(13))
    at, x = np.array([3, 70, 900, 5000]), rnd.normal(size=4)
    y = m.bias + sum(m.weight[i] * v for i, v in zip(at, x))
    y += sum(m.factor[at[i]] @ m.factor[at[j]] * x[i] * x[j] for i in range(4) for j in range(i + 1, 4))
    assert abs(m.score(at, x) - 1 / (1 + np.exp(-y))) < 1e-9


def test_quality_held_out(spark):
    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    held = crc_bucket("doc_id", 4) == 2
    scores = fm.score(docs, fm.fit(docs, labels.filter(~held))).join(labels.filter(held), "doc_id").collect()
    right = sum((r.score >= fm.KEEP) == (r.quality == 1) for r in scores)
    assert len(scores) > 50 and right >= 0.95 * len(scores)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 0.0) for r in ODD], "doc_id long, text string, lang string, n_chars long, score double")
    labels = spark.createDataFrame([(3, 0, 0), (5, 1, 0), (5, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    out = fm.score(docs, fm.fit(docs, labels)).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    none = fm.score(docs.limit(0), fm.fit(docs.limit(0), labels.limit(0)))
    assert none.count() == 0


def test_gradients_by_differences():
    rnd = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in langid._init(rnd, 3, 4).items()}
    x = rnd.integers(0, 4, (6, 5)).astype(np.uint8)
    x[:, 0] = [1, 2, 3, 0, 0, 0]  # padding
    y = np.array([0, 1, 2, 1, 0])
    as32 = lambda q: {k: v.astype(np.float32) for k, v in q.items()}
    _, g = langid._gradients(as32(p), x, y)
    for k in p:
        flat = np.argsort(-np.abs(g[k]).ravel())[:3]
        for i in flat:
            at = np.unravel_index(i, p[k].shape)
            old, eps = p[k][at], 1e-2
            p[k][at] = old + eps
            up = langid._gradients(as32(p), x, y)[0]
            p[k][at] = old - eps
            down = langid._gradients(as32(p), x, y)[0]
            p[k][at] = old
            assert abs((up - down) / (2 * eps) - g[k][at]) < 2e-3 + 0.05 * abs(g[k][at]), k


def test_language_held_out(spark):
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    held = crc_bucket("doc_id", 5) == 0
    got = langid.identify(docs.filter(held), langid.fit(docs.filter(~held), docs_per_lang=60)).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got)


def test_language_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "z") for r in ODD], "doc_id long, text string, lang string, n_chars long, score string")
    out = langid.identify(docs, langid.fit(docs))
    rows = out.collect()
    assert len(rows) == len(ODD) and out.columns == ["doc_id", "text", "lang", "n_chars", "lang_pred", "score"]
    for r in rows:
        assert (r.lang_pred == "und") == (r.text in (None, "", "12 34 !!")) and 0 <= r.score <= 1
    assert langid.identify(docs.limit(0), langid.fit(docs.limit(0))).count() == 0


def test_windows_do_not_depend_on_the_batch():
    rnd = np.random.default_rng(2)
    model = langid.LanguageModel(["a", "b"], langid._init(rnd, 2, 8))
    raws = [bytes(rnd.integers(1, 255, n).astype(np.uint8)) for n in (0, 1, 63, 64, 65, 1000)]
    whole = model.document_probabilities(raws)
    for r, row in zip(raws, whole):
        assert np.allclose(model.document_probabilities([r])[0], row, atol=1e-5)


def test_first_rows_of_a_group_without_sorting_it(spark):
    from pyspark.sql import functions as F

    from mailsift.llm.common import least_per_group
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("g")).filter("g = 'hot' OR id < 90")
    key = F.xxhash64("doc_id", F.lit(42))
    for k in (7, 40, 2500):
        got = {(r.g, r.doc_id) for r in least_per_group(df, ["g"], [key, F.col("doc_id")], k).collect()}
        rows = df.select("g", "doc_id", key.alias("h")).collect()
        want = {(g, r.doc_id) for g in ("hot", "rare") for r in sorted((r for r in rows if r.g == g), key=lambda r: r.h)[:k]}
        assert got == want


def test_samples_are_bounded_by_rows(spark):
    """An id that repeats thousands of times takes one place in a sample."""
    from pyspark.sql import functions as F

    from mailsift.llm import factorisation, langid
    many = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("das ist ein Text mit Wörtern").alias("text"),
                                    F.lit("de").alias("lang"), F.lit(20).cast("long").alias("n_chars"))
    few = spark.createDataFrame([(i, f"this is a text of words {i}", "en", 20) for i in range(20)], "doc_id long, text string, lang string, n_chars long")
    docs = many.unionByName(few)
    model = langid.fit(docs, docs_per_lang=10)
    assert sorted(model.langs) == ["de", "en"]
    labels = spark.createDataFrame([(5, 1), (5, 1), (5, 0), *[(i, i % 2) for i in range(20)]], "doc_id long, quality int")
    assert factorisation.score(docs, factorisation.fit(docs, labels)).count() == 3020
