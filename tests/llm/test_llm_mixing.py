import itertools

import numpy as np

from mailsift.llm.mixing import fit_budget, mix, mixed_documents, source_targets


def test_budget_is_met_as_nearly_as_any_choice():
    rnd = np.random.default_rng(1)
    for _ in range(60):
        sizes = np.unique(rnd.integers(1, 30, 4))
        counts = rnd.integers(1, 4, len(sizes))
        budget = int(rnd.integers(0, (sizes * counts).sum() + 1))
        take = fit_budget(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        fixed = np.array([int(c) * budget // int((sizes * counts).sum()) for c in counts])
        best = max(s for s in (int((sizes * np.array(t)).sum()) for t in itertools.product(*[range(f, c + 1) for f, c in zip(fixed, counts)]))
                   if s <= budget)
        assert int((sizes * take).sum()) == best


def test_large_budget_goes_down_to_the_last_words():
    sizes, counts = np.array([3, 50, 4000]), np.array([1000, 900, 800])
    take = fit_budget(sizes, counts, 1_234_567, last_words=5000)
    assert (take <= counts).all() and abs(int((sizes * take).sum()) - 1_234_567) <= 2


def test_targets_stop_at_twice_the_source():
    t = source_targets([100, 100, 100, 1000], [3, 1, 2, 3])
    assert abs(sum(t) - 1950) < 1e-6 and t[0] == 200 and all(x <= 2 * n for x, n in zip(t, [100, 100, 100, 1000]))
    assert source_targets([], []) == [] and source_targets([0, 0], [3, 1]) == [0.0, 0.0]


def rows():
    out = [(i, "w " * (1 + i * 7 % 23), f"s{i % 4}") for i in range(200)]
    out += [(300, None, "s1"), (301, "", None), (302, "a b", None), (None, "a b c", "s2"), (303, "q " * 400, "s3")]
    return out + [(304, "one two", "s0")] * 3


def test_sources_come_near_their_targets_and_reruns_agree(spark):
    docs = spark.createDataFrame([(*r, 9) for r in rows()], "doc_id long, text string, source string, size int")
    first = mix(docs).collect()
    again = mix(docs.repartition(7)).collect()
    key = lambda r: str((r.doc_id, r.source, r.size, r.copies, r.whole, r.extra, r.target, r.source_size))
    assert sorted(map(key, first)) == sorted(map(key, again))
    by = {}
    for r in first:
        s = by.setdefault(r.source, [r.target, r.source_size, 0])
        s[2] += r.size * (r.whole * r.copies + r.extra)
        assert r.whole + (r.extra > 0) <= 2 and 0 <= r.extra <= r.copies
    words = sum(len((t or "").split()) for _, t, _ in rows())
    assert abs(sum(t for t, *_ in by.values()) - 1.5 * words) < 1e-6
    for target, _, taken in by.values():
        assert abs(target - taken) <= 24


def test_documents_are_repeated_with_all_columns(spark):
    docs = spark.createDataFrame([(*r, 9) for r in rows()], "doc_id long, text string, source string, size int")
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    want = sum(r.whole * r.copies + r.extra for r in mix(docs).collect())
    assert out.count() == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(docs).count() == 0 and mixed_documents(docs).count() == 0
