"""The pivot index against all pairs."""
import math

import numpy as np
import pytest

from mailsift.llm import pivots as pv


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def planted(n, dim, seed, low=0.9, high=1.0):
    """n random vectors and a neighbour of each at a cosine drawn from [low, high]."""
    rnd = np.random.default_rng(seed)
    x = unit(rnd.standard_normal((n, dim)))
    z = rnd.standard_normal((n, dim))
    z = unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    c = rnd.uniform(low, high, (n, 1))
    return np.vstack([x, c * x + np.sqrt(1 - c * c) * z])


def brute(vectors, ids):
    """n_links and component of each row."""
    u = unit(np.asarray(vectors))
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    root = np.arange(len(u))
    for _ in range(len(u)):
        new = np.minimum(root, np.where(near, root[None, :], len(u)).min(axis=1))
        if (new == root).all():
            break
        root = new
    return near, {i: int(near[k].sum()) for k, i in enumerate(ids)}, {i: min(ids[j] for j in np.flatnonzero(root == root[k])) for k, i in enumerate(ids)}


def run(spark, vectors, ids, **how):
    df = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>")
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pv.near_vectors(df.repartition(5), **how).collect()}


def as_float(v):
    return np.asarray(v, np.float32).astype(np.float64)


@pytest.mark.parametrize("how", [{}, {"cell": 60}])
def test_recall_and_no_false_link(spark, how):
    vectors = as_float(planted(900, 64, 1))
    ids = list(range(10, 1810))
    _, links, _ = brute(vectors, ids)
    got = run(spark, vectors, ids, **how)
    assert all(got[i][0] <= links[i] for i in ids)
    found = sum(got[i][0] for i in ids) / sum(links.values())
    assert found >= 0.93, found


def test_dense_clusters_are_exact_however_cut(spark):
    rnd = np.random.default_rng(2)
    centres = unit(rnd.standard_normal((6, 32)))
    vectors = as_float(np.vstack([c + 0.02 * rnd.standard_normal((n, 32)) for c, n in zip(centres, (150, 40, 3, 2, 1, 1))]
                                 + [unit(rnd.standard_normal((100, 32)))]))
    ids = [int(i) for i in rnd.permutation(len(vectors))]
    _, links, component = brute(vectors, ids)
    want = {i: (links[i], component[i], component[i] == i) for i in ids}
    assert run(spark, vectors, ids) == want
    assert run(spark, vectors, ids, cell=50) == want  # long lists are cut, then dealt into blocks


def test_chains_reach_the_smallest_id(spark):
    angle = 0.4  # neighbours link (cos 0.92), next ones don't
    vectors = as_float([[math.cos(angle * k), math.sin(angle * k), 0.0] for k in range(7)])
    got = run(spark, vectors, [60, 50, 40, 30, 20, 10, 70])
    assert got == {i: (1 if i in (60, 70) else 2, 10, i == 10) for i in (60, 50, 40, 30, 20, 10, 70)}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, -0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]),
            (9, [None, 1.0]), (10, [1.0]), (11, [1.0, 0.0, 0.0]), (None, [0.0, 1.0]), (None, [0.0, 1.0]), (None, [1.0, 0.01]), (None, None)]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<double>, node string, copies int")
    got = sorted([(r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in pv.near_vectors(df).collect()], key=str)
    want = [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (3, 4, 1, False), *[(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)],
            (0, 1, None, True), (0, 1, None, True), (0, 4, 1, False), (0, 0, None, True)]
    assert got == sorted(want, key=str)


def test_empty_and_huge_values(spark):
    kind = "vec_id long, embedding array<double>"
    assert pv.near_vectors(spark.createDataFrame([], kind)).count() == 0
    df = spark.createDataFrame([(1, [1e300, 1e300]), (2, [1e-300, 1e-300]), (3, [1e300, -1e300])], kind)
    assert sorted((r["vec_id"], r["n_links"]) for r in pv.near_vectors(df).collect()) == [(1, 1), (2, 1), (3, 0)]


def test_shared_pivots_are_counted():
    rnd = np.random.default_rng(5)
    near = np.array([rnd.permutation(40)[:8] for _ in range(120)], np.int32)
    got = {(a, int(b)) for a, others in pv.candidate_pairs(near, 3) for b in others}
    assert got == {(a, b) for a in range(120) for b in range(a + 1, 120) if len(set(near[a]) & set(near[b])) >= 3}


def test_descriptions_are_ordered_by_nearness():
    rnd = np.random.default_rng(6)
    u, p = unit(rnd.standard_normal((50, 16))), unit(rnd.standard_normal((70, 16)))
    assert (pv.describe(u, p, 16) == np.argsort(-(u @ p.T), axis=1)[:, :16]).all()
    assert pv.pivot_count(10) == 64 and pv.pivot_count(10**9) == 4096


def test_pivots_are_spread_out():
    rnd = np.random.default_rng(7)
    crowd = unit(np.vstack([np.eye(16)[0] + 0.05 * rnd.standard_normal((500, 16)), rnd.standard_normal((300, 16))]))
    chosen = pv.spread_out(crowd, 40)
    assert len(chosen) == 40 and ((chosen @ np.eye(16)[0]) > 0.9).sum() <= 1
    assert len(pv.spread_out(crowd[:500], 40)) < 5


@pytest.mark.parametrize("dim", [2, 3, 8, 16, 300])
def test_recall_at_other_dimensions(dim):
    u = planted(600, dim, dim)
    p = pv.spread_out(u[np.random.default_rng(1).permutation(len(u))], pv.pivot_count(len(u)))
    near = pv.describe(u, p, pv.DEPTH)
    met = found = 0
    for a in range(600):
        links = np.flatnonzero(u @ u[a] >= 0.9)
        links = links[links > a]
        met += len(links)
        heads = (near[links, :pv.HEADS, None] == near[a, None, None, :pv.HEADS]).any(axis=(1, 2))
        shared = (near[links][:, :, None] == near[a][None, None, :]).any(axis=2).sum(axis=1)
        found += int((heads & (shared >= min(pv.SHARED, near.shape[1]))).sum())
    assert found >= 0.93 * met, found / met


def test_one_pivot_only(spark):
    rnd = np.random.default_rng(8)
    vectors = as_float(np.eye(8)[0] + 0.03 * rnd.standard_normal((120, 8)))  # all within each other's reach
    got = run(spark, vectors, list(range(120)), cell=30)
    assert all(v == (119, 0, i == 0) for i, v in got.items())


@pytest.mark.parametrize("how", [{}, {"cell": 60, "block": 150, "round_bytes": 1}, {"heads": 1, "shared": 12, "block": 400}])
def test_no_link_is_missed(spark, how):
    vectors = as_float(np.vstack([planted(700, 64, 11, 0.9, 0.92), planted(200, 64, 12)]))
    ids = [int(i) for i in np.random.default_rng(13).permutation(len(vectors))]
    _, links, component = brute(vectors, ids)
    assert run(spark, vectors, ids, **how) == {i: (links[i], component[i], component[i] == i) for i in ids}


@pytest.mark.parametrize("pivots", [2, 3, 5])
def test_cut_lists_of_few_pivots_lose_nothing(spark, pivots):
    rnd = np.random.default_rng(14)
    centres = unit(rnd.standard_normal((6, 8)))
    vectors = as_float(np.vstack([centres[k % 6] + 0.12 * rnd.standard_normal(8) for k in range(240)]))
    ids = list(range(240))
    _, links, component = brute(vectors, ids)
    want = {i: (links[i], component[i], component[i] == i) for i in ids}
    assert run(spark, vectors, ids, pivots=pivots, cell=20, block=30, round_bytes=1) == want


@pytest.mark.parametrize("dim", [1, 2, 3, 8, 64])
def test_planes_keep_all_within_reach(dim):
    rnd = np.random.default_rng(dim)
    u = np.vstack([planted(150, dim, dim), unit(np.eye(dim)[0] + 0.05 * rnd.standard_normal((50, dim)))]) if dim > 1 else np.array([[1.0], [-1.0]] * 20)
    p = pv.spread_out(u[rnd.permutation(len(u))], 40)
    home = pv.describe(u, p, 1)[:, 0]
    met = pv.reached(u, home, p, 0.9)
    a, b = np.nonzero(u @ u.T >= 0.9)
    assert met[a, home[b]].all()
    tight = pv.reached(np.eye(dim), np.arange(dim), np.eye(dim), 0.9)
    assert (tight == np.eye(dim, dtype=bool)).all()  # clusters at right angles don't meet


def test_dense_tiles_and_long_vectors(spark):
    rnd = np.random.default_rng(15)
    near = np.eye(200)[0] + 0.01 * rnd.standard_normal((150, 200))  # more than a 32nd of the tile is within reach
    vectors = as_float(np.vstack([near, planted(60, 200, 16, 0.9, 0.91)]))
    ids = list(range(len(vectors)))
    _, links, component = brute(vectors, ids)
    want = {i: (links[i], component[i], component[i] == i) for i in ids}
    assert run(spark, vectors, ids, shared=17, block=70) == want
    assert run(spark, vectors, ids, heads=1, shared=16, block=70) == want
