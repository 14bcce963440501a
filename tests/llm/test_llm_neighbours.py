import math

import numpy as np
from pyspark.sql import functions as F

from mailsift.llm.blockjoin import SQL, Rounded, TileSearch, exact_cosine, nearest, tile_bounds


def brute(rows, k=5):
    fine = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        fine[i] = np.array(v, np.float64)
    out = {}
    for q, a in fine.items():
        if q % 50:
            continue
        scores = [(-float(exact_cosine(a[None], b[None])[0]), i) for i, b in fine.items() if i != q and len(b) == len(a)]
        out[q] = [i for _, i in sorted(scores)[:k]]
    return out


def test_equals_brute_force_with_odd_vectors(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rnd.normal(size=24)]) for i in range(400)]
    rows += [(400 + i, rows[50][1]) for i in range(30)] + [(430 + i, [2 * x for x in rows[100][1]]) for i in range(5)]
    rows += [(500, [0.0] * 24), (501, None), (502, []), (503, [float("nan")] * 24), (504, [None] + [1.0] * 23), (505, [float("inf")] * 24),
             (550, [1.0, 2.0]), (551, [2.0, 1.0]), (600, [1e-30] * 24), (601, [1e30] * 24), (None, [1.0] * 24), (7, rows[7][1])]
    vectors = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, rank int")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute(rows)
    for query_bytes in (64 << 20, 900):  # one round, and several
        got = {}
        for r in nearest(vectors, F.col("vec_id") % 50 == 0, query_bytes=query_bytes).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == want


def test_a_repeated_id_takes_one_place(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(size=8)]) for i in range(200)]
    near = [x * 1.5 for x in rows[50][1]]
    rows += [(300, near)] * 6  # equal rows
    rows += [(301, [x + float(np.float32(d)) for x in near]) for d in (0.01, 0.02, 0.03, 0.04, 0.05, 3.0)]  # one id, several vectors
    rows += [(150, rows[150][1])] * 5 + [(100, rows[3][1])]  # queries: repeated, and with two vectors
    by_id = {}
    for i, v in rows:
        by_id.setdefault(i, []).append(np.array(v, np.float32).astype(np.float64))
    want = {}
    for q in (0, 50, 100, 150, 300):
        best = {i: max(float(exact_cosine(a[None], b[None])[0]) for a in by_id[q] for b in vs) for i, vs in by_id.items() if i != q}
        want[q] = sorted(best, key=lambda i: (-best[i], i))[:5]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for query_bytes in (64 << 20, 900):  # one round, and several
        got = {}
        for r in nearest(vectors, F.col("vec_id") % 50 == 0, query_bytes=query_bytes).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == want


def test_bounds_hold():
    rnd = np.random.default_rng(1)
    a, b = rnd.normal(size=(40, 16)), rnd.normal(size=(60, 16)) * 10.0 ** rnd.integers(-3, 3, (60, 1))
    cosine, error = tile_bounds(Rounded(a), Rounded(b))
    exact = np.array([[float(exact_cosine(x[None], y[None])[0]) for y in b] for x in a])
    assert (np.abs(exact - cosine) <= error).all() and error.max() < 0.1


def test_chunks_out_of_reach_are_ruled_out_exactly(monkeypatch):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(6, 32))
    rows = np.vstack([c + 0.05 * rnd.normal(size=(1500, 32)) for c in centres])
    queries, ids = rows[::100] + 0.01, np.arange(len(rows))
    tiles = []
    plain = TileSearch._tile
    monkeypatch.setattr(TileSearch, "_tile", lambda self, which, *a: (tiles.append(len(which)), plain(self, which, *a)))
    sample = TileSearch(-1 - np.arange(90), queries, 5)
    sample.add(ids[::7], rows[::7])
    looked, tiles[:] = 0, []
    search = TileSearch(-1 - np.arange(90), queries, 5, sample.worst())
    search.add(ids, rows, np.repeat(np.arange(6), 1500))
    looked = sum(tiles)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    want = {-1 - i: set(np.argsort(-(unit @ q))[:5].tolist()) for i, q in enumerate(queries)}
    got = {}
    for q, r, _ in search.found():
        got.setdefault(q, set()).add(r)
    assert got == want and looked < 0.5 * 90 * 9  # of all queries x chunks


def test_the_twin_agrees_where_ids_repeat(spark):
    import duckdb
    rnd = np.random.default_rng(4)
    rows = [(i % 120, [float(np.float32(x)) for x in rnd.normal(size=6)]) for i in range(200)] + [(50, [1.0] * 6)] * 3
    got = sorted(map(tuple, nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [list(r) for r in rows])
    want = sorted(con.execute(SQL).fetchall())
    assert [(q, r, v) for q, r, v, _ in got] == [(q, r, v) for q, r, v, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_empty_table(spark):
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0
