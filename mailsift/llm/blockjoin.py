"""Nearest neighbours by a block matrix join.

Blocks of queries meet blocks of rows in tiles. In a tile, unit vectors are
rounded to int8 with a scale of their own, one integer matrix product gives
every cosine, and the rounding residuals bound its error. A pair survives if its
upper bound reaches the k-th best lower bound of its query; survivors are
recomputed in double precision on the original vectors, and each query's heap
merges the tiles. Nothing is missed: the bounds are strict, so the result is exact.

Rows are never shuffled for it. A block of queries is broadcast, and every task
runs over its own rows, tile by tile, keeping a heap a query; as many rounds
follow as there are blocks of QUERY_BYTES. Each query comes with a floor, its
k-th best cosine in a bounded sample of the rows: what can't reach it is not
looked at. Rows of a batch are put together by their nearest of a few pivots, so
that a chunk has a small radius around its centre, and the angle to the centre
less the radius rules out whole tiles.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import run_bounds, written

#: Bytes of the queries of a round (as doubles), which are broadcast.
QUERY_BYTES = 64 << 20
#: Rows whose cosines give the queries their floors, at most.
SAMPLE = 8192
_PIVOTS = 32  # of the sample; they only order rows
_BLOCK = 2048  # queries of a tile
_TILE = 1024  # rows of a tile
_SLACK = 1e-6  # for rounding in the bounds themselves


def _units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Rounded:
    """Unit vectors as int8 with a scale each, and the norm of what rounding lost."""

    def take(self, some: np.ndarray) -> Rounded:
        out = object.__new__(Rounded)
        out.scale, out.codes, out.lost = self.scale[some], self.codes[some], self.lost[some]
        return out

    def __init__(self, vectors: np.ndarray):
        unit = _units(vectors)
        self.scale = np.abs(unit).max(axis=1) / 127
        self.codes = np.rint(unit / self.scale[:, None]).astype(np.int8)
        self.lost = np.sqrt(((unit - self.codes * self.scale[:, None]) ** 2).sum(axis=1))


def tile_bounds(q: Rounded, r: Rounded) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of all pairs from one int8 product, and a bound on their error.

    The product runs in float32, which holds sums of 1,024 int8 products exactly.
    """
    dots = np.zeros((len(q.codes), len(r.codes)))
    for at in range(0, q.codes.shape[1], 1024):
        dots += q.codes[:, at:at + 1024].astype(np.float32) @ r.codes[:, at:at + 1024].astype(np.float32).T
    dots *= q.scale[:, None] * r.scale[None, :]
    return dots, q.lost[:, None] + (1 + q.lost)[:, None] * r.lost[None, :] + _SLACK


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


class TileSearch:
    """The k nearest ids of each query, over blocks of rows that come one by one.
    A query is not its own neighbour; an id with several rows counts once, by its
    nearest. ``floors``: a cosine that k ids are known to reach."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.ids, self.queries, self.k = query_ids, queries, k
        self.floors = np.full(len(query_ids), -np.inf) if floors is None else floors - _SLACK
        self.heaps: list[list] = [[] for _ in query_ids]  # (score, -id), the worst first
        self.blocks = [(at, Rounded(queries[at:at + _BLOCK]), _units(queries[at:at + _BLOCK])) for at in range(0, len(query_ids), _BLOCK)]

    def add(self, row_ids: np.ndarray, rows: np.ndarray, order: np.ndarray | None = None) -> None:
        """``order``: a number a row; chunks are made of rows with near numbers."""
        if order is not None:
            by = np.argsort(order, kind="stable")
            row_ids, rows = row_ids[by], rows[by]
        for at in range(0, len(rows), _TILE):
            ids, block = row_ids[at:at + _TILE], rows[at:at + _TILE]
            by = np.argsort(ids, kind="stable")
            ids, block = ids[by], block[by]
            unit = _units(block)
            centre = unit.sum(axis=0)
            length = np.linalg.norm(centre)
            centre = centre / length if length > 1e-9 else unit[0]
            radius = float(np.arccos(np.clip(unit @ centre, -1, 1)).max())
            rounded = Rounded(block)
            for begin, q, u in self.blocks:
                here = np.arange(begin, begin + len(u))
                nearest = np.cos(np.maximum(np.arccos(np.clip(u @ centre, -1, 1)) - radius, 0))
                some = np.flatnonzero(nearest + _SLACK >= self.floors[here])
                if len(some):
                    self._tile(here[some], q.take(some), ids, block, rounded)

    def _tile(self, which: np.ndarray, q: Rounded, ids: np.ndarray, block: np.ndarray, r: Rounded) -> None:
        k = self.k
        cosine, error = tile_bounds(q, r)
        cosine[self.ids[which][:, None] == ids[None, :]] = -np.inf
        lower = cosine - error
        if (ids[1:] == ids[:-1]).any():
            lower = np.maximum.reduceat(lower, run_bounds(ids)[0], axis=1)
        floor = self.floors[which]
        if lower.shape[1] >= k:
            floor = np.maximum(floor, np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k])
        a, b = np.nonzero((cosine + error >= floor[:, None]) & (cosine > -np.inf))
        for begin in range(0, len(a), 65_536):  # survivors, recomputed
            qa, rb = which[a[begin:begin + 65_536]], b[begin:begin + 65_536]
            score = exact_cosine(self.queries[qa], block[rb])
            order = np.lexsort((ids[rb], -score, qa))
            qa, rb, score = qa[order], rb[order], score[order]
            nearest_row = np.sort(np.unique(np.stack([qa, ids[rb]]), axis=1, return_index=True)[1])  # of each id
            qa, rb, score = qa[nearest_row], rb[nearest_row], score[nearest_row]
            first = np.r_[True, qa[1:] != qa[:-1]]
            nth = np.arange(len(qa)) - np.maximum.accumulate(np.where(first, np.arange(len(qa)), 0))
            best = nth < k
            for i, j, s in zip(qa[best].tolist(), ids[rb[best]].tolist(), score[best].tolist()):
                self._put(self.heaps[i], j, s)
                if len(self.heaps[i]) == k:
                    self.floors[i] = max(self.floors[i], self.heaps[i][0][0])

    def _put(self, heap: list, row_id: int, score: float) -> None:
        had = next((n for n, (_, h) in enumerate(heap) if h == -row_id), None)
        if had is not None:
            if score > heap[had][0]:
                heap[had] = (score, -row_id)
                heapq.heapify(heap)
        elif len(heap) < self.k:
            heapq.heappush(heap, (score, -row_id))
        elif (score, -row_id) > heap[0]:
            heapq.heapreplace(heap, (score, -row_id))

    def found(self) -> list[tuple[int, int, float]]:
        """(query id, row id, score)."""
        return [(int(self.ids[i]), -j, s) for i, heap in enumerate(self.heaps) for s, j in heap]

    def worst(self) -> np.ndarray:
        """The k-th best score of each query, -inf if there are fewer."""
        return np.array([heap[0][0] if len(heap) == self.k else -np.inf for heap in self.heaps])


def _matrix(column) -> np.ndarray:
    """A list column whose lists have one length, as doubles."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _nearest_of(dim: int, rows: DataFrame, queries: DataFrame, n_rows: int, n_queries: int, k: int, query_bytes: int) -> list[DataFrame]:
    """(query_id, vec_id, score) of the best of every task's rows, a table a round."""
    sc, unit = rows.sparkSession.sparkContext, 1 << 30
    share = min(unit, math.ceil(unit * SAMPLE * 0.75 / n_rows))
    sample = rows.filter(F.pmod(F.xxhash64("id", "v"), F.lit(unit)) < share).select("id", "v").limit(SAMPLE).collect()
    ids, vectors = np.array([r["id"] for r in sample], np.int64), np.array([r["v"] for r in sample]).reshape(len(sample), dim)
    sent = sc.broadcast((ids, vectors))  # SAMPLE rows at most

    def floors(batches):
        import pyarrow as pa
        for batch in batches:
            search = TileSearch(batch.column(0).to_numpy(), _matrix(batch.column(1)), k)
            search.add(*sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(search.worst())], names=["id", "v", "floor"])

    turns = max(1, math.ceil(n_queries * dim * 8 / query_bytes))
    asked = written(queries.select("id", "v").mapInArrow(floors, "id long, v array<double>, floor double")
                    .withColumn("turn", F.pmod(F.xxhash64("id", "v"), F.lit(turns))), "queries")
    out = []
    for turn in range(turns):
        some = asked.filter(F.col("turn") == turn).select("id", "v", "floor").toArrow()  # query_bytes or so
        if not some.num_rows:
            continue
        block = sc.broadcast((some["id"].to_numpy(), _matrix(some["v"]), some["floor"].to_numpy()))

        def tiles(batches, block=block):
            import pyarrow as pa
            query_ids, asked_for, floor = block.value
            search = TileSearch(query_ids, asked_for, k, floor.copy())
            pivots = _units(sent.value[1][:_PIVOTS]) if len(sent.value[1]) else None
            for batch in batches:
                v = _matrix(batch.column(1))
                search.add(batch.column(0).to_numpy(), v, (_units(v) @ pivots.T).argmax(axis=1) if pivots is not None and len(v) else None)
            cols = list(zip(*search.found())) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())],
                                             names=["query_id", "vec_id", "score"])

        out.append(written(rows.select("id", "v").mapInArrow(tiles, "query_id long, vec_id long, score double"), "tiles"))
    return out


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
            query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Each query's ``k`` nearest rows by cosine: query_id long, rank int (from
    1), vec_id long, score double; ties go to the smaller id; fewer rows, fewer results.

    Rows whose vector is null, empty, zero or holds a null or non-finite
    component, and null ids, take no part; a query is not its own neighbour;
    vectors of different lengths don't meet (each length is searched on its own).
    Repeated rows of an id count once; if their vectors differ, the nearest pair
    of vectors counts.
    """
    raw = F.col(vec_col)
    v = raw.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists(v, lambda x: x != 0)
    rows = (vectors.filter(F.col(id_col).isNotNull())
            .filter(v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), raw.alias("raw"), is_query.alias("q"))
            .groupBy("id", "raw").agg(F.max("q").alias("q"))
            .select("id", F.col("raw").cast("array<double>").alias("v"), "q", F.size("raw").alias("dim")))
    rows = written(rows, "vectors")
    parts = []
    for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("q")).filter("q > 0").collect():
        own = rows.filter(F.col("dim") == r["dim"])
        parts += _nearest_of(r["dim"], own, own.filter("q"), r["n"], r["q"], k, query_bytes)
    found = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for part in parts:
        found = found.unionByName(part)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same in DuckDB SQL for the production parameters, over ``embeddings``.
SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, max(list_cosine_similarity(q.e, c.e)) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e) GROUP BY q.vec_id, c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
