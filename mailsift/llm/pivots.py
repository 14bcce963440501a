"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by the pivots (reference points) nearest to it, in order.
Vectors at a small angle order the pivots alike, so they meet in the inverted
lists of their nearest pivots, and the number of pivots two descriptions share
tells which pairs to verify by cosine in double precision.

* Equal vectors are one node with a count, so copies cost nothing.
* Each node goes to the lists of its ``heads`` nearest pivots. In a list, one
  task counts shared pivots through postings (pivot -> nodes) and verifies the
  pairs that share ``shared`` or more of their ``depth`` nearest. A pair is
  taken only in the least list both are in, so it counts once.
* A list longer than ``cell`` is cut by each node's next nearest pivots; a list
  that is still longer (a dense cluster) is dealt into blocks, and every pair
  of blocks is a task.
* The pairs the lists leave out (no common list, too few shared pivots, no common
  part of a cut list) are compared exactly, see :func:`rest_links`: nodes are dealt
  into blocks by their nearest pivot, and a node meets the blocks that the planes
  between pivots don't rule out. So no link is missed. Where vectors have no
  clusters the planes rule out little, and that is all pairs of blocks.
* A task returns, for each node, how many vectors it links to and one link of
  a spanning forest, never the pairs.

The number of pivots grows with the square root of the table. They are drawn
from a bounded sample, spread out so that a cluster doesn't take many of them;
every row is indexed.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blockjoin import _matrix, _units
from .common import join_skewed, written
from .components import connected_components

THRESHOLD = 0.9
#: Lists a vector is in; pivots of its description; pivots a pair must share.
HEADS, DEPTH, SHARED = 4, 16, 4
#: Nodes of a list that one task takes.
CELL = 8192
#: Pivots: twice the root of the number of vectors, within these bounds. The sample has at most SAMPLE rows a pivot.
LEAST, MOST, SAMPLE = 64, 4096, 4
#: Dimensions (the most frequent) whose pivots are sampled; further ones get random directions.
DIMENSIONS = 64
_APART = 0.8  # greatest cosine of two pivots
_WHOLE, _ALONE = -1, -2  # instead of a second pivot: the list isn't cut; there is no other pivot
_PAIRS = 1 << 16  # pairs verified at once
#: The rest: bytes of a block (as doubles), its nodes at least, and blocks of a table that has enough nodes for them;
#: what a round sends, in times of the index, or in bytes (as doubles) if that is more.
BLOCK_BYTES, SMALL, FEWEST, COPIES, ROUND_BYTES = 16 << 20, 512, 8, 2, 256 << 20
_TILE = 1024  # rows and columns of a product of the rest
_SLACK = 1e-6  # for rounding in bounds


def pivot_count(n: int) -> int:
    return min(MOST, max(LEAST, 1 << max(0, round(math.log2(2 * math.sqrt(max(n, 1)))))))


def spread_out(sample: np.ndarray, count: int) -> np.ndarray:
    """At most ``count`` rows of ``sample`` (unit vectors): the first, then each
    time the one farthest from those taken, while that is apart from them."""
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        far = int(nearest.argmin())
        if nearest[far] >= _APART:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, sample @ sample[far])
    return sample[chosen]


def directions(dim: int) -> np.ndarray:
    """Seeded random pivots, for a dimension of which there is no sample."""
    return _units(np.random.default_rng(dim).standard_normal((LEAST, dim)))


def describe(units: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The numbers of the ``depth`` nearest pivots, nearest first."""
    cosine = units @ pivots.T
    depth = min(depth, pivots.shape[0])
    near = np.argpartition(-cosine, depth - 1, axis=1)[:, :depth] if depth < pivots.shape[0] else np.tile(np.arange(depth), (len(units), 1))
    order = np.argsort(-np.take_along_axis(cosine, near, axis=1), axis=1, kind="stable")
    return np.take_along_axis(near, order, axis=1).astype(np.int32)


def candidate_pairs(near: np.ndarray, shared: int):
    """Yields (a, others): rows after ``a`` whose descriptions share ``shared``
    pivots or more with it (all, if there are fewer), counted through the postings."""
    n, depth = near.shape
    shared = min(shared, depth)
    flat = near.ravel()
    by_pivot = np.argsort(flat, kind="stable")
    members = by_pivot // depth
    pivots, at = np.unique(flat[by_pivot], return_index=True)
    ends = np.r_[at[1:], len(flat)]
    slot = np.searchsorted(pivots, near)
    for a in range(n):
        counts = np.bincount(np.concatenate([members[at[s]:ends[s]] for s in slot[a]]), minlength=n)
        others = np.flatnonzero(counts[a + 1:] >= shared) + a + 1
        if len(others):
            yield a, others


def _least_common(x: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """The least number that row x has in common with each row of ys (a large one if none)."""
    return np.where((ys[:, :, None] == x[None, None, :]).any(axis=2), ys, np.iinfo(np.int32).max).min(axis=1)


class Links:
    """Of the nodes of one task: the number of vectors each links to, and the
    first node of its component."""

    def __init__(self, units: np.ndarray, copies: np.ndarray, threshold: float):
        self.units, self.copies, self.threshold = units, copies, threshold
        self.count, self.root = np.zeros(len(units), np.int64), np.arange(len(units))

    def verify(self, a: np.ndarray, b: np.ndarray, but=None) -> None:
        """Links the pairs that reach the threshold; ``but``: (a, b) -> those to leave out."""
        root = self.root
        hit = (self.units[a] * self.units[b]).sum(axis=1) >= self.threshold
        a, b = a[hit], b[hit]
        if but is not None and len(a):
            keep = ~but(a, b)
            a, b = a[keep], b[keep]
        np.add.at(self.count, a, self.copies[b])
        np.add.at(self.count, b, self.copies[a])
        new = root[a] != root[b]
        for x, y in zip(a[new].tolist(), b[new].tolist()):
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
        while (root[root] != root).any():
            root[:] = root[root]


def linked(units: np.ndarray, copies: np.ndarray, near: np.ndarray, lists: list[tuple[np.ndarray, int]], sides: np.ndarray | None,
           shared: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each node of one task, the number of vectors it links to here and the
    first node of its component among these. ``lists``: (the lists each node is
    in, the one this task has), level by level; a pair is taken if its least
    common list is this one. ``sides``: pairs must be of different sides."""
    links = Links(units, copies, threshold)
    left, right, waiting = [], [], 0
    for a, others in candidate_pairs(near, shared):
        if sides is not None:
            others = others[sides[others] != sides[a]]
        for inside, own in lists:
            others = others[_least_common(inside[a], inside[others]) == own]
        if len(others):
            left.append(np.full(len(others), a))
            right.append(others)
            waiting += len(others)
        if waiting >= _PAIRS:
            links.verify(np.concatenate(left), np.concatenate(right))
            left, right, waiting = [], [], 0
    if waiting:
        links.verify(np.concatenate(left), np.concatenate(right))
    return links.count, links.root


def _next_lists(near: np.ndarray, own: int, heads: int) -> np.ndarray:
    """The ``heads`` nearest pivots but ``own`` (one of each row's)."""
    other = near != own
    first = np.argsort(~other, axis=1, kind="stable")[:, :min(heads, near.shape[1] - 1)]
    return np.take_along_axis(near, first, axis=1)


def listed(x: np.ndarray, y: np.ndarray, heads: int, shared: int, long: np.ndarray) -> np.ndarray:
    """Which pairs (row by row of two sets of descriptions) the lists verify;
    ``long``: the lists that are cut."""
    depth, none = x.shape[1], np.iinfo(np.int32).max
    same = x[:, :, None] == y[:, None, :]
    met = same.any(axis=2).sum(axis=1) >= min(shared, depth)
    least = np.where(same[:, :heads, :heads].any(axis=2), x[:, :heads], none).min(axis=1)
    met &= least < none
    cut = np.flatnonzero(met & np.isin(least, long)) if depth > 1 else []
    if len(cut):
        own = least[cut, None]
        met[cut] = (_next_lists(x[cut], own, heads)[:, :, None] == _next_lists(y[cut], own, heads)[:, None, :]).any(axis=(1, 2))
    return met


def reached(units: np.ndarray, home: np.ndarray, pivots: np.ndarray, threshold: float) -> np.ndarray:
    """rows x pivots: whether a vector nearest to that pivot can be within the
    threshold of the row. Such a vector is on the pivot's side of the plane half
    way to the row's own nearest pivot (``home``); the row's distance from that
    plane is the sine of the least angle between them."""
    if threshold <= 0:
        return np.ones((len(units), len(pivots)), bool)
    slack = _SLACK + 4e-7 * units.shape[1]  # float32 is that exact
    units, pivots = units.astype(np.float32), pivots.astype(np.float32)
    cosine = units @ pivots.T
    gap = cosine[np.arange(len(units)), home][:, None] - cosine
    apart = np.sqrt(np.maximum(2 - 2 * (pivots[home] @ pivots.T), 0) + np.float32(slack))
    return gap <= np.float32(math.sqrt(max(0.0, 1 - threshold * threshold))) * apart + np.float32(slack)


def far_links(units: np.ndarray, copies: np.ndarray, near: np.ndarray, sides: np.ndarray | None, pivots: np.ndarray, heads: int,
              shared: int, long: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`linked`, for the pairs of one task that the lists don't verify.

    Nodes go by their nearest pivot into chunks; two chunks whose centres are
    farther apart than their radii and the threshold's angle are skipped. Others
    are one float32 product: the first directions of the pivots' span exactly, and
    of what is left the product of the lengths, so it bounds the cosine from
    above. What reaches the threshold by it is verified in double precision."""
    links = Links(units, copies, threshold)
    dim, angle = units.shape[1], math.acos(min(1.0, max(-1.0, threshold))) + _SLACK
    low = np.float32(threshold - 1e-5 - 2e-7 * dim)  # the float32 product may be that much too small
    full = 16 + dim // 8
    if full < 0.6 * dim:
        part = units @ np.linalg.qr(pivots[:full].T)[0]
        short = np.column_stack([part, np.sqrt(np.maximum(1 - (part * part).sum(axis=1), 0))]).astype(np.float32)
    else:
        short = units.astype(np.float32)

    def chunks(rows):
        rows = rows[np.argsort(near[rows, 0], kind="stable")]
        out = []
        for at in range(0, len(rows), _TILE):
            some = rows[at:at + _TILE]
            centre = units[some].sum(axis=0)
            length = np.linalg.norm(centre)
            centre = centre / length if length > 1e-9 else units[some[0]]
            out.append((some, centre, float(np.arccos(np.clip(units[some] @ centre, -1, 1)).max())))
        return out

    def verified(a, b):
        return listed(near[a], near[b], heads, shared, long)

    if sides is None:
        left = right = chunks(np.arange(len(units)))
    else:
        first = sides == sides.min()
        left, right = chunks(np.flatnonzero(first)), chunks(np.flatnonzero(~first))
    for k, (a, centre, radius) in enumerate(left):
        for b, other, further in right[k:] if left is right else right:
            if math.acos(min(1.0, max(-1.0, float(centre @ other)))) - radius - further > angle:
                continue
            rough = short[a] @ short[b].T >= low
            if np.count_nonzero(rough) * 32 > rough.size and short.shape[1] < dim:
                rough = units[a].astype(np.float32) @ units[b].astype(np.float32).T >= low
            some = np.flatnonzero(rough.any(axis=1))
            x, y = np.nonzero(rough[some])
            x = some[x]
            if a is b:
                x, y = x[x < y], y[x < y]
            for at in range(0, len(x), _PAIRS):
                links.verify(a[x[at:at + _PAIRS]], b[y[at:at + _PAIRS]], verified)
    return links.count, links.root


def _clean(vec_col: str) -> tuple[Column, Column]:
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists(v, lambda x: x != 0)
    return v, F.coalesce(fine, F.lit(False))


def fit_pivots(rows: DataFrame, count: int | None = None) -> dict[int, np.ndarray]:
    """dimension -> pivots (unit vectors), from a hash-chosen sample of ``rows`` (v, dim, h1, h2)."""
    sizes = {r[0]: r[1] for r in rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(DIMENSIONS).collect()}
    if not sizes:
        return {}
    wanted = {dim: min(count or pivot_count(n), MOST) for dim, n in sizes.items()}
    unit = 1 << 30
    share = F.create_map(*[F.lit(x) for dim, n in sizes.items() for x in (int(dim), min(unit, math.ceil(unit * SAMPLE * wanted[dim] / n)))])
    some = (rows.filter(F.pmod("h2", F.lit(unit)) < F.coalesce(share[F.col("dim")], F.lit(0))).dropDuplicates(["h1", "h2"])
            .select("dim", "h1", F.col("v").cast("array<double>").alias("v")).limit(2 * SAMPLE * sum(wanted.values())).collect())
    out = {}
    for dim, n in wanted.items():
        mine = sorted((r["h1"], r["v"]) for r in some if r["dim"] == dim)
        out[dim] = spread_out(_units(np.array([v for _, v in mine])), n) if mine else directions(dim)
    return out


def pivot_index(nodes: DataFrame, pivots: dict[int, np.ndarray], depth: int = DEPTH) -> DataFrame:
    """``nodes`` (v, dim, ...) with near array<int>: their nearest pivots in order."""
    sent = nodes.sparkSession.sparkContext.broadcast(pivots)  # at most MOST pivots for DIMENSIONS dimensions
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)

    def run(batches):
        import pyarrow as pa
        table = dict(sent.value)
        for batch in batches:
            for dim in np.unique(batch.column("dim").to_numpy()).tolist():
                rows = batch.filter(pa.array(batch.column("dim").to_numpy() == dim))
                if dim not in table:
                    table[dim] = directions(dim)
                flat = rows.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                near = describe(_units(flat.reshape(-1, dim)), table[dim], depth)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], names=[*rows.schema.names, "near"])

    return nodes.mapInArrow(run, f"{ddl}, near array<int>")


def long_lists(index: DataFrame, heads: int = HEADS, cell: int = CELL) -> DataFrame:
    """(dim, p, long): the lists with more than ``cell`` nodes."""
    lean = index.select("dim", F.explode(F.slice("near", 1, heads)).alias("p"))
    return written(lean.groupBy("dim", "p").count().filter(F.col("count") > cell).withColumn("long", F.lit(True)).drop("count"), "pivot-long")


def pivot_links(index: DataFrame, sizes: DataFrame, threshold: float = THRESHOLD, heads: int = HEADS, shared: int = SHARED,
                cell: int = CELL) -> DataFrame:
    """``index`` (node, dim, copies, v, near) -> (node, links, other): the vectors
    a node links to, in parts to be summed, and links (node, other) that span
    all components; nodes without a link don't appear. ``sizes``: the long lists.
    Pairs that meet in no list are left to :func:`rest_links`."""
    lean = index.select("node", "dim", "near", F.explode(F.slice("near", 1, heads)).alias("p"))
    lists = index.withColumn("p", F.explode(F.slice("near", 1, heads)))
    if sizes.isEmpty():
        cells = lists.withColumns({"q": F.lit(_WHOLE), "i": F.lit(-1), "j": F.lit(-1), "side": F.lit(-1)})
    else:
        others = F.slice(F.filter("near", lambda x: x != F.col("p")), 1, heads)
        nexts = F.when(F.size(others) > 0, others).otherwise(F.array(F.lit(_ALONE)))
        cut = lambda rows: (rows.join(F.broadcast(sizes), ["dim", "p"], "left")  # a row a list: MOST * DIMENSIONS at most
                            .withColumn("q", F.explode(F.when(F.col("long"), nexts).otherwise(F.array(F.lit(_WHOLE))))).drop("long"))
        blocks = (cut(lean).filter(F.col("q") != _WHOLE).groupBy("dim", "p", "q").agg(F.count(F.lit(1)).alias("n"))
                  .filter(F.col("n") > cell).select("dim", "p", "q", F.ceil(F.col("n") / cell).cast("int").alias("g")))
        cells = (cut(lists).join(written(blocks, "pivot-blocks"), ["dim", "p", "q"], "left").withColumn("g", F.coalesce("g", F.lit(1)))
                 .withColumn("side", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
                 .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
                 .withColumns({"i": F.least("side", "k"), "j": F.greatest("side", "k")}).drop("g", "k"))

    def task(key, table):
        import pyarrow as pa
        _, p, q, i, j = (k.as_py() for k in key)
        out = [[], [], []]
        if table.num_rows > 1:
            node = table["node"].to_numpy()
            order = np.argsort(node, kind="stable")
            node, near = node[order], np.stack(table["near"].to_numpy())[order]
            levels = [(near[:, :heads], p)]
            if q >= 0:
                levels.append((_next_lists(near, p, heads), q))
            sides = table["side"].to_numpy()[order] if i != j else None
            links, root = linked(_units(_matrix(table["v"]))[order], table["copies"].to_numpy()[order], near, levels, sides, shared, threshold)
            hit = np.flatnonzero(links)
            out = [node[hit], links[hit], node[root[hit]]]
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["node", "links", "other"])

    return (cells.select("dim", "p", "q", "i", "j", "side", "node", "copies", "v", "near").groupBy("dim", "p", "q", "i", "j")
            .applyInArrow(task, "node long, links long, other long"))


def rest_blocks(index: DataFrame, pivots: dict[int, np.ndarray], block: int | None = None) -> dict[int, tuple[np.ndarray, ...]]:
    """dimension -> (order, first, parts, blocks): the pivots put in an order that
    keeps near ones together; of each pivot the first block of the nodes nearest to
    it and the number of blocks they have to themselves (0: no such node), and how
    many blocks there are in all. Pivots with few nodes share a block."""
    cells: dict[int, dict[int, int]] = {}
    for r in index.groupBy("dim", F.col("near")[0].alias("p")).count().collect():  # a row a pivot
        cells.setdefault(r["dim"], {})[r["p"]] = r["count"]
    out = {}
    for dim, sizes in cells.items():
        total, own = sum(sizes.values()), pivots[dim] if dim in pivots else directions(dim)
        most = block or max(SMALL, min(BLOCK_BYTES // (8 * dim), math.ceil(total / FEWEST)))
        wide = own[:max(1, math.ceil(total / most))]
        order = np.argsort((own @ wide.T).argmax(axis=1), kind="stable")
        first, parts, at, full = np.zeros(len(own), np.int32), np.zeros(len(own), np.int32), 0, 0
        for p in order.tolist():
            n = sizes.get(p, 0)
            if n and full and full + n > most:
                at, full = at + 1, 0
            first[p], parts[p] = at, math.ceil(n / most)
            at, full = (at + int(parts[p]), 0) if n > most else (at, full + n)
        out[dim] = order, first, parts, at + bool(full)
    return out


def rest_links(index: DataFrame, sizes: DataFrame, pivots: dict[int, np.ndarray], threshold: float = THRESHOLD, heads: int = HEADS,
               shared: int = SHARED, block: int | None = None, round_bytes: int = ROUND_BYTES) -> list[DataFrame]:
    """As :func:`pivot_links`, for all pairs that its lists don't verify; exact.

    Two blocks are a task, with the nodes of each that can be within the threshold
    of one in the other (:func:`reached`). The nodes a round sends to tasks are
    COPIES times the index or ``round_bytes``, so the disk doesn't grow with the
    number of blocks; there are as many rounds as that takes."""
    plan = rest_blocks(index, pivots, block)
    if not plan:
        return []
    long: dict[int, list[int]] = {}
    for r in sizes.select("dim", "p").collect():  # of at most MOST pivots for DIMENSIONS dimensions
        long.setdefault(r["dim"], []).append(r["p"])
    sent = index.sparkSession.sparkContext.broadcast((pivots, plan, long))
    names = ["dim", "node", "copies", "v", "near"]
    kind = f"dim int, node long, copies long, v {index.schema['v'].dataType.simpleString()}, near array<int>"

    def mark(batches):
        """Adds the node's block, a bit for each block it is sent to, and how many these are."""
        import pyarrow as pa
        pivots, plan, _ = sent.value
        for whole in batches:
            dims = whole.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                mine = whole.filter(pa.array(dims == dim))
                order, first, parts, blocks = plan[dim]
                used = order[parts[order] > 0]
                starts = np.unique(first[used], return_index=True)[1]
                spans = np.diff(np.r_[first[used][starts], blocks])  # one block, or all of one pivot
                for at in range(0, mine.num_rows, _TILE):
                    rows = mine.slice(at, _TILE)
                    home = np.stack(rows.column("near").to_numpy(zero_copy_only=False))[:, 0]
                    side = (first[home] + rows.column("h").to_numpy() % parts[home]).astype(np.int32)
                    to = np.ones((len(home), blocks), bool)
                    if blocks > 1:
                        met = reached(_units(_matrix(rows.column("v"))), home, pivots[dim] if dim in pivots else directions(dim), threshold)
                        to = np.repeat(np.logical_or.reduceat(met[:, used], starts, axis=1), spans, axis=1)
                        to[np.arange(len(home)), side] = True
                    bits = pa.array([row.tobytes() for row in np.packbits(to, axis=1)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in names], pa.array(side), bits, pa.array(to.sum(axis=1), pa.int64())],
                                                     names=[*names, "side", "bits", "sent"])

    def deal(turn, rounds):
        def run(batches):
            import pyarrow as pa
            for whole in batches:
                for at in range(0, whole.num_rows, _TILE):
                    rows = whole.slice(at, _TILE)
                    side, bits = rows.column("side").to_numpy(), rows.column("bits").to_pylist()
                    to = [np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8))) for b in bits]
                    to = [k[(k + s) % rounds == turn] for k, s in zip(to, side.tolist())]
                    row, other = np.repeat(np.arange(len(to)), [len(k) for k in to]), np.concatenate(to).astype(np.int32)
                    key = [np.minimum(side[row], other), np.maximum(side[row], other), side[row]]
                    kept = rows.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in names], *[pa.array(k, pa.int32()) for k in key]],
                                                     names=[*names, "i", "j", "side"])
        return run

    def task(key, table):
        import pyarrow as pa
        dim, i, j = (k.as_py() for k in key)
        out = [[], [], []]
        if table.num_rows > 1:
            node = table["node"].to_numpy()
            order = np.argsort(node, kind="stable")
            sides = table["side"].to_numpy()[order] if i != j else None
            if sides is None or sides.min() < sides.max():
                pivots, _, long = sent.value
                node, near = node[order], np.stack(table["near"].to_numpy())[order]
                links, root = far_links(_units(_matrix(table["v"]))[order], table["copies"].to_numpy()[order], near, sides,
                                        pivots[dim] if dim in pivots else directions(dim), heads, shared, np.array(long.get(dim, []), np.int32), threshold)
                hit = np.flatnonzero(links)
                out = [node[hit], links[hit], node[root[hit]]]
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["node", "links", "other"])

    marked = written(index.select(*names, F.xxhash64("node").alias("h")).mapInArrow(mark, f"{kind}, side int, bits binary, sent long"), "pivot-marked")
    asked, own = marked.agg(F.sum(F.col("sent") * F.col("dim") * 8), F.sum(F.col("dim").cast("long") * 8)).first()
    rounds = max(1, math.ceil(asked / max(COPIES * own, round_bytes)))
    return [written(marked.mapInArrow(deal(turn, rounds), f"{kind}, i int, j int, side int").groupBy("dim", "i", "j")
                    .applyInArrow(task, "node long, links long, other long"), "pivot-rest") for turn in range(rounds)]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD,
                 pivots: int | None = None, heads: int = HEADS, depth: int = DEPTH, shared: int = SHARED, cell: int = CELL, block: int | None = None,
                 round_bytes: int = ROUND_BYTES) -> DataFrame:
    """A row per input row: vec_id, n_links (other rows with cosine >=
    ``threshold``), component_id (smallest id reachable), kept (it is its own).

    Vectors that are null, empty, zero or hold a null or non-finite component
    link with nothing; vectors of different lengths don't meet. Rows count one
    by one, also if they repeat an id. A null id names no component: such a row
    gets the smallest id its component has, or null, and is kept only if there
    is none. Other columns are not kept; an empty table gives an empty table.
    No pair below the threshold is ever linked, and none at it or above is missed.
    """
    raw, (v, fine) = F.col(vec_col), _clean(vec_col)
    # adding 0.0 makes -0.0 equal to 0.0, as the comparison of vectors does
    flat = F.transform(v, lambda x: x + F.lit(0.0))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), raw.alias("v"), fine.alias("fine"), F.size(raw).alias("dim"),
                          F.xxhash64(flat).alias("h1"), F.xxhash64(F.lit(42), flat).alias("h2"))
    good = rows.filter("fine")
    nodes = (good.groupBy("h1", "h2", "dim", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
             .withColumn("node", F.monotonically_increasing_id()))
    points = fit_pivots(good, pivots)
    index = written(pivot_index(nodes, points, depth), "pivot-index")
    sizes = long_lists(index, heads, cell)
    found = written(pivot_links(index, sizes, threshold, heads, shared, cell), "pivot-links")
    for part in rest_links(index, sizes, points, threshold, heads, shared, block, round_bytes):
        found = found.unionByName(part)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    parts = written(parts.join(index.select("node", "least"), "node"), "pivot-parts")
    names = written(parts.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "pivot-names")
    parts = join_skewed(parts.select("node", "component"), names, ["component"], "n").select("node", F.lit(True).alias("linked"), "component_id")
    result = written(index.select("node", "h1", "h2", "copies", "least").join(links, "node", "left").join(parts, "node", "left")
                     .select("h1", "h2", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                             F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id")), "pivot-result")
    alone = rows.filter(~F.col("fine")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = join_skewed(good.select("vec_id", "h1", "h2"), result, ["h1", "h2"], "copies").select("vec_id", "n_links", "component_id")
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: The same by brute force in DuckDB SQL, over ``embeddings``.
SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e,
         embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine FROM embeddings),
pairs AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND a.fine AND b.fine AND len(a.e) = len(b.e)
          AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT r, r FROM v UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON pairs.a = reach.b),
least AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a)
SELECT v.vec_id, (SELECT count(*) FROM pairs WHERE pairs.a = v.r) AS n_links, component_id, v.vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN least ON least.r = v.r
"""
