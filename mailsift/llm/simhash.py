"""SimHash near-duplicates through BK-trees.

Fingerprints: every word shingle's 64-bit XXH64, repeats included; a bit is 1
if more than half of the shingles set it. Two documents link if their
fingerprints differ in at most ``radius`` bits; the result names each
document's component.

Search. Equal fingerprints are one node first, so copies cost nothing. With
``radius`` r, cut the 64 bits into r + 1 blocks: fingerprints within r bits
agree on one block. Each block value is a shard; its fingerprints form a
BK-tree (children keyed by their integer Hamming distance to the parent) and
are looked up in it, following only edges within r of their own distance. A
shard with more than ``hot`` fingerprints is cut again, on its free bits, by
the same rule, so every shard stays bounded without losing a link. The trees
are not sent to every executor: together they are as large as all
fingerprints, which has no size bound; each goes to the task that holds the
fingerprints that can meet it. Within a shard a union-find keeps one link per
fingerprint instead of all pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, run_bounds, written
from .components import connected_components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints of one shard before it is cut again.
HOT = 4096
_LANES = np.uint64(0x0101010101010101)


def fingerprint_hashes(raw: bytes, shingle: int, seed: int) -> list[int]:
    from xxhash import xxh64_intdigest
    words = raw.lower().split()  # bytes: only A-Z, only ASCII white space
    if len(words) < shingle:
        return [xxh64_intdigest(b" ".join(words), seed)] if words else []
    return [xxh64_intdigest(b" ".join(s), seed) for s in zip(*(words[k:] for k in range(shingle)))]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Majority bit vectors of consecutive runs of ``hashes`` (zero for runs of none)."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    # byte lanes hold up to 255 counts, so runs are summed in steps of at most 255
    n = counts[full]
    steps = -(-n // 255)
    begin = np.cumsum(n) - n
    step_of = np.repeat(np.arange(len(full)), steps)
    nth = np.arange(len(step_of)) - np.repeat(np.cumsum(steps) - steps, steps)
    edges = begin[step_of] + 255 * nth
    first_step = np.cumsum(steps) - steps
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & _LANES, edges)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_step, axis=0)
        bits = (2 * sums > n[:, None]).astype(np.uint64)
        out[full] |= (bits << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(j))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 seed: int = SEED) -> DataFrame:
    """(``id_col``, fp long). Fewer words than a shingle: the whole sequence;
    null, empty or wordless: zero. Only these two columns are kept."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import gc

        import pyarrow as pa
        gc.disable()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [fingerprint_hashes((t or "").encode(), shingle, seed) for t in part.column(1).to_pylist()]
                counts = np.array([len(f) for f in found], np.int64)
                flat = np.fromiter((h for f in found for h in f), np.uint64, int(counts.sum()))
                fp = majority_bits(flat, counts).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


class BKTree:
    """A BK-tree over distinct 64-bit values as arrays, built a level at a time.

    Node i's children hang on integer distances to it; :meth:`within` walks the
    tree for many queries at once and follows an edge only if it is within the
    radius of the query's own distance.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        n = len(values)
        self.edge = np.zeros(n, np.int64)
        parent = np.full(n, -1, np.int64)
        items, above = np.arange(1, n), np.zeros(max(n - 1, 0), np.int64)
        while len(items):
            d = np.bitwise_count(values[items] ^ values[above]).astype(np.int64)
            slot = above * 65 + d
            _, first, group = np.unique(slot, return_index=True, return_inverse=True)
            nodes = items[first]  # the first of each slot becomes the child there
            parent[nodes], self.edge[nodes] = above[first], d[first]
            rest = np.ones(len(items), bool)
            rest[first] = False
            items, above = items[rest], nodes[group[rest]]
        self.children = np.argsort(parent, kind="stable")
        counts = np.bincount(parent[parent >= 0], minlength=n)
        self.first = np.cumsum(counts) - counts + 1  # the root, with parent -1, sorts first
        self.count = counts

    def within(self, queries: np.ndarray, radius: int):
        """Yields (query index, node index) arrays of pairs within ``radius``."""
        for at in range(0, len(queries), 512):
            q = np.arange(at, min(at + 512, len(queries)))
            node = np.zeros(len(q), np.int64)
            while len(q):
                d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                n = self.count[node]
                q, d, low = np.repeat(q, n), np.repeat(d, n), np.repeat(self.first[node], n)
                step = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
                node = self.children[low + step]
                keep = np.abs(self.edge[node] - d) <= radius
                q, node = q[keep], node[keep]


def shard_links(values: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct ``values``, the index of its component's first
    member among them (links: at most ``radius`` bits apart)."""
    root = np.arange(len(values))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for q, node in BKTree(values).within(values, radius):
        new = root[q] != root[node]  # linked already: nothing to add
        for a, b in zip(q[new].tolist(), node[new].tolist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(len(values))])


def _cuts(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` runs of ``bits``."""
    sizes = [len(bits) // parts + (k < len(bits) % parts) for k in range(parts)]
    masks, at = [], 0
    for size in sizes:
        masks.append(sum(1 << b for b in bits[at:at + size]))
        at += size
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """``nodes`` (fp long, distinct; node long) -> links (a long, b long) between
    node ids that span the components of all pairs within ``radius`` bits."""
    masks = _cuts(list(range(64)), radius + 1)

    def keyed(rows: DataFrame, choices) -> DataFrame:
        mask = F.explode(F.array(*[F.lit(_signed(m)) for m in choices]))
        return rows.select("fp", "node", mask.alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))

    live, settled = keyed(nodes, masks), []
    for _ in range(2):  # 21, then 35, then 44 bits fixed
        crowded = written(live.groupBy("mask", "value").count().filter(F.col("count") > hot).drop("count"), "simhash-hot")
        if crowded.isEmpty():
            break
        marked = live.join(crowded.withColumn("_hot", F.lit(True)), ["mask", "value"], "left")
        settled.append(marked.filter(F.col("_hot").isNull()).drop("_hot"))
        finer = {m: [m | p for p in _cuts([b for b in range(64) if not m >> b & 1], radius + 1)] for m in masks}
        masks = [x for m in masks for x in finer[m]]
        table = F.create_map(*[x for m, more in finer.items()
                               for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(p)) for p in more]))])
        live = written(marked.filter("_hot").select("fp", "node", F.explode(table[F.col("mask")]).alias("mask"))
                       .withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))), "simhash-cut")
    for more in settled:
        live = live.unionByName(more)

    def link(batches):
        import pyarrow as pa
        names, held = ["a", "b"], None

        def links(mask, value, fp, node):
            starts, stops = run_bounds(np.stack([mask, value], 1).view("V16").ravel() if len(mask) else mask)
            many = np.flatnonzero(stops - starts > 1)
            a, b = [], []
            for s, e in zip(starts[many].tolist(), stops[many].tolist()):
                at = shard_links(fp[s:e].view(np.uint64), radius) + s
                off = np.flatnonzero(at != np.arange(s, e)) + s
                a.append(node[off])
                b.append(node[at[off - s]])
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(cat(a)), pa.array(cat(b))], names=names)

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "value", "fp", "node")]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not len(cols[0]):
                continue
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [np.ascontiguousarray(c[cut:]) for c in cols]
            if cut:
                yield links(*[np.ascontiguousarray(c[:cut]) for c in cols])
        if held is not None:
            yield links(*held)

    return (live.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
            .select("mask", "value", "fp", "node").mapInArrow(link, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, hot: int = HOT, seed: int = SEED) -> DataFrame:
    """One row per document: ``id_col``, fp long, component_id (the smallest id
    reachable over links, itself included).

    Fingerprints are the nodes; ids only name their components. Ids are longs;
    rows that repeat an id each get a row. A null id names nothing: such a row
    links like any other and gets its component's smallest id, null if no row
    of it has one. Documents without a word share the fingerprint zero. Other
    columns are not kept. An empty table gives an empty table.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle, seed), "simhash")
    nodes = written(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("copies")), "simhash-nodes")
    parts = connected_components(fingerprint_links(nodes.select("fp", F.col("fp").alias("node")), radius, hot))
    parts = written(parts.join(nodes.select(F.col("fp").alias("node"), "least"), "node"), "simhash-parts")
    names = written(parts.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "simhash-names")
    linked = join_skewed(parts.select("node", "component"), names, ["component"], "n")
    linked = linked.select(F.col("node").alias("fp"), "component_id", F.lit(True).alias("linked"))
    named = written(nodes.join(linked, "fp", "left").select(
        "fp", "copies", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id")), "simhash-named")
    return join_skewed(prints, named, ["fp"], "copies").select(id_col, "fp", "component_id")


def fingerprint_hex(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
