"""Suffix-array dedup: maximal repeats of a corpus through common-prefix intervals.

A byte is removed if a string of LEAST bytes covers it that also starts
earlier (smaller id, or same document and earlier start). Such strings are
found as maximal repeats: an enhanced suffix array's common-prefix intervals,
stack-scanned, kept if the bytes to the left of their members differ; every
member but the first is removed over the repeat's whole length.

One suffix array over the corpus would not fit anywhere, so it is cut where no
repeat is lost. Every LEAST-byte window names one of its GRAM-byte substrings,
the one of least hash (the leftmost on ties). Equal windows name equal
substrings, so windows that name the same one, the *contexts*, are all that a
suffix array must see together. Stages, each a Spark job over bounded groups:

1. Equal texts by SHA-256: only the first copy goes on; the others are removed
   whole, being covered by the first.
2. Packs of documents list the named hashes that they hold, each once.
3. Hash buckets answer each pack which of its hashes occur elsewhere or twice,
   and which of these are *hot*: more than HOT contexts name them.
4. Packs cut the contexts of those; equal contexts of a pack become one, its
   earliest, and the rest are removed at once.
5. Hash buckets build the suffix arrays of the contexts of a hash and send the
   removed spans back to the packs, which cut them out of the texts.
6. Contexts of hot hashes go another way: their windows are dealt by the whole
   LEAST bytes, each once a pack; the earliest stays, the others are removed.

A passage that a third of all documents share is one hash a pack in stage 3
and, within the passage, one context a pack in stage 5. At its ends, and around
any short frequent phrase, contexts differ from document to document; there the
hash is hot, and stage 6 deals its windows over all tasks.
"""

from __future__ import annotations

import hashlib
import math
import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import run_bounds, written

LEAST, GRAM = 100, 32
#: Bytes of text of a pack; of text whose hashes share a bucket.
PACK_BYTES, BUCKET_BYTES = 8 << 20, 12 << 20
_STEP = 1 << 20  # windows hashed at once
_LOW = np.uint64((1 << 24) - 1)
_ODD = 0x9E3779B97F4A7C15
_NO_ID = (1 << 63) - 1  # a null id: the last document
_CHUNK = 3000  # contexts of a suffix array that are sorted at once
HOT = _CHUNK  # contexts of a hash, summed over the packs, that share a suffix array at most
_WINDOW_BYTES = 40  # of a window in stage 6: digest, id, tie, start


def _powers(base: int, n: int) -> np.ndarray:
    out, m = np.ones(n, np.uint64), 1
    while m < n:
        q = min(m, n - m)
        out[m:m + q] = out[:q] * np.uint64(pow(base, m, 1 << 64))
        m *= 2
    return out


def _gram_hashes(buf: np.ndarray, gram: int, cache: dict) -> np.ndarray:
    """64-bit hashes of all substrings of ``gram`` bytes, from running sums."""
    n = len(buf)
    if cache.get("n", 0) < n:
        cache.update(n=n, up=_powers(_ODD, n), down=_powers(pow(_ODD, -1, 1 << 64), n),
                     code=np.random.default_rng(7).integers(1, 1 << 63, 256).astype(np.uint64))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(cache["code"][buf] * cache["down"][:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * cache["up"][:n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def named_windows(raws: list[bytes], least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows of one text that name the same substring: (text number,
    first window start, last window start, hash)."""
    if not raws:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    lens = np.array([len(r) for r in raws], np.int64)
    stops = np.cumsum(lens)
    buf = np.frombuffer(b"".join(raws), np.uint8)
    parts, cache, w = [], {}, least - gram + 1
    for at in range(0, len(buf) - least + 1, _STEP):
        seg = buf[at:at + _STEP + least - 1]
        h = _gram_hashes(seg, gram, cache)
        key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        rows = -(-len(key) // w)
        padded = np.full(rows * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[:len(key)] = key
        grid = padded.reshape(rows, w)  # least of each window from block prefixes and suffixes
        left = np.minimum.accumulate(grid, axis=1).ravel()
        right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(seg) - least + 1
        named = (np.minimum(right[:n], left[w - 1:w - 1 + n]) & _LOW).astype(np.int64)
        start = at + np.arange(n)
        doc = np.searchsorted(stops, start, "right")
        inside = start + least <= stops[doc]
        new = np.r_[True, (named[1:] != named[:-1]) | ~inside[:-1]] & inside
        first = np.flatnonzero(new)
        if not len(first):
            continue
        change = np.flatnonzero(np.r_[True, (named[1:] != named[:-1]) | (inside[1:] != inside[:-1])])
        last = np.r_[change[1:], n][np.searchsorted(change, first)] - 1
        d = doc[first]
        base = stops[d] - lens[d]
        parts.append((d, start[first] - base, start[last] - base, h[named[first]]))
    if not parts:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _scan(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """Common-prefix intervals of at least ``least`` bytes by a stack scan:
    (length, first, last) over len(lcp) + 1 sorted suffixes."""
    out, stack = [], []
    for i, x in enumerate([*lcp, 0]):
        begin = i
        while stack and stack[-1][0] > x:
            length, begin = stack.pop()
            if length >= least:
                out.append((length, begin, i))
        if not stack or stack[-1][0] < x:
            stack.append((x, begin))
    return out


def repeat_spans(contexts: list[bytes], group: np.ndarray, order: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Removed spans of distinct contexts: (context, start, end) arrays.

    ``group``: contexts of equal group (neighbours) share a suffix array.
    ``order``: for each context, its place before all others (document and
    start); starts inside a context only matter within one document.
    """
    width = max(map(len, contexts))
    lens = np.array([len(c) for c in contexts], np.int64)
    pad = b"\0" * width
    buf = np.frombuffer(b"".join(c + pad for c in contexts), np.uint8)
    base = np.cumsum(lens + width) - lens - width
    count = lens - least + 1
    ctx = np.repeat(np.arange(len(contexts)), count)
    off = np.arange(len(ctx)) - np.repeat(np.cumsum(count) - count, count)
    rest = lens[ctx] - off
    table = np.empty((len(ctx), width + 4), np.uint8)
    table[:, :4] = (group - group[0]).astype(">u4")[ctx].view(np.uint8).reshape(-1, 4)
    table[:, 4:] = np.lib.stride_tricks.sliding_window_view(buf, width)[base[ctx] + off]
    suffix = np.argsort(table.view(f"S{width + 4}").ravel(), kind="stable")  # the suffix array
    table, ctx, off, rest = table[suffix], ctx[suffix], off[suffix], rest[suffix]
    differ = table[1:] != table[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1) - 4, width)
    lcp = np.maximum(np.minimum(lcp, np.minimum(rest[1:], rest[:-1])), 0)
    before = np.where(off > 0, buf[np.maximum(base[ctx] + off - 1, 0)].astype(np.int64), -1)
    place = order[ctx] + off
    # stretches of suffixes whose neighbours share LEAST bytes
    near = np.r_[False, lcp >= least, False]
    begin, end = np.flatnonzero(near[1:] & ~near[:-1]), np.flatnonzero(near[:-1] & ~near[1:])  # lcp indices [begin, end)
    out: list[tuple] = []
    if len(begin):
        pairs = np.stack([begin, end], 1).ravel()
        limits = pairs if pairs[-1] < len(lcp) else pairs[:-1]
        low, high = (f.reduceat(lcp, limits)[::2] for f in (np.minimum, np.maximum))
        flat = low == high
        single = begin[flat], end[flat] + 1  # one interval each: members [begin, end]
        size = single[1] - single[0]
        member = np.repeat(single[0], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        at = np.cumsum(size) - size
        if len(size):
            b = before[member]
            diverse = (np.minimum.reduceat(b, at) != np.maximum.reduceat(b, at)) | (np.minimum.reduceat(b, at) < 0)
            earliest = np.repeat(np.minimum.reduceat(place[member], at), size)
            gone = np.repeat(diverse, size) & (place[member] != earliest)
            length = np.repeat(low[flat], size)[gone]
            out.append((ctx[member[gone]], off[member[gone]], off[member[gone]] + length))
        found = []
        for s, e in zip(begin[~flat].tolist(), end[~flat].tolist()):
            left, where = before[s:e + 1].tolist(), place[s:e + 1].tolist()
            for length, a, z in _scan(lcp[s:e].tolist(), least):
                chars = set(left[a:z + 1])
                if len(chars) == 1 and -1 not in chars:
                    continue  # not maximal: it goes on to the left
                first = min(where[a:z + 1])
                found += [(s + i, length) for i in range(a, z + 1) if where[i] != first]
        if found:
            i, length = np.array(found, np.int64).T
            out.append((ctx[i], off[i], off[i] + length))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


class _Pack:
    """First copies of a pack, in order: ids, tie numbers (rows of one id with
    different texts), texts."""

    def __init__(self, texts, copies: dict):
        import pyarrow as pa
        rows = sorted(((d, None, t) for d, t in zip(texts["id"].to_pylist(), texts["text"].cast(pa.binary()).to_pylist())),
                      key=lambda r: r[0])
        counts: dict = {}
        for d, *_ in rows:
            counts[d] = counts.get(d, 0) + 1
        seen, kept, self.rest = set(), [], []
        for d, _, t in rows:
            sha = hashlib.sha256(t).digest() if d in copies or counts[d] > 1 else None
            if sha is not None and (sha in copies.get(d, ()) or (d, sha) in seen):
                self.rest.append((d, t))
                continue
            if sha is not None:
                seen.add((d, sha))
            kept.append((d, sha or b"", t))
        kept.sort(key=lambda r: r[:2])
        self.ids = np.array([r[0] for r in kept], np.int64)
        same = np.r_[False, self.ids[1:] == self.ids[:-1]] if len(kept) else np.zeros(0, bool)
        run = np.arange(len(kept))
        self.tie = run - np.maximum.accumulate(np.where(same, 0, run)) if len(kept) else run
        self.raws = [r[2] for r in kept]


def _concat(parts: list, n: int) -> tuple:
    return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(n))


def _copies(table) -> dict:
    out: dict = {}
    for d, sha in zip(table["id"].to_pylist(), table["sha"].to_pylist()):
        if sha is not None:
            out.setdefault(d, set()).add(sha)
    return out


def _rows(schema: str, rows: list):
    import pyarrow as pa
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [c.split() for c in schema.split(", ")]
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, names)], names=[n for n, _ in names])


def _distinct_contexts(hashes, order, start, raws: list[bytes]):
    """Of equal contexts (hash and bytes), the earliest; (kept, removed) indices."""
    first: dict = {}
    removed = []
    for i in np.lexsort((start, order)).tolist():
        key = (int(hashes[i]), raws[i])
        if key in first:
            removed.append(i)
        else:
            first[key] = i
    return np.array(sorted(first.values()), np.int64), np.array(removed, np.int64)


def _contexts_of_repeated(hashes, first, last, doc, raws: list[bytes], least: int) -> dict:
    """Distinct contexts of each hash that occurs more than once in a pack."""
    values, where, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    found: dict = {}
    for i in np.flatnonzero(counts[where.ravel()] > 1).tolist():
        found.setdefault(int(hashes[i]), set()).add(raws[int(doc[i])][int(first[i]):int(last[i]) + least])
    return {h: len(c) for h, c in found.items()}


def _cut(texts, other, buckets: int, least: int, gram: int, answer: bool):
    """Stages 2 (answer=False) and 4 for a pack. Contexts of hot hashes get bucket -1."""
    pack = _Pack(texts, _copies(other))
    doc, first, last, hashes = named_windows(pack.raws, least, gram)
    if not answer:
        values, counts = np.unique(hashes, return_counts=True)
        bucket = (values >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        values, counts, bucket = values[order], counts[order], bucket[order].astype(np.int64)
        distinct = _contexts_of_repeated(hashes, first, last, doc, pack.raws, least)
        out = []
        for s, e in zip(*run_bounds(bucket)):
            twice = counts[s:e] > 1
            several = np.array([distinct[h] for h in values[s:e][twice].tolist()], np.int32)
            out.append((int(bucket[s]), pickle.dumps((values[s:e], np.packbits(twice), several), 5)))
        return out
    wanted, hot = _concat([pickle.loads(b) for b in other["data"].to_pylist() if b is not None], 2)
    wanted, hot = wanted.astype(np.uint64), wanted[hot.astype(bool)].astype(np.uint64)
    keep = np.isin(hashes, wanted)
    doc, first, last, hashes = doc[keep], first[keep], last[keep], hashes[keep]
    raws = [pack.raws[d][s:e + least] for d, s, e in zip(doc.tolist(), first.tolist(), last.tolist())]
    kept, removed = _distinct_contexts(hashes, doc, first, raws)
    out = []
    if len(removed):
        d = doc[removed]
        out.append((None, pickle.dumps((pack.ids[d], pack.tie[d], first[removed], last[removed] + least), 5)))
    bucket = ((hashes[kept] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    bucket[np.isin(hashes[kept], hot)] = -1
    kept, bucket = kept[np.argsort(bucket, kind="stable")], np.sort(bucket)  # a bucket's in order of document and start
    for s, e in zip(*run_bounds(bucket)):
        i = kept[s:e]
        own = [raws[k] for k in i.tolist()]
        out.append((int(bucket[s]), pickle.dumps((hashes[i], pack.ids[doc[i]], pack.tie[doc[i]], first[i],
                                                  np.array([len(x) for x in own], np.int64), b"".join(own)), 5)))
    return out


def _bucket_answers(packs: list, blobs: list, most: int = HOT) -> list[tuple]:
    """Stage 3: of each pack's hashes, those that occur elsewhere or twice, and
    whether more than ``most`` contexts name them."""
    loaded = [pickle.loads(b) for b in blobs]
    values = np.concatenate([v for v, *_ in loaded])
    twice = np.concatenate([np.unpackbits(b, count=len(v)).astype(bool) for v, b, _ in loaded])
    contexts = np.ones(len(values), np.int64)
    contexts[twice] = np.concatenate([n for *_, n in loaded])
    owner = np.repeat(np.array(packs, np.int64), [len(v) for v, *_ in loaded])
    order = np.argsort(values, kind="stable")
    start, stop = run_bounds(values[order])
    often = np.repeat((stop - start > 1) | np.logical_or.reduceat(twice[order], start), stop - start)
    hot = np.repeat(np.add.reduceat(contexts[order], start) > most, stop - start)
    values, owner, hot = values[order][often], owner[order][often], hot[often]
    order = np.argsort(owner, kind="stable")
    values, owner, hot = values[order], owner[order], hot[order]
    return [(int(owner[s]), pickle.dumps((values[s:e], hot[s:e]), 5)) for s, e in zip(*run_bounds(owner))]


def _joined(owner, ids, tie, first, last, least: int) -> list[tuple]:
    """Windows, in order of owner, document and start, as spans by owner; neighbours that touch are one."""
    if not len(owner):
        return []
    new = np.r_[True, (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1]) | (tie[1:] != tie[:-1]) | (first[1:] > last[:-1] + least)]
    s = np.flatnonzero(new)
    owner, ids, tie, a, z = owner[s], ids[s], tie[s], first[s], last[np.r_[s[1:], len(new)] - 1] + least
    return [(int(owner[b]), pickle.dumps((ids[b:e], tie[b:e], a[b:e], z[b:e]), 5)) for b, e in zip(*run_bounds(owner))]


def _hot_windows(pack: int, blob: bytes, buckets: int, least: int) -> list[tuple]:
    """Stage 6 for a pack: (bucket, windows of its hot contexts, each once), and
    (None, spans of those that repeat in the pack)."""
    _, ids, tie, first, lens, text = pickle.loads(blob)  # in order of document and start
    windows = lens - least + 1
    which = np.repeat(np.arange(len(lens)), windows)
    off = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = (np.cumsum(lens) - lens)[which] + off
    digests = np.fromiter((hashlib.blake2b(text[a:a + least], digest_size=16).digest() for a in at), "S16", len(at))
    earliest = np.unique(digests, return_index=True)[1]
    gone = np.ones(len(digests), bool)
    gone[earliest] = False
    ids, tie, start = ids[which], tie[which], first[which] + off
    out = [(None, data) for _, data in _joined(np.full(int(gone.sum()), pack), ids[gone], tie[gone], start[gone], start[gone], least)]
    bucket = (digests[earliest].view(np.uint64)[::2] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    earliest, bucket = earliest[order], bucket[order]
    for s, e in zip(*run_bounds(bucket)):
        i = earliest[s:e]
        out.append((int(bucket[s]), pickle.dumps((digests[i], ids[i], tie[i], start[i]), 5)))
    return out


def _later_windows(packs: list, blobs: list, least: int) -> list[tuple]:
    """Stage 6 for a bucket: spans of all windows but the earliest of equal ones, by pack."""
    loaded = [pickle.loads(b) for b in blobs]
    digests, ids, tie, start = (np.concatenate([x[k] for x in loaded]) for k in range(4))
    owner = np.repeat(np.array(packs, np.int64), [len(x[0]) for x in loaded])
    order = np.lexsort((start, tie, ids, digests))
    gone = order[1:][digests[order][1:] == digests[order][:-1]]
    gone = gone[np.lexsort((start[gone], tie[gone], ids[gone], owner[gone]))]
    return _joined(owner[gone], ids[gone], tie[gone], start[gone], start[gone], least)


def _bucket_spans(packs: list, blobs: list, least: int) -> list[tuple]:
    """Stage 5: removed spans of a bucket's contexts, by pack."""
    loaded = [pickle.loads(b) for b in blobs]
    hashes, ids, tie, first, lens = _concat(loaded, 5)
    owner = np.repeat(np.array(packs, np.int64), [len(x[0]) for x in loaded])
    text = b"".join(x[5] for x in loaded)
    stop = np.cumsum(lens)
    raws = [text[e - n:e] for e, n in zip(stop.tolist(), lens.tolist())]
    _, doc = np.unique(np.stack([ids, tie], 1), axis=0, return_inverse=True)  # by id, then tie
    doc = doc.ravel()
    kept, removed = _distinct_contexts(hashes, doc, first, raws)
    parts = [(removed, first[removed], first[removed] + lens[removed])]
    kept = kept[np.argsort(hashes[kept], kind="stable")]
    start, end = run_bounds(hashes[kept])
    many = end - start > 1
    start, end = start[many], end[many]
    place = doc.astype(np.int64) * (int(first.max()) + 4 * least + 1 if len(first) else 1) + first
    at = 0
    while at < len(start):  # whole hashes, a bounded number of contexts at once
        upto = max(at + 1, int(np.searchsorted(np.cumsum(end[at:] - start[at:]), _CHUNK, "right")) + at)
        i = np.concatenate([kept[s:e] for s, e in zip(start[at:upto].tolist(), end[at:upto].tolist())])
        group = np.repeat(np.arange(upto - at), end[at:upto] - start[at:upto])
        ctx, a, z = repeat_spans([raws[k] for k in i.tolist()], group, place[i], least)
        parts.append((i[ctx], first[i[ctx]] + a, first[i[ctx]] + z))
        at = upto
    which, a, z = _concat(parts, 3)
    which = which.astype(np.int64)
    order = np.argsort(owner[which], kind="stable")
    which, a, z = which[order], a[order], z[order]
    return [(int(owner[which[s]]), pickle.dumps((ids[which[s:e]], tie[which[s:e]], a[s:e], z[s:e]), 5))
            for s, e in zip(*run_bounds(owner[which]))]


def _removed(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes and maximal runs removed, and the rest."""
    depth = np.zeros(len(raw) + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, end, -1)
    gone = np.cumsum(depth[:-1]) > 0
    return int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), np.frombuffer(raw, np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM,
                   pack_bytes: int = PACK_BYTES, bucket_bytes: int = BUCKET_BYTES, keep_text: bool = True,
                   most: int = HOT) -> DataFrame:
    """Per row of ``docs``: ``id_col``, n_bytes, n_removed, n_spans (long),
    kept_sha256 string and, with ``keep_text``, kept binary (the bytes that stay).

    A null text is empty. Null ids come after all others. Rows that repeat an
    id are documents of their own, in the order of their texts' hashes; equal
    rows are copies. Other columns are not kept. An empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    prints = written(rows.select("id", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("long").alias("n"))
                     .groupBy("sha", "id").agg(F.count(F.lit(1)).alias("rows"), F.first("n").alias("n")), "repeat-prints")
    total = prints.agg(F.sum(F.col("n") * F.col("rows"))).first()[0] or 0
    packs, buckets = math.ceil(total / pack_bytes) or 1, math.ceil(total / bucket_bytes) or 1
    pack = F.pmod(F.xxhash64("id"), F.lit(packs)).cast("int")
    firsts = written(prints.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("ids"))
                     .filter(F.col("ids") > 1).drop("ids"), "repeat-firsts")  # a table, so that the join can split a hot text's rows
    copies = written(prints.join(firsts, "sha").filter(F.col("id") != F.col("first")).select("id", "sha"), "repeat-copies")
    texts = rows.filter(F.octet_length("text") >= least).withColumn("pack", pack)
    flags = copies.select(pack.alias("pack"), "id", "sha", F.lit(None).cast("binary").alias("data"))
    note = lambda found: found.select("pack", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("sha"), "data")

    def by_pack(other: DataFrame, work, schema: str) -> DataFrame:
        full = f"pack int, {schema}"

        def run(key, left, right):
            return _rows(full, [(key[0].as_py(), *r) for r in work(left, right)])

        return texts.groupBy("pack").cogroup(other.groupBy("pack")).applyInArrow(run, full)

    def by_bucket(found: DataFrame, work) -> DataFrame:
        def run(table):
            return _rows("pack int, data binary", work(table["pack"].to_pylist(), table["data"].to_pylist()))

        return found.groupBy("bucket").applyInArrow(run, "pack int, data binary")

    listed = by_pack(flags, lambda a, b: _cut(a, b, buckets, least, gram, False), "bucket int, data binary")
    answers = written(by_bucket(listed, lambda p, b: _bucket_answers(p, b, most)), "repeat-answers")
    cut = written(by_pack(flags.unionByName(note(answers)), lambda a, b: _cut(a, b, buckets, least, gram, True),
                          "bucket int, data binary"), "repeat-contexts")
    hot = cut.filter("bucket = -1")
    n_hot = hot.agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0
    spans = (by_bucket(cut.filter("bucket >= 0"), lambda p, b: _bucket_spans(p, b, least))
             .unionByName(cut.filter("bucket IS NULL").select("pack", "data")))
    if n_hot:  # at most a window a byte
        hot_buckets = math.ceil(n_hot * _WINDOW_BYTES / bucket_bytes)

        def windows(batches):
            for batch in batches:
                for p, data in zip(batch.column(0), batch.column(1)):
                    found = _hot_windows(p.as_py(), data.as_py(), hot_buckets, least)
                    yield from _rows("pack int, bucket int, data binary", [(p.as_py(), *r) for r in found]).to_batches()

        dealt = written(hot.select("pack", "data").mapInArrow(windows, "pack int, bucket int, data binary"), "repeat-hot")
        spans = (spans.unionByName(by_bucket(dealt.filter("bucket IS NOT NULL"), lambda p, b: _later_windows(p, b, least)))
                 .unionByName(dealt.filter("bucket IS NULL").select("pack", "data")))
    spans = written(spans, "repeat-spans")

    def finish(left, right) -> list[tuple]:
        pack_ = _Pack(left, _copies(right))
        ids, tie, a, z = _concat([pickle.loads(b) for b in right["data"].to_pylist() if b is not None], 4)
        out = []
        at = {k: i for i, k in enumerate(zip(pack_.ids.tolist(), pack_.tie.tolist()))}
        row = np.array([at[k] for k in zip(ids.tolist(), tie.tolist())], np.int64)
        order = np.argsort(row, kind="stable")
        a, z = a[order], z[order]
        hit = {int(row[order[s]]): (s, e) for s, e in zip(*run_bounds(row[order]))}
        for i, raw in enumerate(pack_.raws):
            n, runs, rest = _removed(raw, *[x[slice(*hit[i])] for x in (a, z)]) if i in hit else (0, 0, raw)
            out.append((int(pack_.ids[i]), len(raw), n, runs, hashlib.sha256(rest).digest(), rest if keep_text else None))
        out += [(d, len(t), len(t), 1, hashlib.sha256(b"").digest(), b"" if keep_text else None) for d, t in pack_.rest]
        return out

    done = by_pack(flags.unionByName(note(spans)), finish, "id long, n_bytes long, n_removed long, n_spans long, sha binary, kept binary")
    short = rows.filter(F.octet_length("text") < least).select(
        "id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.unhex(F.sha2("text", 256)).alias("sha"), F.col("text").alias("kept"))
    out = done.drop("pack").unionByName(short).select(
        F.nullif(F.col("id"), F.lit(_NO_ID)).cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans",
        F.lower(F.hex("sha")).alias("kept_sha256"), "kept")
    return out if keep_text else out.drop("kept")
