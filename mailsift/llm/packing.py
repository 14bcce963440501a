"""Best-fit packing by swap-based local search.

1. :func:`token_pieces` turns each text into token ids (plus an end id) and
   cuts only what is longer than a sequence.
2. :func:`pack` deals the pieces into shards of bounded size. Each shard starts
   from a best-fit packing and then improves it by local search: it takes the
   emptiest bin and moves its pieces into others, exchanges one of them for a
   smaller one, or two for one, whenever that raises the sum of squared fills,
   until the bin is empty. Bins that stay clearly underfull are dissolved and
   meet those of other shards in the next round, until one shard holds them or
   a round no longer helps (pieces that find no partner); then all are closed.

Whole-length pieces are a sequence each and never enter a shard. No shard
grows with the input; where sizes are mixed, the rounds shrink by a factor of
thousands.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import written
from .tokens import VOCABULARY, shared_encoder

SEQUENCE = 4096
END_ID = 1
#: Pieces a shard holds: the unit of memory and time of one task.
SHARD_PIECES = 8192
#: Bins filled less than this share are dissolved and packed again with those of other shards.
REOPEN_BELOW = 0.985
#: Rounds at most; the last one closes every bin.
ROUNDS = 8
#: A round that leaves more than this share of its pieces in underfull bins closes these too.
STALLED = 0.75
#: Source bins that may fail in a row before a shard's search ends.
PATIENCE = 48


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE,
                 vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``id_col``, piece int, start long, length long,
    token_ids binary (little-endian unsigned 32-bit), deal long.

    A null or empty text is the end id alone. Repeated rows are pieces of their
    own; ``deal`` is unique per row and tells them apart. Other columns of
    ``docs`` are not kept. An empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        import gc

        import pyarrow as pa
        from pyspark import TaskContext
        gc.disable()  # nothing here makes cycles; collections would walk the table
        encoder, end = shared_encoder(vocabulary), int(end_id).to_bytes(4, "little")
        serial = TaskContext.get().partitionId() << 36
        schema = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if schema is None:
                    schema = pa.schema([(id_col, part.schema.field(0).type), ("piece", pa.int32()), ("start", pa.int64()),
                                        ("length", pa.int64()), ("token_ids", pa.binary()), ("deal", pa.int64())])
                ids = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                rows = []
                for doc, raw in zip(part.column(0).to_pylist(), ids):
                    raw += end
                    for k, b in enumerate(range(0, len(raw), 4 * length)):
                        piece = raw[b:b + 4 * length]
                        rows.append((doc, k, b // 4, len(piece) // 4, piece, serial))
                        serial += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        cut, f"`{id_col}` {kind}, piece int, start long, length long, token_ids binary, deal long")


class Bins:
    """The bins of one shard: fills, and which pieces lie where."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bin_of = np.full(len(sizes), -1, np.int64)
        self.fill: list[int] = []
        self._best_fit()

    def _best_fit(self) -> None:
        """Best fit, longest first. ``open_mask`` has bit f set if a bin has f free."""
        by_free: dict[int, list[int]] = {}
        open_mask = 0
        for i in np.argsort(-self.sizes, kind="stable").tolist():
            size = int(self.sizes[i])
            fits = open_mask >> size
            if fits:
                free = size + (fits & -fits).bit_length() - 1
                at = by_free[free].pop()
                if not by_free[free]:
                    open_mask ^= 1 << free
            else:
                free, at = self.capacity, len(self.fill)
                self.fill.append(0)
            self.bin_of[i] = at
            self.fill[at] += size
            left = free - size
            if left:
                by_free.setdefault(left, []).append(at)
                open_mask |= 1 << left
        self.fill_at = np.array(self.fill, np.int64)

    def improve(self, patience: int) -> None:
        """Local search: empties the emptiest bin it can, again and again."""
        least = -(-int(self.sizes.sum()) // self.capacity)
        given_up = np.zeros(len(self.fill_at), bool)
        failed = 0
        while int((self.fill_at > 0).sum()) > least and failed < patience:
            open_bins = np.flatnonzero((self.fill_at > 0) & ~given_up & (self.fill_at < self.capacity))
            if not len(open_bins):
                break
            source = int(open_bins[np.argmin(self.fill_at[open_bins])])
            if self._empty(source):
                failed = 0
            else:
                given_up[source], failed = True, failed + 1

    def _empty(self, source: int) -> bool:
        while self.fill_at[source]:
            if not self._step(source):
                return False
        return True

    def _step(self, source: int) -> bool:
        """One exchange that raises the sum of squared fills: ``gain`` tokens go
        from ``source`` to a bin that is at least as full, so the sum grows by
        2 * gain * (fill there - fill here + gain)."""
        mine = np.flatnonzero(self.bin_of == source)
        mine = mine[np.argsort(-self.sizes[mine], kind="stable")]
        free = self.capacity - self.fill_at
        takes = (self.fill_at >= self.fill_at[source]) & (free > 0)
        takes[source] = False
        for i in mine.tolist():  # move, into the bin that it fills best
            fits = np.flatnonzero(takes & (free >= self.sizes[i]))
            if len(fits):
                self._shift([i], [], int(fits[np.argmin(free[fits])]))
                return True
        others = np.flatnonzero((self.bin_of >= 0) & takes[self.bin_of])
        if not len(others):
            return False
        size_there, free_there = self.sizes[others], free[self.bin_of[others]]
        best = (0, None, None)
        for give in [(int(i),) for i in mine]:  # one for one
            gain = int(self.sizes[give[0]]) - size_there
            good = (gain > 0) & (gain <= free_there)
            if good.any():
                k = int(np.argmax(np.where(good, gain, 0)))
                if int(gain[k]) > best[0]:
                    best = (int(gain[k]), give, int(others[k]))
        sums, first, second = self._pair_sums(mine)
        if len(sums):  # two for one: the largest pair sum that the partner's bin has room for
            at = np.searchsorted(sums, size_there + free_there, side="right") - 1
            gain = np.where(at >= 0, sums[np.maximum(at, 0)] - size_there, 0)
            k = int(np.argmax(gain))
            if int(gain[k]) > best[0]:
                best = (int(gain[k]), (int(first[at[k]]), int(second[at[k]])), int(others[k]))
        if not best[0]:
            return False
        self._shift(list(best[1]), [best[2]], int(self.bin_of[best[2]]))
        return True

    def _pair_sums(self, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sums of any two pieces of ``mine``, ascending, with two such pieces
        each. The distinct sizes in a bin add up to its capacity at most, so there
        are few (90 for 4,096), however many pieces there are."""
        sizes, at, n = np.unique(self.sizes[mine], return_index=True, return_counts=True)
        a, b = np.triu_indices(len(sizes), 1)
        twice = np.flatnonzero(n > 1)
        again = np.array([mine[np.flatnonzero(self.sizes[mine] == sizes[t])[1]] for t in twice], np.int64)
        first, second = np.r_[mine[at[a]], mine[at[twice]]], np.r_[mine[at[b]], again]
        sums, kept = np.unique(np.r_[sizes[a] + sizes[b], 2 * sizes[twice]], return_index=True)
        return sums, first[kept], second[kept]

    def _shift(self, out: list[int], back: list[int], target: int) -> None:
        source = int(self.bin_of[out[0]])
        gain = int(self.sizes[out].sum()) - int(self.sizes[back].sum())
        self.bin_of[out], self.bin_of[back] = target, source
        self.fill_at[target] += gain
        self.fill_at[source] -= gain


def pack_sizes(sizes: np.ndarray, capacity: int = SEQUENCE, patience: int = PATIENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each size (1..capacity), no gaps in a bin."""
    sizes = np.asarray(sizes, np.int64)
    bins = Bins(sizes, capacity)
    bins.improve(patience)
    order = np.argsort(bins.bin_of, kind="stable")
    at, run = bins.bin_of[order], sizes[order]
    before = np.cumsum(run) - run
    first = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
    offset = np.empty(len(sizes), np.int64)
    offset[order] = before - np.maximum.accumulate(np.where(first, before, 0)) if len(at) else before
    return bins.bin_of, offset


def _solver(capacity: int, patience: int, reopen: float, turn: int):
    def solve(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("deal", kind="stable").reset_index(drop=True)
        sizes = rows["length"].to_numpy()
        at, offset = pack_sizes(sizes, capacity, patience)
        again = (np.bincount(at, sizes) < reopen)[at]
        name = (np.int64(turn) << 58) + (np.int64(key[0]) << 20) + at
        return rows.drop(columns="_shard").assign(sequence_id=name, offset=offset, _again=again)

    return solve


def pack(pieces: DataFrame, capacity: int = SEQUENCE, shard_pieces: int = SHARD_PIECES,
         reopen_below: float = REOPEN_BELOW, patience: int = PATIENCE) -> DataFrame:
    """``pieces`` (a written table with length 1..capacity, and deal, unique per
    row) with sequence_id long and offset long. All columns and rows are kept;
    an empty table gives an empty table."""
    whole = (pieces.filter(F.col("length") == capacity)
             .select("*", (F.lit(-1) - F.col("deal")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    done, rest = [whole], pieces.filter(F.col("length") < capacity)
    n_rest = rest.count()
    for turn in range(ROUNDS):
        shards = math.ceil(n_rest / shard_pieces)
        if not shards:
            break
        last = shards == 1 or turn == ROUNDS - 1
        schema = StructType([*rest.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType()),
                             StructField("_again", BooleanType())])
        solve = _solver(capacity, patience, 0 if last else reopen_below * capacity, turn)
        dealt = rest.withColumn("_shard", F.pmod(F.xxhash64("deal", F.lit(turn)), F.lit(shards)))
        solved = written(dealt.groupBy("_shard").applyInPandas(solve, schema), "packed")
        n_dealt, n_rest = n_rest, solved.filter("_again").count()
        if last or n_rest > STALLED * n_dealt:
            done.append(solved.drop("_again"))
            break
        done.append(solved.filter(~F.col("_again")).drop("_again"))
        rest = solved.filter("_again").drop("sequence_id", "offset", "_again")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE,
                   vocabulary: str = VOCABULARY, keep: list | None = None) -> DataFrame:
    """Pieces of all documents with their place. ``keep``: what to keep of
    token_ids, as expressions over it (default: the ids themselves)."""
    kept = [F.col("token_ids")] if keep is None else keep
    pieces = token_pieces(docs, id_col, text_col, length, vocabulary).select(id_col, "piece", "start", "length", "deal", *kept)
    return pack(written(pieces, "pieces"), length).drop("deal")
