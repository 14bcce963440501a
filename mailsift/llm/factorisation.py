"""Quality classifier: a factorisation machine.

Inputs of a document: its hashed words, structure statistics of the text, and
its length as metadata. The machine adds to a linear model an interaction of
every pair of inputs, whose weight is the product of two low-rank vectors; the
sum over all pairs is scored in linear time by

    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

It is fitted in numpy on a bounded sample of labelled rows.
"""

from __future__ import annotations

import operator
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_per_group

BUCKETS, RANK = 1 << 15, 8
#: The bounded training sample: labelled documents of each label.
DOCS_PER_LABEL = 2000
EPOCHS, BATCH, RATE, DECAY, SEED = 30, 64, 0.05, 1e-5, 42
KEEP = 0.7
STATISTICS = ("symbols", "capitals", "digits", "punctuation", "separators", "shouts", "word_length", "distinct", "stutter",
              "copied_lines", "ended_lines", "line_length", "size")
LENGTHS = 24  # metadata: one input per power of two of the length, the first for null
INPUTS = BUCKETS + len(STATISTICS) + LENGTHS
_SYMBOLS, _PUNCTUATION = list(b"#*$%&|<>"), list(b".,;:!?")


def word_inputs(raw: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    words = raw.lower().split()
    counts: Counter = Counter()
    for word, n in Counter(words).items():
        counts[crc32(word) % BUCKETS] += n
    at = np.fromiter(counts.keys(), np.int64, len(counts))
    x = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    return at, x / max(np.sqrt((x * x).sum()), 1e-9), words


def statistics(raw: bytes, words: list[bytes]) -> np.ndarray:
    n, w = max(len(raw), 1), max(len(words), 1)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)
    lines = [s for s in raw.split(b"\n") if s.strip()]
    m = max(len(lines), 1)
    letters = max(int(seen[65:91].sum() + seen[97:123].sum()), 1)
    return np.array([
        seen[_SYMBOLS].sum() / n, seen[65:91].sum() / letters, seen[48:58].sum() / n, seen[_PUNCTUATION].sum() / n,
        seen[124] / w, raw.count(b"!!") / w, sum(map(len, words)) / w, len(set(words)) / w,
        sum(map(operator.eq, words, words[1:])) / w, 1 - len(set(lines)) / m if lines else 0.0,
        sum(s.rstrip()[-1:] in (b".", b"!", b"?") for s in lines) / m, np.log1p(n / m), np.log1p(w)])


def length_input(n_chars: int | None) -> int:
    return 0 if n_chars is None else 1 + min(max(int(n_chars), 0).bit_length(), LENGTHS - 2)


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def inputs(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        raw = (text or "").encode()
        at, x, words = word_inputs(raw)
        return self.assemble(at, x, statistics(raw, words), length_input(n_chars))

    def assemble(self, at, x, stats, length) -> tuple[np.ndarray, np.ndarray]:
        scaled = np.clip((stats - self.mean) / self.spread, -4, 4) * 0.5
        return (np.concatenate([at, BUCKETS + np.arange(len(scaled)), [BUCKETS + len(scaled) + length]]),
                np.concatenate([x, scaled, [0.5]]))

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factor[at]
        s = x @ v
        y = self.bias + x @ self.weight[at] + 0.5 * float(s @ s - (x * x) @ (v * v).sum(axis=1))
        return float(1 / (1 + np.exp(-np.clip(y, -30, 30))))


def train(rows: list[tuple], seed: int = SEED) -> Machine:
    """``rows``: (word buckets, word values, statistics, length input, label).
    Adagrad over seeded batches; both labels weigh alike."""
    stats = np.array([r[2] for r in rows]).reshape(len(rows), len(STATISTICS))
    mean = stats.mean(axis=0) if len(rows) else np.zeros(len(STATISTICS))
    spread = stats.std(axis=0) + 1e-3 if len(rows) else np.ones(len(STATISTICS))
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(INPUTS), rng.normal(0, 0.02, (INPUTS, RANK)), mean, spread)
    labels = np.array([r[4] for r in rows], np.float64)
    if not len(rows) or labels.min() == labels.max():
        m.bias = 3.0 if len(rows) and labels[0] else (-3.0 if len(rows) else 0.0)
        m.factor[:] = 0
        return m
    data = [m.assemble(*r[:4]) for r in rows]
    balance = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    g0, gw, gv = 1e-6, np.full(INPUTS, 1e-6), np.full((INPUTS, RANK), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            part = order[start:start + BATCH]
            ats, dws, dvs, db = [], [], [], 0.0
            for i in part.tolist():
                at, x = data[i]
                v = m.factor[at]
                s = x @ v
                d = (m.score(at, x) - labels[i]) * balance[i] / len(part)
                ats.append(at)
                dws.append(d * x)
                dvs.append(d * (x[:, None] * s - v * (x * x)[:, None]))
                db += d
            at, where = np.unique(np.concatenate(ats), return_inverse=True)
            dw = np.bincount(where, np.concatenate(dws)) + DECAY * m.weight[at]
            dv = np.zeros((len(at), RANK))
            np.add.at(dv, where, np.concatenate(dvs))
            dv += DECAY * m.factor[at]
            g0 += db * db
            gw[at] += dw * dw
            gv[at] += dv * dv
            m.bias -= RATE * db / np.sqrt(g0)
            m.weight[at] -= RATE * dw / np.sqrt(gw[at])
            m.factor[at] -= RATE * dv / np.sqrt(gv[at])
    return m


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        length_col: str | None = "n_chars", docs_per_label: int = DOCS_PER_LABEL, seed: int = SEED) -> Machine:
    """Learns from the rows of ``labels`` given (label 0 or 1; nulls teach
    nothing), at most ``docs_per_label`` of each label, the first by a seeded
    hash of the id, one row of each id (the least text). Their inputs, not their
    texts, come to the driver: at most BUCKETS pairs of numbers a document."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(id_col, label_col).distinct()
    picked = least_per_group(known, [label_col], [F.xxhash64(id_col, F.lit(seed)), id_col], docs_per_label).collect()
    label_of: dict = {}
    for doc, label in sorted((r[0], r[1]) for r in picked):
        label_of[doc] = label  # contradictory labels: the larger

    def gather(batches):
        import pyarrow as pa
        for batch in batches:
            ids, ats, xs, stats, lens = [], [], [], [], []
            for doc, text, n in zip(*(batch.column(c).to_pylist() for c in range(3))):
                raw = (text or "").encode()
                at, x, words = word_inputs(raw)
                ids.append(doc)
                ats.append(at.astype(np.int32))
                xs.append(x.astype(np.float32))
                stats.append(statistics(raw, words))
                lens.append(length_input(n))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(ats, pa.list_(pa.int32())),
                                              pa.array(xs, pa.list_(pa.float32())), pa.array(stats, pa.list_(pa.float64())),
                                              pa.array(lens, pa.int32())], names=["id", "at", "x", "stats", "length"])

    if not label_of:
        return train([])
    length = F.col(length_col).cast("long") if length_col else F.lit(None).cast("long")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.filter(F.col(id_col).isin(list(label_of))).select(F.col(id_col).alias("__id"), F.struct(F.col(text_col).alias("t"), length.alias("n")).alias("r"))
    got = (rows.groupBy("__id").agg(F.min("r").alias("r")).select("__id", "r.t", "r.n")
           .mapInArrow(gather, f"id {kind}, at array<int>, x array<float>, stats array<double>, length int").collect())
    rows = [(np.array(r["at"], np.int64), np.array(r["x"], np.float64), np.array(r["stats"]), r["length"], label_of[r["id"]])
            for r in sorted(got, key=lambda r: (r["id"], len(r["at"])))]
    return train(rows, seed)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text",
          length_col: str | None = "n_chars", out: str = "score") -> DataFrame:
    """(``id_col``, ``out`` double 0 to 1) for every row; a null text is empty and
    gets a score too. Other columns are not kept."""
    kind = docs.schema[id_col].dataType.simpleString()
    length = F.col(length_col).cast("long") if length_col else F.lit(None).cast("long")
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # INPUTS x (RANK + 1) numbers whatever the input

    def run(batches):
        import pyarrow as pa
        m = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts, sizes = part.column(1).to_pylist(), part.column(2).to_pylist()
                p = [m.score(*m.inputs(t, n)) for t, n in zip(texts, sizes)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64())], names=[id_col, out])

    return docs.select(id_col, text_col, length.alias("__length")).mapInArrow(run, f"`{id_col}` {kind}, `{out}` double")
