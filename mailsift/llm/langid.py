"""Language identification with a bidirectional gated recurrent network.

Bytes go through an embedding and two gated recurrent layers, one for each
direction; every position gets a probability for every language, and a
document's probabilities are the mean over its positions. Training is
backpropagation through time in numpy, on a bounded sample of windows.

Texts are read whole, as windows of WINDOW bytes in which both directions start
afresh. All windows of a batch advance together, so a step is a few matrix
operations over thousands of windows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_per_group

WINDOW, HIDDEN = 64, 8
#: The bounded training sample: documents of a language, windows of a document.
DOCS_PER_LANG, WINDOWS_PER_DOC = 400, 6
EPOCHS, BATCH, RATE, SEED = 14, 256, 0.01, 42
UNKNOWN = "und"
#: Below this probability a document counts as rejected by :func:`accepted`.
LEAST_SCORE = 0.4
_LETTER = re.compile(r"[^\W\d_]")
_COLUMNS = 4096  # windows that advance together


def _init(rng, langs: int, hidden: int) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p[f"E{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
        p[f"U{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden))
        p[f"O{d}"] = rng.normal(0, 0.3, (langs, hidden))
    p["o"] = np.zeros((langs, 1))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _forward(p, d: str, x: np.ndarray, keep: bool):
    """States (steps, hidden, columns) of direction ``d`` over bytes x (steps,
    columns); gates too if ``keep``. Byte 0 is padding: it resets the state."""
    steps, n = x.shape
    hidden = p[f"U{d}"].shape[1]
    table, u = p[f"E{d}"], p[f"U{d}"]
    h = np.zeros((hidden, n), np.float32)
    states, gates = np.empty((steps, hidden, n), np.float32), []
    pad = not x.all()
    for s in (range(steps) if d == "f" else range(steps - 1, -1, -1)):
        e = table.take(x[s], axis=0).T
        a = u @ h
        rz = a[:2 * hidden] + e[:2 * hidden]
        np.negative(rz, out=rz)
        np.exp(rz, out=rz)
        rz += 1
        np.reciprocal(rz, out=rz)
        r, z, c = rz[:hidden], rz[hidden:], a[2 * hidden:]
        if keep:
            un = c.copy()
        c *= r
        c += e[2 * hidden:]
        np.tanh(c, out=c)
        new = states[s]
        np.subtract(h, c, out=new)
        new *= z
        new += c
        if pad:
            new *= x[s] != 0
        if keep:
            gates.append((s, h, r, z, c, un))
        h = new
    return states, gates


def _probabilities(p, hf, hb):
    """Softmax over languages of one step: (langs, columns)."""
    y = p["Of"] @ hf + p["Ob"] @ hb
    y += p["o"]
    y -= y.max(axis=0)
    np.exp(y, out=y)
    y /= y.sum(axis=0)
    return y


def _gradients(p, x, y):
    """Loss gradients over a batch: x (steps, columns) bytes, y (columns,) languages."""
    g = {k: np.zeros_like(v) for k, v in p.items()}
    seen = (x != 0).astype(np.float32)
    total = max(float(seen.sum()), 1.0)
    out = {d: _forward(p, d, x, True) for d in "fb"}
    steps, n = x.shape
    dh_out = {d: np.empty_like(out[d][0]) for d in "fb"}
    loss = 0.0
    for s in range(steps):
        hf, hb = out["f"][0][s], out["b"][0][s]
        q = _probabilities(p, hf, hb)
        loss -= float((np.log(q[y, np.arange(n)] + 1e-9) * seen[s]).sum())
        q[y, np.arange(n)] -= 1
        q *= seen[s] / total
        g["Of"] += q @ hf.T
        g["Ob"] += q @ hb.T
        g["o"] += q.sum(axis=1, keepdims=True)
        dh_out["f"][s] = p["Of"].T @ q
        dh_out["b"][s] = p["Ob"].T @ q
    for d in "fb":  # backpropagation through time, against the direction
        u = p[f"U{d}"]
        hidden = u.shape[1]
        dh = np.zeros((hidden, n), np.float32)
        for s, before, r, z, c, un in reversed(out[d][1]):
            dh = (dh + dh_out[d][s]) * seen[s]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (before - c) * z * (1 - z)
            dr = dc * un * r * (1 - r)
            da = np.concatenate([dr, dz, dc * r])  # into u @ h
            de = np.concatenate([dr, dz, dc])  # into the embedding
            g[f"U{d}"] += da @ before.T
            np.add.at(g[f"E{d}"], x[s], de.T)
            dh = u.T @ da + dh * z
    return loss / total, g


@dataclass
class LanguageModel:
    langs: list[str]
    params: dict

    def document_probabilities(self, raws: list[bytes]) -> np.ndarray:
        """Mean over the positions of each text (documents, langs); an empty
        text gets equal shares."""
        n = len(self.langs)
        out = np.full((len(raws), n), 1 / max(n, 1), np.float32)
        lens = np.array([len(r) for r in raws], np.int64)
        sums = np.zeros((len(raws), n), np.float64)
        full = lens // WINDOW
        if full.sum():  # whole windows, then one padded rest of each text
            x = np.concatenate([np.frombuffer(r, np.uint8, int(k) * WINDOW) for r, k in zip(raws, full) if k]).reshape(-1, WINDOW)
            self._pool(x, np.repeat(np.arange(len(raws)), full), sums)
        rest = np.flatnonzero(lens % WINDOW)
        if len(rest):
            x = np.zeros((len(rest), WINDOW), np.uint8)
            for row, i in enumerate(rest.tolist()):
                tail = raws[i][int(full[i]) * WINDOW:]
                x[row, :len(tail)] = np.frombuffer(tail, np.uint8)
            self._pool(x, rest, sums)
        some = sums.sum(axis=1) > 0
        out[some] = (sums[some] / sums[some].sum(axis=1, keepdims=True)).astype(np.float32)
        return out

    def _pool(self, windows: np.ndarray, doc: np.ndarray, sums: np.ndarray) -> None:
        p = self.params
        for at in range(0, len(windows), _COLUMNS):
            x = np.ascontiguousarray(windows[at:at + _COLUMNS].T)
            hf, hb = _forward(p, "f", x, False)[0], _forward(p, "b", x, False)[0]
            pad = not x.all()
            total = np.zeros((len(self.langs), x.shape[1]), np.float32)
            for s in range(WINDOW):  # every position gets a label distribution
                q = _probabilities(p, hf[s], hb[s])
                total += q * (x[s] != 0) if pad else q
            np.add.at(sums, doc[at:at + _COLUMNS], total.T)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        # a byte 0 inside a text is a control character: read it as a space
        raws = [(t or "").encode().replace(b"\0", b" ") for t in texts]
        p = self.document_probabilities(raws)
        langs, scores = [], []
        for t, row in zip(texts, p):
            if not self.langs or t is None or not _LETTER.search(t):
                langs.append(UNKNOWN)
                scores.append(0.0)
            else:
                k = int(row.argmax())
                langs.append(self.langs[k])
                scores.append(min(float(row[k]), 1.0))
        return langs, scores


def train(windows: list[bytes], labels: list[str], hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED) -> LanguageModel:
    """Adam over shuffled batches of windows; languages count alike whatever
    their share of the sample."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    p = _init(rng, len(langs), hidden)
    if len(langs) < 2:
        return LanguageModel(langs, p)
    x = np.zeros((len(windows), WINDOW), np.uint8)
    for i, w in enumerate(windows):
        w = w[:WINDOW].replace(b"\0", b" ")
        x[i, :len(w)] = np.frombuffer(w, np.uint8)
    y = np.array([langs.index(v) for v in labels])
    per = max(np.bincount(y))
    m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(np.concatenate([np.resize(rng.permutation(np.flatnonzero(y == k)), per) for k in range(len(langs))]))
        rate = RATE * (1 - epoch / epochs) + 0.001
        for at in range(0, len(order), BATCH):
            part = order[at:at + BATCH]
            _, g = _gradients(p, np.ascontiguousarray(x[part].T), y[part])
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            t += 1
            for k, a in g.items():
                a *= min(1.0, 1.0 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                p[k] -= (rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.99 ** t)) + 1e-6)).astype(np.float32)
    return LanguageModel(langs, p)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        docs_per_lang: int = DOCS_PER_LANG, windows_per_doc: int = WINDOWS_PER_DOC, seed: int = SEED) -> LanguageModel:
    """Trains on ``docs`` (the caller has left out what must not be learned from).

    Rows without a text, a language or an id teach nothing. The sample is the
    first ``docs_per_lang`` ids of each language by a seeded hash, one row of each
    id and language (the least text), and ``windows_per_doc`` evenly spread windows
    of each, at most 400 x 6 x 64 bytes a language. More than 1,000 languages are an error.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    ids = [r[0] for r in least_per_group(known.select(id_col, lang_col).distinct(), [lang_col], [F.xxhash64(id_col, F.lit(seed)), id_col],
                                         docs_per_lang).select(id_col).distinct().collect()]
    if not ids:
        return LanguageModel([], {})

    def cut(batches):
        import pyarrow as pa
        for batch in batches:
            langs, found = [], []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                n = min(windows_per_doc, -(-len(raw) // WINDOW))
                for k in range(n):
                    at = k * max(len(raw) - WINDOW, 0) // max(n - 1, 1)
                    langs.append(lang)
                    found.append(raw[at:at + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["lang", "window"])

    one = known.filter(F.col(id_col).isin(ids)).groupBy(id_col, lang_col).agg(F.min(text_col).alias("__text"))
    rows = one.select("__text", lang_col).mapInArrow(cut, "lang string, window binary").collect()
    rows = sorted((r["lang"], bytes(r["window"])) for r in rows)
    return train([w for _, w in rows], [v for v, _ in rows], seed=seed)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred",
             score_out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_out`` string and ``score_out`` double (0 to 1), which
    replace columns of these names. The language is UNKNOWN with score 0 if the
    text is null or has no letter. Every row of ``docs`` gives one row. ``keep``:
    the columns to return beside the two (default: all), so that texts need not
    travel back from Python."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (lang_out, score_out)]
    schema = StructType([*(docs.schema[c] for c in kept), StructField(lang_out, StringType()), StructField(score_out, DoubleType())])
    docs = docs.select(*kept, F.col(text_col).alias("__text"))

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                langs, scores = model.predict(part.column(len(kept)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                                 names=[*kept, lang_out, score_out])

    return docs.mapInArrow(run, schema)


def accepted(lang: str = "lang_pred", score: str = "score") -> Column:
    """Whether a document's language is known well enough to keep it; texts of
    two languages have about half the positions in each."""
    return (F.col(lang) != UNKNOWN) & (F.col(score) >= LEAST_SCORE)
