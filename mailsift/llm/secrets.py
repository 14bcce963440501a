"""Secret scans: fixed patterns and a randomness test battery.

Three patterns find assignments, access keys and long hex strings. Beside
them, every long run of encoding characters is tested for randomness under the
encoding that its characters suggest (hex, base32, base64, ...):

* chi-squared uniformity over the encoding's alphabet (simulated where a run is
  short for its alphabet),
* a runs test around the middle of the alphabet,
* lag-1 serial correlation of the symbols.

A run is a candidate secret if no test rejects randomness. Ordinary text can
pass when it is short, so each run also gets a p-value against the other
hypothesis, that its characters are drawn like the corpus's own: how likely
is a chi-squared statistic as low as this one from text of this length? The
longer the run, the sharper that test, so the p-values are weighted by length,
and a Benjamini-Hochberg threshold over all runs of the corpus bounds the share
of false discoveries.

Two passes over the texts, none of them shuffled: :func:`fit` counts
characters (256 numbers) and the runs' p-values (a histogram of bounded size);
:func:`scan` and :func:`redact` apply the result row by row.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
                    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
#: Shortest run that the battery tests; below, text and noise can't be told apart.
RUN = 24
#: A test rejects randomness below this p-value; share of false discoveries allowed.
REJECT, FALSE_SHARE = 1e-3, 1e-3
#: Alphabets by size; a run's encoding is the first that has all its characters.
ENCODINGS = ("0123456789", "0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
             "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
             "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
             "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/",
             "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_",
             "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_")
_RUN_BYTES = np.zeros(256, bool)
_RUN_BYTES[list(ENCODINGS[-1].encode())] = True
_JOINTS = re.compile(r"[/_+-]+")
#: Draws of a simulated table.
SIMULATED = 4096
_BIN = 0.02  # width of the histogram's bins of -log10 p
_BINS = 16_000


def _normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _chi2_upper(x: float, df: int) -> float:
    """Upper tail of chi-squared, by the cube-root normal approximation."""
    s = 2 / (9 * df)
    return 1 - _normal_cdf(((max(x, 1e-9) / df) ** (1 / 3) - (1 - s)) / math.sqrt(s))


def _log10_lower(z: float) -> float:
    """log10 of the normal's lower tail, also where it underflows."""
    if z > -30:
        return math.log10(max(_normal_cdf(z), 1e-300))
    return (-z * z / 2 - math.log(-z * math.sqrt(2 * math.pi))) / math.log(10)


@dataclass
class Battery:
    """Fitted scan: character shares of the corpus, mean run length, and the
    threshold on the weighted -log10 p (infinite: nothing is a discovery)."""

    shares: list[float]
    mean_length: float = float(RUN)
    threshold: float = math.inf

    def against_text(self, encoding: int, n: int, squares: int) -> float:
        """-log10 of the length-weighted p-value that characters drawn like the
        corpus's own are as evenly spread as these: ``n`` characters whose counts'
        squares sum to ``squares``."""
        alphabet = ENCODINGS[encoding]
        k = len(alphabet)
        chi2 = squares * k / n - n
        fold = not any(x.islower() for x in alphabet)  # capitals alone: text in capitals would have text's letters
        q = np.array([self.shares[ord(x)] + fold * x.isalpha() * self.shares[ord(x.lower())] for x in alphabet]) + 1e-6
        q = q / q.sum()
        s2, s3 = float((q ** 2).sum()), float((q ** 3).sum())
        expected = k * (1 + (n - 1) * s2) - n
        spread = 2 * n * (n - 1) * (s2 + 2 * (n - 2) * s3 - (2 * n - 3) * s2 * s2) * (k / n) ** 2
        z = (chi2 - expected) / math.sqrt(max(spread, 1e-9))
        return -_log10_lower(z) + math.log10(n / self.mean_length)

    def secret(self, token: str) -> bool:
        measured = measure(token)
        return measured is not None and self.against_text(*measured) >= self.threshold and looks_random(token)


def _values(token: str) -> tuple[int, np.ndarray] | None:
    token = token.rstrip("=")
    chars = set(token)
    encoding = next((i for i, a in enumerate(ENCODINGS) if chars <= set(a)), None)
    if encoding is None or len(token) < RUN:
        return None
    return encoding, np.array([ENCODINGS[encoding].index(c) for c in token])


def measure(token: str) -> tuple[int, int, int] | None:
    """(encoding, length, sum of squared character counts): all that the test
    against text needs, and nothing that gives the token away."""
    found = _values(token)
    if found is None:
        return None
    seen = np.bincount(found[1])
    return found[0], len(found[1]), int((seen * seen).sum())


def looks_random(token: str) -> bool:
    """Whether the uniformity, runs and serial tests all pass."""
    encoding, value = _values(token)
    n, k = len(value), len(ENCODINGS[encoding])
    seen = np.bincount(value, minlength=k)
    chi2 = float((seen ** 2).sum()) * k / n - n
    high = value >= k / 2
    a, b = int(high.sum()), n - int(high.sum())
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * a * b / n
    var = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
    run_p = math.erfc(abs(runs - mean) / math.sqrt(2 * var)) if var > 0 else 0.0
    c = value - value.mean()
    serial = float((c[1:] * c[:-1]).sum()) / max(float((c * c).sum()), 1e-12)
    serial_p = math.erfc(abs(serial + 1 / n) * math.sqrt(n / 2))
    return min(uniformity(chi2, n, k), run_p, serial_p) >= REJECT


def uniformity(chi2: float, n: int, k: int) -> float:
    """P(a statistic as high) of ``n`` uniform characters of ``k``. The
    chi-squared law needs some five characters a letter; below that the tail
    comes from simulated tables, seeded, one for each (n, k)."""
    if n >= 5 * k:
        return _chi2_upper(chi2, k - 1)
    table = _simulated(n, k)
    return (1 + len(table) - int(np.searchsorted(table, chi2 - 1e-9))) / (1 + len(table))


@lru_cache(maxsize=4096)
def _simulated(n: int, k: int) -> np.ndarray:
    draws = np.random.default_rng([n, k]).multinomial(n, np.full(k, 1 / k), size=SIMULATED)
    return np.sort((draws.astype(np.float64) ** 2).sum(axis=1) * k / n - n)


def base_spans(text: str, raw: bytes, long_run: bool = True) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the three patterns, leftmost and without
    overlap within a kind; code points, end exclusive."""
    found = []
    low = raw.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    if long_run:
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LENGTH]
    return sorted(found, key=lambda s: (s[0], s[2]))


def long_runs(raws: list[bytes]) -> list[list[tuple[int, int]]]:
    """Byte spans of runs of at least RUN encoding characters, per text."""
    buf = np.frombuffer(b"\n" + b"\n".join(raws) + b"\n", np.uint8)
    inside = _RUN_BYTES[buf]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = change[::2], change[1::2]
    keep = end - begin >= RUN
    begin, end = begin[keep], end[keep]
    first = np.cumsum([1] + [len(r) + 1 for r in raws])
    out: list[list[tuple[int, int]]] = [[] for _ in raws]
    for b, e, d in zip(begin.tolist(), end.tolist(), (np.searchsorted(first, begin, "right") - 1).tolist()):
        out[d].append((b - int(first[d]), e - int(first[d])))
    return out


def _rests(start: int, end: int, base: list) -> list[tuple[int, int]]:
    """What the base spans leave of [start, end), in pieces of RUN or more."""
    out, at = [], start
    for s, t, _ in sorted(base):
        if t <= at or s >= end:
            continue
        out.append((at, s))
        at = t
    out.append((at, end))
    return [(a, b) for a, b in out if b - a >= RUN]


def _parts(token: str) -> list[tuple[int, int]]:
    """The pieces of RUN or more between separators, if there is one."""
    out, at = [], 0
    for m in [*_JOINTS.finditer(token), None]:
        end = m.start() if m else len(token)
        if RUN <= end - at < len(token):
            out.append((at, end))
        at = m.end() if m else end
    return out


def find_spans(texts: list[str], battery: Battery | None) -> list[tuple[list, list]]:
    """Per text: base spans, and either the discoveries as spans or, without a
    battery, the tokens that it would have to test.

    A run is cut where base spans begin and end, and each rest is judged; if it
    is no secret as a whole, the pieces between its separators are."""
    raws = [t.encode() for t in texts]
    out = []
    for text, raw, runs in zip(texts, raws, long_runs(raws)):
        base = base_spans(text, raw, bool(runs))
        more = []
        for b, e in runs:
            begin = len(raw[:b].decode())
            for start, end in _rests(begin, begin + e - b, base):
                token = text[start:end]
                if battery is None:
                    more += [token, *(token[x:y] for x, y in _parts(token))]
                elif battery.secret(token):
                    more.append((start, end, 3))
                else:
                    more += [(start + x, start + y, 3) for x, y in _parts(token) if battery.secret(token[x:y])]
        out.append((base, more))
    return out


def fit(docs: DataFrame, text_col: str = "text", false_share: float = FALSE_SHARE) -> Battery:
    """Character shares and the discovery threshold over all texts.

    One pass gives a character count per batch and the measures of the runs, not
    the runs themselves; both are summed before anything reaches the driver (256
    counts; at most 16,000 bins).
    """
    def gather(batches):
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                texts = [t or "" for t in batch.slice(at, 512).column(0).to_pylist()]
                counts = np.bincount(np.frombuffer("".join(texts).encode(), np.uint8), minlength=256)
                found = [measure(x) for _, more in find_spans(texts, None) for x in more]
                rows = [(None, None, None, counts.tolist())] + [(*m, None) for m in found if m]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3], pa.list_(pa.int64()))],
                                                 names=["encoding", "n", "squares", "counts"])

    seen = written(docs.select(text_col).mapInArrow(gather, "encoding long, n long, squares long, counts array<long>"), "secret-runs")
    total = (seen.filter("counts IS NOT NULL").select(F.posexplode("counts").alias("byte", "n"))
             .groupBy("byte").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros(256)
    for byte, n in total:
        counts[byte] = n
    tested = seen.filter("n IS NOT NULL").select("encoding", "n", "squares")
    size = tested.agg(F.count("n"), F.avg("n")).first()
    battery = Battery((counts / max(counts.sum(), 1)).tolist(), float(size[1] or RUN))

    def bins(batches):
        import pyarrow as pa
        for batch in batches:
            logs = [battery.against_text(*r) for r in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([int(min(max(x, 0) / _BIN, _BINS - 1)) for x in logs], pa.int32())], names=["bin"])

    hist = tested.mapInArrow(bins, "bin int").groupBy("bin").count().orderBy(F.desc("bin")).collect()
    at_most = 0
    for bin_, n in hist:  # the largest p-value that Benjamini-Hochberg accepts
        at_most += n
        if at_most >= size[0] * 10 ** (-bin_ * _BIN) / false_share:
            battery.threshold = bin_ * _BIN
    return battery


def scan(docs: DataFrame, battery: Battery, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, spans array<struct<start long, end long, kind string>>, by
    start, then kind; code points, end exclusive. A null text is empty. Every
    row of ``docs`` gives one row; other columns are not kept."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        of = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = find_spans([t or "" for t in part.column(1).to_pylist()], battery)
                spans = [[{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in sorted(b + m, key=lambda x: (x[0], x[2]))]
                         for b, m in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, of)], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, spans array<struct<start:bigint,end:bigint,kind:string>>")


def redact(docs: DataFrame, battery: Battery, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark`` (overlapping
    spans by one). All columns stay; a null text stays null."""
    at_col = docs.columns.index(text_col)

    def clean(text: str, spans: list) -> str:
        out, done = [], 0
        for s, e, _ in spans:
            if s >= done:
                out += [text[done:s], mark]
            done = max(done, e)
        return "".join(out) + text[done:]

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(at_col).to_pylist()
                found = find_spans([t or "" for t in texts], battery)
                fixed = [t if t is None or not (b or m) else clean(t, sorted(b + m)) for t, (b, m) in zip(texts, found)]
                cols = list(part.columns)
                cols[at_col] = pa.array(fixed, part.schema.field(at_col).type)
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
