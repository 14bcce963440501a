"""Local surrogate explanations as a map-only batch job.

Per message (cleaned serving text of at least 20 characters):

1. word types = distinct maximal word runs; copy 0 is the message itself, copy
   i >= 1 removes exactly k_i types, k_i uniform in [1, d], a subset drawn from a
   generator seeded by the text, so a message gets the same copies anywhere.
2. The copy's text keeps every separator and drops the removed words; it is
   scored by the fitted model (terms, weights and engineered features of that
   text). No copy's text is made: from the copies x words mask, matrix products
   give the counts of single terms and the features, and the pairs of words that
   come to stand side by side in a copy give those of its n-grams.
   In a lower-case text the copies are bits, and a pair costs its few candidate places.
3. Cosine distance to the original x 100, kernel sqrt(exp(-d^2 / 25^2)), weighted
   forward selection of 6 words (weighted R^2, all candidates at once) and a
   weighted ridge (alpha 1, intercept) on them; weights explain the predicted
   class (the sign is flipped for legitimate).
4. Filler tokens (subject, from, body, com) are dropped, weights rounded to 4,
   and the sentence is built as for the linear attributions.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scores import SURROGATE_SENTENCES, SURROGATE_TOO_SHORT, attribution_sentence
from .models import LinearModel
from .tfidf import TfidfModel

SAMPLES = 500
KERNEL_WIDTH = 25.0
FEATURES = "array<struct<feature:string,weight:double>>"
_WORD = re.compile(r"\w+")
_TOKEN = re.compile(r"\w{2,}")
#: Cells of a copies x words mask that are looked at together.
_HELD = 4_000_000
_PHRASES = (K.URGENT_WORDS, K.ACCOUNT_WORDS, K.PAYMENT_WORDS)
_LONGEST_PHRASE = max(p.count(" ") for ws in _PHRASES for p in ws)
_LINK = re.compile(r"http[s]?://|www\.", re.I)


@dataclass
class TermIndex:
    """The terms of one and two words as arrays; words are numbered by ``ids``."""

    ids: dict  # word -> number; -2 for stop words
    single: np.ndarray  # by word: idf * coefficient, idf of the term that it is, or 0
    starts: np.ndarray  # by word: where its pairs begin
    seconds: np.ndarray  # by pair: the second word
    pairs: np.ndarray  # by pair: idf * coefficient, idf


@dataclass
class TextScorer:
    """The fitted model on one text at a time, for the copies of a message."""

    terms: dict  # term -> (idf * coefficient, idf)
    engineered: list
    intercept: float
    stops: frozenset
    n_max: int
    sublinear: bool
    has_margin: bool = True
    _pairs: dict | None = None
    _index: TermIndex | None = None

    @classmethod
    def of(cls, tfidf: TfidfModel, model: LinearModel) -> TextScorer:
        terms = {t: (idf * model.coef[ix], idf) for t, ix, _, _, idf in tfidf.vocab}
        return cls(terms, list(model.coef[tfidf.size:]), model.intercept, frozenset(tfidf.stop_words), tfidf.n_max, tfidf.sublinear,
                   model.extra.get("has_margin", True))

    def margin(self, text: str) -> float:
        tokens = [t for t in _TOKEN.findall(text.lower()) if t not in self.stops]
        grams = list(tokens)
        for n in range(2, self.n_max + 1):
            grams += map(" ".join, zip(*(tokens[k:] for k in range(n))))
        dot = norm = 0.0
        for term, n in Counter(grams).items():
            known = self.terms.get(term)
            if known:
                tf = 1.0 + math.log(n) if self.sublinear else float(n)
                dot += tf * known[0]
                norm += (tf * known[1]) ** 2
        out = self.intercept + (dot / math.sqrt(norm) if norm else 0.0)
        if self.engineered:
            low = text.lower()
            letters = [c for c in text if c.isalpha()]
            values = (len(_LINK.findall(text)), *(any(w in low for w in ws) for ws in (K.URGENT_WORDS, K.ACCOUNT_WORDS, K.PAYMENT_WORDS)),
                      text.count("!"), sum(c.isupper() for c in letters) / len(letters) if letters else 0.0)
            out += sum(c * v for c, v in zip(self.engineered, values))
        return out

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        """Logistic of the margins; 0 or 1 for a model without one."""
        return 1 / (1 + np.exp(-np.clip(margins, -700.0, 700.0))) if self.has_margin else (margins > 0).astype(float)

    def probability(self, text: str) -> float:
        return float(self.probabilities(np.array([self.margin(text)]))[0])

    def pairs(self) -> dict:
        """first word -> {second word: (idf * coefficient, idf)} of the terms of two words."""
        if self._pairs is None:
            self._pairs = {}
            for term, known in self.terms.items():
                if term.count(" ") == 1:
                    first, second = term.split(" ")
                    self._pairs.setdefault(first, {})[second] = known
        return self._pairs

    def index(self) -> TermIndex:
        if self._index is None:
            pairs = self.pairs() if self.n_max > 1 else {}
            single = [t for t in self.terms if " " not in t]
            words = [w for w in dict.fromkeys([*single, *pairs, *(b for own in pairs.values() for b in own)]) if w not in self.stops]
            ids = {w: i for i, w in enumerate(words)}
            own = [[(ids[b], *known) for b, known in pairs.get(w, {}).items() if b in ids] for w in words]
            flat = np.array([p for o in own for p in o], float).reshape(-1, 3)
            self._index = TermIndex(ids | dict.fromkeys(self.stops, -2), np.array([self.terms.get(w, (0.0, 0.0)) for w in words], float).reshape(-1, 2).T,
                                    np.cumsum([0, *map(len, own)]), flat[:, 0].astype(np.int64), flat[:, 1:].T)
        return self._index


class Copies:
    """A message whose words can be blanked: ``words`` are its word types, in order."""

    def __init__(self, text: str):
        self.text = text
        self.parts = re.split(r"(\w+)", text)  # separators at even places, words at odd ones
        self.words = sorted(set(self.parts[1::2]))
        place = {w: i for i, w in enumerate(self.words)}
        self.types = np.array([place[w] for w in self.parts[1::2]], np.int64)
        self.low = text.lower()
        self.ends = self.parts if self.low == text else [p.lower() for p in self.parts]

    def text_of(self, kept: np.ndarray) -> str:
        copy = list(self.parts)
        copy[1::2] = [w if kept[k] else "" for w, k in zip(self.parts[1::2], self.types)]
        return "".join(copy)

    def _plain(self, scorer: TextScorer) -> bool:
        """Whether blanking words can't change how the other words read: no letter
        whose lower case depends on its neighbours, no link put together from the
        rests, and terms and key phrases of two words at most."""
        low, ends = self.low, self.ends
        return (scorer.n_max <= 2 and "\u03a3" not in self.text and "".join(ends) == low and _LONGEST_PHRASE < 2
                and not ("http" in low and any(w.endswith(("http", "https")) and after in (":", ":/") for w, after in zip(ends[1::2], ends[2::2]))))

    def margins(self, z: np.ndarray, scorer: TextScorer) -> np.ndarray:
        """The margin of every copy; ``z``: copies x words, 1 where the word is kept."""
        if not self._plain(scorer):
            return np.array([scorer.margin(self.text_of(row)) for row in z])
        low = self.words if self.low == self.text else [w.lower() for w in self.words]
        often = np.bincount(self.types, minlength=len(low))
        features = self._feature_sums(low, often) if scorer.engineered else []
        if self.low == self.text:
            sums, known, has_token = self._of_words(often, scorer)
            total = z @ np.column_stack([*sums, *features])
            dot, norm = total[:, 0], total[:, 1]
            if len(known[0]):
                x, y = self._next_to(z, has_token, *known, scorer.sublinear)
                dot, norm = dot + x, norm + y
            total = total[:, 2:]
        else:
            dot, norm = self._of_tokens(z, low, often, scorer)
            total = z @ np.column_stack(features) if features else None
        out = scorer.intercept + np.where(norm > 0, dot / np.sqrt(np.where(norm > 0, norm, 1)), 0.0)
        return out + self._features(z, total) @ np.array(scorer.engineered) if scorer.engineered else out

    def _of_tokens(self, z: np.ndarray, low: list[str], often: np.ndarray, scorer: TextScorer) -> tuple[np.ndarray, np.ndarray]:
        """By copy, the product of its terms with their weights and their squared length."""
        found = [[t for t in _TOKEN.findall(w) if t not in scorer.stops] for w in low]
        tokens = {t: i for i, t in enumerate(sorted({t for f in found for t in f}))}
        dot, norm = np.zeros(len(z)), np.zeros(len(z))

        def add(counts: np.ndarray, known: list) -> None:
            w = np.array(known).reshape(-1, 2)
            tf = np.where(counts > 0, 1.0 + np.log(np.maximum(counts, 1)) if scorer.sublinear else counts, 0.0)
            dot[:] += tf @ w[:, 0]
            norm[:] += (tf * tf) @ (w[:, 1] ** 2)

        single = [t for t in tokens if t in scorer.terms]
        if single:
            column, has = {t: i for i, t in enumerate(single)}, np.zeros((len(low), len(single)))
            for k, f in enumerate(found):
                for t in f:
                    if t in column:
                        has[k, column[t]] += often[k]
            add(z @ has, [scorer.terms[t] for t in single])
        known = sorted((tokens[a] * len(tokens) + tokens[b], w) for a in tokens for b, w in scorer.pairs().get(a, {}).items() if b in tokens)
        if known and scorer.n_max == 2:
            add(self._side_by_side(z, found, tokens, np.array([c for c, _ in known])), [w for _, w in known])
        return dot, norm

    def _side_by_side(self, z: np.ndarray, found: list, tokens: dict, codes: np.ndarray) -> np.ndarray:
        """copies x codes: how often the two tokens of a code follow each other among the kept ones."""
        of_item = np.array([k for k in self.types for _ in found[k]], np.int64)
        token = np.array([tokens[t] for k in self.types for t in found[k]], np.int64)
        out, step = np.zeros((len(z), len(codes))), max(1, _HELD // max(len(token), 1))
        small = len(tokens) ** 2 <= _HELD  # then a code's place is looked up, else searched
        if small:
            places = np.full(len(tokens) ** 2, -1, np.int32)
            places[codes] = np.arange(len(codes))
        for at in range(0, len(z), step):
            row, item = np.nonzero(z[at:at + step][:, of_item])
            here = row[1:] == row[:-1]
            code = (token[item[:-1]] * len(tokens) + token[item[1:]])[here]
            place = places[code] if small else np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = place >= 0 if small else codes[place] == code
            n = np.bincount(row[1:][here][hit] * len(codes) + place[hit], minlength=len(z[at:at + step]) * len(codes))
            out[at:at + step] = n.reshape(-1, len(codes))
        return out

    def _of_words(self, often: np.ndarray, scorer: TextScorer) -> tuple[list, tuple, np.ndarray]:
        """For a text in lower case, where a word is one token, a stop word or too short:
        by word, what it adds to a copy's product and squared length if it is kept; the known
        pairs (first word, second word, weights); whether the word is a token."""
        index = scorer.index()
        code = np.array([index.ids.get(w, -1) if len(w) > 1 else -2 for w in self.words], np.int64)  # -1: a token of no term, -2: none
        at = np.flatnonzero(code >= 0)
        own = code[at]
        tf = 1.0 + np.log(often[at]) if scorer.sublinear else often[at]
        sums = [np.zeros(len(code)), np.zeros(len(code))]
        sums[0][at], sums[1][at] = tf * index.single[0][own], (tf * index.single[1][own]) ** 2
        begins, sizes = index.starts[own], index.starts[own + 1] - index.starts[own]
        entry = np.arange(sizes.sum()) + np.repeat(begins - np.cumsum(sizes) + sizes, sizes)
        word = np.full(len(index.ids), -1)
        word[own] = at
        second = word[index.seconds[entry]]
        here = second >= 0
        return sums, (np.repeat(at, sizes)[here], second[here], index.pairs[:, entry[here]]), code > -2

    def _next_to(self, z: np.ndarray, has_token: np.ndarray, firsts: np.ndarray, seconds: np.ndarray, weights: np.ndarray,
                 sublinear: bool) -> tuple[np.ndarray, np.ndarray]:
        """By copy, what the pairs add to the product and the squared length, counted where
        their words follow each other among the kept tokens.

        A copy keeps all places of a word or none. So a place of the first word can only
        meet the next place of the second, and only if neither is between them: a few
        candidates a pair. Copies are bits; a table of unions over 1, 2, 4 ... places tells
        for all copies at once in which of them nothing between the two is kept."""
        at = np.flatnonzero(has_token[self.types])
        of_item, n = self.types[at], len(at)
        order = np.argsort(of_item, kind="stable")  # by word, then place
        keys, starts = of_item[order] * n + order, np.searchsorted(of_item[order], np.arange(len(has_token) + 1))
        before = np.full(n, -1)
        again = of_item[order[1:]] == of_item[order[:-1]]
        before[order[1:][again]] = order[:-1][again]
        often = starts[seconds + 1] - starts[seconds]
        pair = np.repeat(np.arange(len(firsts)), often)
        q = order[np.arange(len(pair)) + np.repeat(starts[seconds] - np.cumsum(often) + often, often)]
        last = np.searchsorted(keys, firsts[pair] * n + q) - 1  # the last place of the first word before q
        p = order[last]
        there = (last >= 0) & (of_item[p] == firsts[pair]) & (before[q] <= p)
        pair, p, q = pair[there], p[there], q[there]
        gap = q - p - 1
        level = np.where(gap > 0, np.frexp(gap)[1] - 1, 0)
        top = int(level.max(initial=0)) + 1
        dot, norm = np.zeros(len(z)), np.zeros(len(z))
        step = 64 * max(1, _HELD // (64 * max(top * n // 8, len(p), 1)))
        for begin in range(0, len(z), step):
            part = z[begin:begin + step] > 0
            bits = np.zeros((part.shape[1], -(-len(part) // 64) * 8), np.uint8)
            bits[:, :-(-len(part) // 8)] = np.packbits(part, axis=0, bitorder="little").T
            union = np.zeros((top, n, bits.shape[1] // 8), np.uint64)
            union[0] = bits.view(np.uint64)[of_item]
            for k in range(1, top):
                half = 1 << (k - 1)
                union[k, :n - half] = union[k - 1, :n - half] | union[k - 1, half:]
            between = union[level, np.minimum(p + 1, n - 1)] | union[level, np.maximum(q - (1 << level), 0)]
            between[gap == 0] = 0
            meet = union[0, p] & union[0, q] & ~between
            some = np.flatnonzero(meet.any(axis=1))
            if not len(some):
                continue
            counts = np.unpackbits(meet[some].view(np.uint8), axis=1, count=len(part), bitorder="little")
            own = np.flatnonzero(np.r_[True, np.diff(pair[some]) > 0])
            if len(own) < len(some):
                counts = np.add.reduceat(counts, own, axis=0, dtype=np.int64)
            tf = np.r_[0.0, 1.0 + np.log(np.arange(1, counts.max() + 1))][counts] if sublinear else counts.astype(float)
            w = weights[:, pair[some[own]]]
            dot[begin:begin + step] = w[0] @ tf
            norm[begin:begin + step] = w[1] ** 2 @ (tf * tf)
        return dot, norm

    def _feature_sums(self, low: list[str], often: np.ndarray) -> list[np.ndarray]:
        """By word: its links, whether it holds a key phrase of each kind, its letters, its upper-case letters."""
        parts, links = self.ends, np.zeros(len(low))
        if "://" in self.low or "www." in self.low:
            for k, word, after in zip(self.types, parts[1::2], parts[2::2]):
                links[k] += (word.endswith(("http", "https")) and after.startswith("://")) + (word.endswith("www") and after.startswith("."))
        out = [links]
        for phrases in _PHRASES:
            here = [p for p in phrases if " " not in p and p in self.low]
            out.append(np.array([any(p in w for p in here) for w in low], float) if here else np.zeros(len(low)))
        letters = np.array([len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in self.words])
        upper = np.zeros(len(low)) if self.text.islower() else np.array([sum(c.isalpha() and c.isupper() for c in w) for w in self.words])
        return [*out, often * letters, often * upper]

    def _features(self, z: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """copies x the six engineered features, from the copies' sums of _feature_sums()."""
        parts, columns = self.ends, [sums[:, 0]]
        for phrases, alone in zip(_PHRASES, sums[:, 1:4].T):
            there = alone > 0
            for phrase in phrases:
                if " " not in phrase or phrase not in self.low:
                    continue
                first, second = phrase.split(" ")
                sides = {(a, b) for a, b, x, gap, y in zip(self.types, self.types[1:], parts[1::2], parts[2::2], parts[3::2])
                         if gap == " " and x.endswith(first) and y.startswith(second)}
                for a, b in sides:
                    there |= (z[:, a] > 0) & (z[:, b] > 0)
            columns.append(there)
        letters, upper = sums[:, 4], sums[:, 5]
        return np.column_stack([*columns, np.full(len(z), self.text.count("!")), np.where(letters > 0, upper / np.maximum(letters, 1), 0.0)])


def drawn_copies(text: str, d: int, n_samples: int, seed: int) -> np.ndarray:
    """copies x words, 1 where the word is kept: copy 0 keeps all, the others lose the
    first k of a permutation of the words."""
    rng = np.random.default_rng([seed, crc32(text.encode())])
    words, order, z = np.arange(d), np.empty(d, np.int64), np.ones((n_samples, d), bool)
    for kept in z[1:]:
        order[:] = words
        rng.shuffle(order)  # what permutation(d) draws, without an array for each
        kept[order[:rng.integers(1, d + 1)]] = False
    return z.astype(float)


def explain(text: str, phishing: bool, scorer: TextScorer, n_samples: int, n_features: int, seed: int) -> list[tuple[str, float]]:
    """(word, weight) of the selected words, the largest weight first."""
    copies = Copies(text)
    if not copies.words:
        return []
    z = drawn_copies(text, len(copies.words), n_samples, seed)
    p = scorer.probabilities(copies.margins(z, scorer))
    return _weights(z, p if phishing else 1 - p, copies.words, n_features)


def _weights(z: np.ndarray, y: np.ndarray, words: list[str], n_features: int, alpha: float = 1.0) -> list[tuple[str, float]]:
    d = z.shape[1]
    kept = z.sum(1)
    cos = 1.0 - kept / (np.sqrt(np.maximum(kept, 1e-300)) * np.sqrt(d))
    cos[kept == 0] = 1.0
    wts = np.sqrt(np.exp(-((cos * 100.0) ** 2) / KERNEL_WIDTH ** 2))
    sw = np.sqrt(wts)[:, None]
    x = (z - (wts @ z) / wts.sum()) * sw  # weighted centring takes care of the intercept
    t = (y - (wts @ y) / wts.sum()) * sw[:, 0]
    used = _selected(x, t, min(n_features, d))
    a = x[:, used]
    coef = np.linalg.solve(a.T @ a + alpha * np.eye(len(used)), a.T @ t)
    return [(words[used[i]], float(coef[i])) for i in np.argsort(-np.abs(coef), kind="stable")]


def _selected(x: np.ndarray, t: np.ndarray, n: int) -> list[int]:
    """Columns of ``x`` by forward selection: each time the one that leaves least of ``t``.

    Only the chosen columns are made orthogonal. The others' squared lengths beside
    them, and their products with what is left, follow from one product each time;
    where too little is left for differences to be told from rounding, all columns
    are made orthogonal."""
    length = np.einsum("ij,ij->j", x, x)
    least, whole, free = 1e-9 * length, float(t @ t), length > 1e-12
    product, resid, used, basis = t @ x, t, [], []
    for _ in range(n):
        if not free.any() or (length[free] <= least[free]).any() or resid @ resid <= max(1e-16 * whole, 1e-24):
            return _selected_whole(x, t, n)
        gain = np.where(free, product ** 2 / np.where(free, length, 1.0), -1.0)
        j = int(np.argmax(gain))
        used.append(j)
        free[j] = False
        v = x[:, j].copy()
        for q in basis:
            v -= q * (q @ v)
        v /= math.sqrt(v @ v)
        basis.append(v)
        along, left = v @ x, float(v @ resid)
        length, product, resid = length - along * along, product - left * along, resid - left * v
    return used


def _selected_whole(x: np.ndarray, t: np.ndarray, n: int) -> list[int]:
    """The same, all columns made orthogonal at each choice."""
    used: list[int] = []
    resid, e = t.copy(), x.copy()
    for _ in range(n):
        den = (e * e).sum(0)
        gain = np.where(den > 1e-12, (e.T @ resid) ** 2 / np.maximum(den, 1e-12), -np.inf)
        gain[used] = -np.inf
        j = int(np.argmax(gain))
        used.append(j)
        v = e[:, j].copy()
        if v @ v > 1e-12:
            resid = resid - v * (v @ resid) / (v @ v)
            e = e - np.outer(v, (v @ e) / (v @ v))
    return used


def masked_margins(tfidf: TfidfModel, model: LinearModel, msgs: DataFrame, key: str, parts: int, text: str = "cleaned_text") -> DataFrame:
    """(``key``, copy int, margin): for each message the margins of ``parts`` copies
    without the word types whose place in their sorted list is copy modulo ``parts``."""
    shared = msgs.sparkSession.sparkContext.broadcast(TextScorer.of(tfidf, model))  # bounded by max_features
    kind = msgs.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                copies = Copies(t or "")
                z = np.ones((parts, len(copies.words)))
                for i in range(parts):
                    z[i, i::parts] = 0
                out.append(copies.margins(z, shared.value))
            flat = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), parts))),
                                              pa.array(np.tile(np.arange(parts, dtype=np.int32), batch.num_rows)), pa.array(flat)],
                                             names=[key, "copy", "margin"])

    return msgs.select(key, text).mapInArrow(run, f"`{key}` {kind}, copy int, margin double")


def local_surrogate(tfidf: TfidfModel, model: LinearModel, msgs: DataFrame, n_samples: int = SAMPLES,
                    n_features: int = K.ATTRIBUTION_TOP, seed: int = 42) -> DataFrame:
    """``msgs`` (with cleaned_text and prediction) plus surrogate_features and
    surrogate_summary; a row for every row, all fields kept."""
    from pyspark.sql.types import StructField, StructType
    spark = msgs.sparkSession
    shared = spark.sparkContext.broadcast(TextScorer.of(tfidf, model))  # bounded by max_features
    kind = spark.createDataFrame([], f"x {FEATURES}").schema["x"].dataType
    schema = StructType([*msgs.schema.fields, StructField("_found", kind)])
    names, fillers = msgs.columns, set(K.FILLER_TOKENS)

    def run(batches):
        import pyarrow as pa
        scorer = shared.value
        for batch in batches:
            text, pred = batch.column(names.index("cleaned_text")), batch.column(names.index("prediction"))
            found = []
            for t, p in zip(text.to_pylist(), pred.to_pylist()):
                short = len(t or "") < K.SHORT_TEXT_LIMIT
                pairs = [] if short else explain(t, p == K.PHISHING, scorer, n_samples, n_features, seed)
                found.append([{"feature": w, "weight": v} for w, v in pairs if w.lower() not in fillers])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(pa.struct([("feature", pa.string()), ("weight", pa.float64())])))],
                names=[*names, "_found"])

    out = msgs.mapInArrow(run, schema).withColumn("surrogate_features", F.transform("_found", lambda x: F.struct(
        x["feature"].alias("feature"), F.round(x["weight"], 4).alias("weight")))).drop("_found")
    summary = F.when(F.length("cleaned_text") < K.SHORT_TEXT_LIMIT, F.lit(SURROGATE_TOO_SHORT)).otherwise(
        attribution_sentence("surrogate_features", "prediction", SURROGATE_SENTENCES))
    return out.withColumn("surrogate_summary", summary)
