"""Token ids of whole texts by a public word-level BPE vocabulary.

The vocabulary's own pre-tokeniser never joins what white space separates, so
the ids of a text are the ids of its white-space chunks in a row. Chunks recur
(Zipf), so each Python worker keeps a bounded table chunk -> ids over all its tasks,
and only new chunks go to the tokenizer. Plain lower-case words skip the tokenizer's
normaliser, which leaves them as they are: they go in bulk through the same
model, whose word-end tokens mark where each word's ids end.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

VOCABULARY = "word_bpe_49k.json"
#: Entries of a worker's table, about 200 bytes each; of its part for frequent
#: chunks, which stays in the processor's cache; texts that choose that part.
TABLE_ENTRIES, FREQUENT, FIRST_TEXTS = 1_200_000, 24_000, 1024
_BLOCK = 64  # texts looked up together

_PLAIN = re.compile(r"([A-Za-zß-öø-ÿÀ-ÖØ-Þ]+)([.,]?)\Z")


class ChunkEncoder:
    """ids of UTF-8 texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: str = VOCABULARY, entries: int = TABLE_ENTRIES):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers
        path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.marks = {m: self._whole([m])[0] for m in ".,"}
        self.entries = entries
        self.table: dict[bytes, bytes] = {}
        self.frequent: dict[bytes, bytes] = {}
        self.seen: Counter | None = Counter()
        self.texts = 0

    def _whole(self, chunks: list[str]) -> list[bytes]:
        found = self.whole.encode_batch_fast(chunks, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _bulk(self, words: list[bytes]) -> list[bytes]:
        out = []
        for at in range(0, len(words), 5000):
            part = words[at:at + 5000]
            ids = np.array(self.bare.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) != len(part):
                out += self._whole([w.decode() for w in part])
                continue
            raw = ids.tobytes()
            out += [raw[b:e] for b, e in zip([0, *stops], stops)]
        return out

    def learn(self, chunks: Iterable[bytes]) -> None:
        table, marks = self.table, self.marks
        if len(table) > self.entries:
            table.clear()
        plain, odd, new = [], [], set()
        for chunk in chunks:
            if chunk.isalpha():  # bytes: ASCII letters
                key, mark = chunk.lower(), ""
            elif chunk[-1] in b".," and chunk[:-1].isalpha():
                key, mark = chunk[:-1].lower(), chr(chunk[-1])
            else:
                text = chunk.decode()
                m = _PLAIN.match(text)
                if not m:
                    odd.append((chunk, text))
                    continue
                key, mark = m[1].lower().encode(), m[2]
            if key not in table:
                new.add(key)
            if mark or key != chunk:
                plain.append((chunk, key, mark))
        new = list(new)
        table.update(zip(new, self._bulk(new)))
        for chunk, key, mark in plain:
            table[chunk] = table[key] + marks[mark] if mark else table[key]
        if odd:
            table.update(zip((c for c, _ in odd), self._whole([t for _, t in odd])))

    def _choose(self, lists: list[list[bytes]]) -> None:
        for chunks in lists:
            self.seen.update(chunks)
        self.texts += len(lists)
        if self.texts >= FIRST_TEXTS:
            common = [c for c, n in self.seen.most_common(FREQUENT) if n > 1]
            self.learn([c for c in common if c not in self.table])
            self.frequent = {c: self.table[c] for c in common if c in self.table}
            self.seen = None

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), _BLOCK):
            lists = [t.encode().split() for t in texts[at:at + _BLOCK]]
            if self.seen is not None:
                self._choose(lists)
            often, get = self.frequent.get, self.table.get
            found, late = [], []
            for chunks in lists:
                ids = list(map(often, chunks))
                for k in [k for k, x in enumerate(ids) if x is None]:
                    ids[k] = x = get(chunks[k])
                    if x is None:
                        late.append((ids, k, chunks[k]))
                found.append(ids)
            if late:
                self.learn({c for _, _, c in late})
                table = self.table
                for ids, k, chunk in late:
                    ids[k] = table[chunk]
            out += [b"".join(ids) for ids in found]
        return out


@lru_cache(maxsize=2)
def shared_encoder(vocabulary: str = VOCABULARY) -> ChunkEncoder:
    """The encoder of this process, whose table outlives a task."""
    return ChunkEncoder(vocabulary)
