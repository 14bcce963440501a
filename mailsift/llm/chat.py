"""Chat formatting: transcripts parsed by a hidden Markov model.

A transcript is lines of several speakers, some marked ("User: ", "### AI"),
some not. Hidden states are a role and whether a line begins an unmarked turn,
begins a marked one or goes on; observations are the line's speaker marker, its
length, its sentences and the gap before it. Viterbi finds the likeliest states,
which give turns with roles; turns are rendered in one canonical form. Only a
line in a marked state loses its marker, so text that merely looks like one
stays. The model's tables are counts over labelled transcripts.

Long conversations are rows of at most SEGMENT_TURNS turns, and still get the
states of the uncut text: Viterbi over a segment is a (max, +) product of
matrices, states by states, so a first pass reduces each segment to one small
matrix, two sweeps over a conversation's matrices (forward, then back) find the
states at the cuts, and a last pass decodes each segment between its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ROLES = ("system", "user", "assistant")
PLAIN, MARKED, ON = 0, 1, 2  # begins a turn without a marker, with one; goes on
STATES = 3 * len(ROLES)  # 3 * role + one of these
#: Spellings of a speaker by role, in lower case.
SPEAKERS = {"system": 0, "note": 0, "context": 0, "user": 1, "human": 1, "question": 1, "q": 1, "customer": 1,
            "assistant": 2, "ai": 2, "bot": 2, "answer": 2, "a": 2, "agent": 2}
_MARKER = re.compile(r"^(?:#{1,4}\s*|\[|<\|?|\*\*)?([A-Za-z]{1,12})(?:\||\]|>|\*\*)*\s*(?::|\]|>|$)\s*|^[-–—]\s+")
_SENTENCE = re.compile(r"[.!?]+(?:\s|$)")
MARKERS, LENGTHS, SENTENCES, GAPS = 5, 12, 6, 3  # values of each observation
SIZES = (STATES, STATES * STATES, STATES * MARKERS, STATES * LENGTHS, STATES * SENTENCES, STATES * GAPS)
#: Turns of a conversation that share a transcript row; longer ones take several.
SEGMENT_TURNS = 256
_STYLES = (("System: ", "User: ", "Assistant: "), ("[system] ", "[human] ", "[AI] "), ("### Context:\n", "### Question:\n", "### Answer:\n"),
           ("Note: ", "Q: ", "A: "))


def marker(line: str) -> tuple[int, str]:
    """(0 none, 1-3 a role, 4 a speaker unknown; the line without its marker)."""
    m = _MARKER.match(line)
    if not m:
        return 0, line
    if m[1] is None:
        return 4, line[m.end():]
    role = SPEAKERS.get(m[1].lower())
    return (0, line) if role is None else (1 + role, line[m.end():])


def observe(lines: list[str], first: bool = True) -> np.ndarray:
    """``first``: the lines begin the transcript; else a blank line is before them."""
    out, gap = np.zeros((len(lines), 4), np.int64), 2 if first else 1  # 0: after text, 1: after a blank line, 2: the first
    for i, line in enumerate(lines):
        kind, rest = marker(line)
        out[i] = kind, min(len(rest).bit_length(), LENGTHS - 1), min(len(_SENTENCE.findall(rest)), SENTENCES - 1), gap
        gap = 0 if line.strip() else 1
    return out


def count_states(lines: list[str], states: list[int], begins: bool = True) -> np.ndarray:
    """First states, transitions and observations of a labelled transcript, as one vector."""
    first, step, *seen = (np.zeros(n) for n in SIZES)
    if lines:
        first[states[0]] += begins
        for a, b in zip(states, states[1:]):
            step[a * STATES + b] += 1
        for s, row in zip(states, observe(lines, begins).tolist()):
            for table, width, value in zip(seen, (MARKERS, LENGTHS, SENTENCES, GAPS), row):
                table[s * width + value] += 1
    return np.concatenate([first, step, *seen])


@dataclass
class Model:
    """Log probabilities: first state, transitions, and a table per observation."""

    first: np.ndarray
    step: np.ndarray
    seen: list[np.ndarray]

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Model:
        first, step, *seen = np.split(counts + 0.5, np.cumsum(SIZES)[:-1])
        rows = lambda x: np.log(x.reshape(STATES, -1) / x.reshape(STATES, -1).sum(axis=1, keepdims=True))
        step, seen = rows(step), [rows(x) for x in seen]
        for role in range(len(ROLES)):
            own = [3 * role + k for k in (PLAIN, MARKED, ON)]
            for other in range(STATES):  # a turn goes on only in its own role
                if other not in own:
                    step[other, 3 * role + ON] = -np.inf
            for kind in range(MARKERS):  # a marked turn bears its role's marker; a dash names nobody, and stays
                if kind != 1 + role:
                    seen[0][3 * role + MARKED, kind] = -np.inf
        first = np.log(first / first.sum())
        first[ON::3] = -np.inf
        return cls(first, step, seen)

    def _emissions(self, lines: list[str], first: bool) -> np.ndarray:
        return sum(table[:, obs].T for table, obs in zip(self.seen, observe(lines, first).T))

    def viterbi(self, lines: list[str], enter: int | None = None, leave: int | None = None) -> list[int]:
        """The likeliest states; on ties the lowest. ``enter``: the state of the line
        before, if there is one; ``leave``: the state that the last line must have."""
        if not lines:
            return []
        emit = self._emissions(lines, enter is None)
        best, back = (self.first if enter is None else self.step[enter]) + emit[0], []
        for e in emit[1:]:
            reach = best[:, None] + self.step
            back.append(reach.argmax(axis=0))
            best = reach.max(axis=0) + e
        path = [int(best.argmax()) if leave is None else leave]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def reach(self, lines: list[str], first: bool) -> np.ndarray:
        """The best score from each state before the lines to each state of the
        last one (``first``: there is no state before; all rows are alike)."""
        emit = self._emissions(lines, first)
        best = (np.tile(self.first, (STATES, 1)) if first else self.step) + emit[0]
        for e in emit[1:]:
            best = (best[:, :, None] + self.step[None]).max(axis=1) + e
        return best

    def turns(self, text: str | None, enter: int | None = None, leave: int | None = None) -> list[tuple[str, str]]:
        """(role, text) of each turn; blank lines at a turn's ends go."""
        lines = text.split("\n") if text else []
        out: list[tuple[str, list[str]]] = []
        for line, state in zip(lines, self.viterbi(lines, enter, leave)):
            if state % 3 != ON or not out:
                out.append((ROLES[state // 3], []))
            out[-1][1].append(marker(line)[1] if state % 3 == MARKED else line)
        return [(role, "\n".join(body).strip("\n")) for role, body in out]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{body}\n<|end|>\n" for role, body in turns)


def transcripts(conversations: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """Plain-text transcripts of a table of turns (conv_id, turn, role, text), as
    chat exports look: (conv_id, segment, text, states). A blank line ends each
    turn, the marker style is the conversation's, and about a third of the turns
    bear no marker. states: the true state of each line (null where the role is
    none of ROLES).

    Turns are numbered by ``turn`` (null first), then role and text, and cut into
    segments of ``segment_turns``, so no row grows with a long conversation, a
    repeated turn or a missing one. A null text is an empty line; a null id is a
    conversation of its own.
    """
    from pyspark.sql import Window
    style = F.array(*[F.array(*[F.lit(x) for x in s]) for s in _STYLES])[F.pmod(F.xxhash64("conv_id"), F.lit(len(_STYLES))).cast("int")]
    role = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.coalesce(F.col("role"), F.lit("")))
    shown = (F.pmod(F.xxhash64("conv_id", "turn", F.lit(3)), F.lit(3)) > 0) & (role > 0)
    mark = F.when(shown, F.get(style, role.cast("int") - 1)).otherwise("")
    body = F.concat(mark, F.coalesce("text", F.lit("")), F.lit("\n"))
    n = F.size(F.split(body, "\n", -1))
    begin = F.when(role > 0, 3 * (role - 1) + F.when(shown, MARKED).otherwise(PLAIN)).cast("int")
    goes_on = F.when(role > 0, 3 * (role - 1) + ON).cast("int")
    states = F.concat(F.array(begin), F.array_repeat(goes_on, n - 1))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    rows = conversations.select("conv_id", nth.alias("nth"), body.alias("body"), states.alias("states"))
    rows = rows.select("conv_id", F.expr(f"nth div {segment_turns}").cast("long").alias("segment"), F.struct("nth", "body", "states").alias("t"))
    held = rows.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return held.select("conv_id", "segment", F.array_join(F.transform("t", lambda x: x["body"]), "\n").alias("text"),
                       F.flatten(F.transform("t", lambda x: x["states"])).alias("states"))


def fit(labelled: DataFrame) -> Model:
    """Counts over all labelled transcripts (text, states, and segment if they are
    cut); those with an unknown state teach nothing. A batch sends one vector."""
    begins = F.col("segment") == 0 if "segment" in labelled.columns else F.lit(True)

    def count(batches):
        import pyarrow as pa
        for batch in batches:
            total = np.zeros(sum(SIZES))
            for text, states, first in zip(*(c.to_pylist() for c in batch.columns)):
                if text is not None and states and None not in states:
                    total += count_states(text.split("\n"), states, bool(first))
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["n"])

    sums = (labelled.select("text", "states", begins.alias("first")).mapInArrow(count, "n array<double>")
            .select(F.posexplode("n").alias("i", "n")).groupBy("i").agg(F.sum("n")).collect())
    counts = np.zeros(sum(SIZES))
    for i, n in sums:
        counts[i] = n
    return Model.of_counts(counts)


def _marked_changes(batches, at: int):
    """(batch, its rows, each with whether the first ``at`` values differ from the row before)."""
    before = None
    for batch in batches:
        rows = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append((before != row[:at], row))
            before = row[:at]
        yield batch, rows


def _batch(out: list, like, at: int, more: list):
    """Rows as a batch: ``at`` columns as in ``like``, then those of ``more`` (name, type)."""
    import pyarrow as pa
    fields = [(f.name, f.type) for f in list(like.schema)[:at]] + more
    cols = list(zip(*out)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def cut_states(texts: DataFrame, model: Model, keys: list[str], segment: str, text_col: str = "text") -> DataFrame:
    """``keys``, ``segment``, enter int and leave int of every segment: the uncut
    text's state before the segment (null: it is the first) and at its last line.
    What is sorted is a matrix a segment; a conversation's are read as a stream."""
    names = [*keys, segment]
    ddl, at = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in names), len(names)

    def reduced(batches):
        import pyarrow as pa
        for batch in batches:
            found = [model.reach((t or "").split("\n"), s == 0).ravel().tolist()
                     for t, s in zip(batch.column(at).to_pylist(), batch.column(at - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))], names=[*names, "reach"])

    def forward(batches):  # the best score of each state at a segment's end, and where it came from
        import pyarrow as pa
        best = None
        for batch, rows in _marked_changes(batches, at - 1):
            out = []
            for fresh, row in rows:
                matrix = np.array(row[at]).reshape(STATES, STATES)
                both = matrix if fresh else best[:, None] + matrix
                best = both.max(axis=0)
                out.append((*row[:at], both.argmax(axis=0).tolist(), int(best.argmax())))
            yield _batch(out, batch, at, [("back", pa.list_(pa.int32())), ("ends", pa.int32())])

    def backward(batches):
        import pyarrow as pa
        enter = None
        for batch, rows in _marked_changes(batches, at - 1):
            out = []
            for fresh, row in rows:
                leave = row[at + 1] if fresh else enter
                enter = row[at][leave]
                out.append((*row[:at], None if row[at - 1] == 0 else enter, leave))
            yield _batch(out, batch, at, [("enter", pa.int32()), ("leave", pa.int32())])

    order = [F.col(f"`{k}`") for k in keys]
    sorted_by = lambda df, last: df.repartition(*order).sortWithinPartitions(*order, last)
    matrices = texts.select(*names, F.col(text_col).alias("__text")).mapInArrow(reduced, f"{ddl}, reach array<double>")
    scored = sorted_by(matrices, F.asc(segment)).mapInArrow(forward, f"{ddl}, back array<int>, ends int")
    return sorted_by(scored, F.desc(segment)).mapInArrow(backward, f"{ddl}, enter int, leave int")


def format_chats(texts: DataFrame, model: Model, keys: list[str], text_col: str = "text", segment: str | None = None) -> DataFrame:
    """``keys`` (and ``segment``) plus turns array<struct<role, text>> and chat
    string (the canonical form) for every transcript. A null or empty transcript
    has no turns.

    ``segment``: rows are the segments, numbered from 0, of the conversations that
    ``keys`` name; their states are those of the uncut text. A turn that goes on
    over a cut is in both segments' rows. Keys may be null.
    """
    kept = [*keys, segment] if segment else list(keys)
    rows = texts.select(*kept, F.col(text_col).alias("__text"), F.lit(None).cast("int").alias("enter"), F.lit(None).cast("int").alias("leave"))
    if segment:
        long = written(texts.filter(F.col(segment) > 0).select(*[F.col(f"`{k}`").alias(f"__{i}") for i, k in enumerate(keys)]).distinct(), "long-chats")
        same = [texts[k].eqNullSafe(long[f"__{i}"]) for i, k in enumerate(keys)]
        cuts = written(cut_states(texts.join(long, same, "left_semi"), model, keys, segment, text_col), "chat-cuts")
        short = rows.join(long, [rows[k].eqNullSafe(long[f"__{i}"]) for i, k in enumerate(keys)], "left_anti")
        cuts = cuts.select(*[F.col(f"`{k}`").alias(f"__{i}") for i, k in enumerate(kept)], "enter", "leave")
        cut = (texts.join(cuts, [texts[k].eqNullSafe(cuts[f"__{i}"]) for i, k in enumerate(kept)])
               .select(*[texts[k] for k in kept], texts[text_col].alias("__text"), cuts["enter"], cuts["leave"]))
        rows = short.unionByName(cut)
    schema, at = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in kept), len(kept)

    def run(batches):
        import pyarrow as pa
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            turns = [model.turns(*r) for r in zip(*(batch.column(at + i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array([[{"role": r, "text": b} for r, b in x] for x in turns], kind),
                 pa.array([render(x) for x in turns], pa.string())], names=[*kept, "turns", "chat"])

    return rows.select(*kept, "__text", "enter", "leave").mapInArrow(run, f"{schema}, turns array<struct<role:string,text:string>>, chat string")
