"""Many linear classifiers over one feature table, fitted together.

A *cell* is a training set: a fold and size of a learning curve, a stage of a
corpus, a preset, or simply the whole table. Every row lists the cells it
trains and the cells it is held out for, so the rows are stored once however
many cells they are in. A *column* is a model: a cell, a loss and class weights.

Naive Bayes takes one pass: the class sums of all columns together. Logistic
regression and the squared-hinge machine are solved by Newton steps, their
systems by conjugate gradients on Hessian-vector products with the Hessian's
diagonal as preconditioner. Each column's solver is a coroutine that asks for a
gradient at a point or for a product with a direction; one Spark job answers the
requests of all columns, whichever step they are at. So a study of fifty models
takes as many jobs as its slowest model, not the sum.

The table is stored packed: the numbers of some hundred rows in one row of binary
columns, so that a pass reads them as arrays instead of turning each number into
a value of a row and back. Rows of a batch with the same cells are stored together.

A task sums its rows' parts in numpy and sends one vector per request and
feature block; blocks are added up as streams. The driver holds the columns'
coefficients, whose size is columns x features.

Objective of a column, as in the original's libraries (C = 1):
    sum_i weight_i * loss(y_i * margin_i) + |w|^2 / 2  (+ intercept^2 / 2 for squared hinge)
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import LEGITIMATE, PHISHING
from ..session import materialise

LOGISTIC, SQUARED_HINGE, NAIVE_BAYES = "logistic", "squared hinge", "naive Bayes"
#: Features of a block that travels as one row.
BLOCK = 16_384
#: Values that a task holds at once: so many for each non-zero of a slice, one model after the other.
HELD, PARTS = 2_000_000, 4
#: Parts of HELD that are one stored row (some 200 KB), and that are worked on together (they fit the processor's cache).
PACK, WORK = 125, 16
#: Parts up to this size together are added up by the driver, larger ones by tasks.
DIRECT_BYTES = 64 << 20
TOLERANCE, MAX_NEWTON, MAX_PRODUCTS = 1e-4, 60, 200


@dataclass(frozen=True)
class Column:
    """A model to fit: rows of ``cell`` (None: every row), the loss, weights by
    class; ``features``: how many of the table's features this cell's rows use."""
    name: object
    loss: str
    cell: int | None = None
    balanced: bool = False
    alpha: float = 1.0
    features: int | None = None


@dataclass
class Fitted:
    column: Column
    coef: np.ndarray
    intercept: float
    gradient_norm: float = 0.0
    objective: float = 0.0
    requests: int = 0
    extra: dict = field(default_factory=dict)


@dataclass
class CellTable:
    """The features: y (1 phishing, -1 legitimate), ix, w, cells, held. ``packed``:
    the stored table that ``df`` is a view of, read in its place."""
    df: DataFrame
    n_features: int
    packed: DataFrame | None = None

    def __post_init__(self):
        # every task sends its sums for every request, so there are no more tasks than cores, however long the table
        self.tasks = min(self.df.rdd.getNumPartitions(), self.df.sparkSession.sparkContext.defaultParallelism)
        self.df = self._view = self.df.coalesce(self.tasks)
        if self.packed is not None:
            self.packed = self.packed.coalesce(self.tasks)

        def run(batches):
            import pyarrow as pa
            found: dict = {}
            for rows, cells, _ in _parts(batches):
                for sign in (-1, 1):
                    own = rows.y == sign
                    listed, n = np.unique(cells.values[np.repeat(own, cells.sizes)], return_counts=True)
                    for cell, count in [(None, int(own.sum())), *zip(listed.tolist(), n.tolist())]:
                        found[cell, sign] = found.get((cell, sign), 0) + count
            yield pa.RecordBatch.from_pylist([{"cell": c, "y": y, "n": n} for (c, y), n in found.items()],
                                             pa.schema([("cell", pa.int32()), ("y", pa.int32()), ("n", pa.int64())]))

        counts = self.stored.mapInArrow(run, "cell int, y int, n long").groupBy("cell", "y").agg(F.sum("n").alias("count")).filter("count > 0").collect()
        self.counts = {(r["cell"], r["y"]): r["count"] for r in counts}  # two rows a cell

    @property
    def stored(self) -> DataFrame:
        """What a pass reads: the packed table, unless ``df`` was replaced."""
        return self.packed if self.packed is not None and self.df is self._view else self.df


def cell_table(feats: DataFrame, n_features: int, label: str = "label", pairs: str = "pairs", cells: str | None = None,
               held: str | None = None) -> CellTable:
    """Writes ``feats`` (label, pairs, and arrays of cell numbers) for fitting, so
    that the passes of the solver don't repeat, or ship, what made the features."""
    numbers = lambda c: (F.coalesce(F.col(c), F.array().cast("array<int>")) if c else F.array().cast("array<int>"))
    rows = feats.select(F.when(F.col(label) == PHISHING, 1).otherwise(-1).cast("int").alias("y"), F.transform(pairs, lambda p: p["ix"]).alias("ix"),
                        F.transform(pairs, lambda p: p["w"]).alias("w"), numbers(cells).cast("array<int>").alias("cells"),
                        numbers(held).cast("array<int>").alias("held"))
    # a job runs over this table for every request round, so it is spread over all cores at least
    parts = max(rows.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism)
    packed = rows.repartition(parts).mapInArrow(_pack, ", ".join(f"{name} binary" for name in _PACKED))
    packed = materialise(packed, "cells", compression="uncompressed")  # read hundreds of times, and compressed it is no more than a fifth smaller
    return CellTable(packed.mapInArrow(_unpack, rows.schema), n_features, packed)


# ------------------------------------------------------------ inside a task

class _Rows:
    """Compressed sparse rows: signs, features, values, non-zeros of each row."""

    def __init__(self, y: np.ndarray, ix: np.ndarray, x: np.ndarray, counts: np.ndarray):
        self.y, self.ix, self.x, self.counts = y, ix, x, counts
        self.starts = np.r_[0, np.cumsum(counts)[:-1]]

    @classmethod
    def of(cls, batch) -> _Rows:
        """A slice of a batch."""
        ix, w = _Lists.of(batch.column("ix")), _Lists.of(batch.column("w"))
        return cls(batch.column("y").to_numpy().astype(np.float64), ix.values.astype(np.int64), w.values.astype(np.float64), ix.sizes)

    def where(self, chosen: np.ndarray) -> _Rows:
        """The chosen ones."""
        if chosen.all():
            return self
        kept = np.repeat(chosen, self.counts)
        return _Rows(self.y[chosen], self.ix[kept], self.x[kept], self.counts[chosen])

    def margins(self, matrix: np.ndarray) -> np.ndarray:
        """rows x columns; ``matrix``: columns x (features + 1), the intercept last."""
        out = np.zeros((len(self.y), len(matrix)))
        full = self.counts > 0
        if full.any():
            products, starts = np.empty(len(self.ix)), self.starts[full]
            for k, column in enumerate(matrix):  # one at a time: it stays in the processor's cache
                np.take(column, self.ix, out=products, mode="clip")  # all are within; the default makes a copy of ``out``
                products *= self.x
                out[full, k] = np.add.reduceat(products, starts)
        return out + matrix[:, -1]

    def add_to(self, total: np.ndarray, values: np.ndarray, squared: bool = False) -> None:
        """total[:, :-1] += values^T X (or X squared), total[:, -1] += column sums."""
        if len(self.ix):
            x = self.x * self.x if squared else self.x
            for k, column in enumerate(values.T):
                if column.any():  # else no row of this slice is in the cell
                    total[k, :-1] += np.bincount(self.ix, np.repeat(column, self.counts) * x, total.shape[1] - 1)
        total[:, -1] += values.sum(axis=0)


@dataclass
class _Lists:
    """A list of numbers for each row."""
    values: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, column) -> _Lists:
        starts = np.asarray(column.offsets)
        return cls(np.asarray(column.values)[starts[0]:starts[-1]] if len(column) else np.zeros(0, np.int32), np.diff(starts))


def _membership(lists: _Lists, numbers: list) -> np.ndarray:
    """rows x len(numbers): whether the row lists the cell (None: every row does)."""
    row = np.repeat(np.arange(len(lists.sizes)), lists.sizes)
    out = np.zeros((len(lists.sizes), len(numbers)))
    for k, number in enumerate(numbers):
        if number is None:
            out[:, k] = 1
        else:
            out[row[lists.values == number], k] = 1
    return out


def _slices(batch, columns: int):
    """The batch in slices whose non-zeros times columns fit HELD."""
    ends = np.asarray(batch.column("ix").offsets).astype(np.int64)
    begin, limit = 0, max(1, HELD // max(columns, 1))
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + limit, side="right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


#: The columns of a packed table and the numbers in them: of the rows, of their lists, and the lists' sizes.
_PACKED = {"y": np.int32, "ix": np.int32, "w": np.float64, "sizes": np.int32, "cells": np.int32, "cell_sizes": np.int32, "held": np.int32, "held_sizes": np.int32}


def _pack(batches):
    """Rows -> packed rows; those of a batch that list the same cells are together."""
    import pyarrow as pa
    for batch in batches:
        cells = batch.column("cells").to_pylist()
        batch = batch.take(pa.array(sorted(range(len(cells)), key=cells.__getitem__), pa.int64()))
        packed = []
        for part in _slices(batch, PACK):
            ix, w, cells, held = (_Lists.of(part.column(name)) for name in ("ix", "w", "cells", "held"))
            packed.append((part.column("y").to_numpy(), ix.values, w.values, ix.sizes, cells.values, cells.sizes, held.values, held.sizes))
        cols = list(zip(*packed)) or [()] * len(_PACKED)
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v, kind).tobytes() for v in c], pa.binary())
                                          for c, kind in zip(cols, _PACKED.values())], names=[*_PACKED])


def _unpacked(batches):
    """The arrays of packed rows, by name, so many rows at once that their numbers are worked on together.
    The values of a binary column follow each other, so several rows are one array without a copy."""
    import pyarrow as pa
    for batch in batches:
        flat, ends = {}, {}
        for name, kind in _PACKED.items():
            column = batch.column(name)
            offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)
            flat[name] = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            ends[name] = offsets[column.offset:][:batch.num_rows + 1].astype(np.int64)
        begin, limit = 0, HELD // WORK * np.dtype(_PACKED["ix"]).itemsize
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(ends["ix"], ends["ix"][begin] + limit, side="right")) - 1)
            end = min(end, batch.num_rows)
            yield {name: flat[name][ends[name][begin]:ends[name][end]].view(kind) for name, kind in _PACKED.items()}
            begin = end


def _unpack(batches):
    """Packed rows -> rows."""
    import pyarrow as pa
    for part in _unpacked(batches):
        lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(part[sizes])], pa.int32()), pa.array(part[name]))
                 for name, sizes in (("ix", "sizes"), ("w", "sizes"), ("cells", "cell_sizes"), ("held", "held_sizes"))]
        yield pa.RecordBatch.from_arrays([pa.array(part["y"]), *lists], names=["y", "ix", "w", "cells", "held"])


def _parts(batches):
    """(rows, their cells, the cells they are held out for) of a table, packed or not, some at a time."""
    for batch in batches:
        if "sizes" in batch.schema.names:
            for p in _unpacked([batch]):
                yield (_Rows(p["y"].astype(np.float64), p["ix"].astype(np.int64), p["w"], p["sizes"].astype(np.int64)),
                       _Lists(p["cells"], p["cell_sizes"]), _Lists(p["held"], p["held_sizes"]))
        else:
            for part in _slices(batch, PARTS):
                yield _Rows.of(part), _Lists.of(part.column("cells")), _Lists.of(part.column("held"))


def _loss_terms(loss: str, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of y * margin, its slope and its curvature."""
    if loss == LOGISTIC:
        p = 1.0 / (1.0 + np.exp(np.clip(z, -500, 500)))  # of the wrong class
        return np.logaddexp(0, -z), -p, p * (1 - p)
    gap = np.maximum(0, 1 - z)
    return gap * gap, -2 * gap, 2.0 * (gap > 0)


def _blocks(slot: int, values: np.ndarray):
    for at in range(0, len(values), BLOCK):
        yield slot, at // BLOCK, np.ascontiguousarray(values[at:at + BLOCK]).tobytes()


_PARTS = "slot int, block int, part binary"


def _as_batch(rows: list):
    import pyarrow as pa
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())],
                                      names=["slot", "block", "part"])


def _add_parts(batches):
    """Rows sorted by (slot, block) -> one row each, their parts summed."""
    key, total = None, None
    for batch in batches:
        done = []
        for slot, block, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
            values = np.frombuffer(part)
            if (slot, block) == key:
                total = total + values
            else:
                if key is not None:
                    done.append((*key, total.tobytes()))
                key, total = (slot, block), values
        yield _as_batch(done)
    if key is not None:
        yield _as_batch([(*key, total.tobytes())])


def _summed(table: CellTable, slots: int, width: int, run: Callable) -> np.ndarray:
    """The slots x width sums over all tasks of what ``run`` yields."""
    parts = table.stored.mapInArrow(run, _PARTS)
    if table.tasks * slots * width * 8 > DIRECT_BYTES:
        parts = parts.repartition("slot", "block").sortWithinPartitions("slot", "block").mapInArrow(_add_parts, _PARTS)
    out = np.zeros((slots, width))
    for r in parts.collect():
        values = np.frombuffer(r["part"])
        out[r["slot"], r["block"] * BLOCK:r["block"] * BLOCK + len(values)] += values
    return out


# ------------------------------------------------------------ the solver

def newton(n_features: int, penalise_intercept: bool, tolerance: float) -> Generator:
    """Asks ("gradient", point) -> (loss, gradient, Hessian diagonal) and
    ("product", point, direction) -> Hessian times direction, data parts only.
    Returns (point, gradient norm, objective)."""
    penalty = np.ones(n_features + 1)
    penalty[-1] = float(penalise_intercept)

    def whole(point, loss, gradient, diagonal):
        return loss + 0.5 * float(penalty @ (point * point)), gradient + penalty * point, diagonal + penalty

    point = np.zeros(n_features + 1)
    f, g, h = whole(point, *(yield "gradient", point))
    start = np.linalg.norm(g)
    for _ in range(MAX_NEWTON):
        norm = np.linalg.norm(g)
        if norm <= tolerance * start or start == 0:
            break
        scale = 1.0 / np.maximum(h, 1e-12)
        step, r = np.zeros_like(g), -g
        z = scale * r
        p, rz = z, float(r @ z)
        goal = min(0.1, math.sqrt(norm / start)) * norm
        for _ in range(MAX_PRODUCTS):
            hp = (yield "product", point, p) + penalty * p
            curve = float(p @ hp)
            if curve <= 0:
                step = step if step.any() else p
                break
            a = rz / curve
            step, r = step + a * p, r - a * hp
            if np.linalg.norm(r) <= goal:
                break
            z = scale * r
            rz, before = float(r @ z), rz
            p = z + rz / before * p
        slope, length = float(g @ step), 1.0
        while True:
            trial = point + length * step
            f2, g2, h2 = whole(trial, *(yield "gradient", trial))
            if f2 <= f + 1e-4 * length * slope:
                point, f, g, h = trial, f2, g2, h2
                break
            length /= 2
            if length < 1e-9:
                return point, float(np.linalg.norm(g)), f  # no descent is left at this precision
    return point, float(np.linalg.norm(g)), f


def _weights(table: CellTable, c: Column) -> tuple[float, float]:
    """(of legitimate rows, of phishing rows): 1, or balanced n / (2 * n_class)."""
    if not c.balanced:
        return 1.0, 1.0
    n = [table.counts.get((c.cell, y), 0) for y in (-1, 1)]
    classes = sum(x > 0 for x in n)
    return tuple(sum(n) / (classes * x) if x else 0.0 for x in n)  # type: ignore[return-value]


def _answer(table: CellTable, columns: Sequence[Column], requests: list[tuple[int, tuple]]) -> list:
    """One job for all ``requests`` (column number, request)."""
    d = table.n_features
    asked = [(columns[k].loss, columns[k].cell, _weights(table, columns[k]), r[0] == "gradient") for k, r in requests]
    points = np.stack([r[1] for _, r in requests])
    ways = np.stack([r[2] if r[0] == "product" else np.zeros(d + 1) for _, r in requests])
    sent = table.df.sparkSession.sparkContext.broadcast((points, ways))  # columns x features
    cells = sorted({a[1] for a in asked}, key=lambda c: (c is not None, c or 0))
    n = len(requests)
    of_cell = [[k for k, a in enumerate(asked) if a[1] == c] for c in cells]

    def run(batches):
        points, ways = sent.value
        first, second = np.zeros((n, d + 1)), np.zeros((n, d + 1))  # gradients or products; diagonals
        loss = np.zeros(n)
        for rows, listed, _ in _parts(batches):
            member = _membership(listed, cells) > 0
            for c, numbers in enumerate(of_cell):
                if not member[:, c].any():
                    continue
                own = rows.where(member[:, c])  # a cell's models see its rows only
                for k in numbers:
                    kind, _, weights, gradient = asked[k]
                    weight = np.where(own.y > 0, weights[1], weights[0])
                    value, slope, curve = _loss_terms(kind, own.margins(points[k:k + 1])[:, 0] * own.y)
                    if gradient:
                        loss[k] += value @ weight
                        own.add_to(first[k:k + 1], (slope * weight * own.y)[:, None])
                        own.add_to(second[k:k + 1], (curve * weight)[:, None], squared=True)
                    else:
                        own.add_to(first[k:k + 1], (curve * weight * own.margins(ways[k:k + 1])[:, 0])[:, None])
        out = []
        for k in range(n):
            out += _blocks(k, np.r_[first[k], loss[k], second[k]] if asked[k][3] else first[k])
        yield _as_batch(out)

    total = _summed(table, n, 2 * d + 3, run)
    sent.unpersist()
    answers = []
    for k in range(n):
        row = total[k]
        answers.append((float(row[d + 1]), row[:d + 1].copy(), row[d + 2:].copy()) if asked[k][3] else row[:d + 1].copy())
    return answers


def _naive_bayes(table: CellTable, columns: list[Column]) -> list[Fitted]:
    """All columns' class sums in one pass; the closed form on the driver."""
    d, n = table.n_features, len(columns)
    cells = [c.cell for c in columns]

    def run(batches):
        sums = np.zeros((2 * n, d + 1))
        for rows, listed, _ in _parts(batches):
            member = _membership(listed, cells)
            rows.add_to(sums, np.hstack([member * (rows.y < 0)[:, None], member * (rows.y > 0)[:, None]]))
        yield _as_batch([b for k in range(2 * n) for b in _blocks(k, sums[k])])

    sums = _summed(table, 2 * n, d + 1, run)
    out = []
    for k, c in enumerate(columns):
        legit, phish = sums[k], sums[n + k]
        if not (legit[-1] and phish[-1]):  # one class only: it has no odds, and nothing is called phishing
            out.append(Fitted(c, np.zeros(d), -math.inf))
            continue
        size = d if c.features is None else c.features
        logs = [np.log((s[:size] + c.alpha) / (s[:-1].sum() + c.alpha * size)) for s in (legit, phish)]
        out.append(Fitted(c, np.r_[logs[1] - logs[0], np.zeros(d - size)], math.log(phish[-1]) - math.log(legit[-1]),
                          extra={"feature_log_prob": {LEGITIMATE: logs[0].tolist(), PHISHING: logs[1].tolist()},
                                 "class_count": {LEGITIMATE: int(legit[-1]), PHISHING: int(phish[-1])}}))
    return out


def fit_columns(table: CellTable, columns: Sequence[Column], tolerance: float = TOLERANCE) -> list[Fitted]:
    """The fitted columns, in their order. A column converges when its gradient's
    norm is ``tolerance`` times the one at zero."""
    out: dict[int, Fitted] = {}
    bayes = [k for k, c in enumerate(columns) if c.loss == NAIVE_BAYES]
    if bayes:
        out.update(zip(bayes, _naive_bayes(table, [columns[k] for k in bayes])))
    solvers = {k: newton(table.n_features, c.loss == SQUARED_HINGE, tolerance) for k, c in enumerate(columns) if k not in out}
    waiting, asked = {k: next(s) for k, s in solvers.items()}, dict.fromkeys(solvers, 0)
    while waiting:
        requests = list(waiting.items())
        for (k, _), answer in zip(requests, _answer(table, columns, requests)):
            asked[k] += 1
            try:
                waiting[k] = solvers[k].send(answer)
            except StopIteration as end:
                del waiting[k]
                point, norm, objective = end.value
                out[k] = Fitted(columns[k], point[:-1], float(point[-1]), norm, objective, asked[k])
    return [out[k] for k in range(len(columns))]


# ------------------------------------------------------------ scoring

def cell_confusions(table: CellTable, fitted: Sequence[Fitted], everything: str = "train") -> DataFrame:
    """(column int, kind, actual, predicted, count): each column's predictions on
    the rows that train its cell ('train') and on those held out for it
    ('validation'), counted in one map pass and a sum of a few rows a task.
    Columns without a cell judge all rows under ``everything``."""
    spark = table.df.sparkSession
    matrix = np.stack([np.r_[f.coef, f.intercept] for f in fitted])
    sent = spark.sparkContext.broadcast(matrix)  # columns x features
    cells, d = [f.column.cell for f in fitted], table.n_features

    def run(batches):
        import pyarrow as pa
        counts = np.zeros((len(cells), 2, 2, 2), np.int64)  # column, kind, actual, predicted
        for rows, *lists in _parts(batches):
            said = rows.margins(sent.value) > 0
            for kind, listed in enumerate(lists):
                member = _membership(listed, [-1 if c is None and kind else c for c in cells]) > 0
                for actual in (0, 1):
                    here = member & ((rows.y > 0) == bool(actual))[:, None]
                    counts[:, kind, actual, 1] += (here & said).sum(axis=0)
                    counts[:, kind, actual, 0] += (here & ~said).sum(axis=0)
        at = np.argwhere(counts > 0)
        label = [LEGITIMATE, PHISHING]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[:, 0], pa.int32()), pa.array([everything if cells[c] is None else ("train", "validation")[k] for c, k in at[:, :2]], pa.string()),
             pa.array([label[a] for a in at[:, 2]], pa.string()), pa.array([label[p] for p in at[:, 3]], pa.string()),
             pa.array(counts[tuple(at.T)], pa.int64())], names=["column", "kind", "actual", "predicted", "count"])

    parts = table.stored.mapInArrow(run, "column int, kind string, actual string, predicted string, count long")
    return parts.groupBy("column", "kind", "actual", "predicted").agg(F.sum("count").alias("count"))
