"""The many-column solver against dense numpy on small tables."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsift.operators import cells as CE

SCHEMA = "label string, pairs array<struct<ix:int,w:double>>, cells array<int>, held array<int>"


def table(spark, n=120, d=15, seed=1, cells=3):
    """Rows, a dense copy, labels, and the membership of each row."""
    rnd = np.random.default_rng(seed)
    x = np.where(rnd.random((n, d)) < 0.3, rnd.standard_normal((n, d)), 0.0)
    x[:, 0] *= 40  # a badly scaled feature
    x[5] = 0       # an empty row
    y = np.where(x[:, 1] - x[:, 2] + 0.7 * rnd.standard_normal(n) > 0.2, 1, -1)
    member = rnd.random((n, cells)) < [0.3, 0.6, 0.9][:cells]
    rows = [("phishing" if y[i] > 0 else "legitimate", [(int(j), float(x[i, j])) for j in np.flatnonzero(x[i])],
             [int(c) for c in np.flatnonzero(member[i])], [int(c) for c in np.flatnonzero(~member[i])]) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return CE.cell_table(df, d, cells="cells", held="held"), x, y, member


def dense_objective(x, y, weight, loss, w, b):
    value = CE._loss_terms(loss, y * (x @ w + b))[0]
    return float((weight * value).sum() + 0.5 * w @ w + (0.5 * b * b if loss == CE.SQUARED_HINGE else 0.0))


def dense_solution(x, y, weight, loss):
    """Newton with a dense Hessian and step halving."""
    a = np.c_[x, np.ones(len(x))]
    penalty = np.r_[np.ones(x.shape[1]), float(loss == CE.SQUARED_HINGE)]
    p = np.zeros(a.shape[1])
    value = lambda p: dense_objective(x, y, weight, loss, p[:-1], p[-1])
    for _ in range(200):
        _, slope, curve = CE._loss_terms(loss, y * (a @ p))
        g = a.T @ (weight * slope * y) + penalty * p
        if np.linalg.norm(g) < 1e-10:
            break
        step = np.linalg.solve((a * (weight * curve)[:, None]).T @ a + np.diag(penalty) + 1e-12 * np.eye(len(p)), -g)
        t = 1.0
        while value(p + t * step) > value(p) + 1e-12 and t > 1e-10:
            t /= 2
        p = p + t * step
    return p


@pytest.mark.parametrize("loss,balanced", [(CE.LOGISTIC, True), (CE.LOGISTIC, False), (CE.SQUARED_HINGE, False)])
def test_every_column_reaches_the_dense_optimum(spark, loss, balanced):
    t, x, y, member = table(spark)
    columns = [CE.Column(c, loss, c, balanced) for c in (0, 1, 2)] + [CE.Column("all", loss, None, balanced)]
    for got, rows in zip(CE.fit_columns(t, columns, 1e-7), [*member.T, np.ones(len(y), bool)]):
        n = [(y[rows] == k).sum() for k in (-1, 1)]
        weight = np.where(y > 0, rows.sum() / (2 * n[1]), rows.sum() / (2 * n[0])) if balanced else np.ones(len(y))
        weight = weight * rows
        best = dense_solution(x, y, weight, loss)
        mine = dense_objective(x, y, weight, loss, got.coef, got.intercept)
        assert mine <= dense_objective(x, y, weight, loss, best[:-1], best[-1]) * (1 + 1e-8) + 1e-8
        assert got.objective == pytest.approx(mine)
        start = np.linalg.norm(np.c_[x, np.ones(len(x))].T @ (weight * CE._loss_terms(loss, np.zeros(len(y)))[1] * y))
        assert got.gradient_norm <= 1e-7 * start
        assert np.abs(got.coef - best[:-1]).max() < 1e-3


def test_naive_bayes_columns_in_one_pass(spark):
    t, x, y, member = table(spark)
    t.df = t.df.withColumn("w", F.transform("w", lambda v: F.abs(v)))
    for c, got in enumerate(CE.fit_columns(t, [CE.Column(c, CE.NAIVE_BAYES, c) for c in range(3)])):
        rows = member[:, c]
        logs = [np.log((np.abs(x[rows & (y == k)]).sum(0) + 1) / (np.abs(x[rows & (y == k)]).sum() + x.shape[1])) for k in (-1, 1)]
        assert np.allclose(got.coef, logs[1] - logs[0])
        assert got.intercept == pytest.approx(np.log((y[rows] > 0).sum() / (y[rows] < 0).sum()))


def test_confusions_of_all_columns(spark):
    t, x, y, member = table(spark)
    fitted = CE.fit_columns(t, [CE.Column(c, CE.SQUARED_HINGE, c) for c in range(3)] + [CE.Column("all", CE.LOGISTIC)])
    got = {(r["column"], r["kind"], r["actual"], r["predicted"]): r["count"] for r in CE.cell_confusions(t, fitted).collect()}
    want = {}
    for k, f in enumerate(fitted):
        said = x @ f.coef + f.intercept > 0
        for kind, rows in ((("train", member[:, k]), ("validation", ~member[:, k])) if k < 3 else (("train", np.ones(len(y), bool)),)):
            for i in np.flatnonzero(rows):
                key = (k, kind, "phishing" if y[i] > 0 else "legitimate", "phishing" if said[i] else "legitimate")
                want[key] = want.get(key, 0) + 1
    assert got == want


def test_blocks_slices_and_sums_by_tasks(spark, monkeypatch):
    t, *_ = table(spark)
    whole = CE.fit_columns(t, [CE.Column(1, CE.LOGISTIC, 1)])[0]
    monkeypatch.setattr(CE, "DIRECT_BYTES", 0)  # the driver's side: parts are summed by tasks
    again = CE.fit_columns(t, [CE.Column(1, CE.LOGISTIC, 1)])[0]
    assert np.allclose(whole.coef, again.coef, atol=1e-9)


def test_slices_cover_the_batch():
    import pyarrow as pa
    lists = [[0] * n for n in (3, 0, 900, 1, 1, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32()))], names=["ix"])
    for columns in (1, CE.HELD // 4, CE.HELD):
        assert [r for s in CE._slices(batch, columns) for r in s.column("ix").to_pylist()] == lists


def test_an_empty_table_has_no_optimum_but_zero(spark):
    t = CE.cell_table(spark.createDataFrame([], SCHEMA), 4)
    got = CE.fit_columns(t, [CE.Column("all", CE.SQUARED_HINGE)])[0]
    assert not got.coef.any() and got.intercept == 0


def test_a_long_table_has_no_more_tasks_than_cores(spark):
    rows = spark.range(0, 64, 1, 64).selectExpr("CAST(id % 2 * 2 - 1 AS int) AS y", "array(CAST(id % 3 AS int)) AS ix", "array(1.0D) AS w",
                                                "array(CAST(id % 2 AS int)) AS cells", "CAST(array() AS array<int>) AS held")
    table = CE.CellTable(rows, 3)
    assert table.tasks == table.df.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert table.counts == {(None, -1): 32, (None, 1): 32, (0, -1): 32, (1, 1): 32}


def test_packed_rows_are_the_rows(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(CE, "PACK", CE.HELD // 10)  # some 10 numbers a stored row, some 30 worked on together
    monkeypatch.setattr(CE, "WORK", CE.HELD // 30)
    rows = [{"y": 1 if i % 3 else -1, "ix": list(range(i % 7)), "w": [i + 0.5 * k for k in range(i % 7)], "cells": list(range(i % 4)), "held": [i] * (i % 2)}
            for i in range(60)]
    kinds = pa.schema([("y", pa.int32()), ("ix", pa.list_(pa.int32())), ("w", pa.list_(pa.float64())), ("cells", pa.list_(pa.int32())), ("held", pa.list_(pa.int32()))])
    packed = list(CE._pack([pa.RecordBatch.from_pylist(rows, kinds), pa.RecordBatch.from_pylist([], kinds)]))
    assert packed[0].num_rows > 10 and packed[1].num_rows == 0
    again = [r for b in CE._unpack([*packed, packed[0].slice(3, 4)]) for r in b.to_pylist()]
    assert again[:60] == sorted(rows, key=lambda r: r["cells"]) and 0 < len(again) - 60 < 60
    assert len(list(CE._unpacked(packed))) > 3


def test_passes_read_packed_rows(spark):
    t, x, y, member = table(spark)
    assert {f.dataType.simpleString() for f in t.stored.schema.fields} == {"binary"}
    rows = sorted(((r["y"], r["ix"], r["w"], r["cells"], r["held"]) for r in t.df.collect()), key=str)
    want = [(int(y[i]), [int(j) for j in np.flatnonzero(x[i])], [float(v) for v in x[i][x[i] != 0]],
             [int(c) for c in np.flatnonzero(member[i])], [int(c) for c in np.flatnonzero(~member[i])]) for i in range(len(y))]
    assert rows == sorted(want, key=str)
    assert t.counts == {(c, k): n for k in (-1, 1) for c, n in [(None, int((y == k).sum())), *((c, int((member[:, c] & (y == k)).sum())) for c in range(3))]}
    columns = [CE.Column(c, loss, c) for c in range(3) for loss in (CE.LOGISTIC, CE.SQUARED_HINGE)]
    plain = CE.CellTable(t.df, t.n_features)
    for a, b in zip(CE.fit_columns(t, columns, 1e-7), CE.fit_columns(plain, columns, 1e-7)):
        assert np.allclose(a.coef, b.coef, atol=1e-5)
