"""The linear-time Gaussian process against dense matrices, and the logistic fit against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronocohort.operators import models as M


@pytest.fixture(scope="module")
def case():
    rng = np.random.default_rng(5)
    n = 3
    a, b = rng.normal(size=(n, n)), rng.normal(size=(n, n))
    params = {"fast": (a @ a.T).tolist(), "slow": (b @ b.T).tolist(), "noise": [0.1, 0.2, 0.3], "fast_length": 0.5, "slow_length": 10.0}
    t = np.round(rng.uniform(0, 30, 300), 1)  # several readings share a time
    v, y, grid = rng.integers(0, n, len(t)), rng.normal(size=len(t)), np.arange(0.0, 33.0)

    def k(p, q, pv, qv):
        gap = np.abs(p[:, None] - q)
        return np.array(params["fast"])[pv][:, qv] * np.exp(-gap / 0.5) + np.array(params["slow"])[pv][:, qv] * np.exp(-gap / 10)

    gt, gv = np.repeat(grid, n), np.tile(np.arange(n), len(grid))
    prior, cross = k(t, t, v, v) + np.diag(np.array(params["noise"])[v] + 0.001), k(gt, t, gv, v)
    return params, t, v, y, grid, cross @ np.linalg.solve(prior, y), k(gt, gt, gv, gv) - cross @ np.linalg.solve(prior, cross.T)


def test_marginals_equal_dense(spark, case, monkeypatch):
    params, t, v, y, grid, mean, cov = case
    monkeypatch.setattr(M, "SEGMENT", 16)
    m, var, _ = M._process(params, 0.001)(t, v, y, grid, 0, np.random.default_rng(0))
    assert np.abs(m.ravel() - mean).max() < 1e-8 and np.abs(var.ravel() - np.diag(cov)).max() < 1e-8
    long = spark.createDataFrame([(1, float(a), int(b), float(c)) for a, b, c in zip(t, v, y)] + [(1, None, 0, 1.0), (None, 1.0, 0, 1.0), (2, 1.0, 0, None)], "e int, t double, v int, y double")
    hours = spark.createDataFrame([(e, int(g)) for e in (1, 2) for g in grid], "e int, g int")
    got = M.gp_marginals(long, hours, "e", "t", "v", "y", "g", params).orderBy("t", "var_id").collect()
    assert {r["e"] for r in got} == {1}
    assert [r["mean"] for r in got] == pytest.approx(list(mean), abs=1e-8)
    assert [r["variance"] for r in got] == pytest.approx(list(np.diag(cov)), abs=1e-8)


def test_draws_are_joint_and_repeat(case):
    params, t, v, y, grid, mean, cov = case
    draw = lambda seed: M._process(params, 0.001)(t, v, y, grid, 20000, np.random.default_rng(seed))[2].reshape(20000, -1)
    one = draw(3)
    scale = np.abs(cov).max()
    assert np.abs(one.mean(axis=0) - mean).max() < 5 * np.sqrt(scale / 20000)
    assert np.abs(np.cov(one.T) - cov).max() < 7 * scale / np.sqrt(20000)
    assert np.array_equal(one, draw(3)) and not np.array_equal(one, draw(4))


def test_without_readings_of_a_feature_and_outside_the_series(case):
    params, t, v, y, grid, *_ = case
    only = v == 0
    m, var, _ = M._process(params, 0.001)(t[only] + 100, v[only], y[only], np.array([0.0, 5000.0]), 0, np.random.default_rng(0))
    stationary = np.diag(np.array(params["fast"]) + np.array(params["slow"]))
    assert np.abs(m[1]).max() < 1e-8 and var[1] == pytest.approx(stationary, abs=1e-8)
    assert np.abs(m[0]).max() < 1e-3 and np.all(var[0] <= stationary + 1e-9)


def test_a_stay_of_fifty_thousand_hours(spark):
    params = M.starting_params(2, 1)
    long = spark.range(20000).select(F.lit(1).alias("e"), (F.rand(1) * 50000).alias("t"), (F.col("id") % 2).cast("int").alias("v"), F.randn(2).alias("y"))
    hours = spark.range(50000).select(F.lit(1).alias("e"), F.col("id").cast("int").alias("g"))
    out = M.gp_marginals(long, hours, "e", "t", "v", "y", "g", params)
    row = out.agg(F.count("*").alias("n"), F.min("variance").alias("least"), F.max("variance").alias("most")).first()
    assert row["n"] == 100000 and 0 < row["least"] <= row["most"] < 1.1


def test_logistic_fit_equals_newton(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=400), 5 * rng.normal(size=400) + 1, np.full(400, 2.0)])
    y = (x[:, 0] - 0.2 * x[:, 1] + rng.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y)], "x array<double>, y int")
    got = {r["feature"]: r["gradient"] for r in M.logistic_gradient(df, "x", "y").collect()}
    assert set(got) == {-1, 0, 1, 2} and max(map(abs, got.values())) < 1e-6
    design, w = np.column_stack([np.ones(400), x[:, :2]]), np.zeros(3)
    penalty = np.diag([0.0, *(0.01 * x[:, :2].var(axis=0, ddof=1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve(design.T * (p * (1 - p)) @ design / 400 + penalty, design.T @ (p - y) / 400 + penalty @ w)
    scored = M.logistic_baseline(df, df, "x", "y").select("x", "score").collect()
    want = 1 / (1 + np.exp(-(np.column_stack([np.ones(400), [r["x"][:2] for r in scored]]) @ w)))
    assert [r["score"] for r in scored] == pytest.approx(list(want), abs=1e-5)
