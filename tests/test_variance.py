"""Crossed variance components and group-effect R-squared against dense numpy solutions."""

import numpy as np
import pandas as pd
import pytest

from canvass.operators import variance as V


def crossed(seed=5, n=900, va=2.0, vb=0.8):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 14, n), rng.integers(0, 45, n)
    y = 100 + rng.normal(0, np.sqrt(va), 14)[a] + rng.normal(0, np.sqrt(vb), 45)[b] + rng.normal(0, 1.3, n)
    return pd.DataFrame({"a": a, "b": b, "y": y})


def dense_reml(d, theta):
    za, zb = pd.get_dummies(d.a).values.astype(float), pd.get_dummies(d.b).values.astype(float)
    v = np.eye(len(d)) + theta[0] ** 2 * za @ za.T + theta[1] ** 2 * zb @ zb.T
    X, y = np.ones((len(d), 1)), d.y.values
    vi = np.linalg.inv(v)
    xvx = X.T @ vi @ X
    beta = np.linalg.solve(xvx, X.T @ vi @ y)
    u = y - X @ beta
    q = u @ vi @ u
    n = len(d)
    crit = np.linalg.slogdet(v)[1] + np.linalg.slogdet(xvx)[1] + (n - 1) * (1 + np.log(2 * np.pi * q / (n - 1)))
    return crit, q / (n - 1)


def two_way_r2(d):
    X = np.c_[pd.get_dummies(d.a).values.astype(float), pd.get_dummies(d.b).values.astype(float)]
    fit = X @ np.linalg.lstsq(X, d.y.values, rcond=None)[0]
    return 1 - ((d.y - fit) ** 2).sum() / ((d.y - d.y.mean()) ** 2).sum()


def test_reml_is_the_dense_optimum(spark):
    d = crossed()
    df = spark.createDataFrame(d).repartition(4)
    [r] = V.variance_components(df, {"Y": "y"}, "a", "b").collect()
    assert r.estimator == "reml" and r.n == len(d)
    theta = (np.sqrt(r.var_a / r.var_residual), np.sqrt(r.var_b / r.var_residual))
    best, sigma2 = dense_reml(d, theta)
    assert r.var_residual == pytest.approx(sigma2, rel=1e-6)
    for step in (0.98, 1.02):
        assert dense_reml(d, (theta[0] * step, theta[1]))[0] > best
        assert dense_reml(d, (theta[0], theta[1] * step))[0] > best


def test_reml_on_the_boundary(spark):
    d = crossed(seed=11, vb=0.0)
    [r] = V.variance_components(spark.createDataFrame(d), {"Y": "y"}, "b", "a").collect()
    at = (np.sqrt(r.var_b / r.var_residual), np.sqrt(r.var_a / r.var_residual))
    assert r.var_a < 0.1
    assert dense_reml(d, at)[0] <= dense_reml(d, (at[0], at[1] + 0.05))[0]


def test_moments_agree_with_the_simulated_truth(spark):
    d = crossed(n=4000)
    [r] = V.variance_components(spark.createDataFrame(d), {"Y": "y"}, "a", "b", estimator="moments").collect()
    [e] = V.variance_components(spark.createDataFrame(d), {"Y": "y"}, "a", "b").collect()
    assert r.estimator == "moments" and not r.clipped
    for part in ("var_a", "var_b", "var_residual"):
        assert r[part] == pytest.approx(e[part], rel=0.1)


def test_gates(spark):
    d = crossed()
    df = spark.createDataFrame(d)
    assert V.variance_components(df, {"Y": "y"}, "a", "b", min_levels=14).count() == 0
    assert V.variance_components(df, {"Y": "y"}, "a", "b", min_n=901).count() == 0


def test_r2_matches_dense_least_squares(spark):
    d = crossed(n=500)
    df = spark.createDataFrame(d).repartition(3)
    kept = d[d.groupby("a").y.transform("size") >= 5]
    kept = kept[kept.groupby("b").y.transform("size") >= 5]
    for dense in (400, 5):
        [r] = V.fe_r2(df, {"Y": "y"}, "a", "b", dense_levels=dense).collect()
        total = ((kept.y - kept.y.mean()) ** 2).sum()
        one = {f: 1 - ((kept.y - kept.groupby(f).y.transform("mean")) ** 2).sum() / total for f in "ab"}
        assert r.n == len(kept)
        assert r.r2_a == pytest.approx(one["a"]) and r.r2_b == pytest.approx(one["b"])
        assert r.r2_both == pytest.approx(two_way_r2(kept), rel=1e-8)
        assert r.r2_b_given_a == pytest.approx(r.r2_both - r.r2_a)


def test_group_filter_runs_once_or_to_a_fixpoint(spark):
    # dropping level y of b leaves level 1 of a with two rows
    rows = [(1, "x"), (1, "x"), (1, "y"), (2, "x"), (2, "x"), (2, "x")]
    df = spark.createDataFrame(rows, "a int, b string").selectExpr("a", "b", "cast(a as double) as y")
    table = V.cells(df, "y", "a", "b")
    once = V.keep_large_groups(table, 3).groupBy("a").sum("n").collect()
    assert {r.a: r["sum(n)"] for r in once} == {1: 2, 2: 3}
    again = V.keep_large_groups(table, 3, fixpoint=True).groupBy("a").sum("n").collect()
    assert {r.a: r["sum(n)"] for r in again} == {2: 3}


def balanced_optimum(y):
    """REML of one value per cell: mean squares, pooled from below where they are out of order."""
    ka, kb = y.shape
    ssa, ssb = kb * ((y.mean(1) - y.mean()) ** 2).sum(), ka * ((y.mean(0) - y.mean()) ** 2).sum()
    rest = y - y.mean(1, keepdims=True) - y.mean(0, keepdims=True) + y.mean()
    ss, df = (rest**2).sum(), (ka - 1) * (kb - 1)
    for s, k in sorted([(ssa, ka - 1), (ssb, kb - 1)], key=lambda x: x[0] / x[1]):
        if s / k < ss / df:
            ss, df = ss + s, df + k
    e = ss / df
    return max(ssa / (ka - 1) - e, 0) / kb, max(ssb / (kb - 1) - e, 0) / ka, e


@pytest.mark.parametrize("ratio", [1e-8, 1e-4, 1.0, 1e4, 1e8])
@pytest.mark.parametrize("other", [0.0, 1e-2, 1e6])
def test_reml_matches_the_closed_form_at_any_ratio(spark, ratio, other):
    """Ratios of 1e8 and 1e6 to the residual's variance and far below; the criterion must not lose digits."""
    rng = np.random.default_rng(3)
    y = 50 + np.sqrt(ratio) * rng.normal(size=(12, 1)) + np.sqrt(other) * rng.normal(size=(1, 15)) + rng.normal(size=(12, 15))
    want = balanced_optimum(y)
    rows = [(a, b, float(y[a, b])) for a in range(12) for b in range(15)]
    df = spark.createDataFrame(rows, "a int, b int, y double")
    table = V.centre(V.cells(df, "y", "a", "b"))
    small, large, rest, converged = V.reml_components(V.arrange(table, "a", "b", 12))
    assert converged is True
    assert rest == pytest.approx(want[2], rel=1e-6)
    for got, expected in ((small, want[0]), (large, want[1])):
        assert got == pytest.approx(expected, rel=1e-6, abs=1e-7 * want[2])


def test_reml_without_a_residual_is_an_error(spark):
    df = spark.createDataFrame([(a, b, float(a * 3 + b)) for a in range(12) for b in range(12)], "a int, b int, y double")
    with pytest.raises(ValueError, match="exactly"):
        V.variance_components(df, {"Y": "y"}, "a", "b")


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_reml_on_the_given_tables_is_near_the_moments(spark, sf):
    """The estimators differ by sampling error only; the residual's variance is close."""
    from canvass.plans import models

    rows = models.line_rows(spark, f"/root/testdata/sf{sf}")
    found = {e: V.variance_components(rows, {"Mixed": "mixed"}, "price_group", "supplier", estimator=e).first() for e in ("reml", "moments")}
    assert found["reml"].converged
    for part in ("var_a", "var_b", "var_residual"):
        assert found["reml"][part] == pytest.approx(found["moments"][part], rel=0.25)
