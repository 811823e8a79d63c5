"""Regression and bootstrap against row-level refitting in numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from canvass.operators import moments
from canvass.operators.inference import (
    cluster_key,
    WEBB, draw_index, flip_summary, fragile, inference_table, outcome_specs, regress, significance_code, survivors, text_hash, tidy, verdict)
from canvass.operators.moments import Spec


def weight(seed, rep, cluster):
    name = f"{len(str(cluster))}:{cluster}"  # as cluster_key names a cluster of one part
    return WEBB[draw_index(text_hash(seed, "c", name), text_hash(seed, "r", str(rep)))]


def ols(X, y):
    return np.linalg.lstsq(X, y, rcond=None)[0]


def hc1(X, y, params=None):
    b = ols(X, y)
    u = y - X @ b
    inv = np.linalg.inv(X.T @ X)
    n, k = X.shape
    v = n / (n - (params or k)) * inv @ (X.T * u**2) @ X @ inv
    return b, np.sqrt(np.diag(v))


def crv1(X, y, g, params=None):
    b = ols(X, y)
    u = y - X @ b
    inv = np.linalg.inv(X.T @ X)
    n, k = X.shape
    ids = pd.unique(g)
    meat = sum(np.outer(s, s) for s in (X[g == i].T @ u[g == i] for i in ids))
    G = len(ids)
    return np.sqrt(np.diag(G / (G - 1) * (n - 1) / (n - (params or k)) * inv @ meat @ inv))


def boot(X, y, g, j, reps, seed, params=None):
    b = ols(X, y)
    t = b[j] / crv1(X, y, g, params)[j]
    keep = [i for i in range(X.shape[1]) if i != j]
    fitted = X[:, keep] @ ols(X[:, keep], y)
    u = y - fitted
    hits = 0
    for r in range(1, reps + 1):
        w = np.array([weight(seed, r, c) for c in g])
        ys = fitted + w * u
        ts = ols(X, ys)[j] / crv1(X, ys, g, params)[j]
        hits += abs(ts) > abs(t) * (1 + 1e-9)
    return hits / reps


def test_weights_look_like_independent_draws():
    clusters = np.array([text_hash(42, "c", str(i)) for i in range(400)], dtype=np.int64)
    reps = np.array([text_hash(42, "r", str(i)) for i in range(1, 1000)], dtype=np.int64)
    pick = draw_index(clusters[None, :], reps[:, None])
    share = np.bincount(pick.ravel(), minlength=6) / pick.size
    assert np.abs(share - 1 / 6).max() < 5 * np.sqrt(5 / 36 / pick.size)
    w = np.array(WEBB)[pick]
    between_clusters = np.corrcoef(w.T)[np.triu_indices(400, 1)]
    between_reps = np.corrcoef(w)[np.triu_indices(999, 1)]
    for r, n in ((between_clusters, 999), (between_reps, 400)):
        assert abs(r.std() * np.sqrt(n) - 1) < 0.02
        assert np.abs(r).max() < 6 / np.sqrt(n)


def frame(n=600, seed=3):
    rng = np.random.default_rng(seed)
    g = rng.choice(12, n, p=np.r_[[1 / 3], np.full(11, 2 / 33)])
    f = rng.integers(0, 9, n)
    x1 = rng.normal(5e4, 1e3, n) + 300 * g
    x2 = rng.normal(size=n) + 0.3 * f
    y = 1e6 + 0.002 * x1 + 0.5 * x2 + rng.normal(size=12)[g] * 3 + rng.normal(size=n) * (1 + 0.2 * g) + f
    d = pd.DataFrame({"g": g, "f": f, "x1": x1, "x2": x2, "y": y, "const": 1.0, "x3": 2 * x2 + 1})
    d.loc[::17, "x2"] = np.nan
    return d


def test_matches_row_level_fit(spark):
    d = frame()
    df = spark.createDataFrame(d).repartition(5)
    specs = [Spec("one", "y", ("x1",)), Spec("two", "y", ("x2", "x1")), Spec("two b", "y", ("x1", "x2"))]
    got = {r["spec"]: r for r in regress(df, specs, {"g": ["g"]}, reps=99)}
    c = d.dropna()
    for label, rows, xs in [("one", d, ["x1"]), ("two", c, ["x2", "x1"]), ("two b", c, ["x1", "x2"])]:
        z = rows[xs] - rows[xs].mean()
        X, y = np.c_[np.ones(len(rows)), z], (rows.y - rows.y.mean()).values
        b, se = hc1(X, y)
        r = got[label]
        assert r["n_obs"] == len(rows) and r["n_clusters_g"] == 12
        assert r["beta"] == pytest.approx(b[1], rel=1e-8)
        assert r["se_hc1"] == pytest.approx(se[1], rel=1e-8)
        assert r["se_g"] == pytest.approx(crv1(X, y, rows.g.values)[1], rel=1e-8)
        assert r["p_boot_g"] == boot(X, y, rows.g.values, 1, 99, 42)


def test_absorbed_bootstrap_in_pieces(spark, monkeypatch):
    """Split levels, small blocks and several tasks give the p-values of refitting with dummies; two specs at once."""
    from canvass.operators import inference as I

    rng = np.random.default_rng(12)
    n = 400
    f = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 6, n))
    g = rng.integers(0, 15, n)
    x1, x2 = rng.normal(size=n) + f, rng.normal(size=n)
    y = 0.3 * x2 + f + rng.normal(size=n) + rng.normal(size=15)[g]
    df = spark.createDataFrame(pd.DataFrame({"y": y, "x1": x1, "x2": x2, "f": f, "g": g, "h": g % 7})).repartition(4)
    specs = [Spec("a", "y", ("x2", "x1"), fe=("f",)), Spec("b", "x1", ("x2",), fe=("f",))]
    whole = regress(df, specs, {"g": ["g"], "h": ["h"]}, reps=99, seed=7)
    monkeypatch.setattr(I, "LEVEL_CELLS", 2)
    monkeypatch.setattr(I, "BLOCK_NUMBERS", 500)
    monkeypatch.setattr(I, "MOST_PAIRS_PER_TASK", 1000)
    pieces = regress(df, specs, {"g": ["g"], "h": ["h"]}, reps=99, seed=7)
    dummies = np.eye(6)[f]
    for one, other in zip(whole, pieces):
        assert one["p_boot_g"] == other["p_boot_g"] and one["p_boot_h"] == other["p_boot_h"]
    for level, ids in (("g", g), ("h", g % 7)):
        assert whole[0][f"p_boot_{level}"] == pytest.approx(boot(np.c_[x2, x1, dummies], y, ids, 0, 99, 7))
        assert whole[1][f"p_boot_{level}"] == pytest.approx(boot(np.c_[x2, dummies], x1, ids, 0, 99, 7))


def test_absorbed_effect_matches_dummies(spark):
    d = frame(400, 8).dropna()
    df = spark.createDataFrame(d).repartition(3)
    [r] = regress(df, [Spec("fe", "y", ("x2", "x1"), fe=("f",))], {"g": ["g"]}, reps=59, seed=7)
    dummies = pd.get_dummies(d.f).values.astype(float)
    z = (d[["x2", "x1"]] - d[["x2", "x1"]].mean()).values
    X, y = np.c_[z, dummies], (d.y - d.y.mean()).values
    b, se = hc1(X, y)
    assert r["beta"] == pytest.approx(b[0], rel=1e-7)
    assert r["se_hc1"] == pytest.approx(se[0], rel=1e-7)
    assert r["se_g"] == pytest.approx(crv1(X, y, d.g.values)[0], rel=1e-7)
    assert r["p_boot_g"] == boot(X, y, d.g.values, 0, 59, 7)


def test_edge_cases_give_null(spark):
    d = frame()
    df = spark.createDataFrame(d).selectExpr("*", "0 as whole")
    specs = [
        Spec("constant", "y", ("const",)),
        Spec("collinear", "y", ("x2", "x3")),
        Spec("plain", "y", ("x2",)),
        Spec("too small", "y", ("x2",), min_n=10_000),
    ]
    got = {r["spec"]: r for r in regress(df, specs, {"whole": ["whole"]}, reps=9)}
    assert "too small" not in got
    assert got["constant"]["beta"] is None and got["constant"]["se_hc1"] is None
    assert got["collinear"]["beta"] == pytest.approx(got["plain"]["beta"], rel=1e-9)
    assert got["plain"]["se_whole"] is None and got["plain"]["p_boot_whole"] is None


def test_own_cluster_per_row_is_hc1(spark):
    d = frame(200).dropna().reset_index()
    df = spark.createDataFrame(d)
    [r] = regress(df, [Spec("s", "y", ("x2",))], {"row": ["index"]}, bootstrap=[])
    n = len(d)
    assert r["se_row"] / r["se_hc1"] == pytest.approx(np.sqrt((n / (n - 1) * (n - 1) / (n - 2)) / (n / (n - 2))))


def test_p_value_does_not_depend_on_partitioning(spark):
    d = frame(300)
    ps = set()
    for parts in (1, 7):
        df = spark.createDataFrame(d.sample(frac=1, random_state=parts)).repartition(parts)
        [r] = regress(df, [Spec("s", "y", ("x1",))], {"g": ["g"]}, reps=49)
        ps.add(r["p_boot_g"])
    assert len(ps) == 1


def test_missing_cluster_is_its_own_cluster(spark):
    df = spark.sql("select id as x, id * id as y, case when id % 3 = 0 then null else id % 3 end as g from range(30)")
    [r] = regress(df, [Spec("s", "y", ("x",))], {"g": ["g"]}, bootstrap=[])
    assert r["n_clusters_g"] == 3


def test_rows_without_a_cluster_can_be_dropped(spark):
    d = frame(300).dropna().reset_index(drop=True)
    d["h"] = np.where(d.index % 5 == 0, np.nan, d.g % 4)  # a missing part as NaN
    d["name"] = np.where(d.index % 7 == 0, None, d.f.astype(str))  # and as null
    df = spark.createDataFrame(d.astype({"name": object})).repartition(4)
    levels = {"g": ["g"], "both": ["h", "name"]}
    spec = Spec("s", "y", ("x1", "x2"))
    [got] = regress(df, [spec], levels, reps=29, missing_clusters="drop")
    kept = df.where("not isnan(h) and h is not null and name is not null")
    [want] = regress(kept, [spec], levels, reps=29)
    assert 0 < got["n_obs"] == want["n_obs"] < len(d)
    assert got["n_clusters_both"] == want["n_clusters_both"] == d.dropna().groupby(["h", "name"]).ngroups
    for k in ("beta", "se_hc1", "se_g", "se_both"):
        assert got[k] == pytest.approx(want[k], rel=1e-9)
    assert (got["p_boot_g"], got["p_boot_both"]) == (want["p_boot_g"], want["p_boot_both"])
    [level] = regress(df, [spec], levels, bootstrap=[])
    assert level["n_obs"] == len(d) and level["n_clusters_both"] > got["n_clusters_both"]
    with pytest.raises(ValueError):
        regress(df, [spec], levels, missing_clusters="ignore")


def test_each_spec_has_its_own_complete_columns(spark):
    d = frame(300).dropna().reset_index(drop=True)
    d["name"] = np.where(d.index % 7 == 0, None, d.f.astype(str))
    df = spark.createDataFrame(d.astype({"name": object}))
    specs = [Spec("all", "y", ("x1",)), Spec("named", "y", ("x1",), complete=("name",)), Spec("fe", "y", ("x1",), fe=("name",), complete=("name",))]
    got = {r["spec"]: r for r in regress(df, specs, {"g": ["g"]}, bootstrap=[])}
    named = d.dropna()
    assert (got["all"]["n_obs"], got["named"]["n_obs"], got["fe"]["n_obs"]) == (len(d), len(named), len(named))
    X, y = np.c_[named.x1 - named.x1.mean(), np.ones(len(named))], (named.y - named.y.mean()).values
    assert got["named"]["beta"] == pytest.approx(ols(X, y)[0], rel=1e-8)
    assert got["named"]["se_g"] == pytest.approx(crv1(X, y, named.g.values)[0], rel=1e-8)
    within = named[["x1", "y"]] - named.groupby("name")[["x1", "y"]].transform("mean")
    assert got["fe"]["beta"] == pytest.approx((within.x1 * within.y).sum() / (within.x1**2).sum(), rel=1e-8)


def test_no_rows_left_after_dropping(spark):
    df = spark.sql("select id as x, id * id as y, cast(null as string) as g from range(30)")
    assert regress(df, [Spec("s", "y", ("x",))], {"g": ["g"]}, bootstrap=[], missing_clusters="drop") == []


def test_nested_effect_counts_as_one_parameter(spark):
    d = frame(400, 8).dropna()
    d["f"] = d.g * 3 + d.f % 3  # within g; not within h
    d["h"] = np.arange(len(d)) % 10
    df = spark.createDataFrame(d).repartition(3)
    spec = Spec("fe", "y", ("x2", "x1"), fe=("f",))
    dummies = pd.get_dummies(d.f).values.astype(float)
    X, y = np.c_[(d[["x2", "x1"]] - d[["x2", "x1"]].mean()).values, dummies], (d.y - d.y.mean()).values
    every = X.shape[1]
    params = {"nested": (3, every), "all": (every, every), "none": (3, 3)}
    for mode, (in_g, in_h) in params.items():
        [r] = regress(df, [spec], {"g": ["g"], "h": ["h"]}, bootstrap=[], fe_dof=mode)
        assert r["se_g"] == pytest.approx(crv1(X, y, d.g.values, in_g)[0], rel=1e-7)
        assert r["se_h"] == pytest.approx(crv1(X, y, d.h.values, in_h)[0], rel=1e-7)
        assert r["se_hc1"] == pytest.approx(hc1(X, y)[1][0], rel=1e-7)
    with pytest.raises(ValueError):
        regress(df, [spec], {"g": ["g"]}, fe_dof="some")


def test_effect_is_nested_by_its_own_rows_only(spark):
    # the one level that lies in two clusters has only one of them among the complete rows
    rows = [(float(i), float(i * i % 7), f"f{i % 4}", "a" if i % 4 < 2 else "b") for i in range(40)]
    rows += [(None, 1.0, "f0", "b")]
    df = spark.createDataFrame(rows, "x double, y double, f string, g string")
    spec = Spec("s", "y", ("x",), fe=("f",))
    [nested] = regress(df, [spec], {"g": ["g"]}, bootstrap=[])
    [none] = regress(df, [spec], {"g": ["g"]}, bootstrap=[], fe_dof="none")
    [every] = regress(df, [spec], {"g": ["g"]}, bootstrap=[], fe_dof="all")
    assert nested["se_g"] == none["se_g"] < every["se_g"]


def test_four_regressors_one_collinear(spark):
    d = frame(500, 4).dropna()
    d["x4"] = d.f + 0.1 * d.x2
    d["x5"] = 3 * d.x2 - 2 * d.x4  # nothing of its own
    df = spark.createDataFrame(d).repartition(3)
    [r] = regress(df, [Spec("s", "y", ("x1", "x2", "x4", "x5"))], {"g": ["g"]}, reps=49)
    z = (d[["x1", "x2", "x4"]] - d[["x1", "x2", "x4"]].mean()) / d[["x1", "x2", "x4"]].std()
    X, y = np.c_[np.ones(len(d)), z], (d.y - d.y.mean()).values
    b, se = hc1(X, y)
    scale = d.x1.std()
    assert r["beta"] == pytest.approx(b[1] / scale, rel=1e-7)
    assert r["se_hc1"] == pytest.approx(se[1] / scale, rel=1e-7)
    assert r["se_g"] == pytest.approx(crv1(X, y, d.g.values)[1] / scale, rel=1e-7)
    assert r["p_boot_g"] == boot(X, y, d.g.values, 1, 49, 42)


def test_cluster_names_of_different_tuples_differ(spark):
    rows = [("a", "1:b"), ("a1:b", None), ("a1", ":b"), (None, "a"), ("a", None), ("-", "a"), ("", ""), (None, None), ("1:a", ""), ("", "1:a")]
    df = spark.createDataFrame(rows, "p string, q string").select(cluster_key(["p", "q"]).alias("k"))
    assert df.distinct().count() == len(rows)


def test_verdicts_and_flips(spark):
    rows = [("a", True, True, True, 0.01), ("b", True, True, False, 0.2), ("c", False, False, False, 0.5),
            ("d", True, False, True, 0.04), ("e", True, True, False, None)]
    df = spark.createDataFrame(rows, "spec string, h boolean, c boolean, b boolean, p double")
    got = {r.spec: r.verdict for r in verdict(df, "h", "c", "b").collect()}
    assert got == {"a": "ROBUST", "b": "FRAGILE", "c": "Not sig", "d": "Mixed", "e": "FRAGILE"}
    assert {r.spec for r in survivors(df, ["h", "c", "b"]).collect()} == {"a"}
    assert {r.spec for r in fragile(df, "h", ["b"], ["p"]).collect()} == {"b"}
    flips = {r.method: (r.n_significant, r.n_flips) for r in flip_summary(df, "h", ["c", "b"]).collect()}
    assert flips == {"h": (4, 0), "c": (3, 1), "b": (2, 2)}
    codes = {r.spec: r.sig_code for r in significance_code(df, {"h": "H", "c": "S", "b": "s"}).collect()}
    assert codes["d"] == "H-s" and codes["c"] == "---"


def test_outcomes_missing_from_the_table_are_skipped(spark):
    df = spark.createDataFrame(frame())
    specs = outcome_specs(df, {"y": "Y", "nope": "No"}, "x2", min_n=10)
    assert [s.label for s in specs] == ["Y"]
    table = inference_table(df, specs, {"g": ["g"]}, bootstrap=["g"], reps=9)
    long = tidy(table, ["spec"], {"t_hc1": "HC1", "t_g": "Cluster"}, "method", "t_stat")
    assert [(r["method"], r.method_order) for r in long.orderBy("method_order").collect()] == [("HC1", 1), ("Cluster", 2)]


def test_many_cells_are_summed_where_their_rows_meet(spark, monkeypatch):
    rows = spark.range(0, 20_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 500).alias("village"),
        (F.xxhash64("id") % 100 / 10).alias("x"),
        F.when(F.col("id") % 11 > 0, F.xxhash64(F.col("id") + 7) % 100 / 10).alias("y"),
    )
    specs = [Spec("y", "y", ("x",)), Spec("x", "x", ("y",))]
    few = regress(rows, specs, {"village": ["village"]}, reps=99)
    monkeypatch.setattr(moments, "HELD_BYTES", 0)
    many = regress(rows, specs, {"village": ["village"]}, reps=99)
    assert [list(r) for r in few] == [list(r) for r in many]
    assert all(a == b or a == pytest.approx(b) for r, s in zip(few, many) for a, b in zip(r.values(), s.values()))
    # no other partition holds rows of a cell, so no task holds sums of all cells
    fits, _ = moments.distinct_fits(specs)
    placed = moments._gathered(rows, fits, ["village"]).withColumn("at", F.spark_partition_id())
    placed = placed.groupBy("village").agg(F.count_distinct("at").alias("n"))
    assert [r.n for r in placed.select("n").distinct().collect()] == [1]
