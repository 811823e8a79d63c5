"""Missing-value, ordering and binning rules on hand-made frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.functions import quantiles as Q
from canvass.functions import semantics as S
from canvass.functions.skew import join_per_key
from canvass.operators import clock, coverage, effects, interviewer, panel, quality, temporal


def one(df):
    return df.first()[0]


def test_missing_is_a_group_and_a_level(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 1), (None, 2), (None, None)], "g string, x int")
    got = {r.g: r.n for r in df.groupBy("g").agg(S.n_distinct("x").alias("n")).collect()}
    assert got == {"a": 2, None: 3}


def test_missing_keys_match_in_null_safe_joins(spark):
    a = spark.createDataFrame([(1, None), (2, "k")], "id int, k string")
    b = spark.createDataFrame([(None, 10), ("k", 20)], "k string, v int")
    assert a.join(b, S.null_safe(a, b, ["k"])).count() == 2


def test_membership_is_never_missing(spark):
    df = spark.createDataFrame([(1,), (3,), (None,)], "x int")
    assert [r[0] for r in df.select(S.in_set("x", [1, 2])).collect()] == [True, False, False]
    assert [r[0] for r in df.select(S.indicator(F.col("x") == 3)).collect()] == [0, 1, None]
    assert [r[0] for r in df.select(S.indicator(F.col("x") == 3, missing_as_zero=True)).collect()] == [0, 1, 0]


def test_ratio_with_zero_denominator(spark):
    df = spark.createDataFrame([(1, 0), (1, 4)], "a int, b int")
    assert [r[0] for r in df.select(S.pct(F.col("a"), F.col("b"))).collect()] == [None, 25.0]
    assert [r[0] for r in df.select(S.ratio(F.col("a"), F.col("b"))).collect()] == [None, 0.25]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(math.nan,), (1.0,), (None,)], "x double")
    assert S.normalize_missing(df).where("x is null").count() == 2
    logs = spark.createDataFrame([(-2.0,), (-1.0,), (0.0,), (math.nan,)], "x double").select(S.log1p_or_null("x"))
    assert [r[0] for r in logs.collect()] == [None, None, 0.0, None]


def test_tuple_keys_do_not_collide(spark):
    df = spark.createDataFrame([("a_b", "c"), ("a", "b_c"), (None, "NA"), ("NA", None)], "x string, y string")
    assert df.groupBy("x", "y").count().count() == 4


def test_half_even_tenths(spark):
    values = [1.05, 1.15, 1.25, 1.95, 1.99, 2.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r.decimal: r.n for r in effects.decimal_distribution(df, "x").collect()}
    want: dict[float, int] = {}
    for v in values[:-1]:
        key = float(np.rint((v - math.floor(v)) * 10) / 10)
        want[key] = want.get(key, 0) + 1
    assert got == want and 1.0 in got


def test_cut_conventions(spark):
    values = [-5, 4, 5, 30, 60, 90, 240, 241, None]
    df = spark.createDataFrame([(v,) for v in values], "x int")
    left, _ = S.cut("x", quality.DURATION_BREAKS, quality.DURATION_LABELS, right=False)
    got = [r[0] for r in df.select(left).collect()]
    assert got == ["<5", "<5", "5-30", "30-60", "60-90", "90-120", "[240,inf)", "[240,inf)", None]
    right, order = S.cut("x", effects.QUALITY_BREAKS, effects.QUALITY_LABELS)
    got = [r[0] for r in df.select(right).collect()]
    assert got == [None, None, None, "5-30", "30-60", "60-90", "180-240", None, None]
    closed, _ = S.cut("x", effects.QUALITY_BREAKS, effects.QUALITY_LABELS, include_lowest=True)
    assert [r[0] for r in df.select(closed).collect()][2] == "5-30"
    assert S.default_labels((1, 2, float("inf")), True) == ["(1,2]", "(2,inf]"]


def test_names_are_trimmed_of_tabs_and_line_ends(spark):
    df = spark.createDataFrame([("\t ab c\r\n",), (" ",), (None,)], "x string")
    assert [r[0] for r in df.select(S.trimmed_upper("x")).collect()] == ["AB C", "", None]


def test_correlation_of_a_constant_is_missing(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0), ("b", 3.0, None)],
                               "g string, x double, y double")
    got = {r.g: r for r in effects.correlation_and_line(df, ["g"], "x", "y").collect()}
    assert got["a"].r is None and got["a"].slope is None
    assert got["b"].r == pytest.approx(1.0) and got["b"].slope == pytest.approx(2.0) and got["b"].n_pairs == 2


def test_top_k_keeps_ties(spark):
    rows = [("s", h) for h, n in [(8, 5), (9, 4), (10, 3), (11, 3), (12, 1), (30, 9)] for _ in range(n)]
    got = temporal.peak_hours(spark.createDataFrame(rows, "source string, h int"), "source", "h").collect()
    assert sorted((r.h, r.n) for r in got) == [(8, 5), (9, 4), (10, 3), (11, 3)]


@pytest.mark.parametrize("accuracy,few", [(20, 10), (100, 100), (10_000, 10_000)])
def test_exact_quantiles_of_measurements(spark, monkeypatch, accuracy, few):
    monkeypatch.setattr(Q, "FEW", few)
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=3001), "b": np.round(rng.exponential(size=500), 1), "c": np.array([2.0]), None: np.ones(50)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r for r in Q.continuous_summary(df, ["g"], "v", probs, accuracy).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g].n == len(vs)
        assert np.allclose(got[g].q, np.quantile(vs, probs), rtol=1e-12)
    whole = Q.continuous_summary(df, [], "v", probs, accuracy).first()
    assert np.allclose(whole.q, np.quantile(np.concatenate(list(groups.values())), probs), rtol=1e-12)


def test_a_wrong_bracket_is_noticed(spark, monkeypatch):
    monkeypatch.setattr(Q, "FEW", 5)
    values = [float(v) for v in range(1000)] + [500.0] * 300 + [float("inf"), float("-inf")]
    base = spark.createDataFrame([(v,) for v in values], "__v double").repartition(3)
    ordered = sorted(values)
    wrong = [(0, 900.0, 950.0), (1, None, None), (10, 500.0, 501.0), (499, 0.0, 3.0), (500, 2000.0, 3000.0), (700, -9.0, -5.0),
             (799, 500.0, 500.0), (805, 501.0, 501.0), (1300, 7.0, 7.0), (1301, -3.0, 3.0)]
    targets = spark.createDataFrame([(len(values), *w) for w in wrong], "n long, rank long, lo double, hi double")
    got = {r.rank: r.value for r in Q.order_statistics(base, [], targets, 100).collect()}
    assert got == {rank: ordered[rank] for rank, _, _ in wrong}


def test_six_numbers_of_counts(spark):
    values = [1, 1, 2, 5, 9, 9, 10, None]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v int")
    r = Q.six_number_summary(df, ["g"], "v").first()
    known = [v for v in values if v is not None]
    assert (r.n, r.min, r.max) == (7, 1.0, 10.0)
    assert [r.q1, r.median, r.q3, r.mean] == [*np.quantile(known, [0.25, 0.5, 0.75]), pytest.approx(np.mean(known))]


def test_approximate_quantiles_are_close(spark):
    df = spark.range(10_001).selectExpr("cast(id as double) as v")
    r = Q.six_number_summary(df, [], "v", approximate=True).first()
    assert abs(r.median - 5000) <= 2 and r.min == 0 and r.max == 10_000


def test_join_with_a_hot_key(spark, monkeypatch):
    from canvass.functions import skew

    monkeypatch.setattr(skew, "HOT_PARTS", 4)
    rows = [(1, i) for i in range(50)] + [(None, i) for i in range(40)] + [(k, 0) for k in range(2, 30)]
    df = spark.createDataFrame(rows, "k int, v int")
    per_key = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), (F.max("v") * 10).alias("m")).where("k is null or k < 20")
    got = join_per_key(df, per_key, ["k"], "n")
    assert got.columns == ["k", "v", "m"]
    assert got.count() == 50 + 40 + 18
    assert got.where("k = 1").select("m").distinct().collect()[0][0] == 490
    assert join_per_key(df, per_key, ["k"], "n", how="semi").count() == 108


def test_duplicates_keep_every_copy_and_missing_ids_can_be_left_out(spark):
    rows = [(1, "x", 10)] * 3 + [(2, "x", 10), (None, "y", 1), (None, "y", 1), (3, None, 5), (3, None, 5)]
    df = spark.createDataFrame(rows, "id int, place string, t int")
    assert quality.duplicate_rows(df, ["id", "place", "t"]).count() == 7
    assert quality.duplicate_rows(df, ["id", "place"], ["id"]).count() == 5
    got = {r.place: (r.n_rows, r.n_groups) for r in quality.duplicate_summary(df, ["id", "place"], ["place"], ["id"]).collect()}
    assert got == {"x": (3, 1), None: (2, 1)}


def test_missing_profile_counts_nan_only_after_normalizing(spark):
    df = spark.createDataFrame([(1, math.nan, "a"), (None, 2.0, "b")], "x int, y double, z string")
    got = [(r.variable, r.n_missing, r.pct_missing) for r in quality.missing_profile(S.normalize_missing(df)).collect()]
    assert got == [("x", 1, 50.0), ("y", 1, 50.0)]
    assert quality.missing_profile(df, only_missing=False).count() == 3


def test_clock_and_rules(spark):
    rows = [("9", 30, 10, 15), ("bad", 0, 1, 0), ("23", 50, 0, 10), ("25", 61, 26, 0)]
    df = clock.with_clock(spark.createDataFrame(rows, "hour_start string, minute_start int, hour_end int, minute_end int"))
    assert [r.duration_mins for r in df.collect()] == [45, None, -1420, -1]
    bad = quality.rule_violations(df.withColumn("h", F.col("start_hour")), {"time": clock.invalid_time(["h", "hour_end"], ["minute_start"])})
    assert bad.first().n_invalid == 1
    dates = spark.createDataFrame([(31, 2), (29, 2), (0, 1), (None, 1)], "d int, m int")
    assert [r[0] for r in dates.select(clock.invalid_date("d", "m")).collect()] == [False, False, True, None]
    assert [r[0] for r in dates.select(clock.impossible_date("d", "m")).collect()] == [True, False, True, False]


def test_concurrency_counts_identical_slots(spark):
    rows = [("n", 1, 9, 10), ("n", 1, 9, 10), ("n", 1, 9, 11), ("n", 2, 9, 10), ("m", 1, 8, 9), (None, 1, 8, 9)]
    df = spark.createDataFrame(rows, "name string, day int, s int, e int")
    by_day = interviewer.concurrency_by_day(df, ["name"], ["day"], ["s", "e"])
    assert {(r.name, r.day): (r.n, r.min_people) for r in by_day.collect()} == {
        ("n", 1): (3, 2), ("n", 2): (1, 1), ("m", 1): (1, 1), (None, 1): (1, 1)}
    daily = {(r.name, r.day): (r.adjusted, r.single_person) for r in interviewer.daily_productivity(by_day, ["name"]).collect()}
    assert daily[("n", 1)] == (1.5, False) and daily[("n", 2)] == (1.0, False) and daily[(None, 1)] == (1.0, True)
    assert interviewer.single_person_days(by_day, ["name"]).count() == 2


def test_attrition_denominators(spark):
    rows = [(1, 0), (1, 1), (1, 2), (1, None), (0, 1), (None, 1)]
    df = spark.createDataFrame(rows, "panel int, locked int")
    r = panel.panel_attrition(df, "panel", "locked").first()
    assert (r.n_panel, r.n_interviewed, r.n_known, r.n_locked) == (4, 2, 3, 1)
    assert r.pct_interviewed == 50.0 and r.pct_locked == pytest.approx(100 / 3)
    assert panel.applicable(df, "panel") and not panel.applicable(df, "reason")
    dist = {x.locked: x.pct for x in panel.code_distribution(df, "locked").collect()}
    assert sum(dist.values()) == pytest.approx(100) and dist[None] == pytest.approx(100 / 6)


def test_approximate_distinct_counts_are_close(spark):
    df = spark.range(20_000).selectExpr("id % 5000 as x", "id % 3 as g")
    r = coverage.distinct_counts(df, {"levels": "x"}, approximate=True).first()
    assert abs(r.levels / 5000 - 1) < 0.15


def test_month_day_key(spark):
    df = spark.createDataFrame([(1, 5), (12, 31), (None, 3)], "m int, d int")
    assert [r[0] for r in df.select(temporal.month_day_key("m", "d")).collect()] == ["01-05", "12-31", "NA-03"]


def test_timeline_is_lexicographic(spark):
    df = spark.createDataFrame([("s", 2, 1), ("s", 1, 31), ("s", 2, 1), ("s", 10, 2)], "source string, m int, d int")
    r = temporal.fieldwork_timeline(df, "source", "m", "d").first()
    assert (r.first_month, r.first_day, r.last_month, r.last_day, r.n_days) == (1, 31, 10, 2, 3)
