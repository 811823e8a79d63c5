"""The nearest-name search against all pairs, and the steps after it."""

import random

import pytest
from pyspark.sql import functions as F

from canvass.operators import linkage as L


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(left, right, max_dist, skip_blank=True):
    out = {}
    for name in {x for x in left if x is not None and (x or not skip_blank)}:
        options = [
            (edits(name, r), order, r) for order, r in enumerate(right) if r is not None and (r or not skip_blank)
        ]
        options = [o for o in options if o[0] <= max_dist]
        best = min(options) if options else (None, None, None)
        out[name] = (best[0], best[2])
    return out


def names(n, seed, longest, letters="ABC"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def search(spark, left, right, max_dist, skip_blank=True):
    l = spark.createDataFrame([(x,) for x in left], "l string").repartition(3)
    r = spark.createDataFrame([(x, i) for i, x in enumerate(right)], "r string, ord int").repartition(4)
    got = L.nearest_names(l, r, "l", "r", ["ord"], max_dist, skip_blank=skip_blank).collect()
    return {x.l: (x.match_distance, x.matched_name) for x in got}, {x.l: x.n for x in got}


@pytest.mark.parametrize("seed,longest,letters,max_dist", [(1, 9, "ABC", 3), (2, 14, "ABCDEFGH", 3), (3, 7, "AB", 2), (4, 5, "ÀBC", 3)])
def test_equals_all_pairs(spark, seed, longest, letters, max_dist):
    left, right = names(120, seed, longest, letters), names(70, seed + 50, longest, letters)
    got, counts = search(spark, left, right, max_dist)
    assert got == brute(left, right, max_dist)
    assert all(counts[x] == left.count(x) for x in counts)


def test_sparse_gazetteer_reaches_every_round(spark):
    left, right = names(80, 9, 12, "ABCDEFGHIJ"), names(15, 10, 12, "ABCDEFGHIJ")
    got, _ = search(spark, left, right, 3)
    want = brute(left, right, 3)
    assert got == want and {d for d, _ in want.values()} >= {3, None}


def test_blank_and_missing_names(spark):
    left, right = ["", None, "AB", "XYZ"], [None, "", "ABC"]
    got, _ = search(spark, left, right, 3)
    assert got == {"AB": (1, "ABC"), "XYZ": (3, "ABC")}
    got, _ = search(spark, left, right, 3, skip_blank=False)
    assert got == brute(left, right, 3, skip_blank=False)


def test_split_groups_give_the_same_links(spark, monkeypatch):
    left, right = names(150, 21, 8), names(120, 22, 8)
    monkeypatch.setattr(L, "BROADCAST_NAMES", 0)
    monkeypatch.setattr(L, "GROUP", 3)
    got, _ = search(spark, left, right, 3)
    assert got == brute(left, right, 3)


def test_blocks_keep_links_inside(spark):
    l = spark.createDataFrame([("UP", "RAMPUR"), ("RJ", "RAMPUR"), (None, "RAMPUR")], "st string, l string")
    r = spark.createDataFrame([("UP", "RAMPURA", 1), ("MH", "RAMPUR", 2)], "st string, r string, ord int")
    got = {x.st: x.matched_name for x in L.nearest_names(l, r, "l", "r", ["ord"], 3, ["st"]).collect()}
    assert got == {"UP": "RAMPURA", "RJ": None}


def test_split_blocks_of_different_size(spark, monkeypatch):
    from canvass.functions import skew

    monkeypatch.setattr(L, "BROADCAST_NAMES", 0)
    monkeypatch.setattr(L, "GROUP", 3)
    monkeypatch.setattr(L, "NAMES_PER_TASK", 7)
    monkeypatch.setattr(skew, "HOT_PARTS", 50)
    blocks = {"big": (names(160, 31, 7, "AB"), names(120, 32, 7, "AB")), "small": (names(9, 33, 6), names(4, 34, 6)), "left only": (["AB"], [])}
    l = spark.createDataFrame([(b, x) for b, (left, _) in blocks.items() for x in left], "b string, l string").repartition(3)
    r = spark.createDataFrame([(b, x, i) for b, (_, right) in blocks.items() for i, x in enumerate(right)], "b string, r string, ord int")
    got = {}
    for x in L.nearest_names(l, r, "l", "r", ["ord"], 2, ["b"]).collect():
        got.setdefault(x.b, {})[x.l] = (x.match_distance, x.matched_name)
    assert got == {b: brute(left, right, 2) for b, (left, right) in blocks.items()}


def test_ties_take_the_first_row_and_its_columns(spark):
    l = spark.createDataFrame([("CAT", 1), ("CAT", 2), ("DOG", 3)], "l string, id int")
    r = spark.createDataFrame([("BAT", 2, "two"), ("HAT", 1, "one"), ("HAT", 5, "five"), ("DOG", 9, "nine")], "r string, ord int, tag string")
    near = L.nearest_names(l, r, "l", "r", ["ord"], 3)
    linked = L.fuzzy_link(l, L.attach_first(near, r, "r", ["ord"]), "l")
    assert sorted((x.id, x.match_distance, x.matched_name, x.tag) for x in linked.collect()) == [
        (1, 1, "HAT", "one"), (2, 1, "HAT", "one"), (3, 0, "DOG", "nine")]
    assert {x.match_distance: (x.n_names, x.n_rows) for x in L.match_quality(near).collect()} == {0: (1, 1), 1: (1, 2)}
    assert L.match_rate(near).first().pct_matched == 100.0


def test_codes_are_numbers_and_missing_codes_link_nothing(spark):
    linked = spark.createDataFrame([("a", "007", 1), ("b", None, 2), ("c", "x", 3), ("a", "8", 4)], "name string, code string, ord int")
    keys = spark.createDataFrame([("7", "s7"), ("8", "s8"), (None, "s0"), ("9", None)], "kc string, sid string")
    att = spark.createDataFrame([("s7", 100, 20, 5)], "sid string, pop int, sc int, st int")
    out = L.link_via_code(linked, "code", keys, "kc", "sid", att, ["name"], ["ord"])
    [row] = L.population_rates(out, "pop", {"share": ["sc", "st"]}).collect()
    assert (row["name"], row.sid, row.code, row.share) == ("a", "s7", 7.0, 25.0)


def test_validation_needs_enough_places(spark):
    v = spark.range(8).select(F.col("id").alias("k"), (F.col("id") * 2.0).alias("a"), (10.0 - F.col("id")).alias("b"))
    assert L.validation_correlations(v, {"p": ("a", "b")}).first().r == pytest.approx(-1)
    assert L.validation_correlations(v.limit(5), {"p": ("a", "b")}).count() == 0
    m = {r.variable: (r.median, r["mean"]) for r in L.validation_medians(v, ["a", "b"]).collect()}
    assert m["a"] == (7.0, 7.0) and m["b"] == (6.5, 6.5)
