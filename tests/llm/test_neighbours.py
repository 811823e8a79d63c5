"""Nearest neighbours against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from llm import neighbours

KIND = "vec_id long, embedding array<float>, label int, qid int, part int"


def brute(rows, k=20):
    fit = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) and r[0] is not None]
    ids, x = np.array([r[0] for r in fit]), np.array([np.float32(r[1]) for r in fit]).astype(float)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_odd_vectors_ties_and_copies(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist(), 0, 1, 2) for i in range(60)]
    rows += [(i, [1.0] * 8, 0, 1, 2) for i in range(60, 160)]  # a large group of equal vectors, queries among them
    rows += [(200, None, 0, 1, 2), (220, [0.0] * 8, 0, 1, 2), (240, [1.0, None] * 4, 0, 1, 2), (260, [float("nan")] * 8, 0, 1, 2)]
    rows += [(280, [float("inf")] * 8, 0, 1, 2), (300, [], 0, 1, 2), (None, [1.0] * 8, 0, 1, 2)]
    got = found(neighbours.nearest(spark.createDataFrame(rows, KIND), F.col("vec_id") % 20 == 0))
    want = brute(rows)
    assert {q: [v for v, _ in x] for q, x in got.items()} == {q: [v for v, _ in x] for q, x in want.items()}
    assert all(a == pytest.approx(b) for q in want for (_, a), (_, b) in zip(got[q], want[q]))


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0], 0, 1, 2), (20, [0.5, 0.5], 0, 1, 2), (3, [0.0, 2.0], 0, 1, 2)]
    got = found(neighbours.nearest(spark.createDataFrame(rows, KIND), F.col("vec_id") % 20 == 0))
    assert {q: [v for v, _ in x] for q, x in got.items()} == {0: [20, 3], 20: [3, 0]}
    assert neighbours.nearest(spark.createDataFrame([], KIND), F.col("vec_id") % 20 == 0).collect() == []


def test_recall_with_partitions(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.5 * rng.normal(size=16)).tolist(), 0, 1, 2) for i in range(5000)]
    got = found(neighbours.nearest(spark.createDataFrame(rows, KIND), F.col("vec_id") % 20 == 0))
    want = brute(rows)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9


def test_rows_of_the_comparison_follow_the_queries(spark, monkeypatch):
    """Vectors without clusters: most partitions are probed, yet a query leaves its nearest once for each stripe; blocks and batches change nothing."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist(), 0, 1, 2) for i in range(4000)]
    df = spark.createDataFrame(rows, KIND)
    before = found(neighbours.nearest(df, F.col("vec_id") % 20 == 0))
    want = brute(rows)
    hits = sum(len({v for v, _ in before[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    monkeypatch.setattr(neighbours, "HELD_QUERIES", 30)
    monkeypatch.setattr(neighbours, "STRIPES", 3)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert found(neighbours.nearest(df, F.col("vec_id") % 20 == 0)) == before
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    best = neighbours.Best(5)
    best.ask(pd.DataFrame({"gid": [7, 8], "vec": [np.ones(8), -np.ones(8)], "parts": [list(range(20)), [3]]}))
    for part in range(20):
        best.meet(part, pd.DataFrame({"gid": range(100 * part, 100 * part + 100), "vec": list(rng.normal(size=(100, 8)))}))
    assert len(best.found()) == 10


def test_partitions_are_balanced():
    x = np.random.default_rng(2).normal(size=(2000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = neighbours.neighbour_graph(x.astype(np.float32), 10)
    label = neighbours.balanced_partition(x.astype(np.float32), graph, 8)
    assert np.bincount(label, minlength=8).max() <= 1.3 * 250 + 1
    kept = (label[graph] == label[:, None]).mean()
    assert kept > 2 / 8  # far more edges stay inside than by chance
