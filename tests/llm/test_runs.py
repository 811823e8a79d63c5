"""Runs against brute force, on words that repeat at many scales."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import periods
from llm.textops import mix


def brute(words, least=12):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def fast(texts, short, least):
    parts, bounds, at = [], [], 0
    for i, t in enumerate(texts):
        parts += [mix(np.array([zlib.crc32(w.encode()) for w in t], np.uint64)), mix(np.array([10**12 + i], np.uint64))]
        bounds.append(at + len(t))
        at = bounds[-1] + 1
    begin = np.r_[0, np.array(bounds) + 1]
    out = [[] for _ in texts]
    for s, n, q in periods.runs_of(np.concatenate(parts), np.array(bounds, np.int64), least, short).tolist():
        k = int(np.searchsorted(begin, s, "right")) - 1
        out[k].append((s - int(begin[k]), n, q))
    return [sorted(x, key=lambda r: (r[0], r[1])) for x in out]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def thue_morse(n):
    return [str(bin(i).count("1") % 2) for i in range(n)]


def texts_of(rng):
    for kind in range(7):
        n = int(rng.integers(0, 260))
        if kind == 0:
            yield [str(x) for x in rng.integers(0, rng.integers(1, 4), n)]
        elif kind == 1:
            yield fibonacci(n)
        elif kind == 2:
            yield thue_morse(n)
        elif kind == 3:  # one block several times
            block = [str(x) for x in rng.integers(0, 3, rng.integers(1, 80))]
            yield (block * 4)[:n] + ["x", "y"]
        elif kind == 4:  # the period is a stretch of a shorter period
            turn = [str(x) for x in rng.integers(0, 2, rng.integers(1, 5))]
            yield ["x", *(turn * 60)[: int(rng.integers(8, 120))] * int(rng.integers(2, 4)), "y"]
        elif kind == 5:
            parts = []
            for _ in range(rng.integers(1, 6)):
                parts += ([str(x) for x in rng.integers(0, 2, rng.integers(1, 6))] * 50)[: int(rng.integers(4, 90))]
            yield parts + parts[: int(rng.integers(0, len(parts) + 1))]
        else:
            yield ["a"] * n


@pytest.mark.parametrize("short, least", [(4, 1), (4, 12), (8, 12), (32, 12)])
def test_all_runs(short, least):
    rng = np.random.default_rng(short + least)
    for _ in range(12):
        texts = list(texts_of(rng))
        assert fast(texts, short, least) == [brute(t, least) for t in texts]


def test_long_run_of_a_short_period_has_few_seeds():
    values = mix(np.tile(np.array([3, 4, 5], np.uint64), 30_000))
    bounds = np.array([len(values)])
    values = np.r_[values, np.uint64(1)]
    runs = periods.runs_of(values, bounds)
    assert runs.tolist() == [[0, 90_000, 3]]
    assert not len(periods.minimizer_seeds(values, periods.Prefixes(values), bounds, runs, 1024))


def test_equal_hashes_of_different_stretches(monkeypatch):
    """With prefixes that call everything equal, runs are still those of the words."""
    monkeypatch.setattr(periods.Prefixes, "same", lambda self, a, b, size: np.ones(np.broadcast(a, b, size).shape, bool))
    rng = np.random.default_rng(2)
    block = [str(x) for x in rng.integers(0, 5, 40)]
    text = block * 3 + ["x"] + block
    assert set(brute(text)) <= set(map(tuple, fast([text], 8, 12)[0])) | {(0, 120, 40)}


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_operator_and_digests(spark, odd):
    some = [(20, "a b " * 30), (21, "x\n" + "é ü ß " * 9), (None, " ".join(fibonacci(90))), (22, "p  q\tr " * 12 + "end")]
    docs = odd.select("doc_id", "text", F.lit(1).alias("runs"), F.lit("r").alias("row"), F.lit(2).alias("n_words"))
    docs = docs.unionByName(spark.createDataFrame(some, "doc_id long, text string"), True)
    got = periods.periodic_runs(docs, keep=("doc_id", "text", "runs", "row", "n_words"), short=8).collect()
    assert len(got) == docs.count()
    for r in got:
        words = words_of(r.row.text)
        runs = brute(words) if len(words) < 3000 else []
        assert [tuple(x) for x in r.runs] == sorted(runs, key=lambda x: (x[0], x[2]))
        assert (r.n_words, r.collapsed) == (len(words), collapsed(words, runs))
    told = {r.doc_id: r for r in periods.digests(periods.periodic_runs(docs)).collect()}
    best = min(brute(words_of("p  q\tr " * 12 + "end")), key=lambda r: (-r[1], r[0], r[2]))
    assert (told[22].start, told[22].length, told[22].period, told[22].exponent_milli) == (*best, 1000 * best[1] // best[2])
    assert told[4].n_runs == 0 and told[4].start is None
    assert told[4].runs_sha256 == told[4].collapsed_sha256 == hashlib.sha256(b"").hexdigest()


def test_retold(spark):
    texts = [(i, " ".join(f"w{k}" for k in range(i % 50))) for i in range(120)] + [(None, "a b"), (7, None)]
    got = periods.retold(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is None or r.text is None:
            continue
        h, words = zlib.crc32(str(r.doc_id).encode()), [f"w{k}" for k in range(r.doc_id % 50)]
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert r.text.split() == words


def test_empty_table(none):
    assert periods.digests(periods.periodic_runs(periods.retold(none))).collect() == []
