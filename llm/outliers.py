"""Quality rules by robust multivariate outliers.

Each document becomes a vector of transformed statistics.  For every language and source the
minimum-covariance-determinant estimate of centre and scatter is found by concentration steps from
two fixed starts (classical moments, and the ball around the medians); documents whose Mahalanobis
distance is beyond a chi-square quantile are rejected.

Everything after the statistics is aggregation: a concentration step is one quantile sketch and one
grouped sum, both combined before the shuffle, so a source with a third of all rows is no hot task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.tables import cut
from llm.textops import WHITE, Words, mix, per_text, pieces, raw, repeated, windows, U, range_hashes, BYTES

WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STATS = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines".split()

# transformed statistics and the least standard deviation each is given: a cell in which nearly all
# documents have no symbols at all would otherwise reject the first one that has
FLOORS = {"log_words": 0.5, "log_word_length": 0.10, "symbols": 0.08, "dup_lines": 0.12, "repeats": 0.15}
DIMS = list(FLOORS)
# chance of a distance beyond the cut-off for a normal document; chosen on labelled rows that op8 does not hold out (README)
TAIL = 0.005
# more than this many cells are joined by a shuffle instead of a broadcast
BROADCAST_CELLS = 10_000
# cells for one file of a table that has a row for each of them
FILE_CELLS = 10_000


def text_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of ``STATS`` for each text of one batch."""
    data, offsets = raw(column)
    w = Words(data, offsets)
    out = {
        "n_words": w.counts,
        "word_chars": per_text(w.inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_text(SYMBOLS[data], offsets),
    }
    # lines: cut at \n and at text borders, kept when they hold a word
    cuts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1, offsets[-1:]]))
    starts, ends = cuts[:-1], cuts[1:].copy()
    ends[data[ends - 1] == 10] -= 1
    text = np.searchsorted(offsets, starts, "right") - 1
    words_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~WHITE[data], out=words_before[1:])
    full = words_before[ends] > words_before[starts]
    starts, ends, text = starts[full], ends[full], text[full]
    n = len(offsets) - 1
    out["n_lines"] = np.bincount(text, minlength=n)
    lines = np.zeros(len(starts), np.uint64)
    if len(starts):
        lines = range_hashes(BYTES[data], starts, ends, 0x9E3779B97F4A7C15)
    own = mix(lines ^ mix(text.astype(np.uint64) + U(1)))
    first = np.unique(own, return_index=True)[1]
    out["n_dup_lines"] = out["n_lines"] - np.bincount(text[first], minlength=n)
    # windows found twice in the same text, and the words they cover
    first, text = w.window_starts(WINDOW)
    keys = mix(windows(w.hashes(), first, WINDOW) ^ mix(text.astype(np.uint64) + U(1)))
    first = first[repeated(keys)]
    step = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + WINDOW, -1)
    covered = np.cumsum(step[:-1]) > 0
    out["n_repeat_words"] = per_text(covered, w.at)
    return out


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source"), text: str = "text") -> DataFrame:
    """``keep`` and the counts of every whole text; a null or empty text counts zero of everything."""
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias("__text"))
    names = src.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "__text"):
            counts = text_statistics(b.column("__text"))
            columns = [b.column(c) for c in names] + [pa.array(counts[c].astype(np.int64)) for c in STATS]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *STATS])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, kinds + "".join(f", {c} bigint" for c in STATS))


def vector() -> dict[str, Column]:
    """Transforms that bring counts near to a normal shape: logs of sizes, roots of shares."""

    def root(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.sqrt(F.col(a) / F.col(b))).otherwise(0.0)

    return {
        "log_words": F.log1p("n_words"),
        "log_word_length": F.when(F.col("n_words") > 0, F.log(F.col("word_chars") / F.col("n_words"))).otherwise(0.0),
        "symbols": root("n_symbols", "word_chars"),
        "dup_lines": root("n_dup_lines", "n_lines"),
        "repeats": root("n_repeat_words", "n_words"),
    }


def chi2_cdf(x: float, k: int) -> float:
    a, x = k / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= x / (a + n)
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return hi


def _join(rows: DataFrame, table: DataFrame, key: list[str], small: bool) -> DataFrame:
    return rows.join(F.broadcast(table) if small else table, key, "left")


def _moments(rows: DataFrame, key: list[str], where: Column) -> DataFrame:
    x = {c: F.when(where, F.col(c)) for c in DIMS}
    pairs = [(a, b) for i, a in enumerate(DIMS) for b in DIMS[: i + 1]]
    return rows.groupBy(*key).agg(
        F.count(F.when(where, F.lit(1))).cast("double").alias("n"),
        F.array(*[F.sum(x[c]) for c in DIMS]).alias("s"),
        F.array(*[F.sum(x[a] * x[b]) for a, b in pairs]).alias("ss"),
    )


def at_least(cov: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """``cov`` with a standard deviation of ``floor`` or more in every direction; wider directions stay as they are."""
    values, axes = np.linalg.eigh((cov + cov.T) / 2 / np.outer(floor, floor))
    out = (axes * np.maximum(values, 1.0)) @ axes.T * np.outer(floor, floor)
    return (out + out.T) / 2


def _fit(moments: DataFrame, key: list[str], share: float) -> DataFrame:
    """Centre, inverse Cholesky factor (row by row) and log determinant of each cell."""
    p = len(DIMS)
    scale = share / chi2_cdf(chi2_quantile(share, p), p + 2) if share < 1 else 1.0
    floor = np.array(list(FLOORS.values()))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = part[key].copy()
            mids, inverses, dets = [], [], []
            for n, s, ss in zip(part["n"], part["s"], part["ss"]):
                n = max(n, 1.0)
                mid = np.nan_to_num(np.array(s, dtype=float)) / n
                cov = np.zeros((p, p))
                cov[np.tril_indices(p)] = np.nan_to_num(np.array(ss, dtype=float)) / n
                cov = cov + np.tril(cov, -1).T - np.outer(mid, mid)
                root = np.linalg.cholesky(at_least(cov * scale, floor))
                mids.append(mid.tolist())
                inverses.append(np.linalg.inv(root)[np.tril_indices(p)].tolist())
                dets.append(2 * float(np.log(np.diag(root)).sum()))
            out["mid"], out["inv"], out["det"] = mids, inverses, dets
            yield out

    kinds = ", ".join(f"{c} {dict(moments.dtypes)[c]}" for c in key)
    return moments.mapInPandas(run, f"{kinds}, mid array<double>, inv array<double>, det double")


def _distance() -> Column:
    out, k = F.lit(0.0), 0
    for i in range(len(DIMS)):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col("inv")[k] * (F.col(DIMS[j]) - F.col("mid")[j])
            k += 1
        out = out + z * z
    return out


def _held(table: DataFrame, files: int) -> DataFrame:
    """A table of cells, cut into ``files`` files.

    It is aggregated by as many tasks as any other and then gathered: a file for each of these tasks, most of them
    empty, costs an executor a new process (which sets the file's mode) whose memory counts as the executor's own.
    """
    return cut(table.repartition(files))


def cells(rows: DataFrame, passed: Column, least: int) -> tuple[DataFrame, bool, int]:
    """Give each row its ``cell``: its language and source, or, where fewer than ``least`` rows pass, the
    small sources of its language together, then all such rows together, then none (null).

    Also returns whether the cells are few, and the number of files for a table of them."""
    whole = F.lit('{"all":1}')
    level = [
        F.to_json(F.struct(F.lit(0).alias("level"), "lang", "source")),
        F.to_json(F.struct(F.lit(1).alias("level"), "lang")),
        whole,
    ]
    rows = rows.withColumn("cell", level[0])
    small = True
    files = rows.agg(F.approx_count_distinct("cell")).first()[0] // FILE_CELLS + 1
    for up in [*level[1:], F.lit(None).cast("string")]:
        counts = _held(rows.groupBy("cell").agg(F.count(F.when(passed, F.lit(1))).alias("__n")), files)
        small = counts.count() <= BROADCAST_CELLS
        rows = _join(rows, counts, ["cell"], small)
        rows = rows.withColumn("cell", F.when(F.col("__n") < least, up).otherwise(F.col("cell"))).drop("__n")
    return rows, small, files


def mcd_verdicts(
    stats: DataFrame,
    passed: Column,
    share: float = 0.75,
    steps: int = 5,
    least: int = 100,
    tail: float = TAIL,
) -> DataFrame:
    """``stats`` with ``distance`` (squared, from the cell's final estimate) and ``outlier``.

    ``stats`` has ``lang``, ``source`` (nulls are values of their own) and the counts of ``STATS``.
    Rows that do not pass are no part of the estimates.  ``share`` of a cell's rows is covered by the
    estimate; its steps stop after ``steps``; ties at the quantile are all covered.  Rows without a
    cell have no distance and are no outliers.  Copies count as often as they occur.
    """
    p = len(DIMS)
    rows, small, files = cells(stats.withColumns(vector()), passed, least)
    rows = cut(rows)
    base = rows.where(passed & F.col("cell").isNotNull())
    # start 0: moments of all rows; start 1: the rows nearest to the medians, in units of the floors
    meds = _held(base.groupBy("cell").agg(F.array(*[F.percentile_approx(c, 0.5, 1000) for c in DIMS]).alias("mid")), files)
    unit = [0.0] * (p * (p + 1) // 2)
    for i, f in enumerate(FLOORS.values()):
        unit[i * (i + 1) // 2 + i] = 1 / f
    ball = meds.withColumns({"inv": F.array(*[F.lit(v) for v in unit]), "det": F.lit(0.0), "start": F.lit(1)})
    whole = _fit(_moments(base, ["cell"], F.lit(True)), ["cell"], 1.0).withColumn("start", F.lit(0))
    fit = _held(whole.select("cell", "start", "mid", "inv", "det").unionByName(ball), files)
    key = ["cell", "start"]
    twice = base.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    for _ in range(steps):
        near = _join(twice, fit, key, small).withColumn("distance", _distance())
        edge = near.groupBy(*key).agg(F.percentile_approx("distance", share, 10_000).alias("edge"))
        near = _join(near, _held(edge, files), key, small)
        fit = _held(_fit(_moments(near, key, F.col("distance") <= F.col("edge")), key, share), files)
    best = fit.groupBy("cell").agg(F.min_by(F.struct("mid", "inv"), F.struct("det", "start")).alias("b"))
    best = _held(best.select("cell", "b.*"), files)
    # one reweighting step over all rows that the raw estimate does not call far
    near = _join(base, best, ["cell"], small).withColumn("distance", _distance())
    last = _held(_fit(_moments(near, ["cell"], F.col("distance") <= chi2_quantile(0.975, p)), ["cell"], 0.975), files)
    out = _join(rows, last, ["cell"], small).withColumn("distance", _distance())
    return out.withColumn("outlier", F.coalesce(F.col("distance") > chi2_quantile(1 - tail, p), F.lit(False)))


def quality_rules(docs: DataFrame, **options) -> DataFrame:
    """One row per document: the base counts, ``base_failed``, ``distance`` and ``kept``.

    A document fails the base rules with under 20 words (null and empty texts too) or with more than
    30 % of its words in repeated 8-word windows; else it is kept unless it is an outlier.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = cut(statistics(docs).withColumn("base_failed", failed))
    out = mcd_verdicts(stats, ~F.col("base_failed"), **options)
    return out.select(
        "doc_id", *STATS[:-1], "base_failed", (~F.col("base_failed") & ~F.col("outlier")).alias("kept"), "distance"
    )
