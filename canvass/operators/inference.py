"""Regressions with robust, cluster-robust and wild-cluster-bootstrap inference, many at a time.

Rows are scanned twice whatever the number of regressions: once for per-cluster cross-products and
once for the heteroskedasticity-robust errors.  Everything clustered works on the per-cluster table.
Only k x k matrices reach the driver, where they are inverted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.functions.skew import join_per_key
from canvass.operators.moments import Fit, Spec, fit_moments, masked_variables, roll_up
from canvass.session import materialize

# Six-point weights (Webb): plus and minus the square roots of 3/2, 1 and 1/2.
WEBB = (-(1.5**0.5), -1.0, -(0.5**0.5), 0.5**0.5, 1.0, 1.5**0.5)
COLLINEAR = 1e-10
TIE = 1e-9
# Modulus of the weight hash (the Mersenne prime 2^31 - 1).
PRIME = 2_147_483_647
# (row, replication) pairs: what is worth a task of its own while cores are idle, and the most one task gets
PAIRS_PER_TASK = 1_500_000
MOST_PAIRS_PER_TASK = 150_000_000
BLOCK = 1_000
# numbers in one block of vectors
BLOCK_NUMBERS = 2_000_000
# cells of one effect level that meet its drawn means in one task
LEVEL_CELLS = 20_000


@dataclass
class Solution:
    """Least-squares solution of one spec; ``kept`` are positions in the fit, reported one first."""

    spec: Spec
    fit: Fit
    kept: list[int]
    inverse: np.ndarray
    beta: np.ndarray
    restricted: np.ndarray

    @property
    def ok(self) -> bool:
        return bool(self.kept) and self.fit.xs[self.kept[0]] == self.spec.key

    @property
    def a(self) -> np.ndarray:
        """Row of the inverse that belongs to the reported coefficient."""
        return self.inverse[0]

    def col(self, index: int, what: str, *more: int) -> str:
        return "_".join([f"q{index}", what, *map(str, more)])


def _scaled_inverse(m: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.diag(m))
    return np.linalg.inv(m / np.outer(scale, scale)) / np.outer(scale, scale)


def _independent(m: np.ndarray, order: Sequence[int]) -> list[int]:
    """Columns with variation left after the earlier ones; later collinear columns are dropped."""
    kept: list[int] = []
    for j in order:
        left = m[j, j]
        if kept:
            sub = m[np.ix_(kept, kept)]
            left = m[j, j] - m[j, kept] @ _scaled_inverse(sub) @ m[kept, j]
        if m[j, j] > 0 and left > COLLINEAR * m[j, j]:
            kept.append(j)
    return kept


def solve(spec: Spec, fit: Fit) -> Solution:
    k, m = fit.k, fit.cross
    raw = np.array([m[j, j] + fit.n * fit.means[j] ** 2 for j in range(k)])
    order = [fit.xs.index(x) for x in spec.xs]
    # variation that is rounding noise next to the size of the values counts as none
    order = [j for j in order if m[j, j] > 1e-20 * max(raw[j], 1e-300)]
    kept = _independent(m, order)
    if not kept:
        return Solution(spec, fit, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    inverse = _scaled_inverse(m[np.ix_(kept, kept)])
    beta = inverse @ m[kept, k]
    restricted = np.zeros(len(kept))
    if len(kept) > 1:
        rest = kept[1:]
        restricted[1:] = _scaled_inverse(m[np.ix_(rest, rest)]) @ m[rest, k]
    return Solution(spec, fit, kept, inverse, beta, restricted)


def _dot(weights: Sequence[float], columns: Sequence[Column]) -> Column:
    total: Column | None = None
    for w, c in zip(weights, columns):
        term = F.lit(float(w)) * c
        total = term if total is None else total + term
    return total if total is not None else F.lit(0.0)


def _cross(f: Fit, i: int, j: int) -> Column:
    return F.col(f.col("s", min(i, j), max(i, j)))


def _dev(f: Fit, j: int) -> Column:
    return F.col(f.col("t", j))


def _score(s: Solution, beta: np.ndarray) -> list[Column]:
    """Per cluster (or cell): sum of regressor times residual, for each kept regressor."""
    f = s.fit
    return [_cross(f, j, f.k) - _dot(beta, [_cross(f, j, m) for m in s.kept]) for j in s.kept]


def _residual_sum(s: Solution, beta: np.ndarray) -> Column:
    return _dev(s.fit, s.fit.k) - _dot(beta, [_dev(s.fit, m) for m in s.kept])


def _cluster_columns(index: int, s: Solution, draws: bool = True) -> list[Column]:
    """What one spec needs from each cluster: scores, restricted scores and projected cross-products.

    Position 0 is the intercept (absent from the algebra when an effect is absorbed).  Without
    bootstrap draws the count and the score are enough.
    """
    f = s.fit
    score = [
        F.col(f.col("n")).alias(s.col(index, "n")),
        _dot(s.a, _score(s, s.beta)).alias(s.col(index, "u")),
    ]
    if not draws:
        return score
    restricted = _score(s, s.restricted)
    intercept = F.lit(0.0) if f.fe else _residual_sum(s, s.restricted)
    projected = [_dot(s.a, [_dev(f, j) for j in s.kept]) if not f.fe else F.lit(0.0)]
    projected += [_dot(s.a, [_cross(f, j, m) for j in s.kept]) for m in s.kept]
    return [
        *score,
        _dot(s.a, restricted).alias(s.col(index, "al")),
        *[c.alias(s.col(index, "w", i)) for i, c in enumerate([intercept, *restricted])],
        *[c.alias(s.col(index, "c", i)) for i, c in enumerate(projected)],
    ]


def cluster_key(columns: Sequence[str]) -> Column:
    """Name of a cluster, different for different tuples of parts; a missing part is a value of its own."""
    text = [F.col(c).cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def text_hash(seed: int, kind: str, text: str) -> int:
    """A number below PRIME for one replication or cluster (first 8 hex digits of an md5)."""
    return int(hashlib.md5(f"{seed}|{kind}|{text}".encode()).hexdigest()[:8], 16) % PRIME


def cluster_hash(seed: int, cluster: Column) -> Column:
    """The same number for a cluster, in the plan: one md5 per cluster, not per draw."""
    digest = F.md5(F.concat(F.lit(f"{seed}|c|"), cluster))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % PRIME


def rep_hashes(seed: int, reps: int) -> list[int]:
    return [text_hash(seed, "r", str(r)) for r in range(1, reps + 1)]


def draw_index(cluster, rep):
    """Which of the six weights a (cluster, replication) pair gets, from their two hashes.

    Three steps of arithmetic modulo a prime; every product stays below 2^63.  Works on numpy arrays,
    on plain integers and on Columns alike, and does not depend on how the data is partitioned.
    """
    x = (cluster * rep + cluster + rep) % PRIME
    x = (x * x + cluster) % PRIME
    x = (x * x + rep) % PRIME
    return x % 6


def _tasks(df: DataFrame, pairs: int) -> int:
    """Tasks for so many (row, replication) pairs: enough for all cores, and for any number of pairs a bounded share each."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(min(pairs // PAIRS_PER_TASK + 1, 2 * cores), pairs // MOST_PAIRS_PER_TASK + 1)


def _weighted_sums(
    table: DataFrame, rows: int, plain: list[Column], linear: list[Column], square: list[Column], reps: int, seed: int
) -> DataFrame:
    """Per replication: sum of w x for the linear columns and of w^2 x for the square ones.

    That is a (replications x clusters) matrix of weights times a (clusters x columns) matrix.  Spark
    spreads the clusters over tasks; each task multiplies its blocks and emits one row per
    replication, and the partial sums are added up by replication.  Replication 0 has weight one
    everywhere and also carries the plain sums.
    """
    chosen = table.select(cluster_hash(seed, F.col("__g")).alias("__ch"), *plain, *linear, *square)
    names = chosen.columns[1:]
    once_end, linear_end = len(plain), len(plain) + len(linear)
    hashes = np.array(rep_hashes(seed, reps), dtype=np.int64)
    weights = np.array(WEBB)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((reps + 1, len(names)))
        for batch in batches:
            values = batch[names].to_numpy(float)
            keys = batch["__ch"].to_numpy(np.int64)
            for at in range(0, len(batch), BLOCK):
                x = values[at : at + BLOCK]
                w = weights[draw_index(keys[None, at : at + BLOCK], hashes[:, None])]
                total[0] += x.sum(axis=0)
                total[1:, once_end:linear_end] += w @ x[:, once_end:linear_end]
                total[1:, linear_end:] += (w * w) @ x[:, linear_end:]
        out = pd.DataFrame(total, columns=names)
        out.insert(0, "__rep", np.arange(reps + 1, dtype=np.int32))
        yield out

    tasks = _tasks(chosen, rows * reps)
    spread = chosen.repartition(tasks) if tasks > 1 else chosen.coalesce(1)
    schema = "__rep int, " + ", ".join(f"{c} double" for c in names)
    parts = spread.mapInPandas(multiply, schema)
    return parts.groupBy("__rep").agg(*[F.sum(c).alias(c) for c in names])


@dataclass
class ClusterResult:
    """Clusters with rows, sum of squared scores, projected cross-products, bootstrap p-value."""

    groups: int
    meat: float
    projected: np.ndarray
    p: float | None = None


def _total_columns(s: Solution, i: int, draws: bool = True) -> list[Column]:
    """What is summed over clusters without weights: clusters, squared scores, projected cross-products."""
    c = [F.col(s.col(i, "c", j)) for j in range(len(s.kept) + 1)] if draws else []
    u = F.col(s.col(i, "u"))
    return [
        (F.col(s.col(i, "n")) > 0).cast("double").alias(s.col(i, "g")),
        (u * u).alias(s.col(i, "uu")),
        *[(c[a] * c[b]).alias(s.col(i, "cc", a, b)) for a in range(len(c)) for b in range(a, len(c))],
    ]


def _draw_columns(s: Solution, i: int) -> tuple[list[Column], list[Column]]:
    """What is summed with weights w, and with w squared, in every replication."""
    alpha = F.col(s.col(i, "al"))
    linear = []
    for j in range(len(s.kept) + 1):
        linear += [
            F.col(s.col(i, "w", j)).alias(s.col(i, "P", j)),
            (alpha * F.col(s.col(i, "c", j))).alias(s.col(i, "R", j)),
        ]
    return linear, [(alpha * alpha).alias(s.col(i, "Q"))]


def _read_totals(
    row, solutions: Sequence[Solution], picked: Sequence[int], draws: bool = True
) -> list[ClusterResult]:
    out = []
    for i in picked:
        s = solutions[i]
        m = np.zeros((len(s.kept) + 1 if draws else 0,) * 2)
        for a in range(m.shape[0]):
            for b in range(a, m.shape[0]):
                m[a, b] = m[b, a] = row[s.col(i, "cc", a, b)] or 0.0
        out.append(ClusterResult(int(round(row[s.col(i, "g")] or 0)), float(row[s.col(i, "uu")] or 0.0), m))
    return out


def _cluster_totals(
    table: DataFrame, solutions: Sequence[Solution], picked: Sequence[int], draws: bool
) -> list[ClusterResult]:
    columns = [c for i in picked for c in _total_columns(solutions[i], i, draws)]
    wide = table.select(*columns)
    return _read_totals(wide.agg(*[F.sum(c).alias(c) for c in wide.columns]).first(), solutions, picked, draws)


def _p_values(draws: pd.DataFrame, solutions: Sequence[Solution], picked: Sequence[int], results: Sequence[ClusterResult]) -> None:
    """Share of replications whose |t| exceeds the observed one.

    ``draws`` has one row of sums per replication.  Squares are compared, and the small-sample factor
    is left out because it is the same on both sides.
    """
    for i, result in zip(picked, results):
        s = solutions[i]
        if result.meat <= 0:
            continue
        size = len(s.kept) + 1
        sums = draws[[s.col(i, "P", j) for j in range(size)]].to_numpy(float)
        mixed = draws[[s.col(i, "R", j) for j in range(size)]].to_numpy(float)
        d = np.c_[sums[:, 0] / s.fit.n, sums[:, 1:] @ s.inverse.T]
        square = draws[s.col(i, "Q")].to_numpy(float)
        variance = square - 2 * (d * mixed).sum(axis=1) + np.einsum("ra,ab,rb->r", d, result.projected, d)
        observed = s.beta[0] ** 2 / result.meat
        result.p = float(np.mean((variance > 0) & (d[:, 1] ** 2 > observed * (1 + TIE) * variance)))


def _bootstrap_plain(
    table: DataFrame, rows: int, solutions: Sequence[Solution], picked: Sequence[int], reps: int, seed: int
) -> list[ClusterResult]:
    """Cluster totals and all replications of all specs in one pass over the cluster table."""
    plain, linear, square = [], [], []
    for i in picked:
        more_linear, more_square = _draw_columns(solutions[i], i)
        plain += _total_columns(solutions[i], i)
        linear += more_linear
        square += more_square
    sums = _weighted_sums(table, rows, plain, linear, square, reps, seed).toPandas().set_index("__rep")
    results = _read_totals(sums.loc[0], solutions, picked)
    _p_values(sums.drop(index=0), solutions, picked, results)
    return results


def _run_sums(pieces: Iterator[tuple[np.ndarray, np.ndarray]], key: str) -> Iterator[pd.DataFrame]:
    """Add up the vectors of neighbouring rows with the same key; one row per run, the vector as bytes."""
    held, total = None, None
    for keys, vectors in pieces:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sums = np.add.reduceat(vectors, starts, axis=0)
        names = keys[starts]
        if total is not None:
            if held == names[0]:
                sums[0] += total
            else:
                yield pd.DataFrame({key: [held], "__x": [total.tobytes()]})
        yield pd.DataFrame({key: names[:-1], "__x": [v.tobytes() for v in sums[:-1]]})
        held, total = names[-1], sums[-1].copy()
    if total is not None:
        yield pd.DataFrame({key: [held], "__x": [total.tobytes()]})


def _blocks(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    rows = max(1, BLOCK_NUMBERS // width)
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def _stacked(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=float).reshape(len(column), -1)


def _sum_vectors(parts: DataFrame, key: str, width: int) -> DataFrame:
    """One vector per key from partial sums; a key has at most one partial sum per task that made them."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _run_sums(((b[key].to_numpy(object), _stacked(b["__x"])) for b in _blocks(batches, width)), key)

    return parts.repartition(key).sortWithinPartitions(key).mapInPandas(add, f"{key} string, __x binary")


def _bootstrap_absorbed(
    cells: DataFrame,
    rows: int,
    fe: Sequence[str],
    cluster: Sequence[str],
    solutions: Sequence[Solution],
    picked: Sequence[int],
    results: Sequence[ClusterResult],
    reps: int,
    seed: int,
) -> None:
    """The same with an absorbed effect: drawn residuals have to be demeaned again in every draw.

    Works on (effect, cluster) cells; all replications of a cell are one vector.  First the drawn means of each
    effect level are added up, then every cell takes its share of its level's means and these are added up by cluster.
    Each sum is made within tasks first, so what is shuffled is at most one row per cell, and a very large
    level or cluster reaches one task as one row per task.  The cells of a large level are split to meet its means.
    """
    summed, greatest = [], []
    for i in picked:
        s = solutions[i]
        f = s.fit
        chosen = _cluster_columns(i, s)
        summed += [
            _residual_sum(s, s.restricted).alias(s.col(i, "e")),
            _dot(s.a, [_dev(f, j) for j in s.kept]).alias(s.col(i, "at")),
            *chosen,
        ]
        greatest.append(F.col(f.col("ng")).alias(s.col(i, "ng")))
    base = cells.select(cluster_key(fe).alias("__f"), cluster_key(cluster).alias("__g"), *summed, *greatest)
    sizes = [s.col(i, "ng") for i, s in ((i, solutions[i]) for i in picked)]
    base = base.groupBy("__f", "__g").agg(
        *[F.sum(c).alias(c) for c in base.columns[2:] if c not in sizes], *[F.max(c).alias(c) for c in sizes]
    )
    per_row = [F.try_divide(F.lit(1.0), F.col(c)).alias(f"{c}_inv") for c in sizes]
    tasks = _tasks(base, rows * reps)
    base = base.select(cluster_hash(seed, F.col("__g")).alias("__ch"), "*", *per_row).fillna(0.0)
    base = materialize(base.repartition(tasks, "__f", "__g"))

    hashes = np.array(rep_hashes(seed, reps), dtype=np.int64)
    weights = np.array(WEBB)
    m = len(picked)
    width = m * reps
    e = [solutions[i].col(i, "e") for i in picked]
    inverse = [f"{c}_inv" for c in sizes]
    at_names = [solutions[i].col(i, "at") for i in picked]
    # what the last step needs of a cluster beside the vectors: per spec al, then w and c by position
    more = [
        [s.col(i, "al"), *[s.col(i, "w", j) for j in range(len(s.kept) + 1)], *[s.col(i, "c", j) for j in range(len(s.kept) + 1)]]
        for i, s in ((i, solutions[i]) for i in picked)
    ]
    scalars = [c for names in more for c in names]

    def drawn(keys: pd.Series) -> np.ndarray:
        return weights[draw_index(keys.to_numpy(np.int64)[:, None], hashes[None, :])]

    def level_means(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pieces():
            for b in _blocks(batches, width):
                shares = b[e].to_numpy(float) * b[inverse].to_numpy(float)
                yield b["__f"].to_numpy(object), (shares[:, :, None] * drawn(b["__ch"])[:, None, :]).reshape(len(b), width)

        yield from _run_sums(pieces(), "__f")

    partial = base.select("__f", "__ch", *e, *inverse).sortWithinPartitions("__f").mapInPandas(level_means, "__f string, __x binary")
    means = _sum_vectors(partial, "__f", width)

    counts = base.groupBy("__f").agg(F.count(F.lit(1)).alias("__n"))
    counts = materialize(counts.withColumn("__split", F.ceil(F.col("__n") / LEVEL_CELLS).cast("int")))
    split = join_per_key(base.select("__f", "__g", "__ch", *at_names, *scalars), counts, ["__f"], "__n")
    split = split.withColumn("__at", F.pmod(F.col("__ch"), F.col("__split")).cast("int"))
    copies = means.join(counts, "__f").select("__f", "__x", F.explode(F.sequence(F.lit(0), F.col("__split") - 1)).alias("__at"))

    def cluster_shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pieces():
            for b in _blocks(batches, width):
                mu = _stacked(b["__x"]).reshape(len(b), m, reps) * b[at_names].to_numpy(float)[:, :, None]
                yield b["__g"].to_numpy(object), np.c_[b[scalars].to_numpy(float), mu.reshape(len(b), width)]

        yield from _run_sums(pieces(), "__g")

    met = split.join(copies, ["__f", "__at"]).select("__g", "__x", *at_names, *scalars).sortWithinPartitions("__g")
    shares = _sum_vectors(met.mapInPandas(cluster_shares, "__g string, __x binary"), "__g", width + len(scalars))
    outputs = [
        [s.col(i, "Q"), *[s.col(i, what, j) for what in "PR" for j in range(len(s.kept) + 1)]]
        for i, s in ((i, solutions[i]) for i in picked)
    ]
    names = [c for columns in outputs for c in columns]

    def replications(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(names), reps))
        for b in _blocks(batches, width):
            w, x = drawn(b["__ch"]), _stacked(b["__x"])
            mu = x[:, len(scalars) :].reshape(len(b), m, reps)
            at, to = 0, 0
            for k, own in enumerate(more):
                size = (len(own) - 1) // 2
                z = w * x[:, at, None] - mu[:, k]
                total[to] += (z * z).sum(axis=0)
                total[to + 1 : to + 1 + size] += x[:, at + 1 : at + 1 + size].T @ w
                total[to + 1 + size : to + 1 + 2 * size] += x[:, at + 1 + size : at + 1 + 2 * size].T @ z
                at, to = at + len(own), to + 1 + 2 * size
        out = pd.DataFrame(total.T, columns=names)
        out.insert(0, "__rep", np.arange(1, reps + 1, dtype=np.int32))
        yield out

    schema = "__rep int, " + ", ".join(f"{c} double" for c in names)
    parts = shares.select(cluster_hash(seed, F.col("__g")).alias("__ch"), "__x").mapInPandas(replications, schema)
    draws = parts.groupBy("__rep").agg(*[F.sum(c).alias(c) for c in names])
    _p_values(draws.toPandas(), solutions, picked, results)


def _hc1_sums(df: DataFrame, solutions: Sequence[Solution], picked: Sequence[int], cells: DataFrame) -> dict[int, float]:
    """Sum over rows of (projected regressor x residual)^2, per spec.

    Without absorbed effects this is one scan without a shuffle.  With them the group means are
    joined to the rows by a join that keeps very large groups out of the shuffle.
    """
    out: dict[int, float] = {}
    for fe in sorted({solutions[i].fit.fe for i in picked}):
        group = [i for i in picked if solutions[i].fit.fe == fe]
        fits = list({solutions[i].fit.index: solutions[i].fit for i in group}.values())
        rows = masked_variables(df, fits, list(fe))
        if fe:
            counts = [F.sum(f.col("n")).alias(f.col("k")) for f in fits]
            sums = [
                F.try_divide(F.sum(F.col(f.col("n")) * F.col(f.col("m", j))), F.sum(f.col("n"))).alias(f.col("g", j))
                for f in fits
                for j in range(f.k + 1)
            ]
            means = cells.groupBy(*fe).agg(*counts, *sums)
            largest = F.greatest(*[F.col(f.col("k")) for f in fits]) if len(fits) > 1 else F.col(fits[0].col("k"))
            means = materialize(means.withColumn("__rows", largest).drop(*[f.col("k") for f in fits]))
            rows = join_per_key(rows, means, list(fe), "__rows")
        aggs = []
        for i in group:
            s = solutions[i]
            f = s.fit
            centre = [F.col(f.col("g", j)) if fe else F.lit(float(f.means[j])) for j in range(f.k + 1)]
            dev = [F.col(f.col("v", j)) - centre[j] for j in range(f.k + 1)]
            residual = dev[f.k] - _dot(s.beta, [dev[j] for j in s.kept])
            aggs.append(F.sum((_dot(s.a, [dev[j] for j in s.kept]) * residual) ** 2).alias(f"h{i}"))
        row = rows.agg(*aggs).first()
        out.update({i: float(row[f"h{i}"] or 0.0) for i in group})
    return out


def _root(value: float) -> float | None:
    return float(np.sqrt(value)) if value > 0 and np.isfinite(value) else None


def _effect_levels(cells: DataFrame, fits: Sequence[Fit], clusters: Mapping[str, Sequence[str]]) -> None:
    """Set the number of levels of each fit's absorbed effect, and the cluster levels it is nested in.

    An effect is nested when each of its levels has one cluster only: the least and the greatest
    cluster of the level are the same.  One grouping of the cell table answers it for all cluster levels.
    """
    for fe in sorted({f.fe for f in fits if f.fe}):
        same = [f for f in fits if f.fe == fe]
        per_level, totals = [], []
        for f in same:
            n = F.col(f.col("n"))
            per_level.append(F.sum(n).alias(f.col("n")))
            totals.append(F.count_if(n > 0).alias(f.col("n")))
            for i, keys in enumerate(clusters.values()):
                lo, hi = f.col("lo", i), f.col("hi", i)
                present = F.when(n > 0, cluster_key(keys))
                per_level += [F.min(present).alias(lo), F.max(present).alias(hi)]
                totals.append(F.count_if(F.col(lo) != F.col(hi)).alias(f.col("split", i)))
        row = cells.groupBy(*fe).agg(*per_level).agg(*totals).first()
        for f in same:
            f.levels = int(row[f.col("n")])
            f.nested = frozenset(c for i, c in enumerate(clusters) if row[f.col("split", i)] == 0)


def regress(
    df: DataFrame,
    specs: Sequence[Spec],
    clusters: Mapping[str, Sequence[str]],
    bootstrap: Sequence[str] | None = None,
    reps: int = 999,
    seed: int = 42,
    fe_dof: str = "nested",
    hc1: bool = True,
    missing_clusters: str = "level",
) -> list[dict]:
    """Coefficient, standard errors and bootstrap p-values of each spec, as plain records.

    A spec with fewer than ``min_n`` complete rows is left out.  A regressor without variation, a
    single cluster, or a failed fit gives NULL instead of a number.

    ``fe_dof`` says which levels of an absorbed effect count as parameters in the clustered error:
    ``all``, ``none``, or all unless the effect is ``nested`` in the clusters.  ``missing_clusters``
    says what a row without some part of a cluster key is: ``level``, one of a cluster of such rows,
    or ``drop``, left out of every spec, as are rows without the absorbed effect's key.  The rows are
    the same for all cluster levels of a call, so a coefficient and all its errors belong together;
    ``Spec.complete`` asks for columns spec by spec.
    """
    if fe_dof not in ("all", "none", "nested"):
        raise ValueError("fe_dof must be all, none or nested")
    if missing_clusters not in ("level", "drop"):
        raise ValueError("missing_clusters must be level or drop")
    levels = list(clusters)
    bootstrap = levels if bootstrap is None else list(bootstrap)
    if missing_clusters == "drop":
        keys = [c for level in levels for c in clusters[level]]
        specs = [replace(s, complete=(*s.complete, *keys, *s.fe)) for s in specs]
    fits, which, raw_cells, cells, sizes = fit_moments(df, specs, [clusters[c] for c in levels])
    _effect_levels(cells, fits, clusters)
    solutions = [solve(s, fits[w]) for s, w in zip(specs, which)]
    reported = [i for i, s in enumerate(solutions) if s.fit.n >= s.spec.min_n and s.fit.n > 0]
    usable = [i for i in reported if solutions[i].ok]
    records: dict[int, dict] = {}
    for i in reported:
        s = solutions[i]
        records[i] = {
            "spec": s.spec.label,
            "outcome": s.spec.y,
            "key_predictor": s.spec.key,
            "n_obs": s.fit.n,
            "beta": float(s.beta[0]) if s.ok else None,
            "se_hc1": None,
        }
        for c in levels:
            records[i].update({f"n_clusters_{c}": None, f"se_{c}": None, f"p_boot_{c}": None})
    if hc1 and usable:
        for i, meat in _hc1_sums(df, solutions, usable, raw_cells).items():
            s = solutions[i]
            params = len(s.kept) + (s.fit.levels if s.fit.fe else 1)
            if s.fit.n > params:
                records[i]["se_hc1"] = _root(s.fit.n / (s.fit.n - params) * meat)
    for c in levels if usable else []:
        keys = list(clusters[c])
        for fe in sorted({solutions[i].fit.fe for i in usable}):
            picked = [i for i in usable if solutions[i].fit.fe == fe]
            own = list({solutions[i].fit.index: solutions[i].fit for i in picked}.values())
            wanted = c in bootstrap
            table = roll_up(cells, own, keys).select(
                cluster_key(keys).alias("__g"), *[x for i in picked for x in _cluster_columns(i, solutions[i], wanted)]
            )
            if wanted and not fe:
                results = _bootstrap_plain(table, sizes[levels.index(c)], solutions, picked, reps, seed)
            else:
                results = _cluster_totals(table, solutions, picked, wanted)
            if wanted and fe:
                _bootstrap_absorbed(cells, sizes[-1], list(fe), keys, solutions, picked, results, reps, seed)
            for i, r in zip(picked, results):
                s = solutions[i]
                counted = fe_dof == "all" or (fe_dof == "nested" and c not in s.fit.nested)
                extra = s.fit.levels if s.fit.fe and counted else 1
                n, params = s.fit.n, len(s.kept) + extra
                records[i][f"n_clusters_{c}"] = r.groups
                if r.groups >= 2 and n > params:
                    factor = r.groups / (r.groups - 1) * (n - 1) / (n - params)
                    records[i][f"se_{c}"] = _root(factor * r.meat)
                if records[i][f"se_{c}"] is not None:
                    records[i][f"p_boot_{c}"] = r.p
    return [records[i] for i in reported]


def result_schema(levels: Sequence[str]) -> T.StructType:
    fields = [
        T.StructField("spec", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("key_predictor", T.StringType()),
        T.StructField("n_obs", T.LongType()),
        T.StructField("beta", T.DoubleType()),
        T.StructField("se_hc1", T.DoubleType()),
    ]
    for c in levels:
        fields += [
            T.StructField(f"n_clusters_{c}", T.LongType()),
            T.StructField(f"se_{c}", T.DoubleType()),
            T.StructField(f"p_boot_{c}", T.DoubleType()),
        ]
    return T.StructType(fields)


def inference_table(
    df: DataFrame,
    specs: Sequence[Spec],
    clusters: Mapping[str, Sequence[str]],
    bootstrap: Sequence[str] | None = None,
    reps: int = 999,
    seed: int = 42,
    crit: float = 1.96,
    alpha: float = 0.05,
    fe_dof: str = "nested",
    missing_clusters: str = "level",
) -> DataFrame:
    """One row per spec: coefficient, errors, t values, bootstrap p-values and significance flags.

    A missing error or p-value counts as not significant; ``boot_failed`` tells the two apart.
    """
    levels = list(clusters)
    records = regress(df, specs, clusters, bootstrap, reps, seed, fe_dof, missing_clusters=missing_clusters)
    out = df.sparkSession.createDataFrame(records, result_schema(levels))
    booted = levels if bootstrap is None else list(bootstrap)
    columns: dict[str, Column] = {}
    for name in ["hc1", *levels]:
        t = F.try_divide(F.col("beta"), F.col(f"se_{name}"))
        columns[f"t_{name}"] = t
        columns[f"sig_{name}"] = F.coalesce(F.abs(t) > crit, F.lit(False))
    for name in booted:
        columns[f"sig_boot_{name}"] = F.coalesce(F.col(f"p_boot_{name}") < alpha, F.lit(False))
    failed = F.lit(False)
    for name in booted:
        failed = failed | F.col(f"p_boot_{name}").isNull()
    columns["boot_failed"] = failed
    out = out.withColumns(columns)
    return out.drop(*[f"p_boot_{c}" for c in levels if c not in booted])


def verdict(df: DataFrame, hc1: str, cluster: str, boot: str) -> DataFrame:
    """ROBUST, FRAGILE, Not sig or Mixed, from three significance flags."""
    h, c, b = F.col(hc1), F.col(cluster), F.col(boot)
    return df.withColumn(
        "verdict",
        F.when(h & c & b, "ROBUST").when(h & ~b, "FRAGILE").when(~h, "Not sig").otherwise("Mixed"),
    )


def significance_code(df: DataFrame, flags: Mapping[str, str], name: str = "sig_code") -> DataFrame:
    """One letter per flag that holds and a dash per flag that does not, e.g. ``HV--s``."""
    return df.withColumn(name, F.concat(*[F.when(F.col(f), letter).otherwise("-") for f, letter in flags.items()]))


def survivors(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Results significant under every method."""
    out = df
    for f in flags:
        out = out.where(F.col(f))
    return out


def fragile(df: DataFrame, hc1: str, boots: Sequence[str], p_values: Sequence[str] = ()) -> DataFrame:
    """Significant with robust errors but not under some bootstrap; failed bootstraps can be left out."""
    lost = F.lit(False)
    for b in boots:
        lost = lost | ~F.col(b)
    out = df.where(F.col(hc1) & lost)
    for p in p_values:
        out = out.where(F.col(p).isNotNull())
    return out


def flip_summary(df: DataFrame, base: str, others: Sequence[str]) -> DataFrame:
    """How many results each method finds significant, and how many the base method alone does."""
    wide = df.agg(
        F.count(F.lit(1)).alias("n_specs"),
        *[F.count_if(F.col(c)).alias(f"s_{c}") for c in [base, *others]],
        F.lit(0).cast("long").alias(f"f_{base}"),
        *[F.count_if(F.col(base) & ~F.col(c)).alias(f"f_{c}") for c in others],
    )
    rows = [
        F.struct(F.lit(c).alias("method"), F.col(f"s_{c}").alias("n_significant"), F.col(f"f_{c}").alias("n_flips"))
        for c in [base, *others]
    ]
    return wide.select("n_specs", F.explode(F.array(*rows)).alias("r")).select("r.method", "n_specs", "r.n_significant", "r.n_flips")


def outcome_specs(
    df: DataFrame, outcomes: Mapping[str, str], treatment: str, min_n: int = 100
) -> list[Spec]:
    """The same binary treatment on many outcomes; outcomes the table lacks are skipped."""
    return [Spec(label, y, (treatment,), min_n=min_n) for y, label in outcomes.items() if y in df.columns]


def tidy(df: DataFrame, ids: Sequence[str], columns: Mapping[str, str], name: str, value: str) -> DataFrame:
    """Long form of some columns, relabelled, with the order of the labels and the absolute value."""
    long = df.unpivot(list(ids), list(columns), name, value)
    label, order = None, None
    for i, (c, text) in enumerate(columns.items(), 1):
        hit = F.col(name) == c
        label = F.when(hit, text) if label is None else label.when(hit, text)
        order = F.when(hit, i) if order is None else order.when(hit, i)
    return long.withColumns({name: label, f"{name}_order": order, "size": F.abs(value)})
