"""Variances of two crossed random factors by restricted maximum likelihood.

With scales ``x`` (larger factor) and ``t`` (smaller factor), variances in units of the residual's, the larger factor is
eliminated level by level: its block is diagonal.  A level with ``n`` rows leaves the weight
``1 / (n (1 + x n))`` beside the deviations within the level, which do not depend on ``x``.  All sums are
written in these weights, which lie between 0 and ``1 / n``, so nothing cancels at any scale; what belongs to the
deviations within levels is added up once, from deviations.  The eigenvalues ``d`` of the matrix that remains, of the
size of the smaller factor, then give the criterion and its derivatives for all ``t`` as plain sums.

Spark adds up the matrices for a whole grid of ``x`` in one pass over the cells.  The search first finds the lowest
point of a wide grid, then follows the sign of the derivative, and ends when a step changes the scale by less than the
tolerance and both neighbours are higher.  Values that are not finite are an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Numbers in the matrices that one pass adds up in a task: 128 MB
PASS_VALUES = 16_000_000
DECADES = 14
# Numbers of a matrix in one shuffled row
PIECE = 50_000
ROWS = "k int, i int, row array<double>"
_SCALARS = ("log_d", "n_w", "s_w", "ss_w", "nn_v", "ns_v", "ss_v")


@dataclass
class Within:
    """What does not depend on the scales: sums of deviations within levels of the larger factor."""

    laplacian: np.ndarray
    rhs: np.ndarray
    ss: float
    n: int
    levels: int
    total: float
    shift: np.ndarray


@dataclass
class Sums:
    """Sums over levels of the larger factor at one scale, with w = 1 / (1 + x n) and v = w squared.

    With the counts c of a level by the smaller factor: ``a`` adds up c c' w / n, ``b`` adds up c c' v; ``s`` and ``bs`` add up c
    times the level's sum, with w / n and v.
    """

    a: np.ndarray
    b: np.ndarray
    s: np.ndarray
    bs: np.ndarray
    log_d: float
    n_w: float
    s_w: float
    ss_w: float
    nn_v: float
    ns_v: float
    ss_v: float


def dense(part: pd.DataFrame, size: int, shift: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of levels: counts and deviations by level of the smaller factor, and the levels' sums.

    ``shift`` is taken off the outcome, a number for each level of the smaller factor.
    """
    lengths = part["i"].str.len().to_numpy()
    row = np.repeat(np.arange(len(part)), lengths)
    col = np.concatenate(part["i"].to_numpy())
    counts, off = np.zeros((len(part), size)), np.zeros((len(part), size))
    n, s = np.concatenate(part["cn"].to_numpy()).astype(float), np.concatenate(part["cs"].to_numpy())
    if shift is not None:
        s = s - n * shift[col]
    sums = np.bincount(row, s, len(part))
    counts[row, col] = n
    off[row, col] = s - n * np.repeat(sums / part["n"].to_numpy(float), lengths)
    return counts, off, sums


def stretches(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    step = max(1, 2_000_000 // max(size, 1))
    for batch in batches:
        for at in range(0, len(batch), step):
            yield batch.iloc[at : at + step]


def piecewise(k: int, matrix: np.ndarray, scalars: list[float]) -> list[tuple]:
    """A matrix in pieces of some rows each, and its scalars as piece -1."""
    flat = matrix.ravel()
    pieces = [(k, i, flat[at : at + PIECE].tolist()) for i, at in enumerate(range(0, len(flat), PIECE))]
    return [*pieces, (k, -1, [float(x) for x in scalars])]


def added(parts: DataFrame, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The tasks' matrices of ``size`` columns, and their scalars, added up piece by piece."""

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "i": [key[1]], "row": [np.sum(np.stack(rows["row"].to_numpy()), axis=0)]})

    summed = parts.groupBy("k", "i").applyInPandas(add, ROWS)
    found = {(r["k"], r["i"]): r["row"] for r in summed.collect()}
    out = []
    for k in range(1 + max(k for k, _ in found)):
        pieces = [np.array(found[k, i]) for i in range(sum(1 for x in found if x[0] == k) - 1)]
        out.append((np.concatenate(pieces).reshape(-1, size), np.array(found[k, -1])))
    return out


def spread(levels: DataFrame, values: int) -> DataFrame:
    """As many tasks as their matrices stay under a bound together; every core has one."""
    cores = levels.sparkSession.sparkContext.defaultParallelism
    return levels.coalesce(max(cores, 500_000_000 // max(values, 1)))


def within(levels: DataFrame, size: int, shift: np.ndarray) -> Within:
    """One pass over ``levels``: rows (n, w, i, cn, cs) of the larger factor's levels with their cells."""

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rhs, ss, n, k, all_ss = np.zeros((size, size)), np.zeros(size), 0.0, 0.0, 0, 0.0
        for part in stretches(batches, size):
            counts, off, s = dense(part, size, shift)
            rows = part["n"].to_numpy(float)
            total += counts.T @ (counts / rows[:, None])
            rhs += off.sum(0)
            some = counts > 0
            ss += part["w"].sum() + (off[some] ** 2 / counts[some]).sum()
            n, k, all_ss = n + rows.sum(), k + len(rows), all_ss + float((s * s / rows).sum())
        yield pd.DataFrame(piecewise(0, np.vstack([total, rhs]), [ss, n, k, all_ss]), columns=["k", "i", "row"])

    [(found, (ss, n, k, all_ss))] = added(spread(levels, size * size).mapInPandas(add_up, ROWS), size)
    shared, rhs = found[:-1].copy(), found[-1]
    # rows of a Laplacian add up to zero: its diagonal follows from the rest without subtracting like numbers
    np.fill_diagonal(shared, 0.0)
    return Within(np.diag(shared.sum(1)) - shared, rhs, float(ss), int(n), int(k), float(ss + all_ss), shift)


def sums(levels: DataFrame, size: int, scales: Sequence[float], shift: np.ndarray) -> list[Sums]:
    """One pass over the levels of the larger factor for several of its scales."""
    grid = list(scales)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(grid), 2 * size + 2, size))
        scalars = np.zeros((len(grid), len(_SCALARS)))
        for part in stretches(batches, size):
            counts, _, s = dense(part, size, shift)
            n = part["n"].to_numpy(float)
            for k, x in enumerate(grid):
                w = 1.0 / (1.0 + x * n)
                v = w * w
                total[k, :size] += counts.T @ (counts * (w / n)[:, None])
                total[k, size : 2 * size] += counts.T @ (counts * v[:, None])
                total[k, -2] += counts.T @ (s * w / n)
                total[k, -1] += counts.T @ (s * v)
                scalars[k] += [
                    np.log1p(x * n).sum(), (n * w).sum(), (s * w).sum(), (s * s * w / n).sum(),
                    (n * n * v).sum(), (n * s * v).sum(), (s * s * v).sum(),
                ]
        rows = [r for k in range(len(grid)) for r in piecewise(k, total[k], scalars[k])]
        yield pd.DataFrame(rows, columns=["k", "i", "row"])

    parts = spread(levels, len(grid) * 2 * size * (size + 1)).mapInPandas(add_up, ROWS)
    return [Sums(m[:size], m[size : 2 * size], m[-2], m[-1], *map(float, rest)) for m, rest in added(parts, size)]


class Profile:
    """The criterion along the smaller factor's scale ``t``, at one scale of the larger factor."""

    def __init__(self, fixed: Within, at: Sums):
        self.at, self.free = at, fixed.n - 1
        d, u = np.linalg.eigh(fixed.laplacian + at.a)
        self.d, self.u = np.maximum(d, 0.0), u
        self.c = u.sum(0)
        # squares left when the smaller factor is fixed; the effects taken off beforehand leave little to subtract
        rho = u.T @ (fixed.rhs + at.s)
        some = self.d > 1e-15 * max(self.d.max(initial=0.0), 1e-300)
        rho_d = np.where(some, rho / np.where(some, self.d, 1.0), 0.0)
        self.left = max(fixed.ss + at.ss_w - float(rho @ rho_d), 0.0)
        self.shift = fixed.shift
        self.rho_d = rho_d + u.T @ fixed.shift
        self.rho = rho + self.d * (u.T @ fixed.shift)
        self.noise = 1e-24 * fixed.total

    def parts(self, t: float) -> tuple[float, float, float, np.ndarray]:
        """1'V1, mean, squares left, and the shrinkage of each eigenvector."""
        shrink = 1.0 / (1.0 + t * self.d)
        z, x = self.c * np.sqrt(self.d * shrink), self.rho_d * np.sqrt(self.d * shrink)
        q11 = float(z @ z)
        mean = float(z @ x) / q11
        rest = x - z * mean
        return q11, mean, self.left + float(rest @ rest), shrink

    def criterion(self, t: float) -> float:
        return float(self.criteria(np.array([t]))[0])

    def criteria(self, grid: np.ndarray) -> np.ndarray:
        """The criterion for many t at once."""
        turned = 1.0 + np.outer(grid, self.d)
        z, x = self.c * np.sqrt(self.d / turned), self.rho_d * np.sqrt(self.d / turned)
        q11 = (z * z).sum(1)
        rest = x - z * ((z * x).sum(1) / q11)[:, None]
        r2 = self.left + (rest * rest).sum(1)
        if r2.min() <= self.noise:
            raise ValueError("nothing is left for the residual: both factors explain the outcome exactly")
        values = self.at.log_d + np.log(turned).sum(1) + np.log(q11) + self.free * np.log(r2)
        if not np.isfinite(values).all():
            raise ValueError("the likelihood is not finite: the levels do not determine both variances")
        return values

    def slope(self, t: float) -> float:
        """Derivative of the criterion by t."""
        q11, mean, r2, shrink = self.parts(t)
        pulled = (self.rho - self.d * self.c * mean) * shrink
        ones = float(((self.d * self.c * shrink) ** 2).sum())
        return float((self.d * shrink).sum()) - ones / q11 - self.free * float(pulled @ pulled) / r2

    def best(self) -> float:
        """The lowest t: 0, or where the slope vanishes next to the lowest point of a wide grid."""
        unit = 1.0 / max(float(self.d.max(initial=0.0)), 1e-300)
        grid = np.r_[0.0, unit * np.geomspace(10.0**-DECADES, 10.0**DECADES, 16 * DECADES + 1)]
        k = int(np.argmin(self.criteria(grid)))
        lo, hi = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
        if self.slope(lo) >= 0:
            return float(lo)
        for _ in range(200):
            mid = np.sqrt(lo * hi) if lo > 0 else hi / 2
            if not lo < mid < hi or hi - lo <= 1e-13 * hi:
                break
            lo, hi = (mid, hi) if self.slope(mid) < 0 else (lo, mid)
        return float((lo + hi) / 2)

    def slope_of_larger(self, t: float) -> float:
        """Derivative of the criterion by the larger factor's scale, at this t."""
        at = self.at
        q11, mean, r2, shrink = self.parts(t)
        inverse = (self.u * shrink) @ self.u.T
        z = inverse.sum(1)
        # what is left of each level: its sum less its counts times the mean and the smaller factor's effects
        fitted = mean + t * (self.u @ ((self.rho - self.d * self.c * mean) * shrink))
        fitted = fitted - self.shift
        residual = at.ss_v - 2 * float(fitted @ at.bs) + float(fitted @ at.b @ fitted)
        return at.n_w - t * float((inverse * at.b).sum()) - float(z @ at.b @ z) / q11 - self.free * max(residual, 0.0) / r2


@dataclass
class Point:
    x: float
    t: float
    value: float
    slope: float
    residual: float


def evaluate(levels: DataFrame, fixed: Within, scales: Sequence[float]) -> list[Point]:
    """The criterion at the best t for each scale of the larger factor, with its derivative by that scale."""
    size, out = len(fixed.rhs), []
    step = max(1, PASS_VALUES // (2 * size * (size + 1)))
    for at in range(0, len(scales), step):
        for x, found in zip(scales[at : at + step], sums(levels, size, scales[at : at + step], fixed.shift)):
            p = Profile(fixed, found)
            t = p.best()
            out.append(Point(float(x), t, p.criterion(t), p.slope_of_larger(t), p.parts(t)[2] / p.free))
    return out


def optimum(levels: DataFrame, size: int, tolerance: float = 1e-9, rounds: int = 12) -> tuple[Point, bool]:
    """The lowest point over both scales, and whether it is verified.

    It is verified when the derivative changes its sign within ``tolerance`` of it, or is not negative at scale 0, and no other
    point seen is lower.
    """
    whole = within(levels, size, np.zeros(size))
    # the smaller factor's effects as if both factors were fixed
    shift = np.linalg.pinv(whole.laplacian, rcond=1e-10, hermitian=True) @ whole.rhs
    fixed = replace(within(levels, size, shift), total=whole.total)
    unit = fixed.levels / max(fixed.n, 1)
    seen = evaluate(levels, fixed, [0.0, *(unit * np.geomspace(10.0**-DECADES, 10.0**DECADES, 2 * DECADES + 1))])
    for _ in range(rounds):
        seen.sort(key=lambda p: p.x)
        k = min(range(len(seen)), key=lambda i: seen[i].value)
        best = seen[k]
        lowest = best.value + 1e-9 * (1 + abs(best.value))
        if best.x == 0 and best.slope >= 0:
            return best, True
        lo, hi = (seen[k], seen[k + 1] if k + 1 < len(seen) else None) if best.slope < 0 else (seen[k - 1], seen[k])
        if hi is None:
            raise ValueError("nothing is left for the residual: both factors explain the outcome exactly")
        if lo.slope >= 0 or hi.slope < 0:  # rounding near the optimum: the slopes at hand decide
            signs = [i for i in range(len(seen) - 1) if seen[i].slope < 0 <= seen[i + 1].slope and seen[i].value <= lowest]
            if not signs:
                return best, abs(best.slope * best.x) <= 1e-6
            lo, hi = seen[signs[0]], seen[signs[0] + 1]
        if hi.x - lo.x <= tolerance * hi.x:
            return min((lo, hi), key=lambda p: abs(p.slope)), True
        # the root of the line through both slopes, points close around it, and the middle
        root = lo.x + (hi.x - lo.x) * lo.slope / (lo.slope - hi.slope)
        middle = np.sqrt(lo.x * hi.x) if lo.x > 0 else hi.x / 2
        near = [root * (1 + sign * 10.0**-k) for k in (2, 4, 6, 8, 10) for sign in (-1, 1)]
        spread = list(np.linspace(lo.x, hi.x, 6)[1:-1])
        grid = sorted({float(x) for x in [root, middle, *near, *spread] if lo.x < x < hi.x})
        if not grid:
            return min((lo, hi), key=lambda p: abs(p.slope)), True
        seen += evaluate(levels, fixed, grid)
    return min(seen, key=lambda p: p.value), False
