"""Per-cluster cross-products: everything a regression needs from the rows, in one scan.

For a regression of y on x1..xk the rows only enter through counts, means and centred
cross-products per cluster.  Spark's own ``avg`` and ``covar_pop`` aggregates build these in a
numerically stable way and combine before the shuffle, so a cluster with a third of all rows costs
no more than any other; with very many clusters the narrow rows are shuffled first.  All regressions of a batch share the scan: each contributes columns, not
copies of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.semantics import complete, nan_to_null
from canvass.session import materialize

# sums that a task holds for all cells at once; with more of them the rows of a cell are brought together first
HELD_BYTES = 64 << 20


@dataclass(frozen=True)
class Spec:
    """One reported regression: outcome, regressors, and the label of the result row.

    The first regressor is the one reported.  ``fe`` names the columns of an absorbed group effect.
    Rows that lack a variable or one of the ``complete`` columns take no part.
    """

    label: str
    y: str
    xs: tuple[str, ...]
    fe: tuple[str, ...] = ()
    min_n: int = 0
    complete: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return self.xs[0]


@dataclass
class Fit:
    """A regression actually computed: one per outcome, regressor set and list of complete columns."""

    index: int
    y: str
    xs: tuple[str, ...]
    fe: tuple[str, ...]
    n: int = 0
    means: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cross: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    levels: int = 0
    complete: tuple[str, ...] = ()
    # cluster levels within which every level of the absorbed effect lies
    nested: frozenset[str] = frozenset()

    @property
    def variables(self) -> tuple[str, ...]:
        return (*self.xs, self.y)

    @property
    def k(self) -> int:
        return len(self.xs)

    def col(self, what: str, *index: int) -> str:
        """Name of one of this fit's columns."""
        return "_".join([f"f{self.index}", what, *map(str, index)])


def distinct_fits(specs: Sequence[Spec]) -> tuple[list[Fit], list[int]]:
    """The distinct regressions behind the specs, and for each spec the index of its fit."""
    seen: dict[tuple, int] = {}
    fits: list[Fit] = []
    which = []
    for s in specs:
        complete = tuple(sorted(set(s.complete)))
        ident = (s.y, frozenset(s.xs), s.fe, complete)
        if ident not in seen:
            seen[ident] = len(fits)
            fits.append(Fit(len(fits), s.y, tuple(sorted(s.xs)), s.fe, complete=complete))
        which.append(seen[ident])
    return fits, which


def _pairs(m: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(m) for j in range(i, m)]


def masked_variables(df: DataFrame, fits: Sequence[Fit], keep: Sequence[str]) -> DataFrame:
    """Keys plus, per fit, its variables with incomplete rows set to NULL."""
    used = sorted({v for f in fits for v in f.variables})
    needed = sorted({c for f in fits for c in f.complete})
    floats = {c for c, kind in df.dtypes if kind in ("float", "double")}
    clean = df.select(
        *keep,
        *[nan_to_null(F.col(v).cast("double")).alias(f"__x_{v}") for v in used],
        *[(nan_to_null(c) if c in floats else F.col(c)).alias(f"__c_{c}") for c in needed],
    )
    columns = []
    for f in fits:
        present = complete([*[f"__x_{v}" for v in f.variables], *[f"__c_{c}" for c in f.complete]])
        columns += [F.when(present, F.col(f"__x_{v}")).alias(f.col("v", j)) for j, v in enumerate(f.variables)]
    return clean.select(*keep, *columns)


def _gathered(df: DataFrame, fits: Sequence[Fit], keys: Sequence[str]) -> DataFrame:
    """The columns in use; where there are many cells, with the rows of a cell together.

    A task that meets rows of all cells holds sums for every one of them.  Few cells are summed where their rows are.
    Many come together in partitions that Spark cuts by size, so a very large cell is still summed in several tasks.
    """
    used = {v for f in fits for v in (*f.variables, *f.complete)}
    df = df.select(*keys, *sorted(used - set(keys)))
    width = 8 * sum(4 * len(_pairs(f.k + 2)) for f in fits)
    if not keys or df.agg(F.approx_count_distinct(F.struct(*keys))).first()[0] * width <= HELD_BYTES:
        return df
    # not by the keys themselves: sums of one cell made in several tasks have to meet once more
    return df.withColumn("__part", F.pmod(F.xxhash64(*keys), F.lit(1 << 20))).hint("rebalance", F.col("__part")).drop("__part")


def cell_moments(df: DataFrame, fits: Sequence[Fit], keys: Sequence[str]) -> DataFrame:
    """Count, means and centred cross-products of every fit per combination of the keys."""
    aggs: list[Column] = []
    for f in fits:
        v = [F.col(f.col("v", j)) for j in range(f.k + 1)]
        n = F.count(v[0])
        aggs.append(n.alias(f.col("n")))
        aggs += [F.coalesce(F.avg(v[j]), F.lit(0.0)).alias(f.col("m", j)) for j in range(f.k + 1)]
        aggs += [
            F.coalesce(n * (F.var_pop(v[i]) if i == j else F.covar_pop(v[i], v[j])), F.lit(0.0)).alias(f.col("c", i, j))
            for i, j in _pairs(f.k + 1)
        ]
    return masked_variables(_gathered(df, fits, keys), fits, keys).groupBy(*keys).agg(*aggs)


def add_means(cells: DataFrame, fits: Sequence[Fit]) -> None:
    """Set each fit's row count and overall means from the cell table."""
    aggs = []
    for f in fits:
        aggs.append(F.sum(f.col("n")).alias(f.col("n")))
        aggs += [F.sum(F.col(f.col("n")) * F.col(f.col("m", j))).alias(f.col("m", j)) for j in range(f.k + 1)]
    row = cells.agg(*aggs).first()
    for f in fits:
        f.n = int(row[f.col("n")] or 0)
        f.means = np.array([(row[f.col("m", j)] or 0.0) / max(f.n, 1) for j in range(f.k + 1)])


def _centred(f: Fit, centre: list[Column]) -> list[Column]:
    """Deviation sums and cross-products of a cell around the given centre: additive over cells."""
    n = F.col(f.col("n"))
    dev = [F.col(f.col("m", j)) - centre[j] for j in range(f.k + 1)]
    sums = [(n * dev[j]).alias(f.col("t", j)) for j in range(f.k + 1)]
    cross = [(F.col(f.col("c", i, j)) + n * dev[i] * dev[j]).alias(f.col("s", i, j)) for i, j in _pairs(f.k + 1)]
    return [n.alias(f.col("n")), *sums, *cross]


def centred_cells(cells: DataFrame, fits: Sequence[Fit], keys: Sequence[str]) -> DataFrame:
    """Cells around the overall means, or around the means of the absorbed group."""
    plain = [f for f in fits if not f.fe]
    out = cells
    centres: dict[int, list[Column]] = {
        f.index: [F.lit(float(m)) for m in f.means] for f in plain
    }
    for fe in sorted({f.fe for f in fits if f.fe}):
        group = [f for f in fits if f.fe == fe]
        sums = [F.sum(f.col("n")).alias(f.col("ng")) for f in group] + [
            F.sum(F.col(f.col("n")) * F.col(f.col("m", j))).alias(f.col("g", j)) for f in group for j in range(f.k + 1)
        ]
        means = out.groupBy(*[F.col(c).alias(f"__fe_{c}") for c in fe]).agg(*sums)
        on = F.lit(True)
        for c in fe:
            on = on & F.col(c).eqNullSafe(F.col(f"__fe_{c}"))
        out = out.join(means, on).drop(*[f"__fe_{c}" for c in fe])
        for f in group:
            centres[f.index] = [
                F.coalesce(F.try_divide(F.col(f.col("g", j)), F.col(f.col("ng"))), F.lit(0.0)) for j in range(f.k + 1)
            ]
    extra = [F.col(f.col("ng")) for f in fits if f.fe]
    return out.select(*keys, *extra, *[c for f in fits for c in _centred(f, centres[f.index])])


def additive_columns(fits: Sequence[Fit]) -> list[str]:
    names = []
    for f in fits:
        names.append(f.col("n"))
        names += [f.col("t", j) for j in range(f.k + 1)]
        names += [f.col("s", i, j) for i, j in _pairs(f.k + 1)]
    return names


def roll_up(cells: DataFrame, fits: Sequence[Fit], keys: Sequence[str]) -> DataFrame:
    """Sum the centred cells to a coarser set of keys."""
    return cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in additive_columns(fits)])


def add_totals(cells: DataFrame, fits: Sequence[Fit], levels: Sequence[Sequence[str]]) -> list[int]:
    """Set each fit's total cross-product matrix (regressors first, outcome last).

    Returns about how many clusters each level has, and the number of cells; used to size tasks.
    """
    aggs = [F.sum(f.col("s", i, j)).alias(f.col("s", i, j)) for f in fits for i, j in _pairs(f.k + 1)]
    aggs += [F.approx_count_distinct(F.struct(*keys)).alias(f"size_{i}") for i, keys in enumerate(levels)]
    row = cells.agg(*aggs, F.count(F.lit(1)).alias("cells")).first()
    for f in fits:
        m = np.zeros((f.k + 1, f.k + 1))
        for i, j in _pairs(f.k + 1):
            m[i, j] = m[j, i] = row[f.col("s", i, j)] or 0.0
        f.cross = m
    return [*[int(row[f"size_{i}"]) for i in range(len(levels))], int(row["cells"])]


def fit_moments(
    df: DataFrame, specs: Sequence[Spec], clusters: Sequence[Sequence[str]]
) -> tuple[list[Fit], list[int], DataFrame, DataFrame, list[int]]:
    """Fits with totals, the fit of each spec, the cells (raw, centred) keyed by all cluster columns, sizes.

    The cell table is written to the checkpoint folder: the rows are scanned once however many
    standard errors and bootstraps are derived from it.
    """
    fits, which = distinct_fits(specs)
    keys: list[str] = []
    for group in [*clusters, *[f.fe for f in fits]]:
        keys += [c for c in group if c not in keys]
    cells = materialize(cell_moments(df, fits, keys))
    add_means(cells, fits)
    centred = centred_cells(cells, fits, keys)
    if any(f.fe for f in fits):
        centred = materialize(centred)
    sizes = add_totals(centred, fits, clusters)
    return fits, which, cells, centred, sizes
