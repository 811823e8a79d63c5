"""How much of an outcome's variance lies between two crossed factors, such as village and interviewer.

Rows are reduced once to (a, b) cells with counts and sums.  After that:

* one-way R-squared comes from group sums;
* two-way R-squared and REML need the cross-products of the cells over the larger factor, a matrix
  with the size of the smaller factor, which Spark adds up block by block;
* when the smaller factor is too large for such a matrix, R-squared is found by conjugate gradients
  on the cells, and the variance components by the method of moments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.functions.semantics import n_distinct, nan_to_null, pct
from canvass.operators import reml
from canvass.operators.effects import spread_over_interviewers
from canvass.session import materialize

# Largest size of the smaller factor for which its square matrix is formed.
DENSE_LEVELS = 400


def cells(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """n, sum and within-cell sum of squares of the outcome per pair of levels, rows with an outcome only.

    The outcome is measured from its overall mean, so that sums of squares keep their precision.
    """
    rows = df.select(F.col(a).alias("a"), F.col(b).alias("b"), nan_to_null(F.col(y).cast("double")).alias("y"))
    return (
        rows.where("y is not null")
        .groupBy("a", "b")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("y").alias("m"),
            (F.var_pop("y") * F.count(F.lit(1))).alias("w"),
        )
    )


def centre(cell_table: DataFrame) -> DataFrame:
    """Cells with the sum of y measured from the overall mean (n, s) and the within-cell square sum w."""
    mean = cell_table.agg(F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n"))).scalar()
    return cell_table.select("a", "b", "n", (F.col("n") * (F.col("m") - mean)).alias("s"), "w")


def keep_large_groups(cell_table: DataFrame, min_n: int, fixpoint: bool = False) -> DataFrame:
    """Drop levels of ``a`` with fewer than ``min_n`` rows, then levels of ``b``.

    Done once in that order, so a level of ``a`` may end up smaller; ``fixpoint`` repeats until
    nothing changes.  Works on cells, never on rows.
    """
    while True:
        out = cell_table
        for factor in ("a", "b"):
            large = out.groupBy(factor).agg(F.sum("n").alias("__n")).where(F.col("__n") >= min_n).select(
                F.col(factor).alias("__level")
            )
            out = out.join(large, F.col(factor).eqNullSafe(F.col("__level")), "left_semi")
        if not fixpoint:
            return out
        out = materialize(out)
        if out.count() == cell_table.count():
            return out
        cell_table = out


def factor_totals(cell_table: DataFrame) -> DataFrame:
    """Row with the sizes and one-way sums everything else is built from (cells as from :func:`centre`)."""
    by_a = cell_table.groupBy("a").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n") ** 2).alias("nn"))
    by_b = cell_table.groupBy("b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n") ** 2).alias("nn"))

    def one_way(t: DataFrame, name: str) -> DataFrame:
        n, s = F.col("n").cast("double"), F.col("s")  # squares of counts pass 2**63
        return t.agg(
            F.count(F.lit(1)).alias(f"levels_{name}"),
            F.sum(s * s / n).alias(f"between_{name}"),
            F.sum(n * n).alias(f"sq_{name}"),
            F.sum(F.col("nn") / n).alias(f"cross_{name}"),
        )

    whole = cell_table.agg(
        F.sum("n").alias("n"),
        F.sum("s").alias("s"),
        F.sum(F.col("w") + F.col("s") * F.col("s") / F.col("n")).alias("ss"),
    )
    row = F.struct("*")
    return (
        whole.withColumn("__a", one_way(by_a, "a").agg(F.first(row)).scalar())
        .withColumn("__b", one_way(by_b, "b").agg(F.first(row)).scalar())
        .select("n", "s", "ss", "__a.*", "__b.*")
    )


# ---------------------------------------------------------------- method of moments

def moment_components(cell_table: DataFrame) -> DataFrame:
    """Variance of a, of b and of the residual by the method of moments (Gao and Owen, 2017).

    Three sums of squares are set equal to their expectations; the 3 x 3 system is solved by
    Cramer's rule in the plan.  Negative estimates are set to zero and flagged.
    """
    t = factor_totals(cell_table)
    n = F.col("n").cast("double")
    u1 = F.col("ss") - F.col("between_a")
    u2 = F.col("ss") - F.col("between_b")
    u3 = n * F.col("ss") - F.col("s") * F.col("s")
    zero = F.lit(0.0)
    # unknowns: variance of a, variance of b, residual variance
    rows = [
        [zero, n - F.col("cross_a"), n - F.col("levels_a")],
        [n - F.col("cross_b"), zero, n - F.col("levels_b")],
        [n * n - F.col("sq_a"), n * n - F.col("sq_b"), n * n - n],
    ]
    m = [[f"m{i}{j}" for j in range(3)] for i in range(3)]
    t = t.select(
        "n", "levels_a", "levels_b",
        *[rows[i][j].alias(m[i][j]) for i in range(3) for j in range(3)],
        u1.alias("u0"), u2.alias("u1"), u3.alias("u2"),
    )

    def det(c: list[list[str]]):
        c = [[F.col(x) for x in r] for r in c]
        return (
            c[0][0] * (c[1][1] * c[2][2] - c[1][2] * c[2][1])
            - c[0][1] * (c[1][0] * c[2][2] - c[1][2] * c[2][0])
            + c[0][2] * (c[1][0] * c[2][1] - c[1][1] * c[2][0])
        )

    whole = det(m)
    solved = []
    for j, name in enumerate(["raw_a", "raw_b", "raw_residual"]):
        replaced = [[f"u{i}" if k == j else m[i][k] for k in range(3)] for i in range(3)]
        solved.append(F.try_divide(det(replaced), whole).alias(name))
    raw = t.select("n", "levels_a", "levels_b", *solved)
    parts = ["a", "b", "residual"]
    clipped = [F.greatest(F.col(f"raw_{p}"), zero).alias(f"var_{p}") for p in parts]
    flag = (F.col("raw_a") < 0) | (F.col("raw_b") < 0) | (F.col("raw_residual") < 0)
    out = raw.select("n", "levels_a", "levels_b", *clipped, flag.alias("clipped"))
    return add_shares(out)


def add_shares(df: DataFrame) -> DataFrame:
    total = F.col("var_a") + F.col("var_b") + F.col("var_residual")
    return df.withColumns(
        {"icc_a": F.try_divide(F.col("var_a"), total), "icc_b": F.try_divide(F.col("var_b"), total)}
    )


# ---------------------------------------------------------------- cross-products over the larger factor

@dataclass
class SmallFactor:
    """Cells arranged by the larger factor, plus totals per level of the smaller one."""

    by_large: DataFrame
    n_small: np.ndarray
    s_small: np.ndarray
    total_n: int
    total_ss: float


def arrange(cell_table: DataFrame, small: str, large: str, levels: int) -> SmallFactor:
    """Number the levels of the smaller factor and gather the cells of each level of the larger one.

    A level of the larger factor has at most ``levels`` cells, so its list is bounded.
    """
    per_small = (
        cell_table.groupBy(small).agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy(F.col(small).asc_nulls_first())
    ).limit(levels)
    spark = cell_table.sparkSession
    rows = per_small.collect()
    index_schema = cell_table.select(F.col(small).alias("__level")).schema.add("__i", T.IntegerType())
    index = F.broadcast(spark.createDataFrame([(r[0], i) for i, r in enumerate(rows)], index_schema))
    numbered = cell_table.join(index, F.col(small).eqNullSafe(F.col("__level")))
    by_large = numbered.groupBy(large).agg(
        F.sum("n").alias("n"),
        F.sum("s").alias("s"),
        F.sum("w").alias("w"),
        F.collect_list(F.struct(F.col("__i").alias("i"), "n", "s")).alias("cells"),
    )
    cell = {"i": "cells.i", "cn": "cells.n", "cs": "cells.s"}
    totals = cell_table.agg(F.sum("n"), F.sum(F.col("w") + F.col("s") * F.col("s") / F.col("n"))).first()
    return SmallFactor(
        materialize(by_large.select("n", "s", "w", *[F.col(x).alias(name) for name, x in cell.items()])),
        np.array([r["n"] for r in rows], dtype=float),
        np.array([r["s"] for r in rows], dtype=float),
        int(totals[0]),
        float(totals[1]),
    )


def explained_by_larger(f: SmallFactor) -> tuple[np.ndarray, np.ndarray, float]:
    """Counts c of the smaller factor per level of the larger one: sums of c c' / n, of c s / n and of s s / n."""
    size = len(f.n_small)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, ss = np.zeros((size + 1, size)), 0.0
        for part in reml.stretches(batches, size):
            counts, _, s = reml.dense(part, size)
            n = part["n"].to_numpy(float)
            total[:size] += counts.T @ (counts / n[:, None])
            total[size] += counts.T @ (s / n)
            ss += float((s * s / n).sum())
        yield pd.DataFrame(reml.piecewise(0, total, [ss]), columns=["k", "i", "row"])

    levels = reml.spread(f.by_large, size * (size + 1))
    [(found, (between,))] = reml.added(levels.mapInPandas(add_up, reml.ROWS), size)
    return found[:-1], found[-1], float(between)


# ---------------------------------------------------------------- REML

def reml_components(f: SmallFactor) -> tuple[float, float, float, bool]:
    """Variances (smaller factor, larger factor, residual) at the REML optimum, and whether it is verified."""
    best, converged = reml.optimum(f.by_large, len(f.n_small))
    return best.t * best.residual, best.x * best.residual, best.residual, bool(converged)


def variance_components(
    df: DataFrame,
    outcomes: dict[str, str],
    a: str,
    b: str,
    min_levels: int = 10,
    min_n: int = 100,
    estimator: str = "reml",
) -> DataFrame:
    """Variance of two crossed random factors and their shares, per outcome (label -> column).

    An outcome needs more than ``min_levels`` levels of each factor and ``min_n`` rows, otherwise it
    has no row.  ``estimator`` is the caller's choice: ``reml``, whose work grows with the square of the levels of
    the smaller factor, or ``moments``; ``converged`` tells whether the optimum is verified.
    """
    records = []
    if estimator not in ("reml", "moments"):
        raise ValueError("estimator must be reml or moments")
    for label, y in outcomes.items():
        table = materialize(cells(df, y, a, b))
        table = centre(table)
        t = factor_totals(table).first()
        n, la, lb = int(t["n"] or 0), t["levels_a"], t["levels_b"]
        if n < min_n or la <= min_levels or lb <= min_levels:
            continue
        converged = True
        if estimator == "moments":
            r = moment_components(table).first()
            found, used, clipped = (r["var_a"], r["var_b"], r["var_residual"]), "moments", r["clipped"]
        else:
            small, large = ("a", "b") if la <= lb else ("b", "a")
            vs, vl, ve, converged = reml_components(arrange(table, small, large, min(la, lb)))
            found, used, clipped = ((vs, vl, ve) if small == "a" else (vl, vs, ve)), "reml", False
        records.append((label, n, la, lb, *map(float, found), used, clipped, converged))
    schema = (
        "outcome string, n long, levels_a long, levels_b long, var_a double, var_b double, "
        "var_residual double, estimator string, clipped boolean, converged boolean"
    )
    return add_shares(df.sparkSession.createDataFrame(records, schema))


# ---------------------------------------------------------------- R-squared of group effects

def one_way_r2(cell_table: DataFrame) -> DataFrame:
    """R-squared of each factor alone, from group sums (cells as from :func:`centre`)."""
    t = factor_totals(cell_table)
    total = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    shift = F.col("s") * F.col("s") / F.col("n")
    return t.select(
        "n",
        F.try_divide(F.col("between_a") - shift, total).alias("r2_a"),
        F.try_divide(F.col("between_b") - shift, total).alias("r2_b"),
    )


def explained_two_way(f: SmallFactor) -> float:
    """Sum of squares explained by both factors: eliminate the larger one, solve for the smaller."""
    nn, ns, between = explained_by_larger(f)
    m = np.diag(f.n_small) - nn
    r = f.s_small - ns
    effect = np.linalg.pinv(m, rcond=1e-10, hermitian=True) @ r
    return float(effect @ r + between)


def explained_by_conjugate_gradients(
    cell_table: DataFrame, a: str = "a", b: str = "b", tolerance: float = 1e-10, max_steps: int = 2_000
) -> float:
    """The same sum of squares without a matrix: conjugate gradients with two groupings per step.

    Solves (D_a - N D_b^-1 N') x = s_a - N D_b^-1 s_b for the effects of ``a``.  The vectors are
    DataFrames with one row per level; only the scalar products reach the driver.
    """
    base = materialize(cell_table.select(F.col(a).alias("a"), F.col(b).alias("b"), "n", "s"))
    per_b = base.groupBy("b").agg(F.sum("n").alias("nb"), F.sum("s").alias("sb"))
    per_a = base.groupBy("a").agg(F.sum("n").alias("na"), F.sum("s").alias("sa"))
    between_b = per_b.agg(F.sum(F.col("sb") ** 2 / F.col("nb"))).first()[0]

    def safe(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
        renamed = right.withColumnRenamed(key, f"__{key}")
        return left.join(renamed, F.col(key).eqNullSafe(F.col(f"__{key}"))).drop(f"__{key}")

    def project(vector: DataFrame) -> DataFrame:
        """N D_b^-1 N' p for a vector p (columns a, p)."""
        with_p = safe(base, vector, "a")
        back = with_p.groupBy("b").agg((F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("mp"))
        return safe(base, back, "b").groupBy("a").agg(F.sum(F.col("n") * F.col("mp")).alias("np"))

    shift = safe(base, per_b, "b").groupBy("a").agg(F.sum(F.col("n") * F.col("sb") / F.col("nb")).alias("ns"))
    state = safe(per_a, shift, "a").select(
        "a", "na", (F.col("sa") - F.col("ns")).alias("rhs"), (F.col("sa") - F.col("ns")).alias("r")
    )
    state = state.withColumns({"x": F.lit(0.0), "z": F.col("r") / F.col("na"), "p": F.col("r") / F.col("na")})
    state = materialize(state)
    first = state.agg(F.sum(F.col("r") * F.col("z")), F.sum(F.col("rhs") ** 2)).first()
    rz, scale = first[0] or 0.0, first[1] or 0.0
    start = rz
    for _ in range(max_steps):
        if scale == 0 or rz <= tolerance**2 * start:
            break
        step = materialize(
            safe(state, project(state.select("a", "p")), "a").withColumn("q", F.col("na") * F.col("p") - F.col("np"))
        )
        pq = step.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        if not pq or pq <= 0:
            break
        alpha = rz / pq
        moved = step.select(
            "a", "na", "rhs", "p",
            (F.col("x") + alpha * F.col("p")).alias("x"),
            (F.col("r") - alpha * F.col("q")).alias("r"),
        ).withColumn("z", F.col("r") / F.col("na"))
        new = moved.agg(F.sum(F.col("r") * F.col("z"))).first()[0]
        state = materialize(moved.withColumn("p", F.col("z") + (new / rz) * F.col("p")))
        rz = new
    else:
        raise RuntimeError(f"conjugate gradients did not settle in {max_steps} steps")
    gained = state.agg(F.sum(F.col("x") * F.col("rhs"))).first()[0] or 0.0
    return float(between_b + gained)


def fe_r2(
    df: DataFrame,
    outcomes: dict[str, str],
    a: str,
    b: str,
    min_group: int = 5,
    min_n: int = 100,
    fixpoint: bool = False,
    dense_levels: int = DENSE_LEVELS,
) -> DataFrame:
    """R-squared of the effects of a, of b, of both, and what b adds to a, per outcome.

    Small groups are dropped first (levels of a, then of b); outcomes with fewer than ``min_n``
    remaining rows have no row.
    """
    records = []
    for label, y in outcomes.items():
        table = materialize(keep_large_groups(materialize(cells(df, y, a, b)), min_group, fixpoint))
        table = centre(table)
        t = factor_totals(table).first()
        n = int(t["n"] or 0)
        if n < min_n:
            continue
        shift = t["s"] ** 2 / n
        total = t["ss"] - shift
        if total <= 0:
            records.append((label, n, None, None, None, None))
            continue
        la, lb = t["levels_a"], t["levels_b"]
        small, large = ("a", "b") if la <= lb else ("b", "a")
        if min(la, lb) <= dense_levels:
            explained = explained_two_way(arrange(table, small, large, min(la, lb)))
        else:
            explained = explained_by_conjugate_gradients(table, small, large)
        ra, rb = (t["between_a"] - shift) / total, (t["between_b"] - shift) / total
        both = (explained - shift) / total
        records.append((label, n, ra, rb, both, both - ra))
    schema = "outcome string, n long, r2_a double, r2_b double, r2_both double, r2_b_given_a double"
    return df.sparkSession.createDataFrame(records, schema)


# ---------------------------------------------------------------- interviewer means

def interviewer_means(
    df: DataFrame, value: str, flag: str, area: str, keys: Sequence[str], low: float = 0, high: float = 100, min_n: int = 20
) -> DataFrame:
    """Mean and spread of a value, share of a 0/1 flag and areas visited, per interviewer."""
    inside = (F.col(value) > low) & (F.col(value) < high)
    return (
        df.where(inside)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(value).alias("mean_value"),
            F.stddev_samp(value).alias("sd_value"),
            pct(F.sum(flag), F.count(flag)).alias("pct_flag"),
            n_distinct(area).alias("n_areas"),
        )
        .where(F.col("n") >= min_n)
    )


def interviewer_mean_spread(means: DataFrame, by: Sequence[str]) -> DataFrame:
    return spread_over_interviewers(means, by, ["mean_value", "pct_flag"])


def share_table(components: DataFrame, names: dict[str, str]) -> DataFrame:
    """Long form of the variance shares: one row per outcome and component."""
    rest = 1 - F.col("icc_a") - F.col("icc_b")
    rows = [
        F.struct(F.lit(names["a"]).alias("component"), F.col("icc_a").alias("variance_share")),
        F.struct(F.lit(names["b"]).alias("component"), F.col("icc_b").alias("variance_share")),
        F.struct(F.lit(names["residual"]).alias("component"), rest.alias("variance_share")),
    ]
    return components.select("outcome", F.explode(F.array(*rows)).alias("c")).select("outcome", "c.*")
