"""Missing data, range checks, duplicates and per-interviewer data quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.semantics import any_of, cut, in_set, n_distinct, pct
from canvass.functions.skew import join_per_key
from canvass.operators.clock import MAX_MINUTES, MIN_MINUTES, in_range, out_of_range
from canvass.operators.shares import count_by, count_share, overall_and_by

DURATION_BREAKS = (float("-inf"), 5, 30, 60, 90, 120, 180, 240, float("inf"))
DURATION_LABELS = ("<5", "5-30", "30-60", "60-90", "90-120", "120-180", "180-240", "[240,inf)")
SUSPICIOUS_BINS = ("<5", "[240,inf)")


def _missing_counts(columns: Sequence[str]) -> list[Column]:
    return [F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns]


def _long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], value: str) -> DataFrame:
    return df.unpivot(list(ids), [f"`{c}`" for c in columns], "variable", value)


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None, only_missing: bool = True) -> DataFrame:
    """Missing count and percentage per column, most missing first; all columns in one pass."""
    columns = list(columns or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *_missing_counts(columns))
    out = _long(wide, ["__rows"], columns, "n_missing").select(
        "variable", "n_missing", pct(F.col("n_missing"), F.col("__rows")).alias("pct_missing")
    )
    out = out.where("n_missing > 0") if only_missing else out
    return out.orderBy(F.desc("pct_missing"), F.asc("variable"))


def missing_by_group(df: DataFrame, group: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing count per (group, column), long."""
    columns = [c for c in (columns or df.columns) if c != group]
    return _long(df.groupBy(group).agg(*_missing_counts(columns)), [group], columns, "n_missing")


def missing_by_group_wide(
    df: DataFrame, group: str, levels: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Missing counts with one row per column and one column per group; rows with any missing."""
    long = missing_by_group(df, group, columns)
    wide = long.groupBy("variable").pivot(group, list(levels)).agg(F.first("n_missing"))
    return wide.where(any_of(F.col(f"`{v}`") > 0 for v in levels))


def missing_heatmap(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Percentage missing per (keys, column) for the listed columns that exist."""
    present = [c for c in columns if c in df.columns]
    shares = [pct(F.count_if(F.col(f"`{c}`").isNull()), F.count(F.lit(1))).alias(c) for c in present]
    return _long(df.groupBy(*keys).agg(*shares), list(keys), present, "pct_missing")


def range_flags(
    df: DataFrame, value: str, group: str, low: float = MIN_MINUTES, high: float = MAX_MINUTES
) -> DataFrame:
    """Rows outside [low, high], overall and by group.

    ``pct_of_all`` divides by the whole table and ``pct_in_group`` by the group's own rows.
    """
    per_group = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(out_of_range(value, low, high)).alias("n_flagged")
    )
    both = overall_and_by(per_group, group, ["n_rows", "n_flagged"])
    total = per_group.agg(F.sum("n_rows")).scalar()
    return both.select(
        group,
        "n_rows",
        "n_flagged",
        pct(F.col("n_flagged"), total).alias("pct_of_all"),
        pct(F.col("n_flagged"), F.col("n_rows")).alias("pct_in_group"),
    )


def rule_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking each named rule; every rule is counted in the same pass."""
    names = list(rules)
    wide = df.agg(*[F.count_if(rules[n]).alias(n) for n in names])
    return wide.unpivot([], names, "rule", "n_invalid")


def binned_counts(
    df: DataFrame,
    value: str,
    group: str,
    breaks: Sequence[float] = DURATION_BREAKS,
    labels: Sequence[str] = DURATION_LABELS,
    suspicious: Sequence[str] = SUSPICIOUS_BINS,
) -> DataFrame:
    """Rows and within-group percentage per left-closed bin, with a flag on suspicious bins."""
    label, ordinal = cut(value, breaks, labels, right=False)
    binned = df.where(F.col(value).isNotNull()).select(group, label.alias("bin"), ordinal.alias("bin_order"))
    counts = count_share(binned, [group, "bin", "bin_order"], within=[group])
    return counts.withColumn("suspicious", in_set("bin", suspicious))


def _not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def duplicate_groups(df: DataFrame, keys: Sequence[str], require: Sequence[str] = ()) -> DataFrame:
    """Keys held by more than one row, with the number of rows ``n``."""
    return count_by(_not_null(df, require), keys).where("n > 1")


def duplicate_summary(
    df: DataFrame, keys: Sequence[str], by: Sequence[str], require: Sequence[str] = ()
) -> DataFrame:
    """Rows in duplicate groups, counted by some of the key columns, largest first.

    Works on the grouped counts only, so a key with very many copies is one row of this table.
    """
    if not set(by) <= set(keys):
        raise ValueError("the summary columns must be key columns")
    groups = duplicate_groups(df, keys, require)
    out = groups.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"))
    return out.orderBy(F.desc("n_rows"), *[F.col(c).asc_nulls_last() for c in by])


def duplicate_rows(df: DataFrame, keys: Sequence[str], require: Sequence[str] = ()) -> DataFrame:
    """The rows that share their key with another row.

    The key counts decide the route: keys with very many copies are matched by a broadcast of a
    bounded number of keys, so copies of one key are never gathered in one task.
    """
    rows = _not_null(df, require)
    return join_per_key(rows, duplicate_groups(df, keys, require), keys, "n", how="semi")


def interviewer_quality(
    df: DataFrame,
    keys: Sequence[str],
    area: str,
    answer: str,
    duration: str,
    low: float = MIN_MINUTES,
    high: float = MAX_MINUTES,
    min_n: int = 10,
) -> DataFrame:
    """Interviews, areas covered, % missing answers, % flagged durations and mean valid duration."""
    rows = F.count(F.lit(1))
    return (
        df.groupBy(*keys)
        .agg(
            rows.alias("n_interviews"),
            n_distinct(area).alias("n_areas"),
            pct(F.count_if(F.col(answer).isNull()), rows).alias("pct_missing"),
            pct(F.count_if(out_of_range(duration, low, high)), rows).alias("pct_flagged"),
            F.avg(F.when(in_range(duration, low, high), F.col(duration))).alias("avg_duration"),
        )
        .where(F.col("n_interviews") >= min_n)
    )


def problem_interviewers(
    quality: DataFrame, keys: Sequence[str], max_flagged: float = 5.0, max_missing: float = 20.0, top: int = 10
) -> DataFrame:
    """The worst interviewers over either threshold, by share of flagged durations."""
    return (
        quality.where((F.col("pct_flagged") > max_flagged) | (F.col("pct_missing") > max_missing))
        .orderBy(F.col("pct_flagged").desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys])
        .limit(top)
    )


def problem_counts(
    quality: DataFrame, max_flagged: float = 5.0, max_missing: float = 20.0
) -> DataFrame:
    """How many interviewers pass the size gate, and how many exceed a threshold."""
    return quality.agg(
        F.count(F.lit(1)).alias("n_interviewers"),
        F.count_if((F.col("pct_flagged") > max_flagged) | (F.col("pct_missing") > max_missing)).alias("n_problem"),
    )
