"""Digit heaping, answer mixes per interviewer, and answer quality against duration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.semantics import any_of, cut, in_set, pct, pearson
from canvass.operators.clock import MAX_MINUTES, MIN_MINUTES, in_range
from canvass.operators.shares import count_share, overall_and_by

QUALITY_BREAKS = (5, 30, 60, 90, 120, 180, 240)
QUALITY_LABELS = ("5-30", "30-60", "60-90", "90-120", "120-180", "180-240")


def open_range(df: DataFrame, value: str, low: float = 0, high: float = 100) -> DataFrame:
    """Rows strictly between the limits."""
    return df.where((F.col(value) > low) & (F.col(value) < high))


def is_multiple(value: str, per_unit: int = 1) -> Column:
    """The value is a multiple of 1/per_unit."""
    scaled = F.col(value) * per_unit
    return scaled == F.floor(scaled)


def _heaps(value: str) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_multiple(value)).alias("n_whole"),
        F.count_if(is_multiple(value, 2)).alias("n_half"),
    ]


def _heap_shares() -> list[Column]:
    return [
        pct(F.col("n_whole"), F.col("n")).alias("pct_whole"),
        pct(F.col("n_half"), F.col("n")).alias("pct_half"),
    ]


def heaping(df: DataFrame, value: str, source: str, low: float = 0, high: float = 100) -> DataFrame:
    """Whole numbers and multiples of one half, overall and by source, in a single pass."""
    partials = open_range(df, value, low, high).groupBy(source).agg(*_heaps(value))
    both = overall_and_by(partials, source, ["n", "n_whole", "n_half"])
    return both.select(source, "n", "n_whole", "n_half", *_heap_shares())


def decimal_distribution(df: DataFrame, value: str, low: float = 0, high: float = 100) -> DataFrame:
    """Share of each fractional part, rounded to one tenth (half to even), so 0.0 to 1.0."""
    tenth = F.rint((F.col(value) - F.floor(value)) * 10) / 10
    return count_share(open_range(df, value, low, high).select(tenth.alias("decimal")), ["decimal"])


def interviewer_heaping(
    df: DataFrame, value: str, keys: Sequence[str], low: float = 0, high: float = 100, min_n: int = 20
) -> DataFrame:
    return (
        open_range(df, value, low, high)
        .groupBy(*keys)
        .agg(*_heaps(value))
        .where(F.col("n") >= min_n)
        .select(*keys, "n", *_heap_shares())
    )


def heavy_heapers(per_interviewer: DataFrame, limit: float = 60.0) -> DataFrame:
    """How many interviewers give more than ``limit`` percent whole numbers."""
    return per_interviewer.agg(
        F.count(F.lit(1)).alias("n_interviewers"),
        F.count_if(F.col("pct_whole") > limit).alias("n_heavy"),
        pct(F.count_if(F.col("pct_whole") > limit), F.count(F.lit(1))).alias("pct_heavy"),
    )


def response_mix(
    df: DataFrame, code: str, categories: Mapping[str, Sequence], keys: Sequence[str], min_n: int = 20
) -> DataFrame:
    """Percentage of answers in each category per interviewer, missing answers left out."""
    rows = F.count(F.lit(1))
    shares = [pct(F.count_if(in_set(code, codes)), rows).alias(f"pct_{name}") for name, codes in categories.items()]
    answered = df.where(F.col(code).isNotNull())
    return answered.groupBy(*keys).agg(rows.alias("n"), *shares).where(F.col("n") >= min_n)


def spread_over_interviewers(per_interviewer: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Mean, standard deviation and coefficient of variation of interviewer-level values."""
    aggs = [F.count(F.lit(1)).alias("n_interviewers")]
    for m in measures:
        mean, sd = F.avg(m), F.stddev_samp(m)
        aggs += [mean.alias(f"{m}_mean"), sd.alias(f"{m}_sd"), F.try_divide(sd, mean).alias(f"{m}_cv")]
    return per_interviewer.groupBy(*by).agg(*aggs)


def quality_by_duration(
    df: DataFrame,
    duration: str,
    answers: Mapping[str, str],
    source: str,
    breaks: Sequence[float] = QUALITY_BREAKS,
    labels: Sequence[str] = QUALITY_LABELS,
    include_lowest: bool = False,
) -> DataFrame:
    """Percentage of missing answers per (a,b] duration bin; the lowest edge is in no bin."""
    label, ordinal = cut(duration, breaks, labels, right=True, include_lowest=include_lowest)
    rows = F.count(F.lit(1))
    binned = df.where(in_range(duration, breaks[0], breaks[-1])).withColumns({"bin": label, "bin_order": ordinal})
    shares = [pct(F.count_if(F.col(c).isNull()), rows).alias(f"pct_missing_{name}") for name, c in answers.items()]
    return binned.where("bin is not null").groupBy(source, "bin", "bin_order").agg(rows.alias("n"), *shares)


def quality_by_duration_long(wide: DataFrame, source: str, prefix: str = "pct_missing_") -> DataFrame:
    """One row per (source, bin, answer)."""
    columns = [c for c in wide.columns if c.startswith(prefix)]
    long = wide.unpivot([source, "bin", "bin_order", "n"], columns, "variable", "pct_missing")
    return long.withColumn("variable", F.regexp_replace("variable", f"^{prefix}", ""))


def productivity_vs_quality(
    df: DataFrame,
    keys: Sequence[str],
    duration: str,
    answers: Sequence[str],
    low: float = MIN_MINUTES,
    high: float = MAX_MINUTES,
    min_n: int = 20,
) -> DataFrame:
    """Mean duration and share of interviews with any missing answer, per interviewer."""
    rows = F.count(F.lit(1))
    return (
        df.where(in_range(duration, low, high))
        .groupBy(*keys)
        .agg(
            rows.alias("n_interviews"),
            F.avg(duration).alias("avg_duration"),
            pct(F.count_if(any_of(F.col(a).isNull() for a in answers)), rows).alias("pct_missing_any"),
        )
        .where(F.col("n_interviews") >= min_n)
    )


def correlation_and_line(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Correlation of complete pairs and the fitted line y = intercept + slope x."""
    x_, y_ = F.col(x), F.col(y)
    return df.groupBy(*by).agg(
        F.count_if(x_.isNotNull() & y_.isNotNull()).alias("n_pairs"),
        pearson(x_, y_).alias("r"),
        F.regr_slope(y_, x_).alias("slope"),
        F.regr_intercept(y_, x_).alias("intercept"),
    )
