"""Histogram tables (the numbers behind a chart)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.semantics import nan_to_null


def _with_empty(counted: DataFrame, facet: Sequence[str], lasting: Sequence[str], first: Column, last: Column) -> DataFrame:
    """Add a row with n = 0 for every facet and every bin from ``first`` to ``last`` that has no value.

    ``lasting`` columns hold one value in the whole table.  The spine of facets and bins is built from the counts, not from
    the rows, and is added up with them, so a missing facet is a facet like any other.
    """
    own = [*facet, *lasting]
    spine = (
        counted.select(*own)
        .distinct()
        .select(*own, F.explode(F.sequence(first, last)).alias("bin"), F.lit(0).cast("long").alias("n"))
    )
    return counted.select(*own, "bin", "n").unionByName(spine).groupBy(*own, "bin").agg(F.sum("n").alias("n"))


def equal_width(
    df: DataFrame,
    value: str,
    bins: int,
    facet: Sequence[str] = (),
    low: float | None = None,
    high: float | None = None,
    empty: bool = True,
) -> DataFrame:
    """``bins`` bins of equal width over [low, high], shared by all facets.

    Bin i (from 0) is [low + i w, low + (i+1) w), the last one closed.  Limits left open are the
    smallest and largest value, found by one extra aggregate.  Every facet with a value in range has all bins, those
    without a value with n = 0, unless ``empty`` is False; when all values are equal there is one bin.
    """
    rows = df.select(*facet, nan_to_null(F.col(value).cast("double")).alias("__v")).where("__v is not null")
    ends = rows.agg(F.struct(F.min("__v").alias("lo"), F.max("__v").alias("hi")).alias("e"))
    if low is None or high is None:
        rows = rows.withColumn("__e", ends.scalar())
        lo = F.col("__e.lo") if low is None else F.lit(float(low))
        hi = F.col("__e.hi") if high is None else F.lit(float(high))
    else:
        lo, hi = F.lit(float(low)), F.lit(float(high))
    width = (hi - lo) / bins
    position = F.floor(F.try_divide(F.col("__v") - lo, width)).cast("int")
    index = F.when(hi == lo, F.lit(0)).otherwise(F.least(position, F.lit(bins - 1)))
    inside = rows.where((F.col("__v") >= lo) & (F.col("__v") <= hi))
    counted = (
        inside.select(*facet, index.alias("bin"), lo.alias("__lo"), width.alias("__w"))
        .groupBy(*facet, "bin", "__lo", "__w")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if empty:
        last = F.when(F.col("__w") == 0, 0).otherwise(bins - 1)
        counted = _with_empty(counted, facet, ["__lo", "__w"], F.lit(0), last)
    return counted.select(
        *facet,
        "bin",
        (F.col("__lo") + F.col("bin") * F.col("__w")).alias("lower"),
        (F.col("__lo") + (F.col("bin") + 1) * F.col("__w")).alias("upper"),
        "n",
    )


def fixed_width(
    df: DataFrame, value: str, width: float = 1.0, facet: Sequence[str] = (), empty: bool = True
) -> DataFrame:
    """Bins [i w, (i+1) w) of a given width.

    Every facet has all bins from the first to the last one that holds a value in any facet; ``empty=False`` leaves out
    those without a value, for a width that is tiny beside the range.
    """
    rows = df.select(*facet, nan_to_null(F.col(value).cast("double")).alias("__v")).where("__v is not null")
    counted = (
        rows.select(*facet, F.floor(F.col("__v") / width).cast("long").alias("bin"))
        .groupBy(*facet, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if empty:
        ends = counted.agg(F.struct(F.min("bin").alias("lo"), F.max("bin").alias("hi")).alias("e")).scalar()
        counted = _with_empty(counted.withColumn("__e", ends), facet, ["__e"], F.col("__e.lo"), F.col("__e.hi"))
    lower = F.col("bin") * F.lit(float(width))
    return counted.select(*facet, "bin", lower.alias("lower"), ((F.col("bin") + 1) * F.lit(float(width))).alias("upper"), "n")


def log10_axis(
    df: DataFrame, value: str, bins: int, facet: Sequence[str] = (), empty: bool = True
) -> DataFrame:
    """Equal-width bins of log10(value), positive values only; edges are given in both scales."""
    logs = df.where(F.col(value) > 0).select(*facet, F.log10(F.col(value).cast("double")).alias("log10_value"))
    return equal_width(logs, "log10_value", bins, facet, empty=empty).withColumns(
        {"lower_value": F.pow(F.lit(10.0), "lower"), "upper_value": F.pow(F.lit(10.0), "upper")}
    )


def nice_step(span: Column, bins: int) -> Column:
    """The step among 1, 2, 5 times a power of ten that gives about ``bins`` bins."""
    raw = span / bins
    unit = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    lead = raw / unit
    return F.when(lead <= 1.4142135623730951, unit).when(lead <= 3.1622776601683795, 2 * unit).when(
        lead <= 7.0710678118654755, 5 * unit
    ).otherwise(10 * unit)


def suggested_bins(df: DataFrame, value: str, bins: int = 10, empty: bool = True) -> DataFrame:
    """Bins of a round width chosen from the range; right-closed (a,b], the first one closed.

    All bins up to that of the largest value, those without a value with n = 0 unless ``empty`` is False.
    """
    rows = df.select(nan_to_null(F.col(value).cast("double")).alias("__v")).where("__v is not null")
    ends = rows.agg(F.struct(F.min("__v").alias("lo"), F.max("__v").alias("hi")).alias("e"))
    step = F.when(F.col("__e.hi") > F.col("__e.lo"), nice_step(F.col("__e.hi") - F.col("__e.lo"), bins)).otherwise(1.0)
    first = F.floor(F.col("__e.lo") / F.col("__w")) * F.col("__w")
    stepped = rows.withColumn("__e", ends.scalar()).withColumn("__w", step).withColumn("__lo", first)
    index = F.greatest(F.ceil((F.col("__v") - F.col("__lo")) / F.col("__w")).cast("int") - 1, F.lit(0))
    counted = (
        stepped.select(index.alias("bin"), "__lo", "__w")
        .groupBy("bin", "__lo", "__w")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if empty:
        ends = counted.agg(F.max("bin")).scalar()
        counted = _with_empty(counted.withColumn("__e", ends), [], ["__lo", "__w", "__e"], F.lit(0), F.col("__e"))
    return counted.select(
        "bin",
        (F.col("__lo") + F.col("bin") * F.col("__w")).alias("lower"),
        (F.col("__lo") + (F.col("bin") + 1) * F.col("__w")).alias("upper"),
        "n",
    )


def range_limited(
    df: DataFrame, value: str, bins: int, low: float, high: float, facet: Sequence[str] = (), empty: bool = True
) -> DataFrame:
    """Histogram of the values strictly between two limits."""
    inside = df.where((F.col(value) > low) & (F.col(value) < high))
    return equal_width(inside, value, bins, facet, empty=empty)
