"""Fieldwork calendar and time-of-day patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canvass.functions.quantiles import mean_median, six_number_summary
from canvass.operators.clock import MAX_MINUTES, MIN_MINUTES, in_range
from canvass.operators.shares import count_by


def month_day_key(month: str, day: str):
    """Two-digit text key (month-day) for display; a missing part prints as NA."""

    def two(c: str):
        return F.when(F.col(c).isNotNull(), F.format_string("%02d", F.col(c).cast("int"))).otherwise("NA")

    return F.concat(two(month), F.lit("-"), two(day))


def daily_volume(df: DataFrame, source: str, month: str, day: str) -> DataFrame:
    """Interviews per source and calendar day (there is no year)."""
    return count_by(df, [source, month, day], "n_interviews")


def fieldwork_timeline(df: DataFrame, source: str, month: str, day: str) -> DataFrame:
    """First and last (month, day) and the number of distinct days per source."""
    days = daily_volume(df, source, month, day)
    known = F.when(F.col(month).isNotNull() & F.col(day).isNotNull(), F.struct(month, day))
    return days.groupBy(source).agg(F.min(known).alias("f"), F.max(known).alias("l"), F.count(F.lit(1)).alias("n_days")).select(
        source,
        F.col(f"f.{month}").alias("first_month"),
        F.col(f"f.{day}").alias("first_day"),
        F.col(f"l.{month}").alias("last_month"),
        F.col(f"l.{day}").alias("last_day"),
        "n_days",
    )


def volume_by_month(df: DataFrame, source: str, month: str) -> DataFrame:
    return count_by(df, [source, month])


def daily_volume_summary(df: DataFrame, source: str, month: str, day: str) -> DataFrame:
    """Six-number summary of interviews per day, per source."""
    return six_number_summary(daily_volume(df, source, month, day), [source], "n_interviews")


def hourly_counts(df: DataFrame, source: str, hour: str) -> DataFrame:
    return count_by(df.where(F.col(hour).between(0, 23)), [source, hour])


def peak_hours(df: DataFrame, source: str, hour: str, k: int = 3) -> DataFrame:
    """The k busiest start hours per source; hours tied with the k-th are kept."""
    rank = F.rank().over(W.partitionBy(source).orderBy(F.desc("n")))
    return hourly_counts(df, source, hour).withColumn("rank", rank).where(F.col("rank") <= k)


def duration_by_hour(
    df: DataFrame,
    source: str,
    hour: str,
    duration: str,
    low: float = MIN_MINUTES,
    high: float = MAX_MINUTES,
    min_n: int = 50,
) -> DataFrame:
    """n, mean and median valid duration by start hour (end-of-day rushing)."""
    valid = df.where(in_range(duration, low, high) & F.col(hour).isNotNull())
    return mean_median(valid, [source, hour], duration).where(F.col("n") >= min_n)


def day_of_month(df: DataFrame, source: str, day: str) -> DataFrame:
    return count_by(df.where(F.col(day).isNotNull()), [source, day])
