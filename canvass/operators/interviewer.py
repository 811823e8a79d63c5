"""How many people stand behind one interviewer name, and how much they get done per day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.quantiles import mean_median
from canvass.functions.semantics import null_safe, ratio
from canvass.operators.clock import MAX_MINUTES, MIN_MINUTES, in_range


def concurrency_by_day(df: DataFrame, name: Sequence[str], day: Sequence[str], slot: Sequence[str]) -> DataFrame:
    """Interviews per name and day, and the largest number sharing one (start, end) slot.

    Counting by slot first means the second grouping only sees one row per slot.
    """
    slots = df.groupBy(*name, *day, *slot).agg(F.count(F.lit(1)).alias("__n"))
    return slots.groupBy(*name, *day).agg(F.sum("__n").alias("n"), F.max("__n").alias("min_people"))


def concurrency(by_day: DataFrame, name: Sequence[str]) -> DataFrame:
    """Fewest people that can stand behind each name."""
    return by_day.groupBy(*name).agg(F.max("min_people").alias("min_people"))


def concurrency_summary(per_name: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Names that stand for one, two or more, four or more people."""
    people = F.col("min_people")
    return per_name.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_names"),
        F.count_if(people == 1).alias("n_single"),
        F.count_if(people >= 2).alias("n_two_plus"),
        F.count_if(people >= 4).alias("n_four_plus"),
    )


def daily_productivity(by_day: DataFrame, name: Sequence[str]) -> DataFrame:
    """Per name-day: raw count, count per person, and whether the name is a single person.

    The raw count and the number of people come from one grouping, so no join is needed for the
    adjusted count; the single-person names are found with a null-safe semi join.
    """
    daily = by_day.withColumn("adjusted", ratio(F.col("n"), F.col("min_people")))
    single = concurrency(by_day, name).where("min_people = 1").select(*name, F.lit(True).alias("__single"))
    joined = daily.join(single, null_safe(daily, single, name), "left")
    return joined.select(
        *[daily[c] for c in daily.columns], F.coalesce(F.col("__single"), F.lit(False)).alias("single_person")
    )


def single_person_days(by_day: DataFrame, name: Sequence[str]) -> DataFrame:
    """Name-days of names that never need more than one person."""
    single = concurrency(by_day, name).where("min_people = 1").select(*name)
    return by_day.join(single, null_safe(by_day, single, name), "left_semi")


def productivity_summary(daily: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, mean and median of interviews per day: as recorded, per person, and for single-person names."""
    raw = mean_median(daily, by, "n").withColumn("measure", F.lit("raw"))
    adjusted = mean_median(daily, by, "adjusted", discrete=False).withColumn("measure", F.lit("adjusted"))
    single = mean_median(daily.where("single_person"), by, "n").withColumn("measure", F.lit("single"))
    return raw.unionByName(adjusted).unionByName(single)


def valid_duration_stats(
    df: DataFrame, by: Sequence[str], duration: str, low: float = MIN_MINUTES, high: float = MAX_MINUTES
) -> DataFrame:
    """n, mean and median of durations inside [low, high]."""
    return mean_median(df.where(in_range(duration, low, high)), by, duration)
