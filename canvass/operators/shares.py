"""Counts with shares of a total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canvass.functions.semantics import pct


def count_by(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_share(df: DataFrame, keys: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """n per key and its percentage of the total, or of the total of the ``within`` columns.

    The total is taken from the grouped counts, never from the rows again.  Without ``within`` it
    is a scalar subquery, so the groups are not gathered in one task.
    """
    counts = count_by(df, keys)
    if within:
        total: Column = F.sum("n").over(W.partitionBy(*within))
    else:
        total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", pct(F.col("n"), total))


def overall_and_by(partials: DataFrame, group: str, sums: Sequence[str], overall_label: str = "(all)") -> DataFrame:
    """Sum per-group partial counts and add one overall row, from a table of one row per group.

    The measures are additive, so the grand total costs nothing extra on the rows.
    """
    totals = partials.agg(*[F.sum(c).alias(c) for c in sums]).select(F.lit(overall_label).alias(group), *sums)
    return partials.select(F.col(group).cast("string").alias(group), *sums).unionByName(totals)
