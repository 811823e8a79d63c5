"""How many places and observations a survey covers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.quantiles import discrete_summary, mean_median, six_number_summary
from canvass.functions.semantics import n_distinct, ratio
from canvass.operators.shares import count_by


def distinct_counts(
    df: DataFrame, levels: Mapping[str, str], by: Sequence[str] = (), approximate: bool = False
) -> DataFrame:
    """Rows and distinct levels of several columns (a missing level counts as one).

    ``approximate`` swaps in the mergeable sketch, which avoids shuffling the distinct values.
    """
    if approximate:
        measures = [
            (F.approx_count_distinct(c) + F.coalesce(F.max(F.col(c).isNull().cast("long")), F.lit(0))).alias(n)
            for n, c in levels.items()
        ]
    else:
        measures = [n_distinct(c).alias(n) for n, c in levels.items()]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("observations"), *measures)


def observations_per(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per place."""
    return count_by(df, keys)


def frequency_table(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first, missing values left out; ties in value order."""
    known = count_by(df.where(F.col(column).isNotNull()), [column])
    return known.orderBy(F.desc("n"), F.asc(column))


def size_summary(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Six-number summary of rows per place, per source."""
    return six_number_summary(count_by(df, keys), by, "n")


def size_mean_median(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    return mean_median(count_by(df, keys), by, "n")


def cluster_structure(df: DataFrame, clusters: Mapping[str, Sequence[str]]) -> DataFrame:
    """Number of clusters, smallest, median and largest size and their ratio, per cluster level.

    The rows are grouped once by all key columns; every level is added up from those counts.
    """
    every: list[str] = []
    for keys in clusters.values():
        every += [k for k in keys if k not in every]
    finest = count_by(df, every, "__rows")
    parts = []
    for level, keys in clusters.items():
        sizes = finest.groupBy(*keys).agg(F.sum("__rows").alias("n"))
        s = discrete_summary(sizes, [], "n", (0.5,))
        parts.append(
            s.select(
                F.lit(level).alias("level"),
                F.col("n").alias("n_clusters"),
                F.col("min").alias("min_size"),
                F.col("q")[0].alias("median_size"),
                F.col("max").alias("max_size"),
                ratio(F.col("max"), F.col("min")).alias("size_ratio"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
