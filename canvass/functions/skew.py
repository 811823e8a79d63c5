"""Joining rows to per-key tables when one key may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.semantics import all_of

# A key is hot when it holds more than 1/HOT_PARTS of all rows, so there are fewer than HOT_PARTS
# hot keys whatever the data: that is the size bound behind the broadcast below.
HOT_PARTS = 10_000


def join_per_key(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    weight: str,
    how: str = "inner",
) -> DataFrame:
    """Inner or semi join of ``df`` with ``table`` (one row per key, ``weight`` = its row count).

    Hot keys are joined against a broadcast of at most ``HOT_PARTS`` rows and are never shuffled;
    each remaining key holds at most 1/HOT_PARTS of the rows and goes through an ordinary shuffled
    join.  Missing keys match each other.  ``table`` should be materialized by the caller.
    """
    if how not in ("inner", "semi"):
        raise ValueError("how must be inner or semi")
    keep = [c for c in table.columns if c not in keys and c != weight] if how == "inner" else []
    total = table.agg(F.sum(weight)).scalar()
    hot = F.coalesce(F.col(weight) * HOT_PARTS > total, F.lit(False))
    renamed = table.select(
        *[F.col(k).alias(f"__key_{k}") for k in keys], *[F.col(c).alias(f"__val_{c}") for c in keep], hot.alias("__hot")
    )
    hot_keys = F.broadcast(renamed.where("__hot")).drop("__hot")
    cold_keys = renamed.where("not __hot").drop("__hot")
    on = all_of(F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys)
    spark_how = "left_semi" if how == "semi" else "inner"

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        out = left.join(right, on, spark_how)
        return out.select(*left.columns, *[F.col(f"__val_{c}").alias(c) for c in keep])

    from_hot = joined(df, hot_keys)
    rest = df.join(hot_keys, on, "left_anti")
    return from_hot.unionByName(joined(rest, cold_keys))
