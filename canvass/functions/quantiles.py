"""Exact quantiles (linear interpolation between order statistics) without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.semantics import all_of, nan_to_null
from canvass.functions.skew import join_per_key
from canvass.session import materialize

QUARTILES = (0.25, 0.5, 0.75)
# A bracket is cut into this many parts by the sketch of its values, until at most FEW rows are left to order.
STEPS = 200
FEW = 10_000


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows per (keys, value).  The value is part of the grouping key, so a hot group is spread out."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))


def weighted_percentiles(value: str, probs: Sequence[float], weight: str = "__n") -> Column:
    """Array of exact percentiles of a value-count table."""
    wanted = ", ".join(repr(float(p)) for p in probs)
    return F.expr(f"percentile(`{value}`, array({wanted}), `{weight}`)")


def discrete_summary(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Count, min, quantiles, mean and max per group for a value with few distinct levels.

    Meant for counts and whole minutes: the rows are first reduced to (group, value) counts, and a
    group of n rows cannot hold more than about sqrt(2 n) different counts.
    Use :func:`continuous_summary` for measurements.
    """
    counts = value_counts(df, keys, value)
    return counts.groupBy(*keys).agg(
        F.sum("__n").alias("n"),
        F.min(value).alias("min"),
        weighted_percentiles(value, probs).alias("q"),
        F.try_divide(F.sum(F.col(value).cast("double") * F.col("__n")), F.sum("__n")).alias("mean"),
        F.max(value).alias("max"),
    )


def _round_of_counts(base: DataFrame, keys: Sequence[str], targets: DataFrame, accuracy: int) -> DataFrame:
    """One scan: each target's bracket is checked against counts and narrowed.

    A target is (keys, rank) with a bracket of values; ``lo`` or ``hi`` is NULL where it is open.  The rows under, on and
    inside the bracket are counted.  A rank on a border is found; one that lies outside shows that the bracket was
    wrong, and the part of the range on that side takes its place; for one inside, a sketch of the inner values gives
    a narrower bracket.  Nothing but partial aggregates is shuffled.
    """
    v, lo, hi = F.col("__v"), F.col("t.lo"), F.col("t.hi")
    packed = targets.groupBy(*keys).agg(F.max("n").alias("n"), F.collect_list(F.struct("rank", "lo", "hi")).alias("__t"))
    if keys:
        rows = join_per_key(base, materialize(packed), keys, "n")
    else:
        rows = base.withColumn("__t", packed.select("__t").scalar())
    # a value above every bracket yields no row
    rows = rows.select(*keys, "__v", F.explode(F.expr("filter(__t, t -> t.hi is null or __v <= t.hi)")).alias("t"))
    inner = (lo.isNull() | (v > lo)) & (hi.isNull() | (v < hi))
    steps = [i / STEPS for i in range(STEPS + 1)]
    counted = rows.groupBy(*keys, F.col("t.rank").alias("rank"), lo.alias("lo"), hi.alias("hi")).agg(
        F.count_if(v < lo).alias("__under"),
        F.count_if(v == lo).alias("__on_lo"),
        F.count_if(inner).alias("__inside"),
        F.count_if(v == hi).alias("__on_hi"),
        F.percentile_approx(F.when(inner, v), steps, accuracy).alias("__s"),
    )
    own = [F.col(k).alias(f"__k_{k}") for k in keys] + [F.col("rank").alias("__rank")]
    counted = counted.select(*own, "__under", "__on_lo", "__inside", "__on_hi", "__s")
    on = all_of([F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("rank") == F.col("__rank")])
    # a target without any counted row has all rows above its bracket
    t = targets.join(counted, on, "left").fillna(0, ["__under", "__on_lo", "__inside", "__on_hi"])
    rank = F.col("rank")
    to_lo = F.col("__under") + F.col("__on_lo")
    to_inside = to_lo + F.col("__inside")
    to_hi = to_inside + F.col("__on_hi")
    place = (
        F.when(rank < F.col("__under"), "under")
        .when(rank < to_lo, "lo")
        .when(rank < to_inside, "inside")
        .when(rank < to_hi, "hi")
        .otherwise("over")
    )
    part = (rank - to_lo) / F.col("__inside")
    # the sketch may be off by 1/accuracy of the inner rows; a border that was missed is noticed in the next round
    first = F.floor((part - 2.0 / accuracy) * STEPS).cast("int")
    last = F.ceil((part + 2.0 / accuracy) * STEPS).cast("int")
    few = F.col("__inside") <= FEW
    # borders stay until the sketch moves them; a NULL border is open
    new_lo = F.when((first >= 1) & ~few, F.col("__s")[F.least(first, F.lit(STEPS))]).otherwise(F.col("lo"))
    new_hi = F.when((last <= STEPS - 1) & ~few, F.col("__s")[F.greatest(last, F.lit(0))]).otherwise(F.col("hi"))
    t = t.withColumn("__place", place)
    where = F.col("__place")
    return t.select(
        *keys,
        "n",
        "rank",
        F.when(where == "under", None).when(where == "over", F.col("hi")).when(where == "inside", new_lo).otherwise(F.col("lo")).alias("lo"),
        F.when(where == "under", F.col("lo")).when(where == "over", None).when(where == "inside", new_hi).otherwise(F.col("hi")).alias("hi"),
        F.when((where == "inside") & few, to_lo).alias("below"),
        F.when(where == "lo", F.col("lo")).when(where == "hi", F.col("hi")).alias("value"),
    )


def order_statistics(base: DataFrame, keys: Sequence[str], targets: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """The value of each (keys, rank), ranks from 0, among the ``__v`` of ``base``; columns keys, rank, value.

    ``targets`` has keys, n, rank and a first bracket lo, hi (values; NULL: open).  The result is exact for every
    bracket: a wrong one is noticed by its counts and costs a round.  Each round narrows a bracket to about 1/STEPS
    of its rows, so the number of rounds grows with the logarithm of a group.  Once at most ``FEW`` rows lie strictly inside,
    these alone are gathered and ordered; equal values are borders or counted, and never gathered beyond that.
    """
    keys = list(keys)
    blank = [F.lit(None).cast("long").alias("below"), F.lit(None).cast("double").alias("value")]
    known = ["below is not null", "value is not null"]
    # a group of few rows is ordered at once
    start = targets.select(*keys, "n", "rank", "lo", "hi", *blank)
    small = start.where(F.col("n") <= FEW).withColumns(
        {"lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"), "below": F.lit(0).cast("long")}
    )
    state = materialize(small.unionByName(start.where(F.col("n") > FEW)))
    ready = state.where(" or ".join(known))
    open_ = state.where("below is null and value is null")
    while not open_.isEmpty():
        state = materialize(ready.unionByName(_round_of_counts(base, keys, open_, accuracy)))
        ready = state.where(" or ".join(known))
        open_ = state.where("below is null and value is null")
    to_order = state.where("value is null")
    packed = to_order.groupBy(*keys).agg(
        F.max("n").alias("n"), F.collect_list(F.struct("rank", "below", "lo", "hi")).alias("__t")
    )
    if keys:
        rows = join_per_key(base, materialize(packed), keys, "n")
    else:
        rows = base.withColumn("__t", packed.select("__t").scalar())
    inner = "filter(__t, t -> (t.lo is null or __v > t.lo) and (t.hi is null or __v < t.hi))"
    gathered = rows.select(*keys, "__v", F.explode(F.expr(inner)).alias("t")).groupBy(*keys, "t.rank", "t.below").agg(
        F.array_sort(F.collect_list("__v")).alias("__all")
    )
    ordered = gathered.select(*keys, "rank", F.get("__all", (F.col("rank") - F.col("below")).cast("int")).alias("value"))
    return state.where("value is not null").select(*keys, "rank", "value").unionByName(ordered)


def continuous_summary(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int = 10_000
) -> DataFrame:
    """The same summary for a measurement with any number of distinct levels.

    One pass builds a quantile sketch per group (kept in a checkpoint) and brackets every wanted rank between two values.
    :func:`order_statistics` checks the brackets by counting and narrows them until few values are left to order, so
    the result is exact, whatever the sketch says, and no task ever orders a group.
    """
    keys = list(keys)
    base = df.select(*keys, nan_to_null(F.col(value).cast("double")).alias("__v")).where("__v is not null")
    margin = 3.0 / accuracy
    edges = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    m = len(probs)
    sketch = materialize(
        base.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            F.min("__v").alias("min"),
            F.avg("__v").alias("mean"),
            F.max("__v").alias("max"),
            F.percentile_approx("__v", edges, accuracy).alias("__e"),
        )
    )
    wanted = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                ((F.col("n") - 1) * F.lit(float(p))).alias("at"),
                F.col("__e")[i].alias("lo"),
                F.col("__e")[m + i].alias("hi"),
            )
            for i, p in enumerate(probs)
        ]
    )
    points = sketch.where("n > 0").select(*keys, "n", F.explode(wanted).alias("p")).select(*keys, "n", "p.*")
    low, high = F.floor("at"), F.ceil("at")
    targets = (
        points.select(*keys, "n", "lo", "hi", F.explode(F.array_distinct(F.array(low, high))).alias("rank"))
        .groupBy(*keys, "n", "rank")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    found = order_statistics(base, keys, targets, accuracy)
    per_group = found.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("__r")
    )
    if keys:
        on = all_of(F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys)
        joined = sketch.join(per_group, on, "left")
    else:
        joined = sketch.withColumn("__r", per_group.scalar())

    def quantile(p: float) -> Column:
        at = (F.col("n") - 1) * F.lit(float(p))
        below, above = F.element_at("__r", F.floor(at)), F.element_at("__r", F.ceil(at))
        return F.when(F.floor(at) == F.ceil(at), below).otherwise(below + (at - F.floor(at)) * (above - below))

    q = F.when(F.col("n") > 0, F.array(*[quantile(p) for p in probs]))
    return joined.select(*keys, "n", "min", q.alias("q"), "mean", "max")


def approximate_summary(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int = 10_000
) -> DataFrame:
    """The same summary from the sketch alone: one pass, quantiles within n/accuracy ranks."""
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(value).alias("min"),
        F.percentile_approx(F.col(value).cast("double"), list(probs), accuracy).alias("q"),
        F.avg(value).alias("mean"),
        F.max(value).alias("max"),
    )


def _maker(discrete: bool, approximate: bool):
    if approximate:
        return approximate_summary
    return discrete_summary if discrete else continuous_summary


def six_number_summary(
    df: DataFrame, keys: Sequence[str], value: str, discrete: bool = True, approximate: bool = False
) -> DataFrame:
    """n, min, Q1, median, mean, Q3, max per group."""
    s = _maker(discrete, approximate)(df, keys, value, QUARTILES)
    return s.select(
        *keys,
        "n",
        F.col("min").cast("double").alias("min"),
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("median"),
        F.col("mean").alias("mean"),
        F.col("q")[2].alias("q3"),
        F.col("max").cast("double").alias("max"),
    )


def mean_median(
    df: DataFrame, keys: Sequence[str], value: str, discrete: bool = True, approximate: bool = False
) -> DataFrame:
    """n, mean and median per group."""
    s = _maker(discrete, approximate)(df, keys, value, (0.5,))
    return s.select(*keys, "n", F.col("mean"), F.col("q")[0].alias("median"))
