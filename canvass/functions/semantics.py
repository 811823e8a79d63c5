"""Missing-value, ordering and binning rules shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """NaN counts as missing."""
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def normalize_missing(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every float column, so that one test for missing is enough."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: nan_to_null(F.col(f"`{c}`")) for c in floats}) if floats else df


def log1p_or_null(c: Column | str) -> Column:
    """log(1+x); NULL outside the domain instead of NaN or -Infinity."""
    return nan_to_null(F.log1p(as_col(c)))


def in_set(c: Column | str, values: Iterable) -> Column:
    """Set membership that is FALSE, never NULL, for a missing value."""
    return F.coalesce(as_col(c).isin(list(values)), F.lit(False))


def indicator(condition: Column, missing_as_zero: bool = False) -> Column:
    """0/1 recode of a condition; a NULL condition stays NULL unless ``missing_as_zero``."""
    flag = condition.cast("int")
    return F.coalesce(flag, F.lit(0)) if missing_as_zero else flag


def n_distinct(c: Column | str) -> Column:
    """Distinct levels, a missing value being a level of its own."""
    c = as_col(c)
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("long")), F.lit(0))


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL for a zero denominator (ANSI mode would raise)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def pct(num: Column, den: Column) -> Column:
    return F.try_divide(F.lit(100.0) * num.cast("double"), den.cast("double"))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def complete(columns: Iterable[Column | str]) -> Column:
    """Every column is present."""
    return all_of(as_col(c).isNotNull() for c in columns)


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition in which a missing key matches a missing key."""
    return all_of(left[k].eqNullSafe(right[k]) for k in keys)


def default_labels(breaks: Sequence[float], right: bool) -> list[str]:
    def fmt(b: float) -> str:
        if b in (float("inf"), float("-inf")):
            return "inf" if b > 0 else "-inf"
        return f"{b:g}"

    shape = "({},{}]" if right else "[{},{})"
    return [shape.format(fmt(a), fmt(b)) for a, b in zip(breaks[:-1], breaks[1:])]


def cut(
    c: Column | str,
    breaks: Sequence[float],
    labels: Sequence[str] | None = None,
    right: bool = True,
    include_lowest: bool = False,
) -> tuple[Column, Column]:
    """Bin a number: (label column, ordinal column).

    ``right=True`` bins are (a,b], otherwise [a,b).  Values outside every bin, and missing values,
    give NULL; ``include_lowest`` closes the outermost open edge.
    """
    c = as_col(c)
    names = list(labels) if labels is not None else default_labels(breaks, right)
    if len(names) != len(breaks) - 1:
        raise ValueError("one label per bin is needed")
    label = ordinal = None
    for i, (lo, hi) in enumerate(zip(breaks[:-1], breaks[1:])):
        first, last = i == 0, i == len(names) - 1
        if right:
            above = c >= lo if (first and include_lowest) else c > lo
            inside = above & (c <= hi)
        else:
            below = c <= hi if (last and include_lowest) else c < hi
            inside = (c >= lo) & below
        if lo == float("-inf"):
            inside = (c <= hi) if right else (c < hi)
        elif hi == float("inf"):
            inside = (c > lo) if right else (c >= lo)
        label = F.when(inside, names[i]) if label is None else label.when(inside, names[i])
        ordinal = F.when(inside, i + 1) if ordinal is None else ordinal.when(inside, i + 1)
    return label, ordinal


def trimmed_upper(c: Column | str) -> Column:
    """Upper case without surrounding space, tab, CR or LF."""
    return F.upper(F.regexp_replace(as_col(c), r"^[ \t\r\n]+|[ \t\r\n]+$", ""))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation over complete pairs; NULL when either side is constant."""
    x, y = as_col(x), as_col(y)
    both = x.isNotNull() & y.isNotNull()
    mx, my = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(mx, my), F.stddev_samp(mx) * F.stddev_samp(my))

