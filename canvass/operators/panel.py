"""Panel membership, locked houses, reasons and attrition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.semantics import pct
from canvass.operators.shares import count_share
from canvass.sources.tables import with_labels


def applicable(df: DataFrame, *columns: str) -> bool:
    """The analysis makes sense only when the wave has these columns."""
    return all(c in df.columns for c in columns)


def code_distribution(df: DataFrame, code: str) -> DataFrame:
    """Rows and percentage per code; a missing code is a row of its own."""
    return count_share(df, [code])


def flag_rate(df: DataFrame, flag: str, keys: Sequence[str], name: str, min_n: int = 0) -> DataFrame:
    """Rows, rows with flag = 1 and their percentage per group."""
    rows = F.count(F.lit(1))
    hits = F.count_if(F.col(flag) == 1)
    out = df.groupBy(*keys).agg(rows.alias("n"), hits.alias(f"n_{name}"), pct(hits, rows).alias(f"pct_{name}"))
    return out.where(F.col("n") >= min_n) if min_n else out


def reason_distribution(df: DataFrame, reason: str, labels: DataFrame | None = None) -> DataFrame:
    """Share of each given reason, missing ones left out, with its label when there is a dictionary."""
    out = count_share(df.where(F.col(reason).isNotNull()), [reason])
    if labels is not None:
        out = with_labels(out, reason, labels, "label")
    return out.orderBy(F.desc("n"), F.asc(reason))


def panel_attrition(df: DataFrame, panel: str, locked: str, by: Sequence[str] = ()) -> DataFrame:
    """Interviewed and not-interviewed panel households.

    A missing ``locked`` counts as interviewed.  The interviewed share divides by all panel
    households; the locked share only by those with a known ``locked`` value.
    """
    rows = F.count(F.lit(1))
    state = F.col(locked)
    interviewed = F.count_if(state.isNull() | (state == 0))
    known = F.count(state)
    gone = F.count_if(state == 1)
    return (
        df.where(F.col(panel) == 1)
        .groupBy(*by)
        .agg(
            rows.alias("n_panel"),
            interviewed.alias("n_interviewed"),
            pct(interviewed, rows).alias("pct_interviewed"),
            known.alias("n_known"),
            gone.alias("n_locked"),
            pct(gone, known).alias("pct_locked"),
        )
    )


def attrition_outliers(per_interviewer: DataFrame, limit: float = 10.0) -> DataFrame:
    """Interviewers past the size gate and those above the locked-house limit."""
    return per_interviewer.agg(
        F.count(F.lit(1)).alias("n_interviewers"), F.count_if(F.col("pct_locked") > limit).alias("n_above")
    )


def worst(per_interviewer: DataFrame, measure: str, keys: Sequence[str], top: int = 10) -> DataFrame:
    """The ``top`` rows by a measure, with a full tie-break."""
    return per_interviewer.orderBy(
        F.col(measure).desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys]
    ).limit(top)
