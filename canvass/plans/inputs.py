"""The given tables read in the roles the operators need, and the same projections as SQL.

Interviews come from ``events``: the user is the interviewer, the event type the state, parity of
the user the survey wave, ``ts`` the start, ``value`` the minutes and the land answer; the number
in ``props`` decides which answers are missing.  Households come from ``documents`` with the
nullable answers of ``labels``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.operators.clock import with_clock


# Enough digits that a mean over a small power of two of rows never falls half-way between two of them.
DIGITS = 9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double so that two engines can be compared."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def rounded_sql(sql: str, columns: str, digits: int = DIGITS) -> str:
    """The same rounding around an SQL query; ``columns`` is a space-separated list."""
    parts = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns.split())
    return f"SELECT * REPLACE ({parts}) FROM ({sql})"


def interviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    end = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.floor("value").cast("int"), F.lit(0))
    e = e.withColumns({"k": k, "te": end}).select(
        F.col("event_id"),
        F.when(F.col("user_id") % 2 == 0, "W1").otherwise("W2").alias("source"),
        F.col("event_type").alias("state"),
        F.col("user_id").alias("interviewer"),
        F.month("ts").alias("month_interview"),
        F.dayofmonth("ts").alias("date_interview"),
        F.hour("ts").alias("hour_start"),
        F.minute("ts").alias("minute_start"),
        F.hour("te").alias("hour_end"),
        F.minute("te").alias("minute_end"),
        F.when(F.col("k") >= 3, F.col("k") % 5 + 1).alias("q_group"),
        F.when(F.col("k") < 96, F.col("k") % 3 + 1).alias("q_kind"),
        F.when((F.col("k") < 40) | (F.col("k") >= 46), F.round("value", 1)).alias("q_size"),
    )
    return with_clock(e)


INTERVIEWS = """
iv0 AS (
  SELECT event_id, user_id, event_type, ts, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
         ts + to_minutes(CAST(floor(value) AS BIGINT)) AS te
  FROM events
), iv AS (
  SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'W1' ELSE 'W2' END AS source, event_type AS state,
         user_id AS interviewer,
         CAST(month(ts) AS INTEGER) AS month_interview, CAST(day(ts) AS INTEGER) AS date_interview,
         CAST(hour(ts) AS INTEGER) AS hour_start, CAST(minute(ts) AS INTEGER) AS minute_start,
         CAST(hour(te) AS INTEGER) AS hour_end, CAST(minute(te) AS INTEGER) AS minute_end,
         CASE WHEN k >= 3 THEN k % 5 + 1 END AS q_group,
         CASE WHEN k < 96 THEN k % 3 + 1 END AS q_kind,
         CASE WHEN k < 40 OR k >= 46 THEN round(value, 1) END AS q_size,
         CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS start_mins,
         CAST(hour(te) * 60 + minute(te) AS INTEGER) AS end_mins,
         CAST((hour(te) * 60 + minute(te)) - (hour(ts) * 60 + minute(ts)) AS INTEGER) AS duration_mins,
         CAST(hour(ts) AS INTEGER) AS start_hour
  FROM iv0
)
"""


def households(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels")
    joined = d.join(labels, "doc_id", "left")
    return joined.select(
        "doc_id",
        F.col("lang").alias("state"),
        "source",
        "n_chars",
        "quality",
        "toxic",
        F.col("quality").isNotNull().cast("int").alias("panel_hh"),
    )


HOUSEHOLDS = """
hh AS (
  SELECT d.doc_id, d.lang AS state, d.source, d.n_chars, l.quality, l.toxic,
         CAST(CASE WHEN l.quality IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS panel_hh
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)
"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its customer, nation and region."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, F.col("c_nationkey") == n.n_nationkey)
        .join(r, F.col("n_regionkey") == r.r_regionkey)
        .select(
            "o_orderkey",
            F.col("r_name").alias("source"),
            F.col("n_nationkey").alias("state"),
            F.col("c_mktsegment").alias("district"),
            F.col("c_custkey").alias("village"),
            "o_totalprice",
            "o_orderpriority",
            "c_acctbal",
        )
    )


PLACES = """
pl AS (
  SELECT o_orderkey, r_name AS source, n_nationkey AS state, c_mktsegment AS district, c_custkey AS village,
         o_totalprice, o_orderpriority, c_acctbal
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
)
"""


def q(with_clause: str, body: str, doubles: str = "") -> str:
    """WITH ... SELECT ..., with the double columns rounded."""
    sql = f"WITH {with_clause} {body}"
    return rounded_sql(sql, doubles) if doubles else sql
