"""Scans, stacking of waves, literal tables, label dictionaries and exports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.functions.semantics import normalize_missing


def read_wave(spark: SparkSession, path: str, tag: str, tag_column: str = "source") -> DataFrame:
    """One survey wave as Parquet, tagged with its name."""
    return normalize_missing(spark.read.parquet(path)).withColumn(tag_column, F.lit(tag))


def shared_columns(first: DataFrame, *others: DataFrame) -> list[str]:
    """Columns present in every table, in the order of the first."""
    return [c for c in first.columns if all(c in o.columns for o in others)]


def stack_waves(*waves: DataFrame) -> DataFrame:
    """Union of the waves on the columns they share."""
    columns = shared_columns(waves[0], *waves[1:])
    return reduce(lambda a, b: a.unionByName(b), [w.select(*columns) for w in waves])


def stack_all(*tables: DataFrame) -> DataFrame:
    """Union by name; a column missing from one table is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, columns: Mapping[str, str]
) -> DataFrame:
    """CSV with a header and an explicit schema; ``columns`` maps output name to header name."""
    raw = spark.read.csv(path, header=True, schema=schema, nanValue="NaN", nullValue="NA", enforceSchema=True)
    picked = raw.select(*[F.col(f"`{header}`").alias(name) for name, header in columns.items()])
    return normalize_missing(picked)


def with_ordinal(df: DataFrame, order_by: Sequence[str], name: str = "ord") -> DataFrame:
    """Attach an explicit order: the struct of the ordering columns.

    Later "first row wins" steps take the minimum of this column, which needs no global sort.
    """
    return df.withColumn(name, F.struct(*order_by))


def literal_table(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def with_labels(df: DataFrame, column: str, labels: DataFrame, label_column: str) -> DataFrame:
    """Join the code -> label dictionary (columns ``code``, ``label``) of a coded column."""
    d = labels.select(F.col("code").alias("__code"), F.col("label").alias(label_column))
    return df.join(d, df[column] == F.col("__code"), "left").drop("__code")


def labels_from_metadata(df: DataFrame, column: str) -> DataFrame:
    """The dictionary kept in a column's ``labels`` metadata, as a table (code, label)."""
    labels = df.schema[column].metadata.get("labels", {})
    rows = [(int(code), text) for code, text in labels.items()]
    return df.sparkSession.createDataFrame(rows, "code int, label string")


def write_csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "error") -> None:
    """Export the chosen columns with a header."""
    df.select(*columns).write.mode(mode).csv(path, header=True)
