"""One-off ingest of Stata files into Parquet plus a value-label table."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_stata(spark: SparkSession, path_glob: str, schema: T.StructType, chunk_rows: int = 50_000) -> DataFrame:
    """All ``.dta`` files under a glob as one table, one task per file, read in chunks.

    Codes stay numeric; a column of the schema that a file lacks is NULL.  Write the result to
    Parquet once and run every analysis on that.
    """
    names = schema.fieldNames()
    target = {
        f.name: "string" if isinstance(f.dataType, T.StringType) else "Float64" for f in schema.fields
    }
    whole = {f.name for f in schema.fields if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType))}

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                reader = pd.read_stata(
                    io.BytesIO(content), convert_categoricals=False, chunksize=chunk_rows, convert_dates=False
                )
                with reader:
                    for chunk in reader:
                        out = chunk.reindex(columns=names)
                        for name in names:
                            series = out[name]
                            if target[name] == "string":
                                out[name] = series.astype(object).where(series.notna(), None)
                            else:
                                number = pd.to_numeric(series, errors="coerce")
                                out[name] = number.astype("Int64") if name in whole else number.astype("float64")
                        yield out

    files = spark.read.format("binaryFile").load(path_glob).select("content")
    return files.mapInPandas(decode, schema)


def read_stata_labels(spark: SparkSession, path_glob: str) -> DataFrame:
    """Value labels of the same files as a table (label_set, code, label)."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with pd.io.stata.StataReader(io.BytesIO(content)) as reader:
                    sets = reader.value_labels()
                rows = [(s, int(code), str(text)) for s, m in sets.items() for code, text in m.items()]
                yield pd.DataFrame(rows, columns=["label_set", "code", "label"])

    files = spark.read.format("binaryFile").load(path_glob).select("content")
    return files.mapInPandas(decode, "label_set string, code int, label string").distinct()
