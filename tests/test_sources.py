"""Ingest, stacking, label dictionaries and export."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.operators import histogram, panel
from canvass.sources import stata, tables


def test_waves_are_stacked_on_shared_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a", 2.0)], "x int, y string, only1 double").write.parquet(str(tmp_path / "w1"))
    spark.createDataFrame([("b", 2, 7)], "y string, x int, only2 int").write.parquet(str(tmp_path / "w2"))
    one = tables.read_wave(spark, str(tmp_path / "w1"), "W1")
    two = tables.read_wave(spark, str(tmp_path / "w2"), "W2")
    both = tables.stack_waves(one, two)
    assert both.columns == ["x", "y", "source"]
    assert {tuple(r) for r in both.collect()} == {(1, "a", "W1"), (2, "b", "W2")}


def test_csv_round_trip_with_dotted_headers(spark, tmp_path):
    (tmp_path / "g.csv").write_text("District.Name,Village.Code,Note\nUP,12,x\nNA,notanumber,y\n")
    df = tables.read_csv(
        spark, str(tmp_path / "g.csv"), "`District.Name` string, `Village.Code` string, Note string",
        {"district": "District.Name", "code": "Village.Code"})
    assert [tuple(r) for r in df.collect()] == [("UP", "12"), (None, "notanumber")]
    tables.write_csv(df.withColumn("extra", F.lit(1)), str(tmp_path / "out"), ["code", "district"])
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert back.columns == ["code", "district"] and back.count() == 2


def test_labels_from_metadata_and_table(spark):
    schema = T.StructType([T.StructField("reason", T.IntegerType(), True, {"labels": {"1": "moved", "2": "refused"}})])
    df = spark.createDataFrame([(1,), (2,), (1,), (9,), (None,)], schema)
    out = panel.reason_distribution(df, "reason", tables.labels_from_metadata(df, "reason"))
    assert [(r.reason, r.n, r.label) for r in out.collect()] == [(1, 2, "moved"), (2, 1, "refused"), (9, 1, None)]


def test_stata_files_become_one_table(spark, tmp_path):
    for i, extra in enumerate(({}, {"other": [1.0, 2.0]})):
        d = pd.DataFrame({"village": np.array([i, 7], dtype="int32"), "name": ["a", ""], "land": [1.5, np.nan], **extra})
        d.to_stata(tmp_path / f"w{i}.dta", write_index=False, value_labels={"village": {7: "seven"}})
    schema = T.StructType.fromDDL("village int, name string, land double, other double")
    df = stata.read_stata(spark, str(tmp_path / "*.dta"), schema, chunk_rows=1)
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert got == [(0, "a", 1.5, None), (1, "a", 1.5, 1.0), (7, "", None, 2.0), (7, "", None, None)]
    labels = stata.read_stata_labels(spark, str(tmp_path / "*.dta")).collect()
    assert [(r.code, r.label) for r in labels] == [(7, "seven")]


def test_ordinals_and_literals(spark):
    df = tables.literal_table(spark, [("b", 1), ("a", 2)], "k string, v int")
    assert tables.with_ordinal(df, ["v"]).agg(F.min("ord.v")).first()[0] == 1


def test_histograms_partition_the_rows(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 2.5, 9.99, 10]] + [(None,)], "x double")
    h = {r.bin: r.n for r in histogram.equal_width(df, "x", 5).collect()}
    assert h == {0: 2, 1: 2, 2: 0, 3: 0, 4: 2}
    assert histogram.equal_width(df, "x", 5, empty=False).count() == 3
    fixed = {r.bin: r.n for r in histogram.fixed_width(df, "x").collect()}
    assert sum(fixed.values()) == 6 and fixed[2] == 2
    nice = histogram.suggested_bins(df, "x", 5).collect()
    assert sum(r.n for r in nice) == 6 and {r.upper - r.lower for r in nice} == {2.0}
    assert {r.bin: r.n for r in histogram.equal_width(df.where("x = 1"), "x", 5).collect()} == {0: 1}
    assert sum(r.n for r in histogram.log10_axis(df, "x", 4).collect()) == 5
    assert sum(r.n for r in histogram.range_limited(df, "x", 4, 0, 10).collect()) == 4
    limited = histogram.equal_width(df, "x", 2, low=0, high=4).collect()
    assert {r.bin: r.n for r in limited} == {0: 2, 1: 2}
