"""Exporters, manifests, fragments, projections, and streams written once."""

from __future__ import annotations

import csv

import pytest
from pyspark.sql import functions as F

from factloom.sources import exports
from factloom.streaming import sinks

FOLDER = "/root/testdata/sf0.001"


def test_outputs_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, "=1+1", ["a"]), (2, 'x, "y"', None), (2, 'x, "y"', None)], "k int, v string, l array<string>")
    got = exports.write_outputs({"wide": (df, "csv"), "facts": (df, "parquet"), "lines": (df.select("v"), "text"), "rows": (df, "json")}, str(tmp_path / "out"))
    assert got == exports.read_manifest(spark, str(tmp_path / "out")) and got["facts"]["rows"] == 3 and got["facts"]["columns"] == ["k", "v", "l"]
    assert got["facts"]["digest"] == exports.fingerprint(spark.read.parquet(str(tmp_path / "out/facts")).orderBy(F.rand(3)))[1] != exports.fingerprint(df.distinct())[1]
    rows = [r for p in (tmp_path / "out/wide").glob("*.csv") for r in list(csv.reader(p.open(newline="")))[1:]]
    assert sorted(rows) == [["1", "'=1+1", '["a"]'], ["2", 'x, "y"', ""], ["2", 'x, "y"', ""]]
    with pytest.raises(FileExistsError):
        exports.write_outputs({"facts": (df, "parquet")}, str(tmp_path / "out"))
    with pytest.raises(KeyError, match="csv, json, parquet, text"):
        exports.write_outputs({"facts": (df, "xlsx")}, str(tmp_path / "other"))


def test_fragments_replace_only_their_page(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "page int, v string")
    exports.write_fragments(df, str(tmp_path / "f"), "page")
    exports.write_fragments(df.where("page = 2").withColumn("v", F.lit("c")), str(tmp_path / "f"), "page")
    assert {(r["page"], r["v"]) for r in spark.read.json(str(tmp_path / "f")).collect()} == {(1, "a"), (2, "c")}


def test_projection_renames_and_names_what_is_missing(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    assert [r.asDict() for r in exports.project(df, {"id": "k", "text": lambda d: F.upper(d["v"])}).collect()] == [{"id": 1, "text": "A"}]
    with pytest.raises(KeyError, match="no column 'w'"):
        exports.project(df, {"x": "w"})


def test_a_stream_is_written_once(spark, tmp_path):
    stream = lambda: spark.readStream.schema(spark.read.parquet(f"{FOLDER}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(FOLDER)
    for _ in range(2):
        q = sinks.write_once(stream(), str(tmp_path / "s"), str(tmp_path / "c"))
        assert q.awaitTermination(120) and q.exception() is None
    rows = spark.read.parquet(str(tmp_path / "s"))
    assert rows.count() == spark.read.parquet(f"{FOLDER}/events.parquet").count() and sinks.totals(rows, "event_type").where("batches <> 1").count() == 0
