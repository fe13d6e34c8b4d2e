"""Readers, writers and streaming twins."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from factloom.plans import registry
from factloom.sources import files
from factloom.streaming import twins

FOLDER = "/root/testdata/sf0.001"


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.bin").write_bytes(b"x")
    (tmp_path / "c.md").write_text("")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.accepted(spark, str(tmp_path)).collect()}
    assert {k: v["status"] for k, v in got.items()} == {"a.txt": "accepted", "b.bin": "unsupported"} and got["a.txt"]["mime"] == "text/plain"
    assert [r["text"] for r in files.texts(spark, str(tmp_path / "a.txt")).collect()] == ["one\ntwo"]


def test_tables(spark):
    df = spark.createDataFrame([(1, "a\tb\n1\t2"), (2, "plain\nlines"), (3, None), (4, "")], "id bigint, t string")
    assert [(r["id"], r["row_no"], r["cells"]) for r in files.delimited(df, "id", "t").orderBy("row_no").collect()] == [(1, 0, ["a", "b"]), (1, 1, ["1", "2"])]
    ledger = "head\n-----\n| no | date | remark |\n| 1 | 2020-01-01 | pay |\n| | | ment |\n| 2 | 2020-01-02 | rent |\nTotal | 2 | |"
    got = files.pipe_tables(spark.createDataFrame([(1, ledger), (2, None)], "id bigint, t string"), "id", "t").orderBy("row_no").collect()
    assert [r["cells"] for r in got] == [["1", "2020-01-01", "payment"], ["2", "2020-01-02", "rent"]]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("d", "r", "b", "=1+1"), ("d", "r", "a", "x"), ("d", "r", "a", "x"), ("d", "r", None, "y")], "dataset_id string, record_id string, field_key string, value string")
    files.write_bundle(rows, str(tmp_path / "bundle"))
    assert json.loads(spark.read.text(str(tmp_path / "bundle")).first()[0])["fields"] == {"a": "x", "b": "=1+1"}
    files.write_audit_csv(rows.where("field_key = 'b'"), str(tmp_path / "csv"))
    text = "".join(p.read_bytes().decode() for p in (tmp_path / "csv").glob("*.csv"))
    assert "'=1+1" in text and "\r\n" in text


def _stream(spark):
    return spark.readStream.schema(spark.read.parquet(f"{FOLDER}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(FOLDER)


def _run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_streams_equal_batches(spark):
    got = _run(twins.windows(_stream(spark)), "win", "complete")
    want = registry.QUERIES["event_windows"](spark, FOLDER)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    state = {r["user_id"]: (r["ok"], r["failed"]) for r in _run(twins.outcomes(_stream(spark)), "out", "update").collect()}
    want = {r["user_id"]: (r["a"], r["b"]) for r in events.groupBy("user_id").agg(F.count_if(F.col("value") > 0).alias("a"), F.count_if(F.col("value") <= 0).alias("b")).collect()}
    assert state == want
    once = _run(twins.first_deliveries(_stream(spark), "event_id", "ts", "100000 hours"), "once", "append")
    assert once.count() == events.select("event_id").distinct().count()
    assert _run(twins.sessions(_stream(spark)), "ses", "append").count() >= 0
