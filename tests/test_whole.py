"""Queries that must do the whole job: literal cases."""

from __future__ import annotations

import datetime
import json
import random
import time

from compare import connect, difference
from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.plans import registry


def _of(spark, folder, **tables):
    """A folder of the named tables, each given as rows and schema."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_char_preservation_reads_whole_texts(spark, tmp_path):
    d = _of(
        spark, tmp_path,
        documents=([(1, "a" * 5000 + "b \nc", 5004), (2, " ", 1), (3, "xy", 9)], "doc_id bigint, text string, n_chars bigint"),
        parse_results=([(10, 1, "z" * 4000 + "ab", None), (11, 2, "q", None)], "result_id bigint, doc_id bigint, full_text string, parsed_at timestamp"),
    )
    got = {tuple(r) for r in registry.QUERIES["char_preservation"](spark, d).collect()}
    assert got == {(1, 10, 3.0, 0.666667, True), (2, 11, 0.0, 1.0, True), (3, None, 2.0, None, False)}


def test_language_reads_whole_texts(spark):
    rows = [(0, "a" * 3000 + "合" * 3000), (1, "合" * 3000 + "a" * 27000), (2, "a" * 3000 + "合" * 100), (3, " ")]
    df = spark.createDataFrame(rows, "i int, t string").select("i", scalars.language_of(F.col("t")).alias("l"))
    assert dict(map(tuple, df.collect())) == {0: "zh", 1: "mixed", 2: "en", 3: "unknown"}


def test_registry_lookup_counts_every_supplier(spark, tmp_path):
    d = _of(
        spark, tmp_path,
        nation=([(1, "N", 1), (2, "M", 1)], "n_nationkey int, n_name string, n_regionkey int"), region=([(1, "R")], "r_regionkey int, r_name string"),
        customer=([(5, 1), (6, 1)], "c_custkey bigint, c_nationkey int"), supplier=([(7, 1), (8, 1), (9, 1)], "s_suppkey bigint, s_nationkey int"),
    )
    assert {tuple(r) for r in registry.QUERIES["registry_lookup"](spark, d).collect()} == {("N", "R", 2, 3), ("M", "R", 0, 0)}


def test_wide_records_keeps_every_dataset_and_field(spark, tmp_path):
    cells = [("ds_a", "r1", "x", "1"), ("ds_a", "r1", "y", "2"), ("ds_a", "r1", "x", "1"), ("ds_parties", "r2", "seq_no", "7"), ("ds_b", "r3", "x", None)]
    got = registry.QUERIES["wide_records"](spark, _of(spark, tmp_path, audit_cells=(cells, "dataset_id string, record_id string, field_key string, value string")))
    assert {r["record_id"]: r.asDict() for r in got.collect()} == {
        "r1": {"dataset_id": "ds_a", "record_id": "r1", "seq_no": None, "x": "1", "y": "2"},
        "r2": {"dataset_id": "ds_parties", "record_id": "r2", "seq_no": "7", "x": None, "y": None},
        "r3": {"dataset_id": "ds_b", "record_id": "r3", "seq_no": None, "x": None, "y": None},
    }


def test_graph_diff_compares_deliveries(spark, tmp_path):
    def graph(nodes, edges, **more):
        return json.dumps({"mirror": {"graph": {"nodes": nodes, "edges": edges} | more}})

    edge = lambda a, b: {"from": a, "to": b}
    first = graph([{"id": "b1", "kind": "block", "confidence": 0.8}, {"id": "b2", "kind": "block"}, {"id": "b3"}], [edge("b1", "b2"), edge("b2", "b3")])
    second = graph(json.dumps([{"id": "b1", "kind": "table", "confidence": 0.5}, {"id": "b2", "kind": "block"}, {"id": "b4"}]), {"e1": edge("b1", "b2"), "e2": edge("b2", "b4")}, quality_decision={"decision": "reject"})
    rows = [(1, "A", first), (1, "A", '{"mirror": '), (1, "A", second), (2, "B", first), (3, "C", second), (3, "C", second)]
    at = [(*r, datetime.datetime(2024, 1, 1 + i)) for i, r in enumerate(rows)]
    got = registry.QUERIES["graph_diff"](spark, _of(spark, tmp_path, mirror_artifacts=(at, "artifact_id bigint, document_id string, payload string, received_at timestamp")))
    assert {r["change"]: r["n"] for r in got.collect()} == {
        "node_added": 1, "node_removed": 1, "node_changed": 1, "confidence_changed": 1, "node_same": 4, "edge_added": 1, "edge_removed": 1, "edge_same": 3,
        "quality_decision_changed": 1, "quality_decision_same": 1,
    }


def test_redundant_tables(spark, tmp_path):
    big, small = "a, b\n1, 2\n3, 4", "a, b\n1, 2"
    rows = [(1, 7, 1, big), (2, 7, 1, small), (3, 7, 1, small), (4, 7, 2, small), (5, 7, 1, big), (6, 7, 1, "x, y\n1, 2"), (7, None, 1, small), (8, 7, 1, None)]
    d = _of(spark, tmp_path, text_blocks=(rows, "block_id bigint, doc_id bigint, page_number int, content string"))
    assert {r["block_id"] for r in registry.QUERIES["redundant_tables"](spark, d).collect()} == {2, 3, 5}


_BLOCKS = "block_id bigint, doc_id bigint, page_number int, reading_order int, level string, content string, bbox array<double>"


def test_page_valleys_of_odd_pages(spark, tmp_path):
    inf, nan = float("inf"), float("nan")
    spans = {
        1: [(10, 20), (30.9, 40.2)], 2: [(600, 700)], 3: [(50, 40), (-9, -3)], 4: [(None, 100), (200, None), (None, None)], 5: [(nan, 90), (80, nan), (10, 20)], 6: [(-inf, 30), (40, inf), (inf, inf)],
        7: [(-0.5, -0.5), (594, 594.9), (594.9, 700)], 8: [(0, 594)], 9: [(1e12, 2e12), (5, 9)], 10: [(0, 594)] * 9 + [(0, 300)], 11: [(0, 594)] * 10 + [(100, 101), (103, 103)], 12: [(593, 593)], 13: [(0, 592)],
    }
    r = random.Random(5)
    spans |= {20 + n: [(x := r.uniform(-20, 610), x + r.choice([0, 1, 5, 60, 200])) for _ in range(n)] for n in range(1, 61)}
    rows = [(100 * p + i, p, 1, i, "body", "x", [a, 0.0, b, 9.0]) for p, page in spans.items() for i, (a, b) in enumerate([tuple(None if x is None else float(x) for x in s) for s in page])]
    rows += rows[:9] + [(None, 90, 1, 0, "body", "x", [5.0, 0.0, 9.0, 9.0]), (None, 91, 1, 0, "body", "x", [5.0, 0.0, 9.0, 9.0]), (9101, 91, 1, 0, "body", "x", [20.0, 0.0, 30.0, 9.0]), (9201, 92, None, 0, "body", "x", [5.0, 0.0, 9.0, 9.0]), (9301, 93, 1, 0, "body", "x", [5.0])]
    d = _of(spark, tmp_path, text_blocks=(rows, _BLOCKS))
    assert difference(spark, d, registry.QUERIES["page_valleys"], registry.ORACLES["page_valleys"], connect(d)) == ""
    got = registry.QUERIES["page_valleys"](spark, d).where("doc_id IN (1, 2, 3, 8, 12, 90)").orderBy("doc_id", "starts").select("doc_id", "starts", "width").collect()
    assert got == [(1, 0, 10), (1, 21, 9), (1, 41, 554), (2, 0, 595), (3, 0, 595), (12, 0, 593), (90, 0, 595)]


def test_page_valleys_of_many_pages(spark, tmp_path):
    # 20,000 pages of three blocks: 172 s when every point of a page was held against the peak of all of them
    box = F.array(*[F.lit(10.0) + F.col("id") % 3 * 150, F.lit(0.0), F.lit(90.0) + F.col("id") % 3 * 150, F.lit(9.0)])
    b = spark.range(60_000).selectExpr("id", "id AS block_id", "id DIV 3 AS doc_id", "1 AS page_number", "CAST(id AS INT) AS reading_order", "'body' AS level", "'x' AS content")
    b.withColumn("bbox", box).drop("id").write.parquet(f"{tmp_path}/text_blocks.parquet")
    began = time.time()
    assert registry.QUERIES["page_valleys"](spark, str(tmp_path)).groupBy("starts", "width").count().orderBy("starts").collect() == [(0, 10, 20_000), (91, 69, 20_000), (241, 69, 20_000), (391, 204, 20_000)]
    assert time.time() - began < 60
