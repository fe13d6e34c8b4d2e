"""Pipelines, registries, plans of work and results taken up again."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.runtime import pipeline, work


def test_registry():
    r = pipeline.Registry("reader")
    r.register("a", 1), r.register("a", 2, priority=5), r.register("b", 3)
    assert r.get("a") == 2 and r.names() == ["a", "b"] and r.first(lambda t: t % 2) == 1 and r.first(lambda t: t > 9) is None
    with pytest.raises(ValueError, match="registered"):
        r.register("b", 4)
    with pytest.raises(KeyError, match="a, b"):
        r.get("c")


def test_pipeline_orders_and_audits(spark):
    up = pipeline.Stage("up", lambda df: df.withColumn("v", F.upper("v")), needs=("clean",), audited=("v",))
    clean = pipeline.Stage("trim", lambda df: df.withColumn("v", F.trim("v")), provides=("clean",))
    drop = pipeline.Stage("drop", lambda df: df.where("k < 3"), needs=("up",), audited=("_row",))
    p = pipeline.Pipeline([drop, up, clean])
    assert [s.name for s in p.stages] == ["trim", "up", "drop"]
    df = spark.createDataFrame([(1, " a"), (2, "B"), (3, None)], "k int, v string")
    out, trail = p.audited(df, "k")
    assert {tuple(r) for r in out.collect()} == {(1, "A"), (2, "B")}
    assert {tuple(r) for r in trail.collect()} == {("trim", 1, "v", " a", "a"), ("up", 1, "v", "a", "A"), ("drop", 3, "_row", "true", None)}
    assert {tuple(r) for r in p.unaudited(df, "k").collect()} == {("trim", "v", 1)}
    with pytest.raises(ValueError, match="no stage provides"):
        pipeline.Pipeline([up])


def test_fallback_reads_each_row_once(spark):
    df = spark.createDataFrame([(1, "1"), (2, "x"), (3, None)], "k int, v string")
    got = pipeline.with_fallback(df, "k", lambda d: d.withColumn("n", F.col("v").try_cast("int")), lambda d: d.withColumn("n", F.lit(-1)), "n IS NULL")
    assert {tuple(r) for r in got.collect()} == {(1, "1", 1), (2, "x", -1), (3, None, -1)}


def test_plugins(spark):
    class All:
        def project(self, facts):
            return facts.limit(1)

    plugins = pipeline.Plugins()
    plugins.add(pipeline.Plugin("base", ("*",), {"community": All()}))
    plugins.add(pipeline.Plugin("own", ("law",), {"community": All()}))
    assert plugins.project("law", "community", spark.range(3)).count() == plugins.project("tax", "community", spark.range(3)).count() == 1
    assert plugins.project("law", "none", spark.range(3)) is None and plugins.discover("no.such.group") == []
    with pytest.raises(ValueError, match="served by own"):
        plugins.add(pipeline.Plugin("third", ("law",), {"community": All()}))
    stages = pipeline.Registry("stage")
    for n in ("types", "names", "gates"):
        stages.register(n, pipeline.Stage(n, lambda d: d))
    assert [s.name for s in pipeline.resolve("data", "full", stages).stages] == ["types", "names", "gates"]
    assert [s.name for s in pipeline.resolve("other", "full", stages).stages] == ["gates"]


def test_work_is_retried_blocked_and_reported():
    units, told, failed = work.plan("f", 25), [], {"f/extract/0003": 1, "f/merge": 99}

    def handler(u):
        if failed.get(u.name, 0) > 0:
            failed[u.name] -= 1
            raise OSError("lost")

    got = work.run(units, handler, wait_s=0.001, told=told.append)
    by = {u.name: u for u in units}
    assert len(units) == 7 + 25 and got["f/extract/0003"] == "done" and by["f/extract/0003"].tries == 2
    assert got["f/merge"] == "failed" and by["f/merge"].tries == 3 and "lost" in by["f/merge"].error and got["f/chunk"] == got["f/finalize"] == "blocked"
    assert told == sorted(told) and told[-1] == pytest.approx(0.70)
    with pytest.raises(ValueError, match="planned"):
        work.run([work.Unit("a", "route", ("b",))], handler)
    with pytest.raises(ValueError, match="circle"):
        work.run([work.Unit("a", "route", ("b",)), work.Unit("b", "route", ("a",))], handler)


def test_results_are_taken_up_again_only_for_the_same_fingerprint(spark, tmp_path):
    mark = work.fingerprint(input="x", policy={"a": 1})
    assert mark == work.fingerprint(policy={"a": 1}, input="x") != work.fingerprint(input="y", policy={"a": 1})
    for expected in (["page 1"], []):
        r = work.Resumable(spark, str(tmp_path), mark)
        assert r.result("page 1", lambda: spark.range(4)).count() == 4 and r.written == expected
    assert not work.Resumable(spark, str(tmp_path), work.fingerprint(input="y")).has("page 1")
