"""Where intermediates lie and when they go."""

from __future__ import annotations

import os

import pytest

from factloom import session
from factloom.operators import common


class Stub:
    """A session without spark.checkpoint.dir."""

    def __init__(self, master):
        self.master, self.conf, self.sparkContext, self.set = master, self, self, None

    def get(self, name, default):
        return default

    def getCheckpointDir(self):
        return self.set

    def setCheckpointDir(self, path):
        self.set = path


def test_no_machine_local_folder_on_a_cluster():
    for master in ("local", "local[4]", "local[*]"):
        assert session.checkpoint_dir(Stub(master)).startswith("file:/")
    for master in ("local-cluster[3,2,1000]", "spark://h:7077", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.checkpoint_dir(Stub(master))


def test_intermediates_go_with_their_query(spark):
    df = spark.range(5)
    kept = common.materialized(df)
    with common.query_scope(spark):
        inner = common.materialized(df)
        files = [f.removeprefix("file:") for f in inner.inputFiles()]
        assert inner.count() == 5 and files and all(map(os.path.exists, files))
    assert not any(map(os.path.exists, files)) and kept.count() == 5


def test_broadcast_is_guarded_by_rows_and_bytes(spark):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    few = spark.createDataFrame([("x" * 100,)] * 10, "s string")
    assert hinted(common.guarded_broadcast(few)) and not hinted(common.guarded_broadcast(few, 9)) and not hinted(common.guarded_broadcast(few, 10, 500))
    assert hinted(common.guarded_broadcast(few.limit(0)))


def test_numbers_within_keys_go_on_over_parts(spark):
    rows = [("hot", i) for i in range(2000)] + [("b", i) for i in range(3)] + [(None, 7), (None, 8)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(7)
    got = {(r["k"], r["i"]): r["n"] for r in common.numbered(df, ["k"], ["i"], "n").collect()}
    assert got == {(k, i): i + 1 - (7 if k is None else 0) for k, i in rows} and common.numbered(df.limit(0), ["k"], ["i"]).count() == 0
