"""Session settings the engine's plans rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from functools import lru_cache

from pyspark.sql import SparkSession

#: UTC keeps wall-clock arithmetic stable; AQE sizes and splits shuffles at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", app: str = "factloom", **extra: str) -> SparkSession:
    """A local session for tests and benches."""
    conf = {"spark.master": f"local[{cpus}]", "spark.app.name": app, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", **SETTINGS, **extra}
    return SparkSession.builder.config(map=conf).getOrCreate()


@lru_cache(1)
def _own_folder() -> str:
    """A folder of this process, removed when it ends; only for local sessions that name none, as in tests."""
    path = tempfile.mkdtemp(prefix="factloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def is_local(master: str) -> bool:
    """Whether a master runs everything in one process; local-cluster has executors of its own and doesn't."""
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts: the one that spark.checkpoint.dir names. Where none is named, a local session gets a folder of its process; on a
    cluster that is an error, since a folder of one machine would lose or hide what the executors write."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not is_local(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that all executors share")
        named = f"file://{_own_folder()}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named
