"""Helpers of the text operators."""

from __future__ import annotations

from types import ModuleType

from pyspark import cloudpickle
from pyspark.sql import DataFrame

from factloom.operators.common import latest

#: Bytes of stored input per task of Python work on texts; such tasks spend seconds per megabyte.
TASK_BYTES = 1 << 19


def tasks(df: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Number of tasks by the planner's estimate of the input's size, at least two for each core."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, size // task_bytes)


def spread(df: DataFrame, key: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The rows hash-partitioned by a key into as many tasks as their size asks for; aggregations by the key reuse the partitioning."""
    return df.repartition(tasks(df, task_bytes), key)


def latest_texts(df: DataFrame, key: str, arrived: str, *cols: str) -> DataFrame:
    """The latest delivery of each row, spread for Python work."""
    return latest(spread(df.select(key, arrived, *cols), key), key, arrived, *cols)


def by_value(*modules: ModuleType) -> None:
    """Ships the modules' functions inside the tasks, so that executors need no copy of the package."""
    for m in modules:
        cloudpickle.register_pickle_by_value(m)
