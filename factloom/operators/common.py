"""Helpers shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.session import checkpoint_dir

#: Rows and bytes up to which a side input is broadcast; beyond either the join is left to the planner.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 8 << 20


def guarded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a side input for broadcast only after counting that it holds at most max_rows rows and max_bytes of text."""
    size = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if size["n"] <= max_rows and size["b"] <= max_bytes else df


def latest(df: DataFrame, key: str, arrived: str, *cols: str) -> DataFrame:
    """One row per key, the latest delivery; ties fall to the greatest remaining values. Null keys are left out."""
    best = F.max(F.struct(F.col(arrived).alias("_arrived"), *[F.col(c) for c in cols])).alias("_best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col("_best")[c].alias(c) for c in cols])


def text_or_null(c: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    t = F.trim(c)
    return F.when(F.length(t) > 0, t)


def staged(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Adds columns behind a one-row generator, so that what is built on them refers to values and isn't expanded into one huge expression."""
    return df.select(*[c for c in df.columns if c not in cols], F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


_SCOPE: ContextVar[str] = ContextVar("factloom_scope", default="session")


def _tables_of(spark: SparkSession, scope: str = "") -> str:
    return f"{checkpoint_dir(spark)}/factloom-{spark.sparkContext.applicationId}" + (f"/{scope}" if scope else "")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def materialized(df: DataFrame) -> DataFrame:
    """The rows written once as a table in the shared checkpoint folder and read from there: several readers don't compute them again, the
    plan stays small, and a lost executor loses nothing. The tables go when their `query_scope` ends, or else with the application."""
    spark = df.sparkSession
    path, fs = _path(spark, _tables_of(spark))
    fs.deleteOnExit(path)
    to = f"{_tables_of(spark, _SCOPE.get())}/{uuid.uuid4().hex}"
    df.write.parquet(to)
    return spark.read.schema(df.schema).parquet(to)


def drop_materialized(spark: SparkSession, scope: str = "") -> None:
    """Removes the tables of a scope, or all that this application has written to the checkpoint folder."""
    path, fs = _path(spark, _tables_of(spark, scope))
    fs.delete(path, True)


@contextmanager
def query_scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that queries write inside the block are dropped when it ends; read or write the results inside it."""
    scope = uuid.uuid4().hex
    token = _SCOPE.set(scope)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        drop_materialized(spark, scope)


def numbered(df: DataFrame, keys: list[str], order: list[str], to: str = "row_no") -> DataFrame:
    """df with each row's number within its keys, from 1. Rows are laid out by range and numbered within their part, after the parts before it are counted,
    so that a key that holds most rows isn't ordered in one task. `order` must tell the rows of a key apart, or their numbers are any of theirs."""
    parts = materialized(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    at = [*keys, "_part"]
    counts = parts.groupBy(*at).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")).drop("_n")
    rows = parts.withColumn("_at", F.row_number().over(Window.partitionBy(*at).orderBy(*order)))
    before = before.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(at)], "_before")
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(at)]
    return rows.join(before, on).select(*df.columns, (F.col("_at") + F.col("_before")).alias(to))
