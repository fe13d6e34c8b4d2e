"""Writing results: exporters by name, all outputs of a run with a manifest that is written last, fragments by page.

A folder without a manifest is a run that didn't end; readers take only what the manifest names, so a lost driver leaves nothing half read."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.runtime.pipeline import Registry

EXPORTERS = Registry("exporter")
EXPORTERS.register("parquet", lambda df, path: df.write.mode("errorifexists").parquet(path))
EXPORTERS.register("json", lambda df, path: df.write.mode("errorifexists").json(path))
EXPORTERS.register("csv", lambda df, path: safe_csv(df).write.mode("errorifexists").csv(path, header=True, lineSep="\r\n", escape='"', quoteAll=True))
EXPORTERS.register("text", lambda df, path: df.select(df.columns[0]).write.mode("errorifexists").text(path))


def safe_csv(df: DataFrame) -> DataFrame:
    """Texts that begin like formulas escaped; nested columns as JSON."""
    cols = []
    for c, t in df.dtypes:
        v = F.to_json(f"`{c}`") if t.startswith(("struct", "array", "map", "variant")) else F.col(f"`{c}`")
        cols.append((F.when(v.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), v)).otherwise(v) if t == "string" else v).alias(c))
    return df.select(*cols)


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a frame, whatever the order of its rows: an exact sum of row hashes, so that equal rows count."""
    h = F.xxhash64(*[F.col(f"`{c}`").cast("string") if not t.startswith(("struct", "array", "map", "variant")) else F.to_json(f"`{c}`") for c, t in sorted(df.dtypes)])
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return r["n"], f"{int(r['s']) & (1 << 64) - 1:016x}"


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_outputs(outputs: dict[str, tuple[DataFrame, str]], folder: str) -> dict:
    """Writes each frame by its exporter to folder/name and then the manifest {name: {format, rows, digest, columns}}. A folder with a manifest is an error."""
    spark = next(iter(outputs.values()))[0].sparkSession
    path, fs = _file(spark, f"{folder}/manifest.json")
    if fs.exists(path):
        raise FileExistsError(f"{folder} holds the outputs of a run")
    manifest = {}
    for name, (df, kind) in outputs.items():
        EXPORTERS.get(kind)(df, f"{folder}/{name}")
        rows, digest = fingerprint(df)
        manifest[name] = {"format": kind, "rows": rows, "digest": digest, "columns": df.columns}
    out = fs.create(path)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    return manifest


def read_manifest(spark: SparkSession, folder: str) -> dict:
    """The manifest of a folder; an error if there is none."""
    return json.loads("".join(r[0] for r in spark.read.text(f"{folder}/manifest.json", wholetext=True).collect()))  # one small file


def write_fragments(df: DataFrame, folder: str, page: str) -> None:
    """Rows as JSON lines in one folder a page; a page written again replaces only its own."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(page).json(folder)


def project(df: DataFrame, names: dict[str, str | Callable]) -> DataFrame:
    """df under other names: each new column is an old one or made by a function of the frame; a missing one is an error that names it."""
    missing = [old for old in names.values() if isinstance(old, str) and old not in df.columns]
    if missing:
        raise KeyError(f"no column {missing[0]!r} among {', '.join(df.columns)}")
    return df.select(*[(F.col(f"`{old}`") if isinstance(old, str) else old(df)).alias(new) for new, old in names.items()])
