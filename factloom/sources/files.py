"""Readers and writers of document files: bytes with digests, delimited and pipe text, JSON lines, bundles, CSV and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import tables

# MIME types by file suffix.
MIME = {"txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "tsv": "text/tab-separated-values", "json": "application/json", "jsonl": "application/x-ndjson", "xml": "application/xml", "html": "text/html", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg"}


def accepted(spark: SparkSession, path: str, max_bytes: int = 1 << 28) -> DataFrame:
    """(path, length, sha256, mime, status) of the files under a path; unknown and oversized files are rejected with a reason, files without bytes are not listed by Spark."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    known = F.try_element_at(F.create_map(*[F.lit(x) for p in MIME.items() for x in p]), suffix)
    status = F.when(F.col("length") > max_bytes, "too_large").when(known.isNull(), "unsupported").otherwise("accepted")
    return raw.select("path", "length", F.sha2("content", 256).alias("sha256"), known.alias("mime"), status.alias("status"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole text files."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def delimited(df: DataFrame, key: str, text: str, delimiter: str = "\t") -> DataFrame:
    """(key, row_no, cells) of texts whose lines all hold the delimiter; others give no rows."""
    lines = F.filter(F.split(F.col(text), r"\r?\n"), lambda x: F.length(F.trim(x)) > 0)
    whole = df.where(F.forall(lines, lambda x: x.contains(delimiter)) & (F.size(lines) > 0)).select(key, F.posexplode(lines).alias("row_no", "line"))
    return whole.select(key, "row_no", F.split("line", "\\Q" + delimiter + "\\E").alias("cells"))


def pipe_tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row_no, cells) of the pipe tables in texts: continuation rows are glued to the row before; Markdown tables don't count."""
    lines = df.where(F.length(text) > 0).select(key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("n", "line"))
    rows = lines.where(F.col("line").contains("|") & ~F.col("line").rlike(r"^\s*\|?[\s:|-]*-{3}[\s:|-]*$")).select(key, "n", tables.split_pipe_row(F.col("line")).alias("cells"))
    return tables.merge_continuations(rows, [key], "n")


def write_bundle(records: DataFrame, path: str, dataset: str = "dataset_id", record: str = "record_id", field: str = "field_key", value: str = "value") -> None:
    """One JSON line a record: dataset, record and its fields in the order of their names."""
    fields = F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col(field), F.col(value)))))
    records.where(F.col(field).isNotNull()).dropDuplicates([dataset, record, field]).groupBy(dataset, record).agg(fields.alias("fields")).write.mode("errorifexists").json(path)


def write_audit_csv(records: DataFrame, path: str) -> None:
    """Long audit rows as CSV with CRLF; leading formula signs are escaped."""
    safe = [F.when(F.col(c).cast("string").rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in records.dtypes]
    records.select(*safe).write.mode("errorifexists").csv(path, header=True, lineSep="\r\n", escape='"')


def numbered(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with `row_no` within their key, from 1."""
    return df.withColumn("row_no", F.row_number().over(Window.partitionBy(key).orderBy(order)))
