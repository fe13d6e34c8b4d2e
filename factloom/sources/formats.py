"""The registry of formats: what each is read by, found by exact MIME type, by MIME prefix, then by suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Name, content model, reader, MIME types (a star ends a prefix), suffixes.
FORMATS = [
    ("pdf", "page", "", "application/pdf", "pdf"), ("image", "page", "", "image/*", "png jpg jpeg tif tiff bmp webp"), ("docx", "office", "docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docx"), ("pptx", "office", "pptx", "application/vnd.openxmlformats-officedocument.presentationml.presentation", "pptx"),
    ("xlsx", "office", "xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xlsx"), ("csv", "data", "csv", "text/csv", "csv"), ("tsv", "data", "txt", "text/tab-separated-values", "tsv"), ("json", "data", "json", "application/json", "json"), ("xml", "data", "xml", "application/xml text/xml", "xml"),
    ("html", "web", "html", "text/html application/xhtml+xml", "html htm"), ("email", "web", "eml", "message/rfc822", "eml"), ("ofd", "page", "ofd", "application/ofd", "ofd"), ("archive", "archive", "zip", "application/zip", "zip"), ("text", "data", "txt", "text/*", "txt md log"),
]


def registry(spark: SparkSession) -> DataFrame:
    """(name, model, reader, how, pattern, rank) of the formats, one row a pattern; bounded by the code."""
    rows = []
    for rank, (name, model, reader, mimes, suffixes) in enumerate(FORMATS):
        rows += [(name, model, reader, "prefix" if m.endswith("*") else "exact", m.rstrip("*"), rank) for m in mimes.split()] + [(name, model, reader, "suffix", s, rank) for s in suffixes.split()]
    return spark.createDataFrame(rows, "name string, model string, reader string, how string, pattern string, rank int")


def capability(mime, path):
    """(name, how) of the format of a MIME type and a path: exact type, then the type's beginning, then the suffix; `unknown` by `none` else. The registry
    is part of the expression, so nothing is joined."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    tries = []
    for how, test in (("exact", lambda m: F.lower(mime) == m), ("prefix", lambda m: F.startswith(F.lower(mime), F.lit(m))), ("suffix", lambda s: suffix == s)):
        for name, _, _, mimes, suffixes in FORMATS:
            patterns = suffixes.split() if how == "suffix" else [m.rstrip("*") for m in mimes.split() if m.endswith("*") == (how == "prefix")]
            tries += [F.when(test(p), F.struct(F.lit(name).alias("name"), F.lit(how).alias("how"))) for p in patterns]
    return F.coalesce(*tries, F.struct(F.lit("unknown").alias("name"), F.lit("none").alias("how")))
