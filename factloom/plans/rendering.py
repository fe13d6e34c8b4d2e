"""Queries that render documents and bundles: escaped Markdown, chunks, bundles, chunks by block, wide and long exports, conservation between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.io import table
from factloom.operators import rendering
from factloom.plans.base import Book

query = Book()
_B = "(SELECT DISTINCT block_id, content AS x FROM text_blocks WHERE content IS NOT NULL)"


def _rx(x: str, *steps: tuple[str, str]) -> str:
    for a, b in steps:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


_PLAIN = _rx("x", ("\\r\\n?", "\\n"), ("\\x00", ""), ("!\\[[^\\]]*\\]\\([^)]*\\)", ""), ("!\\[[^\\]]*\\]\\[[^\\]]*\\]", ""), ("\\t", "    "), ("[ \\x{a0}]+\\n", "\\n"), ("\\n{3,}", "\\n\\n"), ("^\\s+|\\s+$", "")).replace("'\\n'", "chr(10)").replace("'\\n\\n'", "chr(10) || chr(10)")
_ESC = _rx(f"replace(replace(replace(replace({_PLAIN}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\\', '\\\\')", ("([`*_\\[\\]~])", "\\\\\\1"), ("\\|", "\\\\|"), ("(?m)^( *)(#{1,6})( +)", "\\1\\\\\\2\\3"), ("(?m)^( *)([-+]) +", "\\1\\\\\\2 "), ("(?m)^( *)([0-9]+)([.)]) +", "\\1\\2\\\\\\3 "))


def _blocks(spark, d):
    return table(spark, d, "text_blocks").where("content IS NOT NULL").select("block_id", F.col("content").alias("x")).distinct()


@query(f"SELECT block_id, {_PLAIN} AS plain, {_ESC} AS escaped FROM {_B}")
def escaped_blocks(spark, d):
    """Every block as plain text and escaped for Markdown."""
    return _blocks(spark, d).select("block_id", rendering.plain_text(F.col("x")).alias("plain"), rendering.escaped(F.col("x")).alias("escaped"))


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '!\\[[^\\]]*\\]\\([^)]*\\)') THEN 'markdown_image_not_allowed' END, CASE WHEN regexp_matches(text, '!\\[[^\\]]*\\]\\[[^\\]]*\\]') THEN 'markdown_reference_image_not_allowed' END, CASE WHEN len([t FOR t IN regexp_extract_all(text, '(?i)</?[a-z][^>]*>') IF NOT regexp_matches(t, '(?i)^</?(?:table|thead|tbody|tr|td|th|br)\\b')]) > 0 THEN 'raw_html_not_allowed' END], lambda x: x IS NOT NULL), ',') AS issues FROM documents WHERE text IS NOT NULL")
def markdown_issues(spark, d):
    """What each document holds that Markdown must not."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(rendering.markdown_issues(F.col("text")), ",").alias("issues"))


_LASTNL = "CASE WHEN contains(substr(text, a + 1, 1000), chr(10)) THEN a + 1000 - strpos(reverse(substr(text, a + 1, 1000)), chr(10)) + 1 ELSE 0 END"


@query(f"""WITH RECURSIVE t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, text, n, 0::BIGINT AS a, 0 AS k FROM t WHERE n > 1000 UNION ALL SELECT doc_id, text, n, greatest((CASE WHEN {_LASTNL} > a + 1 THEN {_LASTNL} ELSE a + 1000 END) - 100, a + 1), k + 1 FROM c WHERE (CASE WHEN a + 1000 >= n THEN n WHEN {_LASTNL} > a + 1 THEN {_LASTNL} ELSE a + 1000 END) < n),
p AS (SELECT doc_id, k, regexp_replace(substr(text, a + 1, (CASE WHEN a + 1000 >= n THEN n WHEN {_LASTNL} > a + 1 THEN {_LASTNL} ELSE a + 1000 END) - a), '^\\s+|\\s+$', '', 'g') AS chunk FROM c UNION ALL SELECT doc_id, 0, text FROM t WHERE n <= 1000)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INTEGER AS chunk_no, md5(chunk) AS digest, length(chunk)::INTEGER AS chars FROM p WHERE chunk <> '' OR doc_id IN (SELECT doc_id FROM t WHERE n <= 1000)""")
def line_chunks(spark, d):
    """Chunks of each document cut after line ends, by digest and length."""
    c = rendering.line_chunks(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return c.select("doc_id", "chunk_no", F.md5(F.encode("chunk", "utf-8")).alias("digest"), F.length("chunk").alias("chars"))


@query("WITH b AS (SELECT DISTINCT block_id, doc_id, page_number, reading_order, level, content FROM text_blocks WHERE doc_id IS NOT NULL AND length(trim(content, ' ')) > 0) SELECT doc_id, block_id || ':chunk:0000' AS chunk_id, CASE WHEN level = 'h2' THEN 'section' ELSE 'text' END AS kind, page_number AS page, length(content)::INTEGER AS chars FROM b")
def block_chunks(spark, d):
    """One chunk for each block that isn't blank, with an id that stays; headings are sections."""
    b = table(spark, d, "text_blocks").where("doc_id IS NOT NULL AND length(trim(content)) > 0").select("block_id", "doc_id", "page_number", "reading_order", "level", "content").distinct()
    return b.select("doc_id", F.concat(F.col("block_id").cast("string"), F.lit(":chunk:0000")).alias("chunk_id"), F.when(F.col("level") == "h2", "section").otherwise("text").alias("kind"), F.col("page_number").alias("page"), F.length("content").alias("chars"))


@query("""WITH b AS (SELECT doc_id, count(DISTINCT block_id) FILTER (WHERE level = 'h2') AS sections, count(DISTINCT block_id) AS blocks FROM text_blocks WHERE doc_id IS NOT NULL GROUP BY 1), c AS (SELECT doc_id, count(DISTINCT dataset_id) AS datasets, count(DISTINCT record_id) AS records FROM audit_cells WHERE doc_id IS NOT NULL GROUP BY 1), f AS (SELECT doc_id, count(DISTINCT path) AS files FROM package_files WHERE doc_id IS NOT NULL GROUP BY 1)
SELECT d.doc_id, coalesce(sections, 0) AS sections, coalesce(datasets, 0) AS datasets, coalesce(records, 0) AS records, coalesce(files, 0) AS files, CASE WHEN blocks IS NULL AND datasets IS NULL THEN 'EMPTY' WHEN datasets IS NULL THEN 'PARTIAL_PARSE' ELSE '' END AS warning FROM documents d LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)""")
def document_bundles(spark, d):
    """What the bundle of each document holds: sections, datasets, records, files and a warning. Parts are counted before they are joined."""
    b = table(spark, d, "text_blocks").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count_distinct(F.when(F.col("level") == "h2", F.col("block_id"))).alias("sections"), F.count_distinct("block_id").alias("blocks"))
    c = table(spark, d, "audit_cells").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count_distinct("dataset_id").alias("datasets"), F.count_distinct("record_id").alias("records"))
    f = table(spark, d, "package_files").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count_distinct("path").alias("files"))
    j = table(spark, d, "documents").select("doc_id").join(b, "doc_id", "left").join(c, "doc_id", "left").join(f, "doc_id", "left")
    warning = F.when(F.col("blocks").isNull() & F.col("datasets").isNull(), "EMPTY").when(F.col("datasets").isNull(), "PARTIAL_PARSE").otherwise("")
    return j.select("doc_id", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("sections", "datasets", "records", "files")], warning.alias("warning"))


_CELLS = "(SELECT DISTINCT dataset_id, record_id, field_key, value FROM audit_cells WHERE value IS NOT NULL)"


@query(f"SELECT dataset_id, count(*) AS records, count(DISTINCT record_id) = count(*) AS unique_ids, CAST(sum(fields) AS BIGINT) AS cells FROM (SELECT dataset_id, record_id, count(DISTINCT field_key) AS fields FROM {_CELLS} GROUP BY 1, 2) GROUP BY 1")
def dataset_payloads(spark, d):
    """Every dataset as it goes out: its records, whether their ids are unique, and its cells."""
    r = table(spark, d, "audit_cells").where("value IS NOT NULL").groupBy("dataset_id", "record_id").agg(F.count_distinct("field_key").alias("fields"))
    return r.groupBy("dataset_id").agg(F.count("*").alias("records"), (F.count_distinct("record_id") == F.count("*")).alias("unique_ids"), F.sum("fields").alias("cells"))


@query(f"SELECT record_id, '{{' || string_agg('\"' || field_key || '\":' || to_json(value), ',' ORDER BY field_key) || '}}' AS payload FROM (SELECT record_id, field_key, min(value) AS value FROM {_CELLS} GROUP BY 1, 2) GROUP BY 1")
def canonical_json(spark, d):
    """Each record as compact JSON with its keys in order."""
    c = table(spark, d, "audit_cells").where("value IS NOT NULL").groupBy("record_id", "field_key").agg(F.min("value").alias("value"))
    pair = F.concat(F.lit('"'), "field_key", F.lit('":'), F.regexp_extract(F.to_json(F.struct(F.col("value").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))
    parts = F.array_sort(F.collect_list(F.struct("field_key", pair.alias("p"))))
    return c.groupBy("record_id").agg(F.concat(F.lit("{"), F.array_join(F.transform(parts, lambda x: x["p"]), ","), F.lit("}")).alias("payload"))


@query(f"WITH w AS (SELECT dataset_id, count(DISTINCT record_id) AS wide FROM {_CELLS} GROUP BY 1), l AS (SELECT dataset_id, count(*) AS long FROM (SELECT DISTINCT dataset_id, record_id FROM {_CELLS}) GROUP BY 1), x AS (SELECT dataset_id, count(DISTINCT record_id) AS marked FROM audit_cells GROUP BY 1) SELECT dataset_id, wide, long, wide = long AS conserved, marked - wide AS without_values FROM w JOIN l USING (dataset_id) JOIN x USING (dataset_id)")
def export_conservation(spark, d):
    """Whether the wide and the long export of each dataset hold the same records, and how many records have no value at all."""
    cells = table(spark, d, "audit_cells")
    full = cells.where("value IS NOT NULL")
    w = full.groupBy("dataset_id").agg(F.count_distinct("record_id").alias("wide"))
    n = full.select("dataset_id", "record_id").distinct().groupBy("dataset_id").agg(F.count("*").alias("long"))
    x = cells.groupBy("dataset_id").agg(F.count_distinct("record_id").alias("marked"))
    return w.join(n, "dataset_id").join(x, "dataset_id").select("dataset_id", "wide", "long", (F.col("wide") == F.col("long")).alias("conserved"), (F.col("marked") - F.col("wide")).alias("without_values"))


@query("SELECT DISTINCT field_id, CASE WHEN value IS NULL THEN 'string' WHEN lower(value) IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(value, '^[+-]?[0-9]+$') THEN 'integer' WHEN regexp_matches(value, '^[+-]?[0-9]*\\.[0-9]+$') THEN 'decimal' WHEN length(value) > 200 THEN 'text' ELSE 'string' END AS type FROM trust_fields")
def value_types(spark, d):
    """The type of each field's value."""
    v = F.col("value")
    kind = F.when(v.isNull(), "string").when(F.lower(v).isin("true", "false"), "boolean").when(v.rlike(r"^[+-]?[0-9]+$"), "integer").when(v.rlike(r"^[+-]?[0-9]*\.[0-9]+$"), "decimal").when(F.length(v) > 200, "text").otherwise("string")
    return table(spark, d, "trust_fields").select("field_id", kind.alias("type")).distinct()


@query("SELECT artifact_key, min(page) AS page_from, max(page) AS page_to FROM trust_fields WHERE page IS NOT NULL GROUP BY 1")
def page_ranges(spark, d):
    """The pages that each artifact's fields stand on."""
    return table(spark, d, "trust_fields").where("page IS NOT NULL").groupBy("artifact_key").agg(F.min("page").alias("page_from"), F.max("page").alias("page_to"))


QUERIES, ORACLES = query.queries, query.oracles
