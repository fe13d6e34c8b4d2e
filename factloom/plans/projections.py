"""Queries that give facts other shapes: CSV lines, framework documents, file plans, formulas; and what columns, zones and bands of pages come to."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import cells, checks, normal
from factloom.io import table
from factloom.operators.common import numbered, staged
from factloom.plans.base import Book
from factloom.plans.pages import _PAGE, _ROWS, _SIGNAL, HEIGHT, WIDTH, B, _blocks, _rows, _signals, projected_columns
from factloom.plans.values import _AMOUNTS_SQL, _NUMBERS, _numbers

query = Book()

_Q = "CASE WHEN regexp_matches({x}, '[\",\\r\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END"
_SAFE = "CASE WHEN regexp_matches({x}, '^[=+@-]') THEN '''' || {x} ELSE {x} END"


@query(f"WITH c AS (SELECT dataset_id, record_id, field_key, min(value) AS v FROM audit_cells WHERE value IS NOT NULL GROUP BY 1, 2, 3), s AS (SELECT dataset_id, record_id, field_key, {_SAFE.format(x='v')} AS v FROM c) SELECT dataset_id, record_id, record_id || ',' || string_agg({_Q.format(x='v')}, ',' ORDER BY field_key) AS line FROM s GROUP BY 1, 2")
def csv_lines(spark, d):
    """Every record as a line of CSV, its values in the order of their fields, quoted where need be, formula signs escaped."""
    c = table(spark, d, "audit_cells").where("value IS NOT NULL").groupBy("dataset_id", "record_id", "field_key").agg(F.min("value").alias("v"))
    safe = F.when(F.col("v").rlike("^[=+@-]"), F.concat(F.lit("'"), "v")).otherwise(F.col("v"))
    c = staged(c, {"v": safe})
    cell = F.when(F.col("v").rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace("v", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("v"))
    parts = F.array_sort(F.collect_list(F.struct("field_key", cell.alias("t"))))
    return c.groupBy("dataset_id", "record_id").agg(F.concat("record_id", F.lit(","), F.array_join(F.transform(parts, lambda x: x["t"]), ",")).alias("line"))


@query("SELECT doc_id, md5(text) AS page_content, '{\"source\":\"' || coalesce(source, '') || '\",\"lang\":\"' || coalesce(lang, '') || '\",\"n_chars\":' || coalesce(n_chars, 0) || '}' AS metadata FROM documents WHERE text IS NOT NULL")
def framework_documents(spark, d):
    """Documents as frameworks take them: a content (here its digest) and metadata as JSON."""
    q = lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))
    meta = F.concat(F.lit('{"source":'), q("source"), F.lit(',"lang":'), q("lang"), F.lit(',"n_chars":'), F.coalesce("n_chars", F.lit(0)).cast("string"), F.lit("}"))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(F.encode("text", "utf-8")).alias("page_content"), meta.alias("metadata"))


_NAME = "regexp_extract(path, '([^/]*)$', 1)"


@query(f"SELECT DISTINCT file_id, {_NAME} AS name, CASE WHEN regexp_matches({_NAME}, '^[.~]|^Thumbs\\.db$') THEN 'hidden' WHEN NOT regexp_matches(lower({_NAME}), '\\.(?:pdf|png|jpe?g|tiff?|docx|xlsx|pptx|csv|json|xml|html?|eml|zip|txt|md|ofd)$') THEN 'unsupported' ELSE 'taken' END AS status FROM package_files WHERE path IS NOT NULL")
def scanned_files(spark, d):
    """Files that a scan takes, and those it leaves as hidden or unsupported."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    status = F.when(name.rlike(r"^[.~]|^Thumbs\.db$"), "hidden").when(~F.lower(name).rlike(r"\.(?:pdf|png|jpe?g|tiff?|docx|xlsx|pptx|csv|json|xml|html?|eml|zip|txt|md|ofd)$"), "unsupported").otherwise("taken")
    return table(spark, d, "package_files").where("path IS NOT NULL").select("file_id", name.alias("name"), status.alias("status")).distinct()


@query(f"WITH f AS (SELECT file_id, min(coalesce(document_type, 'unknown') || '/' || {_NAME}) AS target FROM package_files WHERE path IS NOT NULL GROUP BY 1) SELECT file_id, target || CASE WHEN row_number() OVER w > 1 THEN '_' || (row_number() OVER w - 1) ELSE '' END AS target FROM f WINDOW w AS (PARTITION BY target ORDER BY file_id)")
def file_plan(spark, d):
    """Where each file would be filed: by its type, names that are taken numbered, by range parts, as one name may be that of most files."""
    target = F.concat(F.coalesce("document_type", F.lit("unknown")), F.lit("/"), F.regexp_extract("path", "([^/]*)$", 1))
    f = table(spark, d, "package_files").where("path IS NOT NULL").groupBy("file_id").agg(F.min(target).alias("target"))
    return numbered(f, ["target"], ["file_id"], "n").select("file_id", F.concat("target", F.when(F.col("n") > 1, F.concat(F.lit("_"), (F.col("n") - 1).cast("string"))).otherwise("")).alias("target"))


_TEX = "'\\frac{' || l_linenumber || '}{x_{' || l_quantity::INTEGER || '}} + \\sum ' || l_returnflag"
_TOKEN = "\\\\[A-Za-z]+|[{}^_]|[0-9]+|[A-Za-z]|[^\\s]"


@query(f"SELECT l_orderkey, l_linenumber, len(regexp_extract_all({_TEX}, '{_TOKEN}'))::INTEGER AS tokens, len(regexp_extract_all({_TEX}, '\\\\[A-Za-z]+'))::INTEGER AS commands, 'inline' AS kind FROM lineitem")
def formula_tokens(spark, d):
    """Formulas made of every line of the orders, cut into commands, braces, numbers, letters and signs; and whether they would be set in a line."""
    tex = F.concat(F.lit("\\frac{"), "l_linenumber", F.lit("}{x_{"), F.col("l_quantity").cast("int"), F.lit("}} + \\sum "), "l_returnflag")
    count = lambda p: F.size(F.regexp_extract_all(tex, F.lit(f"({p})"), 1))
    kind = F.when(tex.rlike(r"\\begin\{(?:align|gather|cases|matrix)"), "display").otherwise("inline")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", count(r"\\[A-Za-z]+|[{}^_]|[0-9]+|[A-Za-z]|[^\s]").alias("tokens"), count(r"\\[A-Za-z]+").alias("commands"), kind.alias("kind"))


@query("SELECT event_type, count(*) AS events, round(sum(value), 4) AS total, min(ts) AS first, max(ts) AS last, round(count(*) / (date_diff('second', min(ts), max(ts)) / 3600.0 + 1), 4) AS per_hour FROM events GROUP BY 1")
def event_totals(spark, d):
    """Totals, period and rate of each kind of event."""
    hours = (F.unix_timestamp(F.date_trunc("second", F.max("ts"))) - F.unix_timestamp(F.date_trunc("second", F.min("ts")))) / 3600.0 + 1
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.round(F.count("*") / hours, 4).alias("per_hour"))


@query("WITH e AS (SELECT event_type, value, ntile(2) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS half FROM events) SELECT event_type, round(avg(CASE WHEN half = 1 THEN value END), 6) AS baseline, round(avg(CASE WHEN half = 2 THEN value END), 6) AS observed, avg(CASE WHEN half = 2 THEN value END) >= avg(CASE WHEN half = 1 THEN value END) AS improved FROM e GROUP BY 1")
def metric_deltas(spark, d):
    """The mean of each kind of event in the later half of its history against the earlier one. The middle is found by an exact percentile of time, then
    nothing is ordered in one task."""
    e = table(spark, d, "events").select("event_type", "value", "ts", "event_id")
    rank = F.row_number().over(Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id"))
    days = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("event_type").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.withColumns({"before": before, "all": F.sum("n").over(Window.partitionBy("event_type"))})
    e = e.withColumns({"day": F.to_date("ts"), "r": rank}).join(days, ["event_type", "day"])
    early = F.col("before") + F.col("r") <= F.ceil(F.col("all") / 2)
    a, b = F.avg(F.when(early, F.col("value"))), F.avg(F.when(~early, F.col("value")))
    return e.groupBy("event_type").agg(F.round(a, 6).alias("baseline"), F.round(b, 6).alias("observed"), (b >= a).alias("improved"))


# --- normal forms and corrections by column

@query()
def normalized_blocks(spark, d):
    """Blocks under Unicode's compatibility form, as texts, characters and labels; tested against Python's own."""
    b = table(spark, d, "text_blocks").where("content IS NOT NULL").select("block_id", "content").distinct()
    c = F.col("content")
    return b.select("block_id", normal.text(c).alias("text"), normal.chars(c).alias("chars"), normal.label(c).alias("label"))


_DATES_SQL = "regexp_replace(regexp_replace(regexp_replace(value, '([0-9]{4})[~～]([0-9]{2})[-~～]?([0-9]{2})', '\\1-\\2-\\3', 'g'), '([0-9]{4})\\s*[-–—]\\s*([0-9]{2})\\s*[-–—]\\s*([0-9]{2})', '\\1-\\2-\\3', 'g'), '([0-9]{4})\\.([0-9]{2})\\.([0-9]{2})', '\\1-\\2-\\3', 'g')"


@query(f"SELECT DISTINCT cell_id, CASE WHEN field_key = 'amount' THEN {_AMOUNTS_SQL.replace('(x,', '(value,')} WHEN field_key LIKE '%\\_at' ESCAPE '\\' THEN {_DATES_SQL} ELSE value END AS repaired FROM audit_cells WHERE value IS NOT NULL")
def column_repairs(spark, d):
    """Cells repaired by what their column holds: amounts in amounts, dates in times, others as they are."""
    c = table(spark, d, "audit_cells").where("value IS NOT NULL").select("cell_id", "field_key", "value")
    v = F.col("value")
    return c.select("cell_id", F.when(F.col("field_key") == "amount", cells.repaired_amounts(v)).when(F.col("field_key").endswith("_at"), cells.repaired_dates(v)).otherwise(v).alias("repaired")).distinct()


_T = "upper(regexp_replace(x, '\\s+', '', 'g'))"
_SUM = f"CAST(array_to_string([CASE WHEN ascii(c) >= 65 THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END FOR c IN string_split(substr({_T}, 5) || substr({_T}, 1, 4), '')], '') AS HUGEINT) % 97"


@query(f"SELECT file_id, src, CASE WHEN regexp_matches({_T}, '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}$') THEN CASE WHEN {_SUM} = 1 THEN 'valid' ELSE 'invalid' END WHEN regexp_matches(trim(x, ' '), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN 'email' WHEN regexp_matches(trim(x, ' '), '^\\+?[0-9][0-9 ()-]{{5,20}}$') THEN 'phone' ELSE 'unchecked' END AS verdict FROM {_NUMBERS}")
def number_verdicts(spark, d):
    """What can be said of each number: an IBAN that holds or doesn't, an address, a phone, or nothing."""
    x = F.col("x")
    t = F.upper(F.regexp_replace(x, r"\s+", ""))
    from factloom.functions.scalars import iban_ok

    verdict = F.when(t.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), F.when(iban_ok(x), "valid").otherwise("invalid")).when(checks.has_form("email", x), "email").when(checks.has_form("phone", x), "phone").otherwise("unchecked")
    return _numbers(spark, d).select("file_id", "src", verdict.alias("verdict"))


# --- pages

_PROJ = f"WITH {_SIGNAL}, i AS (SELECT *, x - row_number() OVER (PARTITION BY doc_id, page_number ORDER BY x) AS island FROM sig WHERE v = 0), gaps AS (SELECT doc_id, page_number, (min(x) + max(x) + 1) / 2.0 AS mid FROM i GROUP BY doc_id, page_number, island HAVING count(*) >= 15), n AS (SELECT doc_id, page_number, count(*) AS n FROM {B} GROUP BY 1, 2), k AS (SELECT b.block_id, b.doc_id, b.page_number, b.x0, b.y0, CASE WHEN max(n.n) < 4 THEN 0 ELSE count(mid) END AS c FROM {B} b JOIN n ON n.doc_id = b.doc_id AND n.page_number = b.page_number LEFT JOIN gaps g ON g.doc_id = b.doc_id AND g.page_number = b.page_number AND (b.x0 + b.x1) / 2 >= mid GROUP BY 1, 2, 3, 4, 5)"


@query(f"{_PROJ} SELECT block_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, c, y0, x0, block_id) - 1 AS position FROM k")
def column_reading_order(spark, d):
    """Order of a document's blocks by page, column, height and left edge, from 0."""
    c = projected_columns(spark, d)
    b = _blocks(spark, d).select("block_id", *_PAGE, "x0", "y0").join(c, ["block_id", *_PAGE])
    w = Window.partitionBy("doc_id").orderBy("page_number", "column_no", "y0", "x0", "block_id")
    return b.select("block_id", "doc_id", (F.row_number().over(w) - 1).cast("bigint").alias("position"))


@query(f"WITH {_SIGNAL} SELECT doc_id, page_number, round(count(*) FILTER (WHERE v = 0) / {WIDTH}.0, 6) AS empty, max(v)::INTEGER AS peak FROM sig GROUP BY 1, 2")
def page_whitespace(spark, d):
    """The share of a page's width that no block touches, and the most blocks above one another."""
    s = _signals(spark, d)
    return s.select(*_PAGE, F.round(F.size(F.filter("signal", lambda v: v == 0)) / float(WIDTH), 6).alias("empty"), F.array_max("signal").alias("peak"))


@query(f"WITH RECURSIVE {_ROWS} SELECT r.doc_id, r.page_number, row_no, min(b.y0) AS top, max(b.y1) AS bottom, count(*) AS blocks FROM r JOIN {B} b ON b.doc_id = r.doc_id AND b.page_number = r.page_number AND b.block_id = r.block_id GROUP BY 1, 2, 3")
def row_bands(spark, d):
    """The band of each row of a page, from its highest to its lowest edge."""
    j = _rows(spark, d).join(_blocks(spark, d).select(*_PAGE, "block_id", "y0", "y1"), [*_PAGE, "block_id"])
    return j.groupBy(*_PAGE, "row_no").agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.count("*").alias("blocks"))


@query(f"WITH o AS (SELECT *, CASE WHEN y0 - max(y1) OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 20 THEN 0 ELSE 1 END AS new FROM {B}), z AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, block_id ROWS UNBOUNDED PRECEDING) AS zone FROM o) SELECT doc_id, page_number, CAST(zone AS BIGINT) AS zone, min(x0) AS zx0, min(y0) AS zy0, max(x1) AS zx1, max(y1) AS zy1, count(*) AS blocks FROM z GROUP BY 1, 2, 3")
def page_zones(spark, d):
    """Zones of a page, parted where 20 points below everything before are empty."""
    w = Window.partitionBy(*_PAGE).orderBy("y0", "x0", "block_id")
    reach = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = _blocks(spark, d).withColumn("new", (~F.coalesce(F.col("y0") - reach <= 20, F.lit(False))).cast("bigint"))
    z = b.withColumn("zone", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return z.groupBy(*_PAGE, "zone").agg(F.min("x0").alias("zx0"), F.min("y0").alias("zy0"), F.max("x1").alias("zx1"), F.max("y1").alias("zy1"), F.count("*").alias("blocks"))


@query(f"SELECT doc_id, page_number, CASE WHEN level IN ('header', 'footer') THEN level WHEN level = 'h2' THEN 'heading' WHEN y0 < {HEIGHT} * 0.1 THEN 'top' WHEN y1 > {HEIGHT} * 0.9 THEN 'bottom' WHEN contains(content, chr(10)) THEN 'paragraph' ELSE 'line' END AS region, count(*) AS blocks FROM {B} GROUP BY 1, 2, 3")
def page_regions(spark, d):
    """Blocks of each page by the kind of region they are."""
    kind = F.when(F.col("level").isin("header", "footer"), F.col("level")).when(F.col("level") == "h2", "heading").when(F.col("y0") < HEIGHT * 0.1, "top").when(F.col("y1") > HEIGHT * 0.9, "bottom").when(F.col("content").contains("\n"), "paragraph").otherwise("line")
    return _blocks(spark, d).groupBy(*_PAGE, kind.alias("region")).agg(F.count("*").alias("blocks"))


@query("""WITH b AS (SELECT DISTINCT block_id, doc_id, page_number, reading_order, content, evidence_ids FROM text_blocks WHERE doc_id IS NOT NULL), o AS (SELECT *, lag(reading_order) OVER (PARTITION BY doc_id ORDER BY page_number, block_id) AS p FROM b), m AS (SELECT doc_id, count(*) AS blocks, round(avg(CASE WHEN len(evidence_ids) > 0 THEN 1.0 ELSE 0.0 END), 6) AS provenance, CASE WHEN count(*) < 2 THEN 1.0 ELSE round(1 - count_if(p IS NOT NULL AND reading_order < p) / (count(*) - 1), 6) END AS ordering, substr(md5(lower(string_agg(trim(coalesce(content, ''), ' '), ' ' ORDER BY page_number, block_id, content))), 1, 16) AS fingerprint FROM o GROUP BY 1) SELECT * FROM m""")
def document_metrics(spark, d):
    """The metrics of each document in one row: blocks, provenance, order, and a fingerprint of its text."""
    b = table(spark, d, "text_blocks").where("doc_id IS NOT NULL").select("block_id", "doc_id", "page_number", "reading_order", "content", "evidence_ids").distinct()
    o = b.withColumn("p", F.lag("reading_order").over(Window.partitionBy("doc_id").orderBy("page_number", "block_id")))
    n = F.count("*")
    parts = F.array_sort(F.collect_list(F.struct("page_number", "block_id", "content")))
    text = F.array_join(F.transform(parts, lambda x: F.trim(F.coalesce(x["content"], F.lit("")))), " ")
    return o.groupBy("doc_id").agg(n.alias("blocks"), F.round(F.avg(F.when(F.size("evidence_ids") > 0, 1.0).otherwise(0.0)), 6).alias("provenance"), F.when(n < 2, 1.0).otherwise(F.round(1 - F.count_if(F.col("reading_order") < F.col("p")) / (n - 1), 6)).alias("ordering"), F.substring(F.md5(F.encode(F.lower(text), "utf-8")), 1, 16).alias("fingerprint"))


QUERIES, ORACLES = query.queries, query.oracles
