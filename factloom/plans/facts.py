"""More queries for the document-facts operators: tables, candidates, fingerprints, geometry, references, evaluation, events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.io import table
from factloom.operators import layout, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CELLS = "(SELECT DISTINCT cell_id, dataset_id, record_id, doc_id, feed_id, field_key, value, value_type, confidence FROM audit_cells)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _cells(spark, d):
    return table(spark, d, "audit_cells").select("cell_id", "dataset_id", "record_id", "doc_id", "feed_id", "field_key", "value", "value_type", "confidence").distinct()


_PIPE_SQL = "replace(replace(coalesce(value, ''), '|', '/'), chr(10), ' ')"


@query(f"SELECT DISTINCT cell_id AS row_no, field_key AS name, trim({_PIPE_SQL}, ' ') AS value, CASE WHEN trim({_PIPE_SQL}, ' ') = '' THEN 'blank' ELSE 'filled' END AS kind FROM audit_cells")
def pipe_rows(spark, d):
    """Every cell written as a row of pipes, split, classed and read back."""
    value = F.translate(F.coalesce("value", F.lit("")), "|\n", "/ ")
    lines = table(spark, d, "audit_cells").select(F.concat(F.lit("| "), F.col("cell_id"), F.lit(" | "), "field_key", F.lit(" | "), value, F.lit(" |")).alias("line")).distinct()
    c = lines.select(tables.split_pipe_row(F.col("line")).alias("cells")).where(tables.classify_pipe_cells(F.col("cells")) == "data")
    return c.select(F.col("cells")[0].cast("bigint").alias("row_no"), F.col("cells")[1].alias("name"), F.col("cells")[2].alias("value"), F.when(F.col("cells")[2] == "", "blank").otherwise("filled").alias("kind"))


@query(f"SELECT record_id, field_key, arg_max(value, (confidence, -cell_id)) AS value, max(confidence) AS confidence FROM {CELLS} WHERE value IS NOT NULL AND confidence IS NOT NULL GROUP BY 1, 2")
def pick_best_candidate(spark, d):
    """The value of highest confidence for each field of a record; ties fall to the first cell."""
    c = _cells(spark, d).where("value IS NOT NULL AND confidence IS NOT NULL")
    return c.groupBy("record_id", "field_key").agg(F.max_by("value", F.struct("confidence", -F.col("cell_id"))).alias("value"), F.max("confidence").alias("confidence"))


@query(f"SELECT record_id, field_key, lower(trim(value, ' ')) AS text, round(avg(confidence) + least(0.2, 0.05 * (count(DISTINCT feed_id) - 1)), 6) AS confidence FROM {CELLS} WHERE length(trim(value, ' ')) > 0 AND confidence >= 0.35 GROUP BY 1, 2, 3")
def fuse_text_candidates(spark, d):
    """Candidates of like text: mean confidence and a bonus for each further source."""
    c = _cells(spark, d).where("length(trim(value)) > 0 AND confidence >= 0.35")
    return c.groupBy("record_id", "field_key", F.lower(F.trim("value")).alias("text")).agg(F.round(F.avg("confidence") + F.least(F.lit(0.2), 0.05 * (F.count_distinct("feed_id") - 1)), 6).alias("confidence"))


@query(f"SELECT record_id, sha256(string_agg(field_key || '=' || value, '|' ORDER BY field_key, cell_id)) AS fingerprint, count(*) AS facts FROM {CELLS} WHERE value IS NOT NULL GROUP BY 1")
def canonical_fact_fingerprint(spark, d):
    """SHA-256 of a record's facts in fixed order."""
    c = _cells(spark, d).where("value IS NOT NULL")
    parts = F.array_sort(F.collect_list(F.struct("field_key", "cell_id", F.concat("field_key", F.lit("="), "value").alias("t"))))
    return c.groupBy("record_id").agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["t"]), "|"), 256).alias("fingerprint"), F.count("*").alias("facts"))


@query(f"WITH a AS (SELECT record_id, field_key, min(value) AS v FROM {CELLS} WHERE feed_id = 1 GROUP BY 1, 2), b AS (SELECT record_id, field_key, min(value) AS v FROM {CELLS} WHERE feed_id <> 1 GROUP BY 1, 2), j AS (SELECT coalesce(a.field_key, b.field_key) AS field_key, a.v AS av, b.v AS bv, a.record_id IS NOT NULL AS ina, b.record_id IS NOT NULL AS inb FROM a FULL JOIN b ON a.record_id = b.record_id AND a.field_key = b.field_key) SELECT field_key, count_if(ina) AS golden, count_if(inb) AS found, count(*) FILTER (WHERE av = bv) AS matched, round(2.0 * count(*) FILTER (WHERE av = bv) / (count_if(ina) + count_if(inb)), 6) AS f1 FROM j GROUP BY 1")
def kv_field_f1(spark, d):
    """F1 of one feed's key/values against the others'."""
    c = _cells(spark, d)
    a = c.where("feed_id = 1").groupBy("record_id", "field_key").agg(F.min("value").alias("av"), F.lit(True).alias("ina"))
    b = c.where("feed_id <> 1").groupBy("record_id", "field_key").agg(F.min("value").alias("bv"), F.lit(True).alias("inb"))
    j = a.join(b, ["record_id", "field_key"], "full").select("field_key", F.col("ina").isNotNull().alias("ina"), F.col("inb").isNotNull().alias("inb"), (F.col("av") == F.col("bv")).alias("same"))
    g, n, m = F.count_if("ina"), F.count_if("inb"), F.count_if("same")
    return j.groupBy("field_key").agg(g.alias("golden"), n.alias("found"), m.alias("matched"), F.round(2.0 * m / (g + n), 6).alias("f1"))


_HEADERS = "(SELECT dataset_id, md5(string_agg(field_key, chr(10) ORDER BY field_key)) AS header FROM (SELECT DISTINCT dataset_id, trim(field_key, ' ') AS field_key FROM audit_cells WHERE length(trim(field_key, ' ')) > 0) GROUP BY 1)"


def _headers(spark, d):
    """(dataset_id, header, fields): each dataset's distinct fields, and a digest that datasets with the same ones share."""
    f = table(spark, d, "audit_cells").where(F.length(F.trim("field_key")) > 0).groupBy("dataset_id").agg(F.array_sort(F.collect_set(F.trim("field_key"))).alias("fields"))
    return f.select("dataset_id", F.md5(F.array_join("fields", "\n")).alias("header"), "fields")


@query(f"SELECT dataset_id, header FROM {_HEADERS}")
def header_classes(spark, d):
    """The header class of each dataset: datasets with the same fields share one."""
    return _headers(spark, d).select("dataset_id", "header")


@query(f"""WITH h AS {_HEADERS}, f AS (SELECT DISTINCT header, trim(field_key, ' ') AS field_key FROM h JOIN audit_cells USING (dataset_id) WHERE length(trim(field_key, ' ')) > 0), n AS (SELECT header, count(*) AS n FROM f GROUP BY 1)
SELECT a.header AS base, b.header AS other, count(*) AS shared, round(count(*) / max(n.n), 6) AS overlap, count(*) / max(n.n) >= 0.6 AS matches FROM f a JOIN f b ON a.field_key = b.field_key AND a.header <> b.header JOIN n ON n.header = a.header GROUP BY 1, 2""")
def headers_match(spark, d):
    """Pairs of header classes that share fields, and whether six tenths of the first's are in the other: an equi-join of classes, not of datasets."""
    f = _headers(spark, d).dropDuplicates(["header"]).select("header", F.size("fields").alias("n"), F.explode("fields").alias("field"))
    j = f.select(F.col("header").alias("base"), "n", "field").join(f.select(F.col("header").alias("other"), "field"), "field").where("base <> other")
    share = F.count("*") / F.max("n")
    return j.groupBy("base", "other").agg(F.count("*").alias("shared"), F.round(share, 6).alias("overlap"), (share >= 0.6).alias("matches"))


@query("PIVOT (SELECT dataset_id, record_id, field_key, value FROM audit_cells) ON field_key USING max(value) GROUP BY dataset_id, record_id")
def wide_records(spark, d):
    """Wide rows of every dataset: each field key that occurs becomes a column, null where a dataset hasn't that field."""
    return table(spark, d, "audit_cells").groupBy("dataset_id", "record_id").pivot("field_key").agg(F.max("value"))


@query("WITH p AS (SELECT doc_id, line_no, line, sum(CASE WHEN regexp_matches(line, '^\\s*[\\[(]?[0-9]+[\\]).] ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS para FROM (SELECT doc_id, i AS line_no, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL))) SELECT doc_id, CAST(para AS BIGINT) AS para, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM p GROUP BY 1, 2")
def numbered_paragraphs(spark, d):
    """Lines grouped from one numbered line to the next: a running count as group key."""
    l = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    p = l.withColumn("para", F.sum(F.col("line").rlike(r"^\s*[\[(]?[0-9]+[\]).] ").cast("bigint")).over(w))
    return p.groupBy("doc_id", "para").agg(F.count("*").alias("lines"), F.sum(F.length("line")).cast("bigint").alias("chars"))


BLOCKS = "(SELECT DISTINCT block_id, doc_id, page_number, reading_order, level, content, bbox FROM text_blocks WHERE doc_id IS NOT NULL AND len(bbox) = 4)"


def _blocks(spark, d):
    return table(spark, d, "text_blocks").where("doc_id IS NOT NULL AND size(bbox) = 4").select("block_id", "doc_id", "page_number", "reading_order", "level", "content", "bbox").distinct()


@query(f"WITH o AS (SELECT block_id, bbox, lead(bbox) OVER (PARTITION BY doc_id, page_number ORDER BY reading_order, block_id) AS nb FROM {BLOCKS}), s AS (SELECT block_id, greatest(least(bbox[3], nb[3]) - greatest(bbox[1], nb[1]), 0) * greatest(least(bbox[4], nb[4]) - greatest(bbox[2], nb[2]), 0) AS i, (bbox[3] - bbox[1]) * (bbox[4] - bbox[2]) + (nb[3] - nb[1]) * (nb[4] - nb[2]) AS u FROM o WHERE nb IS NOT NULL) SELECT block_id, CASE WHEN u - i > 0 THEN round(i / (u - i), 6) ELSE 0 END AS iou FROM s")
def neighbour_iou(spark, d):
    """Intersection over union of each block's box with the next one's on its page."""
    w = Window.partitionBy("doc_id", "page_number").orderBy("reading_order", "block_id")
    b = _blocks(spark, d).withColumn("nb", F.lead("bbox").over(w)).where("nb IS NOT NULL")
    return b.select("block_id", F.round(scalars.iou([F.col("bbox")[i] for i in range(4)], [F.col("nb")[i] for i in range(4)]), 6).alias("iou"))


@query(f"""WITH x AS (SELECT DISTINCT doc_id, page_number, bbox[1] AS x FROM {BLOCKS}), g AS (SELECT *, x - lag(x) OVER (PARTITION BY doc_id, page_number ORDER BY x) AS gap FROM x),
m AS (SELECT doc_id, page_number, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS gaps, max(x) AS most, count(*) AS n FROM g GROUP BY 1, 2),
s AS (SELECT g.doc_id, g.page_number, x, n, most FROM g JOIN m ON g.doc_id = m.doc_id AND g.page_number IS NOT DISTINCT FROM m.page_number WHERE gap IS NULL OR gap > 2 * gaps[len(gaps) // 2 + 1])
SELECT doc_id, page_number, row_number() OVER w AS column_no, x AS starts, CASE WHEN n = 1 THEN x + 100 ELSE coalesce(lead(x) OVER w, most + 10) END AS ends FROM s WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY x)""")
def cluster_x_positions(spark, d):
    """Columns of a page: a new one begins where the distance to the next left edge is over twice the upper median of the page's distances."""
    x = _blocks(spark, d).groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_set(F.col("bbox")[0])).alias("xs"))
    return x.select("doc_id", "page_number", F.inline(layout.column_bounds(F.col("xs")))).select("doc_id", "page_number", F.col("column_no").cast("bigint").alias("column_no"), "starts", "ends")


@query("WITH e AS (SELECT DISTINCT block_id, unnest(evidence_ids) AS evidence_id FROM text_blocks) SELECT evidence_id, count(*) AS owners FROM e GROUP BY 1 HAVING count(*) > 1")
def duplicate_evidence(spark, d):
    """Evidence atoms that more than one block claims."""
    e = table(spark, d, "text_blocks").select("block_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
    return e.groupBy("evidence_id").agg(F.count("*").alias("owners")).where("owners > 1")


@query("SELECT DISTINCT block_id, doc_id FROM text_blocks WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents)")
def dangling_references(spark, d):
    """Blocks whose document isn't there: an anti-join."""
    b = table(spark, d, "text_blocks").where("doc_id IS NOT NULL").select("block_id", "doc_id").distinct()
    return b.join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_anti").select("block_id", "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM trust_fields WHERE needs_review)")
def documents_under_review(spark, d):
    """Documents with a field to review: a semi-join."""
    t = table(spark, d, "trust_fields").where("needs_review").select("doc_id")
    return table(spark, d, "documents").select("doc_id").join(t, "doc_id", "left_semi")


@query("SELECT package_id, count(DISTINCT path) AS paths, string_agg(DISTINCT document_type, ',' ORDER BY document_type) AS types, min(received_at) AS first_received FROM package_files GROUP BY 1")
def package_manifest(spark, d):
    """What each package holds."""
    p = table(spark, d, "package_files").groupBy("package_id")
    types = F.array_join(F.array_sort(F.collect_set("document_type")), ",")
    return p.agg(F.count_distinct("path").alias("paths"), F.when(F.count("document_type") > 0, types).alias("types"), F.min("received_at").alias("first_received"))


# Scripts by ranges of code points; letters of none of them are Latin. Ties fall to the last by name.
SCRIPTS = {"Arabic": "\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}", "Cyrillic": "\\x{0400}-\\x{052F}", "Devanagari": "\\x{0900}-\\x{097F}", "Han": "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}", "Hangul": "\\x{AC00}-\\x{D7AF}\\x{1100}-\\x{11FF}", "Hiragana": "\\x{3040}-\\x{309F}", "Katakana": "\\x{30A0}-\\x{30FF}\\x{31F0}-\\x{31FF}", "Thai": "\\x{0E00}-\\x{0E7F}"}
_COUNTS = {n: f"[^{r}]" for n, r in SCRIPTS.items()} | {"Latin": f"[{''.join(SCRIPTS.values())}\\P{{L}}]"}


@query("WITH s AS (SELECT DISTINCT block_id, " + ", ".join(f"length(regexp_replace(content, '{r}', '', 'g')) AS {n}" for n, r in _COUNTS.items()) + f" FROM text_blocks WHERE length(content) > 0), m AS (SELECT *, greatest({', '.join(_COUNTS)}) AS most FROM s) SELECT block_id, CASE " + " ".join(["WHEN most = 0 THEN NULL", *[f"WHEN {n} = most THEN '{n}'" for n in sorted(_COUNTS, reverse=True)]]) + f" END AS script, CASE WHEN most = 0 THEN 0 ELSE round(most / ({' + '.join(_COUNTS)}), 6) END AS share FROM m")
def detect_script(spark, d):
    """The script most letters of a block are in, the last by name of several, and their share."""
    b = table(spark, d, "text_blocks").where("length(content) > 0").select("block_id", *[F.length(F.regexp_replace("content", r, "")).alias(n) for n, r in _COUNTS.items()]).distinct()
    most = F.greatest(*_COUNTS)
    name = F.when(most == 0, F.lit(None).cast("string"))
    for n in sorted(_COUNTS, reverse=True):
        name = name.when(F.col(n) == most, n)
    return b.select("block_id", name.alias("script"), F.when(most == 0, 0.0).otherwise(F.round(most / sum(F.col(n) for n in _COUNTS), 6)).alias("share"))


_MONEY = r"(?:EUR|USD|£|\$|€) ?[0-9][0-9,.]*[0-9]"


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_MONEY}')) AS amounts, regexp_extract_all(text, '{_MONEY}')[1] AS first_amount FROM documents WHERE regexp_matches(text, '{_MONEY}')")
def money_values(spark, d):
    """Money amounts named in a text."""
    every = F.regexp_extract_all("text", F.lit(f"({_MONEY})"), 1)
    return table(spark, d, "documents").where(F.col("text").rlike(_MONEY)).select("doc_id", F.size(every).cast("bigint").alias("amounts"), F.element_at(every, 1).alias("first_amount"))


@query("WITH i AS (SELECT DISTINCT file_id, upper(regexp_replace(account_number, '\\s', '', 'g')) AS t FROM package_files WHERE regexp_matches(upper(regexp_replace(account_number, '\\s', '', 'g')), '^[A-Z]{2}[0-9]{2}[A-Z0-9]{18}$')), c AS (SELECT file_id, [CASE WHEN ascii(x) >= 65 THEN CAST(ascii(x) - 55 AS VARCHAR) ELSE x END FOR x IN string_split(substr(t, 5) || substr(t, 1, 4), '')] AS l FROM i) SELECT file_id, CAST(array_to_string(l, '') AS HUGEINT) % 97 = 1 AS valid FROM c")
def validate_iban(spark, d):
    """Whether the check digits of bare IBANs hold."""
    t = F.upper(F.regexp_replace("account_number", r"\s", ""))
    return table(spark, d, "package_files").where(t.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{18}$")).select("file_id", scalars.iban_ok(F.col("account_number")).alias("valid")).distinct()


_FORMAT_CHECKS = {"email": r"^[^@\s]+@[^@\s]+\.[a-z]{2,}$", "vat": r"^[A-Z]{2}[0-9A-Z]{8,12}$", "ein": r"^[0-9]{2}-[0-9]{7}$", "bic": r"^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$", "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "passport": r"^[A-Z]{2}[0-9]{7}$"}


@query("WITH v AS (SELECT DISTINCT file_id, id_number AS x FROM package_files WHERE id_number IS NOT NULL) SELECT file_id, " + ", ".join(f"regexp_matches(x, '{p}') AS {n}" for n, p in _FORMAT_CHECKS.items()) + " FROM v")
def validate_formats(spark, d):
    """Format checks of identity numbers."""
    return table(spark, d, "package_files").where("id_number IS NOT NULL").select("file_id", *[F.col("id_number").rlike(p).alias(n) for n, p in _FORMAT_CHECKS.items()]).distinct()


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """Tumbling windows of one hour; the batch twin of streaming.windows."""
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_event, max(ts) AS last_ts, count(*) AS events FROM events GROUP BY 1")
def latest_progress(spark, d):
    """The latest event of each user."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"), F.max("ts").alias("last_ts"), F.count("*").alias("events"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_properties(spark, d):
    """A typed property out of JSON text."""
    return table(spark, d, "events").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k")).where("k IS NOT NULL")


@query("SELECT doc_id, lang, CASE WHEN lang IS NULL THEN 'unknown' WHEN lower(left(trim(lang, ' '), 2)) IN ('en', 'de', 'fr', 'es') THEN lower(left(trim(lang, ' '), 2)) ELSE 'other' END AS language FROM documents")
def resolve_language_hint(spark, d):
    """Explicit language hints to codes."""
    two = F.lower(F.substring(F.trim("lang"), 1, 2))
    return table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("lang").isNull(), "unknown").when(two.isin("en", "de", "fr", "es"), two).otherwise("other").alias("language"))


@query("SELECT ruling_no, version_no, doc_id, CASE WHEN lag(text) OVER w IS NULL THEN 'first' WHEN lag(text) OVER w = text THEN 'same' ELSE 'changed' END AS change FROM documents WHERE ruling_no IS NOT NULL AND text IS NOT NULL WINDOW w AS (PARTITION BY ruling_no ORDER BY version_no, doc_id)")
def version_changes(spark, d):
    """Whether each version of a ruling differs from the one before; digests are compared, not texts."""
    w = Window.partitionBy("ruling_no").orderBy("version_no", "doc_id")
    docs = table(spark, d, "documents").where("ruling_no IS NOT NULL AND text IS NOT NULL").select("ruling_no", "version_no", "doc_id", F.sha2("text", 256).alias("h"))
    p = F.lag("h").over(w)
    return docs.select("ruling_no", "version_no", "doc_id", F.when(p.isNull(), "first").when(p == F.col("h"), "same").otherwise("changed").alias("change"))


@query("WITH g AS (SELECT docket_no, count(*) AS docs, count(DISTINCT ruling_no) AS rulings, count(DISTINCT court_code) AS courts FROM documents GROUP BY 1) SELECT CASE WHEN courts > 1 THEN 'fail' WHEN docs > 2 * rulings THEN 'warn' ELSE 'pass' END AS gate, count(*) AS dockets, CAST(sum(docs) AS BIGINT) AS docs FROM g GROUP BY 1")
def quality_gates(spark, d):
    """Threshold gates over dockets."""
    g = table(spark, d, "documents").groupBy("docket_no").agg(F.count("*").alias("docs"), F.count_distinct("ruling_no").alias("rulings"), F.count_distinct("court_code").alias("courts"))
    gate = F.when(F.col("courts") > 1, "fail").when(F.col("docs") > 2 * F.col("rulings"), "warn").otherwise("pass")
    return g.groupBy(gate.alias("gate")).agg(F.count("*").alias("dockets"), F.sum("docs").alias("docs"))
