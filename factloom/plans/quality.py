"""Queries on quality: fidelity of documents, gates, metrics by bucket and against targets, review and coverage, deduplication, conservation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.io import table
from factloom.operators import gates
from factloom.plans.base import Book

query = Book()
B = "(SELECT DISTINCT block_id, doc_id, page_number, reading_order, role, content, evidence_ids FROM text_blocks WHERE doc_id IS NOT NULL)"


def _blocks(spark, d):
    return table(spark, d, "text_blocks").where("doc_id IS NOT NULL").select("block_id", "doc_id", "page_number", "reading_order", "role", "content", "evidence_ids").distinct()


# What each shortcoming takes off at most.
PENALTIES = {"encoding": 0.20, "pages": 0.15, "repeats": 0.15, "whitespace": 0.10, "truncation": 0.05}
_STRIP = "trim(content, ' ')"
_FIDELITY = f"""x AS (SELECT *, {_STRIP} AS s FROM {B}), k AS (SELECT doc_id, sum(length(content)) AS chars, sum(length(content) - length(regexp_replace(content, '[\\x{{fffd}}\\x{{fffe}}\\x{{ffff}}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'))) AS garbled,
count(DISTINCT page_number) AS pages, max(page_number) AS last_page, count(*) AS n, count(DISTINCT (page_number, content)) AS different,
count(*) FILTER (WHERE length(content) >= 5) AS segments, count(*) FILTER (WHERE length(content) >= 5 AND regexp_matches(content, '(?:\\S\\s){{3,}}\\S')) AS spaced,
count(*) FILTER (WHERE length(s) >= 10 AND contains(s, ' ')) AS checked, count(*) FILTER (WHERE length(s) >= 10 AND contains(s, ' ') AND NOT regexp_matches(s, '[.!?。！？；;：:\\-—)\\]》）】」』0-9%‰\\x{{4e00}}-\\x{{9fff}}]$')) AS cut FROM x WHERE length(content) > 0 GROUP BY 1),
r AS (SELECT doc_id, greatest(0, 1 - 20 * garbled / chars) AS encoding, CASE WHEN last_page <= 1 THEN 1 ELSE pages / last_page END AS pages, different / n AS repeats, CASE WHEN segments = 0 THEN 1 ELSE (segments - spaced) / segments END AS whitespace, CASE WHEN checked = 0 THEN 1 ELSE (checked - cut) / checked END AS truncation FROM k)"""
_SCORE = "round(1 - (" + " + ".join(f"round((1 - {n}) * {c} + 1e-9, 4)" for n, c in PENALTIES.items()) + "), 4)"


@query(f"WITH {_FIDELITY} SELECT doc_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in PENALTIES) + f", {_SCORE} AS score, {_SCORE} >= 0.7 AS passed FROM r")
def document_fidelity(spark, d):
    """How faithful each document's blocks are: shares of sound characters, of pages with content, of blocks that don't repeat, of texts without spaced
    letters and of texts that end as sentences do; what lacks is taken off a score, and seven tenths pass."""
    c, s = F.col("content"), F.trim("content")
    long = (F.length(s) >= 10) & s.contains(" ")
    b = _blocks(spark, d).where("length(content) > 0")
    k = b.groupBy("doc_id").agg(
        F.sum(F.length(c)).alias("chars"), F.sum(F.length(c) - F.length(F.regexp_replace(c, r"[\x{fffd}\x{fffe}\x{ffff}\x00-\x08\x0b\x0c\x0e-\x1f]", ""))).alias("garbled"),
        F.count_distinct("page_number").alias("n_pages"), F.max("page_number").alias("last_page"), F.count("*").alias("n"), F.count_distinct(F.struct("page_number", F.md5(F.encode(c, "utf-8")))).alias("different"),
        F.count_if(F.length(c) >= 5).alias("segments"), F.count_if((F.length(c) >= 5) & c.rlike(r"(?:\S\s){3,}\S")).alias("spaced"),
        F.count_if(long).alias("checked"), F.count_if(long & ~s.rlike(r"[.!?。！？；;：:\-—)\]》）】」』0-9%‰\x{4e00}-\x{9fff}]$")).alias("cut"),
    )
    share = lambda good, of: F.when(F.col(of) == 0, 1.0).otherwise(good / F.col(of))
    r = k.select(
        "doc_id", F.greatest(F.lit(0.0), 1 - 20 * F.col("garbled") / F.col("chars")).alias("encoding"), F.when(F.col("last_page") <= 1, 1.0).otherwise(F.col("n_pages") / F.col("last_page")).alias("pages"),
        (F.col("different") / F.col("n")).alias("repeats"), share(F.col("segments") - F.col("spaced"), "segments").alias("whitespace"), share(F.col("checked") - F.col("cut"), "checked").alias("truncation"),
    )
    score = F.round(1 - sum(F.round((1 - F.col(n)) * most + 1e-9, 4) for n, most in PENALTIES.items()), 4)
    return r.select("doc_id", *[F.round(n, 6).alias(n) for n in PENALTIES], score.alias("score"), (score >= 0.7).alias("passed"))


@query(f"WITH o AS (SELECT doc_id, reading_order, lag(reading_order) OVER (PARTITION BY doc_id ORDER BY page_number, block_id) AS p FROM {B}), n AS (SELECT doc_id, count(*) AS n, count_if(p IS NOT NULL AND reading_order < p) AS inv FROM o GROUP BY 1) SELECT doc_id, CASE WHEN n < 2 THEN 1.0 ELSE round(1 - inv / (n - 1), 6) END AS score FROM n")
def reading_order_share(spark, d):
    """One less the share of adjacent blocks whose orders are inverted."""
    w = Window.partitionBy("doc_id").orderBy("page_number", "block_id")
    o = _blocks(spark, d).select("doc_id", "reading_order", F.lag("reading_order").over(w).alias("p"))
    n = F.count("*")
    return o.groupBy("doc_id").agg(F.when(n < 2, 1.0).otherwise(F.round(1 - F.count_if(F.col("reading_order") < F.col("p")) / (n - 1), 6)).alias("score"))


@query(f"SELECT doc_id, round(avg(CASE WHEN len(evidence_ids) > 0 THEN 1.0 ELSE 0.0 END), 6) AS provenance FROM {B} GROUP BY 1")
def provenance_share(spark, d):
    """The share of each document's blocks that name their evidence."""
    return _blocks(spark, d).groupBy("doc_id").agg(F.round(F.avg(F.when(F.size("evidence_ids") > 0, 1.0).otherwise(0.0)), 6).alias("provenance"))


@query(f"WITH t AS (SELECT doc_id, role, trim(content, ' ') AS text, page_number, reading_order FROM {B} WHERE role IN ('header', 'footer') AND length(trim(content, ' ')) > 0) SELECT doc_id, role, text, count(DISTINCT page_number) AS pages, count(*) AS blocks FROM t GROUP BY 1, 2, 3 HAVING count(DISTINCT page_number) >= 2")
def repeated_edges(spark, d):
    """Heads and feet that recur on two pages or more of a document."""
    t = _blocks(spark, d).where("role IN ('header', 'footer')").select("doc_id", "role", F.trim("content").alias("text"), "page_number").where(F.length("text") > 0)
    return t.groupBy("doc_id", "role", "text").agg(F.count_distinct("page_number").alias("pages"), F.count("*").alias("blocks")).where("pages >= 2")


# --- gates and metrics

GATES = [("equals", {"equals": "digital"}, "extraction_method"), ("in", {"in": ["ok", "success", "partial"]}, "status"), ("min", {"min": 0.5}, "confidence"), ("max", {"max": 40}, "page_count"), ("max_issues", {"max_issues": 3}, "page_count"), ("contains", {"contains": "o"}, "document_type")]
_R = "(SELECT DISTINCT result_id, status, confidence, extraction_method, document_type, page_count FROM parse_results)"


@query(f"""SELECT result_id, extraction_method IS NOT DISTINCT FROM 'digital' AS "equals", coalesce(status IN ('ok', 'success', 'partial'), false) AS "in", coalesce(confidence >= 0.5, false) AS "min", coalesce(page_count <= 40, false) AS "max", coalesce(page_count, 0) <= 3 AS max_issues, coalesce(contains(document_type, 'o'), false) AS contains FROM {_R}""")
def gate_results(spark, d):
    """Each comparison that a gate may make, on the results of parsing."""
    r = table(spark, d, "parse_results").select("result_id", "status", "confidence", "extraction_method", "document_type", "page_count").distinct()
    return r.select("result_id", *[gates.passed(F.col(c), spec).alias(n) for n, spec, c in GATES])


TARGETS = {"silent_failure_rate": (0.0, "max"), "schema_validation_pass_rate": (0.99, "min"), "evidence_coverage_for_key_fields": (0.95, "min"), "page_level_partial_retention": (1.0, "min"), "error_envelope_coverage": (1.0, "min"), "markdown_generation_success": (0.99, "min")}
_OBS = f"""o AS (SELECT count_if(confidence IS NULL) / count(*) AS a, count_if(status IS NOT NULL) / count(*) AS b, avg(CASE WHEN confidence > 0 THEN confidence END) AS c, count_if(page_count > 0) / count(*) AS e FROM {_R})"""


def _observed(spark, d):
    r = table(spark, d, "parse_results").select("result_id", "status", "confidence", "extraction_method", "document_type", "page_count").distinct()
    n = F.count("*")
    o = r.agg((F.count_if(F.col("confidence").isNull()) / n).alias("silent_failure_rate"), (F.count_if(F.col("status").isNotNull()) / n).alias("schema_validation_pass_rate"), F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("evidence_coverage_for_key_fields"), (F.count_if(F.col("page_count") > 0) / n).alias("page_level_partial_retention"))
    return o.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in o.columns])))


@query(f"""WITH {_OBS}, g(metric, target, direction, observed) AS (SELECT 'silent_failure_rate', 0.0, 'max', a FROM o UNION ALL SELECT 'schema_validation_pass_rate', 0.99, 'min', b FROM o UNION ALL SELECT 'evidence_coverage_for_key_fields', 0.95, 'min', c FROM o UNION ALL SELECT 'page_level_partial_retention', 1.0, 'min', e FROM o
UNION ALL SELECT 'error_envelope_coverage', 1.0, 'min', NULL UNION ALL SELECT 'markdown_generation_success', 0.99, 'min', NULL) SELECT metric, target::DOUBLE AS target, direction, round(observed, 6) AS observed, CASE WHEN observed IS NULL THEN 'not_measured' WHEN (direction = 'min' AND observed >= target) OR (direction = 'max' AND observed <= target) THEN 'pass' ELSE 'fail' END AS status FROM g""")
def metrics_against_targets(spark, d):
    """Metrics of all results of parsing against their targets."""
    return gates.against_targets(spark, _observed(spark, d), TARGETS).withColumn("observed", F.round("observed", 6))


_DIMS = ("status", "extraction_method", "document_type")


@query(f"""WITH r AS (SELECT coalesce(status, 'unknown') AS status, coalesce(extraction_method, 'unknown') AS extraction_method, coalesce(document_type, 'unknown') AS document_type, confidence FROM {_R})
SELECT CASE WHEN grouping(status) = 0 THEN 'status' WHEN grouping(extraction_method) = 0 THEN 'extraction_method' WHEN grouping(document_type) = 0 THEN 'document_type' ELSE 'overall' END AS dimension, coalesce(status, extraction_method, document_type, 'all') AS bucket, count(*) AS n, round(avg(CASE WHEN confidence > 0 THEN confidence END), 4) AS mean, coalesce(avg(CASE WHEN confidence > 0 THEN confidence END) < 0.8, false) AS failing FROM r GROUP BY GROUPING SETS ((status), (extraction_method), (document_type), ())""")
def observations_by_bucket(spark, d):
    """Confidence over all results and by each single dimension, and whether it falls short of its target; zero scores don't count for means."""
    r = table(spark, d, "parse_results").select("result_id", "status", "confidence", "extraction_method", "document_type", "page_count").distinct()
    r = r.select("confidence", *[F.coalesce(c, F.lit("unknown")).alias(c) for c in _DIMS])
    mean = F.avg(F.when(F.col("confidence") > 0, F.col("confidence")))
    g = r.groupingSets([[c] for c in _DIMS] + [[]], *_DIMS).agg(F.count("*").alias("n"), F.round(mean, 4).alias("mean"), F.coalesce(mean < 0.8, F.lit(False)).alias("failing"), F.grouping_id().alias("gid"))
    name = F.when(F.col("gid") == 3, "status").when(F.col("gid") == 5, "extraction_method").when(F.col("gid") == 6, "document_type").otherwise("overall")
    return g.select(name.alias("dimension"), F.coalesce(*_DIMS, F.lit("all")).alias("bucket"), "n", "mean", "failing")


# --- review and coverage of fields

F_ = "(SELECT DISTINCT field_id, artifact_key, name, value, currency, confidence, page, bbox, source_ref, needs_review FROM trust_fields)"
P0 = ("total_amount", "costs_awarded")


def _fields(spark, d):
    return table(spark, d, "trust_fields").select("field_id", "artifact_key", "name", "value", "currency", "confidence", "page", "bbox", "source_ref", "needs_review").distinct()


_HAS = "coalesce(length(source_ref) > 0 OR page IS NOT NULL OR len(bbox) > 0 OR confidence > 0, false)"


def _evidenced():
    return F.coalesce(F.length("source_ref") > 0, F.lit(False)) | F.col("page").isNotNull() | F.coalesce(F.size("bbox") > 0, F.lit(False)) | F.coalesce(F.col("confidence") > 0, F.lit(False))


@query(f"""WITH s AS (SELECT artifact_key, name, CASE WHEN needs_review THEN 1 ELSE 0 END AS flagged, CASE WHEN confidence < 0.7 THEN 1 ELSE 0 END AS golden FROM {F_}), k AS (SELECT artifact_key, name, max(flagged) AS f, max(golden) AS g FROM s GROUP BY 1, 2)
SELECT count_if(g = 1) AS should_flag, count_if(g = 1 AND f = 1) AS correctly, count_if(g = 1 AND f = 0) AS missed, round(count_if(g = 1 AND f = 1) / count_if(g = 1), 6) AS recall, round(count_if(g = 1 AND f = 1) / count_if(f = 1), 6) AS precision FROM k""")
def flag_recall(spark, d):
    """Fields flagged for review against those of low confidence, as sets of paths."""
    one = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    k = _fields(spark, d).groupBy("artifact_key", "name").agg(one(F.col("needs_review")).alias("f"), one(F.col("confidence") < 0.7).alias("g"))
    g, f = F.col("g") == 1, F.col("f") == 1
    return k.agg(F.count_if(g).alias("should_flag"), F.count_if(g & f).alias("correctly"), F.count_if(g & ~f).alias("missed"), F.round(F.count_if(g & f) / F.count_if(g), 6).alias("recall"), F.round(F.count_if(g & f) / F.count_if(f), 6).alias("precision"))


_STATUS = "CASE WHEN source_ref IS NULL OR source_ref = '' THEN 'needs_evidence' WHEN confidence >= 0.85 THEN 'auto_accepted' WHEN confidence >= 0.6 THEN 'manual_optional' ELSE 'needs_review' END"


@query(f"""WITH s AS (SELECT name, confidence, {_STATUS} AS status, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS bucket, coalesce(length(source_ref) > 0, false) AS has FROM {F_})
SELECT name, bucket, count(*) AS total, count_if(status IN ('needs_review', 'needs_evidence')) AS review, count_if(status = 'auto_accepted') AS accepted, count_if(NOT has) AS no_evidence, count(*) FILTER (WHERE confidence < 0.5) AS low FROM s GROUP BY GROUPING SETS ((name), (bucket), ())""")
def review_summary(spark, d):
    """Fields by name, by class of confidence and in all: how many are to be reviewed, accepted, without evidence, of low confidence."""
    from factloom.functions.cells import review_of

    has = F.coalesce(F.length("source_ref") > 0, F.lit(False))
    s = _fields(spark, d).select("name", "confidence", review_of(has, F.col("confidence")).alias("status"), F.when(F.col("confidence") >= 0.85, "high").when(F.col("confidence") >= 0.6, "medium").otherwise("low").alias("bucket"), has.alias("has"))
    g = s.groupingSets([["name"], ["bucket"], []], "name", "bucket")
    return g.agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("needs_review", "needs_evidence")).alias("review"), F.count_if(F.col("status") == "auto_accepted").alias("accepted"), F.count_if(~F.col("has")).alias("no_evidence"), F.count_if(F.col("confidence") < 0.5).alias("low"))


@query(f"SELECT coalesce(round(count_if(NOT {_HAS} AND NOT coalesce(needs_review, false)) / nullif(count_if(NOT {_HAS}), 0), 6), 0) AS rate FROM {F_}")
def unproven_acceptance(spark, d):
    """The share of fields without any evidence that aren't marked for review; 0 if all have evidence."""
    bare = ~_evidenced()
    rate = F.count_if(bare & ~F.coalesce("needs_review", F.lit(False))) / F.nullif(F.count_if(bare), F.lit(0))
    return _fields(spark, d).agg(F.coalesce(F.round(rate, 6), F.lit(0.0)).alias("rate"))


_KEYS = "('total_amount', 'P0'), ('costs_awarded', 'P0'), ('security_deposit', 'P1'), ('filing_fee', 'P1')"
_COVER = f"c AS (SELECT a.artifact_key, k.name, k.priority, coalesce(max(CASE WHEN {_HAS} THEN 1 ELSE 0 END), 0) AS has FROM (SELECT DISTINCT artifact_key FROM {F_} WHERE artifact_key IS NOT NULL) a CROSS JOIN (VALUES {_KEYS}) k(name, priority) LEFT JOIN {F_} f ON f.artifact_key = a.artifact_key AND f.name = k.name GROUP BY 1, 2, 3)"


def _covered(spark, d):
    """(artifact_key, name, priority, has) of each key field of each artifact; the four key fields are literals."""
    keys = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("priority")) for n, p in (("total_amount", "P0"), ("costs_awarded", "P0"), ("security_deposit", "P1"), ("filing_fee", "P1"))])
    per = _fields(spark, d).where("artifact_key IS NOT NULL").groupBy("artifact_key").agg(F.collect_set(F.when(_evidenced(), F.col("name"))).alias("names"))
    return per.select("artifact_key", "names", F.inline(keys)).select("artifact_key", "name", "priority", F.array_contains("names", F.col("name")).alias("has"))


@query(f"WITH {_COVER} SELECT artifact_key, count(*) AS key_fields, CAST(sum(has) AS BIGINT) AS evidenced, round(avg(has), 6) AS coverage, round(avg(CASE WHEN priority = 'P0' THEN has END), 6) AS p0_coverage FROM c GROUP BY 1")
def key_field_coverage(spark, d):
    """How many of each artifact's key fields have evidence, in all and of first priority."""
    has = F.col("has").cast("int")
    return _covered(spark, d).groupBy("artifact_key").agg(F.count("*").alias("key_fields"), F.sum(has).alias("evidenced"), F.round(F.avg(has), 6).alias("coverage"), F.round(F.avg(F.when(F.col("priority") == "P0", has)), 6).alias("p0_coverage"))


@query(f"WITH {_COVER} SELECT name, count(*) AS artifacts, round(sum(has) / count(*), 6) AS coverage, count(*) - CAST(sum(has) AS BIGINT) AS uncovered FROM c GROUP BY GROUPING SETS ((name), ())")
def coverage_summary(spark, d):
    """Coverage of each key field over all artifacts, and of all together."""
    has = F.col("has").cast("int")
    return _covered(spark, d).groupingSets([["name"], []], "name").agg(F.count("*").alias("artifacts"), F.round(F.sum(has) / F.count("*"), 6).alias("coverage"), (F.count("*") - F.sum(has)).alias("uncovered"))


@query(f"""SELECT artifact_key, CASE WHEN source_ref IS NOT NULL AND source_ref <> '' THEN 'ref' WHEN len(bbox) > 0 THEN 'box' WHEN page IS NOT NULL THEN 'page' ELSE 'unresolved' END AS kind, count(*) AS spans, count(*) FILTER (WHERE confidence < 0.5) AS to_review FROM {F_} GROUP BY 1, 2""")
def source_spans(spark, d):
    """Spans of evidence behind each artifact's fields by their strongest kind, and those to be reviewed."""
    kind = F.when(F.col("source_ref").isNotNull() & (F.col("source_ref") != ""), "ref").when(F.size("bbox") > 0, "box").when(F.col("page").isNotNull(), "page").otherwise("unresolved")
    return _fields(spark, d).groupBy("artifact_key", kind.alias("kind")).agg(F.count("*").alias("spans"), F.count_if(F.col("confidence") < 0.5).alias("to_review"))


# --- sets and deduplication

_TX = "(SELECT DISTINCT field_id, artifact_key, name, value, currency FROM trust_fields)"


@query(f"SELECT min(field_id) AS field_id, count(*) AS rows FROM {_TX} GROUP BY artifact_key, name, coalesce(value, ''), coalesce(currency, '')")
def first_of_equal_fields(spark, d):
    """The first of the fields that state the same under the same name."""
    f = table(spark, d, "trust_fields").select("field_id", "artifact_key", "name", "value", "currency").distinct()
    g = f.groupBy("artifact_key", "name", F.coalesce("value", F.lit("")).alias("_v"), F.coalesce("currency", F.lit("")).alias("_c"))
    return g.agg(F.min("field_id").alias("field_id"), F.count("*").alias("rows")).select("field_id", "rows")


@query("SELECT artifact_key, name, arg_min(value, (extracted_at, field_id)) AS value FROM trust_fields WHERE artifact_key IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT artifact_key, name, value FROM trust_fields WHERE artifact_key IS NULL AND value IS NOT NULL")
def union_keep_first(spark, d):
    """Fields united, the first of each key kept and those without a key all."""
    f = table(spark, d, "trust_fields").where("value IS NOT NULL")
    first = f.where("artifact_key IS NOT NULL").groupBy("artifact_key", "name").agg(F.min_by("value", F.struct("extracted_at", "field_id")).alias("value"))
    return first.unionByName(f.where("artifact_key IS NULL").select("artifact_key", "name", "value"))


@query("WITH c AS (SELECT DISTINCT record_id, field_key, feed_id, value FROM audit_cells WHERE value IS NOT NULL), e AS (SELECT record_id, field_key, count(DISTINCT value) AS versions, count(DISTINCT feed_id) AS feeds FROM c GROUP BY 1, 2) SELECT field_key, count(*) AS fields, count_if(versions = 1) AS agreed, round(count_if(versions = 1) / count(*), 6) AS recall FROM e WHERE feeds > 1 GROUP BY 1")
def field_agreement(spark, d):
    """Of the fields that several feeds give, how many all give alike."""
    c = table(spark, d, "audit_cells").where("value IS NOT NULL").groupBy("record_id", "field_key").agg(F.count_distinct("value").alias("versions"), F.count_distinct("feed_id").alias("feeds")).where("feeds > 1")
    n, k = F.count("*"), F.count_if(F.col("versions") == 1)
    return c.groupBy("field_key").agg(n.alias("fields"), k.alias("agreed"), F.round(k / n, 6).alias("recall"))


@query("SELECT record_id, sha256(string_agg(field_key || '=' || v, '&' ORDER BY field_key)) AS seal FROM (SELECT record_id, field_key, string_agg(v, '|' ORDER BY v) AS v FROM (SELECT DISTINCT record_id, field_key, trim(value, ' ') AS v FROM audit_cells WHERE length(trim(value, ' ')) > 0) GROUP BY 1, 2) GROUP BY 1")
def sealed_records(spark, d):
    """A digest of each record's facts in the order of their names, apart from what changes between deliveries."""
    c = table(spark, d, "audit_cells").select("record_id", "field_key", F.trim("value").alias("v")).where(F.length("v") > 0)
    c = c.groupBy("record_id", "field_key").agg(F.array_join(F.array_sort(F.collect_set("v")), "|").alias("v"))
    parts = F.array_sort(F.collect_list(F.struct("field_key", F.concat("field_key", F.lit("="), "v").alias("t"))))
    return c.groupBy("record_id").agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["t"]), "&"), 256).alias("seal"))


@query("WITH v AS (SELECT cell_id, ingested_at, value, lag(value) OVER (PARTITION BY cell_id ORDER BY ingested_at) AS old, row_number() OVER (PARTITION BY cell_id ORDER BY ingested_at) AS n FROM audit_cells) SELECT CASE WHEN value IS DISTINCT FROM old THEN 'changed' ELSE 'same' END AS change, count(*) AS n FROM v WHERE n > 1 GROUP BY 1")
def cell_mutations(spark, d):
    """Deliveries of a cell after its first, by whether they changed it."""
    w = Window.partitionBy("cell_id").orderBy("ingested_at")
    v = table(spark, d, "audit_cells").select("value", F.lag("value").over(w).alias("old"), F.row_number().over(w).alias("n")).where("n > 1")
    return v.groupBy(F.when(F.col("value").eqNullSafe(F.col("old")), "same").otherwise("changed").alias("change")).agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT result_id, max(page_count) AS stated, max(len(pages)) AS given, max(len(array_to_string([p.page_text FOR p IN pages], chr(10)))) AS chars, max(length(full_text)) AS whole FROM parse_results GROUP BY 1) SELECT result_id, stated IS NOT DISTINCT FROM given AS pages_agree, chars IS NOT DISTINCT FROM whole AS text_agrees FROM l")
def conservation(spark, d):
    """Whether a result's pages are as many as it states and hold as much text as the whole."""
    r = table(spark, d, "parse_results").groupBy("result_id").agg(F.max("page_count").alias("stated"), F.max(F.when(F.col("pages").isNotNull(), F.size("pages"))).alias("given"), F.max(F.length(F.array_join(F.transform("pages", lambda p: p["page_text"]), "\n"))).alias("chars"), F.max(F.length("full_text")).alias("whole"))
    return r.select("result_id", F.col("stated").eqNullSafe(F.col("given")).alias("pages_agree"), F.col("chars").eqNullSafe(F.col("whole")).alias("text_agrees"))


@query("WITH e AS (SELECT DISTINCT doc_id, block_id, unnest(evidence_ids) AS atom FROM text_blocks WHERE doc_id IS NOT NULL), o AS (SELECT doc_id, atom, count(*) AS owners FROM e GROUP BY 1, 2) SELECT doc_id, count(*) AS atoms, count_if(owners > 1) AS shared, CASE WHEN count_if(owners > 1) = 0 THEN 'pass' ELSE 'fail' END AS gate FROM o GROUP BY 1")
def source_conservation(spark, d):
    """Whether every atom of evidence of a document belongs to one block only."""
    e = table(spark, d, "text_blocks").where("doc_id IS NOT NULL").select("doc_id", "block_id", F.explode("evidence_ids").alias("atom")).distinct()
    o = e.groupBy("doc_id", "atom").agg(F.count("*").alias("owners"))
    shared = F.count_if(F.col("owners") > 1)
    return o.groupBy("doc_id").agg(F.count("*").alias("atoms"), shared.alias("shared"), F.when(shared == 0, "pass").otherwise("fail").alias("gate"))


@query("WITH s AS (SELECT DISTINCT cell_id, field_key, value, raw, feed_id FROM audit_cells WHERE value IS NOT NULL AND raw IS NOT NULL) SELECT field_key, count_if(value = raw) AS true_negative, count_if(value <> raw AND trim(value, ' ') = trim(raw, ' ')) AS corrected, count_if(trim(value, ' ') <> trim(raw, ' ')) AS changed FROM s GROUP BY 1")
def correction_report(spark, d):
    """Cells whose value is their raw text, differs from it by blanks only, or is another."""
    s = table(spark, d, "audit_cells").where("value IS NOT NULL AND raw IS NOT NULL").select("cell_id", "field_key", "value", "raw", "feed_id").distinct()
    same, near = F.col("value") == F.col("raw"), F.trim("value") == F.trim("raw")
    return s.groupBy("field_key").agg(F.count_if(same).alias("true_negative"), F.count_if(~same & near).alias("corrected"), F.count_if(~near).alias("changed"))


@query("WITH c AS (SELECT DISTINCT dataset_id, record_id, field_key, value FROM audit_cells), r AS (SELECT dataset_id, record_id, max(CASE WHEN field_key LIKE '%\\_at' ESCAPE '\\' AND length(value) > 0 THEN 1 ELSE 0 END) AS dated, max(CASE WHEN field_key = 'amount' AND length(value) > 0 THEN 1 ELSE 0 END) AS priced FROM c GROUP BY 1, 2), q AS (SELECT dataset_id, count(*) AS n, count_if(dated = 1 AND priced = 1) AS k FROM r GROUP BY 1) SELECT dataset_id, n AS records, k AS canonical, round(k / n, 6) AS ratio, CASE WHEN k / n >= 0.8 THEN 'pass' WHEN k / n >= 0.5 THEN 'warn' ELSE 'fail' END AS status FROM q")
def canonical_rows(spark, d):
    """Of each dataset, the records that have both a time and an amount, as a share with a verdict."""
    full = F.coalesce(F.length("value") > 0, F.lit(False))
    r = table(spark, d, "audit_cells").groupBy("dataset_id", "record_id").agg(F.max((F.col("field_key").endswith("_at") & full).cast("int")).alias("dated"), F.max(((F.col("field_key") == "amount") & full).cast("int")).alias("priced"))
    n, k = F.count("*"), F.count_if((F.col("dated") == 1) & (F.col("priced") == 1))
    return r.groupBy("dataset_id").agg(n.alias("records"), k.alias("canonical"), F.round(k / n, 6).alias("ratio"), F.when(k / n >= 0.8, "pass").when(k / n >= 0.5, "warn").otherwise("fail").alias("status"))


QUERIES, ORACLES = query.queries, query.oracles
