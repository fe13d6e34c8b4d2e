"""Queries for the document-facts operators: lines, headings, chunks, key/values, ledgers, typing, quality, evidence, rendering, safety.

Each query is named after what it computes; ORACLES holds the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.io import table
from factloom.operators import ledgers, nested
from factloom.operators.common import guarded_broadcast, latest, numbered
from factloom.plans.oracles import _elements, _opened

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _lines(docs: DataFrame) -> DataFrame:
    return docs.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).cast("int").alias("line_no"), "line")


LINES = "(SELECT doc_id, CAST(i AS INTEGER) AS line_no, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL))"


@query(f"SELECT doc_id, line_no, trim(line, ' ') AS content FROM {LINES} WHERE length(trim(line, ' ')) > 0")
def doc_line_blocks(spark, d):
    """Text to ordered line blocks; blank lines give none."""
    return _lines(table(spark, d, "documents")).where(F.length(F.trim("line")) > 0).select("doc_id", "line_no", F.trim("line").alias("content"))


@query("SELECT substr(md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '))), 1, 16) AS fingerprint, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_fingerprint(spark, d):
    """Fingerprints of normalised text shared by several documents."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    flat = F.lower(F.trim(F.regexp_replace("text", r"[\t\n\x0B\f\r ]+", " ")))
    return docs.select("doc_id", F.substring(F.md5(F.encode(flat, "utf-8")), 1, 16).alias("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text")
def exact_dedup_keep_first(spark, d):
    """The first document of each text. Texts are grouped by a digest, so no text is shuffled."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h")).groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\b[0-9]{14}([0-9]{3}[0-9Xx])\\b', 'ID_MASKED(...\\1)', 'g'), '\\b1[3-9][0-9]{5}([0-9]{4})\\b', 'PHONE_MASKED(...\\1)', 'g'), '\\b[0-9]{12,15}([0-9]{4})\\b', 'CARD_MASKED(...\\1)', 'g'),
'\\b[1-9][0-9]{5}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])([0-9]{4})\\b', 'ID_TAIL_MASKED(...\\1)', 'g') AS clean FROM documents""")
def pii_redaction(spark, d):
    """Ordered replacement of personal numbers by LABEL(...last four)."""
    return table(spark, d, "documents").select("doc_id", scalars.redact_pii(F.col("text")).alias("clean"))


@query("SELECT block_id, max(length(content) - length(regexp_replace(content, '[\\x{200b}-\\x{200f}\\x{2060}-\\x{2064}\\x{feff}\\x{ad}]', '', 'g'))) AS invisible, max(regexp_replace(content, '[\\x{200b}-\\x{200f}\\x{2060}-\\x{2064}\\x{feff}\\x{ad}]', '', 'g')) AS clean FROM text_blocks WHERE content IS NOT NULL GROUP BY block_id")
def zero_width_count(spark, d):
    """Invisible characters of each block and the block without them."""
    c = F.regexp_replace("content", r"[\x{200b}-\x{200f}\x{2060}-\x{2064}\x{feff}\x{ad}]", "")
    rows = table(spark, d, "text_blocks").where("content IS NOT NULL").select("block_id", c.alias("clean"), (F.length("content") - F.length(c)).alias("invisible"))
    return rows.groupBy("block_id").agg(F.max("invisible").cast("bigint").alias("invisible"), F.max("clean").alias("clean"))


@query("WITH c AS (SELECT package_id, unnest(string_split(subject_name, '')) AS ch FROM package_files WHERE length(subject_name) > 0), n AS (SELECT package_id, ch, count(*) AS k FROM c GROUP BY 1, 2), t AS (SELECT package_id, k, sum(k) OVER (PARTITION BY package_id) AS n FROM n) SELECT package_id, round(-sum(k / n * log2(k / n)), 6) + 0 AS entropy FROM t GROUP BY 1")
def char_entropy(spark, d):
    """Shannon entropy in bits a character of the subject names of each package."""
    ch = table(spark, d, "package_files").where(F.length("subject_name") > 0).select("package_id", F.explode(F.split("subject_name", "")).alias("ch"))
    n = ch.groupBy("package_id", "ch").agg(F.count("*").alias("k")).withColumn("n", F.sum("k").over(Window.partitionBy("package_id")))
    p = F.col("k") / F.col("n")
    return n.groupBy("package_id").agg((F.round(-F.sum(p * F.log2(p)), 6) + 0).alias("entropy"))


@query("SELECT role, content, count(DISTINCT doc_id) AS docs, count(DISTINCT page_number) AS pages FROM text_blocks WHERE role IN ('header', 'footer') AND length(content) > 0 GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 2")
def repeated_line_noise(spark, d):
    """Headers and footers that recur over documents."""
    b = table(spark, d, "text_blocks").where("role IN ('header', 'footer') AND length(content) > 0")
    return b.groupBy("role", "content").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("page_number").alias("pages")).where("docs >= 2")


@query("""WITH s AS (SELECT DISTINCT result_id, full_text, length(regexp_replace(full_text, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) / greatest(length(full_text), 1) AS share FROM parse_results)
SELECT DISTINCT result_id, CASE WHEN length(trim(coalesce(full_text, ''), ' ')) = 0 THEN 'unknown' WHEN share > 0.3 THEN 'zh' WHEN share > 0.05 THEN 'mixed' ELSE 'en' END AS language FROM s""")
def language_share(spark, d):
    """Language by the share of CJK characters."""
    return table(spark, d, "parse_results").select("result_id", scalars.language_of(F.col("full_text")).alias("language")).distinct()


@query("SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, substr(text, i * 900 + 1, 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 100) / 900.0) AS BIGINT)))) AS i FROM documents WHERE length(text) > 0)")
def chunk_windows(spark, d):
    """Fixed windows of 1,000 characters with 100 of overlap."""
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - 100) / F.lit(900.0)).cast("int"))
    c = table(spark, d, "documents").where("length(text) > 0").select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return c.select("doc_id", "chunk_no", F.substring(F.col("text"), F.col("chunk_no") * 900 + 1, F.lit(1000)).alias("chunk"))


@query("SELECT block_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, reading_order, block_id, received_at) - 1 AS position FROM text_blocks WHERE doc_id IS NOT NULL")
def global_reading_order(spark, d):
    """Total order of a document's blocks over its pages, from 0."""
    w = Window.partitionBy("doc_id").orderBy("page_number", "reading_order", "block_id", "received_at")
    return table(spark, d, "text_blocks").where("doc_id IS NOT NULL").select("block_id", "doc_id", (F.row_number().over(w) - 1).cast("bigint").alias("position"))


@query("WITH o AS (SELECT doc_id, page_number, reading_order, lag(reading_order) OVER (PARTITION BY doc_id, page_number ORDER BY block_id, received_at) AS p FROM text_blocks WHERE doc_id IS NOT NULL) SELECT doc_id, count(*) AS blocks, CAST(sum(CASE WHEN reading_order < p THEN 1 ELSE 0 END) AS BIGINT) AS inversions FROM o GROUP BY 1")
def reading_order_score(spark, d):
    """Inversions of adjacent reading orders per document."""
    w = Window.partitionBy("doc_id", "page_number").orderBy("block_id", "received_at")
    rows = table(spark, d, "text_blocks").where("doc_id IS NOT NULL").select("doc_id", "reading_order", F.lag("reading_order").over(w).alias("p"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum((F.col("reading_order") < F.col("p")).cast("bigint")).alias("s")).select("doc_id", "blocks", F.coalesce("s", F.lit(0)).cast("bigint").alias("inversions"))


@query("WITH b AS (SELECT block_id, doc_id, level, content, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, reading_order, block_id, received_at) AS n FROM text_blocks WHERE doc_id IS NOT NULL) SELECT block_id, doc_id, n, last_value(CASE WHEN level = 'h2' THEN block_id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading_id FROM b")
def nearest_heading(spark, d):
    """As-of join in one pass: each block's nearest heading at or before it."""
    w = Window.partitionBy("doc_id").orderBy("page_number", "reading_order", "block_id", "received_at")
    b = table(spark, d, "text_blocks").where("doc_id IS NOT NULL").select("block_id", "doc_id", "level", F.row_number().over(w).cast("bigint").alias("n"))
    return b.select("block_id", "doc_id", "n", F.last(F.when(F.col("level") == "h2", F.col("block_id")), True).over(Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)).alias("heading_id"))


@query(f"SELECT doc_id, key, value, line_no FROM (SELECT doc_id, line_no, trim(regexp_extract(line, '^([^:]{{2,30}}): (.+)$', 1), ' ') AS key, trim(regexp_extract(line, '^([^:]{{2,30}}): (.+)$', 2), ' ') AS value FROM {LINES} WHERE regexp_matches(line, '^([^:]{{2,30}}): (.+)$')) QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY line_no) = 1")
def key_value_recovery(spark, d):
    """`label: value` lines; the first of a key wins."""
    form = r"^([^:]{2,30}): (.+)$"
    rows = _lines(table(spark, d, "documents")).where(F.col("line").rlike(form)).select("doc_id", "line_no", F.trim(F.regexp_extract("line", form, 1)).alias("key"), F.trim(F.regexp_extract("line", form, 2)).alias("value"))
    return rows.groupBy("doc_id", "key").agg(F.min(F.struct("line_no", "value")).alias("b")).select("doc_id", "key", "b.value", "b.line_no")


@query("SELECT doc_id, field_key, arg_max(value, (coalesce(page_start, -1), cell_id, ingested_at)) AS value FROM audit_cells WHERE doc_id IS NOT NULL AND value IS NOT NULL AND length(field_key) > 0 GROUP BY 1, 2")
def all_key_values(spark, d):
    """Key/values of a document; of several values of a key the last by page and place wins, keys without a name are left out."""
    c = table(spark, d, "audit_cells").where("doc_id IS NOT NULL AND value IS NOT NULL AND length(field_key) > 0")
    return c.groupBy("doc_id", "field_key").agg(F.max_by("value", F.struct(F.coalesce("page_start", F.lit(-1)).alias("p"), "cell_id", "ingested_at")).alias("value"))


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS balance FROM orders")
def running_balance(spark, d):
    """Running balance of each account's ledger."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("balance"))


# a statement: each customer's orders in the order of their keys, with the balance as it stood on their dates, so that some rows don't follow from the one before
STATEMENT = "(SELECT o_custkey, o_orderkey, o_totalprice AS amount, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS balance FROM orders)"
SOLVED = f"(SELECT *, CASE WHEN prev IS NULL THEN CASE WHEN balance - amount >= -0.01 THEN 'income' ELSE 'expense' END WHEN abs(round(balance - prev, 2) - amount) <= 0.01 THEN 'income' WHEN abs(round(balance - prev, 2) + amount) <= 0.01 THEN 'expense' ELSE '' END AS direction FROM (SELECT *, lag(balance) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM {STATEMENT}))"


def _solved(spark, d):
    dates = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("amount"), F.round(F.sum("o_totalprice").over(dates), 2).alias("balance"))
    return ledgers.directed(rows, ["o_custkey"], "o_orderkey", "amount", "balance")


@query(f"SELECT o_custkey, o_orderkey, amount, balance, direction FROM {SOLVED}")
def ledger_directions(spark, d):
    """The direction of each row of a statement, from the change of its balance; the first row's from whether its opening balance would be negative."""
    return _solved(spark, d).select("o_custkey", "o_orderkey", "amount", "balance", "direction")


@query(f"SELECT o_custkey, count(*) AS entries, count_if(prev IS NOT NULL AND abs(round(CASE WHEN direction = 'income' THEN prev + amount ELSE prev - amount END - balance, 2)) > 0.01) AS breaks FROM {SOLVED} GROUP BY 1")
def running_balance_breaks(spark, d):
    """Rows of each statement whose balance doesn't follow from the one before and their own amount."""
    return _solved(spark, d).groupBy("o_custkey").agg(F.count("*").alias("entries"), F.count_if(ledgers.broken("amount", "balance", "direction", "prev")).alias("breaks"))


@query("SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'expense' ELSE 'income' END AS direction, count(*) AS entries, round(sum(l_extendedprice), 2) AS total, round(avg(l_extendedprice), 2) AS mean, max(l_extendedprice) AS largest, min(l_shipdate) AS period_from, max(l_shipdate) AS period_to FROM lineitem GROUP BY 1, 2")
def ledger_summary(spark, d):
    """Totals, mean, largest entry and period per account and direction."""
    li = table(spark, d, "lineitem")
    side = F.when(F.col("l_returnflag") == "R", "expense").otherwise("income").alias("direction")
    p = "l_extendedprice"
    return li.groupBy("l_suppkey", side).agg(F.count("*").alias("entries"), F.round(F.sum(p), 2).alias("total"), F.round(F.avg(p), 2).alias("mean"), F.max(p).alias("largest"), F.min("l_shipdate").alias("period_from"), F.max("l_shipdate").alias("period_to"))


@query("SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2) AS debit, round(sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE 0 END), 2) AS credit FROM lineitem GROUP BY 1")
def debit_credit_split(spark, d):
    """Amounts to debit and credit columns."""
    p, r = F.col("l_extendedprice"), F.col("l_returnflag") == "R"
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.when(r, p).otherwise(0.0)), 2).alias("debit"), F.round(F.sum(F.when(~r, p).otherwise(0.0)), 2).alias("credit"))


@query("WITH l AS (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS t FROM lineitem GROUP BY 1) SELECT o_orderkey, coalesce(n, 0) AS lines, abs(o_totalprice - coalesce(t, 0)) <= 1 AS totals_agree FROM orders LEFT JOIN l ON o_orderkey = l_orderkey")
def reconciliation_gates(spark, d):
    """Order totals held against their lines, pre-aggregated before the join."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum(F.expr("l_extendedprice * (1 - l_discount) * (1 + l_tax)")).alias("t"))
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(l, "o_orderkey", "left")
    return o.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("lines"), (F.abs(F.col("o_totalprice") - F.coalesce("t", F.lit(0.0))) <= 1).alias("totals_agree"))


# Types of values by form, in the order in which they are tried.
_TYPE = [("datetime", r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}\s+\d{1,2}:\d{2}"), ("date", r"^\d{4}[-/年]\d{1,2}[-/月]\d{1,2}[日]?$"), ("time", r"^\d{1,2}:\d{2}(:\d{2})?$"), ("percentage", r"^\d+\.?\d*%$"), ("phone", r"^1[3-9]\d{9}$"), ("email", r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), ("id_number", r"^\d{17}[\dXx]$"), ("account", r"^\d{15,19}$"), ("amount", r"^[-+]?[¥￥$€£]?[\d,]+\.?\d{0,2}$")]
_TYPE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(v, '{p}') THEN '{t}'" for t, p in _TYPE) + " ELSE 'text' END"


@query(f"WITH v AS (SELECT field_key, {_TYPE_SQL} AS t, count(*) AS n FROM (SELECT cell_id, field_key, trim(value, ' ') AS v FROM audit_cells WHERE value NOT IN ('-', '—')) WHERE v <> '' GROUP BY 1, 2), s AS (SELECT field_key, t, n / sum(n) OVER (PARTITION BY field_key) AS share FROM v) SELECT field_key, CASE WHEN share >= 0.6 THEN t ELSE 'text' END AS column_type, round(share, 6) AS share FROM s QUALIFY row_number() OVER (PARTITION BY field_key ORDER BY share DESC, t) = 1")
def type_vote(spark, d):
    """Column type by the vote of its values, each counting for the first form it has; below 60 % it is text. All values vote, not a sample."""
    v = F.col("v")
    t = F.lit("text")
    for name, p in reversed(_TYPE):
        t = F.when(v.rlike(p), name).otherwise(t)
    c = table(spark, d, "audit_cells").where("value NOT IN ('-', '—')").select("field_key", F.trim("value").alias("v")).where("v <> ''")
    n = c.groupBy("field_key", t.alias("t")).agg(F.count("*").alias("n"))
    share = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("field_key")))
    best = share.groupBy("field_key").agg(F.min(F.struct((-F.col("share")).alias("m"), "t")).alias("b"))
    return best.select("field_key", F.when(-F.col("b.m") >= 0.6, F.col("b.t")).otherwise("text").alias("column_type"), F.round(-F.col("b.m"), 6).alias("share"))


@query("SELECT event_type, user_id % 5 AS bucket, count(*) AS n, round(avg(CASE WHEN value > 0 THEN value END), 6) AS mean FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 5), ())")
def bucket_metrics(spark, d):
    """Metrics by single dimensions and in total; zero scores don't count for means."""
    e = table(spark, d, "events").withColumn("bucket", F.expr("user_id % 5"))
    g = e.groupingSets([["event_type"], ["bucket"], []], "event_type", "bucket")
    return g.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("value") > 0, F.col("value"))), 6).alias("mean"))


@query("WITH f AS (SELECT DISTINCT field_id, name, needs_review, confidence FROM trust_fields) SELECT name, count(*) AS fields, count_if(needs_review) AS flagged, count_if(confidence < 0.6) AS low, count_if(needs_review AND confidence < 0.6) AS both, round(count_if(needs_review AND confidence < 0.6) / nullif(count_if(confidence < 0.6), 0), 6) AS recall FROM f GROUP BY 1")
def review_recall(spark, d):
    """How many of the fields of low confidence are marked for review."""
    f = table(spark, d, "trust_fields").select("field_id", "name", "needs_review", "confidence").distinct()
    low, both = F.count_if(F.col("confidence") < 0.6), F.count_if(F.col("needs_review") & (F.col("confidence") < 0.6))
    return f.groupBy("name").agg(F.count("*").alias("fields"), F.count_if("needs_review").alias("flagged"), low.alias("low"), both.alias("both"), F.round(both / F.nullif(low, F.lit(0)), 6).alias("recall"))


@query("""WITH p AS (SELECT package_id, count(DISTINCT file_id) AS files, count(DISTINCT CASE WHEN length(subject_name) > 0 THEN file_id END) AS named, count(DISTINCT CASE WHEN length(subject_name) > 0 THEN subject_name END) AS names, count(DISTINCT CASE WHEN length(id_number) > 0 THEN file_id END) AS identified, count(DISTINCT CASE WHEN length(id_number) > 0 THEN id_number END) AS ids, count(DISTINCT document_type) AS types, count(DISTINCT CASE WHEN document_type IS NOT NULL THEN file_id END) AS typed FROM package_files GROUP BY 1)
SELECT package_id, files, CASE WHEN named < 2 THEN 'not_checked' WHEN names > 1 THEN 'warning' ELSE 'pass' END AS subject, CASE WHEN identified < 2 THEN 'not_checked' WHEN ids > 1 THEN 'warning' ELSE 'pass' END AS identity, typed > types AS repeated_types FROM p""")
def package_consistency(spark, d):
    """Whether the files of a package agree on subject and identity, where at least two state them, and whether a type occurs twice."""
    stated = lambda c, of: F.count_distinct(F.when(F.length(c) > 0, F.col(of)))
    p = table(spark, d, "package_files").groupBy("package_id").agg(F.count_distinct("file_id").alias("files"), stated("subject_name", "file_id").alias("named"), stated("subject_name", "subject_name").alias("names"), stated("id_number", "file_id").alias("identified"), stated("id_number", "id_number").alias("ids"), F.count_distinct("document_type").alias("types"), F.count_distinct(F.when(F.col("document_type").isNotNull(), F.col("file_id"))).alias("typed"))
    verdict = lambda n, k: F.when(F.col(n) < 2, "not_checked").when(F.col(k) > 1, "warning").otherwise("pass")
    return p.select("package_id", "files", verdict("named", "names").alias("subject"), verdict("identified", "ids").alias("identity"), (F.col("typed") > F.col("types")).alias("repeated_types"))


@query(f"""WITH j AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY received_at, artifact_id) AS n, CASE WHEN (p -> '$.mirror') IS NULL AND (p -> '$.datasets') IS NULL AND json_type(p -> '$.result') = 'OBJECT' THEN (p -> '$.result') ELSE p END AS p
  FROM (SELECT document_id, received_at, artifact_id, payload::JSON AS p FROM mirror_artifacts WHERE json_valid(payload) AND json_type(payload) = 'OBJECT' AND document_id IS NOT NULL)),
g AS (SELECT document_id, n, {_opened("(p -> '$.mirror.graph.nodes')")} AS nodes, {_opened("(p -> '$.mirror.graph.edges')")} AS edges FROM j),
e AS (SELECT document_id, n, 'node' AS part, coalesce(e.v ->> '$.id', e.k) AS a, '' AS b, e.v ->> '$.kind' AS kind FROM (SELECT document_id, n, {_elements("nodes", "id", "kind")} AS e FROM g)
  UNION SELECT document_id, n, 'edge', coalesce(e.v ->> '$.from', ''), coalesce(e.v ->> '$.to', ''), NULL FROM (SELECT document_id, n, {_elements("edges", "from", "to")} AS e FROM g)),
pairs AS (SELECT x.document_id, x.n FROM j x JOIN j y ON x.document_id = y.document_id AND y.n = x.n + 1),
v AS (SELECT e.* FROM e JOIN pairs USING (document_id, n)), w AS (SELECT e.document_id, e.n - 1 AS n, part, a, b, kind FROM e JOIN pairs p ON p.document_id = e.document_id AND p.n = e.n - 1)
SELECT CASE WHEN v.part IS NULL THEN w.part || '_added' WHEN w.part IS NULL THEN v.part || '_removed' WHEN v.kind IS DISTINCT FROM w.kind THEN 'node_changed' ELSE v.part || '_same' END AS change, count(*) AS n
FROM v FULL JOIN w ON v.document_id = w.document_id AND v.n = w.n AND v.part = w.part AND v.a = w.a AND v.b = w.b GROUP BY 1
UNION ALL SELECT 'quality_decision_same', count(*) FROM pairs HAVING count(*) > 0""")
def graph_diff(spark, d):
    """Changes between the graphs of each readable delivery of a document and the one before it: nodes by id and field, edges by their ends, and
    the quality decision, with what stayed the same. A document delivered once has nothing to be compared with."""
    rows = table(spark, d, "mirror_artifacts").where("document_id IS NOT NULL").withColumn("tie", F.xxhash64("payload"))
    by_doc = Window.partitionBy("document_id")
    g = nested.graph_elements(rows, "document_id", "received_at", "artifact_id", "tie")
    g = g.withColumns({"n": F.row_number().over(by_doc.orderBy("received_at", "artifact_id", "tie")), "of": F.count("*").over(by_doc)}).where("of > 1")
    sides = F.expr("explode(filter(array(named_struct('pair', n, 'base', true), named_struct('pair', n - 1, 'base', false)), s -> s.pair BETWEEN 1 AND of - 1))")
    e = g.select("document_id", "elements", sides.alias("side")).select("document_id", "side.*", F.inline("elements"))
    last = lambda here: F.max(F.when(here, F.struct("idx", "fields")))
    j = e.groupBy("document_id", "pair", "part", "a", "b").agg(last(F.col("base")).alias("v"), last(~F.col("base")).alias("w"))
    named = {"confidence": "confidence_changed", "bbox": "bbox_changed", "value_preview": "field_value_changed", "raw_preview": "field_value_changed", "review": "review_changed"}
    kinds = F.array(*[F.lit(named.get(f, "node_changed")) for f in nested.NODE_FIELDS])
    differ = F.zip_with(F.col("v.fields"), F.col("w.fields"), lambda x, y: ~x.eqNullSafe(y))
    of_part = lambda x: F.concat("part", F.lit(x))
    changed = F.when(F.col("part") == "node", F.filter(F.zip_with(differ, kinds, lambda x, k: F.when(x, k)), lambda k: k.isNotNull())).otherwise(F.array(of_part("_changed")))
    changes = F.when(F.col("v").isNull(), F.array(of_part("_added"))).when(F.col("w").isNull(), F.array(of_part("_removed"))).when(F.exists(differ, lambda x: x), changed).otherwise(F.array(of_part("_same")))
    return j.select(F.explode(changes).alias("change")).groupBy("change").agg(F.count("*").alias("n"))


@query("UNPIVOT (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_orderpriority FROM orders) ON o_custkey, o_orderstatus, o_orderpriority INTO NAME field VALUE value")
def audit_unpivot(spark, d):
    """Long audit rows (record, field, value) of a wide table."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus", "o_orderpriority")
    return o.unpivot("o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"], "field", "value").where("value IS NOT NULL")


@query("WITH c AS (SELECT DISTINCT cell_id, coalesce(value, '') AS value, coalesce(value_type, 'string') IN ('string', 'text', 'enum', 'date', 'datetime') AND regexp_matches(coalesce(value, ''), '^[=+\\-@]') AS escaped FROM audit_cells) SELECT cell_id, CASE WHEN escaped THEN chr(39) || value ELSE value END AS safe, escaped FROM c")
def csv_safe_cells(spark, d):
    """Cells as they go into a spreadsheet: textual ones that begin like a formula are escaped, and marked so; null as an empty text."""
    v = F.coalesce("value", F.lit(""))
    escaped = F.coalesce("value_type", F.lit("string")).isin("string", "text", "enum", "date", "datetime") & v.rlike(r"^[=+\-@]")
    c = table(spark, d, "audit_cells").select("cell_id", v.alias("v"), escaped.alias("escaped")).distinct()
    return c.select("cell_id", F.when(F.col("escaped"), F.concat(F.lit("'"), "v")).otherwise(F.col("v")).alias("safe"), "escaped")


@query("""WITH r AS (SELECT dataset_id, record_id, max(CASE WHEN length(trim(value, ' ')) > 0 THEN 1 ELSE 0 END) AS filled FROM audit_cells GROUP BY 1, 2)
SELECT dataset_id, count(*) AS expected_row_count, CAST(sum(filled) AS BIGINT) AS emitted_row_count, CAST(count(*) - sum(filled) AS BIGINT) AS omitted_row_count, sum(filled) = count(*) AS verified FROM r GROUP BY 1""")
def dataset_completeness(spark, d):
    """Records that a dataset's cells mark, against those of them that come out with any value."""
    filled = F.max((F.length(F.trim("value")) > 0).cast("int"))
    r = table(spark, d, "audit_cells").groupBy("dataset_id", "record_id").agg(F.coalesce(filled, F.lit(0)).alias("filled"))
    n, k = F.count("*"), F.sum("filled")
    return r.groupBy("dataset_id").agg(n.alias("expected_row_count"), k.alias("emitted_row_count"), (n - k).alias("omitted_row_count"), (n == k).alias("verified"))


_COLUMN_TYPE = "CASE WHEN regexp_matches(lower({v}), '^(?:true|false)$') THEN 'boolean' WHEN regexp_matches({v}, '^[+-]?[0-9]+$') THEN 'integer' WHEN regexp_matches({v}, '^[+-]?[0-9]*\\.[0-9]+$') THEN 'decimal' WHEN length({v}) > 200 THEN 'text' ELSE 'string' END"


@query(f"""WITH n AS (SELECT dataset_id, count(DISTINCT record_id) AS records FROM audit_cells GROUP BY 1), c AS (SELECT dataset_id, field_key, arg_min(value, (cell_id, ingested_at)) FILTER (WHERE length(value) > 0) AS v, count(DISTINCT CASE WHEN length(value) > 0 THEN record_id END) AS present, bool_or(coalesce(length(raw) > 0, false)) AS raw_available, bool_or(evidence_ref IS NOT NULL) AS evidence_available, min(page_start) AS page_from, max(page_end) AS page_to FROM audit_cells GROUP BY 1, 2)
SELECT dataset_id, field_key, replace(field_key, '_', ' ') AS label, {_COLUMN_TYPE.format(v="coalesce(v, '')")} AS type, present < records AS nullable, raw_available, evidence_available, page_from, page_to FROM c JOIN n USING (dataset_id)""")
def dataset_columns(spark, d):
    """Columns of a dataset: label, the type of the first value that isn't blank, whether any record lacks it, whether raw texts and evidence are there, and
    its pages."""
    c = table(spark, d, "audit_cells")
    n = c.groupBy("dataset_id").agg(F.count_distinct("record_id").alias("records"))
    full = F.length("value") > 0
    k = c.groupBy("dataset_id", "field_key").agg(
        F.min_by("value", F.when(full, F.struct("cell_id", "ingested_at"))).alias("v"), F.count_distinct(F.when(full, F.col("record_id"))).alias("present"), F.bool_or(F.coalesce(F.length("raw") > 0, F.lit(False))).alias("raw_available"),
        F.bool_or(F.col("evidence_ref").isNotNull()).alias("evidence_available"), F.min("page_start").alias("page_from"), F.max("page_end").alias("page_to"),
    )
    v = F.coalesce("v", F.lit(""))
    kind = F.when(F.lower(v).rlike("^(?:true|false)$"), "boolean").when(v.rlike("^[+-]?[0-9]+$"), "integer").when(v.rlike(r"^[+-]?[0-9]*\.[0-9]+$"), "decimal").when(F.length(v) > 200, "text").otherwise("string")
    return k.join(n, "dataset_id").select("dataset_id", "field_key", F.translate("field_key", "_", " ").alias("label"), kind.alias("type"), (F.col("present") < F.col("records")).alias("nullable"), "raw_available", "evidence_available", "page_from", "page_to")


@query("SELECT DISTINCT dataset_id, record_id, format('{}:r{:06d}', dataset_id, dense_rank() OVER (PARTITION BY dataset_id ORDER BY record_id)) AS canonical_id FROM audit_cells")
def canonical_record_id(spark, d):
    """Canonical ids numbered within each dataset, by range parts, so that a dataset that holds most records isn't ordered in one task."""
    r = numbered(table(spark, d, "audit_cells").select("dataset_id", "record_id").distinct(), ["dataset_id"], ["record_id"])
    return r.select("dataset_id", "record_id", F.format_string("%s:r%06d", "dataset_id", "row_no").alias("canonical_id"))


@query("SELECT doc_id, string_agg(CASE WHEN level = 'h2' THEN '## ' || content ELSE content END, chr(10) || chr(10) ORDER BY page_number, reading_order, block_id) AS markdown FROM (SELECT DISTINCT block_id, doc_id, page_number, reading_order, level, content FROM text_blocks) WHERE doc_id IS NOT NULL AND length(content) > 0 GROUP BY 1")
def render_markdown(spark, d):
    """Blocks of a document as Markdown in reading order."""
    b = table(spark, d, "text_blocks").select("block_id", "doc_id", "page_number", "reading_order", "level", "content").distinct().where("doc_id IS NOT NULL AND length(content) > 0")
    line = F.when(F.col("level") == "h2", F.concat(F.lit("## "), "content")).otherwise(F.col("content"))
    parts = F.array_sort(F.collect_list(F.struct("page_number", "reading_order", "block_id", line.alias("t"))))
    return b.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("markdown"))


@query("SELECT DISTINCT file_id, CASE WHEN length(account_number) <= 8 THEN repeat('*', length(account_number)) ELSE repeat('*', length(account_number) - 4) || substr(account_number, -4) END AS masked, substr(sha256(account_number), 1, 16) AS hashed FROM package_files WHERE account_number IS NOT NULL")
def mask_and_hash(spark, d):
    """Masked and hashed account numbers."""
    a = F.col("account_number")
    return table(spark, d, "package_files").where(a.isNotNull()).select("file_id", scalars.mask_value(a).alias("masked"), scalars.hash_value(a).alias("hashed")).distinct()


@query("SELECT DISTINCT block_id, doc_id, regexp_matches(lower(content), 'e-mail|email|@') AS contact, regexp_matches(content, '[0-9]{9,}') AS number, regexp_matches(content, '\\*{2,}|REDACTED') AS masked FROM text_blocks WHERE content IS NOT NULL")
def classify_redaction(spark, d):
    """What kinds of sensitive or masked parts a block shows."""
    c = F.col("content")
    return table(spark, d, "text_blocks").where(c.isNotNull()).select("block_id", "doc_id", F.lower(c).rlike("e-mail|email|@").alias("contact"), c.rlike("[0-9]{9,}").alias("number"), c.rlike(r"\*{2,}|REDACTED").alias("masked")).distinct()


_BLANKS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _distinct_chars(c: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.regexp_replace(c, _BLANKS, ""), "")), lambda x: x != "")


def _chars_sql(c: str) -> str:
    return f"list_filter(list_distinct(string_split(regexp_replace({c}, '{_BLANKS}', '', 'g'), '')), lambda x: x <> '')"


@query(f"""WITH r AS (SELECT result_id, arg_max(doc_id, parsed_at) AS doc_id, arg_max(coalesce(full_text, ''), parsed_at) AS t FROM parse_results WHERE doc_id IS NOT NULL GROUP BY 1)
SELECT doc_id, result_id, len({_chars_sql("text")}) / 1.0 AS distinct_chars, CASE WHEN t IS NULL THEN NULL WHEN len({_chars_sql("text")}) = 0 THEN 1.0 ELSE round(len(list_intersect({_chars_sql("text")}, {_chars_sql("t")})) / len({_chars_sql("text")}), 6) END AS preserved,
length(text) = n_chars AS length_ok FROM documents LEFT JOIN r USING (doc_id) WHERE text IS NOT NULL""")
def char_preservation(spark, d):
    """Share of a document's distinct characters that the text of each of its parse results keeps, blanks aside, and whether the stated length
    holds. Whole texts are read; each is cut down to its distinct characters before anything is shuffled."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", _distinct_chars(F.col("text")).alias("chars"), (F.length("text") == F.col("n_chars")).alias("length_ok"))
    found = table(spark, d, "parse_results").where("doc_id IS NOT NULL").select("result_id", "parsed_at", "doc_id", _distinct_chars(F.coalesce("full_text", F.lit(""))).alias("found"))
    j = docs.join(latest(found, "result_id", "parsed_at", "doc_id", "found"), "doc_id", "left")
    n, kept = F.size("chars"), F.size(F.array_intersect("chars", "found"))
    rate = F.when(F.col("found").isNull(), None).when(n == 0, 1.0).otherwise(F.round(kept / n, 6))
    return j.select("doc_id", "result_id", n.cast("double").alias("distinct_chars"), rate.alias("preserved"), "length_ok")


@query("SELECT DISTINCT result_id, page_count, len(pages) AS pages, count_content AS filled, CASE WHEN page_count <= 1 THEN 1.0 ELSE round(count_content / page_count, 6) END AS coverage FROM (SELECT result_id, page_count, pages, len([p FOR p IN pages IF length(p.page_text) > 0]) AS count_content FROM parse_results WHERE pages IS NOT NULL AND page_count > 0)")
def page_coverage(spark, d):
    """Share of pages with content; 1 for up to one page."""
    r = table(spark, d, "parse_results").where("pages IS NOT NULL AND page_count > 0").select("result_id", "page_count", F.size("pages").cast("bigint").alias("pages"), F.size(F.filter("pages", lambda p: F.length(p["page_text"]) > 0)).cast("bigint").alias("filled"))
    return r.withColumn("coverage", F.when(F.col("page_count") <= 1, 1.0).otherwise(F.round(F.col("filled") / F.col("page_count"), 6))).distinct()


@query("WITH c AS (SELECT DISTINCT cell_id, record_id, field_key, page_start, bbox FROM audit_cells WHERE len(bbox) = 4) SELECT page_start AS page, count(*) AS boxes, round(min(bbox[1]), 3) AS x0, round(min(bbox[2]), 3) AS y0, round(max(bbox[3]), 3) AS x1, round(max(bbox[4]), 3) AS y1 FROM c WHERE bbox[3] > bbox[1] AND bbox[4] > bbox[2] GROUP BY 1")
def bounding_union(spark, d):
    """Bounding union of the boxes of positive area on each page."""
    c = table(spark, d, "audit_cells").where("size(bbox) = 4").select("cell_id", "record_id", "field_key", "page_start", "bbox").distinct().where("bbox[2] > bbox[0] AND bbox[3] > bbox[1]")
    return c.groupBy(F.col("page_start").alias("page")).agg(F.count("*").alias("boxes"), *[F.round(f(F.expr(f"bbox[{i}]")), 3).alias(n) for i, (n, f) in enumerate((("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max)))])


@query("SELECT user_id, event_id, count_if(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_no FROM (SELECT user_id, event_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE, true) AS gap FROM events)")
def event_sessions(spark, d):
    """Sessions of each user, parted by more than 30 minutes: gaps and islands."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.coalesce(F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 30 MINUTES"), F.lit(True)).alias("gap"))
    return e.select("user_id", "event_id", F.sum(F.col("gap").cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("session_no"))


@query("SELECT event_type, CASE WHEN count_if(value > 0) = 0 THEN 'failed' WHEN count_if(value <= 0) > 0 THEN 'partial' ELSE 'success' END AS status, count(*) AS n FROM events GROUP BY 1")
def outcome_ledger(spark, d):
    """Outcome by precedence: nothing succeeded, some failed, all succeeded."""
    ok, bad = F.count_if(F.col("value") > 0), F.count_if(F.col("value") <= 0)
    return table(spark, d, "events").groupBy("event_type").agg(F.when(ok == 0, "failed").when(bad > 0, "partial").otherwise("success").alias("status"), F.count("*").alias("n"))


@query("SELECT n_name, r_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(DISTINCT s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey")
def registry_lookup(spark, d):
    """Dictionary lookups as joins; side tables are broadcast only after their size is checked."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count_distinct("s_suppkey").alias("suppliers"))
    j = n.join(guarded_broadcast(r), n["n_regionkey"] == r["r_regionkey"]).join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    return j.select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("WITH f AS (SELECT DISTINCT field_id, artifact_key, name, confidence, source_ref, bbox, page FROM trust_fields) SELECT artifact_key, count(*) AS fields, count_if(source_ref IS NOT NULL OR bbox IS NOT NULL OR page IS NOT NULL) AS evidenced, round(count_if(source_ref IS NOT NULL OR bbox IS NOT NULL OR page IS NOT NULL) / count(*), 4) AS coverage, CASE WHEN min(confidence) < 0.5 THEN 'reject' WHEN min(confidence) < 0.85 THEN 'needs_review' ELSE 'auto_ingest' END AS decision FROM f GROUP BY 1")
def evidence_coverage(spark, d):
    """Evidence coverage and the ordered quality decision of each artifact."""
    f = table(spark, d, "trust_fields").select("field_id", "artifact_key", "name", "confidence", "source_ref", "bbox", "page").distinct()
    has = F.count_if(F.expr("source_ref IS NOT NULL OR bbox IS NOT NULL OR page IS NOT NULL"))
    low = F.min("confidence")
    return f.groupBy("artifact_key").agg(F.count("*").alias("fields"), has.alias("evidenced"), F.round(has / F.count("*"), 4).alias("coverage"), F.when(low < 0.5, "reject").when(low < 0.85, "needs_review").otherwise("auto_ingest").alias("decision"))


_OLD = "CASE WHEN old IS NULL THEN 'missing' WHEN trim(old, ' ') = '' THEN 'blank' WHEN regexp_matches(old, '^[0-9.,+-]+$') THEN 'number' ELSE 'text' END"


@query(f"WITH m AS (SELECT field_key, value, confidence, lag(value) OVER w AS old, row_number() OVER w AS n FROM audit_cells WINDOW w AS (PARTITION BY cell_id ORDER BY ingested_at)) SELECT field_key, {_OLD} AS old_class, count(*) AS members, count(confidence) AS rated, round(avg(confidence), 6) AS confidence FROM m WHERE n > 1 GROUP BY 1, 2 HAVING count(*) >= 2")
def mutation_patterns(spark, d):
    """Patterns of later deliveries of cells: their field and the class of the value before, with at least two members, and their mean confidence."""
    w = Window.partitionBy("cell_id").orderBy("ingested_at")
    m = table(spark, d, "audit_cells").select("field_key", "confidence", F.lag("value").over(w).alias("old"), F.row_number().over(w).alias("n")).where("n > 1")
    kind = F.when(F.col("old").isNull(), "missing").when(F.trim("old") == "", "blank").when(F.col("old").rlike("^[0-9.,+-]+$"), "number").otherwise("text")
    return m.groupBy("field_key", kind.alias("old_class")).agg(F.count("*").alias("members"), F.count("confidence").alias("rated"), F.round(F.avg("confidence"), 6).alias("confidence")).where("members >= 2")


@query("SELECT DISTINCT cell_id, CASE WHEN length(regexp_replace(regexp_replace(lower(value), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) > 0 THEN regexp_replace(regexp_replace(lower(value), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') ELSE substr(sha1(value), 1, 10) END AS slug FROM audit_cells WHERE field_key = 'party_name' AND value IS NOT NULL")
def party_slugs(spark, d):
    """ASCII slugs of party names."""
    return table(spark, d, "audit_cells").where("field_key = 'party_name' AND value IS NOT NULL").select("cell_id", scalars.slug(F.col("value")).alias("slug")).distinct()
