"""Queries on evidence: atoms and their owners, tokens in grids, candidates and votes, graphs and their integrity, verification, decisions, safety."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import safety, scalars
from factloom.io import table
from factloom.operators import nested
from factloom.plans.base import Book
from factloom.plans.oracles import P2_ROWS
from factloom.plans.pages import B, _blocks
from factloom.plans.tabular import T, _tables

query = Book()


@query(f"""WITH g AS (SELECT doc_id, page_number, content, min(block_id) AS first, arg_min(bbox, block_id) AS fb FROM {B} WHERE length(trim(content, ' ')) > 0 GROUP BY 1, 2, 3), j AS (SELECT first, block_id, greatest(0, least(fb[3], x1) - greatest(fb[1], x0)) * greatest(0, least(fb[4], y1) - greatest(fb[2], y0)) AS i, (fb[3] - fb[1]) * (fb[4] - fb[2]) + (x1 - x0) * (y1 - y0) AS u FROM {B} b JOIN g USING (doc_id, page_number, content) WHERE block_id <> first)
SELECT first AS preferred, block_id AS same_as, round(CASE WHEN u - i > 0 THEN i / (u - i) ELSE 0 END, 6) AS iou FROM j WHERE i / nullif(u - i, 0) >= 0.7""")
def same_visual_text(spark, d):
    """Blocks that show the same text at the same place of a page as the first of them: each is held against the first, not against one another."""
    b = _blocks(spark, d).where("length(trim(content)) > 0").withColumn("h", F.md5(F.encode("content", "utf-8")))
    g = b.groupBy("doc_id", "page_number", "h").agg(F.min(F.struct("block_id", "bbox")).alias("f"))
    j = b.join(g, ["doc_id", "page_number", "h"]).where("block_id <> f.block_id")
    iou = scalars.iou([F.col("f.bbox")[i] for i in range(4)], [F.col("bbox")[i] for i in range(4)])
    return j.withColumn("v", iou).where("v >= 0.7").select(F.col("f.block_id").alias("preferred"), F.col("block_id").alias("same_as"), F.round("v", 6).alias("iou"))


@query(f"SELECT block_id, format('doc{{}}:p{{:04d}}:text:{{:06d}}', doc_id, page_number, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY reading_order, y0, x0, block_id)) AS atom_id FROM {B}")
def evidence_atoms(spark, d):
    """Deterministic ids of the atoms of a page, in reading order."""
    n = F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("reading_order", "y0", "x0", "block_id"))
    return _blocks(spark, d).select("block_id", F.format_string("doc%d:p%04d:text:%06d", "doc_id", "page_number", n).alias("atom_id"))


@query("""WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)), g AS (SELECT *, sum(CASE WHEN trim(line, ' ') = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS part FROM l)
SELECT doc_id, CAST(part AS BIGINT) AS part, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM g WHERE trim(line, ' ') <> '' GROUP BY 1, 2""")
def native_blocks(spark, d):
    """Lines of a document grouped to blocks by the blank lines between them."""
    lines = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    blank = F.length(F.trim("line")) == 0
    g = lines.withColumn("part", F.sum(blank.cast("bigint")).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).where(~blank)
    parts = F.array_sort(F.collect_list(F.struct("i", "line")))
    return g.groupBy("doc_id", "part").agg(F.count("*").alias("lines"), F.md5(F.encode(F.array_join(F.transform(parts, lambda x: x["line"]), "\n"), "utf-8")).alias("digest"))


@query("SELECT DISTINCT result_id, p.page_number AS page_number FROM (SELECT result_id, doc_id, unnest(pages) AS p FROM parse_results) r WHERE NOT EXISTS (SELECT 1 FROM text_blocks b WHERE b.doc_id = r.doc_id AND b.page_number = r.p.page_number AND length(b.content) > 0)")
def pages_without_atoms(spark, d):
    """Pages of results for which no block with text is there: those that would have to be scanned."""
    p = table(spark, d, "parse_results").select("result_id", "doc_id", F.explode("pages").alias("p")).select("result_id", "doc_id", F.col("p.page_number").alias("page_number"))
    b = table(spark, d, "text_blocks").where("length(content) > 0").select("doc_id", "page_number").distinct()
    return p.join(b, ["doc_id", "page_number"], "left_anti").select("result_id", "page_number").distinct()


@query("WITH r AS (SELECT result_id, arg_max(pages, parsed_at) AS pages FROM parse_results GROUP BY 1), p AS (SELECT result_id, unnest(pages) AS p FROM r), s AS (SELECT result_id, p.page_number AS page, 1 + length(coalesce(p.page_text, '')) // 2000 AS segments FROM p) SELECT result_id, page, segments::INTEGER AS segments, CAST(sum(segments) OVER (PARTITION BY result_id ORDER BY page ROWS UNBOUNDED PRECEDING) - segments + 1 AS BIGINT) AS first_logical FROM s")
def document_plans(spark, d):
    """Logical pages of each result: a source page gives one for each 2,000 characters begun; the first follows from those of the pages before."""
    r = table(spark, d, "parse_results").groupBy("result_id").agg(F.max_by("pages", "parsed_at").alias("pages"))
    s = r.select("result_id", F.inline("pages")).select("result_id", F.col("page_number").alias("page"), (1 + F.floor(F.length(F.coalesce("page_text", F.lit(""))) / 2000)).cast("int").alias("segments"))
    before = F.sum("segments").over(Window.partitionBy("result_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    return s.select("result_id", "page", "segments", (before - F.col("segments") + 1).alias("first_logical"))


_CLASS = "CASE WHEN regexp_matches(regexp_replace(v, '[,，]', '', 'g'), '^[+-]?[0-9]+(?:\\.[0-9]+)?$') THEN 'number' WHEN regexp_matches(v, '[0-9]{4}[-/年][0-9]{1,2}') THEN 'date' WHEN regexp_matches(v, '[\\x{4e00}-\\x{9fff}]') THEN 'cjk_text' WHEN regexp_matches(v, '[A-Za-z]') THEN 'latin_text' ELSE 'symbol' END"
_CLASSES = f"(SELECT field_key, {_CLASS} AS class, count(*) AS n FROM (SELECT DISTINCT cell_id, field_key, trim(value, ' ') AS v FROM audit_cells WHERE length(trim(value, ' ')) > 0) GROUP BY 1, 2)"


def _classes(spark, d):
    c = table(spark, d, "audit_cells").select("cell_id", "field_key", F.trim("value").alias("v")).where("length(v) > 0").distinct()
    v = F.col("v")
    kind = F.when(F.regexp_replace(v, "[,，]", "").rlike(r"^[+-]?\d+(?:\.\d+)?$"), "number").when(v.rlike(r"\d{4}[-/年]\d{1,2}"), "date").when(v.rlike(r"[\x{4e00}-\x{9fff}]"), "cjk_text").when(v.rlike("[A-Za-z]"), "latin_text").otherwise("symbol")
    return c.groupBy("field_key", kind.alias("class")).agg(F.count("*").alias("n"))


@query(f"WITH t AS (SELECT *, sum(n) OVER (PARTITION BY field_key) AS total FROM {_CLASSES}) SELECT field_key, round(least(1, -sum(n / total * log2(n / total)) / log2(greatest(2, count(*)))), 6) + 0 AS entropy, round(max(n / total), 6) AS consistency FROM t GROUP BY 1")
def column_entropy(spark, d):
    """How mixed the classes of a field's values are, and the share of the commonest."""
    t = _classes(spark, d).withColumn("total", F.sum("n").over(Window.partitionBy("field_key")))
    p = F.col("n") / F.col("total")
    return t.groupBy("field_key").agg((F.round(F.least(F.lit(1.0), -F.sum(p * F.log2(p)) / F.log2(F.greatest(F.lit(2), F.count("*")))), 6) + 0).alias("entropy"), F.round(F.max(p), 6).alias("consistency"))


@query(f"WITH b AS (SELECT field_key, arg_max(class, (n, class)) AS type, max(n) AS k, sum(n) AS total FROM {_CLASSES} GROUP BY 1), u AS (SELECT field_key, count(DISTINCT cell_id) AS cells FROM audit_cells GROUP BY 1) SELECT u.field_key, coalesce(type, 'empty') AS type, round(coalesce(k / total, 0), 6) AS confidence, cells - CAST(coalesce(total, 0) AS BIGINT) AS empty FROM u LEFT JOIN b USING (field_key)")
def type_signatures(spark, d):
    """The type of each field by its commonest class, with confidence and the number of cells without a value."""
    b = _classes(spark, d).groupBy("field_key").agg(F.max_by("class", F.struct("n", "class")).alias("type"), F.max("n").alias("k"), F.sum("n").alias("total"))
    u = table(spark, d, "audit_cells").groupBy("field_key").agg(F.count_distinct("cell_id").alias("cells"))
    return u.join(b, "field_key", "left").select("field_key", F.coalesce("type", F.lit("empty")).alias("type"), F.round(F.coalesce(F.col("k") / F.col("total"), F.lit(0.0)), 6).alias("confidence"), (F.col("cells") - F.coalesce("total", F.lit(0))).alias("empty"))


# --- tokens in a grid of three columns of 200 and nine rows of 100 points

_GRID = "(SELECT r AS row_no, c AS col_no, c * 200.0 AS gx0, r * 100.0 AS gy0, c * 200.0 + 200 AS gx1, r * 100.0 + 100 AS gy1 FROM (SELECT unnest(range(9)) AS r), (SELECT unnest(range(3)) AS c))"
_OVER = f"(SELECT block_id, row_no, col_no, greatest(0, least(x1, gx1) - greatest(x0, gx0)) * greatest(0, least(y1, gy1) - greatest(y0, gy0)) / ((x1 - x0) * (y1 - y0)) AS overlap, (x0 + x1) / 2 BETWEEN gx0 AND gx1 AND (y0 + y1) / 2 BETWEEN gy0 AND gy1 AS inside, abs((x0 + x1) / 2 - (gx0 + gx1) / 2) + abs((y0 + y1) / 2 - (gy0 + gy1) / 2) AS distance FROM {B}, {_GRID} WHERE x1 > x0 AND y1 > y0)"


def _over_grid(spark, d):
    """(block_id, cells): each block with every cell of the grid, its overlap with it and their distance; the 27 cells are part of the expression."""
    b = _blocks(spark, d).where("x1 > x0 AND y1 > y0")
    area, cx, cy = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2

    def cell(i):
        r, c = F.floor(i / 3).cast("int"), (i % 3).cast("int")
        gx0, gy0 = c * 200.0, r * 100.0
        over = F.greatest(F.lit(0.0), F.least("x1", gx0 + 200) - F.greatest("x0", gx0)) * F.greatest(F.lit(0.0), F.least("y1", gy0 + 100) - F.greatest("y0", gy0)) / area
        inside = (cx >= gx0) & (cx <= gx0 + 200) & (cy >= gy0) & (cy <= gy0 + 100)
        return F.struct(r.alias("row_no"), c.alias("col_no"), over.alias("overlap"), inside.alias("inside"), (F.abs(cx - gx0 - 100) + F.abs(cy - gy0 - 50)).alias("distance"))

    return b.select("block_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(26)), cell)).alias("g")).select("block_id", "g.*")


@query(f"SELECT block_id, row_no::INTEGER AS row_no, col_no::INTEGER AS col_no, round(overlap, 6) AS overlap FROM {_OVER} WHERE overlap >= 0.2 OR (inside AND overlap > 0) QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY overlap + CASE WHEN inside THEN 0.05 ELSE 0 END DESC, distance, row_no, col_no) = 1")
def tokens_in_cells(spark, d):
    """The one cell of the grid that each block belongs to: most overlap, a bonus for its centre, then the nearest."""
    o = _over_grid(spark, d).where("overlap >= 0.2 OR (inside AND overlap > 0)")
    best = F.min_by(F.struct("row_no", "col_no", "overlap"), F.struct(-(F.col("overlap") + F.when(F.col("inside"), 0.05).otherwise(0.0)), "distance", "row_no", "col_no"))
    return o.groupBy("block_id").agg(best.alias("b")).select("block_id", "b.row_no", "b.col_no", F.round("b.overlap", 6).alias("overlap"))


@query(f"SELECT block_id, row_no::INTEGER AS row_no, col_no::INTEGER AS col_no FROM {_OVER} WHERE overlap >= 0.45 OR (inside AND overlap > 0)")
def tokens_over_cells(spark, d):
    """Every cell of the grid that a block covers with nearly half of itself or with its centre; a block may be in several."""
    return _over_grid(spark, d).where("overlap >= 0.45 OR (inside AND overlap > 0)").select("block_id", "row_no", "col_no")


# --- candidates, votes, sets

_CAND = f"(SELECT block_id, len(t) - 1 AS rows, len([1 FOR r IN t[2:] IF len(r) = len(t[1])]) / greatest(1, len(t) - 1) AS consistent, len([1 FOR c IN t[1] IF length(trim(c, ' ')) BETWEEN 2 AND 30]) / len(t[1]) AS labels FROM {T})"


@query(f"WITH s AS (SELECT block_id, rows, round(0.35 * least(1, rows / 10.0) + 0.25 * consistent + 0.2 * labels + 0.1 * CASE WHEN rows > 1 THEN 1 ELSE 0 END + 0.1, 6) AS score FROM {_CAND}), b AS (SELECT DISTINCT block_id, doc_id FROM text_blocks WHERE doc_id IS NOT NULL) SELECT doc_id, arg_min(block_id, (-score, abs(rows - 5), block_id)) AS block_id, max(score) AS score, count(*) AS candidates FROM s JOIN b USING (block_id) GROUP BY 1")
def best_tables(spark, d):
    """The best candidate of each document's tables: rows, even width, labels and a prior weighted; ties fall to the one nearest to five rows."""
    t = F.col("t")
    df = _tables(spark, d).select("block_id", (F.size(t) - 1).alias("rows"), (F.size(F.filter(F.slice(t, 2, F.size(t)), lambda r: F.size(r) == F.size(t[0]))) / F.greatest(F.lit(1), F.size(t) - 1)).alias("consistent"), (F.size(F.filter(t[0], lambda c: F.length(F.trim(c)).between(2, 30))) / F.size(t[0])).alias("labels"))
    score = F.round(0.35 * F.least(F.lit(1.0), F.col("rows") / 10.0) + 0.25 * F.col("consistent") + 0.2 * F.col("labels") + 0.1 * (F.col("rows") > 1).cast("int") + 0.1, 6)
    b = table(spark, d, "text_blocks").where("doc_id IS NOT NULL").select("block_id", "doc_id").distinct()
    s = df.select("block_id", "rows", score.alias("score")).join(b, "block_id")
    return s.groupBy("doc_id").agg(F.min_by("block_id", F.struct(-F.col("score"), F.abs(F.col("rows") - 5), "block_id")).alias("block_id"), F.max("score").alias("score"), F.count("*").alias("candidates"))


@query("WITH v AS (SELECT record_id, field_key, value, sum(confidence) AS weight, count(*) AS n FROM (SELECT DISTINCT cell_id, record_id, field_key, value, confidence FROM audit_cells WHERE value IS NOT NULL AND confidence IS NOT NULL) GROUP BY 1, 2, 3) SELECT record_id, field_key, arg_min(value, (-round(weight, 6), value)) AS value, round(max(round(weight, 6)) / sum(weight), 4) AS share FROM v GROUP BY 1, 2")
def fused_values(spark, d):
    """The value of each field by the votes of its cells, weighted by confidence; ties fall to the smaller value."""
    c = table(spark, d, "audit_cells").where("value IS NOT NULL AND confidence IS NOT NULL").select("cell_id", "record_id", "field_key", "value", "confidence").distinct()
    v = c.groupBy("record_id", "field_key", "value").agg(F.sum("confidence").alias("w")).withColumn("r", F.round("w", 6))
    return v.groupBy("record_id", "field_key").agg(F.min_by("value", F.struct(-F.col("r"), "value")).alias("value"), F.round(F.max("r") / F.sum("w"), 4).alias("share"))


@query("WITH f AS (SELECT DISTINCT artifact_key, name FROM trust_fields WHERE needs_review), e AS (SELECT DISTINCT artifact_key, name FROM trust_fields WHERE length(source_ref) > 0) SELECT 'both' AS part, count(*) AS n FROM (FROM f INTERSECT FROM e) UNION ALL SELECT 'flagged_only', count(*) FROM (FROM f EXCEPT FROM e) UNION ALL SELECT 'evidenced_only', count(*) FROM (FROM e EXCEPT FROM f)")
def review_sets(spark, d):
    """Fields flagged for review and fields with evidence, as sets: in both, in one only."""
    t = table(spark, d, "trust_fields")
    f, e = t.where("needs_review").select("artifact_key", "name"), t.where("length(source_ref) > 0").select("artifact_key", "name")
    parts = {"both": f.intersect(e), "flagged_only": f.distinct().subtract(e), "evidenced_only": e.distinct().subtract(f)}
    counts = [x.agg(F.lit(n).alias("part"), F.count("*").alias("n")) for n, x in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT cell_id, old, value AS new, ingested_at AS at FROM (SELECT cell_id, value, ingested_at, lag(value) OVER w AS old, row_number() OVER w AS n FROM audit_cells WINDOW w AS (PARTITION BY cell_id ORDER BY ingested_at)) WHERE n > 1 AND value IS DISTINCT FROM old")
def mutation_log(spark, d):
    """Every change of a cell's value by a later delivery."""
    w = Window.partitionBy("cell_id").orderBy("ingested_at")
    v = table(spark, d, "audit_cells").select("cell_id", "value", F.col("ingested_at").alias("at"), F.lag("value").over(w).alias("old"), F.row_number().over(w).alias("n"))
    return v.where("n > 1 AND NOT (value <=> old)").select("cell_id", "old", F.col("value").alias("new"), "at")


@query("SELECT doc_id, CASE WHEN count(*) FILTER (WHERE length(full_text) > 0) = 0 THEN 'failed' WHEN count(*) FILTER (WHERE full_text IS NULL OR full_text = '') > 0 THEN 'partial' WHEN min(confidence) < 0.5 THEN 'degraded' ELSE 'success' END AS status, count(*) AS results FROM parse_results WHERE doc_id IS NOT NULL GROUP BY 1")
def document_outcomes(spark, d):
    """The outcome of each document's results by precedence: failed without any text, partial, degraded, success."""
    r = table(spark, d, "parse_results").where("doc_id IS NOT NULL").groupBy("doc_id")
    good, bad = F.count_if(F.length("full_text") > 0), F.count_if(F.coalesce(F.length("full_text"), F.lit(0)) == 0)
    return r.agg(F.when(good == 0, "failed").when(bad > 0, "partial").when(F.min("confidence") < 0.5, "degraded").otherwise("success").alias("status"), F.count("*").alias("results"))


# --- graphs

_JOINED = f"WITH RECURSIVE {P2_ROWS}"


@query(f"""{_JOINED}, n AS (SELECT artifact_id, id FROM bl UNION SELECT artifact_id, id FROM pg), e AS (SELECT artifact_id, v ->> '$.from' AS f, v ->> '$.to' AS t, v ->> '$.type' AS k FROM ed), au AS (SELECT DISTINCT artifact_id, f, t, k FROM e WHERE f IS NOT NULL AND t IS NOT NULL)
SELECT artifact_id, count(*) AS edges, count_if(f = t) AS self_loops, count_if(k = 'contains' AND NOT EXISTS (SELECT 1 FROM n WHERE n.artifact_id = au.artifact_id AND n.id = au.t)) AS unknown_ends FROM au GROUP BY 1""")
def edge_integrity(spark, d):
    """Of each artifact's distinct edges, those from an element to itself and those that contain an element that isn't on any page."""
    p = nested.parsed(table(spark, d, "mirror_artifacts"))
    ids = p.select("artifact_id", F.explode(F.expr("concat(transform(blocks, b -> b.id), transform(pages, p -> p.id))")).alias("t")).where("t IS NOT NULL").distinct().withColumn("known", F.lit(True))
    e = nested.edges(p).select("artifact_id", F.col("from_id").alias("f"), F.col("to_id").alias("t"), F.col("edge_type").alias("k")).where("f IS NOT NULL AND t IS NOT NULL").distinct()
    j = e.join(ids, ["artifact_id", "t"], "left")
    return j.groupBy("artifact_id").agg(F.count("*").alias("edges"), F.count_if(F.col("f") == F.col("t")).alias("self_loops"), F.count_if((F.col("k") == "contains") & F.col("known").isNull()).alias("unknown_ends"))


@query(f"""{_JOINED} SELECT artifact_id, count(*) AS nodes, max(level) AS depth, count(DISTINCT page) AS pages FROM bl GROUP BY 1""")
def block_graphs(spark, d):
    """Blocks, greatest depth and pages of each artifact's graph."""
    b = nested.blocks(nested.parsed(table(spark, d, "mirror_artifacts")))
    return b.groupBy("artifact_id").agg(F.count("*").alias("nodes"), F.max("level").alias("depth"), F.count_distinct("page_id").alias("pages"))


@query(f"SELECT doc_id, md5(string_agg(format('{{}}@{{:.2f}},{{:.2f}},{{:.2f}},{{:.2f}}', block_id, x0, y0, x1, y1), ';' ORDER BY page_number, block_id, x0, y0)) AS digest, count(*) AS nodes FROM {B} GROUP BY 1")
def canonical_graphs(spark, d):
    """A digest of each document's blocks in canonical order with boxes to two decimals."""
    one = F.format_string("%d@%.2f,%.2f,%.2f,%.2f", "block_id", "x0", "y0", "x1", "y1")
    parts = F.array_sort(F.collect_list(F.struct("page_number", "block_id", "x0", "y0", one.alias("s"))))
    return _blocks(spark, d).groupBy("doc_id").agg(F.md5(F.encode(F.array_join(F.transform(parts, lambda x: x["s"]), ";"), "utf-8")).alias("digest"), F.count("*").alias("nodes"))


@query("SELECT DISTINCT field_id, page, bbox[1] AS x, bbox[2] AS y, bbox[3] - bbox[1] AS width, bbox[4] - bbox[2] AS height, CASE WHEN needs_review THEN 'review' WHEN confidence >= 0.85 THEN 'accepted' ELSE 'optional' END AS layer FROM trust_fields WHERE len(bbox) = 4 AND page IS NOT NULL")
def overlay_primitives(spark, d):
    """Rectangles to draw over pages for each field, by the layer of its status."""
    t = table(spark, d, "trust_fields").where("size(bbox) = 4 AND page IS NOT NULL")
    b = F.col("bbox")
    layer = F.when(F.col("needs_review"), "review").when(F.col("confidence") >= 0.85, "accepted").otherwise("optional")
    return t.select("field_id", "page", b[0].alias("x"), b[1].alias("y"), (b[2] - b[0]).alias("width"), (b[3] - b[1]).alias("height"), layer.alias("layer")).distinct()


# --- verification, decisions, safety

_UNITS = "(SELECT artifact_key, count(*) AS units, count(*) FILTER (WHERE value IS NOT NULL AND len(bbox) = 4) AS applicable, count(*) FILTER (WHERE value IS NOT NULL AND len(bbox) = 4 AND confidence >= 0.8) AS verified, count(*) FILTER (WHERE needs_review AND confidence >= 0.85) AS conflicts FROM (SELECT DISTINCT field_id, artifact_key, value, bbox, confidence, needs_review FROM trust_fields WHERE artifact_key IS NOT NULL) GROUP BY 1)"


@query(f"""SELECT artifact_key, gate, CASE WHEN applicable = 0 AND gate <> 'unit_coverage' THEN 'not_applicable' WHEN ok THEN 'pass' ELSE 'warn' END AS status FROM (SELECT artifact_key, applicable, unnest(['unit_coverage', 'value_confidence', 'conflict_ratio']) AS gate, unnest([units > 0, coalesce(verified / nullif(applicable, 0) >= 0.8, false), coalesce(conflicts / units <= 0.01, false)]) AS ok FROM {_UNITS})""")
def verification_gates(spark, d):
    """Gates of each artifact's verification: units there, values confident, hardly any conflicts; those without a unit to apply to don't apply."""
    f = table(spark, d, "trust_fields").where("artifact_key IS NOT NULL").select("field_id", "artifact_key", "value", "bbox", "confidence", "needs_review").distinct()
    there = F.col("value").isNotNull() & (F.size("bbox") == 4)
    u = f.groupBy("artifact_key").agg(F.count("*").alias("units"), F.count_if(there).alias("applicable"), F.count_if(there & (F.col("confidence") >= 0.8)).alias("verified"), F.count_if(F.col("needs_review") & (F.col("confidence") >= 0.85)).alias("conflicts"))
    gates = {"unit_coverage": F.col("units") > 0, "value_confidence": F.coalesce(F.col("verified") / F.nullif("applicable", F.lit(0)) >= 0.8, F.lit(False)), "conflict_ratio": F.col("conflicts") / F.col("units") <= 0.01}
    one = F.inline(F.array(*[F.struct(F.lit(n).alias("gate"), ok.alias("ok")) for n, ok in gates.items()]))
    rows = u.select("artifact_key", "applicable", one)
    return rows.select("artifact_key", "gate", F.when((F.col("applicable") == 0) & (F.col("gate") != "unit_coverage"), "not_applicable").when(F.col("ok"), "pass").otherwise("warn").alias("status"))


@query("SELECT DISTINCT artifact_id, CASE WHEN NOT coalesce(json_valid(payload), false) THEN 'reject' WHEN json_type(payload) <> 'OBJECT' OR json_extract(payload, '$.datasets') IS NULL AND json_extract(payload, '$.result.datasets') IS NULL THEN 'needs_review' ELSE 'auto_ingest' END AS decision FROM (SELECT artifact_id, CASE WHEN json_valid(payload) THEN payload END AS payload FROM mirror_artifacts)")
def artifact_decisions(spark, d):
    """Whether each delivery is taken in, looked at for lack of datasets, or rejected as unreadable."""
    j = F.expr("try_parse_json(payload)")
    obj = F.expr("try_variant_get(try_parse_json(payload), '$', 'map<string,variant>') IS NOT NULL")
    has = F.expr("try_variant_get(try_parse_json(payload), '$.datasets', 'variant') IS NOT NULL OR try_variant_get(try_parse_json(payload), '$.result.datasets', 'variant') IS NOT NULL")
    return table(spark, d, "mirror_artifacts").select("artifact_id", F.when(j.isNull(), "reject").when(~obj | ~has, "needs_review").otherwise("auto_ingest").alias("decision")).distinct()


_ZW = "[\\x{200b}-\\x{200f}\\x{2060}-\\x{2064}\\x{2066}-\\x{2069}\\x{feff}]"


@query(f"WITH b AS (SELECT DISTINCT block_id, content FROM text_blocks WHERE content IS NOT NULL), s AS (SELECT block_id, length(content) - length(regexp_replace(content, '{_ZW}', '', 'g')) AS hidden, regexp_matches(content, '(?i)ignore\\s+(all\\s+)?(previous|prior|above)\\s+(instructions|commands|directives|prompts?)') AS injected, regexp_replace(content, '{_ZW}', '', 'g') AS clean FROM b) SELECT block_id, hidden::INTEGER AS hidden, injected, CASE WHEN injected THEN 'block' WHEN hidden > 0 THEN 'sanitize' ELSE 'pass' END AS action, md5(clean) AS digest FROM s")
def safety_reports(spark, d):
    """What is unsafe in each block, what is done about it, and a digest of the block as it goes on."""
    b = table(spark, d, "text_blocks").where("content IS NOT NULL").select("block_id", "content").distinct()
    clean = F.regexp_replace("content", "[" + "".join(f"\\x{{{c}}}" for c in safety.INVISIBLE) + "]", "")
    hidden, injected = F.length("content") - F.length(clean), F.col("content").rlike("(?i)" + safety.INJECTIONS["ignore_previous_instructions"])
    return b.select("block_id", hidden.alias("hidden"), injected.alias("injected"), F.when(injected, "block").when(hidden > 0, "sanitize").otherwise("pass").alias("action"), F.md5(F.encode(clean, "utf-8")).alias("digest"))


@query("WITH l AS (SELECT doc_id, count(*) AS n, count_if(regexp_matches(line, '^\\s*[\\[(]?[0-9]+[\\]).] ')) AS numbered, count_if(regexp_matches(line, '^[A-ZÄÖÜ ]{6,}$')) AS heads, count_if(regexp_matches(line, '[0-9]{1,3}(,[0-9]{3})*\\.[0-9]{2}')) AS money FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE length(text) > 0) WHERE trim(line, ' ') <> '' GROUP BY 1) SELECT doc_id, CASE WHEN money / n >= 0.5 THEN 'table' WHEN numbered / n >= 0.3 THEN 'section' WHEN n <= 3 THEN 'scan' WHEN heads / n >= 0.2 THEN 'mixed' ELSE 'prose' END AS structure, round(least(1, heads / 5.0), 4) AS header_score FROM l")
def document_structures(spark, d):
    """How a document is built, by the shares of its lines that are numbered, headings or hold amounts; and a score of its headings."""
    lines = table(spark, d, "documents").where("length(text) > 0").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("length(trim(line)) > 0")
    x, n = F.col("line"), F.count("*")
    k = lines.groupBy("doc_id").agg(n.alias("n"), F.count_if(x.rlike(r"^\s*[\[(]?[0-9]+[\]).] ")).alias("numbered"), F.count_if(x.rlike("^[A-ZÄÖÜ ]{6,}$")).alias("heads"), F.count_if(x.rlike(r"[0-9]{1,3}(,[0-9]{3})*\.[0-9]{2}")).alias("money"))
    share = lambda c: F.col(c) / F.col("n")
    kind = F.when(share("money") >= 0.5, "table").when(share("numbered") >= 0.3, "section").when(F.col("n") <= 3, "scan").when(share("heads") >= 0.2, "mixed").otherwise("prose")
    return k.select("doc_id", kind.alias("structure"), F.round(F.least(F.lit(1.0), F.col("heads") / 5.0), 4).alias("header_score"))


@query("SELECT dataset_id, count(DISTINCT (record_id, field_key)) AS anchors, count(DISTINCT CASE WHEN n > 1 THEN record_id END) AS records_with_rivals FROM (SELECT dataset_id, record_id, field_key, count(DISTINCT cell_id) AS n FROM audit_cells GROUP BY 1, 2, 3) GROUP BY 1")
def anchor_integrity(spark, d):
    """Fields of each dataset, and records in which a field is given by several cells."""
    g = table(spark, d, "audit_cells").groupBy("dataset_id", "record_id", "field_key").agg(F.count_distinct("cell_id").alias("n"))
    return g.groupBy("dataset_id").agg(F.count("*").alias("anchors"), F.count_distinct(F.when(F.col("n") > 1, F.col("record_id"))).alias("records_with_rivals"))


@query("SELECT dataset_id, record_id, string_agg(field_key || ':' || coalesce(page_start, 0), ',' ORDER BY field_key, page_start) AS lineage FROM (SELECT DISTINCT dataset_id, record_id, field_key, page_start FROM audit_cells WHERE evidence_ref IS NOT NULL) GROUP BY 1, 2")
def projection_lineage(spark, d):
    """Where each record's fields come from: every field with the page of its evidence."""
    c = table(spark, d, "audit_cells").where("evidence_ref IS NOT NULL").select("dataset_id", "record_id", "field_key", "page_start").distinct()
    parts = F.array_sort(F.collect_list(F.struct("field_key", "page_start", F.concat("field_key", F.lit(":"), F.coalesce("page_start", F.lit(0)).cast("string")).alias("s"))))
    return c.groupBy("dataset_id", "record_id").agg(F.array_join(F.transform(parts, lambda x: x["s"]), ",").alias("lineage"))


QUERIES, ORACLES = query.queries, query.oracles
