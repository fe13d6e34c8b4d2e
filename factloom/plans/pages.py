"""Queries on the geometry and order of pages: rows, columns, valleys, bridges, sections, ids and coverage of facts.

A block counts once, as its distinct content and place; blocks without a document or a whole box are left out. Pages are taken as 595 by 842 points."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.io import table
from factloom.operators import layout
from factloom.operators.common import staged
from factloom.plans.base import Book

query = Book()
WIDTH, HEIGHT = 595, 842
B = "(SELECT DISTINCT block_id, doc_id, page_number, reading_order, level, content, bbox, bbox[1] AS x0, bbox[2] AS y0, bbox[3] AS x1, bbox[4] AS y1 FROM text_blocks WHERE doc_id IS NOT NULL AND page_number IS NOT NULL AND len(bbox) = 4)"
_PAGE = ["doc_id", "page_number"]


def _blocks(spark, d):
    b = table(spark, d, "text_blocks").where("doc_id IS NOT NULL AND page_number IS NOT NULL AND size(bbox) = 4").select("block_id", *_PAGE, "reading_order", "level", "content", "bbox").distinct()
    return b.withColumns({n: F.col("bbox")[i] for i, n in enumerate(("x0", "y0", "x1", "y1"))})


_ROWS = f"""o AS (SELECT block_id, doc_id, page_number, y0, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, block_id) AS n FROM {B}),
r AS (SELECT *, y0 AS row_y, 1 AS row_no FROM o WHERE n = 1 UNION ALL SELECT o.*, CASE WHEN abs(o.y0 - r.row_y) <= 8 THEN r.row_y ELSE o.y0 END, CASE WHEN abs(o.y0 - r.row_y) <= 8 THEN r.row_no ELSE r.row_no + 1 END FROM r JOIN o ON o.doc_id = r.doc_id AND o.page_number = r.page_number AND o.n = r.n + 1)"""


def _rows(spark, d):
    items = F.array_sort(F.collect_list(F.struct("y0", "x0", "block_id")))
    pages = _blocks(spark, d).groupBy(*_PAGE).agg(items.alias("items")).select(*_PAGE, F.inline(layout.rows_of(F.col("items"), "y0")))
    return pages.select(*_PAGE, F.col("item.block_id").alias("block_id"), "row_no", "row_y")


@query(f"WITH RECURSIVE {_ROWS} SELECT doc_id, page_number, block_id, row_no, row_y FROM r")
def page_rows(spark, d):
    """The row of each block on its page: rows begin 8 points below the first block of the one before."""
    return _rows(spark, d)


@query(f"""WITH RECURSIVE {_ROWS}, y AS (SELECT DISTINCT doc_id, page_number, row_no, row_y FROM r), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_number) AS n, row_y - lag(row_y) OVER (PARTITION BY doc_id, page_number ORDER BY row_no) AS gap FROM y),
t AS (SELECT *, sum(CASE WHEN n >= 4 AND gap > {HEIGHT} * 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS part FROM c)
SELECT doc_id, page_number, min(row_no) AS first_row, count(*) AS rows FROM t GROUP BY doc_id, page_number, part, n HAVING count(*) >= 2 OR n < 4""")
def tables_by_gap(spark, d):
    """Tables of a page: parted where rows lie a twentieth of its height apart; single rows are dropped, pages of under four rows stay whole."""
    w = Window.partitionBy(*_PAGE).orderBy("row_no")
    y = _rows(spark, d).select(*_PAGE, "row_no", "row_y").distinct().withColumns({"n": F.count("*").over(Window.partitionBy(*_PAGE)), "gap": F.col("row_y") - F.lag("row_y").over(w)})
    part = F.sum(((F.col("n") >= 4) & F.coalesce(F.col("gap") > HEIGHT * 0.05, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    t = y.withColumn("part", part).groupBy(*_PAGE, "part", "n").agg(F.min("row_no").alias("first_row"), F.count("*").alias("rows"))
    return t.where("rows >= 2 OR n < 4").select(*_PAGE, "first_row", "rows")


@query(f"SELECT doc_id, page_number, block_id, CAST(sum(CASE WHEN y0 - p > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, block_id ROWS UNBOUNDED PRECEDING) + 1 AS BIGINT) AS part FROM (SELECT *, lag(y1) OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, block_id) AS p FROM {B})")
def line_clusters(spark, d):
    """Clusters of lines on a page, parted by more than 40 points from the line before."""
    w = Window.partitionBy(*_PAGE).orderBy("y0", "x0", "block_id")
    b = _blocks(spark, d).withColumn("p", F.lag("y1").over(w))
    far = F.coalesce(F.col("y0") - F.col("p") > 40, F.lit(False)).cast("bigint")
    return b.select(*_PAGE, "block_id", (F.sum(far).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).alias("part"))


_BOUNDS = f"""x AS (SELECT DISTINCT doc_id, page_number, x0 AS x FROM {B}), g AS (SELECT *, x - lag(x) OVER (PARTITION BY doc_id, page_number ORDER BY x) AS gap FROM x),
m AS (SELECT doc_id, page_number, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS gaps, max(x) AS most, count(*) AS n FROM g GROUP BY 1, 2),
s AS (SELECT doc_id, page_number, x, n, most FROM g JOIN m USING (doc_id, page_number) WHERE gap IS NULL OR gap > 2 * gaps[len(gaps) // 2 + 1]),
bounds AS (SELECT doc_id, page_number, row_number() OVER w AS column_no, x AS starts, CASE WHEN n = 1 THEN x + 100 ELSE coalesce(lead(x) OVER w, most + 10) END AS ends FROM s WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY x))"""


@query(f"""WITH {_BOUNDS}, c AS (SELECT block_id, doc_id, page_number, (x0 + x1) / 2 AS c FROM {B})
SELECT block_id, doc_id, page_number, arg_min(column_no, (CASE WHEN starts <= c AND c < ends THEN 0 ELSE 1 END, CASE WHEN starts <= c AND c < ends THEN 0 ELSE abs(c - (starts + ends) / 2) END, column_no))::INTEGER AS column_no FROM c JOIN bounds USING (doc_id, page_number) GROUP BY 1, 2, 3""")
def blocks_in_columns(spark, d):
    """The column of each block: the one its centre lies in, else the nearest."""
    pages = _blocks(spark, d).groupBy(*_PAGE).agg(F.array_sort(F.collect_set("x0")).alias("xs"), F.collect_list(F.struct("block_id", ((F.col("x0") + F.col("x1")) / 2).alias("c"))).alias("items"))
    pages = staged(pages, {"bounds": layout.column_bounds(F.col("xs"))}).select(*_PAGE, "bounds", F.inline("items"))
    return pages.select("block_id", *_PAGE, layout.column_of(F.col("c"), F.col("bounds")).alias("column_no"))


_SIGNAL = f"sig AS (SELECT p.doc_id, p.page_number, x, count(b.block_id) AS v FROM (SELECT DISTINCT doc_id, page_number FROM {B}) p CROSS JOIN (SELECT unnest(range({WIDTH})) AS x) LEFT JOIN {B} b ON b.doc_id = p.doc_id AND b.page_number = p.page_number AND greatest(0, trunc(b.x0)) <= x AND x <= least({WIDTH - 1}, trunc(b.x1)) GROUP BY 1, 2, 3)"


def _signals(spark, d):
    pages = _blocks(spark, d).groupBy(*_PAGE).agg(F.collect_list(F.struct("x0", "x1", "block_id")).alias("spans"))
    return staged(pages, {"signal": layout.covered(F.col("spans"), WIDTH)})


@query(f"""WITH {_SIGNAL}, m AS (SELECT *, v <= 0.1 * max(v) OVER (PARTITION BY doc_id, page_number) AS low FROM sig), i AS (SELECT *, x - row_number() OVER (PARTITION BY doc_id, page_number ORDER BY x) AS island FROM m WHERE low)
SELECT doc_id, page_number, min(x)::INTEGER AS starts, count(*)::INTEGER AS width FROM i GROUP BY doc_id, page_number, island HAVING count(*) >= 2""")
def page_valleys(spark, d):
    """Runs of at least two points across a page in which at most a tenth as many blocks stand as where most do."""
    edges = _blocks(spark, d).select(*_PAGE, "block_id", F.inline(layout.edges(F.col("x0"), F.col("x1"), WIDTH)))
    changes = edges.groupBy(*_PAGE, "x").agg(F.sum(F.when(F.col("block_id").isNotNull(), F.col("d")).otherwise(0)).alias("d"))
    pages = changes.groupBy(*_PAGE).agg(F.array_sort(F.collect_list(F.struct("x", "d"))).alias("changes"))
    pages = staged(pages, {"levels": layout.levels(F.col("changes"))})
    pages = staged(pages, {"line": 0.1 * F.array_max(F.col("levels.v"))})
    return pages.select(*_PAGE, F.inline(layout.low_runs(F.col("levels"), F.col("line"), WIDTH)))


@query(f"""WITH {_SIGNAL}, i AS (SELECT *, x - row_number() OVER (PARTITION BY doc_id, page_number ORDER BY x) AS island FROM sig WHERE v = 0), gaps AS (SELECT doc_id, page_number, (min(x) + max(x) + 1) / 2.0 AS mid FROM i GROUP BY doc_id, page_number, island HAVING count(*) >= 15),
n AS (SELECT doc_id, page_number, count(*) AS n FROM {B} GROUP BY 1, 2)
SELECT b.block_id, b.doc_id, b.page_number, CASE WHEN max(n.n) < 4 THEN 0 ELSE count(mid) END AS column_no FROM {B} b JOIN n ON n.doc_id = b.doc_id AND n.page_number = b.page_number LEFT JOIN gaps g ON g.doc_id = b.doc_id AND g.page_number = b.page_number AND (b.x0 + b.x1) / 2 >= mid GROUP BY 1, 2, 3""")
def projected_columns(spark, d):
    """The column of each block, from 0: columns are parted in the middle of stripes of 15 points or more that no block touches; pages of under four blocks have one."""
    empty = layout.valleys(F.col("signal"), 0.0, 15)
    mids = F.transform(empty, lambda r: r["starts"] + r["width"] / 2)
    pages = staged(staged(_signals(spark, d), {"signal": F.transform("signal", lambda v: F.when(v == 0, 0).otherwise(1))}), {"mids": F.when(F.size("spans") >= 4, mids)}).select(*_PAGE, "mids", F.inline("spans"))
    n = F.size(F.filter(F.coalesce("mids", F.array().cast("array<double>")), lambda m: (F.col("x0") + F.col("x1")) / 2 >= m))
    return pages.select("block_id", *_PAGE, n.cast("bigint").alias("column_no"))


@query(f"SELECT block_id, doc_id, page_number, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY round(y0, 2), round(x0, 2), CASE WHEN level IN ('header', 'footer') THEN 1 ELSE 0 END, block_id) - 1 AS position FROM {B}")
def canonical_order(spark, d):
    """Order of a page's blocks by place, texts before what stands at its edges, then by id; from 0."""
    late = F.when(F.col("level").isin("header", "footer"), 1).otherwise(0)
    w = Window.partitionBy(*_PAGE).orderBy(F.round("y0", 2), F.round("x0", 2), late, "block_id")
    return _blocks(spark, d).select("block_id", *_PAGE, (F.row_number().over(w) - 1).cast("bigint").alias("position"))


@query(f"WITH o AS (SELECT doc_id, block_id, lead(block_id) OVER (PARTITION BY doc_id ORDER BY page_number, reading_order, y0, x0, block_id) AS next FROM {B}) SELECT doc_id, block_id AS from_id, next AS to_id, 'reading_next' AS edge_type FROM o WHERE next IS NOT NULL")
def document_flow(spark, d):
    """The chain of a document's blocks in reading order, as edges."""
    w = Window.partitionBy("doc_id").orderBy("page_number", "reading_order", "y0", "x0", "block_id")
    rows = _blocks(spark, d).select("doc_id", F.col("block_id").alias("from_id"), F.lead("block_id").over(w).alias("to_id"))
    return rows.where("to_id IS NOT NULL").withColumn("edge_type", F.lit("reading_next"))


_GOES_ON = "(CASE WHEN ta <> '' AND tb <> '' THEN (CASE WHEN right(ta, 1) NOT IN ('.', '。', '!', '！', '?', '？', ':', '：', ';', '；') THEN 0.4 ELSE 0 END) + (CASE WHEN regexp_matches(tb, '^\\p{Ll}') THEN 0.3 ELSE 0 END) + (CASE WHEN NOT regexp_matches(tb, '^\\p{Lu}') AND NOT regexp_matches(tb, '^[0-9（(【\\[]') THEN 0.2 ELSE 0 END) ELSE 0 END)"


@query(f"""WITH j AS (SELECT a.doc_id, a.block_id AS from_id, b.block_id AS to_id, a.page_number, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / nullif(least(a.x1 - a.x0, b.x1 - b.x0), 0) AS overlap, b.y0 AS gap, trim(coalesce(a.content, ''), chr(10) || ' ') AS ta, trim(coalesce(b.content, ''), chr(10) || ' ') AS tb FROM {B} a JOIN {B} b ON a.doc_id = b.doc_id AND b.page_number = a.page_number + 1
WHERE a.y1 > {HEIGHT} * 0.8 AND b.y0 < 100 AND b.y0 <= 50), c AS (SELECT *, least(1, 0.4 * overlap + 0.3 * greatest(0, 1 - gap / 50) + 0.3 * {_GOES_ON}) AS c FROM j WHERE overlap >= 0.3)
SELECT doc_id, from_id, to_id, page_number, round(c + 1e-9, 3) AS confidence, round(c + 1e-9, 3) < 0.5 AS candidate FROM c""")
def page_bridges(spark, d):
    """Blocks in the last fifth of a page and blocks at the begin of the next that stand in one column, with how surely the one goes on in the other."""
    b = _blocks(spark, d).where("x1 > x0").withColumn("t", F.regexp_replace(F.coalesce("content", F.lit("")), r"^[\n ]+|[\n ]+$", ""))
    a = b.where(F.col("y1") > HEIGHT * 0.8).select("doc_id", (F.col("page_number") + 1).alias("next"), "page_number", F.col("block_id").alias("from_id"), F.col("bbox").alias("p"), F.col("t").alias("ta"))
    c = b.where("y0 <= 50").select("doc_id", F.col("page_number").alias("next"), F.col("block_id").alias("to_id"), F.col("bbox").alias("q"), F.col("t").alias("tb"))
    j = a.join(c, ["doc_id", "next"]).withColumn("o", layout.horizontal_overlap(F.col("p"), F.col("q"))).where("o >= 0.3")
    confidence = F.round(F.least(F.lit(1.0), 0.4 * F.col("o") + 0.3 * F.greatest(F.lit(0.0), 1 - F.col("q")[1] / 50) + 0.3 * layout.goes_on(F.col("ta"), F.col("tb"))) + 1e-9, 3)
    return j.select("doc_id", "from_id", "to_id", "page_number", confidence.alias("confidence"), (confidence < 0.5).alias("candidate"))


@query(f"""WITH h AS (SELECT *, last_value(CASE WHEN level = 'h2' THEN block_id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number, reading_order, block_id ROWS UNBOUNDED PRECEDING) AS section FROM {B}), o AS (SELECT *, lead(page_number) OVER w AS np, lead(block_id) OVER w AS nid, lead(bbox) OVER w AS nb, lead(section) OVER w AS ns, trim(content, chr(10) || ' ') AS t FROM h WHERE level = 'body' WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, reading_order, block_id)),
s AS (SELECT block_id, nid AS next_id, (CASE WHEN t <> '' AND NOT regexp_matches(t, '[.!?。！？;；:：…]$') THEN 0.30 ELSE 0 END) + (CASE WHEN y1 > 500 AND nb[2] < 200 THEN 0.25 ELSE 0 END) + (CASE WHEN greatest(y1 - y0, nb[4] - nb[2]) > 0 AND NOT least(y1 - y0, nb[4] - nb[2]) / greatest(y1 - y0, nb[4] - nb[2]) > 0.7 THEN 0 ELSE 0.20 END) + (CASE WHEN section = ns THEN 0.15 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[-—]$') THEN 0.10 ELSE 0 END) AS c FROM o WHERE nid IS NOT NULL AND np <> page_number)
SELECT block_id, next_id, round(c, 3) AS confidence, c >= 0.6 - 1e-9 AS merges FROM s""")
def detect_continuations(spark, d):
    """Paragraphs that are followed by one of another page, with how surely the one goes on in the other, by end, place, height, section and hyphen."""
    flow = Window.partitionBy("doc_id").orderBy("page_number", "reading_order", "block_id")
    section = F.last(F.when(F.col("level") == "h2", F.col("block_id")), True).over(flow.rowsBetween(Window.unboundedPreceding, 0))
    h = _blocks(spark, d).withColumn("section", section).where("level = 'body'")
    o = h.withColumns({"np": F.lead("page_number").over(flow), "next_id": F.lead("block_id").over(flow), "nb": F.lead("bbox").over(flow), "ns": F.lead("section").over(flow), "t": F.regexp_replace("content", r"^[\n ]+|[\n ]+$", "")}).where("next_id IS NOT NULL AND np <> page_number")
    a, b = F.col("y1") - F.col("y0"), F.col("nb")[3] - F.col("nb")[1]
    sign = lambda c, v: F.when(c, v).otherwise(0.0)
    score = sign((F.col("t") != "") & ~F.col("t").rlike("[.!?。！？;；:：…]$"), 0.30) + sign((F.col("y1") > 500) & (F.col("nb")[1] < 200), 0.25) + F.when((F.greatest(a, b) > 0) & ~(F.least(a, b) / F.greatest(a, b) > 0.7), 0.0).otherwise(0.20) + sign(F.col("section") == F.col("ns"), 0.15) + sign(F.col("t").rlike("[-—]$"), 0.10)
    return o.select("block_id", "next_id", F.round(score, 3).alias("confidence"), (score >= 0.6 - 1e-9).alias("merges"))


# Forms of headings.
HEADINGS = (r"(第)?[一二三四五六七八九十百]+[章节部分篇条]", "[（(][一二三四五六七八九十]+[）)]", r"[0-9]+[\.、]\s*[\x{4e00}-\x{9fff}]", r"[\[【][0-9]+[\]】]", r"(?:[Cc][Hh][Aa][Pp][Tt][Ee][Rr]|[Ss][Ee][Cc][Tt][Ii][Oo][Nn]|[Pp][Aa][Rr][Tt]|[Aa][Pp][Pp][Ee][Nn][Dd][Ii][Xx])\s+[0-9]+", r"[0-9]+(\.[0-9]+)*\s+[A-Z][a-zA-Z\s]{3,}", r"[A-Z]\.[0-9]+\.\s", r"[IVX]+\.\s+[A-Z]", "(摘要|概要|总结|结论|附录|参考文献|Abstract|Summary|Introduction|Conclusion|References|Appendix)")
_HEADING = "^(?:" + "|".join(f"(?:{h})" for h in HEADINGS) + ")"


@query(f"""WITH m AS (SELECT doc_id, page_number, list_sort(list(y1 - y0) FILTER (WHERE y1 > y0)) AS hs FROM {B} GROUP BY 1, 2), k AS (SELECT block_id, trim(content, chr(10) || ' ') AS t, x0, x1, CASE WHEN y1 > y0 THEN (y1 - y0) / hs[len(hs) // 2 + 1] ELSE 0 END AS ratio FROM {B} b JOIN m ON m.doc_id = b.doc_id AND m.page_number = b.page_number),
s AS (SELECT block_id, (CASE WHEN regexp_matches(t, '{_HEADING}') THEN 0.5 ELSE 0 END) + (CASE WHEN ratio >= 1.5 THEN 0.3 WHEN ratio >= 1.3 THEN 0.2 WHEN ratio >= 1.1 THEN 0.1 ELSE 0 END) + (CASE WHEN length(t) <= 30 THEN 0.1 WHEN length(t) <= 50 THEN 0.05 ELSE 0 END) + (CASE WHEN x0 < 100 THEN 0.05 ELSE 0 END) + (CASE WHEN x1 - x0 > 50 AND x1 - x0 < 400 THEN 0.05 ELSE 0 END) AS s FROM k WHERE t <> '' AND length(t) <= 120)
SELECT block_id, round(least(1, s), 2) AS score FROM s WHERE s >= 0.4 - 1e-9""")
def detect_headings(spark, d):
    """Blocks that are headings, by form, height against the page's upper median, length and place."""
    b = _blocks(spark, d)
    m = b.where("y1 > y0").groupBy(*_PAGE).agg(layout.upper_median(F.collect_list(F.col("y1") - F.col("y0"))).alias("body"))
    k = b.join(m, _PAGE, "left").withColumns({"t": F.regexp_replace("content", r"^[\n ]+|[\n ]+$", ""), "ratio": F.when(F.col("y1") > F.col("y0"), (F.col("y1") - F.col("y0")) / F.col("body")).otherwise(0.0)}).where("length(t) BETWEEN 1 AND 120")
    n, r, w = F.length("t"), F.col("ratio"), F.col("x1") - F.col("x0")
    s = F.when(F.col("t").rlike(_HEADING), 0.5).otherwise(0.0) + F.when(r >= 1.5, 0.3).when(r >= 1.3, 0.2).when(r >= 1.1, 0.1).otherwise(0.0) + F.when(n <= 30, 0.1).when(n <= 50, 0.05).otherwise(0.0) + F.when(F.col("x0") < 100, 0.05).otherwise(0.0) + F.when((w > 50) & (w < 400), 0.05).otherwise(0.0)
    return k.withColumn("s", s).where("s >= 0.4 - 1e-9").select("block_id", F.round(F.least(F.lit(1.0), "s"), 2).alias("score"))


_SECTIONS = f"h AS (SELECT doc_id, block_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, reading_order, block_id) AS n, least(6, dense_rank() OVER (PARTITION BY doc_id ORDER BY x1 - x0 DESC)) AS level FROM {B} WHERE level = 'h2')"


def _sections(spark, d):
    h = _blocks(spark, d).where("level = 'h2'")
    order = Window.partitionBy("doc_id").orderBy("page_number", "reading_order", "block_id")
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy((F.col("x1") - F.col("x0")).desc()))
    h = h.select("doc_id", "block_id", F.row_number().over(order).alias("n"), F.least(F.lit(6), rank).alias("level"))
    before = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    up = {f"_up{k}": F.last(F.when(F.col("level") < k, F.struct("n", "block_id")), True).over(before) for k in range(2, 7)}
    h = h.withColumns(up)
    parent = F.coalesce(*[F.when(F.col("level") == k, F.col(f"_up{k}.block_id")) for k in range(2, 7)])
    return h.select("doc_id", "block_id", "n", F.col("level").cast("bigint").alias("level"), parent.alias("parent_id"))


@query(f"WITH {_SECTIONS} SELECT doc_id, block_id, n, level, (SELECT arg_max(p.block_id, p.n) FROM h p WHERE p.doc_id = h.doc_id AND p.n < h.n AND p.level < h.level) AS parent_id FROM h")
def section_tree(spark, d):
    """Headings of a document with their level, by the rank of their width, and the nearest heading before that is above them. Levels are at most six, so
    each is found by one running window instead of comparing headings with one another."""
    return _sections(spark, d).withColumn("n", F.col("n").cast("bigint"))


@query(f"WITH {_SECTIONS} SELECT doc_id, count(*) AS headings, max(level) AS depth, count_if(NOT EXISTS (SELECT 1 FROM h p WHERE p.doc_id = h.doc_id AND p.n < h.n AND p.level < h.level)) AS roots FROM h GROUP BY 1")
def outlines(spark, d):
    """How many headings each document's outline has, how deep it is, and how many stand at its top."""
    return _sections(spark, d).groupBy("doc_id").agg(F.count("*").alias("headings"), F.max("level").alias("depth"), F.count_if(F.col("parent_id").isNull()).alias("roots"))


@query(f"""WITH o AS (SELECT *, lead(bbox) OVER (PARTITION BY doc_id, page_number ORDER BY reading_order, block_id) AS q FROM {B})
SELECT block_id, least(x0, q[1]) AS ux0, least(y0, q[2]) AS uy0, greatest(x1, q[3]) AS ux1, greatest(y1, q[4]) AS uy1, x0 - 1 <= q[1] AND y0 - 1 <= q[2] AND x1 + 1 >= q[3] AND y1 + 1 >= q[4] AS holds FROM o WHERE q IS NOT NULL""")
def box_relations(spark, d):
    """Each block's box with the next one's on its page: their union, and whether it holds the other."""
    b = _blocks(spark, d).withColumn("q", F.lead("bbox").over(Window.partitionBy(*_PAGE).orderBy("reading_order", "block_id"))).where("q IS NOT NULL")
    q = F.col("q")
    return b.select("block_id", F.least("x0", q[0]).alias("ux0"), F.least("y0", q[1]).alias("uy0"), F.greatest("x1", q[2]).alias("ux1"), F.greatest("y1", q[3]).alias("uy1"), layout.contains(F.col("bbox"), q).alias("holds"))


@query(f"SELECT block_id, round(1 / (x1 - x0), 9) AS sx, round(1 / (y1 - y0), 9) AS sy, round(-x0 / (x1 - x0), 9) AS tx, round(-y0 / (y1 - y0), 9) AS ty FROM {B} WHERE x1 > x0 AND y1 > y0")
def box_transforms(spark, d):
    """The inverse of the matrix that lays the unit square on each block's box."""
    z, one = F.lit(0.0), F.lit(1.0)
    m = layout.inverse([[F.col("x1") - F.col("x0"), z, F.col("x0")], [z, F.col("y1") - F.col("y0"), F.col("y0")], [z, z, one]])
    return _blocks(spark, d).where("x1 > x0 AND y1 > y0").select("block_id", F.round(m[0][0], 9).alias("sx"), F.round(m[1][1], 9).alias("sy"), F.round(m[0][2], 9).alias("tx"), F.round(m[1][2], 9).alias("ty"))


@query(f"SELECT min(block_id) AS block_id, doc_id, page_number, count(*) AS glyphs FROM {B} WHERE content IS NOT NULL GROUP BY doc_id, page_number, floor(x0 / 3), floor(y0 / 3), content")
def overlaid_blocks(spark, d):
    """The first of the blocks that stand at the same place, three points give or take, with the same content."""
    g = _blocks(spark, d).where("content IS NOT NULL").groupBy(*_PAGE, F.floor(F.col("x0") / 3).alias("_x"), F.floor(F.col("y0") / 3).alias("_y"), F.md5(F.encode("content", "utf-8")).alias("_c"))
    return g.agg(F.min("block_id").alias("block_id"), F.count("*").alias("glyphs")).select("block_id", *_PAGE, "glyphs")


@query(f"SELECT doc_id, block_id, format('text:p{{}}:t{{}}', page_number, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY reading_order, block_id) - 1) AS fact_id FROM {B}")
def fact_ids(spark, d):
    """Stable ids of text facts: pages as numbered, texts from 0 in reading order."""
    n = F.row_number().over(Window.partitionBy(*_PAGE).orderBy("reading_order", "block_id")) - 1
    return _blocks(spark, d).select("doc_id", "block_id", F.format_string("text:p%d:t%d", "page_number", n).alias("fact_id"))


_LEVEL = "CASE WHEN {n} = 0 THEN 'missing' WHEN {n} >= {of} THEN 'full' ELSE 'partial' END"


@query(f"""WITH b AS (SELECT DISTINCT block_id, doc_id, page_number, content, bbox, evidence_ids FROM text_blocks WHERE doc_id IS NOT NULL),
n AS (SELECT doc_id, count(*) AS blocks, count(DISTINCT page_number) AS pages, count(*) FILTER (WHERE length(trim(content, ' ')) > 0) AS texts, count(*) FILTER (WHERE len(bbox) > 0) AS boxes, count(*) FILTER (WHERE len(evidence_ids) > 0) AS refs FROM b GROUP BY 1)
SELECT doc_id, CASE WHEN texts > 0 THEN 'full' ELSE 'missing' END AS text, {_LEVEL.format(n="blocks", of="pages")} AS blocks, CASE WHEN boxes > 0 THEN 'block' ELSE 'none' END AS bbox, {_LEVEL.format(n="refs", of="blocks")} AS source_refs, boxes > 0 AND refs > 0 AS forensic_ready FROM n""")
def mirror_completeness(spark, d):
    """How completely each document's texts, blocks, boxes and sources are there."""
    b = table(spark, d, "text_blocks").where("doc_id IS NOT NULL").select("block_id", "doc_id", "page_number", "content", "bbox", "evidence_ids").distinct()
    n = b.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("page_number").alias("pages"), F.count_if(F.length(F.trim("content")) > 0).alias("texts"), F.count_if(F.size("bbox") > 0).alias("boxes"), F.count_if(F.size("evidence_ids") > 0).alias("refs"))
    level = lambda k, of: F.when(F.col(k) == 0, "missing").when(F.col(k) >= F.col(of), "full").otherwise("partial")
    return n.select("doc_id", F.when(F.col("texts") > 0, "full").otherwise("missing").alias("text"), level("n", "pages").alias("blocks"), F.when(F.col("boxes") > 0, "block").otherwise("none").alias("bbox"), level("refs", "n").alias("source_refs"), ((F.col("boxes") > 0) & (F.col("refs") > 0)).alias("forensic_ready"))


QUERIES, ORACLES = query.queries, query.oracles
