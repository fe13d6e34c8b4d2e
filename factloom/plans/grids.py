"""Queries that find columns, rows and grids from the places of words and blocks, and records from the lines of texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.io import table
from factloom.operators import layout, tables
from factloom.operators.common import staged
from factloom.plans.base import Book
from factloom.plans.documents import LINES, _lines
from factloom.plans.pages import _BOUNDS, _PAGE, _ROWS, B, _blocks, _rows
from factloom.plans.tabular import _IS_HEADER, T, _tables

query = Book()

# words of a block lie side by side on its box, as wide as their share of its letters
W = f"(SELECT doc_id, page_number, block_id, i, word, x0 + (x1 - x0) * ofs / n AS wx0, x0 + (x1 - x0) * (ofs + length(word)) / n AS wx1, y0 FROM (SELECT *, length(array_to_string(ws[1:i - 1], ' ')) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS ofs, length(array_to_string(ws, ' ')) AS n, ws[i] AS word FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT *, [w FOR w IN string_split_regex(content, '\\s+') IF w <> ''] AS ws FROM {B} WHERE length(trim(content, ' ')) > 0))))"


def _words(spark, d):
    b = _blocks(spark, d).where("length(trim(content)) > 0")
    b = staged(b, {"ws": F.filter(F.split("content", r"\s+"), lambda w: w != "")})
    w = b.select(*_PAGE, "block_id", "x0", "x1", "y0", "ws", F.length(F.array_join("ws", " ")).alias("n"), F.posexplode("ws").alias("i", "word"))
    at = F.length(F.array_join(F.slice("ws", 1, F.col("i")), " ")) + F.when(F.col("i") > 0, 1).otherwise(0)
    x = lambda p: F.col("x0") + (F.col("x1") - F.col("x0")) * p / F.col("n")
    return w.select(*_PAGE, "block_id", (F.col("i") + 1).alias("i"), "word", x(at).alias("wx0"), x(at + F.length("word")).alias("wx1"), "y0")


@query(f"""WITH w AS {W}, m AS (SELECT *, max(wx1) OVER (PARTITION BY doc_id, page_number ORDER BY wx0, wx1, block_id, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w), g AS (SELECT doc_id, page_number, reach, wx0, wx0 - reach AS gap FROM m WHERE wx0 - reach > 2)
SELECT doc_id, page_number, round((reach + wx0) / 2, 4) AS edge FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY round(gap, 6) DESC, wx0) <= 2""")
def template_columns(spark, d):
    """The two widest gaps between the merged reaches of a page's words, as edges of three columns."""
    w = Window.partitionBy(*_PAGE).orderBy("wx0", "wx1", "block_id", "i").rowsBetween(Window.unboundedPreceding, -1)
    g = _words(spark, d).withColumn("reach", F.max("wx1").over(w)).withColumn("gap", F.col("wx0") - F.col("reach")).where("gap > 2")
    r = F.row_number().over(Window.partitionBy(*_PAGE).orderBy(F.round("gap", 6).desc(), "wx0"))
    return g.withColumn("r", r).where("r <= 2").select(*_PAGE, F.round((F.col("reach") + F.col("wx0")) / 2, 4).alias("edge"))


@query(f"WITH w AS {W}, v AS (SELECT doc_id, page_number, floor(wx0 / 5) * 5 AS start, count(DISTINCT block_id) AS votes FROM w GROUP BY 1, 2, 3), n AS (SELECT doc_id, page_number, count(DISTINCT block_id) AS rows FROM w GROUP BY 1, 2) SELECT doc_id, page_number, start, votes FROM v JOIN n USING (doc_id, page_number) WHERE votes >= 2 AND votes >= 0.5 * rows")
def voted_columns(spark, d):
    """Starts of columns, to five points, that words of at least two blocks and half of a page's blocks share."""
    w = _words(spark, d)
    v = w.groupBy(*_PAGE, (F.floor(F.col("wx0") / 5) * 5).cast("double").alias("start")).agg(F.count_distinct("block_id").alias("votes"))
    n = w.groupBy(*_PAGE).agg(F.count_distinct("block_id").alias("rows"))
    return v.join(n, _PAGE).where("votes >= 2 AND votes >= 0.5 * rows").select(*_PAGE, "start", "votes")


_LABEL = "length(word) BETWEEN 2 AND 30 AND NOT regexp_matches(word, '[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|^[+-]?[0-9]+\\.[0-9]{1,2}$|^[0-9]{10,}$|^[A-Z]{2,4}$')"


@query(f"""WITH w AS {W}, b AS (SELECT doc_id, page_number, block_id, min(y0) AS y, count(*) AS words, count(*) FILTER (WHERE {_LABEL}) AS labels FROM w GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y, block_id) AS r FROM b), h AS (SELECT doc_id, page_number, block_id FROM o WHERE r <= 5 AND words >= 3 AND labels / words >= 0.5 QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY r) = 1)
SELECT w.doc_id, w.page_number, w.i::INTEGER AS column_no, round(wx0, 4) AS starts FROM w JOIN h USING (doc_id, page_number, block_id)""")
def anchored_columns(spark, d):
    """Columns by the words of the first of five lines that looks like a header."""
    w = _words(spark, d)
    word = F.col("word")
    label = F.length(word).between(2, 30) & ~word.rlike(r"[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|^[+-]?[0-9]+\.[0-9]{1,2}$|^[0-9]{10,}$|^[A-Z]{2,4}$")
    b = w.groupBy(*_PAGE, "block_id").agg(F.min("y0").alias("y"), F.count("*").alias("words"), F.count_if(label).alias("labels"))
    b = b.withColumn("r", F.row_number().over(Window.partitionBy(*_PAGE).orderBy("y", "block_id"))).where("r <= 5 AND words >= 3 AND labels / words >= 0.5")
    h = b.groupBy(*_PAGE).agg(F.min_by("block_id", "r").alias("block_id"))
    return w.join(h, [*_PAGE, "block_id"]).select(*_PAGE, F.col("i").cast("int").alias("column_no"), F.round("wx0", 4).alias("starts"))


@query(f"""WITH RECURSIVE {_ROWS}, {_BOUNDS}, c AS (SELECT block_id, doc_id, page_number, x0, content, (x0 + x1) / 2 AS c FROM {B}), k AS (SELECT block_id, c.doc_id, c.page_number, x0, content, arg_min(column_no, (CASE WHEN starts <= c AND c < ends THEN 0 ELSE 1 END, CASE WHEN starts <= c AND c < ends THEN 0 ELSE abs(c - (starts + ends) / 2) END, column_no)) AS column_no FROM c JOIN bounds ON bounds.doc_id = c.doc_id AND bounds.page_number = c.page_number GROUP BY 1, 2, 3, 4, 5)
SELECT k.doc_id, k.page_number, r.row_no, k.column_no::INTEGER AS column_no, md5(string_agg(coalesce(content, ''), ' ' ORDER BY x0, k.block_id, content)) AS cell, count(*) AS tokens FROM k JOIN r ON r.doc_id = k.doc_id AND r.page_number = k.page_number AND r.block_id = k.block_id GROUP BY 1, 2, 3, 4""")
def page_grids(spark, d):
    """Every page as a grid of rows and columns, each cell the digest of its texts from the left."""
    b = _blocks(spark, d)
    pages = b.groupBy(*_PAGE).agg(F.array_sort(F.collect_set("x0")).alias("xs"), F.collect_list(F.struct("block_id", "x0", "content", ((F.col("x0") + F.col("x1")) / 2).alias("c"))).alias("items"))
    pages = staged(pages, {"bounds": layout.column_bounds(F.col("xs"))}).select(*_PAGE, "bounds", F.inline("items"))
    k = pages.select(*_PAGE, "block_id", "x0", "content", layout.column_of(F.col("c"), F.col("bounds")).alias("column_no"))
    j = k.join(_rows(spark, d).select(*_PAGE, "block_id", "row_no"), [*_PAGE, "block_id"])
    parts = F.array_sort(F.collect_list(F.struct("x0", "block_id", F.coalesce("content", F.lit("")).alias("t"))))
    return j.groupBy(*_PAGE, "row_no", "column_no").agg(F.md5(F.encode(F.array_join(F.transform(parts, lambda x: x["t"]), " "), "utf-8")).alias("cell"), F.count("*").alias("tokens"))


@query(f"WITH x AS (SELECT DISTINCT doc_id, page_number, x FROM (SELECT doc_id, page_number, x0 AS x FROM {B} UNION ALL SELECT doc_id, page_number, x1 FROM {B})), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY x) AS r FROM x) SELECT b.block_id, b.doc_id, b.page_number, (q.r - p.r)::INTEGER AS spans FROM {B} b JOIN k p ON p.doc_id = b.doc_id AND p.page_number = b.page_number AND p.x = b.x0 JOIN k q ON q.doc_id = b.doc_id AND q.page_number = b.page_number AND q.x = b.x1 WHERE q.r - p.r > 1")
def merged_cells(spark, d):
    """Blocks that reach over more than one of the stripes between a page's edges."""
    b = _blocks(spark, d)
    pages = b.groupBy(*_PAGE).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("x0", "x1"))))).alias("xs"), F.collect_list(F.struct("block_id", "x0", "x1")).alias("items"))
    k = pages.select(*_PAGE, "xs", F.inline("items"))
    spans = (F.array_position("xs", F.col("x1")) - F.array_position("xs", F.col("x0"))).cast("int")
    return k.select("block_id", *_PAGE, spans.alias("spans")).where("spans > 1")


@query(f"SELECT block_id, doc_id, page_number, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, block_id) AS band FROM {B} WHERE level IN ('header', 'h2')")
def header_bands(spark, d):
    """Heads and headings of a page, numbered from above."""
    w = Window.partitionBy(*_PAGE).orderBy("y0", "x0", "block_id")
    return _blocks(spark, d).where("level IN ('header', 'h2')").select("block_id", *_PAGE, F.row_number().over(w).cast("bigint").alias("band"))


@query(f"""WITH p AS (SELECT a.block_id AS label, b.block_id AS value, row_number() OVER (PARTITION BY a.block_id ORDER BY b.x0 - a.x1, b.block_id) AS r FROM {B} a JOIN {B} b ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND abs(a.y0 - b.y0) <= 40 AND b.x0 >= a.x1 WHERE length(a.content) <= 60) SELECT label, value FROM p WHERE r = 1""")
def label_values(spark, d):
    """The nearest block to the right of each short block, within 40 points of its height."""
    b = _blocks(spark, d)
    a = b.where("length(content) <= 60").select(*_PAGE, F.col("block_id").alias("label"), F.col("y0").alias("ay"), F.col("x1").alias("ax"))
    c = b.select(*_PAGE, F.col("block_id").alias("value"), F.col("y0").alias("by"), F.col("x0").alias("bx"))
    band = F.floor(F.col("by") / 40)  # heights meet in bands, so that not all blocks of a page meet all
    a, c = a.withColumn("band", F.floor(F.col("ay") / 40)), c.withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
    j = a.join(c, [*_PAGE, "band"]).where((F.abs(F.col("ay") - F.col("by")) <= 40) & (F.col("bx") >= F.col("ax")))
    return j.groupBy("label").agg(F.min_by("value", F.struct(F.col("bx") - F.col("ax"), "value")).alias("value"))


@query(f"WITH x AS (SELECT doc_id, page_number, count(DISTINCT floor(x0 / 50)) AS cols, count(DISTINCT floor(y0 / 50)) AS rows, count(*) AS blocks FROM {B} GROUP BY 1, 2) SELECT doc_id, page_number, cols, rows, blocks, cols >= 2 AND rows >= 2 AND blocks >= 0.5 * cols * rows AS lattice FROM x")
def page_lattices(spark, d):
    """Pages whose blocks fill half of a lattice of 50 points by 50."""
    x = _blocks(spark, d).groupBy(*_PAGE).agg(F.count_distinct(F.floor(F.col("x0") / 50)).alias("cols"), F.count_distinct(F.floor(F.col("y0") / 50)).alias("rows"), F.count("*").alias("blocks"))
    return x.withColumn("lattice", (F.col("cols") >= 2) & (F.col("rows") >= 2) & (F.col("blocks") >= 0.5 * F.col("cols") * F.col("rows")))


# the candidates of columns from left edges (weight 0.3) and from middles of boxes (weight 0.2)
_SIGNALS = f"(SELECT doc_id, page_number, x0 AS pos, 0.3 AS w, 'edge' AS m FROM {B} UNION ALL SELECT doc_id, page_number, (x0 + x1) / 2, 0.2, 'middle' FROM {B})"


@query(f"WITH o AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 5 THEN 0 ELSE 1 END AS new, row_number() OVER w AS i FROM {_SIGNALS} WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY pos, m, w)), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_number ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT doc_id, page_number, round(sum(pos * w) / sum(w), 4) AS boundary, round(sum(w), 4) AS vote, count(*) AS votes FROM g GROUP BY doc_id, page_number, k HAVING count(*) >= 2")
def fused_columns(spark, d):
    """Candidates of columns that lie within five points of one another, fused to their weighted middle; at least two must agree."""
    b = _blocks(spark, d)
    s = b.select(*_PAGE, F.inline(F.array(F.struct(F.col("x0").alias("pos"), F.lit(0.3).alias("w"), F.lit("edge").alias("m")), F.struct(((F.col("x0") + F.col("x1")) / 2).alias("pos"), F.lit(0.2).alias("w"), F.lit("middle").alias("m")))))
    w = Window.partitionBy(*_PAGE).orderBy("pos", "m", "w")
    new = (~F.coalesce(F.col("pos") - F.lag("pos").over(w) <= 5, F.lit(False))).cast("int")
    g = s.withColumn("new", new).withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy(*_PAGE, "k").agg(F.round(F.sum(F.col("pos") * F.col("w")) / F.sum("w"), 4).alias("boundary"), F.round(F.sum("w"), 4).alias("vote"), F.count("*").alias("votes")).where("votes >= 2").select(*_PAGE, "boundary", "vote", "votes")


# --- records from lines and tables

@query(f"""WITH l AS (SELECT doc_id, line_no, line, regexp_matches(line, '^[^:]{{2,30}}: .+$') AS kv FROM {LINES}), n AS (SELECT *, lead(line, 1) OVER w AS l1, lead(kv, 1) OVER w AS k1, lead(line, 2) OVER w AS l2, lead(kv, 2) OVER w AS k2, lead(line, 3) OVER w AS l3, lead(kv, 3) OVER w AS k3 FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, line_no, CASE WHEN coalesce(trim(l1, ' '), '') = '' OR k1 THEN 0 WHEN coalesce(trim(l2, ' '), '') = '' OR k2 THEN 1 WHEN coalesce(trim(l3, ' '), '') = '' OR k3 THEN 2 ELSE 3 END AS following FROM n WHERE kv""")
def extended_fields(spark, d):
    """How many of the three lines after a label and value go on with it: up to the first that is blank or has a label itself."""
    l = _lines(table(spark, d, "documents")).withColumn("kv", F.col("line").rlike(r"^[^:]{2,30}: .+$"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    stop = {i: (F.coalesce(F.length(F.trim(F.lead("line", i).over(w))), F.lit(0)) == 0) | F.lead("kv", i).over(w) for i in (1, 2, 3)}
    n = l.withColumn("following", F.when(stop[1], 0).when(stop[2], 1).when(stop[3], 2).otherwise(3))
    return n.where("kv").select("doc_id", "line_no", "following")


@query(f"WITH s AS (SELECT doc_id, line_no, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) - line_no AS width FROM {LINES} WHERE regexp_matches(line, '^\\s*[\\[(]?[0-9]+[\\]).] ')), c AS (SELECT doc_id, width, count(*) AS n FROM s WHERE width IS NOT NULL GROUP BY 1, 2), m AS (SELECT doc_id, arg_min(width, (-n, width)) AS width, sum(n) AS total, max(n) AS n FROM c GROUP BY 1) SELECT doc_id, width, CAST(n AS BIGINT) AS records, round(n / total, 6) AS share FROM m")
def repeated_records(spark, d):
    """The commonest number of lines from one numbered line to the next, and how many records keep to it."""
    s = _lines(table(spark, d, "documents")).where(F.col("line").rlike(r"^\s*[\[(]?[0-9]+[\]).] "))
    s = s.select("doc_id", (F.lead("line_no").over(Window.partitionBy("doc_id").orderBy("line_no")) - F.col("line_no")).alias("width")).where("width IS NOT NULL")
    c = s.groupBy("doc_id", "width").agg(F.count("*").alias("n"))
    m = c.groupBy("doc_id").agg(F.min_by("width", F.struct(-F.col("n"), "width")).alias("width"), F.max("n").alias("records"), F.sum("n").alias("total"))
    return m.select("doc_id", "width", "records", F.round(F.col("records") / F.col("total"), 6).alias("share"))


_JUNK = "regexp_matches(array_to_string(r, ' '), '(?i)^\\s*(?:page|seite|pagina|total|sum)\\b|^\\s*[0-9]{1,4}\\s*(?:/\\s*[0-9]{1,4})?\\s*$')"
_FULLCELLS = "len([1 FOR c IN r IF trim(c, ' ') <> ''])"


@query(f"SELECT block_id, len([1 FOR r IN t IF len(r) < 2])::INTEGER AS narrow, len([1 FOR r IN t IF len(r) >= 2 AND NOT ({_FULLCELLS} / len(r) >= 0.6 AND {_FULLCELLS} > 3) AND {_JUNK}])::INTEGER AS junk, len([1 FOR r IN t IF regexp_matches(lower(array_to_string(r, ' ')), 'total|subtotal|summe|sous-total')])::INTEGER AS totals FROM {T}")
def junk_rows(spark, d):
    """Of each table, rows with a single cell, rows that are furniture of the page, and rows of totals."""
    text = lambda r: F.array_join(r, " ")
    filled = lambda r: F.size(F.filter(r, lambda c: F.length(F.trim(c)) > 0))
    junk = lambda r: (F.size(r) >= 2) & ~((filled(r) / F.size(r) >= 0.6) & (filled(r) > 3)) & text(r).rlike(r"(?i)^\s*(?:page|seite|pagina|total|sum)\b|^\s*[0-9]{1,4}\s*(?:/\s*[0-9]{1,4})?\s*$")
    count = lambda f: F.size(F.filter("t", f))
    return _tables(spark, d).select("block_id", count(lambda r: F.size(r) < 2).alias("narrow"), count(junk).alias("junk"), count(lambda r: F.lower(text(r)).rlike("total|subtotal|summe|sous-total")).alias("totals"))


@query(f"WITH h AS (SELECT block_id, t, [trim(c, ' ') FOR c IN t[1] IF trim(c, ' ') <> ''] AS head FROM {T}), o AS (SELECT block_id, [CASE WHEN len(head) > 0 THEN len(list_intersect(list_distinct([trim(c, ' ') FOR c IN r]), list_distinct(head))) / len(list_distinct(head)) ELSE 0 END FOR r IN t[2:11]] AS shares FROM h) SELECT block_id, coalesce(list_position([s >= 0.5 FOR s IN shares], true), 0)::INTEGER AS repeated_at FROM o")
def repeated_headers(spark, d):
    """The first of ten rows below a table's header that repeats half of it, or 0."""
    plain = lambda r: F.array_distinct(F.filter(F.transform(r, lambda c: F.trim(c)), lambda c: F.length(c) > 0))
    df = staged(_tables(spark, d), {"head": plain(F.col("t")[0])})
    share = lambda r: F.when(F.size("head") > 0, F.size(F.array_intersect(plain(r), F.col("head"))) / F.size("head")).otherwise(0.0)
    return df.select("block_id", F.array_position(F.transform(F.slice("t", 2, 10), lambda r: share(r) >= 0.5), True).cast("int").alias("repeated_at"))


@query(f"SELECT block_id, array_to_string(flatten([[t[i][j] || '=' || t[i][j + 1] FOR j IN range(1, len(t[i])) IF regexp_matches(t[i][j], '^[A-Za-z ]{{3,40}}$') AND regexp_matches(t[i][j + 1], '^[0-9][0-9.,]*$')] FOR i IN range(1, len(t) + 1)]), ';') AS pairs FROM {T}")
def preamble_pairs(spark, d):
    """Labels of letters that stand beside a number in a row of a table."""
    pair = lambda r: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1))), lambda j: F.when(F.get(r, j - 1).rlike("^[A-Za-z ]{3,40}$") & F.get(r, j).rlike("^[0-9][0-9.,]*$"), F.concat(F.get(r, j - 1), F.lit("="), F.get(r, j)))), lambda x: x.isNotNull())
    return _tables(spark, d).select("block_id", F.array_join(F.flatten(F.transform("t", pair)), ";").alias("pairs"))


_CLS = "CASE WHEN trim(c, ' ') = '' THEN 'empty' WHEN regexp_matches(regexp_replace(trim(c, ' '), '[,，]', '', 'g'), '^[+-]?[0-9]+(?:\\.[0-9]+)?$') THEN 'number' WHEN regexp_matches(trim(c, ' '), '[0-9]{4}[-/年][0-9]{1,2}') THEN 'date' WHEN regexp_matches(c, '[\\x{4e00}-\\x{9fff}]') THEN 'cjk_text' WHEN regexp_matches(c, '[A-Za-z]') THEN 'latin_text' ELSE 'symbol' END"


@query(f"""WITH k AS (SELECT block_id, t, i FROM (SELECT block_id, t, unnest(range(1, least(3, len(t)) + 1)) AS i FROM {T}) WHERE {_IS_HEADER.replace(' r IF', ' t[i] IF').replace('IN r ', 'IN t[i] ')}),
c AS (SELECT block_id, i, j, {_CLS} AS class, count(*) AS n FROM (SELECT block_id, i, j, t[m][j] AS c FROM (SELECT block_id, t, i, m, unnest(range(1, len(t[m]) + 1)) AS j FROM (SELECT block_id, t, i, unnest(range(i + 1, len(t) + 1)) AS m FROM k))) WHERE trim(c, ' ') <> '' GROUP BY 1, 2, 3, 4),
s AS (SELECT block_id, i, avg(share) AS mean FROM (SELECT block_id, i, j, max(n) / sum(n) AS share, sum(n) AS total FROM c GROUP BY 1, 2, 3) WHERE total >= 2 GROUP BY 1, 2),
f AS (SELECT k.block_id, k.i, round(coalesce(mean, 0) * len([c FOR c IN t[k.i] IF trim(c, ' ') <> '']) / len(t[k.i]) * (0.7 + 0.3 * len(list_distinct([c FOR c IN t[k.i] IF trim(c, ' ') <> ''])) / len([c FOR c IN t[k.i] IF trim(c, ' ') <> ''])), 6) AS score FROM k LEFT JOIN s ON s.block_id = k.block_id AND s.i = k.i),
b AS (SELECT block_id, arg_min(i, (-score, i)) - 1 AS header, max(score) AS score FROM f GROUP BY 1) SELECT a.block_id, coalesce(header, -1)::INTEGER AS header, coalesce(score, 0)::DOUBLE AS score FROM {T} a LEFT JOIN b ON b.block_id = a.block_id""")
def inferred_headers(spark, d):
    """The header of each table by what stands below its candidates."""
    return tables.inferred_header(_tables(spark, d), "t").select("block_id", "header", "score")


_TR = f"(SELECT b.doc_id, b.page_number, b.block_id, t FROM {T} JOIN (SELECT DISTINCT block_id, doc_id, page_number FROM text_blocks WHERE doc_id IS NOT NULL) b USING (block_id))"


@query(f"""WITH d AS (SELECT doc_id, page_number, block_id, list_distinct([array_to_string(r, chr(31)) FOR r IN t]) AS rs FROM {_TR}) SELECT DISTINCT a.block_id FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND a.block_id <> b.block_id WHERE len(list_intersect(a.rs, b.rs)) = len(a.rs) AND (len(a.rs) < len(b.rs) OR (len(a.rs) = len(b.rs) AND a.block_id > b.block_id))""")
def redundant_tables(spark, d):
    """Tables of which every row stands in another table of the page that has more, or as many and came first. Tables meet through their rows; copies are set
    aside before."""
    b = table(spark, d, "text_blocks").where("doc_id IS NOT NULL").select("block_id", "doc_id", "page_number").distinct()
    t = _tables(spark, d).select("block_id", F.array_sort(F.array_distinct(F.transform("t", lambda r: F.md5(F.encode(F.array_join(r, "\x1f"), "utf-8"))))).alias("rs")).join(b, "block_id")
    first = t.groupBy(*_PAGE, "rs").agg(F.min("block_id").alias("first"))
    copies = t.join(first, [*_PAGE, "rs"]).where("block_id > first").select("block_id")
    rows = first.select(*_PAGE, F.col("first").alias("id"), F.size("rs").alias("n"), F.explode("rs").alias("r"))
    other = rows.select(*_PAGE, "r", F.col("id").alias("id2"), F.col("n").alias("n2"))
    within = rows.join(other, [*_PAGE, "r"]).where("id <> id2 AND n < n2").groupBy("id", "id2").agg(F.count("*").alias("shared"), F.max("n").alias("n")).where("shared = n")
    # a copy of a table that is within another is within it too
    inner = within.select("id").distinct()
    copies_within = t.join(first, [*_PAGE, "rs"]).join(inner, F.col("first") == F.col("id")).select("block_id")
    return copies.unionByName(copies_within).distinct()


@query()
def similar_fields(spark, d):
    """Fields of a record that give one value under labels that are alike; tested against brute force."""
    from factloom.operators import lexicon

    c = table(spark, d, "audit_cells").select("record_id", "field_key", "value")
    return lexicon.similar_labels(c, ["record_id"], "field_key", "value")


QUERIES, ORACLES = query.queries, query.oracles
