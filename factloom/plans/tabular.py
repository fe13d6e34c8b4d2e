"""Queries on tables in text: put right, headers found, rendered, checked, folded, merged over pages.

Tables are read from blocks of two lines or more, cells parted by commas, so that rows differ in width as they do where columns are torn; and from
orders, whose lines make a ledger that goes over pages of three lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.io import table
from factloom.operators import tables
from factloom.operators.common import staged
from factloom.plans.base import Book

query = Book()
T = "(SELECT block_id, [string_split(l, ', ') FOR l IN string_split(content, chr(10))] AS t FROM (SELECT DISTINCT block_id, content FROM text_blocks WHERE contains(content, chr(10))))"
_OUT = "array_to_string([array_to_string(r, '¦') FOR r IN t], chr(10))"


def _tables(spark, d):
    b = table(spark, d, "text_blocks").where(F.col("content").contains("\n")).select("block_id", "content").distinct()
    return staged(b, {"t": F.transform(F.split("content", "\n"), lambda line: F.split(line, ", "))}).select("block_id", "t")


def _shown(df):
    return df.select("block_id", F.array_join(F.transform("t", lambda r: F.array_join(r, "¦")), "\n").alias("shown"))


_STEPS = f"""a AS (SELECT block_id, len(t[1]) AS n, t FROM {T}),
sp AS (SELECT block_id, n, list_concat([t[1]], [CASE WHEN len(r) = n - 1 AND len([c FOR c IN r IF regexp_matches(c, '^[0-9]{{1,3}}\\.[0-9]{{2}}[0-9]{{5,}}')]) > 0 THEN flatten([CASE WHEN regexp_matches(c, '^[0-9]{{1,3}}\\.[0-9]{{2}}[0-9]{{5,}}') THEN [regexp_extract(c, '^([0-9]{{1,3}}\\.[0-9]{{2}})', 1), regexp_extract(c, '^[0-9]{{1,3}}\\.[0-9]{{2}}([0-9]{{5,}}[A-Z]*[0-9]*)', 1)] ELSE [c] END FOR c IN r]) ELSE r END FOR r IN t[2:]]) AS t FROM a),
al AS (SELECT block_id, n, [CASE WHEN len(r) < n THEN list_concat(r, [x FOR x IN list_resize(['']::VARCHAR[], n - len(r), '')]) WHEN len(r) > n THEN list_concat(r[1:n - 1], [array_to_string([c FOR c IN r[n:] IF c <> ''], ' ')]) ELSE r END FOR r IN t] AS t FROM sp),
cl AS (SELECT block_id, n, [[trim(replace(c, chr(13), ''), ' ') FOR c IN r] FOR r IN t] AS t FROM al),
ul AS (SELECT block_id, n, [[CASE WHEN contains(c, '___') THEN rtrim(regexp_replace(c, '_{{3,}}.*$', ''), ' ') ELSE c END FOR c IN r] FOR r IN t] AS t FROM cl),
tr AS (SELECT block_id, list_max([list_max([CASE WHEN trim(r[i], ' ') <> '' THEN i ELSE 0 END FOR i IN range(1, len(r) + 1)]) FOR r IN t]) AS n, t FROM ul),
tt AS (SELECT block_id, n, [r[1:n] FOR r IN t] AS t FROM tr),
di AS (SELECT block_id, n, list_concat([t[1]], [[CASE WHEN regexp_matches(trim(c, ' '), '^[0-9\\s]+$') AND contains(trim(c, ' '), ' ') THEN replace(trim(c, ' '), ' ', '') ELSE c END FOR c IN r] FOR r IN t[2:]]) AS t FROM tt),
cu AS (SELECT block_id, n, list_concat([t[1]], [[CASE WHEN regexp_matches(trim(c, ' '), '^(?:RMB|CNY|USD|EUR|JPY|HKD|GBP)\\s*[-0-9,]+\\.?[0-9]*\\s*$') THEN regexp_extract(trim(c, ' '), '([-0-9,]+\\.?[0-9]*)\\s*$', 1) ELSE c END FOR c IN r] FOR r IN t[2:]]) AS t FROM di),
kp AS (SELECT block_id, t, [i FOR i IN range(1, n + 1) IF NOT (len([1 FOR r IN t[2:] IF trim(r[i], ' ') <> '']) = 0 AND (trim(t[1][i], ' ') = '' OR len([1 FOR h IN t[1] IF trim(h, ' ') = trim(t[1][i], ' ')]) > 1))] AS keep, n FROM cu),
fx AS (SELECT block_id, CASE WHEN len(t) >= 2 AND n > 1 THEN [[r[i] FOR i IN keep] FOR r IN t] ELSE t END AS t FROM kp)"""


@query(f"WITH {_STEPS} SELECT block_id, {_OUT} AS shown FROM fx")
def fixed_tables(spark, d):
    """Every table put right: joined cells split, rows as wide as the header, cells cleaned, underlines, empty columns, blanks in numbers and currencies away."""
    return _shown(tables.fixed_tables(_tables(spark, d), "t"))


@query(f"WITH {_STEPS.split(',' + chr(10) + 'cl AS')[0]} SELECT block_id, {_OUT} AS shown FROM al")
def aligned_tables(spark, d):
    """Every table with joined cells split and its rows as wide as its header."""
    df = staged(_tables(spark, d), {"t": tables.split_joined_cells(F.col("t"))})
    return _shown(staged(df, {"t": tables.aligned(F.col("t"))}))


_IS_DATA = "len([1 FOR c IN r IF regexp_matches(c, '[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}') OR regexp_matches(regexp_replace(c, '[,¥ ]', '', 'g'), '^[+-]?[0-9]+\\.[0-9]{1,2}$')]) > 0"
_DATA_CELL = "(regexp_matches(c, '[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}') OR regexp_matches(regexp_replace(trim(c, ' '), '[,¥]', '', 'g'), '^[+-]?[0-9]+\\.[0-9]{1,2}$') OR regexp_matches(trim(c, ' '), '^[0-9]{2}:[0-9]{2}:[0-9]{2}$|^[0-9]{10,}$'))"
_LABEL_CELL = f"NOT {_DATA_CELL} AND NOT regexp_matches(trim(c, ' '), '^[A-Z]{{2,4}}\\s+[0-9,.]+$|^[A-Z]{{2,4}}$') AND length(trim(c, ' ')) BETWEEN 2 AND 30"
_FULL = "[c FOR c IN r IF trim(c, ' ') <> '']"
_IS_HEADER = f"len({_FULL}) >= 2 AND len([1 FOR c IN {_FULL} IF {_DATA_CELL}]) = 0 AND len([1 FOR c IN {_FULL} IF {_LABEL_CELL}]) >= 0.6 * len({_FULL})"


@query(f"WITH k AS (SELECT block_id, t, [CASE WHEN {_IS_HEADER} THEN 1 ELSE 0 END FOR r IN t[1:5]] AS h, [CASE WHEN {_IS_DATA} THEN 1 ELSE 0 END FOR r IN t] AS dr FROM {T}) SELECT block_id, (CASE WHEN list_contains(h, 1) THEN list_position(h, 1) - 1 WHEN list_contains(dr[2:6], 1) THEN 0 ELSE -1 END)::INTEGER AS header, list_sum(dr)::INTEGER AS data_rows FROM k")
def table_headers(spark, d):
    """Where each table's header stands, and how many of its rows hold data."""
    return _tables(spark, d).select("block_id", tables.header_index(F.col("t")).alias("header"), F.size(F.filter("t", tables.is_data_row)).alias("data_rows"))


@query(f"""WITH n AS (SELECT block_id, t, list_max([len(r) FOR r IN t]) AS n FROM {T}), l AS (SELECT block_id, n, [('| ' || array_to_string(list_concat([replace(replace(c, '|', '\\|'), chr(10), ' ') FOR c IN r], list_resize([]::VARCHAR[], n - len(r), '')), ' | ') || ' |') FOR r IN t] AS l FROM n)
SELECT block_id, array_to_string(list_concat([l[1], '| ' || array_to_string(list_resize([]::VARCHAR[], n, '---'), ' | ') || ' |'], l[2:]), chr(10)) AS markdown FROM l""")
def table_markdown(spark, d):
    """Every table as a pipe table of Markdown."""
    return _tables(spark, d).select("block_id", tables.markdown(F.col("t")).alias("markdown"))


@query(f"SELECT block_id, i - 2 AS row_no, j AS cell_no, t[1][j] AS label, t[i][j] AS value FROM (SELECT block_id, t, i, unnest(range(1, least(len(t[1]), len(t[i])) + 1)) AS j FROM (SELECT block_id, t, unnest(range(2, len(t) + 1)) AS i FROM {T}))")
def table_records(spark, d):
    """Every cell below a header with its label; cells beyond the header are dropped."""
    r = _tables(spark, d).select("block_id", F.posexplode(tables.records(F.col("t"))).alias("row_no", "pairs")).select("block_id", F.col("row_no").cast("bigint").alias("row_no"), F.posexplode("pairs").alias("cell_no", "p"))
    return r.select("block_id", "row_no", (F.col("cell_no") + 1).cast("bigint").alias("cell_no"), F.col("p.label").alias("label"), F.col("p.value").alias("value"))


_NARROW = "len(r) < greatest(1, len(t[1]) // 2)"
_CHECKS = f"(SELECT block_id, len(t) - 1 AS rows, len([1 FOR r IN t[2:] IF len(r) = len(t[1])]) AS as_wide, len([1 FOR i IN range(3, len(t) + 1) IF t[i] = t[i - 1]]) AS repeated, len([1 FOR r IN t[2:] IF [lower(trim(c, ' ')) FOR c IN r] = [lower(trim(c, ' ')) FOR c IN t[1]]]) AS headers, len([1 FOR r IN t[2:] IF {_NARROW}]) AS narrow, len([1 FOR r IN t[2:] IF NOT ({_NARROW}) AND len({_FULL}) < 0.5 * len(t[1])]) AS sparse FROM {T})"


def _checks(spark, d):
    return _tables(spark, d).select("block_id", *[c.alias(n) for n, c in tables.checks(F.col("t")).items()])


@query(f"SELECT block_id, round(as_wide / rows, 6) AS alignment, round((rows - repeated) / rows, 6) AS uniqueness, round((rows - headers) / rows, 6) AS header_uniqueness FROM {_CHECKS}")
def table_fidelity(spark, d):
    """Of each table, the share of rows as wide as the header, of rows unlike the one before, and of rows unlike the header."""
    r = F.col("rows")
    return _checks(spark, d).select("block_id", F.round(F.col("as_wide") / r, 6).alias("alignment"), F.round((r - F.col("repeated")) / r, 6).alias("uniqueness"), F.round((r - F.col("headers")) / r, 6).alias("header_uniqueness"))


@query(f"SELECT block_id, narrow / rows > 0.3 OR sparse / rows > 0.3 AS collapsed FROM {_CHECKS} WHERE rows >= 3")
def collapsed_tables(spark, d):
    """Whether tables of three rows or more have collapsed: over three tenths of their rows sparse or too narrow."""
    return _checks(spark, d).where("rows >= 3").select("block_id", ((F.col("narrow") / F.col("rows") > 0.3) | (F.col("sparse") / F.col("rows") > 0.3)).alias("collapsed"))


@query(f"""WITH RECURSIVE s AS (SELECT block_id, len(t[1]) AS n, i, [coalesce(t[i][j], '') FOR j IN range(1, len(t[1]) + 1)] AS r FROM (SELECT block_id, t, unnest(range(2, len(t) + 1)) AS i FROM {T})),
k AS (SELECT block_id, i, r, len([1 FOR c IN r IF regexp_matches(trim(c, ' '), '^[0-9]{{4}}[-./][0-9]{{1,2}}[-./][0-9]{{1,2}}$') OR regexp_matches(regexp_replace(trim(c, ' '), '[,¥$]', '', 'g'), '^-?[0-9]+\\.[0-9]{{2}}$')]) > 0 OR regexp_matches(trim(r[1], ' '), '^[0-9]{{1,6}}$') AS anchor FROM s WHERE len([1 FOR c IN r IF trim(c, ' ') <> '']) > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY i) AS m FROM k), g AS (SELECT *, sum(CASE WHEN anchor OR m = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY block_id ORDER BY m ROWS UNBOUNDED PRECEDING) AS rec FROM o)
SELECT block_id, CAST(count(DISTINCT rec) AS INTEGER) AS records, CAST(count(*) - count(DISTINCT rec) AS INTEGER) AS folded FROM g GROUP BY 1""")
def merged_rows(spark, d):
    """How many records each table has after rows that begin none are folded into the one before, and how many rows were folded."""
    df = _tables(spark, d).withColumn("filled", F.size(F.filter(F.transform(F.slice("t", 2, 9999), lambda r: F.slice(r, 1, F.size(F.get("t", 0)))), lambda r: F.exists(r, lambda c: F.length(F.trim(c)) > 0))))
    df = staged(df, {"m": tables.merged_split_rows(F.col("t"))})
    return df.select("block_id", (F.size("m") - 1).alias("records"), (F.col("filled") - F.size("m") + 1).alias("folded")).where("filled > 0")


# --- ledgers over pages

L = "(SELECT l_orderkey AS doc, CAST(ceil(l_linenumber / 3.0) AS INTEGER) AS page, l_linenumber AS line, 4 + CASE WHEN l_linestatus = 'F' AND l_linenumber > 3 THEN 1 ELSE 0 END AS width, l_extendedprice AS amount FROM lineitem)"
_PARTS = f"(SELECT doc, page, count(*) AS rows, max(width) AS width, round(sum(amount), 2) AS total FROM {L} GROUP BY 1, 2)"


def _parts(spark, d):
    page, more = F.ceil(F.col("l_linenumber") / 3.0).cast("int"), ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") > 3)).cast("int")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), page.alias("page"), (F.lit(4) + more).alias("width"), F.col("l_extendedprice").alias("amount"))
    return rows.groupBy("doc", "page").agg(F.count("*").alias("rows"), F.max("width").alias("width"), F.round(F.sum("amount"), 2).alias("total"))


@query(f"""WITH k AS (SELECT *, CASE WHEN page - lag(page) OVER w = 1 AND abs(width - lag(width) OVER w) <= 0 THEN 0 ELSE 1 END AS begins FROM {_PARTS} WINDOW w AS (PARTITION BY doc ORDER BY page)),
g AS (SELECT *, sum(begins) OVER (PARTITION BY doc ORDER BY page ROWS UNBOUNDED PRECEDING) AS part FROM k) SELECT doc, CAST(part AS BIGINT) AS part, min(page) AS first_page, max(page) AS last_page, CAST(sum(rows) AS BIGINT) AS rows, max(width) AS width FROM g GROUP BY doc, part""")
def logical_tables(spark, d):
    """Tables of adjacent pages with one width, composed into one: gaps and islands over the pages of a document."""
    w = Window.partitionBy("doc").orderBy("page")
    follows = (F.col("page") - F.lag("page").over(w) == 1) & (F.col("width") == F.lag("width").over(w))
    k = _parts(spark, d).withColumn("begins", (~F.coalesce(follows, F.lit(False))).cast("bigint"))
    g = k.withColumn("part", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("doc", "part").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.sum("rows").alias("rows"), F.max("width").alias("width"))


@query(f"SELECT a.doc, a.page, round(CASE WHEN a.width = b.width THEN 0.4 ELSE 0 END + 0.3 + CASE WHEN b.rows > 0 THEN 0.2 ELSE 0 END + CASE WHEN a.rows = 3 THEN 0.1 ELSE 0 END, 2) AS score, CASE WHEN a.width = b.width THEN 0.4 ELSE 0 END + 0.3 + CASE WHEN b.rows > 0 THEN 0.2 ELSE 0 END + CASE WHEN a.rows = 3 THEN 0.1 ELSE 0 END >= 0.7 AS valid FROM {_PARTS} a JOIN {_PARTS} b ON a.doc = b.doc AND b.page = a.page + 1")
def merge_scores(spark, d):
    """How well the table of a page goes on in that of the next: widths, kinds of columns (always alike here), rows to go on with, and a full page before."""
    w = Window.partitionBy("doc").orderBy("page")
    p = _parts(spark, d).withColumns({"next": F.lead("page").over(w), "w2": F.lead("width").over(w), "r2": F.lead("rows").over(w)}).where("next = page + 1")
    score = F.when(F.col("width") == F.col("w2"), 0.4).otherwise(0.0) + 0.3 + F.when(F.col("r2") > 0, 0.2).otherwise(0.0) + F.when(F.col("rows") == 3, 0.1).otherwise(0.0)
    return p.select("doc", "page", F.round(score, 2).alias("score"), (score >= 0.7).alias("valid"))


@query(f"WITH m AS (SELECT doc, median(width) AS med FROM {_PARTS} GROUP BY 1) SELECT p.doc, round(avg(CASE WHEN abs(width - med) / med <= 0.25 THEN 1.0 ELSE 0.0 END), 6) AS share, avg(CASE WHEN abs(width - med) / med <= 0.25 THEN 1.0 ELSE 0.0 END) >= 0.85 AS stable FROM {_PARTS} p JOIN m ON m.doc = p.doc GROUP BY 1")
def stable_widths(spark, d):
    """Whether the widths of a document's tables keep within a quarter of their median."""
    p = _parts(spark, d).withColumn("med", F.percentile("width", 0.5).over(Window.partitionBy("doc")))
    near = F.avg((F.abs(F.col("width") - F.col("med")) / F.col("med") <= 0.25).cast("double"))
    return p.groupBy("doc").agg(F.round(near, 6).alias("share"), (near >= 0.85).alias("stable"))


@query(f"SELECT doc, count(*) AS pages, CAST(sum(rows) AS BIGINT) AS rows, round(sum(total), 2) AS total, coalesce(max(gap), 0) AS widest_gap FROM (SELECT *, page - lag(page) OVER (PARTITION BY doc ORDER BY page) AS gap FROM {_PARTS}) GROUP BY 1")
def dual_views(spark, d):
    """What a document's tables hold as a whole: pages, rows, total, and the widest gap between their pages."""
    p = _parts(spark, d).withColumn("gap", F.col("page") - F.lag("page").over(Window.partitionBy("doc").orderBy("page")))
    return p.groupBy("doc").agg(F.count("*").alias("pages"), F.sum("rows").alias("rows"), F.round(F.sum("total"), 2).alias("total"), F.coalesce(F.max("gap"), F.lit(0)).alias("widest_gap"))


@query(f"SELECT doc, page, rows FROM {_PARTS} QUALIFY row_number() OVER (PARTITION BY doc ORDER BY width = 4 DESC, rows DESC, page) = 1")
def primary_tables(spark, d):
    """The table of each document to export: of those that keep the width of four, else of all, the one with the most rows, the first on ties."""
    best = F.min_by(F.struct("page", "rows"), F.struct(F.col("width") != 4, -F.col("rows"), "page"))
    return _parts(spark, d).groupBy("doc").agg(best.alias("b")).select("doc", "b.*")


QUERIES, ORACLES = query.queries, query.oracles
