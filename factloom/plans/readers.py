"""Queries that write every order, event or document in a format and read it back by that format's reader; gates before reading; formats of paths."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from factloom.io import table
from factloom.operators.common import staged
from factloom.plans.base import Book
from factloom.sources import formats, structured

query = Book()
LINE = "SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, printf('%.2f', l_extendedprice), l_returnflag, l_linestatus) - 1 AS n, l_linenumber, printf('%.2f', l_extendedprice) AS price, l_returnflag || ', \"' || l_linestatus || '\"' AS flags FROM lineitem"


def _orders(spark, d):
    """(doc, rows): the lines of each order as an array of (line, price, flags)."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_linenumber", "l_partkey", F.format_string("%.2f", "l_extendedprice").alias("price"), F.concat("l_returnflag", F.lit(', "'), "l_linestatus", F.lit('"')).alias("flags"))
    g = li.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "price", "flags"))).alias("rows"))
    return staged(g, {"rows": F.transform("rows", lambda r: F.struct(r["l_linenumber"].cast("string").alias("line"), r["price"].alias("price"), r["flags"].alias("flags")))})


def _cells(df, kind):
    return structured.read(df, "doc", "text", kind).where("kind = 'cell'").select("doc", F.col("row_no").cast("bigint").alias("row_no"), "label", "value")


_CELLS = f"SELECT doc, n AS row_no, unnest(['line', 'price', 'flags']) AS label, unnest([CAST(l_linenumber AS VARCHAR), price, flags]) AS value FROM ({LINE})"


@query(_CELLS)
def read_json_tables(spark, d):
    """Orders as JSON lists of objects, read back as tables."""
    return _cells(_orders(spark, d).select("doc", F.to_json("rows").alias("text")), "json")


@query("SELECT event_id AS doc, 'k' AS label, props ->> '$.k' AS value FROM events WHERE props IS NOT NULL AND json_valid(props)")
def read_json_objects(spark, d):
    """The properties of events, read as keys and values."""
    e = table(spark, d, "events").select(F.col("event_id").alias("doc"), F.col("props").alias("text"))
    return structured.read(e, "doc", "text", "json").where("kind = 'kv'").select("doc", "label", "value")


@query(_CELLS)
def read_csv_tables(spark, d):
    """Orders as CSV with quoted cells and a blank row, read back as tables."""
    quoted = lambda r: F.concat(r["line"], F.lit(","), r["price"], F.lit(',"'), F.replace(r["flags"], F.lit('"'), F.lit('""')), F.lit('"'))
    text = F.concat(F.lit("line,price,flags\r\n,,\r\n"), F.array_join(F.transform("rows", quoted), "\r\n"))
    return _cells(_orders(spark, d).select("doc", text.alias("text")), "csv")


@query(_CELLS)
def read_tab_tables(spark, d):
    """Orders as tab-separated text, the last cell of each row missing where it is empty, read back as tables."""
    text = F.concat(F.lit("line\tprice\tflags\n"), F.array_join(F.transform("rows", lambda r: F.concat_ws("\t", r["line"], r["price"], r["flags"])), "\n"))
    return _cells(_orders(spark, d).select("doc", text.alias("text")), "txt")


@query(f"SELECT doc, n AS row_no, CASE WHEN n = 0 THEN 'first' ELSE 'line' END AS element, price AS value FROM ({LINE})")
def read_xml_tables(spark, d):
    """Orders as XML, read back as rows of element and value; attributes win over text."""
    item = lambda r, i: F.when(i == 0, F.concat(F.lit('<x:first price="'), r["price"], F.lit('">text</x:first>'))).otherwise(F.concat(F.lit("<x:line><b>"), r["price"], F.lit("</b></x:line>")))
    text = F.concat(F.lit('<x:order xmlns:x="urn:x" id="1">'), F.array_join(F.transform("rows", item), ""), F.lit("</x:order>"))
    facts = structured.read(_orders(spark, d).select("doc", text.alias("text")), "doc", "text", "xml").where("kind = 'cell'")
    pair = facts.groupBy("doc", "row_no").agg(F.max(F.when(F.col("label") == "element", F.col("value"))).alias("element"), F.max(F.when(F.col("label") == "value", F.col("value"))).alias("value"))
    return pair.select("doc", F.col("row_no").cast("bigint").alias("row_no"), "element", "value")


_LINES = "(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, array_to_string(string_split_regex(trim(line, ' '), '\\s+'), ' ') AS line FROM (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE length(text) > 0)) WHERE length(trim(line, ' ')) > 0)"


def _pages(spark, d):
    """(doc_id, html): every document as a page, its first line the heading, with parts that aren't to be read and blocks that aren't closed."""
    docs = table(spark, d, "documents").where("length(text) > 0")
    safe = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    block = lambda x, i: F.when(i == 0, F.concat(F.lit("<h1>"), safe(x), F.lit("</h1>"))).when(i % 2 == 1, F.concat(F.lit("<p>"), safe(x))).otherwise(F.concat(F.lit("<p><b>"), safe(x), F.lit("</b></p>")))
    page = F.concat(F.lit("<html><head><script>var a = '<p>no</p>';</script><style>p {}</style></head><body><nav>Home | Search</nav>"), F.array_join(F.transform(lines, block), "\n"), F.lit("<footer>no</footer></body></html>"))
    return docs.select("doc_id", page.alias("html"))


@query(f"SELECT doc_id, n AS block_no, CASE WHEN n = 0 THEN 'h1' ELSE 'body' END AS level, line AS text FROM {_LINES} WHERE line <> ''")
def read_html_blocks(spark, d):
    """Documents as HTML, read back as blocks with their level."""
    facts = structured.read(_pages(spark, d), "doc_id", "html", "html")
    return facts.select("doc_id", F.col("row_no").cast("bigint").alias("block_no"), F.col("label").alias("level"), F.col("value").alias("text"))


@query("SELECT DISTINCT file_id, unnest(['subject', 'to', 'attachments', 'body']) AS label, unnest([document_type, package_id || '@example.org', 'a.pdf, b.pdf', path]) AS value FROM package_files WHERE document_type IS NOT NULL AND path IS NOT NULL AND package_id IS NOT NULL")
def read_emails(spark, d):
    """Submitted files as e-mails with two attachments, read back as headers, body and names."""
    part = lambda n: f'--b\nContent-Type: application/pdf\nContent-Disposition: attachment; filename="{n}"\n\nx\n'
    f = table(spark, d, "package_files").where("document_type IS NOT NULL AND path IS NOT NULL AND package_id IS NOT NULL").select("file_id", "document_type", "package_id", "path").distinct()
    mail = F.concat(F.lit("Subject: "), "document_type", F.lit("\nTo: "), "package_id", F.lit('@example.org\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/plain; charset="utf-8"\n\n'), "path", F.lit("\n" + part("a.pdf") + part("b.pdf") + "--b--\n"))
    facts = structured.read(f.select("file_id", mail.alias("mail")), "file_id", "mail", "eml").where("label IN ('subject', 'to', 'attachments', 'body')")
    return facts.select("file_id", "label", F.trim(F.regexp_replace("value", r"\s+$", "")).alias("value")).distinct()


def _zips(spark, d):
    """(package_id, raw): the files of each package zipped, each file's number as its content, in an archive within an archive for every second package."""
    def pack(batches):
        for pdf in batches:
            out = []
            for p, names in zip(pdf["package_id"], pdf["names"]):
                inner = io.BytesIO()
                with zipfile.ZipFile(inner, "w") as z:
                    for i, n in enumerate(names):
                        z.writestr(n, "x" * (i + 1))
                if len(names) % 2 == 0:
                    outer = io.BytesIO()
                    with zipfile.ZipFile(outer, "w") as z:
                        z.writestr("in.zip", inner.getvalue())
                    inner = outer
                out.append((p, inner.getvalue()))
            yield pd.DataFrame(out, columns=["package_id", "raw"])

    g = table(spark, d, "package_files").where("package_id IS NOT NULL").groupBy("package_id").agg(F.array_sort(F.collect_set(F.concat_ws("/", F.col("file_id").cast("string"), F.lit("f.txt")))).alias("names"))
    return g.mapInPandas(pack, "package_id string, raw binary")


@query("WITH n AS (SELECT package_id, count(DISTINCT file_id) AS k FROM package_files WHERE package_id IS NOT NULL GROUP BY 1) SELECT package_id, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS depth, k AS members, CAST(k * (k + 1) / 2 AS BIGINT) AS bytes FROM n")
def read_archives(spark, d):
    """The members of each package's archive, those of archives within it included, with their depth and size."""
    facts = structured.read(_zips(spark, d), "package_id", "raw", "zip").where("label = 'ok' AND NOT endswith(part, '.zip')")
    return facts.groupBy("package_id", F.col("col_no").alias("depth")).agg(F.count("*").alias("members"), F.sum(F.col("value").cast("bigint")).alias("bytes"))


@query("WITH g AS (SELECT package_id, count(DISTINCT file_id) AS n, max(len(string_split(path, '/')) - 1) AS depth, bool_or(contains(path, '..')) AS unsafe FROM package_files WHERE path IS NOT NULL GROUP BY 1) SELECT package_id, n <= 200 AND depth <= 10 AND NOT unsafe AS allowed, array_to_string(list_filter([CASE WHEN n > 200 THEN 'entry_count exceeds max' END, CASE WHEN depth > 10 THEN 'depth exceeds max' END, CASE WHEN unsafe THEN 'unsafe path detected' END], lambda x: x IS NOT NULL), '; ') AS reason FROM g")
def archive_preflight(spark, d):
    """Whether each package may be opened as an archive, and why not."""
    g = table(spark, d, "package_files").where("path IS NOT NULL").groupBy("package_id").agg(F.count_distinct("file_id").alias("n"), F.max(F.size(F.split("path", "/")) - 1).alias("depth"), F.bool_or(F.col("path").contains("..")).alias("unsafe"))
    allowed, reason = structured.archive_gate(F.col("n"), F.col("depth"), F.lit(1), F.lit(1), F.col("unsafe"))
    return g.select("package_id", allowed.alias("allowed"), reason.alias("reason"))


@query("SELECT DISTINCT result_id, coalesce(page_count, 0) <= 2000 AND NOT coalesce(contains(lower(full_text), '/javascript'), false) AS allowed, array_to_string(list_filter([CASE WHEN coalesce(page_count, 0) > 2000 THEN 'page_count exceeds max' END, CASE WHEN coalesce(contains(lower(full_text), '/javascript'), false) THEN 'JavaScript not allowed' END], lambda x: x IS NOT NULL), '; ') AS reason FROM parse_results")
def pages_preflight(spark, d):
    """Whether each result's file may be read page by page, and why not."""
    script = F.coalesce(F.lower("full_text").contains("/javascript"), F.lit(False))
    allowed, reason = structured.pages_gate(F.coalesce(F.length("full_text"), F.lit(0)), F.coalesce("page_count", F.lit(0)), F.lit(False), script)
    return table(spark, d, "parse_results").select("result_id", allowed.alias("allowed"), reason.alias("reason")).distinct()


@query("SELECT DISTINCT block_id, 100 * (bbox[3] - bbox[1]) <= 16384 AND 100 * (bbox[4] - bbox[2]) <= 16384 AND 10000 * (bbox[3] - bbox[1]) * (bbox[4] - bbox[2]) <= 268435456 AS allowed FROM text_blocks WHERE len(bbox) = 4")
def image_preflight(spark, d):
    """Whether each block, drawn at a hundred dots a point, would be an image of allowed size."""
    b = table(spark, d, "text_blocks").where("size(bbox) = 4")
    w, h = (F.col("bbox")[2] - F.col("bbox")[0]) * 100, (F.col("bbox")[3] - F.col("bbox")[1]) * 100
    allowed, _ = structured.image_gate(w, h, F.lit(3), F.lit(1), F.lit(0))
    return b.select("block_id", allowed.alias("allowed")).distinct()


_SUFFIX = "lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1))"


@query(f"SELECT DISTINCT file_id, CASE WHEN {_SUFFIX} = 'pdf' THEN 'pdf' WHEN {_SUFFIX} IN ('png', 'jpg', 'jpeg', 'tif', 'tiff', 'bmp', 'webp') THEN 'image' WHEN {_SUFFIX} IN ('docx', 'pptx', 'xlsx', 'csv', 'tsv', 'json', 'xml', 'ofd') THEN {_SUFFIX} WHEN {_SUFFIX} IN ('html', 'htm') THEN 'html' WHEN {_SUFFIX} = 'eml' THEN 'email' WHEN {_SUFFIX} = 'zip' THEN 'archive' WHEN {_SUFFIX} IN ('txt', 'md', 'log') THEN 'text' ELSE 'unknown' END AS name FROM package_files WHERE path IS NOT NULL")
def format_of_files(spark, d):
    """The format of each submitted file."""
    f = table(spark, d, "package_files").where("path IS NOT NULL").select("file_id", formats.capability(F.lit(None).cast("string"), F.col("path")).alias("c"))
    return f.select("file_id", "c.name").distinct()


QUERIES, ORACLES = query.queries, query.oracles
