"""Readers of structured sources: literal files, broken ones, fallbacks, gates, formats."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from factloom.sources import formats, structured


def _zip(members, flag=None):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return raw.getvalue()


def _facts(kind, content):
    return [f[0:1] + f[2:] for f in structured.READERS[kind](content)]


def test_json_csv_xml_text():
    assert _facts("json", '{"b": 1, "a": [2]}') == [("kv", 0, 0, "b", "1"), ("kv", 1, 0, "a", "[2]")]
    assert _facts("json", '[{"x": 1, "y": "z"}, {"y": null, "w": 9}]') == [("cell", 0, 0, "x", "1"), ("cell", 0, 1, "y", "z"), ("cell", 1, 0, "x", ""), ("cell", 1, 1, "y", "null")]
    assert _facts("json", "[1]") == _facts("json", "3") == _facts("csv", "a,b") == []
    assert _facts("csv", 'a,b\r\n,\r\n"x, ""y""",2\r\n') == [("cell", 0, 0, "a", 'x, "y"'), ("cell", 0, 1, "b", "2")]
    assert _facts("xml", '<root id="1"><item>hello</item><n:e xmlns:n="u" k="v">t<b>u</b></n:e></root>') == [("kv", 0, 0, "id", "1"), ("kv", 1, 0, "item", "hello"), ("kv", 2, 0, "e", "t u"), ("cell", 0, 0, "element", "item"), ("cell", 0, 1, "value", "hello"), ("cell", 1, 0, "element", "e"), ("cell", 1, 1, "value", "v")]
    assert _facts("txt", "a\tb\n1\t2\t3\n\n4") == [("cell", 0, 0, "a", "1"), ("cell", 0, 1, "b", "2"), ("cell", 1, 0, "a", "4"), ("cell", 1, 1, "b", "")]
    assert _facts("txt", "one\n\ntwo") == [("text", 0, 0, "body", "one"), ("text", 1, 0, "body", "two")]


def test_html_and_email():
    page = "<title>T</title><script>x</script><h2>A &amp; b</h2><p>one<p>two <b>three</b><nav>no</nav><ul><li>four</ul>"
    assert [f[3:] for f in _facts("html", page)] == [("title", "T"), ("h2", "A & b"), ("body", "one"), ("body", "two three"), ("body", "four")]
    assert [f[4] for f in _facts("html_runs", "<p>a<style>b</style> c <i>d</i>")] == ["a", "c", "d"]
    mail = 'Subject: =?utf-8?q?H=C3=A9?=\nFrom: a@b.c\nTo: d@e.f\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/plain\n\nhello\n\nyou\n--b\nContent-Disposition: attachment; filename="x.pdf"\n\nz\n--b--\n'
    got = {f[3]: f[4] for f in _facts("eml", mail)}
    assert (got["subject"], got["from"], got["attachments"], got["body"].split()) == ("Hé", "a@b.c", "x.pdf", ["hello", "you"])
    assert [f[4] for f in _facts("eml_lines", mail)] == ["Subject: Hé", "From: a@b.c", "To: d@e.f", "hello", "you"]


def test_office_formats():
    w = 'xmlns:w="w"'
    docx = _zip({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>a </w:t></w:r><w:r><w:t>b</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    assert _facts("docx", docx) == [("text", 0, 0, "h1", "Title"), ("text", 1, 0, "body", "a b"), ("cell", 0, 0, "h", "v")]
    slide = lambda t, n: f'<p:sld xmlns:p="p" xmlns:a="a"><p:sp><a:t>{n}</a:t></p:sp><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:t>{t}</a:t></p:sp></p:sld>'
    pptx = _zip({"ppt/slides/slide10.xml": slide("Z", "z"), "ppt/slides/slide2.xml": slide("B", "b")})
    assert [(f[1], f[4], f[5]) for f in structured.READERS["pptx"](pptx)] == [("slide_1", "h2", "B"), ("slide_1", "body", "b"), ("slide_2", "h2", "Z"), ("slide_2", "body", "z")]
    xlsx = _zip({"xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>1</v></c></row><row/><row><c r="A3" t="s"><v>1</v></c><c r="C3"><v>2.5</v></c></row></worksheet>'})
    assert _facts("xlsx", xlsx) == [("cell", 0, 0, "name", "ab"), ("cell", 0, 1, "", ""), ("cell", 0, 2, "1", "2.5")]
    assert [f[4] for f in _facts("ofd", _zip({"Doc/Page.xml": "<o:Page xmlns:o='o'><o:TextCode>合同</o:TextCode></o:Page>"}))] == ["合同"]


def test_archives():
    raw = _zip({"a.txt": "abc", "../up.txt": "x", "/root.txt": "y", "in.zip": _zip({"b.txt": "de", "bad.zip": "no zip"})})
    got = [(f[1], f[3], f[4], f[5]) for f in structured.READERS["zip"](raw)]
    assert got[0] == ("a.txt", 1, "ok", "3") and ("../up.txt", 1, "unsafe", "1") in got and ("/root.txt", 1, "unsafe", "1") in got and ("in.zip!b.txt", 2, "ok", "2") in got and ("in.zip!bad.zip", 2, "unread", "6") in got
    deep = _zip({"x.txt": "1"})
    for _ in range(12):
        deep = _zip({"n.zip": deep})
    assert [f[4] for f in structured.READERS["zip"](deep)].count("too_deep") == 1


def test_reading_survives_broken_empty_and_null_contents(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": '), (3, ""), (4, None), (5, "x,y\n1,2")], "id bigint, t string").withColumn("kind", F.lit("clash"))
    got = {(r["id"], r["kind"], r["label"]) for r in structured.read(df, "id", "t", "json").collect()}
    assert got == {(1, "kv", "a"), (2, "error", "JSONDecodeError"), (5, "error", "JSONDecodeError")}
    assert structured.read(df.limit(0), "id", "t", "xml").count() == 0
    chain = structured.read_first(df, "id", "t", ["json", "csv"]).collect()
    assert {(r["id"], r["kind"], r["label"], r["value"]) for r in chain} == {(1, "kv", "a", "1"), (5, "cell", "x", "1"), (5, "cell", "y", "2")}


def test_gates_and_formats(spark):
    df = spark.createDataFrame([(201, 11, False, "application/zip", "x.bin"), (5, 1, True, "image/webp", "y"), (5, 1, False, None, "a/B.DOCX"), (5, 1, False, "weird/type", "noext")], "n int, depth int, unsafe boolean, mime string, path string")
    allowed, reason = structured.archive_gate(F.col("n"), F.col("depth"), F.lit(10), F.lit(1), F.col("unsafe"))
    rows = df.select(allowed.alias("a"), reason.alias("r"), formats.capability(F.col("mime"), F.col("path")).alias("c")).collect()
    assert [r["a"] for r in rows] == [False, False, True, True] and rows[0]["r"] == "entry_count exceeds max; depth exceeds max" and rows[1]["r"] == "unsafe path detected"
    assert [tuple(r["c"]) for r in rows] == [("archive", "exact"), ("image", "prefix"), ("docx", "suffix"), ("unknown", "none")]
    assert formats.registry(spark).where("how = 'prefix'").count() == 2
    one = df.limit(1).select(structured.image_gate(F.lit(20000), F.lit(10), F.lit(5), F.lit(1), F.lit(1))[1], structured.pages_gate(F.lit(1), F.lit(2001), F.lit(False), F.lit(True))[1]).first()
    assert tuple(one) == ("dimensions exceed max; channels exceed max", "page_count exceeds max; JavaScript not allowed")
