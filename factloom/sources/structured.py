"""Structured sources to facts: JSON, CSV, XML, plain and tab-separated text, HTML, e-mail, zipped office formats and archives.

Each reader turns one text or file into facts (kind, part, row_no, col_no, label, value): `kv` for a key and its value, `text` for a block (label is its
level), `cell` for a cell below a header (part is the table, row_no counts from 0). `read` runs a reader over a frame in Arrow batches. Null and empty
contents give no facts; one that can't be read gives a single fact of kind `error` with the reason, so that one bad file fails no job."""

from __future__ import annotations

import csv
import email
import io
import json
import re
import sys
import zipfile
from collections.abc import Callable, Iterator
from email import policy
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Fact = tuple[str, str, int, int, str, str]
SCHEMA = "kind string, part string, row_no int, col_no int, label string, value string"
#: Members, depth of nesting and bytes of one archive beyond which it isn't opened.
MOST_MEMBERS, MOST_DEPTH, MOST_BYTES = 200, 10, 500_000_000


def _cells(part: str, header: list[str], rows: list[list[str]]) -> Iterator[Fact]:
    for r, row in enumerate(rows):
        for c, (label, value) in enumerate(zip(header, row)):
            yield "cell", part, r, c, label, value


def json_facts(text: str) -> Iterator[Fact]:
    """An object gives keys and values, a list of objects one table with the keys of its first; other JSON gives nothing."""
    data = json.loads(text)
    shown = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if isinstance(data, dict):
        for i, (k, v) in enumerate(data.items()):
            yield "kv", "", i, 0, k, shown(v)
    elif isinstance(data, list) and data and isinstance(data[0], dict):
        header = list(data[0])
        yield from _cells("json_records", header, [[shown(r[h]) if isinstance(r, dict) and h in r else "" for h in header] for r in data])


def csv_facts(text: str) -> Iterator[Fact]:
    """The first row is the header; rows without any text are dropped."""
    rows = list(csv.reader(io.StringIO(text, newline="")))
    if rows:
        yield from _cells("csv_data", rows[0], [r for r in rows[1:] if any(r)])


def xml_facts(text: str) -> Iterator[Fact]:
    """Attributes of the root and texts of its children as keys and values; each child also as a row of its name and its first attribute, else its text."""
    root = ElementTree.fromstring(text)
    n, rows = 0, []
    for k, v in root.attrib.items():
        yield "kv", "", n, 0, k, v
        n += 1
    for child in root:
        name = child.tag.rsplit("}", 1)[-1]
        whole = " ".join(p for p in ((e.text or "").strip() for e in child.iter()) if p)
        if whole:
            yield "kv", "", n, 0, name, whole
            n += 1
        first = next(iter(child.attrib.values()), whole)
        if first:
            rows.append([name, first])
    yield from _cells("xml_elements", ["element", "value"], rows)


def text_facts(text: str) -> Iterator[Fact]:
    """A table if a tab stands in one of the first 20 lines that aren't blank, rows padded or cut to the header; else one block a line."""
    lines = [x for x in text.splitlines() if x.strip()]
    if any("\t" in x for x in lines[:20]):
        header, *rows = [x.split("\t") for x in lines]
        yield from _cells("txt_tsv", header, [(r + [""] * len(header))[: len(header)] for r in rows])
    else:
        for i, line in enumerate(lines):
            yield "text", "", i, 0, "body", line


class _Html(HTMLParser):
    LEVELS = {"title": "title", "h1": "h1", "h2": "h2", "h3": "h3", "h4": "h3", "h5": "h3", "h6": "h3", "p": "body", "li": "body"}
    SILENT = {"script", "style", "noscript", "template", "nav", "footer"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.silent, self.open, self.blocks, self.runs = 0, [], [], []

    def _close(self) -> None:
        if self.open:
            tag, parts = self.open.pop()
            if text := " ".join(" ".join(parts).split()):
                self.blocks.append((self.LEVELS[tag], text))

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT:
            self.silent += 1
        elif tag in self.LEVELS and not self.silent:
            self._close()  # an unclosed block ends where the next begins
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif self.open and tag in (self.open[-1][0], "body", "html", "ul", "ol", "div"):
            self._close()

    def handle_data(self, data):
        text = " ".join(data.split())
        if text and not self.silent:
            self.runs.append(text)
            if self.open:
                self.open[-1][1].append(text)


def html_facts(text: str) -> Iterator[Fact]:
    """Title, headings, paragraphs and list items as blocks; scripts, styles, navigation and feet are left out."""
    p = _Html()
    p.feed(text)
    p.close()
    p._close()
    for i, (level, block) in enumerate(p.blocks):
        yield "text", "", i, 0, level, block


def html_runs(text: str) -> Iterator[Fact]:
    """Every visible run of text, blanks collapsed."""
    p = _Html()
    p.feed(text)
    p.close()
    for i, run in enumerate(p.runs):
        yield "text", "", i, 0, "run", run


def email_facts(raw: str | bytes) -> Iterator[Fact]:
    """Five headers and the names of attachments as keys and values, plain-text parts as blocks."""
    m = email.message_from_bytes(raw, policy=policy.default) if isinstance(raw, bytes) else email.message_from_string(raw, policy=policy.default)
    for i, h in enumerate(("subject", "from", "to", "date", "message-id")):
        yield "kv", "", i, 0, h.replace("-", "_"), str(m[h] or "")
    names, n = [], 0
    for part in m.walk():
        if part.get_content_disposition() == "attachment":
            names += [part.get_filename()] if part.get_filename() else []
        elif part.get_content_type() == "text/plain" and (body := part.get_content()).strip():
            yield "text", "", n, 0, "body", body
            n += 1
    if names:
        yield "kv", "", 5, 0, "attachments", ", ".join(names)


def email_lines(raw: str | bytes) -> Iterator[Fact]:
    """Header lines, then the lines of the body that aren't blank."""
    facts = list(email_facts(raw))
    lines = [f"{f[4].capitalize()}: {f[5]}" for f in facts if f[0] == "kv" and f[4] in ("subject", "from", "to", "date") and f[5]]
    lines += [x.strip() for f in facts if f[0] == "text" for x in f[5].splitlines() if x.strip()]
    for i, line in enumerate(lines):
        yield "text", "", i, 0, "line", line


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _parts(raw: bytes, pattern: str) -> Iterator[tuple[str, ElementTree.Element]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        number = lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]
        for name in sorted((n for n in z.namelist() if re.search(pattern, n)), key=number):
            yield name, ElementTree.fromstring(z.read(name))


def _texts(e: ElementTree.Element, *names: str) -> str:
    return "".join(x.text or "" for x in e.iter() if _local(x.tag) in names)


def docx_facts(raw: bytes) -> Iterator[Fact]:
    """Paragraphs with their style as level, and cells of tables."""
    n = tables = 0
    for _, root in _parts(raw, r"^word/document\.xml$"):
        for e in next(x for x in root if _local(x.tag) == "body"):
            if _local(e.tag) == "p" and (text := _texts(e, "t")).strip():
                style = next((v for x in e.iter() if _local(x.tag) == "pStyle" for k, v in x.attrib.items() if _local(k) == "val"), "body")
                yield "text", "", n, 0, style.lower().replace("heading", "h").replace(" ", ""), text
                n += 1
            elif _local(e.tag) == "tbl":
                rows = [[_texts(c, "t") for c in r if _local(c.tag) == "tc"] for r in e if _local(r.tag) == "tr"]
                yield from _cells(f"docx_table_{tables}", rows[0] if rows else [], rows[1:])
                tables += 1


def pptx_facts(raw: bytes) -> Iterator[Fact]:
    """The texts of each slide's shapes, its title first; part is the slide."""
    for s, (_, root) in enumerate(_parts(raw, r"^ppt/slides/slide\d+\.xml$"), 1):
        shapes = [x for x in root.iter() if _local(x.tag) == "sp"]
        title = lambda x: any(_local(p.tag) == "ph" and p.attrib.get("type") in ("title", "ctrTitle") for p in x.iter())
        for i, sp in enumerate(sorted(shapes, key=lambda x: not title(x))):
            if (text := _texts(sp, "t")).strip():
                yield "text", f"slide_{s}", i, 0, "h2" if title(sp) else "body", text


def xlsx_facts(raw: bytes) -> Iterator[Fact]:
    """The cells of each sheet below its first row, which is the header; part is the sheet. Empty rows are skipped."""
    shared = [_texts(si, "t") for _, root in _parts(raw, r"^xl/sharedStrings\.xml$") for si in root]
    column = lambda ref: sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(re.sub(r"\d", "", ref)))) - 1
    for s, (_, root) in enumerate(_parts(raw, r"^xl/worksheets/sheet\d+\.xml$"), 1):
        rows = []
        for r in (x for x in root.iter() if _local(x.tag) == "row"):
            row: dict[int, str] = {}
            for i, c in enumerate(x for x in r if _local(x.tag) == "c"):
                text = _texts(c, "v", "t")
                row[column(c.attrib["r"]) if c.attrib.get("r") else i] = shared[int(text)] if c.attrib.get("t") == "s" and text else text
            if any(row.values()):
                rows.append([row.get(i, "") for i in range(max(row) + 1)])
        if rows:
            yield from _cells(f"sheet_{s}", rows[0], [(r + [""] * len(rows[0]))[: len(rows[0])] for r in rows[1:]])


def ofd_facts(raw: bytes) -> Iterator[Fact]:
    """The texts of an OFD file's pages and titles."""
    n = 0
    for name, root in _parts(raw, r"(?i)\.xml$"):
        for e in root.iter():
            if _local(e.tag) in ("TextCode", "Title", "DocTitle") and (text := "".join(e.itertext()).strip()):
                yield "text", name, n, 0, "body", text
                n += 1


def archive_facts(raw: bytes, depth: int = 1, path: str = "") -> Iterator[Fact]:
    """The members of a zip archive and of those within it: part is the path, label ok, locked, unsafe, too_deep or unread, value the size. col_no is the
    depth."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for i, m in enumerate(x for x in z.infolist() if not x.is_dir()):
            at = f"{path}{m.filename}"
            unsafe = m.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", m.filename) or re.match(r"^[A-Za-z]:", m.filename) or (m.external_attr >> 28) == 0xA
            status = "unsafe" if unsafe else "locked" if m.flag_bits & 1 else "too_deep" if depth > MOST_DEPTH else "ok"
            if status == "ok" and m.filename.lower().endswith(".zip"):
                try:
                    yield from archive_facts(z.read(m), depth + 1, f"{at}!")
                except (zipfile.BadZipFile, RuntimeError):
                    status = "unread"
            yield "member", at, i, depth, status, str(m.file_size)


READERS: dict[str, Callable] = {
    "json": json_facts, "csv": csv_facts, "xml": xml_facts, "txt": text_facts, "html": html_facts, "html_runs": html_runs, "eml": email_facts, "eml_lines": email_lines,
    "docx": docx_facts, "pptx": pptx_facts, "xlsx": xlsx_facts, "ofd": ofd_facts, "zip": archive_facts,
}


def read(df: DataFrame, key: str, content: str, kind: str) -> DataFrame:
    """(key, facts): the facts of each content, a text or bytes, by the reader of that kind; rows with a null or empty content give none."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    reader, types = READERS[kind], dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, c in zip(pdf[key], pdf[content]):
                if c is None or len(c) == 0:
                    continue
                try:
                    facts = list(reader(bytes(c) if isinstance(c, (bytes, bytearray, memoryview)) else c))
                except Exception as e:  # noqa: BLE001 - a file that can't be read is a fact about it
                    facts = [("error", "", 0, 0, type(e).__name__, str(e)[:500])]
                out += [(k, *f) for f in facts]
            yield pd.DataFrame(out, columns=[key, "kind", "part", "row_no", "col_no", "label", "value"])

    return df.select(key, content).mapInPandas(run, f"`{key}` {types[key]}, {SCHEMA}")


def read_first(df: DataFrame, key: str, content: str, kinds: list[str]) -> DataFrame:
    """Facts by the first reader, and of contents that it couldn't read by the next: a chain of fallbacks. What no reader can read keeps its last error."""
    facts = read(df, key, content, kinds[0])
    for kind in kinds[1:]:
        failed = facts.where("kind = 'error'").select(key)
        facts = facts.where("kind != 'error'").unionByName(read(df.join(failed, key, "left_semi"), key, content, kind))
    return facts


def preflight(checks: list[tuple]) -> tuple:
    """(allowed, reason) columns of checks given as (column that must hold, reason): reasons of those that don't, joined by semicolons."""
    blocked = F.array_compact(F.array(*[F.when(~ok, reason) for ok, reason in checks]))
    return F.size(blocked) == 0, F.array_join(blocked, "; ")


def archive_gate(members, depth, size, packed, unsafe) -> tuple:
    return preflight([(members <= MOST_MEMBERS, "entry_count exceeds max"), (depth <= MOST_DEPTH, "depth exceeds max"), (size <= MOST_BYTES, "uncompressed_size exceeds max"), (size / F.greatest(packed, F.lit(1)) <= 100, "compression_ratio exceeds max"), (~unsafe, "unsafe path detected")])


def pages_gate(size, pages, embedded, script) -> tuple:
    return preflight([(size <= 500_000_000, "file_size exceeds max"), (pages <= 2000, "page_count exceeds max"), (~embedded, "embedded files not allowed"), (~script, "JavaScript not allowed")])


def image_gate(width, height, channels, frames, size) -> tuple:
    return preflight([((width <= 16384) & (height <= 16384), "dimensions exceed max"), (width * height <= 268_435_456, "pixels exceed max"), (channels <= 4, "channels exceed max"), (frames <= 1, "frames exceed max"), (size <= 200_000_000, "file_size exceeds max")])
