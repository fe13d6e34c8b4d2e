"""Text of scanned pages: running heads and page numbers out, split words joined, misread characters repaired.

Heads are found by fuzzy repetition of lines at page edges: a line's skeleton (letters that scans confuse folded together, digits
masked) that recurs, or comes within an edit distance of FUZZY of the most repeated one of its edge, on several pages of one document, or at
the edges of the corpus's pages, and hardly ever within pages. Page numbers are
edge lines of a number form whose value follows the pages' sequence. Line ends are joined by the corpus vocabulary: a hyphen goes if
the joined word is commoner than the hyphenated one. A word is misread if a much commoner word of the corpus has the same skeleton
and turns into it by known confusions. Counts run over all texts. Null and empty texts have no lines to report.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import common
from factloom.operators.common import guarded_broadcast, materialized

# What is printed and what scans read instead.
CONFUSIONS = [("o", "0"), ("l", "1"), ("s", "5"), ("b", "6"), ("B", "8"), ("g", "9"), ("i", "!"), ("m", "rn"), ("d", "cl"), ("w", "vv"), ("h", "li"), ("u", "ii"), ("t", "f"), ("e", "c"), ("i", "l"), ("I", "l"), ("l", "I"), ("li", "h"), ("cl", "d"), ("rn", "m"), ("O", "0"), ("S", "5"), ("I", "1"), ("c", "e"), ("f", "t"), ("i", "1"), ("q", "9"), ("z", "2"), ("a", "4"), ("n", "ri"), ("fi", "fl")]
HYPHENS = "-‐‑¬­"
_TOKEN = r"[\p{L}\d!]*\p{L}[\p{L}\d!]*(?:['’][\p{L}\d!]*\p{L}[\p{L}\d!]*)*(?:-[\p{L}\d!]*\p{L}[\p{L}\d!]*)*"
_TAIL = r"([\p{L}\d!][\p{L}\d!'’-]*)[-‐‑¬\x{AD}]\s*$"
_HEAD = r"^\s*([\p{L}\d!][\p{L}\d!'’-]*)"
#: A repair must be this many times as common as what it replaces; one with a digit or mark inside only has to occur.
COMMONER = 15
#: Edit distance up to which a line counts as the document's head, as a share of the head's length; lines shorter than SHAPE are too common to be heads.
FUZZY, SHAPE = 0.15, 7


def skeleton(word: Column) -> Column:
    """Words that scans confuse have one skeleton."""
    s = F.translate(F.lower(word), "!1i|05689fqe2", "llllosbbgtgcz")
    for many, one in (("rn", "m"), ("rl", "n"), ("cl", "d"), ("vv", "w"), ("ll", "h"), ("u", "h")):
        s = F.regexp_replace(s, many, one)
    return s


def _reads_as(printed: str, read: str) -> bool:
    """Whether a printed word turns into the word read by at least one known confusion."""
    a, b = printed, read
    seen, todo = set(), [(0, 0)]
    while todo:
        i, j = todo.pop()
        if (i, j) in seen:
            continue
        seen.add((i, j))
        if i == len(a) and j == len(b):
            return a != b
        if i < len(a) and j < len(b) and a[i].lower() == b[j].lower():
            todo.append((i + 1, j + 1))
        for x, y in CONFUSIONS:
            if (a.startswith(x, i) or a[i : i + len(x)].lower() == x.lower()) and (b.startswith(y, j) or b[j : j + len(y)].lower() == y.lower()):
                todo.append((i + len(x), j + len(y)))
    return False


def lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line_no, line): the lines of each text, counted from 1."""
    return df.where(F.length(text) > 0).select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("_n", "line")).select(*keys, (F.col("_n") + 1).alias("line_no"), "line")


def pages_of(text: str, pages: str) -> Column:
    """The texts of the pages, if they make up the whole text when joined by line feeds; else the whole text as one page."""
    parts = F.when(F.size(pages) > 0, F.transform(F.col(pages), lambda p: F.coalesce(p["page_text"], F.lit(""))))
    return F.when(F.array_join(parts, "\n") == F.col(text), parts).otherwise(F.array(F.col(text)))


def page_lines(df: DataFrame, keys: list[str], pages: str) -> DataFrame:
    """(keys, line_no, line, page, top, bottom, leading, shape): the lines of page texts that aren't blank, with their page and their place among
    its lines that aren't, counted from either edge; leading marks the lines before a page's first blank one; shape is the line's skeleton at the
    edges and its digest elsewhere. Places are counted within each page's array, so nothing is shuffled."""
    ended = F.transform(F.col(pages), lambda t: F.size(F.split(t, "\n")))
    starts = F.aggregate(ended, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    base = df.select(*keys, starts.alias("_starts"), F.posexplode(pages).alias("page", "_t")).select(*keys, "page", F.col("_starts")[F.col("page")].alias("_start"), F.split("_t", "\n").alias("_lines"))
    full = F.filter(F.transform("_lines", lambda line, i: F.struct(i.alias("i"), line.alias("line"))), lambda x: F.length(F.trim(x["line"])) > 0)
    base = base.select(*keys, "page", "_start", F.array_position(F.transform("_lines", lambda x: F.length(F.trim(x)) == 0), True).alias("_blank"), full.alias("_full"))
    rows = base.select(*keys, "page", "_start", "_blank", F.size("_full").alias("_all"), F.posexplode("_full").alias("_pos", "_x"))
    rows = rows.select(*keys, (F.col("_start") + F.col("_x.i") + 1).cast("int").alias("line_no"), F.col("_x.line").alias("line"), "page", (F.col("_pos") + 1).alias("top"), (F.col("_all") - F.col("_pos")).alias("bottom"), ((F.col("_blank") == 0) | (F.col("_x.i") + 1 < F.col("_blank"))).alias("leading"))
    shape = F.regexp_replace(skeleton(F.regexp_replace(F.regexp_replace(F.trim("line"), r"\d+", "#"), r"\b\p{Lu}{1,3}\.? #", "#")), r"\s+", " ")
    rows = rows.select("*", shape.alias("shape"))
    return rows.withColumns({"long": F.length("shape") >= SHAPE, "shape": F.when((F.col("top") <= 4) | (F.col("bottom") <= 3), F.col("shape")), "digest": F.xxhash64("shape")})


_NUMBER = r"^[\s\[(–—-]*(?:(?:pagc|page|seite|scite|s|p|pp|pag|pág|página|blatt|nr|no)\b[\s.]*)?([0-9lIOoSB]{1,4}|[ivxlc]{1,6})(?:\s*(?:/|of|0f|von|de|sur)\s*[0-9lIOoSB]{1,4})?[\s\])–—-]*$"


def _edge_numbers(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edge lines of a number form whose value follows the sequence of the document's pages."""
    low = F.lower(F.trim("line"))
    shown = F.regexp_extract(F.trim("line"), "(?i)" + _NUMBER, 1)
    digits = F.translate(shown, "lIOoSB", "110058")
    roman = F.lower(shown)
    of_roman = sum((F.length(roman) - F.length(F.regexp_replace(roman, c, ""))) * v for c, v in (("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100)))
    less = sum(F.when(roman.contains(p), v).otherwise(0) for p, v in (("iv", 2), ("ix", 2), ("xl", 20), ("xc", 20)))
    value = F.when(shown.rlike(r"\d|^l+$"), digits.try_cast("int")).when(roman.rlike("^[ivxlc]+$"), of_roman - less).otherwise(digits.try_cast("int"))
    marked = low.rlike(r"^[\[(–—-]|^(?:pag|sei|sci|p\b|s\b|pá)|/|\bof\b")
    found = edges.where(((F.col("top") <= 3) | (F.col("bottom") <= 2)) & F.trim("line").rlike("(?i)" + _NUMBER)).withColumns({"_value": value, "_marked": marked}).where("_value IS NOT NULL")
    found = found.withColumn("_offset", F.col("_value") - F.col("page"))
    per = found.groupBy(*keys, "_offset").agg(F.countDistinct("page").alias("_hits"), F.max("_marked").alias("_m"))
    best = per.groupBy(*keys).agg(F.max(F.struct("_hits", F.col("_m"), (-F.abs(F.col("_offset") - 1)).alias("near"), F.col("_offset").alias("o"))).alias("_best"))
    return found.join(best, keys).where(F.col("_offset") == F.col("_best.o")).select(*keys, "line_no", F.lit("page_number").alias("kind"))


def _close(shape: Column, head: Column) -> Column:
    """Whether a skeleton is the head's, or comes within the edit distance FUZZY of it."""
    return F.coalesce((shape == head) | ((F.length(head) >= SHAPE) & (F.levenshtein(shape, head) <= F.length(head) * FUZZY)), F.lit(False))


def furniture(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, kind): running heads and page numbers among page_lines."""
    edge = (F.col("top") <= 3) | (F.col("bottom") <= 3)
    slim = rows.select(*keys, "line_no", "page", "top", "bottom", "leading", "shape", "long", "digest", F.when(edge | (F.col("top") <= 4), F.col("line")).alias("line"))
    numbers = _edge_numbers(slim.where(edge), keys).distinct()
    near = slim.where(edge | (F.col("top") <= 4)).join(numbers.select(*keys, "line_no", F.lit(True).alias("_number")), [*keys, "line_no"], "left").where("_number IS NULL")
    corpus = rows.where("long").groupBy("digest").agg(F.count_if(edge).alias("_at_edge"), F.count("*").alias("_all")).where("_at_edge > 0")
    # the caption is the last of the first page's leading lines; lines before it are furniture
    lead = near.where((F.col("page") == 0) & F.col("leading") & (F.col("top") <= 4))
    caption = lead.groupBy(*keys).agg(F.max(F.struct("line_no", "shape")).alias("_c")).select(*keys, F.col("_c.line_no").alias("_cline"), F.col("_c.shape").alias("_cshape"))
    own = near.where(edge & F.col("long")).withColumn("side", F.when(F.col("top") <= 3, "top").otherwise("bottom"))
    # the skeleton that stands on most pages of a document, at either edge
    seen = own.groupBy(*keys, "side", "shape").agg(F.count_distinct("page").alias("_pages"))
    heads = seen.groupBy(*keys, "side").agg(F.max(F.struct("_pages", F.col("shape").alias("h"))).alias("_h")).where("_h._pages >= 2").select(*keys, "side", F.col("_h.h").alias("_head"))
    own = own.join(seen, [*keys, "side", "shape"]).join(heads, [*keys, "side"], "left").join(caption, keys, "left").join(corpus, "digest")
    is_caption = (F.col("line_no") == F.col("_cline")) & (F.col("page") == 0)
    place = (F.col("top") <= 2) | (F.col("bottom") <= 2)
    open_end = ~F.trim("line").rlike(r"[.;,:]$")
    everywhere = (F.col("_at_edge") >= 2) & (F.col("_at_edge") >= 0.9 * F.col("_all")) & F.trim("line").rlike(r"\d")
    repeated = (F.col("_pages") >= 2) | _close(F.col("shape"), F.col("_head")) | (_close(F.col("shape"), F.col("_cshape")) & (F.col("page") > 0))
    inside = F.col("_all") - F.col("_at_edge") <= 0.1 * F.col("_all")
    head = place & open_end & (everywhere | (repeated & inside)) & ~F.coalesce(is_caption, F.lit(False))
    return own.where(head).select(*keys, "line_no", F.lit("running_head").alias("kind")).distinct().unionByName(numbers)


def _ends(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Body lines with the first part of a split word at their end (_a) and the second part from the next body line at its begin (_b)."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    a = F.nullif(F.regexp_extract("line", _TAIL, 1), F.lit(""))
    rows = rows.withColumn("_a", a).withColumns({"_next": F.lead("line").over(w), "_next_no": F.lead("line_no").over(w), "_before": F.lag("_a").over(w)})
    return rows.withColumn("_b", F.when(F.col("_a").isNotNull(), F.nullif(F.regexp_extract("_next", _HEAD, 1), F.lit(""))))


def _tokens(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, word): the words of body lines without the parts of split words."""
    kept = F.when(F.col("_b").isNotNull(), F.regexp_replace("line", _TAIL, "")).otherwise(F.col("line"))
    kept = F.when(F.col("_before").isNotNull(), F.regexp_replace(kept, _HEAD, "")).otherwise(kept)
    return rows.select(*keys, "line_no", F.explode(F.regexp_extract_all(kept, F.lit(f"({_TOKEN})"), 1)).alias("word")).withColumn("word", F.regexp_replace("word", "!+$", ""))


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, n): lower-case words of the corpus and how often each occurs."""
    return words.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))


def repairs(vocab: DataFrame) -> DataFrame:
    """(word, right): words that are misreadings of a commoner word, and that word."""
    common.by_value(sys.modules[__name__])
    sk = vocab.where(F.length("word") > 1).withColumns({"_s": skeleton(F.col("word")), "_odd": F.col("word").rlike(r"[\d!]")})
    best = sk.where("NOT _odd").groupBy("_s").agg(F.max(F.struct("n", F.col("word").alias("right"))).alias("_best"))
    close = sk.join(best, "_s").where((F.col("word") != F.col("_best.right")) & (F.col("_odd") | (F.col("_best.n") >= COMMONER * F.col("n"))))
    check = _reads_as

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[check(r, w) for r, w in zip(pdf["right"], pdf["word"])]]

    return close.select("word", F.col("_best.right").alias("right")).mapInPandas(run, "word string, right string")


def decided(ends: DataFrame, vocab: DataFrame, fixes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, next_no, a, b, joined, right): split words with the corpus's decision; joined is null for a hyphen that stays."""
    cut = ends.where("_a IS NOT NULL AND _b IS NOT NULL").select(*keys, "line_no", F.col("_next_no").alias("next_no"), F.col("_a").alias("a"), F.regexp_replace("_b", r"[-'’!]+$", "").alias("b"), F.regexp_extract("line", r"([-‐‑¬\x{AD}])\s*$", 1).alias("mark"))
    low = F.lower(F.concat("a", "b"))
    cut = cut.withColumns({"_one": low, "_two": F.lower(F.concat("a", F.lit("-"), "b"))})
    one = vocab.select(F.col("word").alias("_one"), F.col("n").alias("_n1"))
    two = vocab.select(F.col("word").alias("_two"), F.col("n").alias("_n2"))
    good = fixes.select(F.col("word").alias("_one"), F.col("right").alias("_r1"))
    cut = cut.join(one, "_one", "left").join(two, "_two", "left").join(good, "_one", "left")
    n1, n2 = F.coalesce(F.col("_n1"), F.lit(0)), F.coalesce(F.col("_n2"), F.lit(0))
    capital = F.col("b").rlike(r"^\p{Lu}\p{Ll}") & F.col("a").rlike(r"\p{Ll}")
    split = F.when(n1 + n2 > 0, n1 >= n2).otherwise(F.col("_r1").isNotNull() | ((F.col("mark") != "-") | ~capital))
    return cut.select(*keys, "line_no", "next_no", "a", "b", F.when(split, F.concat("a", "b")).alias("joined"), F.when(split, F.col("_r1")).alias("right"))


def repaired_parts(results: DataFrame, blocks: DataFrame) -> dict[str, DataFrame]:
    """All findings of scanned texts. results: (row_id, pages); blocks: (row_id, text). Frames with the key (src, row_id): `furniture`
    (line_no, kind), `cuts` (line_no, next_no, a, b, joined, right) and `misread` (line_no, word, right)."""
    keys = ["row_id"]
    rows = materialized(page_lines(results, keys, "pages"))
    found = materialized(furniture(rows, keys))
    body = rows.join(found.select(*keys, "line_no").distinct(), [*keys, "line_no"], "left_anti").select(*keys, "line_no", "line")
    ends = _ends(body, keys).withColumn("src", F.lit("result")).unionByName(_ends(lines(blocks, keys, "text").where(F.length(F.trim("line")) > 0), keys).withColumn("src", F.lit("block")))
    ends, both = materialized(ends), ["src", *keys]
    words = _tokens(ends, both)
    vocab = materialized(vocabulary(words))
    fixes = guarded_broadcast(materialized(repairs(vocab)))
    cuts = decided(ends, vocab, fixes, both)
    plain = words.withColumn("_low", F.lower("word")).join(fixes.withColumnRenamed("word", "_low"), "_low").select(*both, "line_no", "word", "right")
    # a misread split word: the line that holds the part which differs
    odd = cuts.where("right IS NOT NULL").withColumns({"_a": F.lower("a"), "_b": F.lower("b")})
    first = odd.where("NOT startswith(right, _a)").select(*both, "line_no", F.col("a").alias("word"), "right")
    second = odd.where("startswith(right, _a) OR NOT endswith(right, _b)").select(*both, F.col("next_no").alias("line_no"), F.col("b").alias("word"), "right")
    return {"furniture": found.withColumn("src", F.lit("result")).select(*both, "line_no", "kind"), "cuts": cuts, "misread": plain.unionByName(first).unionByName(second)}


def _cased(word: str, right: str) -> str:
    letters = [c for c in word if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return right.upper()
    return right[:1].upper() + right[1:] if word[:1].isupper() else right


def repaired_text(lines: list[str], edits: list) -> str:
    """Paragraphs of a text without its furniture, with split words joined and misread words repaired. Edits are rows with kind, line_no,
    and for cuts next_no, a, b, joined, for misread words word and right."""
    drop = {e["line_no"] for e in edits if e["kind"] == "drop"}
    text = {n: line for n, line in enumerate(lines, 1) if n not in drop}
    for e in edits:
        if e["kind"] == "misread" and e["line_no"] in text:
            text[e["line_no"]] = re.sub(rf"(?<![\w!]){re.escape(e['word'])}(?![\w])", lambda m, e=e: _cased(e["word"], e["right"]), text[e["line_no"]])
    for e in sorted((e for e in edits if e["kind"] == "cut"), key=lambda e: e["line_no"]):
        n, m = e["line_no"], e["next_no"]
        if n in text and m in text:
            head = re.match(r"\s*(\S+)", text[m])
            tail = text[n].rstrip()
            if head and tail and tail[-1] in HYPHENS:
                whole = tail[:-1] + ("" if e["joined"] else "-") + head.group(1)
                if e["joined"] and e["right"]:
                    whole = re.sub(r"[^\W\d_][\w!'’-]*(?=\W*$)", lambda w, e=e: _cased(w.group(), e["right"]), whole)
                text[n], text[m] = whole, text[m][head.end() :].lstrip()
    paragraphs: list[str] = []
    fresh = True
    for n in sorted(text):
        line = text[n].rstrip()
        body = line.strip()
        if not body:
            fresh = True
            continue
        begins = bool(re.match(r"\s*(?:[\[(]\d+[\])]|\d+\.)\s|\s{2,}\S", line))
        open_end = bool(paragraphs) and not re.search(r"[.!?:;…]\W*$", paragraphs[-1])
        if paragraphs and (not fresh and (open_end or not begins) or open_end and body[:1].islower()):
            paragraphs[-1] += " " + body
        else:
            paragraphs.append(body)
        fresh = False
    return "\n\n".join(paragraphs)


def repaired(results: DataFrame, blocks: DataFrame) -> DataFrame:
    """(src, row_id, repaired): every scanned text as continuous paragraphs. Texts without findings keep their words."""
    common.by_value(sys.modules[__name__])
    parts, none = repaired_parts(results, blocks), lambda *names: [F.lit(None).cast(t).alias(n) for n, t in names]
    s, i = "string", "int"
    drop = parts["furniture"].select("src", "row_id", F.lit("drop").alias("kind"), "line_no", *none(("next_no", i), ("joined", s), ("word", s), ("right", s)))
    cut = parts["cuts"].select("src", "row_id", F.lit("cut").alias("kind"), "line_no", "next_no", "joined", *none(("word", s)), "right")
    mis = parts["misread"].select("src", "row_id", F.lit("misread").alias("kind"), "line_no", *none(("next_no", i), ("joined", s)), "word", "right")
    edits = drop.unionByName(cut).unionByName(mis).groupBy("src", "row_id").agg(F.collect_list(F.struct("kind", "line_no", "next_no", "joined", "word", "right")).alias("edits"))
    texts = results.select(F.lit("result").alias("src"), "row_id", F.array_join("pages", "\n").alias("text")).unionByName(blocks.select(F.lit("block").alias("src"), "row_id", "text"))
    fix = repaired_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["src", "row_id"]].assign(repaired=[fix(t.split("\n"), list(e) if e is not None else []) for t, e in zip(pdf["text"], pdf["edits"])])

    return texts.where(F.length("text") > 0).join(edits, ["src", "row_id"], "left").mapInPandas(run, "src string, row_id bigint, repaired string")
