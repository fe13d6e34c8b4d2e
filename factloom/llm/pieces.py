"""Splitting oversized texts at natural boundaries.

A recursive hierarchy of separators (section, paragraph, line, sentence, word, character) cuts a text into atoms that fit the limit;
atoms are packed greedily into pieces, and each piece after the first starts with trailing atoms of the one before, up to the asked
overlap (less where the next atom needs the room, and cut out of an atom only where no boundary lies within the overlap). Joined
without their overlaps the pieces give the text again, character by character. Null and empty texts give no pieces.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import common

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = "v vs no nos nr art arts al abs para paras p pp s ss cl ch sec seq cf ff ibid e.g i.e eg ie etc ca approx mr mrs ms dr prof st sr sra hon jr bzw vgl z.b d.h ggf bd rn az lit núm pág m mme mlle ltd co corp inc plc w.r w r q.b app fig vol ed eds rev gmbh u.a i.v c.f ref tel ext dept est jan feb mar apr jun jul aug sep sept oct nov dec".split()
_CLOSE = r"[\"'”’»›)\]}）」』】》]*"
_END = re.compile(rf"(?:[.!?…]+{_CLOSE}(?=\s|$)|[。！？…．]+{_CLOSE})")
_ABBREVIATION = re.compile(r"(?:^|[\s(\[\"'“„«])([\p{L}][\p{L}.]*)\.$")
_INITIAL = re.compile(r"(?:^|[\s(.])\p{Lu}\.$")
_KNOWN = frozenset(ABBREVIATIONS)
#: Characters before a stop in which an abbreviation is looked for; a longer word is none of the known ones.
_BACK = 2 * max(map(len, ABBREVIATIONS)) + 4


def sentence_ends(text: str) -> list[int]:
    """Offsets just after each sentence of a text, its end included. Line breaks end sentences; stops of abbreviations, initials and ordinals
    before a lower-case word, and stops within numbers don't."""
    out, line_at = [], 0
    for line in text.splitlines(keepends=True) if "\n" in text else [text]:
        body = line.rstrip("\n")
        full = len(body.rstrip())
        for m in _END.finditer(body):
            end = m.end()
            if m.group()[0] == "." and len(m.group().rstrip("\"'”’»›)]}）」』】》")) == 1:
                before, after = body[max(0, m.start() - _BACK) : m.start() + 1], body[end : end + 3].lstrip()
                a = _ABBREVIATION.search(before)
                short = m.group() == "." and ((a and a.group(1).lower() in _KNOWN) or _INITIAL.search(before))
                if end < full and (short or after[:1].islower()):
                    continue
            out.append(line_at + end)
        line_at += len(line)
        if not out or out[-1] < line_at:
            out.append(line_at)
    return out


def longest_sentence(paragraph: str) -> int:
    """Characters of the longest sentence, without surrounding blanks."""
    most, at = 0, 0
    for end in sentence_ends(paragraph):
        most = max(most, len(paragraph[at:end].strip()))
        at = end
    return most


def _cuts(text: str, level: int) -> list[int]:
    if level == 0:
        return [m.end() for m in re.finditer(r"\n{3,}|\n(?=#{1,6} |[IVX]+\. |\p{Lu}[\p{Lu} ]{6,}\n)", text)]
    if level == 1:
        return [m.end() for m in re.finditer(r"\n\n+", text)]
    if level == 2:
        return [m.end() for m in re.finditer(r"\n", text)]
    if level == 3:
        return [m.end() for e in sentence_ends(text) for m in [re.compile(r"\s*").match(text, e)]]
    return [m.end() for m in re.finditer(r"\s+", text)]


SENTENCE, CHARACTER = 3, 5


def atoms(text: str, limit: int, level: int = 0, at: int = 0) -> list[tuple[int, int]]:
    """(end, level) of the parts of a text within the limit, in order, cut at the coarsest separators that give such parts. level is that of the cut:
    0 section, 1 paragraph, 2 line, SENTENCE, 4 word, CHARACTER."""
    if len(text) <= limit:
        return [(at + len(text), max(0, level - 1))] if text else []
    if level >= CHARACTER:
        return [(at + min(i + limit, len(text)), CHARACTER) for i in range(0, len(text), limit)]
    out, begin = [], 0
    for end in [*_cuts(text, level), len(text)]:
        if end > begin:
            out += atoms(text[begin:end], limit, level + 1, at + begin)
            begin = end
    return out


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(begin, end, overlap) of each piece: piece k is text[begin:end], of which the first `overlap` characters repeat the one before.

    Atoms are at most limit - overlap characters, so that every piece has room for the whole overlap. The time grows with the text's length only."""
    if not text:
        return []
    if len(text) <= limit:
        return [(0, len(text), 0)]
    ends = [e for e, _ in atoms(text, max(1, limit - overlap))]
    out, begin, fresh, k = [], 0, 0, 0
    while k < len(ends):
        end = fresh
        while k < len(ends) and ends[k] - begin <= limit:
            end = ends[k]
            k += 1
        out.append((begin, end, fresh - begin))
        fresh = end
        if not overlap:
            begin = end
            continue
        first = 0 if end <= overlap else ends[bisect_left(ends, end - overlap)]  # the first boundary within the overlap, or the end itself
        begin = first if first < end and end - first >= overlap // 2 else max(0, end - overlap)
        if begin == end - overlap and first >= end:
            space = text.find(" ", begin, end)
            begin = space + 1 if 0 <= space < end - 1 else begin
    return out


def pieces(df: DataFrame, key: str, text: str, limit: int = 1800, overlap: int = 200) -> DataFrame:
    """(key, piece_no, begin_at, overlap_chars, piece): the pieces of each text, counted from 1."""
    common.by_value(sys.modules[__name__])
    cut, types = split, dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, n, b, o, t[b:e]) for k, t in zip(pdf[key], pdf[text]) for n, (b, e, o) in enumerate(cut(t, limit, overlap), 1)]
            yield pd.DataFrame(rows, columns=[key, "piece_no", "begin_at", "overlap_chars", "piece"])

    return df.where(F.length(text) > 0).select(key, text).mapInPandas(run, f"`{key}` {types[key]}, piece_no int, begin_at bigint, overlap_chars bigint, piece string")


def below_sentences(paragraph: str, limit: int) -> bool:
    """Whether the hierarchy has to cut below the level of sentences, and does so within a sentence that is too long without its surrounding blanks."""
    return len(paragraph) > limit and any(level > SENTENCE for _, level in atoms(paragraph, limit)) and longest_sentence(paragraph) > limit


def unsplittable(df: DataFrame, key: str, text: str, limit: int = 1800) -> DataFrame:
    """(key, para_no): paragraphs in which the hierarchy of separators has to cut below the level of sentences."""
    common.by_value(sys.modules[__name__])
    below, types = below_sentences, dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, n) for k, t in zip(pdf[key], pdf[text]) for n, p in enumerate(t.split("\n\n"), 1) if below(p, limit)]
            yield pd.DataFrame(rows, columns=[key, "para_no"])

    return df.where(F.length(text) > 0).select(key, text).mapInPandas(run, f"`{key}` {types[key]}, para_no bigint")
