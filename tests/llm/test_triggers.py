"""Every branch of every detector pattern gives texts at which the linear-time form of the pattern stops too."""

from __future__ import annotations

import re
from re import _constants as c
from re import _parser as parser

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from factloom.llm import residue


def _each(items, groups):
    """Texts of a parsed pattern: every branch occurs, one place varied at a time."""
    out = [""]
    for op, arg in items:
        if op is c.LITERAL:
            own = [chr(arg)]
        elif op is c.IN:
            own = [_of_set(arg)]
        elif op is c.ANY:
            own = [" "]
        elif op is c.NOT_LITERAL:
            own = ["q"]
        elif op is c.BRANCH:
            own = [t for x in arg[1] for t in _each(x, groups)]
        elif op is c.SUBPATTERN:
            own = _each(arg[3], groups)
            groups[arg[0]] = own[0]
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            one = _each(arg[2], groups)
            own = [t * max(arg[0], 1) for t in one] + [""] * (arg[0] == 0)
        elif op is c.GROUPREF:
            own = [groups[arg]]
        else:
            own = [""]
        out = [out[0] + t for t in own] + [t + own[0] for t in out[1:]]
    return out


def _of_set(arg):
    for op, x in arg:
        if op is c.NEGATE:
            return "q" if any(k is c.CATEGORY for k, _ in arg) else " "
        if op is c.LITERAL:
            return chr(x)
        if op is c.RANGE:
            return chr(x[0])
        return {c.CATEGORY_SPACE: " ", c.CATEGORY_DIGIT: "7", c.CATEGORY_NOT_SPACE: "q", c.CATEGORY_NOT_WORD: "(", c.CATEGORY_WORD: "q"}[x]


PATTERNS = [p for ps in residue.KINDS.values() for p in ps]


@pytest.mark.parametrize("n", range(len(PATTERNS)))
def test_linear_form_stops_at_every_example(n):
    p = re.compile(residue._anchored(PATTERNS[n]))
    texts = [t for x in _each(parser.parse(PATTERNS[n]), {}) for t in (x, f"({x})", f"so: {x};", f"So held. {x}", f"\u2003{x}\u2003") if p.search(t)]
    stop = pc.match_substring_regex(pa.array(texts), residue.linear(PATTERNS[n].removeprefix("(?i)")), ignore_case=PATTERNS[n].startswith("(?i)")).to_pylist()
    assert texts and [t for t, s in zip(texts, stop) if not s] == []


def test_repetition_is_measured():
    assert [residue.period(t.split()) for t in ("a b a b a", "a a", "a b", "a b c a b", "a", "")] == [2, 1, 2, 5, 1, 0]
    assert residue.units("Paragraph 1. Soon.\n\nParagraph 2. Soon.\nOnce", False) == ([("Paragraph 9. Soon.", True)], False)
    assert residue.units("no no no no no no", True) == ([("no", True)], True) and residue.units("- - - - - - -", False) == ([("-", True)], False)


def test_slug_is_compared_with_title_and_body():
    title, body = "Court\nHB 2019/12\n", "x" * 200 + "\nas held in hb-2019/12"
    assert [residue.compared("HB 2019/12", t) for t in (title, title + body, body, "HB 2019/123", "")] == [(True, False), (True, True), (False, True), (False, False), (False, False)]
    assert residue.compared(None, title) == residue.compared(" - ", title) == (False, False)


@pytest.mark.parametrize("text", ["Aliquam ornare velit porta nibh eget quisque", "[ enter the date ]", "[ name of party]", "signed on DD/MM/YY", "value NULL", "NULL", "(NaN)", "sum; NaN;", "foo-bar-baz", "(gone, request 7)"])
def test_forms_are_detected(text):
    assert [n for n, _ in residue.Detector()(text)] == [1]


@pytest.mark.parametrize("fill", [0, 40])
def test_forms_over_a_sentence_end_are_detected_at_any_length(fill):
    before, after = "The appeal was heard in open court. " * fill, " The appeal was heard." * fill
    assert residue.Detector()(f"{before}Service unavailable. Please try again later{after}") == [(1, "error_page")]
    assert residue.Detector()(f"{before}As pleaded, service unavailable. Please try again later{after}") == []
