"""Exact forms of personal items: the check after the model's spans, and the labels of its training texts."""

from __future__ import annotations

import regex as re

from factloom.llm.pii_model import fold

_E = r"(?<![\w.+-])[A-Za-z0-9_+-]+(?:\.[A-Za-z0-9_+-]+)*\s?(?:@|\[at\]|\(at\))\s?[A-Za-z0-9-]+(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)[A-Za-z0-9-]+)*(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)[A-Za-z]{2,}(?![\w@])"
_IBAN = r"(?<![A-Za-z0-9])[A-Za-z]{2}\d{2}[ ]?[A-Za-z]{4}(?:[ ]?\d{4}){3}[ ]?\d{2}(?![A-Za-z0-9])"
_ACCOUNT = rf"{_IBAN}|(?<![\d-])\d{{2}}-\d{{2}}-\d{{2}}[ ]\d{{8}}(?!\d)|(?<![\d/])\d{{10}}/\d{{4}}(?![\d/])"
_IDENTITY = (
    r"(?<![\d.-])\d{17}[\dXx](?![\d-])|(?<![A-Za-z0-9])[A-Za-z]{2}\d{7}(?![A-Za-z0-9])|(?<![\d.*-])\d{3}-\d{2}-\d{4}(?![\d-])|(?<![\d.*-])\d{3} \d{2} \d{4}(?![\d])|(?<![A-Za-z0-9-])\d{8}-?[A-Z](?![A-Za-z0-9])"
    r"|(?<![\d.])\d{15}(?!\d)|(?<![\d.])\d \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}(?!\d)|(?<![A-Za-z0-9])[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d](?![A-Za-z0-9])"
)
_EXT = r"(?:\s?(?:ext\.?|x)\s?\d{1,5})?"
_PHONE = (
    rf"(?<![\w+*])\+\d{{1,3}}(?:[ .-]?\(0\)|[ .-]?\(\d{{2,4}}\))?(?:[ ./-]?\d{{1,4}}){{2,6}}{_EXT}(?![\d/])|(?<![\w+])\(0\d{{2,5}}\)[ ]?\d[\d ]{{4,9}}\d{_EXT}(?!\d)|(?<![\w/.-])0\d{{1,4}}[/ -]\d{{3,8}}(?:[ -]\d{{2,5}}){{0,3}}{_EXT}(?![\d/])"
    rf"|(?<![\w./-])0\d(?:[. ]\d{{2}}){{4}}{_EXT}(?!\d)|(?<![\w./-])1?[-. ]?\(?\d{{3}}\)?[-. ]\d{{3}}[-. ]\d{{4}}{_EXT}(?![\d/])|(?<![\w./-])0\d{{9,10}}{_EXT}(?!\d)"
)
_L = r"[\p{L}\p{M}]"
_W = rf"\p{{Lu}}{_L}+"
_LOW = r"\p{Lu}\p{Ll}+"
_PLACE = rf"{_LOW}(?:[- ](?:on|upon|am|sur|an der)?-?{_LOW})*"
_STREETS = r"(?:Street|St|Terrace|Ter|Lane|Ln|Road|Rd|Avenue|Ave|Row|Close|Gardens|Walk|Way|Drive|Mews|Hill|Square|Place|Court|Crescent|Quay|Parade|Grove|Boulevard|Blvd|Highway|Pl|Sq|Dr|Cres|Ct|Gdns)"
_HOUSES = r"(?:Cottage|House|Lodge|Farm|Hall|Manor|Villa|Barn|Mill|Court)"
_UNITS = r"(?:Flat|Unit|Apt\.?|Apartment|Suite|Ste\.?|Room|Level)"
_TAIL = rf"(?:,\s+(?:{_PLACE} [A-Z]{{1,2}}\d\w? \d[A-Z]{{2}}|{_UNITS} ?\w+|\d*\w? ?\d{{0,5}} ?{_PLACE}|{_PLACE}(?: [A-Z]{{1,2}}\d\w? \d[A-Z]{{2}})?|[A-Z]{{2}} \d{{4,5}}))*"
_ADDRESS = (
    rf"(?:(?:{_UNITS}\s?\w+,\s+)?(?:\d+\w?,?\s+(?:{_W}\s+)*{_W}\s+{_STREETS}\b\.?|{_W}(?:\s{_W})?\s{_HOUSES},\s+(?:{_W}\s+)+{_STREETS}\b\.?){_TAIL})"
    rf"|(?:C/|Calle|Avda\.?|Plaza|Paseo)\s?(?:{_W}|de|la|del|los|las)(?:\s(?:{_W}|de|la|del|los|las))*[,]?\s+(?:n\.?[ºo°]\s?)?\d+(?:,\s+\d+\.?[ºo°]\s?\w+)?(?:,\s+\d{{5}}\s+{_PLACE})?"
    rf"|\d+(?:\s(?:bis|ter))?,?\s+(?:rue|avenue|boulevard|place|impasse|allée|allee|quai|chemin|cours)\s+[\p{{L}}' -]+?,\s+\d{{5}}\s+{_PLACE}"
    rf"|(?:Am|An der|Im|Zum|Zur|Auf der|In der|Unter den|Beim)\s{_W}(?:\s{_W})?\s+\d+\w?,\s+\d{{5}}\s+{_PLACE}"
    rf"|{_W}(?:er|[-\s]{_W})?(?:straße|strasse|strabe|stra.e|gasse|weg|allee|platz|ufer|damm|\s(?:Straße|Strasse|Stra.e|Weg|Allee|Platz|Gasse|Ufer|Damm|Ring))\s+\d+\w?,\s+\d{{5}}\s+{_PLACE}"
)
EXACT = {k: re.compile(v) for k, v in (("email", _E), ("account", _ACCOUNT), ("identity", _IDENTITY), ("phone", _PHONE), ("address", _ADDRESS))}

# Titles that stand before a name and don't belong to it.
TITLES = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Dame|Lord|Lady|Judge|Justice|Herr|Frau|Mme|Mlle|Sr|Sra|Srta|Don|Doña|Dona|MR|MRS|MS|DR|PROF|JUDGE|JUSTICE|HERR|FRAU|MME|SR|SRA)"
_PART = r"(?:(?:van der|van den|van|von der|von|de la|de|du|del|della|VAN DER|VON|DE LA|Van Der|Von|De La)\s+)?"
_SUR = rf"{_PART}(?:[OD]'\s?)?{_W}(?:-(?:[OD]')?{_W})*"
NAME = re.compile(
    rf"(?P<plain>{_W}(?:\s\p{{Lu}}\.)?\s{_SUR})|(?P<last>{_SUR},\s{_W}(?:\s\p{{Lu}}\.)?(?!{_L}))|(?P<initial>(?:\p{{Lu}}\.\s?)+{_SUR})|(?P<single>{_SUR})"
)
_TITLED = re.compile(rf"\b{TITLES}\.?\s+$")
_LEADING = re.compile(rf"^(?:{TITLES}\.?\s+)+")


def exact(kind: str, text: str, begin: int, end: int, margin: int = 40) -> tuple[int, int] | None:
    """The exact form that overlaps a span of the model most, or None. `text` is folded."""
    at = max(0, begin - margin)
    best = None
    for m in EXACT[kind].finditer(text, at, min(len(text), end + margin)):
        both = min(end, m.end()) - max(begin, m.start())
        if both > 0 and (best is None or both > best[0]):
            best = (both, m.start(), m.end())
    return best and best[1:]


def person(text: str, begin: int, end: int) -> tuple[int, int] | None:
    """A span of the model cut to a person's name without title, or None: a given name or initial with a surname, or a surname after a title."""
    while begin < end and not text[begin].isalpha():
        begin += 1
    while begin > 0 and (text[begin - 1].isalpha() or text[begin - 1] in "'-") and text[begin].isalpha():
        begin -= 1
    while end < len(text) and (text[end].isalpha() or (text[end] in "-'" and end + 1 < len(text) and text[end + 1].isalpha())):
        end += 1
    if m := _LEADING.match(text[begin:end]):
        if m.end() < end - begin:
            begin += m.end()
    m = NAME.match(text, begin, end)
    if not m or m.end() - m.start() < 3:
        return None
    if m.lastgroup == "single" and not _TITLED.search(text[max(0, begin - 12) : begin]):
        if re.match(r"(?:van der|van|von|de la|de|du|del)\s", m.group(), re.I) and m.end() - begin > 8:
            return begin, m.end()
        return None
    return m.start(), m.end()


INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u0301\u0308\u0303\u030a\u0300\u0302"


def _visible(text: str) -> tuple[str, list[int] | range]:
    """The folded text without invisible characters and loose accents, and the place of each of its characters in the text."""
    if text.isascii():
        return text, range(len(text) + 1)
    at = [i for i, c in enumerate(text) if c not in INVISIBLE]
    flat = fold(text)
    return "".join([flat[i] for i in at]), [*at, len(text)]


def checked(text: str, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The model's spans after the exact check, without overlaps; a name within another item is left out."""
    if not found:
        return []
    flat, at = _visible(text)
    place = {p: i for i, p in enumerate(at)}
    near = lambda p: next(place[q] for q in range(p, len(text) + 1) if q in place)
    out: list[tuple[str, int, int]] = []
    order = {"email": 0, "account": 1, "identity": 2, "phone": 3, "address": 4, "name": 5}
    for kind, b, e in sorted(found, key=lambda s: (order[s[0]], s[1])):
        b, e = near(b), near(e)
        hit = person(flat, b, e) if kind == "name" else exact(kind, flat, b, e)
        if hit is None and kind in ("phone", "identity", "account"):
            for other in ("account", "identity", "phone"):
                if other != kind and (hit := exact(other, flat, b, e, 4)):
                    kind = other
                    break
        if hit and hit[0] < hit[1] and all(hit[1] <= x[1] or hit[0] >= x[2] for x in out):
            out.append((kind, *hit))
    return [(k, at[b], at[e - 1] + 1) for k, b, e in sorted(out, key=lambda s: s[1])]


_FORMS = [(g, re.compile(p)) for g, p in (("last", rf"{_SUR},\s{_W}(?:\s\p{{Lu}}\.)?(?!{_L})"), ("plain", rf"{_W}(?:\s\p{{Lu}}\.)?\s{_SUR}"), ("initial", rf"(?:\p{{Lu}}\.\s?)+{_SUR}"), ("single", _SUR))]


def label(text: str, given: set[str], surnames: set[str]) -> list[tuple[str, int, int]]:
    """Labelled spans of a training text: the exact forms, and names whose parts are known from a clean name column."""
    flat, at = _visible(text)
    out: list[tuple[str, int, int]] = []

    def add(kind: str, b: int, e: int) -> bool:
        free = all(e <= x[1] or b >= x[2] for x in out)
        if free:
            out.append((kind, b, e))
        return free

    for kind in ("email", "account", "identity", "phone", "address"):
        for m in EXACT[kind].finditer(flat):
            add(kind, m.start(), m.end())
    done = 0
    for start in re.finditer(rf"(?<![\p{{L}}'])(?:(?:van der|van|von|de la|de)\s)?\p{{Lu}}", flat):
        b = start.start()
        if b < done:
            continue
        titled = bool(_TITLED.search(flat[max(0, b - 12) : b]))
        for form, pattern in _FORMS:
            m = pattern.match(flat, b)
            words = [w.lower() for w in re.findall(rf"{_L}{{2,}}", m.group())] if m else []
            first, last, known = words[:1], words[-1:], [w for w in words if w in surnames]
            if not known or {*first} & _TITLE_WORDS:
                continue
            if {"last": last and last[0] in given and words[0] not in given, "plain": first and first[0] in given, "initial": True, "single": titled}[form] and add("name", b, m.end()):
                done = m.end()
                break
    return [(k, at[b], at[e - 1] + 1) for k, b, e in sorted(out, key=lambda s: s[1])]


_TITLE_WORDS = {w.lower() for w in re.findall(r"\w+", TITLES)}
