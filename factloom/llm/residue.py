"""Documents that are, wholly or in part, template residue, filler, error pages or script notices instead of content.

Every document is read whole, once. Its address slug (docket number) is compared with the terms of its title and of its body; where neither
holds it, the document is mismatched. Its information is measured as repetition: a text or line that is one unit said over and over, or a
line that recurs within the document, is worth no more than the unit. Detectors of placeholders, filler, site errors and script notices
read every line.

Over the corpus, the lines and units of mismatched documents are counted by ruling and by host (source). One that recurs over several
rulings and several hosts, mostly in mismatched documents, is a stock response if it is low in information or if detectors found residue
in most of the documents that hold it; it flags every mismatched document that holds it, and every other document in which it stands as
repetition. A short genuine decision also recurs over rulings and hosts, but repeats nothing and goes along with no residue. A detector's
finding flags its document by itself. Quoted parts are not read; what a sentence reports with a verb of saying before it doesn't count.
Null and empty texts are not flagged: there is nothing in them to exclude. Documents without a slug count as mismatched.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import common
from factloom.operators.common import materialized

# Forms of unfilled placeholders and drafting instructions.
PLACEHOLDERS = [
    r"\{\{\s*[#/]?[\w. ]{2,40}\s*\}\}", r"\$\{\s*[\w. ]{2,40}\s*\}", r"<%=?\s*[\w. ]{2,40}\s*%>", r"<<\s*[A-Za-z][\w ]{2,40}>>", r"«\s*[A-Za-z][\w ]{2,40}»", r"@@[A-Za-z][\w ]{2,40}@@",
    r"%[A-Za-z][A-Za-z]*_?[A-Za-z0-9_]{2,40}%", r"__[A-Za-z][A-Za-z]+(?:[ _][A-Za-z0-9]+)*__", r"#(?:[Ff]ield_)?[A-Za-z]+(?:_[A-Za-z0-9]+)+#", r"\*\*\*[A-Za-z][\w ]{2,40}\*\*\*", r"<[A-Z]{2,}(?:_[A-Z0-9]+)*>", r"<(?:[Ff]ield_)[A-Za-z0-9_]+>", r"\{(?:[Ff]ield_)?[A-Za-z]{2,}(?:_?[A-Za-z0-9]+)*\}",
    r"\[\s*(?i:insert|enter|add|type|fill in|tbc|tbd|to be completed|delete as (?:appropriate|applicable)|name of|date of|einfügen|eintragen|insérer|à compléter|insertar|rellenar)\b[^\]\n]{0,60}\]", r"\[(?i:template version|drafting note|note to (?:draft|editor)|guidance)[^\]\n]{0,80}",
    r"\{%.{1,80}?%\}", r"\b(?:DD|TT|JJ|MM)[/.-](?:MM|DD)[/.-](?:YYYY|JJJJ|AAAA|YY)\b|\bYYYY-MM-DD\b", r"\bX{1,3}(?:[,.]XXX)+(?:[.,]XX)?\b|\bXX[.,]XX\b", r"\bNULL\b|\bNaN\b|(?:\bDear|[,:]) undefined[,.]|\[object Object\]", r"(?i)^\W*insert (?:the )?(?:[a-z-]+ ){0,4}[a-z-]+\.?\W*$",
    r"\b(?:TODO|FIXME|TBD|TBC|XXX)\s*:\s*\w+", r"(?i)\bset out here the\b", r"(?i)\bdelete (?:as appropriate|guidance before)\b", r"(?i)click (?:or tap )?here to enter (?:text|a date)", r"(?i)\bchoose an item\.",
    r"\[(?!REDACTED|SIC\b|OMITTED|ANON|WITHHELD|DELETED|SEALED|CONFIDENTIAL|NAME)(?:[A-Z]{3,}(?:[_ ][A-Z]+)*|[Ff]ield_\w+)\]", r"#[A-Za-z]{3,}(?:_[A-Za-z0-9]+)*#", r"(?i)[\[(][^\])\n]{0,60}\bto be (?:added|inserted|completed|confirmed|supplied|filled in)\b[^\])\n]{0,20}[\])]",
]
# Filler texts.
FILLERS = [
    r"(?i)^\W*(?:your (?:content|text) (?:goes )?here|sample text|text goes here|placeholder text|dummy text|insert text here|blindtext|texte d'exemple|texto de ejemplo)\W*$",
    r"(?i)(?:\b(?:your (?:content|text) (?:goes )?here|sample text|text goes here)\.\s*){2,}", r"(?i)^(?:x{3,}[\s.]*){6,}$", r"(?i)\b(?:lorem ipsum dolor|the quick brown fox)\b", r"(?i)(?:\bfoo\b.*\bbar\b.*\bbaz\b|asdf\s?(?:asdf|jkl))", r"(?i)\bblindtext\b(?:\W+blindtext\b)+", r"(?i)\b(?:paragraph|section|page|text|heading) is (?:a dummy|dummy text|a placeholder)\b|\breplaced before publication\b",
]
# Words of filler Latin; a line made of them is filler.
LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor aliquam ornare velit porta nibh eget quisque tellus pharetra vestibulum erat donec feugiat libero lacus mauris nunc sodales ultricies".split()
# Messages of sites in place of content.
ERRORS = [
    r"(?i)^\W*(?:http(?:/\d\.\d)? ?)?(?:error )?[45]\d\d[ :—–-]+(?:not found|forbidden|internal server error|service (?:temporarily )?unavailable|bad gateway|gateway time-?out|too many requests|gone|unauthori[sz]ed|bad request|access denied)\b",
    r"(?i)^\W*error [45]\d\d\b", r"(?i)\b(?:not found|forbidden|gone|bad gateway|internal server error|service unavailable|too many requests)[.,] (?:request \w+|please try again later)", r"(?i)please try again later or contact the administrator", r"(?i)\bpage (?:can'?t|cannot|could not|can’t) be found\b", r"(?i)^\W*oops\b",
    r"(?i)\bpage introuvable\b", r"(?i)le document demandé n['’]existe plus", r"(?i)la página solicitada no está disponible", r"(?i)\bvuelva al inicio\b", r"(?i)seite (?:wurde )?nicht gefunden", r"(?i)die (?:angeforderte|gewünschte|aufgerufene) (?:seite|datei|entscheidung)\b.{0,40}\b(?:nicht|existiert)", r"(?i)\bfehler [45]\d\d\b",
    r"(?i)we['’]re sorry, something went wrong", r"(?i)something went wrong while loading", r"(?i)^\W*access denied\b", r"(?i)you do not have permission to (?:view|access)", r"(?i)zugriff verweigert", r"(?i)accès refusé", r"(?i)acceso denegado", r"(?i)too many requests from your network", r"(?i)wait \d+ seconds, then reload",
    r"(?i)^\W*traceback \(most recent call last\)", r"(?i)^\W*(?:Key|Value|Type|Index|Attribute|Runtime)Error: ", r"(?i)fatal error: uncaught exception", r"(?i)an error occurred while (?:rendering|loading)", r"(?i)could not be located on the\b", r"(?i)the requested (?:ruling|document|page|url|resource)\b.{0,40}\b(?:could not|was not|cannot|is not|no longer)",
    r"(?i)\b(?:is )?temporarily down for maintenance\b", r"(?i)\bdatabase of the .{3,40} is temporarily\b", r"(?i)^\W*expected back at \d", r"(?i)checking your browser before accessing", r"(?i)your session has (?:expired|timed out)", r"(?i)^\W*incident [0-9a-f]{6,} at \d{4}-", r"(?i)\bray id[: ]+[0-9a-f]{8,}", r"(?i)^\W*reference #[0-9a-f.]{6,}", r"(?i)unusual traffic from your", r"(?i)verify (?:that )?you are (?:a )?human", r"(?i)^\W*loading(?:\.{3}|…)\W*$", r"(?i)\bpowered by an? \w+ server\b",
]
_SCRIPT = r"(?:java ?script|js|scripts|scripting|client-side scripts?)"
# Notices that scripts are required.
SCRIPTS = [
    rf"(?i)\b(?:please )?(?:enable|activate|allow|turn on|switch on)\b.{{0,12}}\b{_SCRIPT}\b.{{0,60}}(?:\bto (?:read|view|see|open|load|use|continue|display|access)\b|browser)", rf"(?i)\bbrowser does not support {_SCRIPT}\b", rf"(?i)\byou need to (?:turn on|enable|allow) {_SCRIPT}\b", rf"(?i)\b(?:application|page|site|viewer|pane|app|document|archive|text|judgment)\b.{{0,20}}\b(?:requires|needs|does not work without|cannot be shown without)\b.{{0,12}}\b{_SCRIPT}\b",
    r"(?i)^\W*noscript\b", rf"(?i)\b{_SCRIPT} (?:could not|cannot|can't|did not) (?:run|start|load)\b", rf"(?i)\blooks like {_SCRIPT}\b", rf"(?i)\bcookies and {_SCRIPT} must\b", rf"(?i){_SCRIPT} (?:is|are|must be|has been) (?:disabled|blocked|required|turned off|switched off|enabled|allowed)", r"(?i)\b(?:activer|autoriser|activez|autorisez) javascript\b", r"(?i)\bjavascript\b.{0,20}\b(?:aktivieren|erlauben|einschalten|zulassen)\b", r"(?i)\b(?:aktivieren|erlauben|schalten) sie (?:bitte )?javascript\b", r"(?i)\b(?:active|habilite|permita|activar|habilitar) javascript\b",
]
# Words by which a sentence reports what others said or wrote.
REPORTED = r"(?i)\b(?:explained|said|stated|testified|told|noted|observed|reported|recalled|alleged|recorded|described|printed|photographed|exhibited)\b.{0,60}\b(?:that|words|reading)\b|\bas pleaded\b|\b(?:erklärte|sagte|führte aus)\b.{0,40}\bdass\b|\b(?:expliqué|déclaré|indiqué|explicó|declaró)\b.{0,40}\bqu[e']"
QUOTED = r"[\"“”„][^\"“”„\n]*[\"“”]"
SENTENCE_END = r"[.!?;][\s]+"
KINDS = {"placeholder": PLACEHOLDERS, "script_notice": SCRIPTS, "error_page": ERRORS, "filler": FILLERS}
_BEGIN, _STOP = r"(?:^|(?<=[.!?;]\s))", r"(?=\s*$|(?<=[.!?;])\s)"


def _anchored(pattern: str) -> str:
    """A pattern for whole lines: its begin and end are those of a line or sentence."""
    flag = "(?i)" if pattern.startswith("(?i)") else ""
    body = pattern.removeprefix("(?i)")
    body = _BEGIN + body[1:] if body.startswith("^") else body
    return flag + (body[:-1] + _STOP if body.endswith("$") else body)


def linear(pattern: str) -> str:
    """A pattern for a linear-time engine that matches wherever the given one does: zero-width tests are left out, counts loosened."""
    from re import _constants as c
    from re import _parser as parser

    # wider than Python's classes beyond ASCII, and quick to compile
    classes = {c.CATEGORY_SPACE: r"\s\x{1C}-\x{1F}\x{80}-\x{10FFFF}", c.CATEGORY_DIGIT: r"0-9\x{80}-\x{10FFFF}", c.CATEGORY_WORD: r"0-9A-Za-z_\x{80}-\x{10FFFF}"}
    negated = {c.CATEGORY_NOT_SPACE: r"\S", c.CATEGORY_NOT_WORD: r"\W", c.CATEGORY_NOT_DIGIT: r"\D"}
    char = lambda n: f"\\x{{{n:X}}}"

    def of(items) -> str:
        out = ""
        for op, arg in items:
            if op is c.LITERAL:
                out += char(arg)
            elif op is c.NOT_LITERAL:
                out += f"[^{char(arg)}]"
            elif op is c.ANY:
                out += r"[^\n]"
            elif op is c.IN:
                inside = "".join(char(x) if k is c.LITERAL else f"{char(x[0])}-{char(x[1])}" if k is c.RANGE else classes.get(x) or negated[x] for k, x in arg if k is not c.NEGATE)
                out += f"[{'^' if arg[0][0] is c.NEGATE else ''}{inside}]"
            elif op is c.BRANCH:
                out += f"(?:{'|'.join(of(x) for x in arg[1])})"
            elif op is c.SUBPATTERN:
                flag = "i" if arg[1] & re.I else ""
                out += f"(?{flag}:{of(arg[3])})"
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
                least, most, what = arg
                out += f"(?:{of(what)})" + ("" if least == most == 1 else f"{{{min(least, 8)},}}" if least else "?" if most == 1 else "*")
            elif op not in (c.AT, c.ASSERT, c.ASSERT_NOT):
                raise ValueError(f"{op} has no linear form")
        return out

    return of(parser.parse(pattern))


def period(words: list[str]) -> int:
    """The length of the unit that a sequence of words is made of by repetition, the last one possibly cut short; its own length if it is none."""
    n, fail = len(words), [0] * (len(words) + 1)
    k = 0
    for i in range(1, n):
        while k and words[i] != words[k]:
            k = fail[k]
        k += words[i] == words[k]
        fail[i + 1] = k
    p = n - fail[n]
    return p if 2 * p <= n else n


class Detector:
    """Kinds of residue in texts. All texts are read by one linear-time automaton of all patterns; the lines of those it stops at are read again
    pattern by pattern."""

    def __init__(self) -> None:
        self.kinds = {k: [re.compile(_anchored(p)) for p in v] for k, v in KINDS.items()}
        self.reported, self.latin = re.compile(REPORTED), set(LATIN)
        self.cut, self.word = re.compile(SENTENCE_END), re.compile(r"[^\W\d_]+")
        every = [p for v in KINDS.values() for p in v]
        self.folding = "|".join(f"(?:{linear(p.removeprefix('(?i)'))})" for p in every if p.startswith("(?i)"))
        filler = "|".join(LATIN)
        self.folding += rf"|(?:^|[^A-Za-z])(?:{filler})[^A-Za-z\n]+(?:{filler})(?:[^A-Za-z]|$)"  # a line that is four fifths filler Latin has two such words side by side
        self.exact = "|".join(f"(?:{linear(p)})" for p in every if not p.startswith("(?i)"))

    def texts(self, texts: list[str]) -> list[list[tuple[int, str]]]:
        """(line number, kind) of the residue in each text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        stop = lambda x: pc.or_(pc.match_substring_regex(x, self.folding, ignore_case=True), pc.match_substring_regex(x, self.exact))
        bare = pc.replace_substring_regex(pa.array(texts, pa.large_string()), QUOTED, " ")
        out: list[list[tuple[int, str]]] = [[] for _ in texts]
        held = [(k, n, line) for k in pc.indices_nonzero(stop(bare)).to_pylist() for n, line in enumerate(bare[k].as_py().split("\n"), 1) if line]
        for at in pc.indices_nonzero(stop(pa.array([line for *_, line in held], pa.large_string()))).to_pylist():
            k, n, line = held[at]
            if kind := self.kind_of(line):
                out[k].append((n, kind))
        return out

    def kind_of(self, line: str) -> str | None:
        """The kind of residue in a line without its quoted parts."""
        ends = None
        for kind, patterns in self.kinds.items():
            for p in patterns:
                for m in p.finditer(line):
                    ends = ends or [0, *[x.end() for x in self.cut.finditer(line)]]
                    if not self.reported.search(line, max(e for e in ends if e <= m.start()), m.start() + 1):
                        return kind
        for sentence in self.cut.split(line):
            words = self.word.findall(sentence.lower())
            if len(words) >= 4 and sum(w in self.latin for w in words) >= 0.8 * len(words):
                return "filler"
        return None

    def __call__(self, text: str) -> list[tuple[int, str]]:
        return self.texts([text])[0]


def compared(slug: str | None, text: str) -> tuple[bool, bool]:
    """Whether the terms of the slug stand, side by side, in the title (the lines before the first long one) and in the body."""
    terms = re.findall(r"\w+", slug.lower()) if isinstance(slug, str) else []
    if not terms:
        return False, False
    form = re.compile(r"(?<!\w)" + r"\W{1,3}".join(map(re.escape, terms)) + r"(?!\w)", re.I)
    m = form.search(text)
    if not m:
        return False, False
    at = 0
    for line in text.split("\n"):
        if len(line) > 120:
            break
        at += len(line) + 1
    return m.start() < at, m.start() >= at or bool(form.search(text, at))


#: A line that says one unit of words so many times over is filler, whatever the unit.
OVER_AND_OVER = 6


def units(text: str, mismatched: bool) -> tuple[list[tuple[str, bool]], bool]:
    """((unit, low), filler): what of a text may be a stock response, digits masked. low marks what the text repeats: the unit of a repetitive text
    or line, and lines that recur. The other lines are given for mismatched documents only. filler tells of a line repeated OVER_AND_OVER."""
    masked = [re.sub(r"\d+", "9", x.strip()) for x in text.split("\n")]
    seen, out, filler = Counter(x for x in masked if x), {}, False
    for line, n in seen.items():
        words = line.split()
        p = period(words) if len(words) > 1 and words.count(words[0]) > 1 else len(words)
        unit = " ".join(words[:p])
        filler = filler or len(words) >= OVER_AND_OVER * p and any(c.isalpha() for c in unit)
        if n > 1 or p < len(words):
            out[unit] = True
        elif mismatched:
            out.setdefault(unit, False)
    if mismatched and len(seen) > 1:
        words = " ".join(masked).split()
        if (p := period(words)) < len(words):
            out[" ".join(words[:p])] = True
    return list(out.items()), filler


def examined(df: DataFrame, key: str, text: str, slug: str, host: str, unit: str) -> DataFrame:
    """(key, host, unit, kinds, mismatched, units): what detectors find in each document, whether its slug stands neither in title nor body, and
    the digests of its possible stock responses."""
    common.by_value(sys.modules[__name__])
    make, compare, parts, types = Detector, compared, units, dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        detect = make()
        digest = lambda s: xxhash.xxh3_128_hexdigest(s.encode("utf-8", "surrogatepass"))
        for pdf in batches:
            rows = []
            texts = pdf[text].tolist()
            for k, h, u, s, t, found in zip(pdf[key], pdf[host], pdf[unit], pdf[slug], texts, detect.texts(texts)):
                off = not any(compare(s, t))
                own, filler = parts(t, off)
                kinds = {x for _, x in found} | ({"filler"} if filler else set())
                rows.append((k, h, u, sorted(kinds), off, [{"digest": digest(x), "low": low} for x, low in own]))
            yield pd.DataFrame(rows, columns=[key, host, unit, "kinds", "mismatched", "units"])

    given = df.where(F.length(text) > 0).select(key, text, slug, host, unit)
    return given.mapInPandas(run, f"`{key}` {types[key]}, `{host}` {types[host]}, `{unit}` {types[unit]}, kinds array<string>, mismatched boolean, units array<struct<digest string, low boolean>>")


def residue(df: DataFrame, key: str, text: str, *, slug: str, host: str, unit: str, rulings: int = 3, hosts: int = 2) -> DataFrame:
    """(key, evidence): documents to exclude and the kinds of evidence against them, stock_response being that of slug, repetition and hosts."""
    seen = materialized(examined(df, key, text, slug, host, unit).where("mismatched OR size(kinds) > 0 OR size(units) > 0"))
    parts = seen.select(F.col(key).alias("_key"), F.col(host).alias("_host"), F.col(unit).alias("_unit"), "mismatched", (F.size("kinds") > 0).alias("_hit"), F.inline("units"))
    off, share = F.col("mismatched"), lambda c: F.count_if(off & c) / F.count_if(off)
    per = parts.groupBy("digest").agg(F.approx_count_distinct(F.when(off, F.col("_unit"))).alias("_units"), F.approx_count_distinct(F.when(off, F.col("_host"))).alias("_hosts"), share(F.col("low")).alias("_low"), share(F.col("_hit")).alias("_hits"), (F.count_if(off) / F.count("*")).alias("_off"))
    stock = per.where((F.col("_units") >= rulings) & (F.col("_hosts") >= hosts) & ((F.col("_low") > 0.5) | (F.col("_hits") > 0.5)) & (F.col("_off") > 0.2)).select("digest")
    low = parts.where("mismatched OR low").join(stock, "digest").select("_key").distinct().select(F.col("_key").alias(key), F.array(F.lit("stock_response")).alias("evidence"))
    both = seen.where("size(kinds) > 0").select(key, F.col("kinds").alias("evidence")).unionByName(low)
    return both.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("evidence"))).alias("evidence"))
