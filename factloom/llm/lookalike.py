"""Visually identical text in different characters to one consistent form.

Look-alikes are pairs of strings: full-width and half-width forms, ligatures, non-breaking characters and their plain form, composed
and decomposed accents, invisible characters and nothing, letters of other scripts and the Latin letters they are drawn like. Union-find
over these strings and code points gives transitive classes; the member that is most frequent in the corpus represents its class (ties
fall to the shorter, then the smaller string); a multi-pattern automaton rewrites every text greedily, longest match first, until
nothing changes. Letter case, accents, raised signs and spaces between words stay different. Null stays null, empty stays empty.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import common
from factloom.operators.common import materialized

# Letters of other scripts and the Latin letters they are drawn like.
DRAWN_ALIKE = {
    "АаВЕеЅѕІіЈјКМНОоРрСсТУуХхһԁԛԝҮ": "AaBEeSsIiJjKMHOoPpCcTYyXxhdqwY",
    "ΑΒΕΖΗΙΚΜΝΟοΡΤΥΧϹϲϳ": "ABEZHIKMNOoPTYXCcj",
    "‐‑‒−": "----",
}
INVISIBLE = "­​‌‍‎‏⁠⁡⁢⁣﻿‪‫‬‭‮⁦⁧⁨⁩᠎͏"
#: Kinds of Unicode decomposition that keep the look.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>")


def pairs(symbols: set[str]) -> list[tuple[str, str]]:
    """Look-alike pairs among the characters that occur in the corpus and the strings they stand for."""
    drawn = {a: b for others, latin in DRAWN_ALIKE.items() for a, b in zip(others, latin)}
    out = []
    for c in sorted(symbols):
        if c in INVISIBLE:
            out.append((c, ""))
            continue
        if c in drawn:
            out.append((c, drawn[c]))
        kind, _, rest = unicodedata.decomposition(c).rpartition(">")
        if kind and kind + ">" in SAME_LOOK:
            out.append((c, "".join(chr(int(x, 16)) for x in rest.split())))
        elif unicodedata.category(c) == "Zs" and c != " ":
            out.append((c, " "))
        plain = unicodedata.normalize("NFD", c)
        if plain != c and not kind:
            out.append((c, plain))
    marks = [c for c in symbols if unicodedata.combining(c)]
    bases = {b for c in symbols for b in [unicodedata.normalize("NFKC", drawn.get(c, c))] if len(b) == 1}
    out += [(whole, b + m) for m in marks for b in sorted(bases) for whole in [unicodedata.normalize("NFC", b + m)] if len(whole) == 1]
    return out


def classes(links: list[tuple[str, str]], counts: dict[str, int]) -> dict[str, str]:
    """Each string of a class and its representative, by union-find; the empty string always represents its class."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    members: dict[str, list[str]] = {}
    for x in parent:
        members.setdefault(root(x), []).append(x)
    out = {}
    for group in members.values():
        best = "" if "" in group else min(group, key=lambda x: (-counts.get(x, 0), len(x), x))
        out |= {x: best for x in group if x != best and x}
    return out


class Rewriter:
    """Greedy rewriting by a multi-pattern automaton: at each place the longest pattern wins."""

    def __init__(self, table: dict[str, str]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for pattern, to in table.items():
            self.auto.add_word(pattern, (len(pattern), to))
        self.any = bool(table)
        if self.any:
            self.auto.make_automaton()

    def __call__(self, text: str) -> str:
        if not self.any or text.isascii():
            return text.strip()
        seen: list[str] = []
        while text not in seen:  # until nothing changes; should forms go round in a circle, its smallest stands for them
            seen.append(text)
            out, at = [], 0
            for end, (size, to) in self.auto.iter_long(text):
                out += [text[at : end + 1 - size], to]
                at = end + 1
            if not out:
                break
            text = "".join([*out, text[at:]])
        return min(seen[seen.index(text) :]).strip()


def counted(texts: list[str]) -> Counter:
    """Occurrences of each character, and of the strings that one character may stand for."""
    whole = "\n".join(texts)
    n = Counter(whole)
    if not whole.isascii():
        for lig in ("ff", "fi", "fl", "ffi", "ffl", "st"):
            n[lig] += whole.count(lig)
        for m in [c for c in n if len(c) == 1 and unicodedata.combining(c)]:
            at = whole.find(m)
            while at > 0:
                n[whole[at - 1 : at + 1]] += 1
                at = whole.find(m, at + 1)
    return n


def table_of(df: DataFrame, text: str) -> dict[str, str]:
    """The rewriting table of a corpus. What comes to the driver is bounded by the number of characters there are, not by the texts."""
    common.by_value(sys.modules[__name__])
    count = counted

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            total += count(pdf[text].dropna().tolist())
        yield pd.DataFrame(list(total.items()), columns=["s", "n"])

    got = df.select(text).where(F.length(text) > 0).mapInPandas(run, "s string, n bigint").groupBy("s").agg(F.sum("n").alias("n"))
    counts = {r["s"]: r["n"] for r in got.toLocalIterator()}
    return classes(pairs({s for s in counts if len(s) == 1}), counts)


def consistent(df: DataFrame, text: str, table: dict[str, str], to: str = "clean") -> DataFrame:
    """The rows of df with `to`, the text in its consistent form; a column of that name is replaced."""
    common.by_value(sys.modules[__name__])
    make, df = Rewriter, df.drop(to)
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{to}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewrite = make(table)
        for pdf in batches:
            yield pdf.assign(**{to: [None if t is None else rewrite(t) for t in pdf[text]]})

    return df.mapInPandas(run, schema)


def same_look(df: DataFrame, key: str, group: list[str], raw: str, clean: str = "clean") -> DataFrame:
    """(left_id, right_id): rows of one group whose consistent forms are equal and whose characters aren't. Rows with a null group, key
    or text pair with nothing. Only forms that occur in different characters go on; of each, the different character sequences are paired,
    not their copies, and the pairs are then given out to the rows, so the work is bounded by the texts and the result."""
    digest = lambda c: F.md5(F.encode(c, "utf-8"))
    base = df.where((F.length(clean) > 0) & F.col(key).isNotNull()).select(F.col(key).alias("_id"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], digest(F.col(clean)).alias("_form"), digest(F.col(raw)).alias("_raw"))
    base = materialized(base)  # narrow rows, so that no text is rewritten again for the joins below
    at = [*[f"_g{i}" for i in range(len(group))], "_form"]
    several = base.groupBy(*at).agg(F.min("_raw").alias("_a"), F.max("_raw").alias("_b")).where("_a != _b").select(*at)
    base = base.join(several, at, "left_semi")
    classes = base.select(*at, "_raw").distinct()
    pairs = classes.withColumnRenamed("_raw", "_l").join(classes.withColumnRenamed("_raw", "_r"), at).where("_l != _r")
    left = pairs.join(base.select(*at, F.col("_raw").alias("_l"), F.col("_id").alias("left_id")), [*at, "_l"])
    return left.join(base.select(*at, F.col("_raw").alias("_r"), F.col("_id").alias("right_id")), [*at, "_r"]).where("left_id < right_id").select("left_id", "right_id")
