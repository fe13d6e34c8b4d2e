"""Words against lexicons: every hit of a dictionary with its place, longest hits without overlap, the one term that a misread word stands for."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pairs of signs that are read for one another, at a cost below that of another sign.
CONFUSIONS = {frozenset(p): 0.2 for p in ("0o", "1l", "1i", "5s", "8b", "il", "ce", "rn", "uv", "2z")}
#: Costs of two neighbours that changed places; the greatest distance of a match; how far the next term must be.
SWAP, FARTHEST, MARGIN = 0.75, 1.0, 0.5


def weighted_distance(a: str, b: str) -> float:
    """Edit distance with cheap confusions and neighbours that change places."""
    before: list[float] = []
    last = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        now = [float(i)]
        for j, y in enumerate(b, 1):
            cost = 0.0 if x == y else CONFUSIONS.get(frozenset((x, y)), 1.0)
            best = min(now[-1] + 1, last[j] + 1, last[j - 1] + cost)
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, before[j - 2] + SWAP)
            now.append(best)
        before, last = last, now
    return last[-1]


def unique_term(word: str, terms: list[str]) -> tuple[str, float] | None:
    """The term nearest to a word, if it is within FARTHEST and the next one at least MARGIN farther; none for terms themselves and words of under three signs."""
    low = word.strip().lower()
    if len(low) < 3 or low in terms:
        return None
    near = sorted((d, t) for t in terms if abs(len(t) - len(low)) <= 1 for d in [weighted_distance(low, t)] if d <= FARTHEST)
    return (near[0][1], near[0][0]) if near and (len(near) == 1 or near[1][0] - near[0][0] >= MARGIN) else None


def corrections(words: DataFrame, word: str, terms: list[str]) -> DataFrame:
    """(word, term, distance) of the words that stand for one term only; the lexicon is part of the task."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    find = unique_term

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(w, *m) for w in pdf[word] if w for m in [find(w, terms)] if m]
            yield pd.DataFrame(rows, columns=["word", "term", "distance"])

    return words.select(word).mapInPandas(run, "word string, term string, distance double")


def hits(df: DataFrame, key: str, text: str, words: list[str], longest: bool = False) -> DataFrame:
    """(key, word, start): every place where a word of the dictionary stands, from 0; or, with `longest`, hits taken from the left, the longest first, that
    share no sign. Texts are read once whatever the number of words."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    types, pick = dict(df.dtypes), apart

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        auto = ahocorasick.Automaton()
        for w in words:
            auto.add_word(w, w)
        auto.make_automaton()
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text]):
                found = [(w, e - len(w) + 1) for e, w in auto.iter(t)]
                rows += [(k, *h) for h in (pick(found) if longest else found)]
            yield pd.DataFrame(rows, columns=[key, "word", "start"])

    return df.where(F.length(text) > 0).select(key, text).mapInPandas(run, f"`{key}` {types[key]}, word string, start int")


def apart(found: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Hits that share no sign: from the left, of those that begin together the longest."""
    out, free = [], 0
    for w, at in sorted(found, key=lambda h: (h[1], -len(h[0]))):
        if at >= free:
            out.append((w, at))
            free = at + len(w)
    return out


#: Likeness of labels from which one stands for the other.
ALIKE = 0.74


def first_labels(labels: list[str]) -> list[tuple[str, str]]:
    """(label, kept) of labels in their order: each falls to the first kept one that it is alike to, by the share of matching blocks, or is kept."""
    from difflib import SequenceMatcher

    kept: list[str] = []
    out = []
    for x in labels:
        same = next((k for k in kept if SequenceMatcher(None, x, k).ratio() >= ALIKE), None)
        if same is None:
            kept.append(x)
        out.append((x, same or x))
    return out


def similar_labels(df: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """(keys, value, label, kept): labels under which one value is given several times, and the one that stands for them. Values given under one label, and
    null or blank ones, are left out; what is compared is the labels of one value, never values with one another."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    keep, types = first_labels, dict(df.dtypes)
    groups = df.where(F.length(F.trim(value)) > 0).groupBy(*keys, value).agg(F.array_sort(F.collect_set(label)).alias("_labels")).where(F.size("_labels") > 1)
    cols = [*keys, value]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*k, a, b) for k, ls in zip(pdf[cols].itertuples(index=False, name=None), pdf["_labels"]) for a, b in keep(list(ls))]
            yield pd.DataFrame(rows, columns=[*cols, "label", "kept"])

    return groups.mapInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in cols) + ", label string, kept string")
