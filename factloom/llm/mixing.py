"""Mixing sources to target shares of the total size.

Each source gets a budget, its share of the largest total that all sources can serve within their allowed repeats. Whole repeats come
first; for the rest documents are counted by exact token length, each length gives its even part, and bounded-knapsack dynamic
programming over the lengths fits what is left to the token; documents of a length are then chosen in a seeded order. Only histograms
by length leave the tasks' rows. Documents without source, size or tokens, and sources without a target, are left out.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import common
from factloom.operators.common import materialized

#: Budget that is left to dynamic programming: so many of the longest documents, but no more than so many tokens. It bounds the bit sets, one of a
#: bit a token for each step; what lies above is filled with the longest documents that fit.
FIT_LENGTHS, FIT_TOKENS = 4, 1 << 16
#: Parts of a group of equal length that are counted before any document is ranked; must be a power of two.
PARTS = 1024


def subset(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their sum comes closest to the budget from below, by bounded knapsack over
    bit sets of reachable sums; counts are taken apart into powers of two."""
    mask, sums, steps = (1 << (budget + 1)) - 1, 1, []
    for k, (size, n) in enumerate(zip(lengths, counts)):
        lot, n = 1, min(n, budget // size if size else 0)
        while n > 0 and not sums >> budget & 1:
            take = min(lot, n)
            steps.append((sums, k, take))
            sums |= sums << (size * take) & mask
            n -= take
            lot *= 2
    rest, out = sums.bit_length() - 1, [0] * len(lengths)
    for before, k, take in reversed(steps):
        if not before >> rest & 1:
            out[k] += take
            rest -= lengths[k] * take
    return out


def fitted(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length fill a budget: an even part of each length, then the knapsack for the remainder."""
    total = sum(a * b for a, b in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    out = [b * budget // total for b in counts]
    left = budget - sum(a * b for a, b in zip(lengths, out))
    most = min(FIT_LENGTHS * max(lengths), FIT_TOKENS)
    for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if left > most and lengths[k]:
            more = min(counts[k] - out[k], (left - most) // lengths[k] + 1, left // lengths[k])
            out[k] += more
            left -= more * lengths[k]
    for k, n in enumerate(subset(lengths, [c - o for c, o in zip(counts, out)], left)):
        out[k] += n
    return out


def _plan(sizes: DataFrame, targets: DataFrame, source: str, size: str) -> DataFrame:
    """(source, tokens, n, whole, extra): per source and length, whole repeats and the number of documents taken once more."""
    common.by_value(sys.modules[__name__])
    goal = targets.where("target_share > 0 AND max_repeats > 0").groupBy(F.col("source").alias(source)).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    lengths = sizes.groupBy(source, size).agg(F.count("*").alias("n"))
    per = lengths.groupBy(source).agg(F.sum(F.col(size) * F.col("n")).alias("total")).join(goal, source)
    whole = F.min(F.col("total") * F.col("cap") / F.col("share")).over(Window.partitionBy(F.lit(1)))  # over one row a source
    per = per.withColumn("budget", F.floor(whole * F.col("share")).cast("long"))
    fit = fitted

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(size)
        total, budget, cap = int(pdf["total"].iloc[0]), int(pdf["budget"].iloc[0]), int(pdf["cap"].iloc[0])
        whole = min(budget // total, cap)
        rest = budget - whole * total if whole < cap else 0
        take = fit(pdf[size].tolist(), pdf["n"].tolist(), rest) if rest else [0] * len(pdf)
        return pdf.assign(whole=whole, extra=take)[[source, size, "n", "whole", "extra"]]

    return lengths.join(per, source).groupBy(source).applyInPandas(run, f"`{source}` string, `{size}` bigint, n bigint, whole bigint, extra bigint")


def _usable(sizes: DataFrame, key: str, source: str, size: str) -> DataFrame:
    """(_key, _source, _size) of what can be mixed; the caller's names can't clash with those made here."""
    return materialized(sizes.where(F.col(source).isNotNull() & (F.col(size) > 0)).select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(size).cast("bigint").alias("_size")))


def _chosen(usable: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """usable with `repeats`: of each length the planned number of documents is taken once more, those whose seeded hash is smallest.

    Hashes fall into parts; parts are counted and taken whole up to the one in which the number is reached, and only that part is ranked, so
    a length that holds a large share of all documents is not ordered in one task."""
    at = ["_source", "_size"]
    rows = usable.withColumn("_hash", F.xxhash64(F.lit(seed), F.col("_key"))).withColumn("_part", F.pmod("_hash", F.lit(PARTS)))
    counts = rows.groupBy(*at, "_part").agg(F.count("*").alias("_n")).join(plan.drop("n"), at)
    upto = F.sum("_n").over(Window.partitionBy(*at).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("_take", F.least(F.greatest(F.col("extra") - (upto - F.col("_n")), F.lit(0)), F.col("_n")))
    rows = rows.join(counts, [*at, "_part"])
    cut = (F.col("_take") > 0) & (F.col("_take") < F.col("_n"))
    rank = F.row_number().over(Window.partitionBy(*at, "_part").orderBy("_hash", "_key"))
    some = rows.where(cut).withColumn("_more", (rank <= F.col("_take")).cast("int"))
    rows = rows.where(~cut).withColumn("_more", (F.col("_take") > 0).cast("int")).unionByName(some)
    return rows.withColumn("repeats", (F.col("whole") + F.col("_more")).cast("int")).where("repeats > 0").select("_key", *at, "repeats")


def mixed(sizes: DataFrame, targets: DataFrame, *, key: str, source: str, size: str, seed: int = 7) -> DataFrame:
    """(key, source, size, repeats): the chosen documents; repeats is never above the source's allowed number."""
    usable = _usable(sizes, key, source, size)
    rows = _chosen(usable, _plan(usable, targets, "_source", "_size"), seed)
    return rows.select(F.col("_key").alias(key), F.col("_source").alias(source), F.col("_size").alias(size), "repeats")


def shares(sizes: DataFrame, targets: DataFrame, *, key: str, source: str, size: str, seed: int = 7) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_repeats): what the chosen documents hold of each source."""
    usable = _usable(sizes, key, source, size)
    rows = _chosen(usable, _plan(usable, targets, "_source", "_size"), seed)
    per = rows.groupBy(F.col("_source").alias(source)).agg(F.sum(F.col("_size") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    goal = targets.select(F.col("source").alias(source), "target_share")
    return goal.join(per, source, "left").withColumn("actual_share", F.coalesce(F.col("tokens"), F.lit(0)) / F.sum("tokens").over(Window.partitionBy(F.lit(1)))).select(source, "target_share", "actual_share", "tokens", "documents", "most_repeats")
