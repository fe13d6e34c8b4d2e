"""Filling containers of fixed capacity with items of varying length.

Hierarchical residual packing: items fall into groups by a hash of their id; each group is packed by best fit, longest first; nearly
full bins are done, the others go on as items of the next round, in fewer groups, until one group is left or a round saves less than the share
`worth` of its bins (0 goes on until nothing is saved). Every item is placed whichever round is the last.
Items above the capacity, and only those, are split into full parts and a rest. Items of size 0 fit anywhere; items whose size or id is
null are left out. Groups are sized by a count, so that no task holds more than a bounded number of items; nothing is collected.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import common
from factloom.operators.common import materialized

#: Items of one group, fill at which a bin counts as full, groups merged into one per round, reduction below which rounds end.
GROUP_ITEMS, FULL, FAN_IN, WORTH = 20_000, 0.995, 8, 0.002


def tokenizer(name: str = "byte_bpe_50k.tiktoken"):
    """The public tokenizer of that name; its folder is that of the installed vocabulary files."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_CACHE: dict = {}


def token_counts(texts: list, name: str) -> list:
    if name not in _CACHE:
        _CACHE[name] = tokenizer(name)
    known = [i for i, t in enumerate(texts) if t is not None]
    out: list = [None] * len(texts)
    for i, ids in zip(known, _CACHE[name].encode_ordinary_batch([texts[i] for i in known], num_threads=1)):
        out[i] = len(ids)
    return out


def sized(df: DataFrame, text: str, keep: list[str], name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(keep, tokens): the size of each text in tokens of a public tokenizer; null texts have none."""
    common.by_value(sys.modules[__name__])
    count, types = token_counts, dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[keep].assign(tokens=pd.array(count(pdf[text].tolist(), name), dtype="Int64"))

    return df.select(*keep, text).mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keep) + ", tokens bigint")


def best_fit(ids: list, sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item by best fit, longest first; equal sizes go by id."""
    out, room, holders, used = [0] * len(ids), [], {}, 0
    for k in sorted(range(len(ids)), key=lambda i: (-sizes[i], ids[i])):
        at = bisect_left(room, sizes[k])
        if at == len(room):
            left, b = capacity, used
            used += 1
        else:
            left = room[at]
            b = holders[left].pop()
            if not holders[left]:
                del holders[left]
                room.pop(at)
        left -= sizes[k]
        out[k] = b
        if left not in holders:
            holders[left] = []
            insort(room, left)
        holders[left].append(b)
    return out


def _round(items: DataFrame, groups: int, capacity: int, number: int) -> DataFrame:
    """(item, size, bin, fill) of one round over (item, size)."""
    common.by_value(sys.modules[__name__])
    fit = best_fit

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        where = fit(pdf["item"].tolist(), pdf["size"].tolist(), capacity)
        out = pdf.assign(bin=[f"{number}-{g}-{b}" for g, b in zip(pdf["g"], where)])
        return out.assign(fill=out.groupby("bin")["size"].transform("sum"))[["item", "size", "bin", "fill"]]

    grouped = items.withColumn("g", F.pmod(F.xxhash64("item"), F.lit(groups))).groupBy("g")
    return grouped.applyInPandas(run, "item string, size bigint, bin string, fill bigint")


def packed(df: DataFrame, key: str, size: str, capacity: int, group_items: int = GROUP_ITEMS, worth: float = WORTH) -> DataFrame:
    """(key, part, tokens, container): where each item, or each part of an item above the capacity, lies. part counts from 0."""
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.col(size) - 1) / capacity), F.lit(0)).cast("int")), lambda i: F.struct(i.alias("part"), F.least(F.lit(capacity).cast("long"), F.col(size) - i * F.lit(capacity)).alias("tokens")))
    base = df.where(F.col(size).isNotNull() & F.col(key).isNotNull()).select(key, F.inline(parts)).withColumn("item", F.concat_ws("/", F.col(key).cast("string"), "part"))
    base = materialized(base)
    n = base.count()
    groups = max(1, -(-n // group_items))
    placed = materialized(_round(base.select("item", F.col("tokens").alias("size")), groups, capacity, 0))
    bins, parents, number = placed, None, 0
    while groups > 1:
        low = bins.where(F.col("fill") < FULL * capacity).groupBy(F.col("bin").alias("item")).agg(F.first("fill").alias("size"))
        left = low.count()
        if left == 0:
            break
        number, groups = number + 1, max(-(-left // group_items), groups // FAN_IN, 1)
        bins = materialized(_round(low, groups, capacity, number))
        into = bins.select(F.col("item").alias("_was"), F.col("bin").alias("_to"))
        # the first round's bins and where they lie now: bins, not items, are joined in each round
        parents = materialized(into if parents is None else parents.withColumnRenamed("_to", "_at").join(into.withColumnRenamed("_was", "_at"), "_at", "left").select("_was", F.coalesce("_to", "_at").alias("_to")))
        if bins.select("bin").distinct().count() > left * (1 - worth):
            break
    moves = placed.select("item", "bin")
    if parents is not None:
        moves = moves.join(parents, F.col("bin") == F.col("_was"), "left").select("item", F.coalesce("_to", "bin").alias("bin"))
    return base.join(moves.withColumnRenamed("bin", "container"), "item").select(key, "part", "tokens", "container")
