"""Personal items in free text: found by the sequence model, checked for their exact form, replaced by typed placeholders.

Null and empty texts give no items and come out as they are; texts of any length are decoded whole in overlapping windows. Ties
between overlapping items fall to the kind with the stricter form (e-mail, account, identity, phone, address, name).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import common, pii_model, pii_rules

WEIGHTS = Path(__file__).with_name("pii_weights.npz")
#: Texts scored together; bounds the memory of one step together with the window size.
BATCH_CHARS = 400_000


@lru_cache(1)
def weights() -> dict[str, np.ndarray]:
    with np.load(WEIGHTS) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


def found(params: dict, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Checked items of each text."""
    out, part, size = [], [], 0
    for t in [*texts, None]:
        if t is not None:
            part.append(t)
            size += len(t)
        if part and (t is None or size >= BATCH_CHARS):
            out += [pii_rules.checked(x, s) for x, s in zip(part, pii_model.decode(params, part))]
            part, size = [], 0
    return out


def items(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, kind, begin_at, end_at): the items of each text; offsets count code points from 0."""
    common.by_value(pii_model, pii_rules)
    params, scan = weights(), found
    types = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*k, kind, b, e) for k, spans in zip(pdf[keys].itertuples(index=False, name=None), scan(params, pdf[text].tolist())) for kind, b, e in spans]
            yield pd.DataFrame(rows, columns=[*keys, "kind", "begin_at", "end_at"])

    common.by_value(__import__("sys").modules[__name__])
    given = df.where(F.length(text) > 0).select(*keys, text)
    return given.mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", kind string, begin_at bigint, end_at bigint")


def replaced(df: DataFrame, text: str) -> DataFrame:
    """The rows of df with `clean`, the text with [KIND] in place of each item, and `n_items`; columns of these names are replaced."""
    common.by_value(pii_model, pii_rules, __import__("sys").modules[__name__])
    params, scan, df = weights(), found, df.drop("clean", "n_items")
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", clean string, n_items int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            clean, n = [], []
            for t, spans in zip(pdf[text], scan(params, [t or "" for t in pdf[text]])):
                if t is not None:
                    for kind, b, e in reversed(spans):
                        t = f"{t[:b]}[{kind.upper()}]{t[e:]}"
                clean.append(t)
                n.append(len(spans))
            yield pdf.assign(clean=clean, n_items=np.array(n, dtype="int32"))

    return df.mapInPandas(run, schema)
