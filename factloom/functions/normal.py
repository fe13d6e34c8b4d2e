"""Texts under Unicode's compatibility normalisation, which the JVM's functions lack: Arrow-batched, one pass over a batch's distinct texts."""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

_CJK = "\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff"


def normal_text(t: str) -> str:
    """Compatibility form; line breaks away between CJK signs, else blanks; runs of blanks to one; trimmed."""
    t = unicodedata.normalize("NFKC", t).replace("\u3000", " ").replace("\xa0", " ")
    t = re.sub(rf"(?<=[{_CJK}])\n(?=[{_CJK}])", "", t).replace("\n", " ")
    return re.sub(r"[ \t]+", " ", t).strip()


def normal_chars(t: str) -> str:
    """Compatibility form without invisible signs, runs of blanks to one, trimmed."""
    return re.sub(r"[ \t]+", " ", re.sub("[\u200b-\u200f\u2028-\u202f\ufeff]", "", unicodedata.normalize("NFKC", t))).strip()


def clean_label(t: str) -> str:
    """Compatibility form with single blanks, without blanks and colons at its ends."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t).strip()).strip(" \t:：")


def _over(f):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    def run(s: pd.Series) -> pd.Series:
        known = {t: f(t) for t in s.dropna().unique()}
        return s.map(known, na_action="ignore").where(s.notna(), None)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")


def text(c: Column) -> Column:
    return _over(normal_text)(c)


def chars(c: Column) -> Column:
    return _over(normal_chars)(c)


def label(c: Column) -> Column:
    return _over(clean_label)(c)
