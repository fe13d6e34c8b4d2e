"""Column -> Column functions: normalising, validating, redacting. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import cells, safety

INVISIBLE = r"[​-‏⁠-⁤﻿­]"


def normalize_amount(c: Column) -> Column:
    """Number of an amount text, as in cells.amount_of."""
    return cells.amount_of(c)


def parse_amount(c: Column) -> Column:
    """Amount text with two decimals: (x) and a CR suffix are negative, a DR suffix positive, other signs after the number are dropped; what is no
    number comes out without brackets, suffix, currency signs and commas."""
    t = F.trim(c)
    bracket = t.rlike(r"^\(.*\)$")
    body = F.when(bracket, F.regexp_replace(t, r"^\(|\)$", "")).otherwise(t)
    up = F.upper(F.trim(body))
    body = F.when(up.rlike("(?:CR|DR)$"), F.regexp_replace(up, "(?:CR|DR)$", "")).otherwise(body)
    body = F.regexp_replace(F.regexp_replace(body, "[,¥￥$ ]", ""), r"[^\d.eE+-]+$", "")
    n = F.when(body.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), body.try_cast("double"))
    return F.when(n.isNull(), body).otherwise(F.format_string("%.2f", F.when(bracket | up.endswith("CR"), -F.abs(n)).otherwise(n)))


def normalize_timestamp(c: Column) -> Column:
    """ISO text of a timestamp text in one of the ordered formats; what can't be read stays as it is."""
    t = F.trim(c)
    forms = [
        (r"^(\d{4})[-/.](\d{2})[-/.](\d{2})\s*T?\s*(\d{2}):(\d{2}):(\d{2})$", "$1-$2-$3T$4:$5:$6"), (r"^(\d{4})(\d{2})(\d{2})\s?(\d{2}):?(\d{2}):?(\d{2})$", "$1-$2-$3T$4:$5:$6"),
        (r"^(\d{4})[-/.](\d{2})[-/.](\d{2})\s+(\d{2}):(\d{2})$", "$1-$2-$3T$4:$5:00"), (r"^(\d{4})[-/.](\d{2})[-/.](\d{2})$", "$1-$2-$3T00:00:00"), (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    ]
    return reduce(lambda rest, f: F.when(t.rlike(f[0]), F.regexp_replace(t, *f)).otherwise(rest), reversed(forms), c)


def redact_secrets(c: Column) -> Column:
    return safety.redact_secrets(c)


def redact_pii(c: Column) -> Column:
    return safety.redact_personal(c)


def mask_value(c: Column, keep: int = 4) -> Column:
    """All but the last characters masked; values of up to twice as many wholly, null as an empty text."""
    c = F.coalesce(c, F.lit(""))
    return F.when(F.length(c) <= 2 * keep, F.repeat(F.lit("*"), F.length(c).cast("int"))).otherwise(F.concat(F.repeat(F.lit("*"), F.length(c) - keep), F.substring(c, -keep, keep)))


def hash_value(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def language_of(c: Column) -> Column:
    """zh above 30 % CJK characters, mixed above 5 %, else en; blank is unknown. Whole texts are read."""
    share = F.length(F.regexp_replace(c, r"[^\x{4e00}-\x{9fff}]", "")) / F.greatest(F.length(c), F.lit(1))
    return F.when(F.length(F.trim(F.coalesce(c, F.lit("")))) == 0, "unknown").when(share > 0.3, "zh").when(share > 0.05, "mixed").otherwise("en")


def csv_safe(c: Column) -> Column:
    """A leading formula sign is escaped with an apostrophe."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def slug(c: Column) -> Column:
    """Lower-case ASCII slug, else the first ten digits of the SHA-1."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-|-$", "")
    return F.when(F.length(s) > 0, s).otherwise(F.substring(F.sha1(c), 1, 10))


def iban_ok(c: Column) -> Column:
    """Whether an IBAN's check digits hold (mod 97)."""
    t = F.upper(F.regexp_replace(c, r"\s", ""))
    moved = F.concat(F.substring(t, 5, 40), F.substring(t, 1, 4))
    codes = F.transform(F.split(moved, ""), lambda ch: F.when(ch.rlike("[0-9]"), ch.try_cast("int")).otherwise(F.ascii(ch) - 55))
    rest = F.aggregate(codes, F.lit(0).cast("long"), lambda a, d: F.when(d >= 10, (a * 100 + d) % 97).otherwise((a * 10 + d) % 97))
    return t.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (rest == 1)


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes [x0, y0, x1, y1]; 0 if they don't meet."""
    w, h = (F.greatest(F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]), F.lit(0.0)) for i in (0, 1))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    whole = area(a) + area(b) - w * h
    return F.when(whole > 0, w * h / whole).otherwise(0.0)
