"""Column -> Column functions on the texts of cells and labels: unwrapping lines, amounts, dates, misread figures. All stay in the JVM.

Null gives null; texts that a function has nothing to say about come out as they are, or trimmed where it says so."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_CJK = r"\x{3400}-\x{9fff}"
# Repairs of amounts, in this order.
AMOUNT_REPAIRS = [
    (r"([+-]?\d[\d,]*): (\d{2})\b", "$1.$2"), (r"(\d{1,3})\.(\d{3}):(\d{2})\b", "$1,$2.$3"), (r"([+-]?\d{1,3});(\d{3}[.\d]*)", "$1,$2"), (r"(\d{3})-(\d{2})\b", "$1.$2"), (r"(\d)\. (\d{3})\. (\d{2})\b", "$1,$2.$3"),
    (r"(\d)\. (\d{3})\. (\d{2})", "$1,$2.$3"), (r"^\.(\d{1,3},\d{3}\.\d{2})", "$1"), (r"([+-]?\d{1,3});(\d{3}\.\d{2})", "$1,$2"), (r"(\d), (\d{3})", "$1,$2"), (r"(\d)\. (\d{2})\b", "$1.$2"),
]
# Repairs of dates, in this order.
DATE_REPAIRS = [(r"(\d{4})[~～](\d{2})[-~～]?(\d{2})", "$1-$2-$3"), (r"(\d{4})\s*[-–—]\s*(\d{2})\s*[-–—]\s*(\d{2})", "$1-$2-$3"), (r"(\d{4})\.(\d{2})\.(\d{2})", "$1-$2-$3")]
# Letters and digits that are taken for one another, by what stands around them, in this order.
CONFUSED = [
    (r"(?<=\d)[Oo](?=\d)", "0"), (r"(?<=\d)[Oo]([.,\s]|$)", "0$1"), (r"(?<=[a-zA-Z])0(?=[a-zA-Z])", "O"), (r"(?<=\d)[Il](?=\d)", "1"), (r"(?<=[a-z])1(?=[a-z])", "l"), (r"(?<=[A-Z])1(?=[A-Z])", "I"),
    (r"(?<=\d)[Ss](?=\d)", "5"), (r"(?<=[a-zA-Z])5(?=[a-zA-Z])", "S"), (r"^S(?=\d{2,})", "5"),
]
# Signs and words of currencies, in the order in which they are looked for.
CURRENCIES = [("USD", r"\$|USD|美元"), ("EUR", "€|EUR|欧元"), ("GBP", "£|GBP|英镑"), ("CNY", "¥|￥|CNY|RMB|人民币|元|圆")]


def _in_order(c: Column, repairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, *r), repairs, c)


def unwrapped_cell(c: Column) -> Column:
    """A cell without the line breaks of its layout: date and time by a blank, numbers joined tight, other lines by a blank, none between CJK signs."""
    t = F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "\r", "\n")
    moment = r"^\s*((?:19|20)\d{2}[-/.]\d{1,2}[-/.]\d{1,2})\s*\n\s*(\d{1,2}:\d{2}(?::\d{2})?)\s*$"
    tight = F.regexp_replace(t, r"\s+", "")
    n = F.length(tight)
    number = (n >= 10) & (tight.rlike(r"^[A-Za-z0-9\-_]{8,}$") | ((n >= 12) & (F.length(F.regexp_replace(tight, r"\D", "")) > 0.5 * n)))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    joined = F.regexp_replace(F.array_join(lines, "\n"), rf"(?<=[{_CJK}])\n(?=[{_CJK}])", "")
    return F.when(~t.contains("\n"), t).when(t.rlike(moment), F.regexp_replace(t, moment, "$1 $2")).when(number, tight).otherwise(F.replace(joined, F.lit("\n"), F.lit(" ")))


def cleaned_cell(c: Column) -> Column:
    """Line breaks to blanks, blanks between CJK signs away, trimmed."""
    t = F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))
    cjk = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"
    return F.trim(F.regexp_replace(t, rf"(?<={cjk})\s+(?={cjk})", ""))


def repaired_amounts(c: Column) -> Column:
    return _in_order(c, AMOUNT_REPAIRS)


def repaired_dates(c: Column) -> Column:
    return _in_order(c, DATE_REPAIRS)


def repaired_confusions(c: Column) -> Column:
    return _in_order(c, CONFUSED)


def without_digit_noise(c: Column) -> Column:
    return F.regexp_replace(c, r"(\d{5}),\s*$", "$1")


def amount_of(c: Column) -> Column:
    """Number of an amount without currency signs, commas, blanks and leading plus, rounded to cents (halves away from zero); null on failure."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), r"[¥￥$€£₤₩,，\s元圆]", ""), r"^\++", "")
    return F.when(t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), F.round(t.try_cast("double"), 2))


def generic_amount(c: Column) -> Column:
    """Number of an amount in any currency: parentheses are negative, a final thousands point as in 127,500.000.00 is repaired."""
    t = F.trim(c)
    brackets = t.rlike(r"^\(.*\)$")
    t = F.when(brackets, F.trim(F.regexp_replace(t, r"^\(|\)$", ""))).otherwise(t)
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"(?i)\b(?:CNY|RMB|USD|EUR|GBP)\b", ""), "人民币|美元|欧元|英镑", ""))
    n = amount_of(F.regexp_replace(t, r"^([-+]?\d{1,3}(?:,\d{3})*)\.(\d{3})\.(\d{2})$", "$1,$2.$3"))
    return F.when(brackets, -F.abs(n)).otherwise(n)


def signed_amount(c: Column) -> Column:
    """(amount, direction): minus is expense, plus or no sign income, no number other."""
    n = amount_of(F.regexp_replace(F.trim(c), "[,¥￥]", ""))
    return F.struct(F.abs(n).alias("amount"), F.when(n.isNull(), "other").when(F.trim(c).startswith("-"), "expense").otherwise("income").alias("direction"))


def currency_of(c: Column) -> Column:
    """The currency whose sign or word a text holds, in fixed order, or null."""
    up = F.upper(c)
    return reduce(lambda rest, x: F.when(up.rlike(x[1]), x[0]).otherwise(rest), reversed(CURRENCIES), F.lit(None).cast("string"))


def iso_date(c: Column) -> Column:
    """The first date in a text as yyyy-MM-dd, in four fixed forms; the calendar isn't looked at. Null if there is none."""
    forms = [(r"(\d{4})年(\d{1,2})月(\d{1,2})日", (1, 2, 3)), (r"(\d{4})/(\d{1,2})/(\d{1,2})", (1, 2, 3)), (r"(\d{4})-(\d{1,2})-(\d{1,2})", (1, 2, 3)), (r"(\d{1,2})/(\d{1,2})/(\d{4})", (3, 1, 2))]
    part = lambda f, i: F.regexp_extract(c, f, i)
    iso = lambda f, at: F.concat_ws("-", part(f, at[0]), F.lpad(part(f, at[1]), 2, "0"), F.lpad(part(f, at[2]), 2, "0"))
    return reduce(lambda rest, x: F.when(c.rlike(x[0]), iso(*x)).otherwise(rest), reversed(forms), F.lit(None).cast("string"))


def period_of(c: Column) -> Column:
    """The first range of dates in a text, or an empty text."""
    day = r"\d{4}[-./年]\d{1,2}[-./月]\d{1,2}日?"
    return F.regexp_extract(c, rf"({day}\s*[~\-至]\s*{day})", 1)


def phone_of(c: Column, confirmed: bool = False) -> Column:
    """The digits of a phone number, with a leading plus if it has one; empty if it is none."""
    t = F.trim(c)
    digits = F.regexp_replace(t, r"\D", "")
    form = t.rlike(r"^\+?[0-9][0-9 ()-]{5,20}$") & F.length(digits).between(6, 15)
    plain = digits.rlike(r"^1[3-9]\d{9}$") | t.rlike("[ ()-]") | F.lit(confirmed)
    return F.when(~form, "").when(t.startswith("+"), F.concat(F.lit("+"), digits)).when(plain, digits).otherwise("")


def review_of(refs: Column, confidence: Column) -> Column:
    """Review status of a field by its evidence and confidence."""
    return F.when(~refs, "needs_evidence").when(confidence >= 0.85, "auto_accepted").when(confidence >= 0.60, "manual_optional").otherwise("needs_review")
