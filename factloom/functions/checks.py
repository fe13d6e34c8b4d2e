"""Column -> Column checks and repairs of numbers with check digits and of formatted texts. All stay in the JVM.

A check of null is null; an empty text fails every check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.scalars import iban_ok

# The characters of a social credit code, whose weights are the powers of 3 modulo 31.
CREDIT_CHARS = "0123456789ABCDEFGHJKLMNPQRTUWXY"
# Weights and check characters of a resident identity number.
RESIDENT_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
RESIDENT_CHECKS = "10X98765432"
# Glyphs that are read for one another.
GLYPHS = {"O": "O0", "I": "I1", "L": "L1", "Z": "Z2", "S": "S5", "B": "B8", "0": "0O", "1": "1IL", "2": "2Z", "5": "5S", "8": "8B"}
# Forms of texts.
FORMS = {"bic": r"^[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$", "eu_vat": r"^[A-Z]{2}[A-Z0-9]{2,12}$", "us_ein": r"^\d{2}-?\d{7}$", "jp_corporate": r"^\d{13}$", "sg_uen": r"^(?:\d{8}[A-Z]|\d{9}[A-Z]|[STF]\d{2}[A-Z]{2}\d{4}[A-Z])$", "email": r"^[^\s@]+@[^\s@]+\.[^\s@]+$", "phone": r"^\+?[0-9][0-9 ()-]{5,20}$"}
_STRIPPED = {"bic": r"\s+", "eu_vat": r"[\s.-]+", "jp_corporate": r"\s+", "sg_uen": r"\s+"}
#: Variants of a code up to which a repair is looked for.
MOST_VARIANTS = 4096


def _squeezed(c: Column, away: str = r"\s+") -> Column:
    return F.upper(F.regexp_replace(c, away, ""))


def has_form(kind: str, c: Column) -> Column:
    """Whether a text has one of FORMS, after blanks and, for some, letter case are set aside."""
    return (_squeezed(c, _STRIPPED[kind]) if kind in _STRIPPED else F.trim(c)).rlike(FORMS[kind])


def _digits(c: Column, chars: str) -> Column:
    return F.transform(F.split(c, ""), lambda ch: F.instr(F.lit(chars), ch) - 1)


def _weighted(digits: Column, weights: list[int]) -> Column:
    return F.aggregate(F.zip_with(digits, F.array(*map(F.lit, weights)), lambda d, w: d * w), F.lit(0), lambda a, x: a + x)


def _credit_ok(t: Column) -> Column:
    digits = _digits(t, CREDIT_CHARS)
    total = _weighted(F.slice(digits, 1, 17), [pow(3, i, 31) for i in range(17)])
    return t.rlike(f"^[{CREDIT_CHARS}]{{18}}$") & (F.element_at(digits, 18) == (31 - total % 31) % 31)


def credit_code_ok(c: Column) -> Column:
    """Whether the check character of an 18-character social credit code holds."""
    t = _squeezed(c)
    return F.coalesce(_credit_ok(t), F.when(c.isNotNull(), False))


def resident_id_ok(c: Column) -> Column:
    """Whether the date and the check character of an 18-character resident identity number hold."""
    t = _squeezed(c, r"[\s-]+")
    total = _weighted(_digits(F.substring(t, 1, 17), "0123456789"), list(RESIDENT_WEIGHTS))
    real = F.try_to_date(F.substring(t, 7, 8), "yyyyMMdd").isNotNull()
    good = t.rlike(r"^\d{17}[\dX]$") & real & (F.substring(t, 18, 1) == F.get(F.split(F.lit(RESIDENT_CHECKS), ""), total % 11))
    return F.coalesce(good, F.when(c.isNotNull(), False))


def date_text_ok(c: Column) -> Column:
    """Whether a text is a date of 1900 to 2099 that exists, year first."""
    form = r"^((?:19|20)\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})日?$"
    t = F.trim(c)
    iso = F.concat_ws("-", F.regexp_extract(t, form, 1), F.lpad(F.regexp_extract(t, form, 2), 2, "0"), F.lpad(F.regexp_extract(t, form, 3), 2, "0"))
    return F.when(c.isNotNull(), t.rlike(form) & F.when(t.rlike(form), F.try_to_date(iso, "yyyy-MM-dd")).isNotNull())


def amount_text_ok(c: Column) -> Column:
    """Whether a text is an amount with commas, if any, between groups of three digits."""
    return F.regexp_replace(F.trim(c), "[￥¥]", "").rlike(r"^[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?$")


def _glyphs(ch: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in GLYPHS.items() for x in pair])
    return F.split(F.coalesce(F.try_element_at(known, ch), ch), "")


def repaired_iban(c: Column) -> Column:
    """The IBAN itself if it holds, else the only one that holds and differs from it in one glyph; else null."""
    t = _squeezed(c)
    at = F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1)))

    def changed(i: Column) -> Column:
        ch = F.substring(t, i, F.lit(1))
        fits = lambda x: F.when(i <= 2, x.rlike("[A-Z]")).when(i <= 4, x.rlike(r"\d")).otherwise(True)
        return F.transform(F.filter(_glyphs(ch), lambda x: (x != ch) & fits(x)), lambda x: F.concat(F.substring(t, F.lit(1), i - 1), x, F.substring(t, i + 1, F.lit(99))))

    variants = F.filter(F.flatten(F.transform(at, changed)), iban_ok)
    return F.when(iban_ok(t), t).when(F.size(variants) == 1, F.get(variants, 0))


def repaired_credit_code(c: Column) -> Column:
    """The code itself if it holds, else the only one among its look-alikes that does, if there are at most MOST_VARIANTS; else null."""
    t = _squeezed(c)
    options = F.transform(F.split(t, ""), lambda ch: F.filter(_glyphs(ch), lambda x: F.instr(F.lit(CREDIT_CHARS), x) > 0))
    count = F.aggregate(options, F.lit(1).cast("long"), lambda a, o: F.least(a * F.size(o), F.lit(MOST_VARIANTS + 1).cast("long")))
    grown = F.aggregate(options, F.array(F.lit("")), lambda acc, o: F.flatten(F.transform(acc, lambda p: F.transform(o, lambda x: F.concat(p, x)))))
    variants = F.filter(grown, lambda v: (v != t) & _credit_ok(v))
    tried = F.when((F.length(t) == 18) & ~F.coalesce(_credit_ok(t), F.lit(False)) & (count > 0) & (count <= MOST_VARIANTS), variants)
    return F.when(F.coalesce(_credit_ok(t), F.lit(False)), t).when(F.size(tried) == 1, F.get(tried, 0))
