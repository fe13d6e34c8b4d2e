"""Quantities in mixed units, scales and currencies to one number in one common unit per kind of quantity.

A value is read as number and unit with regular expressions; the unit's alias is normalised by a join with a table of units;
unit field, unit in the text and the source's default are coalesced in this order; factor and offset of the unit apply. Feet and
inches, stones and pounds, hours, minutes and seconds in one text are added up. Nulls, fillers, texts without a figure and
unknown units give null. Common units: m, kg, m2, m3, C, s, 1 (rates as fractions) and EUR (amounts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.common import guarded_broadcast, staged

# Kind, factor and offset to the common unit, names (compared in lower case).
UNITS = [
    ("length", 0.001, 0.0, "mm|millimetre|millimetres|millimeter|millimeters"), ("length", 0.01, 0.0, "cm|centimetre|centimetres|centimeter|centimeters|zentimeter"),
    ("length", 1.0, 0.0, "m|m.|metre|metres|meter|meters|mètres"), ("length", 1000.0, 0.0, "km|kilometre|kilometres|kilometer|kilometers"),
    ("length", 0.0254, 0.0, "in|in.|inch|inches|zoll|\""), ("length", 0.3048, 0.0, "ft|ft.|foot|feet|fuß|'"), ("length", 0.9144, 0.0, "yd|yds|yard|yards"),
    ("length", 1609.344, 0.0, "mi|mile|miles|meilen"), ("length", 1852.0, 0.0, "nmi|nm|nautical mile|nautical miles|seemeilen"),
    ("weight", 1e-6, 0.0, "mg|milligrams"), ("weight", 0.001, 0.0, "g|gr|gr.|gram|grams|gramm|grammes"), ("weight", 1.0, 0.0, "kg|kilogram|kilograms|kilogramm|kilogrammes|kilo|kilos"),
    ("weight", 1000.0, 0.0, "t|tonne|tonnes|tonnen|metric ton|metric tons"), ("weight", 0.45359237, 0.0, "lb|lbs|lb.|pound|pounds"), ("weight", 0.028349523125, 0.0, "oz|oz.|ounce|ounces"),
    ("weight", 6.35029318, 0.0, "st|stone|stones"), ("weight", 1016.0469088, 0.0, "long ton|long tons"), ("weight", 907.18474, 0.0, "short ton|short tons|us ton|us tons"),
    ("floor_area", 1.0, 0.0, "m2|m²|m^2|sqm|sq m|qm|square metre|square metres|square meters|quadratmeter"), ("floor_area", 100.0, 0.0, "a|are|ares|ar"), ("floor_area", 10000.0, 0.0, "ha|hectare|hectares|hektar"),
    ("floor_area", 0.09290304, 0.0, "sq ft|sqft|ft2|ft²|ft^2|square foot|square feet"), ("floor_area", 0.83612736, 0.0, "sq yd|sqyd|yd²|square yard|square yards"), ("floor_area", 4046.8564224, 0.0, "ac|acre|acres"), ("floor_area", 1e6, 0.0, "km²|km2|sq km|square kilometres"),
    ("volume", 1e-6, 0.0, "ml|millilitre|millilitres|milliliters|cm³|cc"), ("volume", 1e-5, 0.0, "cl|centilitres"), ("volume", 0.001, 0.0, "l|litre|litres|liter|liters"), ("volume", 0.1, 0.0, "hl|hectolitre|hectolitres|hektoliter"), ("volume", 1.0, 0.0, "m³|m3|m^3|cbm|cubic metre|cubic metres|cubic meters|kubikmeter"),
    ("volume", 0.003785411784, 0.0, "us gal|us gallon|us gallons|gal (us)|gal us"), ("volume", 0.00454609, 0.0, "imp gal|imperial gallon|imperial gallons|gal (imp.)|gal (imp)|gal (uk)"), ("volume", 0.028316846592, 0.0, "ft³|ft3|ft^3|cu ft|cubic foot|cubic feet"),
    ("temperature", 1.0, 0.0, "c|°c|℃|deg c|celsius|grad celsius|degrees celsius"), ("temperature", 5 / 9, -160 / 9, "f|°f|℉|deg f|fahrenheit|grad fahrenheit|degrees fahrenheit"), ("temperature", 1.0, -273.15, "k|kelvin|°k"),
    ("duration", 1.0, 0.0, "s|sec|secs|second|seconds|sekunden|secondes"), ("duration", 60.0, 0.0, "min|mins|minute|minutes|minuten"), ("duration", 3600.0, 0.0, "h|hr|hrs|hour|hours|std|stunden|heures"), ("duration", 86400.0, 0.0, "d|day|days|tag|tage|jour|jours"), ("duration", 604800.0, 0.0, "week|weeks|wochen|semaines"),
    ("interest_rate", 0.01, 0.0, "%|pct|percent|per cent|prozent|pour cent|v.h."), ("interest_rate", 0.001, 0.0, "‰|per mille|per mill|promille"), ("interest_rate", 0.0001, 0.0, "bp|bps|basis point|basis points|basispunkte"), ("interest_rate", 1.0, 0.0, "ratio|fraction|1"),
]
# Signs and names of a currency, and those of its hundredth.
CURRENCY_NAMES = {"EUR": "€|euro|euros", "USD": "us$|us dollars", "GBP": "£|pounds sterling", "AUD": "a$|au$", "JPY": "¥jp|jp¥|yen", "CHF": "fr.|sfr.|franken", "CNY": "rmb|cn¥|yuan"}
HUNDREDTHS = {"EUR": "ct|euro cents|cents|eurocent", "USD": "us cents", "GBP": "pence|gbx|p", "AUD": "au cents", "CHF": "rappen|rp."}
COMMON_UNIT = {"length": "m", "weight": "kg", "floor_area": "m2", "volume": "m3", "temperature": "C", "duration": "s", "interest_rate": "1", "amount": "EUR"}

_FIGURE = r"\d(?:[\d.,'’     ]*\d)?(?:[eE][+-]?\d+)?"


def unit_rows() -> list[tuple[str, str, float, float, str | None]]:
    """(kind, alias, factor, offset, currency): the units above, and for each currency its code, names, hundredths and scaled forms by rule."""
    rows = [(kind, alias, f, o, None) for kind, f, o, names in UNITS for alias in names.split("|")]
    for code, names in CURRENCY_NAMES.items():
        own = [code.lower(), *names.split("|")]
        scaled = {1.0: own, 1e3: [f"{x} {k}" for x in own for k in ("k", "thousand", "tsd.")] + [f"{t}{code.lower()}" for t in ("k", "t", "tsd. ")], 1e6: [f"{x} {k}" for x in own for k in ("m", "mn", "million", "millions", "mio.", "mio")] + [f"{t}{code.lower()}" for t in ("mio. ", "mio ", "m")]}
        scaled[1e9] = [f"{x} {k}" for x in own for k in ("bn", "billion", "mrd.")]
        scaled[0.01] = HUNDREDTHS[code].split("|") if code in HUNDREDTHS else []
        rows += [("amount", alias, f, 0.0, code) for f, aliases in scaled.items() for alias in aliases]
    return rows


def units(spark: SparkSession, rates: DataFrame | None = None) -> DataFrame:
    """The table of units as a frame (kind, alias, factor, offset); amounts in EUR by `rates` (currency, eur_per_unit)."""
    df = spark.createDataFrame(unit_rows(), "kind string, alias string, factor double, offset double, currency string")
    plain = df.where("currency IS NULL").select("kind", "alias", "factor", "offset")
    if rates is None:
        return plain
    fx = rates.where("currency IS NOT NULL AND eur_per_unit IS NOT NULL").dropDuplicates(["currency"])
    return plain.unionByName(df.join(fx, "currency").select("kind", "alias", (F.col("factor") * F.col("eur_per_unit")).alias("factor"), "offset"))


def decimal_mark(figure: Column) -> Column:
    """The decimal mark that follows from a figure itself: of two marks the last, else the only one, unless it recurs or parts
    exactly three last digits from one to three others."""
    return F.when(figure.rlike(r"\..*,|^[1-9]\d{0,2}(?:\.\d{3})+$|\..*\."), F.when(figure.rlike(r",.*\."), ".").otherwise(",")).when(figure.rlike(r",.*\.|^[1-9]\d{0,2}(?:,\d{3})+$|,.*,"), ".").when(figure.contains(","), ",").otherwise(".")


def number(figure: Column, mark: Column) -> Column:
    """The number of a figure (blanks and apostrophes already removed) with a known decimal mark."""
    return F.when(mark == ",", F.replace(F.replace(figure, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(figure, F.lit(","), F.lit(""))).try_cast("double")


def _several(text: Column) -> Column:
    """Seconds, metres or kilograms of a text with two or three units, else null."""
    low, n = F.lower(text), r"(\d+(?:[.,]\d+)?)"

    def total(pattern: str, *factors: float) -> Column:
        parts = [F.coalesce(F.replace(F.regexp_extract(low, pattern, i + 1), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0)) * f for i, f in enumerate(factors)]
        return F.when(low.rlike(pattern), sum(parts[1:], parts[0]))

    return F.coalesce(
        total(rf"^-?{n}:(\d{{1,2}}):{n}$", 3600, 60, 1),
        total(rf"^-?(?:p(?:(\d+)d)?t)(?:{n}h)?(?:{n}m)?(?:{n}s)?$", 86400, 3600, 60, 1),
        total(rf"^-?{n}\s*h(?:rs?|ours?)?\s*{n}\s*m(?:in)?(?:utes?)?\.?(?:\s*{n}\s*s(?:ec)?(?:onds?)?\.?)?$", 3600, 60, 1),
        total(rf"^-?{n}\s*(?:ft\.?|feet|foot)\s*{n}\s*(?:in\.?|inch|inches)$", 0.3048, 0.0254),
        total(rf"^-?{n}\s*'\s*{n}\s*\"$", 0.3048, 0.0254),
        total(rf"^-?{n}\s*(?:st|stone)\s*{n}\s*(?:lb|lbs|pounds)$", 6.35029318, 0.45359237),
        total(rf"^-?{n}\s*(?:lb|lbs|pounds)\s*{n}\s*(?:oz|ounces)$", 0.45359237, 0.028349523125),
    )


def to_common_unit(df: DataFrame, unit_table: DataFrame, *, kind: str, value: str, unit: str, mark: str | None = None, dollar: str | None = None) -> DataFrame:
    """The rows of df with `quantity` (double in the kind's common unit, or null). `mark` is the source's decimal mark, `dollar` the
    currency that a bare $ means and that an amount without any unit is in."""
    # the caller's columns travel in one struct, so none of them can clash with those made here
    nothing = F.lit(None).cast("string")
    kept = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "quantity"]).alias("_own")
    df = df.select(kept, F.col(kind).alias("_k"), F.col(value).alias("_v"), F.col(unit).alias("_u"), (F.col(mark) if mark else nothing).alias("_m"), F.lower(F.col(dollar) if dollar else nothing).alias("_home"))
    kind, unit, t, m, home = "_k", "_u", F.trim("_v"), F.col("_m"), F.col("_home")
    figure = F.regexp_extract(t, _FIGURE, 0)
    left = F.regexp_replace(t, r"\(([^)]*\d[^)]*)\)", "$1")  # parentheses that hold the figure
    said = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(left, rf"^(\D*){_FIGURE}", "$1 "), r"(?:^|\s)[-−+](?=\s|\D|$)", " "), r"[     ]+", " "))
    figure = F.regexp_replace(F.nullif(figure, F.lit("")), r"['’     ]", "")
    df = staged(df, {"_figure": figure, "_mark": F.coalesce(m, decimal_mark(F.regexp_replace(figure, "[eE].*$", ""))), "_said": F.lower(said), "_minus": t.rlike(r"\([^)]*\d[^)]*\)|^\D*[-−]\s*\D{0,4}\d"), "_sum": F.when(F.col(kind).isin("length", "weight", "duration"), _several(t))})
    field = F.lower(F.trim(F.regexp_replace(F.col(unit), r"[     ]+", " ")))
    alias = F.coalesce(F.nullif(field, F.lit("")), F.nullif(F.col("_said"), F.lit("")), F.when(F.col(kind) == "amount", home))
    df = staged(df, {"_alias": F.when(alias == "$", home).otherwise(alias), "_n": number(F.col("_figure"), F.col("_mark"))})
    side = unit_table.select(F.col("kind").alias("_kind"), F.col("alias").alias("_name"), F.col("factor").alias("_factor"), F.col("offset").alias("_offset"))
    df = df.join(guarded_broadcast(side), (F.col(kind) == F.col("_kind")) & (F.col("_alias") == F.col("_name")), "left")
    plain = F.when(F.col("_minus"), -F.col("_n")).otherwise(F.col("_n")) * F.col("_factor") + F.col("_offset")
    total = F.when(F.col("_minus"), -F.col("_sum")).otherwise(F.col("_sum"))
    return df.select("_own.*", F.coalesce(total, plain).alias("quantity"))


def same_quantity(df: DataFrame, key: str, group: list[str], *, kind: str, quantity: str = "quantity", relative: float = 0.002, degrees: float = 0.1) -> DataFrame:
    """(left_id, right_id): rows of one group that state the same quantity: apart by less than `relative` of the larger, temperatures
    by less than `degrees`. A band join: values fall into bands as wide as the tolerance, so only rows of neighbouring bands meet,
    also in a group that holds a large share of all rows. Rows with a null group, key or quantity pair with nothing."""
    q = F.col(quantity)
    base = df.where(q.isNotNull() & ~F.isnan(q) & F.col(key).isNotNull()).select(key, *group, kind, q)
    step = -F.log(F.lit(1 - relative))
    scaled = F.when(F.col(kind) == "temperature", q / degrees).when(q == 0, F.lit(-1e6)).otherwise(F.log(F.abs(q)) / step)
    base = base.withColumns({"_band": F.floor(scaled), "_sign": F.when(F.col(kind) == "temperature", 0).otherwise(F.signum(q).cast("int"))})
    left = base.select(*group, "_sign", "_band", F.col(key).alias("left_id"), q.alias("_lq"))
    right = base.select(*group, "_sign", F.explode(F.array(*[F.col("_band") + i for i in (-1, 0, 1)])).alias("_band"), F.col(key).alias("right_id"), q.alias("_rq"), F.col(kind).alias("_kind"))
    apart, larger = F.abs(F.col("_lq") - F.col("_rq")), F.greatest(F.abs(F.col("_lq")), F.abs(F.col("_rq")))
    close = F.when(F.col("_kind") == "temperature", apart < degrees).otherwise((apart < larger * relative) | (apart == 0))
    return left.join(right, [*group, "_sign", "_band"]).where((F.col("left_id") < F.col("right_id")) & close).select("left_id", "right_id")
