"""Mixed timestamp texts to one unambiguous instant.

A text denotes an instant if it holds a date and a time of day that exist. The instant comes out as whole seconds since
1970-01-01T00:00:00Z (fractions are cut off). A text without a zone is a wall time of its source; the source's zone is the
declared one or else the one that `estimate_zones` finds. Of a wall time that occurs twice the earlier instant is meant; a
wall time that the zone skips denotes none. Nulls, fillers, dates without a time and impossible values give null.

Everything is a Catalyst expression: no Python runs per row, so scans keep column pruning and whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.common import guarded_broadcast, latest, materialized, staged

# First letters by which a month is known in English, German, French and Spanish.
MONTHS = {
    1: "jan jän ene", 2: "feb fév fev", 3: "mar mär mrz", 4: "apr avr abr", 5: "may mai", 6: "jun juin", 7: "jul juil",
    8: "aug aoû aou ago", 9: "sep", 10: "oct okt", 11: "nov", 12: "dec dez déc dic",
}
# Minutes east of Greenwich by zone abbreviation; the last column names zones in which it differs.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120, "EET": 120, "EEST": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "JST": 540, "KST": 540, "IST": 330, "SGT": 480, "HKT": 480, "NZST": 720, "NZDT": 780,
}
BY_ZONE = {("Australia/", "EST"): 600, ("Australia/", "EDT"): 660, ("Australia/", "CST"): 570, ("Asia/Shanghai", "CST"): 480, ("Asia/Jerusalem", "IST"): 120, ("Europe/Dublin", "IST"): 60}

#: Zones that are tried for a source without a declared zone (a parameter of estimate_zones).
CANDIDATES = (
    "UTC", "Europe/London", "Europe/Berlin", "Europe/Helsinki", "Europe/Moscow", "America/New_York", "America/Chicago", "America/Denver",
    "America/Los_Angeles", "America/Sao_Paulo", "Asia/Kolkata", "Asia/Shanghai", "Asia/Tokyo", "Australia/Sydney", "Australia/Perth", "Pacific/Auckland",
)

_CLOCK = r"(\d{1,2})[:hH](\d{2})(?::(\d{2})(?:[.,]\d+)?)?\s*([AaPp]\.?[Mm]\.?(?![A-Za-z]))?\s*(?:Uhr|Uhrzeit|h)?"
_ZONE = r"\s*,?\s*([Zz]|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]+/[A-Za-z_/+-]+|[A-Z]{2,5})?\s*"
_BETWEEN = r"(?:T|,?\s*(?:à|at|um|a las)?\s*)"
_WEEKDAY = r"(?:\p{L}{2,10}\.?,\s*)?"
# Each form puts year, month, day, hour, minute, second, half of the day and zone in this order; "n" marks dates in the source's order.
_FORMS = (
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_BETWEEN}{_CLOCK}{_ZONE}$", "d|$1|$2|$3|$4|$5|$6|$7|$8"),
    (r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(\d{2})?(?:[.,]\d+)?" + _ZONE + "$", "d|$1|$2|$3|$4|$5|$6||$7"),
    (rf"^{_WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th)?[\s.-]+(?:de\s+)?(\p{{L}}{{3,10}})\.?[\s,.-]+(?:de\s+)?(\d{{4}}){_BETWEEN}{_CLOCK}{_ZONE}$", "d|$3|$2|$1|$4|$5|$6|$7|$8"),
    (rf"^{_WEEKDAY}(\p{{L}}{{3,10}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){_BETWEEN}{_CLOCK}{_ZONE}$", "d|$3|$1|$2|$4|$5|$6|$7|$8"),
    (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}}){_BETWEEN}{_CLOCK}{_ZONE}$", "n|$1|$2|$3|$4|$5|$6|$7|$8"),
    (rf"^(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日\s*(\d{{1,2}})[時时:](\d{{1,2}})(?:分|:)?(?:(\d{{1,2}})秒?)?{_ZONE}$", "d|$1|$2|$3|$4|$5|$6||$7"),
)


def _parts(text: Column) -> Column:
    t = F.regexp_replace(F.trim(text), r"[\s    ]+", " ")
    return F.split(reduce(lambda rest, form: F.when(t.rlike(form[0]), F.regexp_replace(t, *form)).otherwise(rest), reversed(_FORMS), F.lit(None).cast("string")), r"\|")


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _month(name: Column) -> Column:
    known, low = _map({w: m for m, words in MONTHS.items() for w in words.split()}), F.lower(name)
    return F.coalesce(F.try_element_at(known, F.substring(low, 1, 4)), F.try_element_at(known, F.substring(low, 1, 3)))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _seconds(ntz: Column) -> Column:
    """Seconds since 1970 of a wall time read as UTC; no session zone is involved."""
    return F.datediff(ntz.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ntz) * 3600 + F.minute(ntz) * 60 + F.second(ntz)


def _offset_minutes(zone: Column, source_zone: Column) -> Column:
    """Minutes east of Greenwich of a numeric zone or an abbreviation; null otherwise."""
    num = F.regexp_replace(F.regexp_replace(zone, "^(?:UTC|GMT)(?=[+-])", ""), ":", "")
    bare = F.substring(num, 2, 9)
    of_num = F.when(F.length(bare) <= 2, _int(bare) * 60).otherwise(_int(bare) - F.floor(_int(bare) / 100).cast("int") * 40)
    signed = F.when(F.substring(num, 1, 1) == "-", -of_num).otherwise(of_num)
    own = F.try_element_at(_map({f"{a}{z}": m for (a, z), m in BY_ZONE.items()}), F.concat(F.regexp_replace(source_zone, "^(Australia/).*$", "$1"), F.upper(zone)))
    return F.when(num.rlike("^[+-]"), F.when(of_num <= 18 * 60, signed)).otherwise(F.coalesce(own, F.try_element_at(_map(ABBREVIATIONS), F.upper(zone))))


def zone_names(spark: SparkSession) -> list[str]:
    """Region names that the JVM can convert with."""
    return sorted(z for z in map(str, spark._jvm.java.time.ZoneId.getAvailableZoneIds().toArray()) if "/" in z)


def read_times(df: DataFrame, text: str, date_order: str, source_zone: str) -> DataFrame:
    """Adds _abs (seconds, where the text alone fixes the instant), _wall (wall time without a zone) and _named (zone named in the text, or null)."""
    zones = zone_names(df.sparkSession)
    t, order = F.trim(F.col(text)), F.upper(F.coalesce(F.col(date_order), F.lit("DMY")))
    df = staged(df, {"_p": _parts(F.col(text))})
    p = [F.get(F.col("_p"), i) for i in range(9)]
    df = staged(df, {"_a": _int(p[1]), "_b": F.coalesce(_int(p[2]), _month(p[2])), "_c": _int(p[3]), "_short": F.length(p[3]) == 2, "_order": F.when(p[0] == "n", order).otherwise("fixed"), "_h": _int(p[4]), "_half": F.lower(F.substring(p[7], 1, 1)), "_z": F.nullif(p[8], F.lit(""))})
    a, b, c, o, h, half = (F.col(x) for x in ("_a", "_b", "_c", "_order", "_h", "_half"))
    first = (o == "fixed") | ((o == "YMD") & F.col("_short"))  # the year stands first
    year = F.when(first, a).otherwise(c)
    df = staged(df, {"_year": F.when(year < 100, year + 2000).otherwise(year), "_month": F.when(o == "MDY", a).otherwise(b), "_day": F.when(o == "MDY", b).when(first, c).otherwise(a)})
    hour = F.when(half == "", h).when(h.between(1, 12), h % 12 + F.when(half == "p", 12).otherwise(0))
    wall = F.try_make_timestamp_ntz(F.col("_year"), F.col("_month"), F.col("_day"), hour, _int(p[5]), F.coalesce(_int(p[6]), F.lit(0)).cast("decimal(16,6)"))
    digits = F.regexp_extract(t, r"^(\d{9,17})(?:[.,]\d+)?$", 1)
    df = staged(df, {"_wall": wall, "_off": _offset_minutes(F.col("_z"), F.col(source_zone)), "_named": F.when(F.col("_z").isin(zones), F.col("_z")), "_n": digits.try_cast("long"), "_len": F.length(digits)})
    epoch = F.when(F.col("_len") < 12, F.col("_n")).when(F.col("_len") < 15, F.expr("_n DIV 1000")).otherwise(F.expr("_n DIV 1000000"))
    known = F.col("_z").isNull() | F.col("_off").isNotNull() | F.col("_named").isNotNull()
    df = staged(df, {"_abs": F.coalesce(epoch, _seconds(F.col("_wall")) - F.col("_off") * 60), "_wall": F.when(F.col("_off").isNull() & known, F.col("_wall"))})
    return df.drop("_p", "_a", "_b", "_c", "_short", "_h", "_half", "_z", "_year", "_month", "_day", "_off", "_n", "_len")


def wall_seconds(wall: Column, zone: Column) -> Column:
    """Seconds of a wall time in a zone: the earlier of two, null if the zone skips it. Both must not be null."""
    utc = F.call_function("convert_timezone", zone, F.lit("UTC"), wall)
    back = F.call_function("convert_timezone", F.lit("UTC"), zone, utc)
    return F.when(back == wall, _seconds(utc))


def estimate_zones(timed: DataFrame, source: str, group: Sequence[str], arrived: str, candidates: Sequence[str] = CANDIDATES) -> DataFrame:
    """(source, zone, violations, evidence, offsets): per source the candidate zone whose offset history fits its wall times best, and the
    history it fits by: each offset in minutes with the first and the last wall hour that it accounts for.

    Evidence is, first, the instants that other sources fix for the same item (`group`), as far as they differ from the wall time by a whole
    number of quarter hours and so may be the same event: one that the zone's offset at that time doesn't align counts as a violation; second,
    the arrival: an instant after it counts as a violation of order. Rows are counted per source, wall hour and offset before candidates are
    tried, so the work after the first aggregation grows with hours of history and not with rows. Ties fall to the candidate listed first.
    Sources without wall times give no row.
    """
    walls = timed.where(F.col("_wall").isNotNull() & F.col("_named").isNull() & F.col(source).isNotNull())
    anchors = timed.where(F.col("_abs").isNotNull()).select(*group, F.col("_abs").alias("_anchor")).distinct()
    apart = _seconds(F.col("_wall")) - F.col("_anchor")
    near = (F.abs(apart) <= 15 * 3600) & (F.pmod(apart + 60, F.lit(900)) <= 120)
    hour = F.date_trunc("hour", F.col("_wall")).cast("timestamp_ntz").alias("_hour")
    seen = walls.join(anchors, list(group)).where(near).select(source, hour, F.round(apart / 900).cast("int").alias("_steps"))
    aligned = seen.groupBy(source, "_hour", "_steps").agg(F.count("*").alias("_n"))
    late = walls.select(source, hour, F.floor((_seconds(F.col("_wall")) - F.unix_seconds(F.col(arrived).cast("timestamp"))) / 900).alias("_steps"))
    late = late.where(F.abs(F.col("_steps")) <= 60).groupBy(source, "_hour", "_steps").agg(F.count("*").alias("_n"))
    evidence = aligned.withColumn("_kind", F.lit(0)).unionByName(late.withColumn("_kind", F.lit(1)).withColumn("_steps", F.col("_steps").cast("int")))
    tried = evidence.withColumn("_c", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(z).alias("z")) for i, z in enumerate(candidates)])))
    tried = tried.withColumn("_of_zone", F.floor((_seconds(F.col("_hour")) - F.coalesce(wall_seconds(F.col("_hour"), F.col("_c.z")), F.lit(0))) / 900))
    bad = F.when(F.col("_kind") == 0, F.col("_of_zone") != F.col("_steps")).otherwise(F.col("_steps") > F.col("_of_zone"))
    of_kind = lambda k: F.sum(F.when((F.col("_kind") == k) & bad, F.col("_n")).otherwise(0))
    by_offset = tried.groupBy(source, "_c", "_of_zone").agg(of_kind(0).alias("_bad"), of_kind(1).alias("_late"), F.sum("_n").alias("_n"), F.min("_hour").alias("first_hour"), F.max("_hour").alias("last_hour"))
    history = F.array_sort(F.collect_list(F.struct("first_hour", "last_hour", (F.col("_of_zone") * 15).cast("int").alias("minutes"))))
    scored = by_offset.groupBy(source, "_c").agg(F.sum("_bad").alias("violations"), F.sum("_late").alias("_late"), F.sum("_n").alias("evidence"), history.alias("offsets"))
    best = scored.groupBy(source).agg(F.min_by(F.struct(F.col("_c.z").alias("zone"), "violations", "evidence", "offsets"), F.struct("violations", "_late", "_c.i")).alias("_b"))
    return best.select(source, "_b.*")


def to_instants(df: DataFrame, sources: DataFrame, *, text: str = "value", source: str = "feed_id", zone: str = "tz_name", date_order: str = "date_order", key: str = "cell_id", group: Sequence[str] = ("record_id", "field_key"), arrived: str = "ingested_at", candidates: Sequence[str] = CANDIDATES) -> DataFrame:
    """(key, group, source, text, instant): the latest delivery of each row with its instant in seconds since 1970, or null.

    Texts are read before the rows are shuffled by key, once for all that follows. Zones are estimated for the sources whose wall times have
    neither a zone of their own nor a declared one, and only if there are such. Rows without a source keep what their text alone fixes.
    Columns of df other than those named are left out.
    """
    side = sources.select(F.col(source).alias("_source"), F.col(zone).alias("_zone"), F.col(date_order).alias("_declared_order")).where(F.col(source).isNotNull()).dropDuplicates(["_source"])
    given = df.select(key, *group, source, text, arrived).join(guarded_broadcast(side), F.col(source) == F.col("_source"), "left")
    timed = materialized(latest(read_times(given, text, "_declared_order", "_zone"), key, arrived, *group, source, text, arrived, "_abs", "_wall", "_named", "_zone"))
    open_ends = timed.where(F.col("_wall").isNotNull() & F.col("_named").isNull() & F.col("_zone").isNull() & F.col(source).isNotNull())
    if open_ends.limit(1).count():
        unzoned = open_ends.select(source).distinct()
        found = estimate_zones(timed.join(guarded_broadcast(unzoned), source, "left_semi").unionByName(timed.where(F.col("_abs").isNotNull()).withColumn(source, F.lit(None).cast(timed.schema[source].dataType))), source, group, arrived, candidates)
        timed = timed.join(guarded_broadcast(found.select(F.col(source).alias("_esource"), F.col("zone").alias("_ezone"))), F.col(source) == F.col("_esource"), "left")
    else:
        timed = timed.withColumn("_ezone", F.lit(None).cast("string"))
    use = F.coalesce(F.col("_named"), F.col("_zone"), F.col("_ezone"))
    instant = F.coalesce(F.col("_abs"), F.when(F.col("_wall").isNotNull() & use.isNotNull(), wall_seconds(F.col("_wall"), use)))
    return timed.select(key, *group, source, text, instant.alias("instant"))
