"""Nested records, instants and quantities: literal cases, brute force, edge cases."""

from __future__ import annotations

import datetime as dt
import json
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from factloom.operators import instants, nested, quantities

FEEDS = "feed_id bigint, tz_name string, date_order string"


def _instants(spark, rows, feeds=((1, "Europe/London", "DMY"), (4, "America/New_York", "MDY"), (7, "Asia/Tokyo", "YMD"), (6, "Australia/Sydney", "DMY"))):
    cells = spark.createDataFrame([(i, "r", "filed_at", f, v, dt.datetime(2024, 1, 1)) for i, (f, v) in enumerate(rows)], "cell_id bigint, record_id string, field_key string, feed_id bigint, value string, ingested_at timestamp")
    out = instants.to_instants(cells, spark.createDataFrame(list(feeds), FEEDS))
    return {r["cell_id"]: r["instant"] for r in out.collect()}


def _utc(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp())


def test_forms_of_times(spark):
    cases = [
        (1, "2010-09-04T17:36:00Z", _utc(2010, 9, 4, 17, 36)), (1, "20170224T223100Z", _utc(2017, 2, 24, 22, 31)), (1, "30 March 2014, 02:28:21 BST", _utc(2014, 3, 30, 1, 28, 21)),
        (1, "Tue, 15 Jun 2021 12:21:00 +0100", _utc(2021, 6, 15, 11, 21)), (1, "2014-03-16 03:38:53 Europe/London", _utc(2014, 3, 16, 3, 38, 53)), (1, "2012-07-10 06:20:00 America/New_York", _utc(2012, 7, 10, 10, 20)), (1, "28/10/2018 00:35", _utc(2018, 10, 27, 23, 35)),
        (1, "1512006738", 1512006738), (1, "1271417968207", 1271417968), (1, "1383740380922518", 1383740380), (1, "1509326800.326", 1509326800), (1, "2017-10-2823:43:00", _utc(2017, 10, 28, 22, 43)),
        (1, "24 mai 2012 à 13h50:42", _utc(2012, 5, 24, 12, 50, 42)), (1, "1. März 2010, 04:34", _utc(2010, 3, 1, 4, 34)), (1, "05.11.23 05:41:30", _utc(2023, 11, 5, 5, 41, 30)), (1, "17.06.2013 00:14:41 Uhr", _utc(2013, 6, 16, 23, 14, 41)),
        (4, "Jan 22, 2020 04:59:00 PM EST", _utc(2020, 1, 22, 21, 59)), (4, "5/24/12 07:50:41", _utc(2012, 5, 24, 11, 50, 41)), (4, "November 12, 2011 12:14:38 am", _utc(2011, 11, 12, 5, 14, 38)), (4, "11/06/2022 01:30 AM", _utc(2022, 11, 6, 5, 30)),
        (6, "28 July 2012, 12:40:58 EST", _utc(2012, 7, 28, 2, 40, 58)), (7, "2012.03.02 19:06:46", _utc(2012, 3, 2, 10, 6, 46)), (7, "12/03/02 19:06", _utc(2012, 3, 2, 10, 6)), (1, "2012-05-17 20:47:00.5-03:30", _utc(2012, 5, 18, 0, 17)),
        (1, "2020-03-28", None), (1, "see docket", None), (1, None, None), (1, "", None), (1, "2017-13-40T25:00:00Z", None), (1, "31/02/2016 10:00", None), (4, "03/14/2010 02:30 AM", None), (1, "x" * 20000, None), (None, "2010-01-01 00:00:00", None), (None, "2010-01-01T00:00:00Z", _utc(2010, 1, 1)),
    ]
    got = _instants(spark, [(f, v) for f, v, _ in cases])
    assert {i: got[i] for i in range(len(cases))} == {i: want for i, (_, _, want) in enumerate(cases)}


def test_wall_times_against_zoneinfo(spark):
    """Brute force around the changes of the clock: the earlier of two, none where the clock skips."""
    walls = [dt.datetime(2021, m, d, h, n) for m, d in ((3, 13), (3, 14), (11, 6), (11, 7)) for h in range(0, 5) for n in (0, 29, 59)]
    got = _instants(spark, [(4, w.strftime("%m/%d/%Y %H:%M:%S")) for w in walls])
    zone = ZoneInfo("America/New_York")
    for i, w in enumerate(walls):
        at = w.replace(tzinfo=zone, fold=0)
        real = at.astimezone(dt.timezone.utc).astimezone(zone).replace(tzinfo=None) == w
        assert got[i] == (int(at.timestamp()) if real else None), w


def test_zone_is_estimated_where_none_is_declared(spark):
    rows, zone = [], ZoneInfo("America/Chicago")
    for i in range(60):
        at = dt.datetime(2015, 1, 1, 12, tzinfo=dt.timezone.utc) + dt.timedelta(days=11 * i)
        rows += [(2 * i, f"r{i}", "filed_at", 1, at.astimezone(zone).strftime("%Y-%m-%d %H:%M:%S"), dt.datetime(2024, 1, 1)), (2 * i + 1, f"r{i}", "filed_at", 2, at.strftime("%Y-%m-%dT%H:%M:%SZ"), dt.datetime(2024, 1, 1))]
    cells = spark.createDataFrame(rows, "cell_id bigint, record_id string, field_key string, feed_id bigint, value string, ingested_at timestamp")
    got = {r["cell_id"]: r["instant"] for r in instants.to_instants(cells, spark.createDataFrame([(1, None, None), (2, None, None)], FEEDS)).collect()}
    assert all(got[2 * i] == got[2 * i + 1] for i in range(60))


def test_latest_delivery_counts_once(spark):
    cells = spark.createDataFrame([(1, "r", "k", 1, "2010-01-01T00:00:00Z", dt.datetime(2020, 1, 1)), (1, "r", "k", 1, "2011-01-01T00:00:00Z", dt.datetime(2021, 1, 1)), (None, "r", "k", 1, "x", None)], "cell_id bigint, record_id string, field_key string, feed_id bigint, value string, ingested_at timestamp")
    got = instants.to_instants(cells.withColumn("_wall", F.lit("clash")), spark.createDataFrame([(1, "UTC", "YMD")], FEEDS)).collect()
    assert [(r["cell_id"], r["instant"]) for r in got] == [(1, _utc(2011, 1, 1))]
    assert instants.to_instants(cells.limit(0), spark.createDataFrame([], FEEDS)).count() == 0


CELLS = "id bigint, kind string, value string, unit string, mark string, home string"


def _quantities(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], CELLS).withColumns({"_figure": F.lit("clash"), "quantity": F.lit(1)})
    rates = spark.createDataFrame([("EUR", 1.0), ("USD", 0.9137), ("GBP", 1.1642), ("JPY", 0.006281), ("CHF", 1.0468)], "currency string, eur_per_unit double")
    out = quantities.to_common_unit(df, quantities.units(spark, rates), kind="kind", value="value", unit="unit", mark="mark", dollar="home")
    assert {"_figure", "quantity"} <= set(out.columns) and len(out.columns) == len(set(out.columns))
    return {r["id"]: r["quantity"] for r in out.collect()}


def test_quantities(spark):
    cases = [
        ("length", "7,591.82", "mm", ".", 7.59182), ("length", "11.696,6", "cm", ",", 116.966), ("length", "3' 0\"", None, ".", 0.9144), ("length", "311 ft 9 in", None, ".", 95.0214), ("length", "1'239.31 inches", None, ".", 31.478474), ("length", "1.781102e+02 km", None, ".", 178110.2), ("length", "9 328.67", "in", ".", 236.948218),
        ("weight", "0.825107st", None, ".", 5.239692), ("weight", "5'561 oz", None, ".", 157.651683), ("floor_area", "4808.76m2", None, ".", 4808.76), ("floor_area", "432,884m^2", None, ",", 432.884), ("volume", "66.0698gal (US)", None, ".", 0.250101), ("volume", "0.448689 gal (imp.)", None, ".", 0.002039780),
        ("temperature", "-6.00", "°C", ".", -6.0), ("temperature", "83.66 ℉", None, ".", 28.7), ("temperature", "433.85 K", None, ".", 160.7), ("duration", "17h10m59s", None, ".", 61859.0), ("duration", "PT0H3M3S", None, ".", 183.0), ("duration", "65:19:46", None, ".", 235186.0), ("duration", "0 h 15 min 59 s", None, ".", 959.0),
        ("interest_rate", "54.1065 ‰", None, ".", 0.0541065), ("interest_rate", "17,4448", "Prozent", ",", 0.174448), ("amount", "(5843.51)", "EUR", ".", -5843.51), ("amount", "-€ 931.20", None, ".", -931.2), ("amount", "0,31", "TEUR", ",", 310.0), ("amount", "28.27142", "Mio. JPY", ".", 177572.789), ("amount", "$121,828.21", None, ".", 111314.436), ("amount", "(62691,22) EUR", None, None, -62691.22), ("amount", "1.234.567 EUR", None, None, 1234567.0), ("amount", "12,345.67 EUR", None, None, 12345.67), ("amount", "EUR 1 234,5", None, None, 1234.5),
        ("amount", "n/a", None, ".", None), ("amount", None, None, ".", None), ("amount", "", "EUR", ".", None), ("length", "12 parsecs", None, ".", None), (None, "12", "m", ".", None), ("length", "9" * 30000, "m", ".", float("inf")),
    ]
    got = _quantities(spark, [(k, v, u, m, "USD") for k, v, u, m, _ in cases])
    for i, (_, v, _, _, want) in enumerate(cases):
        assert (got[i] is None) if want is None else got[i] == pytest.approx(want, rel=1e-5), (v and v[:40], got[i])


def test_same_quantity_against_brute_force(spark):
    import random

    r, rows = random.Random(1), []
    for i in range(300):
        kind = r.choice(["length", "temperature"])
        rows.append((i, "g" if r.random() < 0.4 else f"g{i % 40}", kind, r.choice([-1, 1]) * 10 ** r.uniform(-2, 2) * r.choice([1, 1.0019, 1.0021]) if r.random() < 0.9 else 0.0))
    rows += [(900, None, "length", 1.0), (901, "g", "length", None), (902, "g", "length", float("nan"))]
    df = spark.createDataFrame(rows, "id bigint, grp string, kind string, quantity double")
    got = {tuple(x) for x in quantities.same_quantity(df, "id", ["grp", "kind"], kind="kind").collect()}
    want = set()
    for a in rows[:300]:
        for b in rows[:300]:
            if a[0] < b[0] and a[1:3] == b[1:3]:
                d = abs(a[3] - b[3])
                if d < 0.1 if a[2] == "temperature" else (d < 0.002 * max(abs(a[3]), abs(b[3])) or d == 0):
                    want.add((a[0], b[0]))
    assert got == want


def test_nested_layouts_give_the_same_links(spark):
    block = {"id": "b1", "children": [{"id": "b2", "children": {"id": "b3"}}]}
    one = {"mirror": {"document": {"document_id": "D"}, "pages": [{"page_id": "p1", "blocks": [block]}], "graph": {"edges": [{"id": "e", "type": "contains", "from": "b1", "to": "b2"}, {"type": "continues", "from": "b2", "to": "b3"}]}}, "datasets": [{"id": "d", "rows": [{"record_id": "r", "items": [{"id": "i"}]}]}]}
    two = {"mirror": {"document": {"document_id": "D"}, "pages": {"p1": {"blocks": {"id": "b1", "children": [{"id": "b2", "children": [{"id": "b3", "children": None}]}]}}}, "graph": {"edges": {"id": "e", "type": "contains", "from": "b1", "to": "b2"}}}, "datasets": json.dumps([{"id": "d", "rows": {"r": {"items": {"id": "i"}}}}])}
    deep = {"id": "x0"}
    for n in range(1, 40):
        deep = {"id": f"x{n}", "children": [deep]}
    three = {"mirror": {"pages": {"page_id": "p", "blocks": deep}}, "datasets": None}
    wrapped, twice = {"status": "ok", "result": one}, {"result": json.dumps({"result": two})}
    rows = [(10, "D", json.dumps(wrapped)), (11, "D", json.dumps(twice)), (12, "D", json.dumps({"result": None})), (13, "D", json.dumps({"result": two, "datasets": []})), (1, "D", json.dumps(one)), (2, "D", json.dumps(two)), (3, "E", json.dumps(three)), (4, "F", json.dumps(one)[:-5]), (5, "F", ""), (6, "F", None), (7, "F", "null"), (8, "F", "[1]"), (1, "D", json.dumps(one))]
    df = spark.createDataFrame(rows, "artifact_id bigint, document_id string, payload string").withColumns({"pages": F.lit("clash"), "idx": F.lit(0)})
    got = nested.links(nested.parsed(df)).collect()
    of = lambda n: {tuple(r)[1:] for r in got if r["artifact_id"] == n}
    assert of(1) == of(2) == of(10) == of(11) == {("page", "D", "p1"), ("block", "p1", "b1"), ("block", "b1", "b2"), ("block", "b2", "b3"), ("contains", "b1", "b2"), ("dataset", "D", "d"), ("row", "d", "r"), ("item", "r", "i")}
    assert len(of(3)) == 41 and ("page", "E", "p") in of(3) and ("block", "x1", "x0") in of(3)
    assert {r["artifact_id"] for r in got} == {1, 2, 3, 10, 11} and len(got) == len({tuple(r) for r in got})
    assert nested.links(nested.parsed(df.limit(0))).count() == 0
