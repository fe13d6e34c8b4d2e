"""SQL for the general training-data queries, for DuckDB. Its constants are stated here on their own, apart from those of the operators."""

from __future__ import annotations

def _opened(x: str) -> str:
    return f"(CASE WHEN json_type({x}) = 'VARCHAR' THEN (CASE WHEN json_valid({x} ->> '$') THEN ({x} ->> '$')::JSON END) ELSE {x} END)"


def _elements(x: str, *marks: str) -> str:
    one = " OR ".join(f"({x} ->> '$.{m}') IS NOT NULL" for m in marks)
    return f"unnest(CASE json_type({x}) WHEN 'ARRAY' THEN [{{'k': NULL::VARCHAR, 'v': e}} FOR e IN json_extract({x}, '$[*]')] WHEN 'OBJECT' THEN CASE WHEN {one} THEN [{{'k': NULL::VARCHAR, 'v': {x}}}] ELSE [{{'k': q, 'v': json_extract({x}, '$.\"' || q || '\"')}} FOR q IN json_keys({x})] END ELSE [] END)"


P2_ROWS = f"""w AS (SELECT artifact_id, document_id, payload::JSON AS p FROM mirror_artifacts WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
j0 AS (SELECT artifact_id, document_id, CASE WHEN (p -> '$.mirror') IS NULL AND (p -> '$.datasets') IS NULL AND json_type(p -> '$.result') = 'OBJECT' THEN (p -> '$.result') ELSE p END AS p FROM w),
j AS (SELECT artifact_id, p, coalesce(p ->> '$.mirror.document.document_id', document_id) AS doc FROM j0),
a AS (SELECT artifact_id, doc, {_opened("(p -> '$.mirror.pages')")} AS pages, {_opened("(p -> '$.mirror.graph.edges')")} AS edges, {_opened("(p -> '$.datasets')")} AS sets FROM j),
pg AS (SELECT artifact_id, doc, coalesce(e.v ->> '$.page_id', e.k) AS id, e.v AS v, {_opened("(e.v -> '$.blocks')")} AS x FROM (SELECT artifact_id, doc, {_elements("pages", "page_id", "page_number", "blocks")} AS e FROM a)),
bl AS (SELECT artifact_id, doc, id AS page, id AS parent, coalesce(e.v ->> '$.id', e.k) AS id, 0 AS level, e.v AS v, {_opened("(e.v -> '$.children')")} AS x FROM (SELECT artifact_id, doc, id, {_elements("x", "id", "type", "children")} AS e FROM pg)
  UNION ALL SELECT artifact_id, doc, page, id, coalesce(e.v ->> '$.id', e.k), level + 1, e.v, {_opened("(e.v -> '$.children')")} FROM (SELECT artifact_id, doc, page, id, level, {_elements("x", "id", "type", "children")} AS e FROM bl)),
ds AS (SELECT artifact_id, doc, coalesce(e.v ->> '$.id', e.k) AS id, e.v AS v, {_opened("(e.v -> '$.rows')")} AS x FROM (SELECT artifact_id, doc, {_elements("sets", "rows", "columns", "name")} AS e FROM a)),
rw AS (SELECT artifact_id, doc, id AS parent, coalesce(e.v ->> '$.record_id', e.k) AS id, e.v AS v, {_opened("(e.v -> '$.items')")} AS x FROM (SELECT artifact_id, doc, id, {_elements("x", "record_id", "raw", "normalized", "items")} AS e FROM ds)),
it AS (SELECT artifact_id, doc, id AS parent, coalesce(e.v ->> '$.id', e.k) AS id, e.v AS v FROM (SELECT artifact_id, doc, id, {_elements("x", "id", "note")} AS e FROM rw)),
ed AS (SELECT artifact_id, doc, e.k AS k, e.v AS v FROM (SELECT artifact_id, doc, {_elements("edges", "from", "to")} AS e FROM a))"""
P2 = f"""WITH RECURSIVE {P2_ROWS},
l AS (SELECT artifact_id, 'page' AS link_kind, doc AS parent_id, id AS child_id FROM pg UNION SELECT artifact_id, 'block', parent, id FROM bl UNION SELECT artifact_id, 'contains', v ->> '$.from', v ->> '$.to' FROM ed WHERE v ->> '$.type' = 'contains'
  UNION SELECT artifact_id, 'dataset', doc, id FROM ds UNION SELECT artifact_id, 'row', parent, id FROM rw UNION SELECT artifact_id, 'item', parent, id FROM it)
SELECT * FROM l WHERE parent_id IS NOT NULL AND child_id IS NOT NULL"""
# the flat tables; places within a list are not compared, since SQL's unnesting has no order to rely on
_AMOUNT = "coalesce(v ->> '$.normalized.amount.value', v ->> '$.raw.amount.value', CASE WHEN json_type(v -> '$.normalized.amount') <> 'OBJECT' THEN v ->> '$.normalized.amount' END, CASE WHEN json_type(v -> '$.raw.amount') <> 'OBJECT' THEN v ->> '$.raw.amount' END)"
P2_TABLES = {n: f"WITH RECURSIVE {P2_ROWS} SELECT artifact_id, doc AS document_id, {columns}" for n, columns in {
    "p2_pages": "id AS page_id, try_cast(v ->> '$.page_number' AS INTEGER) AS page_number, try_cast(v ->> '$.width' AS DOUBLE) AS width, try_cast(v ->> '$.height' AS DOUBLE) AS height, v ->> '$.content_mode' AS content_mode FROM pg",
    "p2_blocks": "page AS page_id, parent AS parent_id, level, id AS block_id, v ->> '$.type' AS block_type, v ->> '$.text' AS text, CASE WHEN json_type(v -> '$.bbox') = 'ARRAY' THEN array_to_string([printf('%.2f', x) FOR x IN CAST(v -> '$.bbox' AS DOUBLE[])], ' ') END AS bbox FROM bl",
    "p2_edges": "coalesce(v ->> '$.id', k) AS edge_id, v ->> '$.type' AS edge_type, v ->> '$.from' AS from_id, v ->> '$.to' AS to_id, try_cast(v ->> '$.confidence' AS DOUBLE) AS confidence FROM ed",
    "p2_datasets": "id AS dataset_id, v ->> '$.name' AS name FROM ds",
    "p2_rows": f"parent AS dataset_id, id AS record_id, coalesce(v ->> '$.normalized.label', v ->> '$.raw.label') AS label, {_AMOUNT} AS amount, try_cast(v ->> '$.source.page' AS INTEGER) AS page FROM rw",
    "p2_items": "parent AS record_id, id AS item_id, v ->> '$.note' AS note FROM it",
}.items()}

# times: texts are brought to one order of words, then read by formats
_MONTHS = ", ".join(f"('{w}', '{m}')" for m, words in {1: "januar janvier january", 2: "februar février february", 3: "märz mars march", 4: "april avril", 5: "mai may", 6: "juni juin june", 7: "juli juillet july", 8: "august août", 9: "september septembre", 10: "oktober octobre october", 11: "november novembre", 12: "dezember décembre december"}.items() for w in words.split())
# hours east of Greenwich
_ABBR = ", ".join(f"('{a}', {int(60 * float(h))})" for a, h in (x.split("=") for x in "Z=0 UTC=0 GMT=0 BST=1 CET=1 CEST=2 EST=-5 EDT=-4 CST=-6 CDT=-5 AEST=10 AEDT=11 JST=9 IST=5.5".split()))
_DAY_FIRST, _MONTH_FIRST = ["%d/%m/%Y", "%d.%m.%Y", "%d-%m-%Y"], ["%m/%d/%Y"]
_SHORT = {k: [f.replace("%Y", "%y") for f in v] for k, v in (("DMY", _DAY_FIRST), ("MDY", _MONTH_FIRST), ("YMD", ["%Y/%m/%d", "%Y.%m.%d", "%Y-%m-%d"]))}
_FIXED = ["%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%Y%m%d"]
_CLOCKS = [" %H:%M:%S", " %H:%M", " %I:%M:%S %p", " %I:%M %p", " %H%M%S"]


def _at(zone: str) -> str:
    """Seconds of the wall time w in a zone: the earlier of two, null where the zone skips it."""
    return f"(CASE WHEN timezone({zone}, timezone({zone}, w) - INTERVAL 1 HOUR) = w THEN epoch(timezone({zone}, w))::BIGINT - 3600 WHEN timezone({zone}, timezone({zone}, w)) = w THEN epoch(timezone({zone}, w))::BIGINT END)"


def _formats(dates: list[str]) -> str:
    return "[" + ", ".join(f"'{a}{b}'" for a in dates for b in _CLOCKS) + "]"


P3_ROWS = f"""m(w, n) AS (VALUES {_MONTHS}), z(abbr, minutes) AS (VALUES {_ABBR}),
c AS (SELECT DISTINCT cell_id, record_id, field_key, feed_id, trim(value, ' ') AS value FROM audit_cells WHERE field_key LIKE '%\\_at' ESCAPE '\\'),
t0 AS (SELECT c.*, tz_name, date_order, regexp_extract(value, '(?i)(?:[^0-9a-z]|[0-9])(Z|[+-][0-9]{{2}}:?[0-9]{{2}}|[a-z]+/[a-z_]+|(?:UTC|GMT|BST|CES?T|E[SD]T|C[SD]T|AE[SD]T|JST|IST))$', 1) AS zone FROM c LEFT JOIN feeds USING (feed_id)),
t1 AS (SELECT *, trim(CASE WHEN zone <> '' AND NOT regexp_matches(value, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN left(value, length(value) - length(zone)) ELSE value END, ' ,') AS s FROM t0),
t2 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, ' Uhr$', ''), '^[A-Z][a-z]{{2}}, ', ''), ' à ([0-9]{{2}})h', ' \\1:'), '([0-9])T([0-9])', '\\1 \\2'), '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})([0-9]{{2}}:)', '\\1 \\2') AS u FROM t1),
t3 AS (SELECT *, lower(regexp_extract(u, '([A-Za-zäéûàô]{{3,}})', 1)) AS word FROM t2),
t4 AS (SELECT t3.*, (SELECT min(n) FROM m WHERE starts_with(w, word) AND length(word) >= 3) AS mon FROM t3),
t5 AS (SELECT *, regexp_replace(CASE WHEN mon IS NULL THEN u WHEN regexp_matches(u, '^[0-9]') THEN regexp_replace(u, '^([0-9]{{1,2}})[. -]+[^0-9]+?[ -]*([0-9]{{4}}),? +', '\\2-' || mon || '-\\1 ') ELSE regexp_replace(u, '^[^0-9]+ ([0-9]{{1,2}}), ([0-9]{{4}}) ', '\\2-' || mon || '-\\1 ') END, '([0-9]:[0-9]{{2}}:[0-9]{{2}})[.,][0-9]+$', '\\1') AS v FROM t4),
t6 AS (SELECT *, CASE WHEN regexp_matches(v, '^[0-9]{{4}}') THEN try_strptime(v, {_formats(_FIXED)}) WHEN regexp_matches(v, '^[0-9]{{1,2}}[-/.][0-9]{{1,2}}[-/.][0-9]{{4}}') THEN (CASE date_order WHEN 'MDY' THEN try_strptime(v, {_formats(_MONTH_FIRST)}) ELSE try_strptime(v, {_formats(_DAY_FIRST)}) END)
  ELSE (CASE date_order WHEN 'MDY' THEN try_strptime(v, {_formats(_SHORT["MDY"])}) WHEN 'YMD' THEN try_strptime(v, {_formats(_SHORT["YMD"])}) ELSE try_strptime(v, {_formats(_SHORT["DMY"])}) END) END AS w FROM t5),
t AS (SELECT cell_id, record_id, field_key, CASE
  WHEN regexp_matches(value, '^[0-9]{{9,17}}(\\.[0-9]+)?$') THEN CASE WHEN length(split_part(value, '.', 1)) < 12 THEN split_part(value, '.', 1)::BIGINT WHEN length(split_part(value, '.', 1)) < 15 THEN split_part(value, '.', 1)::BIGINT // 1000 ELSE split_part(value, '.', 1)::BIGINT // 1000000 END
  WHEN w IS NULL THEN NULL
  WHEN regexp_matches(zone, '^[+-]') THEN epoch(w)::BIGINT - (CASE left(zone, 1) WHEN '-' THEN -1 ELSE 1 END) * (substr(zone, 2, 2)::INTEGER * 3600 + right(zone, 2)::INTEGER * 60)
  WHEN zone LIKE '%/%' THEN {_at("zone")}
  WHEN zone <> '' THEN epoch(w)::BIGINT - 60 * (SELECT minutes FROM z WHERE abbr = upper(zone))
  ELSE {_at("tz_name")} END AS instant FROM t6)"""
P3 = f"WITH {P3_ROWS} SELECT l.cell_id AS left_cell_id, r.cell_id AS right_cell_id FROM t l JOIN t r USING (record_id, field_key, instant) WHERE l.cell_id < r.cell_id"

# quantities
# kind, factor to the common unit, shift, names
_UNITS = """('length', 0.001, 0, 'mm|millimetre|millimetres|millimeter|millimeters'), ('length', 0.01, 0, 'cm|centimetre|centimetres|centimeter|centimeters|zentimeter'), ('length', 1, 0, 'm|m.|metre|metres|meter|meters'), ('length', 1000, 0, 'km|kilometre|kilometres|kilometer|kilometers'),
('length', 0.0254, 0, 'in|in.|inch|inches|zoll|"'), ('length', 0.3048, 0, 'ft|ft.|foot|feet|fuß|'''), ('length', 0.9144, 0, 'yd|yds|yard|yards'), ('length', 1609.344, 0, 'mi|mile|miles|meilen'), ('length', 1852, 0, 'nmi|nm|nautical mile|nautical miles|seemeilen'),
('weight', 0.000001, 0, 'mg|milligrams'), ('weight', 0.001, 0, 'g|gr|gr.|gram|grams|gramm'), ('weight', 1, 0, 'kg|kilogram|kilograms|kilogramm|kilo|kilos'), ('weight', 1000, 0, 't|tonne|tonnes|tonnen|metric tons'), ('weight', 0.45359237, 0, 'lb|lbs|lb.|pound|pounds'),
('weight', 0.028349523125, 0, 'oz|oz.|ounce|ounces'), ('weight', 6.35029318, 0, 'st|stone|stones'), ('weight', 1016.0469088, 0, 'long ton|long tons'), ('weight', 907.18474, 0, 'short ton|short tons|us ton|us tons'),
('floor_area', 1, 0, 'm2|m²|m^2|sqm|sq m|qm|square metres|square meters|quadratmeter'), ('floor_area', 100, 0, 'a|are|ares|ar'), ('floor_area', 10000, 0, 'ha|hectare|hectares|hektar'), ('floor_area', 0.09290304, 0, 'sq ft|sqft|ft2|ft²|ft^2|square feet'),
('floor_area', 0.83612736, 0, 'sq yd|yd²|square yards'), ('floor_area', 4046.8564224, 0, 'ac|acre|acres'), ('floor_area', 1000000, 0, 'km²|km2|sq km'),
('volume', 0.000001, 0, 'ml|cc|cm³|millilitre|millilitres|milliliters'), ('volume', 0.00001, 0, 'cl|centilitres'), ('volume', 0.001, 0, 'l|litre|litres|liter|liters'), ('volume', 0.1, 0, 'hl|hektoliter|hectolitre|hectolitres'), ('volume', 1, 0, 'm³|m3|m^3|cbm|cubic metres|cubic meters|kubikmeter'),
('volume', 0.003785411784, 0, 'us gal|us gallons|gal (us)|gal us'), ('volume', 0.00454609, 0, 'imp gal|imperial gallons|gal (imp.)|gal (imp)|gal (uk)'), ('volume', 0.028316846592, 0, 'ft³|ft3|ft^3|cu ft|cubic feet'),
('temperature', 1, 0, 'c|°c|℃|deg c|celsius|degrees celsius|grad celsius'), ('temperature', 0.5555555555555556, -17.77777777777778, 'f|°f|℉|deg f|fahrenheit|degrees fahrenheit|grad fahrenheit'), ('temperature', 1, -273.15, 'k|kelvin|°k'),
('duration', 1, 0, 's|sec|secs|second|seconds|sekunden|secondes'), ('duration', 60, 0, 'min|mins|minute|minutes|minuten'), ('duration', 3600, 0, 'h|hr|hrs|hour|hours|std|stunden|heures'), ('duration', 86400, 0, 'd|day|days|tage|jours'), ('duration', 604800, 0, 'week|weeks|wochen'),
('interest_rate', 0.01, 0, '%|pct|percent|per cent|prozent|pour cent|v.h.'), ('interest_rate', 0.001, 0, '‰|per mille|promille'), ('interest_rate', 0.0001, 0, 'bp|bps|basis points|basispunkte'), ('interest_rate', 1, 0, 'ratio|fraction|1')"""
_MONEY = """('EUR', '€|eur|euro|euros', 'ct|cents|cent|euro cents'), ('USD', 'usd|us$|us dollars', 'us cents'), ('GBP', 'gbp|£|pounds sterling', 'pence|gbx|p'), ('AUD', 'aud|a$|au$', 'au cents'), ('JPY', 'jpy|¥jp|jp¥|yen', ''), ('CHF', 'chf|fr.|sfr.|franken', 'rappen|rp.'), ('CNY', 'cny|rmb|cn¥|yuan', '')"""
_SCALES = """('', '', 1), ('', ' k', 1e3), ('', ' thousand', 1e3), ('', ' tsd.', 1e3), ('k', '', 1e3), ('t', '', 1e3), ('tsd. ', '', 1e3), ('', ' m', 1e6), ('', ' mn', 1e6), ('', ' million', 1e6), ('', ' millions', 1e6), ('', ' mio.', 1e6), ('', ' mio', 1e6), ('m', '', 1e6), ('mio. ', '', 1e6), ('mio ', '', 1e6), ('', ' bn', 1e9), ('', ' billion', 1e9), ('', ' mrd.', 1e9)"""
_FIG = "[0-9](?:[0-9.,''’    ]*[0-9])?(?:[eE][+-]?[0-9]+)?"


def _total(pattern: str, *factors: float) -> str:
    return f"CASE WHEN regexp_matches(low, '{pattern}') THEN " + " + ".join(f"coalesce(try_cast(replace(regexp_extract(low, '{pattern}', {i + 1}), ',', '.') AS DOUBLE), 0) * {f!r}" for i, f in enumerate(factors)) + " END"


_N = "([0-9]+(?:[.,][0-9]+)?)"
P5_ROWS = f"""un(kind, factor, shift, names) AS (VALUES {_UNITS}), money(currency, names, hundredths) AS (VALUES {_MONEY}), scale(before, after, times) AS (VALUES {_SCALES}),
units AS (SELECT kind, unnest(string_split(names, '|')) AS alias, factor::DOUBLE AS factor, shift::DOUBLE AS shift FROM un
  UNION SELECT 'amount', before || name || after, eur_per_unit * times, 0 FROM (SELECT currency, unnest(string_split(names, '|')) AS name FROM money) JOIN fx_rates USING (currency), scale
  UNION SELECT 'amount', unnest(string_split(hundredths, '|')), eur_per_unit / 100, 0 FROM money JOIN fx_rates USING (currency) WHERE hundredths <> ''),
c AS (SELECT DISTINCT 'cell' AS src, cell_id AS id, record_id AS g, field_key AS n, field_key AS kind, value, unit, decimal_mark AS mark, lower(home_currency) AS home FROM audit_cells LEFT JOIN feeds USING (feed_id) WHERE field_key IN ('length', 'weight', 'floor_area', 'volume', 'temperature', 'duration', 'interest_rate', 'amount')
  UNION SELECT DISTINCT 'trust', field_id, artifact_key, name, 'amount', value, currency, NULL, NULL FROM trust_fields WHERE name IN ('total_amount', 'costs_awarded', 'security_deposit', 'filing_fee')),
f AS (SELECT *, lower(trim(value, ' ')) AS low, regexp_replace(regexp_extract(value, '{_FIG}'), '[''’    ]', '', 'g') AS fig,
  lower(trim(regexp_replace(replace(regexp_replace(regexp_replace(value, '\\(([^)]*[0-9][^)]*)\\)', '\\1'), '^([^0-9]*){_FIG}', '\\1 '), '-', ' '), '[    ]+', ' ', 'g'), ' ')) AS said,
  regexp_matches(value, '\\([^)]*[0-9][^)]*\\)|^[^0-9]*-\\s*[^0-9]{{0,4}}[0-9]') AS minus FROM c WHERE value IS NOT NULL),
k AS (SELECT *, coalesce(nullif(lower(trim(unit, ' ')), ''), nullif(said, ''), CASE WHEN kind = 'amount' THEN home END) AS al, coalesce(mark, CASE
  WHEN regexp_matches(fig, ',.*\\.') THEN '.' WHEN regexp_matches(fig, '\\..*,') THEN ',' WHEN regexp_matches(fig, '\\..*\\.|^[1-9][0-9]{{0,2}}\\.[0-9]{{3}}$') THEN ',' WHEN regexp_matches(fig, ',.*,|^[1-9][0-9]{{0,2}},[0-9]{{3}}$') THEN '.' WHEN contains(fig, ',') THEN ',' ELSE '.' END) AS dm,
  CASE WHEN kind = 'duration' THEN coalesce({_total(f"^{_N}:([0-9]{{1,2}}):{_N}$", 3600, 60, 1)}, {_total(f"^pt{_N}h{_N}m{_N}s$", 3600, 60, 1)}, {_total(f"^{_N} ?h ?{_N} ?m(?:in)?(?: ?{_N} ?s)?$", 3600, 60, 1)})
       WHEN kind = 'length' THEN coalesce({_total(f"^{_N} ?ft ?{_N} ?in$", 0.3048, 0.0254)}, {_total(f"^{_N} ?'' ?{_N} ?" + '"$', 0.3048, 0.0254)}) END AS total FROM f),
q AS (SELECT src, id, g, n, k.kind, coalesce(total, (CASE WHEN minus THEN -1 ELSE 1 END) * try_cast(CASE dm WHEN ',' THEN replace(replace(fig, '.', ''), ',', '.') ELSE replace(fig, ',', '') END AS DOUBLE) * factor + shift) AS v
  FROM k LEFT JOIN units u ON u.kind = k.kind AND u.alias = CASE WHEN al = '$' THEN home ELSE al END)"""
P5 = f"""WITH {P5_ROWS} SELECT l.src, l.id AS left_id, r.id AS right_id FROM q l JOIN q r ON l.src = r.src AND l.g = r.g AND l.n = r.n AND l.id < r.id
WHERE CASE WHEN l.kind = 'temperature' THEN abs(l.v - r.v) < 0.1 ELSE abs(l.v - r.v) < 0.002 * greatest(abs(l.v), abs(r.v)) OR l.v = r.v END"""

# every instant and quantity: of rows delivered again the latest value counts, which in these tables is the same
P3_INSTANTS = f"WITH {P3_ROWS}, v AS (SELECT cell_id, any_value(value) AS value FROM (SELECT DISTINCT cell_id, value FROM audit_cells) GROUP BY 1) SELECT t.cell_id, record_id, field_key, v.value, instant AS instant_s, strftime(make_timestamp(instant * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS instant_utc FROM t JOIN v USING (cell_id)"
_COMMON = "CASE kind WHEN 'length' THEN 'm' WHEN 'weight' THEN 'kg' WHEN 'floor_area' THEN 'm2' WHEN 'volume' THEN 'm3' WHEN 'temperature' THEN 'C' WHEN 'duration' THEN 's' WHEN 'interest_rate' THEN '1' ELSE 'EUR' END"
P5_QUANTITIES = f"WITH {P5_ROWS} SELECT src, id AS row_id, kind, printf('%.10e', v * (1 + 1e-13)) AS quantity, {_COMMON} AS unit FROM q UNION ALL SELECT src, id, kind, NULL, {_COMMON} FROM c WHERE value IS NULL"
ORACLES = {"p2_found": P2, "p3_found": P3, "p5_found": P5, "p3_instants": P3_INSTANTS, "p5_quantities": P5_QUANTITIES, **P2_TABLES}
