"""Queries for scalar operators: numbers with check digits, amounts, dates, cells, redaction, safety."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import cells, checks, safety
from factloom.io import table
from factloom.plans.base import Book

query = Book()

# SQL of the checks, on a column x
_T = "upper(regexp_replace(x, '\\s+', '', 'g'))"
_CN = "upper(regexp_replace(x, '[\\s-]+', '', 'g'))"
_IBAN_REST = "CAST(array_to_string([CASE WHEN ascii(c) >= 65 THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END FOR c IN string_split(substr({t}, 5) || substr({t}, 1, 4), '')], '') AS HUGEINT) % 97"
_CREDIT = "regexp_matches({t}, '^[0-9A-HJ-NPQRTUWXY]{{18}}$') AND (strpos('0123456789ABCDEFGHJKLMNPQRTUWXY', {t}[18]) - 1) = (31 - list_sum([(strpos('0123456789ABCDEFGHJKLMNPQRTUWXY', {t}[i]) - 1) * (CAST(power(3, i - 1) AS HUGEINT) % 31) FOR i IN range(1, 18)]) % 31) % 31"
_NUMBERS = "(SELECT DISTINCT file_id, src, x FROM (SELECT file_id, unnest(['id_number', 'account_number']) AS src, unnest([id_number, account_number]) AS x FROM package_files) WHERE x IS NOT NULL)"


def _numbers(spark, d):
    parts = F.array(*[F.struct(F.lit(c).alias("src"), F.col(c).alias("x")) for c in ("id_number", "account_number")])
    return table(spark, d, "package_files").select("file_id", F.inline(parts)).where("x IS NOT NULL").distinct()


@query(f"""SELECT file_id, src, {_CREDIT.format(t=_T)} AS credit_code,
regexp_matches({_CN}, '^[0-9]{{17}}[0-9X]$') AND try_strptime(substr({_CN}, 7, 8), '%Y%m%d') IS NOT NULL AND {_CN}[18] = ('10X98765432')[1 + CAST(list_sum([coalesce(try_cast({_CN}[i] AS INTEGER), 0) * [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2][i] FOR i IN range(1, 18)]) AS INTEGER) % 11] AS resident_id,
regexp_matches({_T}, '^[A-Z]{{6}}[A-Z0-9]{{2}}(?:[A-Z0-9]{{3}})?$') AS bic, regexp_matches(upper(regexp_replace(x, '[\\s.-]+', '', 'g')), '^[A-Z]{{2}}[A-Z0-9]{{2,12}}$') AS eu_vat, regexp_matches(trim(x, ' '), '^[0-9]{{2}}-?[0-9]{{7}}$') AS us_ein,
regexp_matches({_T}, '^[0-9]{{13}}$') AS jp_corporate, regexp_matches({_T}, '^(?:[0-9]{{8}}[A-Z]|[0-9]{{9}}[A-Z]|[STF][0-9]{{2}}[A-Z]{{2}}[0-9]{{4}}[A-Z])$') AS sg_uen, regexp_matches(trim(x, ' '), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AS email, regexp_matches(trim(x, ' '), '^\\+?[0-9][0-9 ()-]{{5,20}}$') AS phone
FROM {_NUMBERS}""")
def number_checks(spark, d):
    """Checks of identity, company, bank, tax, e-mail and phone numbers."""
    x = F.col("x")
    return _numbers(spark, d).select("file_id", "src", checks.credit_code_ok(x).alias("credit_code"), checks.resident_id_ok(x).alias("resident_id"), *[checks.has_form(k, x).alias(k) for k in checks.FORMS])


@query(f"""WITH n AS (SELECT file_id, src, {_T} AS t FROM {_NUMBERS}), g(ch, other) AS (VALUES ('O', '0'), ('I', '1'), ('L', '1'), ('Z', '2'), ('S', '5'), ('B', '8'), ('0', 'O'), ('1', 'I'), ('1', 'L'), ('2', 'Z'), ('5', 'S'), ('8', 'B')),
v AS (SELECT file_id, src, t, substr(t, 1, i - 1) || other || substr(t, i + 1) AS w FROM (SELECT *, unnest(range(1, length(t) + 1)) AS i FROM n) JOIN g ON ch = t[i] AND (i > 2 OR other >= 'A') AND (i NOT IN (3, 4) OR other <= '9')),
ok AS (SELECT file_id, src, t, w FROM (SELECT *, t AS w FROM n UNION ALL SELECT file_id, src, t, w FROM v) WHERE regexp_matches(w, '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}$') AND {_IBAN_REST.format(t="w")} = 1),
cnt AS (SELECT file_id, src, t, max(CASE WHEN w = t THEN w END) AS self, count(DISTINCT w) AS k, min(w) AS one FROM ok GROUP BY 1, 2, 3)
SELECT file_id, src, coalesce(self, CASE WHEN k = 1 THEN one END) AS repaired FROM cnt WHERE self IS NOT NULL OR k = 1""")
def repaired_ibans(spark, d):
    """Account numbers that are IBANs, or become one, and only one, by changing a single glyph."""
    rows = _numbers(spark, d).select("file_id", "src", checks.repaired_iban(F.col("x")).alias("repaired"))
    return rows.where("repaired IS NOT NULL")


_VALUES = "(SELECT DISTINCT cell_id, value AS x FROM audit_cells WHERE value IS NOT NULL)"
_STRIP = "regexp_replace(regexp_replace(trim({x}, ' '), '[¥￥$€£₤₩,，\\s元圆]', '', 'g'), '^\\++', '')"
_NUM = "CASE WHEN regexp_matches({s}, '^[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?$') THEN CASE WHEN contains(lower({s}), 'e') OR length({s}) > 25 THEN round(try_cast({s} AS DOUBLE), 2) ELSE round(try_cast({s} AS DECIMAL(38, 9)), 2)::DOUBLE END END"


def _values(spark, d):
    return table(spark, d, "audit_cells").where("value IS NOT NULL").select("cell_id", F.col("value").alias("x")).distinct()


@query(f"""WITH v AS (SELECT cell_id, x, {_STRIP.format(x="x")} AS s, regexp_replace(trim(x, ' '), '^\\(\\s*|\\s*\\)$', '', 'g') AS inner_, regexp_matches(trim(x, ' '), '^\\(.*\\)$') AS br FROM {_VALUES}),
g AS (SELECT *, {_STRIP.format(x="regexp_replace(trim(regexp_replace(CASE WHEN br THEN inner_ ELSE x END, '(?i)\\b(?:CNY|RMB|USD|EUR|GBP)\\b', '', 'g'), ' '), '^([-+]?[0-9]{1,3}(?:,[0-9]{3})*)\\.([0-9]{3})\\.([0-9]{2})$', '\\1,\\2.\\3')")} AS gs FROM v),
a AS (SELECT cell_id, x, br, {_NUM.format(s="s")} AS amount, {_NUM.format(s="gs")} AS ga FROM g)
SELECT cell_id, amount, CASE WHEN br THEN -abs(ga) ELSE ga END AS generic, abs(amount) AS unsigned, CASE WHEN amount IS NULL THEN 'other' WHEN starts_with(trim(x, ' '), '-') THEN 'expense' ELSE 'income' END AS direction,
CASE WHEN regexp_matches(upper(x), '[$]|USD') THEN 'USD' WHEN regexp_matches(upper(x), '€|EUR') THEN 'EUR' WHEN regexp_matches(upper(x), '£|GBP') THEN 'GBP' WHEN regexp_matches(upper(x), '¥|￥|CNY|RMB') THEN 'CNY' END AS currency,
regexp_matches(regexp_replace(trim(x, ' '), '[￥¥]', '', 'g'), '^[+-]?(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(?:\\.[0-9]+)?$') AS plain FROM a""")
def amount_forms(spark, d):
    """Every cell's text as an amount, by the rules for plain, generic and signed amounts, with the currency it names."""
    x, s = F.col("x"), cells.signed_amount(F.col("x"))
    return _values(spark, d).select("cell_id", cells.amount_of(x).alias("amount"), cells.generic_amount(x).alias("generic"), s["amount"].alias("unsigned"), s["direction"].alias("direction"), cells.currency_of(x).alias("currency"), checks.amount_text_ok(x).alias("plain"))


_ISO = "CASE " + " ".join(f"WHEN regexp_matches(x, '{f}') THEN regexp_extract(x, '{f}', {y}) || '-' || lpad(regexp_extract(x, '{f}', {m}), 2, '0') || '-' || lpad(regexp_extract(x, '{f}', {dd}), 2, '0')" for f, y, m, dd in (("([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日", 1, 2, 3), ("([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})", 1, 2, 3), ("([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", 1, 2, 3), ("([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", 3, 1, 2))) + " END"
_DAY = "[0-9]{4}[-./年][0-9]{1,2}[-./月][0-9]{1,2}日?"


@query(f"""SELECT cell_id, {_ISO} AS iso, CASE WHEN regexp_matches(trim(x, ' '), '^(?:19|20)[0-9]{{2}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,2}}$') THEN try_strptime(replace(replace(trim(x, ' '), '/', '-'), '.', '-'), '%Y-%m-%d') IS NOT NULL ELSE false END AS is_date,
regexp_replace(regexp_replace(regexp_replace(x, '([0-9]{{4}})[~～]([0-9]{{2}})[-~～]?([0-9]{{2}})', '\\1-\\2-\\3', 'g'), '([0-9]{{4}})\\s*[-–—]\\s*([0-9]{{2}})\\s*[-–—]\\s*([0-9]{{2}})', '\\1-\\2-\\3', 'g'), '([0-9]{{4}})\\.([0-9]{{2}})\\.([0-9]{{2}})', '\\1-\\2-\\3', 'g') AS repaired FROM {_VALUES}""")
def date_forms(spark, d):
    """Every cell's text as a date: the first one in ISO form, whether it is one that exists, and with repaired separators."""
    x = F.col("x")
    return _values(spark, d).select("cell_id", cells.iso_date(x).alias("iso"), checks.date_text_ok(x).alias("is_date"), cells.repaired_dates(x).alias("repaired"))


_BLOCKS = "(SELECT DISTINCT block_id, content AS x FROM text_blocks WHERE content IS NOT NULL)"


def _blocks(spark, d):
    return table(spark, d, "text_blocks").where("content IS NOT NULL").select("block_id", F.col("content").alias("x")).distinct()


def _rx(x: str, *steps: tuple[str, str]) -> str:
    for a, b in steps:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


_AMOUNTS_SQL = _rx("x", ("([+-]?[0-9][0-9,]*): ([0-9]{2})\\b", "\\1.\\2"), ("([0-9]{1,3})\\.([0-9]{3}):([0-9]{2})\\b", "\\1,\\2.\\3"), ("([+-]?[0-9]{1,3});([0-9]{3}[.0-9]*)", "\\1,\\2"), ("([0-9]{3})-([0-9]{2})\\b", "\\1.\\2"), ("([0-9])\\. ([0-9]{3})\\. ([0-9]{2})\\b", "\\1,\\2.\\3"), ("([0-9])\\. ([0-9]{3})\\. ([0-9]{2})", "\\1,\\2.\\3"), ("^\\.([0-9]{1,3},[0-9]{3}\\.[0-9]{2})", "\\1"), ("([+-]?[0-9]{1,3});([0-9]{3}\\.[0-9]{2})", "\\1,\\2"), ("([0-9]), ([0-9]{3})", "\\1,\\2"), ("([0-9])\\. ([0-9]{2})\\b", "\\1.\\2"))
# without look-around, what stands between two neighbours is replaced twice, since matches that share a neighbour follow one another
_CONF = [("([0-9])[Oo]([0-9])", "\\1" + "0\\2"), ("([0-9])[Oo]([.,\\s]|$)", "\\1" + "0\\2"), ("([a-zA-Z])0([a-zA-Z])", "\\1O\\2"), ("([0-9])[Il]([0-9])", "\\1" + "1\\2"), ("([a-z])1([a-z])", "\\1l\\2"), ("([A-Z])1([A-Z])", "\\1I\\2"), ("([0-9])[Ss]([0-9])", "\\1" + "5\\2"), ("([a-zA-Z])5([a-zA-Z])", "\\1S\\2"), ("^S([0-9]{2,})", "5\\1")]
_CONF_SQL = _rx("x", *[s for c in _CONF for s in (c, c)])


@query(f"SELECT block_id, {_AMOUNTS_SQL} AS amounts, {_CONF_SQL} AS confusions, regexp_replace(x, '([0-9]{{5}}),\\s*$', '\\1') AS digits, regexp_extract(x, '({_DAY}\\s*[~\\-至]\\s*{_DAY})', 1) AS period FROM {_BLOCKS}")
def misread_figures(spark, d):
    """Blocks with repaired amounts, with letters and digits exchanged by what stands around them, without noise at the end, and the period they name."""
    x = F.col("x")
    return _blocks(spark, d).select("block_id", cells.repaired_amounts(x).alias("amounts"), cells.repaired_confusions(x).alias("confusions"), cells.without_digit_noise(x).alias("digits"), cells.period_of(x).alias("period"))


@query(f"""WITH t AS (SELECT block_id, replace(replace(x, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS x FROM {_BLOCKS}), k AS (SELECT *, regexp_replace(x, '\\s+', '', 'g') AS k FROM t)
SELECT block_id, CASE WHEN NOT contains(x, chr(10)) THEN x WHEN regexp_matches(x, '^\\s*(?:19|20)[0-9]{{2}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,2}}\\s*\\n\\s*[0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?\\s*$') THEN regexp_replace(trim(x), '\\s+', ' ', 'g')
WHEN length(k) >= 10 AND (regexp_matches(k, '^[A-Za-z0-9\\-_]{{8,}}$') OR (length(k) >= 12 AND length(regexp_replace(k, '[^0-9]', '', 'g')) > 0.5 * length(k))) THEN k ELSE array_to_string([trim(l, ' ') FOR l IN string_split(x, chr(10)) IF length(trim(l, ' ')) > 0], ' ') END AS unwrapped,
trim(replace(replace(x, chr(10), ' '), chr(13), ''), ' ') AS cleaned FROM k""")
def unwrapped_cells(spark, d):
    """Blocks read as cells: without the line breaks of their layout."""
    x = F.col("x")
    return _blocks(spark, d).select("block_id", cells.unwrapped_cell(x).alias("unwrapped"), cells.cleaned_cell(x).alias("cleaned"))


@query(f"SELECT file_id, src, CASE WHEN NOT (regexp_matches(t, '^\\+?[0-9][0-9 ()-]{{5,20}}$') AND length(g) BETWEEN 6 AND 15) THEN '' WHEN starts_with(t, '+') THEN '+' || g WHEN regexp_matches(g, '^1[3-9][0-9]{{9}}$') OR regexp_matches(t, '[ ()-]') THEN g ELSE '' END AS phone FROM (SELECT file_id, src, trim(x, ' ') AS t, regexp_replace(x, '[^0-9]', '', 'g') AS g FROM {_NUMBERS})")
def phone_forms(spark, d):
    """The digits of phone numbers."""
    return _numbers(spark, d).select("file_id", "src", cells.phone_of(F.col("x")).alias("phone"))


@query("SELECT DISTINCT field_id, name, CASE WHEN source_ref IS NULL OR source_ref = '' THEN 'needs_evidence' WHEN confidence >= 0.85 THEN 'auto_accepted' WHEN confidence >= 0.6 THEN 'manual_optional' ELSE 'needs_review' END AS review FROM trust_fields")
def field_reviews(spark, d):
    """Review status of each field by its evidence and confidence."""
    refs = F.coalesce(F.length("source_ref") > 0, F.lit(False))
    return table(spark, d, "trust_fields").select("field_id", "name", cells.review_of(refs, F.col("confidence")).alias("review")).distinct()


# --- security and safety

_PII_SQL = _rx("x", ("\\b[0-9]{14}([0-9]{3}[0-9Xx])\\b", "ID_MASKED(...\\1)"), ("\\b1[3-9][0-9]{5}([0-9]{4})\\b", "PHONE_MASKED(...\\1)"), ("\\b[0-9]{12,15}([0-9]{4})\\b", "CARD_MASKED(...\\1)"), ("\\b[1-9][0-9]{5}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])([0-9]{4})\\b", "ID_TAIL_MASKED(...\\1)"))
_SECRET_SQL = _rx("x", ("(?i)(?:api[_-]?key|apikey|secret|token|password|auth)\\s*[:=]\\s*\\S+", "[SECRET_REDACTED]"), ("(?i)Bearer\\s+\\S+", "Bearer [REDACTED]"), ("sk-[A-Za-z0-9]{20,}", "sk-[REDACTED]"))
_TYPES = (("ID_MASKED", "\\b[0-9]{17}[0-9Xx]\\b"), ("PHONE_MASKED", "\\b1[3-9][0-9]{9}\\b"), ("CARD_MASKED", "\\b[0-9]{16,19}\\b"), ("ID_TAIL_MASKED", "\\b[1-9][0-9]{5}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{4}\\b"))
_TYPES_SQL = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(x, '{p}') THEN '{n}' END" for n, p in _TYPES) + "], lambda t: t IS NOT NULL), ',')"
_HAS_SECRET = "regexp_matches(x, '(?i)(?:api[_-]?key|apikey|secret|token|password|auth)\\s*[:=]\\s*\\S+') OR regexp_matches(x, '(?i)Bearer\\s+\\S+') OR regexp_matches(x, 'sk-[A-Za-z0-9]{20,}')"


@query(f"SELECT block_id, {_PII_SQL.replace('(x,', f'({_SECRET_SQL},')} AS clean FROM {_BLOCKS}")
def redacted_blocks(spark, d):
    """Blocks without secrets and personal numbers."""
    return _blocks(spark, d).select("block_id", safety.redact_text(F.col("x")).alias("clean"))


@query(f"SELECT block_id, {_HAS_SECRET} AS has_secrets, {_TYPES_SQL} <> '' AS has_pii, {_TYPES_SQL} AS pii_types, CASE WHEN x = '' THEN 0 WHEN {_TYPES_SQL} <> '' THEN 3 WHEN length(x) > 200 THEN 2 ELSE 1 END AS sensitivity FROM {_BLOCKS}")
def sensitive_blocks(spark, d):
    """What redaction would find in each block, and its class of sensitivity."""
    r = safety.redaction_of(F.col("x"))
    return _blocks(spark, d).select("block_id", r["has_secrets"].alias("has_secrets"), r["has_pii"].alias("has_pii"), r["pii_types"].alias("pii_types"), safety.sensitivity(F.col("x"), r["has_pii"]).alias("sensitivity"))


@query(f"SELECT DISTINCT file_id, subject_name AS subject, '[SECRET_REDACTED]' AS token, {_PII_SQL.replace('(x,', f'({_SECRET_SQL},').replace('(x,', '(account_number,')} AS account FROM package_files")
def redacted_maps(spark, d):
    """Rows as maps: values under secret keys withheld, others redacted."""
    m = F.create_map(F.lit("subject"), F.col("subject_name"), F.lit("To-ken"), F.coalesce("id_number", F.lit("")), F.lit("account"), F.col("account_number"))
    rows = table(spark, d, "package_files").select("file_id", safety.redact_map(m).alias("m"), "subject_name")
    return rows.select("file_id", F.col("subject_name").alias("subject"), F.col("m")["To-ken"].alias("token"), F.col("m")["account"].alias("account")).distinct()


_DOCS_X = "(SELECT doc_id, text AS x FROM documents WHERE text IS NOT NULL)"
_INJECT = [(n, p.replace("'", "''")) for n, p in safety.INJECTIONS.items()]


@query("SELECT doc_id, array_to_string(names, ',') AS forms, round(len(names) / 20.0, 4) AS risk FROM (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(x, '(?i){p}') THEN '{n}' END" for n, p in _INJECT) + f"], lambda t: t IS NOT NULL) AS names FROM {_DOCS_X})")
def injected_forms(spark, d):
    """Injected instructions and code in each document, and the share of known forms that it holds."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", safety.injections(F.col("text")).alias("n"))
    return docs.select("doc_id", F.array_join("n", ",").alias("forms"), F.round(F.size("n") / 20.0, 4).alias("risk"))


@query(f"""WITH b AS (SELECT block_id, x FROM {_BLOCKS} WHERE length(x) >= 8), w AS (SELECT block_id, 0 AS start, least(length(x), 256) AS stop, substr(x, 1, 256) AS t, true AS lone FROM b UNION ALL SELECT block_id, s AS start, s + 128, substr(x, s + 1, 128), false FROM (SELECT block_id, x, unnest(range(0, length(x) - 127, 64)) AS s FROM b)),
c AS (SELECT DISTINCT block_id, start, stop, lone, t FROM w), h AS (SELECT block_id, start, stop, lone, ch, count(*) AS k FROM (SELECT block_id, start, stop, lone, unnest(string_split(t, '')) AS ch FROM c) GROUP BY 1, 2, 3, 4, 5),
e AS (SELECT block_id, start, stop, lone, -sum(k / n * log2(k / n)) AS e FROM (SELECT *, sum(k) OVER (PARTITION BY block_id, start, stop, lone) AS n FROM h) GROUP BY 1, 2, 3, 4)
SELECT block_id, start::INTEGER AS start, stop::INTEGER AS stop, round(e, 2) AS entropy FROM e WHERE e >= 4.5 AND (lone OR block_id NOT IN (SELECT block_id FROM e WHERE lone AND e >= 4.5))""")
def high_entropy_parts(spark, d):
    """Parts of blocks whose characters are as varied as those of encoded data."""
    rows = _blocks(spark, d).select("block_id", F.inline(safety.high_entropy(F.col("x"))))
    return rows.select("block_id", "start", F.col("end").alias("stop"), "entropy").distinct()


@query(f"WITH n(code, name) AS (VALUES " + ", ".join(f"({int(c, 16)}, '{n}')" for c, n in safety.INVISIBLE.items()) + f"), c AS (SELECT block_id, i - 1 AS position, unicode(string_split(x, '')[i]) AS code FROM (SELECT block_id, x, unnest(range(1, length(x) + 1)) AS i FROM {_BLOCKS})) SELECT DISTINCT block_id, position::INTEGER AS position, name FROM c JOIN n USING (code)")
def invisible_characters(spark, d):
    """Every invisible character of a block, with its place and name."""
    names = F.create_map(*[F.lit(x) for c, n in safety.INVISIBLE.items() for x in (chr(int(c, 16)), n)])
    chars = "[" + "".join(f"\\x{{{c}}}" for c in safety.INVISIBLE) + "]"
    rows = _blocks(spark, d).where(F.col("x").rlike(chars)).select("block_id", F.posexplode(F.split("x", "")).alias("position", "ch"))
    return rows.select("block_id", "position", F.try_element_at(names, F.col("ch")).alias("name")).where("name IS NOT NULL").distinct()


@query("SELECT DISTINCT block_id, CASE WHEN confidence < 0.01 THEN 'zero_opacity' WHEN bbox[4] - bbox[2] < 0.5 THEN 'zero_font_size' END AS reason, contains(content, '>>') OR contains(content, 'stream') OR contains(content, '/Page') OR contains(content, '/Type') OR contains(content, '/Root') OR contains(content, '/Info') OR contains(content, '/Metadata') OR contains(content, 'obj<') OR contains(content, 'endobj') OR contains(content, '%%EOF') AS marks FROM text_blocks WHERE length(trim(content)) > 0 AND len(bbox) = 4")
def hidden_blocks(spark, d):
    """Why a block can't be seen, taking its confidence for opacity and its box's height for the size of its letters; and whether it holds marks of a file's insides."""
    b = table(spark, d, "text_blocks").where("length(trim(content)) > 0 AND size(bbox) = 4")
    reason = safety.hidden_reason(F.col("confidence"), F.lit(0), F.expr("bbox[3] - bbox[1]"))
    return b.select("block_id", reason.alias("reason"), safety.metadata_injected(F.col("content")).alias("marks")).distinct()


QUERIES, ORACLES = query.queries, query.oracles
