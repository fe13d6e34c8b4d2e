"""Queries on texts and records: key/values, notes, columns and entities under standard names, statements, hierarchies, dictionaries, contracts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import cells
from factloom.io import table
from factloom.operators import ledgers, lexicon
from factloom.operators.common import staged
from factloom.plans.base import Book
from factloom.plans.documents import LINES, STATEMENT, _lines

query = Book()

_KV = "regexp_matches(line, '^([^:]{2,30}): (.+)$')"


@query(f"""WITH k AS (SELECT doc_id, line_no, trim(regexp_extract(line, '^([^:]{{2,30}}): (.+)$', 1), ' ') AS key, rtrim(regexp_extract(line, '^([^:]{{2,30}}): (.+)$', 2), ' ;') AS value FROM {LINES} WHERE {_KV})
SELECT doc_id, line_no, key, value FROM k WHERE length(key) BETWEEN 2 AND 30 AND NOT contains(key, '|') AND NOT contains(value, '|') AND NOT regexp_matches(key, '[,，;；。！？?!]') AND NOT regexp_matches(key, '^[（(]?[0-9]+([）)、.]|\\s+)') AND NOT (length(key) > 8 AND regexp_matches(key, '^[0-9]')) AND NOT regexp_matches(value, '^(?:[（(]?[0-9]{{1,3}}[）)]|[0-9]{{1,3}}[、．])\\s*\\S') AND NOT contains(value, ';')""")
def scalar_key_values(spark, d):
    """Label and value of the lines that give one fact: labels that are clauses or numbers, and values that are lists, are left out."""
    form = r"^([^:]{2,30}): (.+)$"
    k = _lines(table(spark, d, "documents")).where(F.col("line").rlike(form)).select("doc_id", "line_no", F.trim(F.regexp_extract("line", form, 1)).alias("key"), F.rtrim(F.regexp_replace(F.regexp_extract("line", form, 2), "[ ;]+$", "")).alias("value"))
    key, value = F.col("key"), F.col("value")
    label = F.length(key).between(2, 30) & ~key.contains("|") & ~key.rlike("[,，;；。！？?!]") & ~key.rlike(r"^[（(]?\d+([）)、.]|\s+)") & ~((F.length(key) > 8) & key.rlike(r"^\d"))
    return k.where(label & ~value.contains("|") & ~value.contains(";") & ~value.rlike(r"^(?:[（(]?\d{1,3}[）)]|\d{1,3}[、．])\s*\S"))


@query(f"WITH n AS (SELECT doc_id, line_no, line, regexp_replace(line, '\\s+', '', 'g') AS k FROM {LINES} WHERE regexp_matches(line, '^\\s*(?:Held|Note|HEADNOTE|Reported at)\\b') AND length(trim(line, ' ')) >= 4), f AS (SELECT doc_id, k, min(line_no) AS line_no FROM n GROUP BY 1, 2) SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS note_no FROM f")
def labelled_notes(spark, d):
    """Lines that begin as notes, each text once, numbered within their document."""
    n = _lines(table(spark, d, "documents")).where(F.col("line").rlike(r"^\s*(?:Held|Note|HEADNOTE|Reported at)\b") & (F.length(F.trim("line")) >= 4))
    f = n.groupBy("doc_id", F.md5(F.encode(F.regexp_replace("line", r"\s+", ""), "utf-8")).alias("k")).agg(F.min("line_no").alias("line_no"))
    return f.select("doc_id", "line_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")).cast("bigint").alias("note_no"))


@query("SELECT DISTINCT block_id, regexp_extract(content, '(?:No\\.|Nr\\.|paragraph|Randnummer|apartado|al\\.)\\s*([0-9]+)', 1) AS ref FROM text_blocks WHERE regexp_matches(content, '(?:No\\.|Nr\\.|paragraph|Randnummer|apartado|al\\.)\\s*([0-9]+)')")
def note_references(spark, d):
    """The first numbered reference in a block."""
    form = r"(?:No\.|Nr\.|paragraph|Randnummer|apartado|al\.)\s*([0-9]+)"
    return table(spark, d, "text_blocks").where(F.col("content").rlike(form)).select("block_id", F.regexp_extract("content", form, 1).alias("ref")).distinct()


# --- standard names

# Standard fields with the names that they are known by, in the order in which they are tried.
COLUMNS = [("sequence", ("seq_no", "no", "number")), ("timestamp", ("filed_at", "date", "_at")), ("party", ("party_name", "payer", "counsel")), ("role", ("party_role", "role")), ("amount", ("amount", "total_amount", "fee")), ("title", ("entry_title", "description", "title")), ("measure", ("length", "weight", "volume", "floor_area"))]
_EXACT = "CASE " + " ".join("WHEN key IN (" + ", ".join(f"'{a}'" for a in names) + f") THEN '{field}'" for field, names in COLUMNS) + " END"
_PART = "CASE " + " ".join(f"WHEN contains(key, '{names[0]}') OR contains('{names[0]}', key) THEN '{field}'" for field, names in COLUMNS) + " END"


def _standard(key):
    exact = F.coalesce(*[F.when(key.isin(*names), field) for field, names in COLUMNS])
    return F.coalesce(exact, *[F.when(key.contains(names[0]) | F.contains(F.lit(names[0]), key), field) for field, names in COLUMNS])


@query(f"WITH k AS (SELECT DISTINCT dataset_id, field_key, regexp_replace(field_key, '\\s', '', 'g') AS key FROM audit_cells WHERE length(field_key) > 0), m AS (SELECT *, coalesce({_EXACT}, {_PART}) AS field, CASE WHEN {_EXACT} IS NOT NULL THEN 0 ELSE 1 END AS r FROM k) SELECT dataset_id, field, arg_min(field_key, (r, field_key)) AS field_key FROM m WHERE field IS NOT NULL GROUP BY 1, 2")
def matched_columns(spark, d):
    """The column of each dataset that stands for a standard field: exact names before parts of names, each field once."""
    k = table(spark, d, "audit_cells").where(F.length("field_key") > 0).select("dataset_id", "field_key").distinct().withColumn("key", F.regexp_replace("field_key", r"\s", ""))
    exact = F.coalesce(*[F.when(F.col("key").isin(*names), F.lit(0)) for _, names in COLUMNS], F.lit(1))
    m = k.withColumns({"field": _standard(F.col("key")), "r": exact}).where("field IS NOT NULL")
    return m.groupBy("dataset_id", "field").agg(F.min_by("field_key", F.struct("r", "field_key")).alias("field_key"))


_STRIP = "regexp_replace(regexp_replace(trim(value, ' '), '[¥￥$€£₤₩,，\\s元圆]', '', 'g'), '^\\++', '')"


_NUM = f"CASE WHEN regexp_matches({_STRIP}, '^[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?$') THEN CASE WHEN contains(lower({_STRIP}), 'e') OR length({_STRIP}) > 25 THEN round(try_cast({_STRIP} AS DOUBLE), 2) ELSE round(try_cast({_STRIP} AS DECIMAL(38, 9)), 2)::DOUBLE END END"


@query(f"SELECT DISTINCT cell_id, coalesce({_EXACT}, {_PART}, 'raw_' || field_key) AS field, CASE WHEN coalesce({_EXACT}, {_PART}) = 'amount' THEN printf('%.2f', {_NUM}) ELSE value END AS value FROM (SELECT cell_id, field_key, value, regexp_replace(field_key, '\\s', '', 'g') AS key FROM audit_cells WHERE length(field_key) > 0)")
def normalized_records(spark, d):
    """Cells under standard names with amounts as numbers; fields without one keep their name behind raw_."""
    c = table(spark, d, "audit_cells").where("length(field_key) > 0").select("cell_id", "field_key", "value")
    c = staged(c, {"field": _standard(F.regexp_replace("field_key", r"\s", "")), "n": cells.amount_of(F.col("value"))})
    amount = F.coalesce(F.col("field") == "amount", F.lit(False))
    return c.select("cell_id", F.coalesce("field", F.concat(F.lit("raw_"), "field_key")).alias("field"), F.when(amount, F.when(F.col("n").isNotNull(), F.format_string("%.2f", "n"))).otherwise(F.col("value")).alias("value")).distinct()


_SYN = "('payer', 'party', 2), ('counsel', 'party', 3), ('party_name', 'party', 1), ('entry_title', 'title', 1), ('description', 'title', 2)"


@query(f"WITH s(field_key, canonical, r) AS (VALUES {_SYN}), c AS (SELECT record_id, canonical, r, min(value) AS value FROM audit_cells JOIN s USING (field_key) WHERE length(value) > 0 GROUP BY 1, 2, 3) SELECT record_id, canonical, arg_min(value, r) AS value FROM c GROUP BY 1, 2")
def canonical_entities(spark, d):
    """Facts of records under canonical names: of several synonyms the first in order that has a value."""
    rank = F.create_map(*[F.lit(x) for k, v in {"party_name": 1, "payer": 2, "counsel": 3, "entry_title": 1, "description": 2}.items() for x in (k, v)])
    name = F.when(F.col("field_key").isin("party_name", "payer", "counsel"), "party").otherwise("title")
    c = table(spark, d, "audit_cells").where("length(value) > 0").where(F.col("field_key").isin("party_name", "payer", "counsel", "entry_title", "description"))
    return c.groupBy("record_id", name.alias("canonical")).agg(F.min_by("value", F.struct(F.try_element_at(rank, F.col("field_key")), "value")).alias("value"))


@query("SELECT file_id, coalesce(max(nullif(trim(id_number, ' '), '')), max(nullif(trim(account_number, ' '), '')), max(nullif(trim(subject_name, ' '), ''))) AS identity, CASE WHEN max(nullif(trim(id_number, ' '), '')) IS NOT NULL THEN 'id_number' WHEN max(nullif(trim(account_number, ' '), '')) IS NOT NULL THEN 'account_number' WHEN max(nullif(trim(subject_name, ' '), '')) IS NOT NULL THEN 'subject_name' END AS source FROM package_files GROUP BY 1")
def identities(spark, d):
    """The first identity that a file states: number, account, else name."""
    names = ("id_number", "account_number", "subject_name")
    f = table(spark, d, "package_files").groupBy("file_id").agg(*[F.max(F.nullif(F.trim(c), F.lit(""))).alias(c) for c in names])
    return f.select("file_id", F.coalesce(*names).alias("identity"), F.coalesce(*[F.when(F.col(c).isNotNull(), c) for c in names]).alias("source"))


# --- statements in text

_ROWS = f"(SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey, amount, balance FROM {STATEMENT})"


def _statements(spark, d):
    """(o_custkey, text): each customer's orders as a statement in text, with a head of totals and rows over two lines."""
    dates = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("amount"), F.round(F.sum("o_totalprice").over(dates), 2).alias("balance"))
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", "amount", "balance")))
    g = o.groupBy("o_custkey").agg(rows.alias("rows"), F.count("*").alias("n"), F.sum("amount").alias("total"))
    line = lambda r, i: F.format_string("%d 2024-01-02 10:00:00 order\n%s %,.2f %,.2f", i + 1, r["o_orderkey"].cast("string"), r["amount"], r["balance"])
    text = F.concat(F.format_string("Statement\nDebit 0 0.00 Credit %d %,.2f Rows %d\n", F.col("n"), F.col("total"), F.col("n")), F.array_join(F.transform("rows", line), "\n"))
    return g.select("o_custkey", text.alias("text"))


def _read(spark, d):
    return ledgers.directed(ledgers.rows_of_text(_statements(spark, d), "o_custkey", "text"), ["o_custkey"], "row_no", "amount", "balance")


@query(f"SELECT o_custkey, n::INTEGER AS row_no, '2024-01-02' AS day, '10:00:00' AS time, 'order ' || o_orderkey AS summary, amount, balance FROM {_ROWS}")
def statement_rows(spark, d):
    """The rows of every statement in text."""
    return ledgers.rows_of_text(_statements(spark, d), "o_custkey", "text")


_SOLVED = f"""(SELECT *, CASE WHEN prev IS NULL THEN 'income' WHEN abs(round(balance - prev, 2) - amount) <= 0.01 THEN 'income' WHEN abs(round(balance - prev, 2) + amount) <= 0.01 THEN 'expense' ELSE '' END AS direction FROM (SELECT *, lag(balance) OVER (PARTITION BY o_custkey ORDER BY n) AS prev FROM {_ROWS}))"""


@query(f"""WITH s AS {_SOLVED}, k AS (SELECT o_custkey, count(*) AS n, count_if(direction = 'expense' AND prev IS NOT NULL) AS d, count_if(direction = 'income' AND prev IS NOT NULL) AS c, coalesce(sum(amount) FILTER (WHERE direction = 'income' AND prev IS NOT NULL), 0) AS ct, coalesce(sum(amount) FILTER (WHERE direction = 'expense' AND prev IS NOT NULL), 0) AS dt, max(amount) FILTER (WHERE prev IS NULL) AS first, max(CASE WHEN balance - amount >= -0.01 THEN 'income' ELSE 'expense' END) FILTER (WHERE prev IS NULL) AS guess, sum(amount) AS total,
count_if(prev IS NOT NULL AND abs(round(CASE WHEN direction = 'income' THEN prev + amount ELSE prev - amount END - balance, 2)) > 0.01) AS breaks FROM s GROUP BY 1),
f AS (SELECT *, CASE WHEN d = 0 AND c + 1 = n AND abs(round(ct + first, 2) - round(total, 2)) <= 0.01 THEN 'income' ELSE guess END AS first_direction FROM k)
SELECT o_custkey, true AS rows_agree, d + (first_direction = 'expense')::INTEGER = 0 AND c + (first_direction = 'income')::INTEGER = n AS counts_agree, abs(round(dt + CASE WHEN first_direction = 'expense' THEN first ELSE 0 END, 2)) <= 0.01 AND abs(round(ct + CASE WHEN first_direction = 'income' THEN first ELSE 0 END, 2) - round(total, 2)) <= 0.01 AS totals_agree, breaks = 0 AS chain_holds, first_direction FROM f""")
def statement_gates(spark, d):
    """Every statement held against its own head and its chain of balances: four gates, and the direction of its first row."""
    heads = _statements(spark, d).select("o_custkey", ledgers.head_totals(F.col("text")).alias("head"))
    return ledgers.reconciled(_read(spark, d), heads, "o_custkey")


@query(f"SELECT o_custkey, n::INTEGER AS row_no, CASE WHEN direction = 'expense' THEN printf('%.2f', amount) ELSE '' END AS debit, CASE WHEN direction = 'income' THEN printf('%.2f', amount) ELSE '' END AS credit, printf('%.2f', balance) AS balance FROM (SELECT * REPLACE (CASE WHEN prev IS NULL AND NOT balance - amount >= -0.01 THEN 'expense' ELSE direction END AS direction) FROM {_SOLVED})")
def split_statements(spark, d):
    """Rows of statements with their amounts in columns of debit and credit."""
    shown = lambda c, on: F.when(on, F.format_string("%.2f", c)).otherwise("")
    r = _read(spark, d)
    return r.select("o_custkey", "row_no", shown(F.col("amount"), F.col("direction") == "expense").alias("debit"), shown(F.col("amount"), F.col("direction") == "income").alias("credit"), F.format_string("%.2f", "balance").alias("balance"))


@query(f"WITH k AS (SELECT o_custkey, arg_min(balance - amount, n) AS opening, sum(amount) AS delta, arg_max(balance, n) AS ending FROM {_ROWS} GROUP BY 1) SELECT o_custkey, round(opening, 2) + 0 AS opening, round(ending, 2) AS ending, abs(opening + delta - ending) <= 0.05 AS rolls_forward FROM k")
def roll_forward(spark, d):
    """Whether the opening balance and all changes give the ending balance of each statement."""
    k = _read(spark, d).groupBy("o_custkey").agg(F.min_by(F.col("balance") - F.col("amount"), "row_no").alias("opening"), F.sum("amount").alias("delta"), F.max_by("balance", "row_no").alias("ending"))
    return k.select("o_custkey", (F.round("opening", 2) + 0).alias("opening"), F.round("ending", 2).alias("ending"), (F.abs(F.col("opening") + F.col("delta") - F.col("ending")) <= 0.05).alias("rolls_forward"))


# --- hierarchies and dictionaries

_LEVEL = "CASE WHEN regexp_matches(line, '^\\s*[IVX]+\\. ') THEN 1 WHEN regexp_matches(line, '^\\s*[0-9]+\\. ') THEN 2 WHEN regexp_matches(line, '^\\s*[\\[(][0-9a-z]+[\\])] ') THEN 3 END"


@query(f"WITH r AS (SELECT doc_id, line_no, {_LEVEL} AS level FROM {LINES}), h AS (SELECT doc_id, line_no, level FROM r WHERE level IS NOT NULL) SELECT doc_id, line_no, level, CASE level WHEN 3 THEN max(CASE WHEN level < 3 THEN line_no END) OVER w WHEN 2 THEN max(CASE WHEN level < 2 THEN line_no END) OVER w END AS parent_line FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def row_hierarchy(spark, d):
    """Numbered lines with their level and the nearest line before that is above them."""
    line = F.col("line")
    level = F.when(line.rlike(r"^\s*[IVX]+\. "), 1).when(line.rlike(r"^\s*[0-9]+\. "), 2).when(line.rlike(r"^\s*[\[(][0-9a-z]+[\])] "), 3)
    h = _lines(table(spark, d, "documents")).select("doc_id", "line_no", level.alias("level")).where("level IS NOT NULL")
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    up = {k: F.max(F.when(F.col("level") < k, F.col("line_no"))).over(before) for k in (2, 3)}
    return h.select("doc_id", "line_no", "level", F.when(F.col("level") == 3, up[3]).when(F.col("level") == 2, up[2]).alias("parent_line"))


WORDS = ["appellant", "respondent", "court", "tribunal", "landlord", "tenant", "insurer", "carrier", "judgment", "certificate", "agreement", "assignment", "limitation period", "consideration", "liquidator", "Berufung", "Urteil", "défendeur", "recurso", "licenciement"]
_W = ", ".join(f"('{w}')" for w in WORDS)


@query(f"WITH w(word) AS (VALUES {_W}), p AS (SELECT doc_id, word, string_split(text, word) AS parts FROM documents JOIN w ON contains(text, word)), i AS (SELECT doc_id, word, parts, unnest(range(1, len(parts))) AS k FROM p) SELECT doc_id, word, CAST(list_sum([length(x) FOR x IN parts[1:k]]) + (k - 1) * length(word) AS INTEGER) AS start FROM i")
def vocabulary_hits(spark, d):
    """Every place where a word of the dictionary stands in a document."""
    return lexicon.hits(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", WORDS)


@query(f"WITH w(word) AS (VALUES {_W}) SELECT doc_id, count(word) AS words, coalesce(round(count(word) / {len(WORDS)}, 4), 0) AS share FROM documents LEFT JOIN w ON contains(text, word) WHERE text IS NOT NULL GROUP BY 1")
def vocabulary_scores(spark, d):
    """How many words of the dictionary each document knows."""
    n = sum(F.col("text").contains(w).cast("int") for w in WORDS)
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", n.cast("bigint").alias("words"), F.round(n / len(WORDS), 4).alias("share"))


@query()
def lexicon_corrections(spark, d):
    """Words of the blocks that stand for one term of the lexicon only; tested against brute force."""
    words = table(spark, d, "text_blocks").select(F.explode(F.regexp_extract_all(F.lower("content"), F.lit(r"([\p{L}\d]{3,})"), 1)).alias("word")).distinct()
    return lexicon.corrections(words, "word", [w.lower() for w in WORDS if " " not in w])


_TOKENS = {"latin": "[A-Za-zÀ-ɏ]+(?:['’-][A-Za-zÀ-ɏ]+)*", "digits": "[0-9]+", "cjk": "[\\x{4e00}-\\x{9fff}]"}


@query("SELECT DISTINCT block_id, " + ", ".join(f"len(regexp_extract_all(content, '{p.replace(chr(39), chr(39) * 2)}'))::INTEGER AS {n}" for n, p in _TOKENS.items()) + " FROM text_blocks WHERE content IS NOT NULL")
def script_tokens(spark, d):
    """Tokens of each block by script: words of letters, numbers, single CJK signs."""
    count = lambda p: F.size(F.regexp_extract_all("content", F.lit(f"({p})"), 1))
    return table(spark, d, "text_blocks").where("content IS NOT NULL").select("block_id", *[count(p).alias(n) for n, p in _TOKENS.items()]).distinct()


# --- contracts

_KEYS = "['schema_version', 'mirror', 'datasets']"


@query(f"SELECT DISTINCT artifact_id, array_to_string(list_sort([k FOR k IN {_KEYS} IF NOT list_contains(json_keys(p), k)]), ',') AS missing FROM (SELECT artifact_id, payload::JSON AS p FROM mirror_artifacts WHERE json_valid(payload) AND json_type(payload) = 'OBJECT')")
def missing_keys(spark, d):
    """The required keys that each payload lacks at its top."""
    keys = F.expr("json_object_keys(payload)")
    p = table(spark, d, "mirror_artifacts").where(F.expr("try_parse_json(payload) IS NOT NULL AND try_variant_get(try_parse_json(payload), '$', 'map<string,variant>') IS NOT NULL"))
    return p.select("artifact_id", F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, ("schema_version", "mirror", "datasets"))), keys)), ",").alias("missing")).distinct()


_REQ = "('ds_docket_entries', 'filed_at'), ('ds_docket_entries', 'entry_title'), ('ds_parties', 'party_name'), ('ds_parties', 'party_role'), ('ds_payments', 'amount'), ('ds_payments', 'payer')"


@query(f"WITH req(dataset_id, field_key) AS (VALUES {_REQ}), n AS (SELECT dataset_id, count(*) AS need FROM req GROUP BY 1), r AS (SELECT dataset_id, record_id, count(DISTINCT CASE WHEN length(value) > 0 THEN req.field_key END) AS have FROM audit_cells c LEFT JOIN req USING (dataset_id, field_key) GROUP BY 1, 2) SELECT r.dataset_id, count(*) AS records, count(*) FILTER (WHERE have = need) AS complete, CASE WHEN need IS NULL THEN 'skip' WHEN count_if(have = need) = count(*) THEN 'pass' ELSE 'partial' END AS outcome FROM r LEFT JOIN n USING (dataset_id) GROUP BY r.dataset_id, need")
def domain_contracts(spark, d):
    """Whether the records of each dataset have the fields that its contract asks for; datasets without a contract are skipped."""
    req = {"ds_docket_entries": ("filed_at", "entry_title"), "ds_parties": ("party_name", "party_role"), "ds_payments": ("amount", "payer")}
    have = sum((F.max(((F.col("dataset_id") == ds) & (F.col("field_key") == f) & (F.coalesce(F.length("value"), F.lit(0)) > 0)).cast("int")) for ds, fs in req.items() for f in fs), F.lit(0))
    need = F.coalesce(*[F.when(F.col("dataset_id") == ds, len(fs)) for ds, fs in req.items()])
    r = table(spark, d, "audit_cells").groupBy("dataset_id", "record_id").agg(have.alias("have"))
    whole = F.coalesce(F.col("have") == need, F.lit(False))
    g = r.groupBy("dataset_id").agg(F.count("*").alias("records"), F.count_if(whole).alias("complete"))
    return g.select("dataset_id", "records", "complete", F.when(need.isNull(), "skip").when(F.col("complete") == F.col("records"), "pass").otherwise("partial").alias("outcome"))


@query("WITH b AS (SELECT DISTINCT block_id, doc_id, page_number, reading_order, level FROM text_blocks WHERE doc_id IS NOT NULL), j AS (SELECT f.block_id AS target, c.block_id AS caption, row_number() OVER (PARTITION BY f.block_id ORDER BY abs(c.reading_order - f.reading_order), c.block_id) AS r FROM b f JOIN b c ON f.doc_id = c.doc_id AND f.page_number = c.page_number AND abs(c.reading_order - f.reading_order) <= 3 WHERE f.level = 'body' AND c.level = 'h2') SELECT target, caption FROM j WHERE r = 1")
def caption_relations(spark, d):
    """The nearest heading on a text's page within three places of it."""
    b = table(spark, d, "text_blocks").where("doc_id IS NOT NULL").select("block_id", "doc_id", "page_number", "reading_order", "level").distinct()
    f = b.where("level = 'body'").select("doc_id", "page_number", F.col("block_id").alias("target"), F.col("reading_order").alias("o"))
    c = b.where("level = 'h2'").select("doc_id", "page_number", F.col("block_id").alias("caption"), F.col("reading_order").alias("p"))
    c = c.withColumn("o", F.explode(F.sequence(F.col("p") - 3, F.col("p") + 3)))  # places meet by equality, not all headings all texts
    j = f.join(c, ["doc_id", "page_number", "o"])
    return j.groupBy("target").agg(F.min_by("caption", F.struct(F.abs(F.col("o") - F.col("p")), "caption")).alias("caption"))


QUERIES, ORACLES = query.queries, query.oracles
