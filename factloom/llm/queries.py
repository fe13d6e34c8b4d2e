"""The queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.io import table
from factloom.llm import common, lookalike, mixing, packing, pieces, pii, residue, scanned
from factloom.operators.common import latest

LOOKALIKE_FIELDS = ("entry_title", "description", "payer", "party_name", "counsel")


def _pii_texts(spark: SparkSession, d: str) -> DataFrame:
    """(src, row_id, text) of every text that may hold personal items, the latest delivery of each row."""
    blocks, files = table(spark, d, "text_blocks"), table(spark, d, "package_files")
    content = common.latest_texts(blocks, "block_id", "received_at", "content").select(F.lit("content").alias("src"), F.col("block_id").alias("row_id"), F.col("content").alias("text"))
    numbers = common.latest_texts(files, "file_id", "received_at", "id_number", "account_number")
    numbers = numbers.select(F.inline(F.array(*[F.struct(F.lit(c).alias("src"), F.col("file_id").alias("row_id"), F.col(c).alias("text")) for c in ("id_number", "account_number")])))
    return content.unionByName(numbers)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per personal item."""
    return pii.items(_pii_texts(spark, d), ["src", "row_id"], "text").select("src", "row_id", "kind", "begin_at")


def p1_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Every text with typed placeholders in place of its items."""
    return pii.replaced(_pii_texts(spark, d), "text").select("src", "row_id", "clean", "n_items")


def _look_texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cells = table(spark, d, "audit_cells").where(F.col("field_key").isin(*LOOKALIKE_FIELDS))
    cells = latest(cells, "cell_id", "ingested_at", "record_id", "field_key", "raw").select("cell_id", "record_id", "field_key", F.col("raw").alias("text"))
    blocks = common.latest_texts(table(spark, d, "text_blocks"), "block_id", "received_at", "doc_id", "content").select("block_id", "doc_id", F.col("content").alias("text"))
    return cells, blocks


def _look_table(spark: SparkSession, d: str) -> dict[str, str]:
    texts = table(spark, d, "audit_cells").select(F.col("raw").alias("text")).unionByName(table(spark, d, "text_blocks").select(F.col("content").alias("text")))
    return lookalike.table_of(texts, "text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of cells of one field of one record, and of blocks of one document, that look the same in different characters."""
    forms = _look_table(spark, d)
    cells, blocks = (lookalike.consistent(x, "text", forms) for x in _look_texts(spark, d))
    cells = lookalike.same_look(cells, "cell_id", ["record_id", "field_key"], "text")
    blocks = lookalike.same_look(blocks, "block_id", ["doc_id"], "text")
    return cells.select(F.lit("cell").alias("src"), "left_id", "right_id").unionByName(blocks.select(F.lit("block").alias("src"), "left_id", "right_id"))


def p4_consistent(spark: SparkSession, d: str) -> DataFrame:
    """Every raw cell text and block content in its consistent form."""
    cells = latest(table(spark, d, "audit_cells"), "cell_id", "ingested_at", "raw").select(F.lit("cell").alias("src"), F.col("cell_id").alias("row_id"), F.col("raw").alias("text"))
    blocks = common.latest_texts(table(spark, d, "text_blocks"), "block_id", "received_at", "content").select(F.lit("block").alias("src"), F.col("block_id").alias("row_id"), F.col("content").alias("text"))
    return lookalike.consistent(cells.unionByName(blocks), "text", _look_table(spark, d)).select("src", "row_id", "clean")


def _scanned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    results = table(spark, d, "parse_results").where("extraction_method = 'ocr' AND length(full_text) > 0").select("result_id", "parsed_at", scanned.pages_of("full_text", "pages").alias("pages"))
    results = latest(results, "result_id", "parsed_at", "pages").withColumnRenamed("result_id", "row_id")
    blocks = table(spark, d, "text_blocks").where(F.col("content").contains("\n"))
    return results, latest(blocks, "block_id", "received_at", "content").select(F.col("block_id").alias("row_id"), F.col("content").alias("text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per line and kind of noise in scanned texts."""
    parts = scanned.repaired_parts(*_scanned(spark, d))
    lines = [parts["furniture"], parts["cuts"].where("joined IS NOT NULL").select("src", "row_id", "line_no", F.lit("split_word").alias("kind")), parts["misread"].select("src", "row_id", "line_no", F.lit("misread").alias("kind")).distinct()]
    return lines[0].unionByName(lines[1]).unionByName(lines[2]).select("src", "row_id", "line_no", "kind")


def p10_residue(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are template residue, filler, error pages or script notices, with the evidence."""
    docs = table(spark, d, "documents").select("doc_id", "text", "docket_no", "source", "ruling_no")
    docs = docs.repartition(common.tasks(docs, 1 << 20))
    return residue.residue(docs, "doc_id", "text", slug="docket_no", host="source", unit="ruling_no").select("doc_id", F.array_join("evidence", ",").alias("evidence"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents to leave out."""
    return p10_residue(spark, d).select("doc_id")


def p10_kept(spark: SparkSession, d: str) -> DataFrame:
    """Documents that stay, by source."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    return docs.join(p10_found(spark, d), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("kept"))


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every scanned text as continuous paragraphs, without heads, page numbers, split and misread words."""
    return scanned.repaired(*_scanned(spark, d))


def _results(spark: SparkSession, d: str, only: str = "true") -> DataFrame:
    results = table(spark, d, "parse_results").where(F.expr(only) & (F.length("full_text") > 0))
    return common.latest_texts(results, "result_id", "parsed_at", "full_text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs that no cut at a natural boundary makes small enough."""
    return pieces.unsplittable(_results(spark, d, "extraction_method = 'digital'"), "result_id", "full_text")


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every result's full text, at most 1,800 characters each with 200 characters of overlap."""
    return pieces.pieces(_results(spark, d), "result_id", "full_text")


def p7_page_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every page's text, at most 1,800 characters each with 200 characters of overlap."""
    results = table(spark, d, "parse_results").where(F.size("pages") > 0)
    pages = common.latest_texts(results, "result_id", "parsed_at", "pages").select("result_id", F.inline("pages"))
    pages = pages.select(F.struct("result_id", "page_number").alias("page"), "page_text")
    return pieces.pieces(pages, "page", "page_text").select("page.*", "piece_no", "begin_at", "overlap_chars", "piece")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return packing.sized(docs.repartition(common.tasks(docs, 1 << 20)), "text", ["doc_id", "source"])


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The containers of each capacity: how many items and tokens each holds."""
    placed = p8_placed(spark, d)
    return placed.groupBy("pack_id", "capacity", "container").agg(F.count("*").alias("items"), F.sum("tokens").alias("filled"))


def p8_placed(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of every part of a document above the capacity, for each capacity."""
    sizes = packing.materialized(_sized(spark, d).select("doc_id", "tokens"))
    out = None
    for r in table(spark, d, "pack_sizes").select("pack_id", "capacity_tokens").orderBy("pack_id").collect():  # TESTDATA.md: three rows
        one = packing.packed(sizes, "doc_id", "tokens", r["capacity_tokens"]).withColumns({"pack_id": F.lit(r["pack_id"]), "capacity": F.lit(r["capacity_tokens"])})
        out = one if out is None else out.unionByName(one)
    return out.select("pack_id", "capacity", "container", "doc_id", "part", "tokens")


def p9_mixed(spark: SparkSession, d: str) -> DataFrame:
    """Every chosen document and how often it is repeated."""
    return mixing.mixed(_sized(spark, d), table(spark, d, "mix_targets"), key="doc_id", source="source", size="tokens")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The actual share of each source in the mixture beside its target."""
    return mixing.shares(_sized(spark, d), table(spark, d, "mix_targets"), key="doc_id", source="source", size="tokens")


# --- what must hold of the results, stated in SQL too


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    """Every full text put together again from its pieces, and whether all pieces keep within the limit."""
    rows = p7_pieces(spark, d)
    fresh = F.expr("substring(piece, overlap_chars + 1)")
    parts = F.array_sort(F.collect_list(F.struct("piece_no", fresh.alias("t"))))
    return rows.groupBy("result_id").agg(F.md5(F.encode(F.array_join(F.transform(parts, lambda x: x["t"]), ""), "utf-8")).alias("digest"), (F.max(F.length("piece")) <= 1800).alias("within"))


def p8_whole(spark: SparkSession, d: str) -> DataFrame:
    """For each capacity: how many documents are placed, whether no container is overfull, whether only larger texts are split and all parts are there."""
    placed = p8_placed(spark, d)
    docs = placed.groupBy("pack_id", "capacity", "doc_id").agg(F.count("*").alias("parts"), F.max("part").alias("last"), F.sum("tokens").alias("tokens"))
    docs = docs.groupBy("pack_id").agg(F.count("*").alias("documents"), F.bool_and((F.col("parts") == F.col("last") + 1) & (F.col("parts") == F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity"))))).alias("parts_agree"))
    bins = placed.groupBy("pack_id", "capacity", "container").agg(F.sum("tokens").alias("filled")).groupBy("pack_id").agg(F.bool_and(F.col("filled") <= F.col("capacity")).alias("fits"))
    return docs.join(bins, "pack_id")


def p9_close(spark: SparkSession, d: str) -> DataFrame:
    """For each source: whether its share is within a thousandth of its target and no document is repeated too often."""
    goal = table(spark, d, "mix_targets").select("source", "max_repeats")
    rows = p9_shares(spark, d).join(F.broadcast(goal), "source")  # TESTDATA.md: seven rows
    return rows.select("source", "target_share", (F.abs(F.col("actual_share") - F.col("target_share")) < 0.001).alias("close"), (F.coalesce("most_repeats", F.lit(0)) <= F.col("max_repeats")).alias("within"))


_MARK = r"\[(?:EMAIL|PHONE|IDENTITY|ACCOUNT|ADDRESS|NAME)\]"


def p1_marked(spark: SparkSession, d: str) -> DataFrame:
    """For every text, whether as many placeholders were put in as items were found, and whether a text without items is left as it was."""
    rows = pii.replaced(_pii_texts(spark, d), "text")
    marks = lambda c: F.coalesce(F.regexp_count(c, F.lit(_MARK)), F.lit(0))
    return rows.select("src", "row_id", (marks(F.col("clean")) - marks(F.col("text")) == F.col("n_items")).alias("marked"), ((F.col("n_items") > 0) | F.col("clean").eqNullSafe(F.col("text"))).alias("untouched"))


def p4_plain(spark: SparkSession, d: str) -> DataFrame:
    """For every text, whether one of plain ASCII comes out as it was but for blanks at its ends, and null as null."""
    cells = latest(table(spark, d, "audit_cells"), "cell_id", "ingested_at", "raw").select(F.lit("cell").alias("src"), F.col("cell_id").alias("row_id"), F.col("raw").alias("text"))
    out = lookalike.consistent(cells, "text", _look_table(spark, d))
    plain = F.col("text").rlike(r"^[\x00-\x7F]*$")
    stripped = F.regexp_replace("text", r"^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")
    return out.select("src", "row_id", F.when(F.col("text").isNull(), F.col("clean").isNull()).otherwise(~plain | (F.col("clean") == stripped)).alias("kept"))


def p6_conserved(spark: SparkSession, d: str) -> DataFrame:
    """For every scanned text, whether its repaired paragraphs hold no more characters than it does, but for the blanks between paragraphs and a sign for each
    misread one that stands for two."""
    repaired, (results, blocks) = p6_repaired(spark, d), _scanned(spark, d)
    texts = results.select(F.lit("result").alias("src"), "row_id", F.array_join("pages", "\n").alias("text")).unionByName(blocks.select(F.lit("block").alias("src"), "row_id", "text"))
    size = lambda c: F.length(F.regexp_replace(c, r"\s+", ""))
    return texts.where(F.length("text") > 0).join(repaired, ["src", "row_id"]).select("src", "row_id", (size("repaired") <= size("text") * 1.05 + 4).alias("conserved"))


def p10_counted(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each source: those kept and those left out together."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    out = p10_found(spark, d).select("doc_id").withColumn("out", F.lit(1))
    g = docs.join(out, "doc_id", "left").groupBy("source").agg(F.count_if(F.col("out").isNull()).alias("kept"), F.count_if(F.col("out").isNotNull()).alias("left_out"))
    return g.select("source", (F.col("kept") + F.col("left_out")).alias("documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_replaced, p4_found, p4_consistent, p6_found, p6_repaired, p7_found, p7_pieces, p7_page_pieces, p7_restored, p8_placed, p8_containers, p8_whole, p9_shares, p9_mixed, p9_close, p10_found, p10_residue, p10_kept, p1_marked, p4_plain, p6_conserved, p10_counted)}
ORACLES: dict[str, str] = {
    "p7_restored": "SELECT result_id, md5(arg_max(full_text, parsed_at)) AS digest, true AS within FROM parse_results WHERE length(full_text) > 0 GROUP BY 1",
    "p8_whole": "SELECT pack_id, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS documents, true AS parts_agree, true AS fits FROM pack_sizes",
    "p1_marked": "SELECT DISTINCT src, row_id, true AS marked, true AS untouched FROM (SELECT 'content' AS src, block_id AS row_id FROM text_blocks UNION ALL SELECT unnest(['id_number', 'account_number']), file_id FROM package_files)",
    "p4_plain": "SELECT DISTINCT 'cell' AS src, cell_id AS row_id, true AS kept FROM audit_cells",
    "p6_conserved": "SELECT 'result' AS src, result_id AS row_id, true AS conserved FROM parse_results WHERE extraction_method = 'ocr' AND length(full_text) > 0 GROUP BY ALL UNION ALL SELECT 'block', block_id, true FROM text_blocks WHERE contains(content, chr(10)) GROUP BY ALL",
    "p10_counted": "SELECT source, count(*) AS documents FROM documents GROUP BY 1",
    "p9_close": "SELECT source, target_share, true AS close, true AS within FROM mix_targets",
}
