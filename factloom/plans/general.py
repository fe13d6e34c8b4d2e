"""The general training-data queries (p2, p3, p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.io import table
from factloom.operators import instants, nested, quantities
from factloom.operators.common import latest

AMOUNTS = ("total_amount", "costs_awarded", "security_deposit", "filing_fee")


def _times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "audit_cells").where(F.col("field_key").endswith("_at"))


def p3_instants(spark: SparkSession, d: str) -> DataFrame:
    """Every time cell with its instant in seconds and in ISO form (UTC)."""
    rows = instants.to_instants(_times(spark, d), table(spark, d, "feeds"))
    return rows.select("cell_id", "record_id", "field_key", "value", F.col("instant").alias("instant_s"), F.date_format(F.timestamp_seconds("instant"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("instant_utc"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of cells of one field of one record that denote the same second."""
    rows = instants.to_instants(_times(spark, d), table(spark, d, "feeds")).where("instant IS NOT NULL").select("record_id", "field_key", "instant", "cell_id")
    left, right = rows.withColumnRenamed("cell_id", "left_cell_id"), rows.withColumnRenamed("cell_id", "right_cell_id")
    return left.join(right, ["record_id", "field_key", "instant"]).where("left_cell_id < right_cell_id").select("left_cell_id", "right_cell_id")


def p3_zones(spark: SparkSession, d: str) -> DataFrame:
    """The zone that fits each feed's wall times best, found without its declared zone."""
    feeds = table(spark, d, "feeds").select("feed_id", F.lit(None).cast("string").alias("_zone"), F.col("date_order").alias("_declared_order"))
    timed = instants.read_times(_times(spark, d).join(F.broadcast(feeds), "feed_id"), "value", "_declared_order", "_zone")
    timed = latest(timed, "cell_id", "ingested_at", "record_id", "field_key", "feed_id", "ingested_at", "_abs", "_wall", "_named")
    found = instants.estimate_zones(timed, "feed_id", ["record_id", "field_key"], "ingested_at")
    history = F.array_join(F.transform("offsets", lambda o: F.format_string("%s to %s: %d", F.date_format(o["first_hour"], "yyyy-MM"), F.date_format(o["last_hour"], "yyyy-MM"), o["minutes"])), "; ")
    return found.select("feed_id", "zone", "violations", "evidence", history.alias("offsets"))


def _cells_in_common_unit(spark: SparkSession, d: str, unit_table: DataFrame) -> DataFrame:
    kinds = list(quantities.COMMON_UNIT)
    cells = latest(table(spark, d, "audit_cells").where(F.col("field_key").isin(kinds)), "cell_id", "ingested_at", "record_id", "field_key", "feed_id", "value", "unit")
    feeds = F.broadcast(table(spark, d, "feeds").select("feed_id", "decimal_mark", "home_currency"))  # TESTDATA.md: nine rows at every scale
    return quantities.to_common_unit(cells.join(feeds, "feed_id", "left"), unit_table, kind="field_key", value="value", unit="unit", mark="decimal_mark", dollar="home_currency")


def _trust_in_common_unit(spark: SparkSession, d: str, unit_table: DataFrame) -> DataFrame:
    fields = latest(table(spark, d, "trust_fields").where(F.col("name").isin(*AMOUNTS)), "field_id", "extracted_at", "artifact_key", "name", "value", "currency")
    return quantities.to_common_unit(fields.withColumn("kind", F.lit("amount")), unit_table, kind="kind", value="value", unit="currency")


def p5_quantities(spark: SparkSession, d: str) -> DataFrame:
    """Every quantity of cells and trust fields in its common unit, rounded to eleven significant digits (ties away from zero, in any engine)."""
    unit_table = quantities.units(spark, table(spark, d, "fx_rates"))
    names = F.create_map(*[F.lit(x) for pair in quantities.COMMON_UNIT.items() for x in pair])
    rounded = F.format_string("%.10e", F.col("quantity") * (1 + 1e-13)).alias("quantity")
    cells = _cells_in_common_unit(spark, d, unit_table).select(F.lit("cell").alias("src"), F.col("cell_id").alias("row_id"), F.col("field_key").alias("kind"), F.when(F.col("quantity").isNotNull(), rounded).alias("quantity"), F.try_element_at(names, F.col("field_key")).alias("unit"))
    trust = _trust_in_common_unit(spark, d, unit_table).select(F.lit("trust").alias("src"), F.col("field_id").alias("row_id"), "kind", F.when(F.col("quantity").isNotNull(), rounded).alias("quantity"), F.lit("EUR").alias("unit"))
    return cells.unionByName(trust)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of cells of one field of one record, and of trust fields of one artifact and name, that state the same quantity."""
    unit_table = quantities.units(spark, table(spark, d, "fx_rates"))
    cells = _cells_in_common_unit(spark, d, unit_table).withColumn("kind", F.col("field_key"))
    cells = quantities.same_quantity(cells, "cell_id", ["record_id", "field_key"], kind="kind")
    trust = quantities.same_quantity(_trust_in_common_unit(spark, d, unit_table), "field_id", ["artifact_key", "name"], kind="kind")
    return cells.select(F.lit("cell").alias("src"), "left_id", "right_id").unionByName(trust.select(F.lit("trust").alias("src"), "left_id", "right_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct parent-child link of the payloads."""
    return nested.links(nested.parsed(table(spark, d, "mirror_artifacts")))


def _flat(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = getattr(nested, name)(nested.parsed(table(spark, d, "mirror_artifacts")))
        if name == "blocks":
            rows = rows.withColumn("bbox", F.array_join(F.transform("bbox", lambda x: F.format_string("%.2f", x)), " "))
        return rows.drop("page_idx", "block_idx", "edge_idx", "dataset_idx", "row_idx", "item_idx")

    query.__doc__ = f"The flat table of {name}, without the places within lists."
    return query


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_instants, p3_zones, p5_found, p5_quantities)} | {f"p2_{n}": _flat(n) for n in ("pages", "blocks", "edges", "datasets", "rows", "items")}
