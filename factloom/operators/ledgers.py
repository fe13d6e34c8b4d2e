"""Statements of account: directions of their rows from the chain of balances, breaks of that chain, rows and totals out of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Difference up to which two amounts agree.
TOLERANCE = 0.01


def directed(rows: DataFrame, keys: list[str], order: str, amount: str, balance: str) -> DataFrame:
    """rows with `prev`, the balance of the row before, and `direction`: income or expense where the balance changed by the amount, empty where it
    didn't; the first row is income unless its opening balance would then be negative."""
    rows = rows.withColumn("prev", F.lag(balance).over(Window.partitionBy(*keys).orderBy(order)))
    delta, a = F.round(F.col(balance) - F.col("prev"), 2), F.col(amount)
    first = F.when(F.col(balance) - a >= -TOLERANCE, "income").otherwise("expense")
    return rows.withColumn("direction", F.when(F.col("prev").isNull(), first).when(F.abs(delta - a) <= TOLERANCE, "income").when(F.abs(delta + a) <= TOLERANCE, "expense").otherwise(""))


def broken(amount: str, balance: str, direction: str, prev: str) -> Column:
    """Whether a row's balance doesn't follow from the one before."""
    expected = F.col(prev) + F.when(F.col(direction) == "income", F.col(amount)).otherwise(-F.col(amount))
    return F.coalesce(F.abs(F.round(expected - F.col(balance), 2)) > TOLERANCE, F.lit(False))


#: A line of a statement's text that begins a row: number, date and time.
ROW_BEGIN = r"^(\d+)\s+(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})"
_MONEY = r"-?\d[\d,]*\.\d{2}"
#: The totals that a statement's head states.
HEAD = r"Debit (\d+) (-?[\d,]+\.\d{2}) Credit (\d+) (-?[\d,]+\.\d{2}) Rows (\d+)"


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def rows_of_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row_no, day, time, summary, amount, balance): rows of statements in text. A row goes from one line with number, date and time to the next; its
    last two amounts are amount and balance, what stands before them the summary. Rows with fewer amounts, and lines before the first row, are left out."""
    lines = df.where(F.length(text) > 0).select(key, F.posexplode(F.split(F.col(text), "\n")).alias("n", "line")).where(F.length(F.trim("line")) > 0)
    begins = F.trim("line").rlike(ROW_BEGIN)
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_row", F.sum(begins.cast("int")).over(w)).where("_row > 0")
    rows = lines.groupBy(key, "_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.trim("line").alias("t")))), lambda x: x["t"]), " ").alias("t"))
    money = F.regexp_extract_all("t", F.lit(f"({_MONEY})"), 1)
    rows = rows.withColumn("m", money).where(F.size("m") >= 2)
    part = lambda i: F.regexp_extract("t", ROW_BEGIN, i)
    summary = F.trim(F.regexp_replace(F.regexp_replace("t", ROW_BEGIN, ""), rf"\s*{_MONEY}\s+{_MONEY}\s*$", ""))
    return rows.select(key, part(1).cast("int").alias("row_no"), part(2).alias("day"), part(3).alias("time"), summary.alias("summary"), _number(F.element_at("m", -2)).alias("amount"), _number(F.element_at("m", -1)).alias("balance"))


def head_totals(text: Column) -> Column:
    """(debits, debit_total, credits, credit_total, rows) that a statement's head states, or null."""
    part = lambda i: F.regexp_extract(text, HEAD, i)
    return F.when(text.rlike(HEAD), F.struct(part(1).cast("int").alias("debits"), _number(part(2)).alias("debit_total"), part(3).cast("int").alias("credits"), _number(part(4)).alias("credit_total"), part(5).cast("int").alias("rows")))


def reconciled(rows: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """(key, rows_agree, counts_agree, totals_agree, chain_holds, first_direction): directed rows held against what their statement's head states. The
    first row's direction is expense if that meets the head, else income if that does, else as directed."""
    one = F.col("prev").isNull()
    side = lambda d: (F.col("direction") == d) & ~one
    per = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(side("expense")).alias("d"), F.count_if(side("income")).alias("c"), F.coalesce(F.sum(F.when(side("expense"), F.col("amount"))), F.lit(0.0)).alias("dt"), F.coalesce(F.sum(F.when(side("income"), F.col("amount"))), F.lit(0.0)).alias("ct"),
        F.max(F.when(one, F.col("amount"))).alias("first"), F.max(F.when(one, F.col("direction"))).alias("guess"), F.count_if(broken("amount", "balance", "direction", "prev")).alias("breaks"),
    ).join(heads, key)
    near = lambda a, b: F.abs(F.round(a, 2) - b) <= TOLERANCE
    h = F.col("head")

    def meets(expense: bool) -> Column:
        d, c, dt, ct = (F.col(x) for x in ("d", "c", "dt", "ct"))
        return ((d + int(expense)) == h["debits"]) & ((c + int(not expense)) == h["credits"]) & near(dt + (F.col("first") if expense else 0), h["debit_total"]) & near(ct + (0 if expense else F.col("first")), h["credit_total"])

    direction = F.when(meets(True), "expense").when(meets(False), "income").otherwise(F.col("guess"))
    e = (F.col("first_direction") == "expense").cast("int")
    per = per.withColumn("first_direction", direction)
    return per.select(
        key, (F.col("n") == h["rows"]).alias("rows_agree"), ((F.col("d") + e == h["debits"]) & (F.col("c") + 1 - e == h["credits"])).alias("counts_agree"),
        (near(F.col("dt") + e * F.col("first"), h["debit_total"]) & near(F.col("ct") + (1 - e) * F.col("first"), h["credit_total"])).alias("totals_agree"), (F.col("breaks") == 0).alias("chain_holds"), "first_direction",
    )
