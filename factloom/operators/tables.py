"""Text tables: pipe rows to cells, continuation rows folded, rows classed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import cells
from factloom.operators.common import staged


def split_pipe_row(line: Column) -> Column:
    """Cells of a pipe row, trimmed; edge pipes give no cells."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))


def classify_pipe_cells(cells: Column) -> Column:
    """separator, data (first cell a number), continuation (first cell blank), footer or header."""
    joined = F.array_join(cells, "")
    first = F.element_at(cells, 1)
    return F.when(joined.rlike(r"^[-=+: ]*$") & (F.length(joined) > 0), "separator").when(F.size(cells) < 2, "junk").when(first.rlike(r"^\d{1,6}$"), "data").when(first == "", "continuation").when(F.lower(joined).rlike("total|sum"), "footer").otherwise("header")


def merge_continuations(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, row_no, cells): data rows with the cells of the continuation rows after them glued on without a separator."""
    kind = classify_pipe_cells(F.col("cells"))
    w = Window.partitionBy(*keys).orderBy(order)
    rows = rows.withColumn("kind", kind).where("kind IN ('data', 'continuation')").withColumn("row_no", F.sum((F.col("kind") == "data").cast("int")).over(w)).where("row_no > 0")
    parts = F.array_sort(F.collect_list(F.struct(order, "cells")))
    glued = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(F.size(a) == 0, x["cells"]).otherwise(F.zip_with(a, x["cells"], lambda p, q: F.concat(F.coalesce(p, F.lit("")), F.coalesce(q, F.lit(""))))))
    return rows.groupBy(*keys, "row_no").agg(glued.alias("cells"))


# --- tables as arrays of rows of cells, the header first. A table without rows comes out as it is.

_DATE = r"\d{4}[-./]\d{1,2}[-./]\d{1,2}"
_AMOUNT = r"^[+-]?\d+\.\d{1,2}$"


def _blank(c: Column) -> Column:
    return F.length(F.trim(F.coalesce(c, F.lit("")))) == 0


def _body(t: Column, f) -> Column:
    """The table with f on each cell below the header."""
    return F.transform(t, lambda row, i: F.when(i == 0, row).otherwise(F.transform(row, f)))


def cleaned(t: Column) -> Column:
    """Every cell without line breaks and without blanks between CJK signs."""
    return F.transform(t, lambda row: F.transform(row, cells.cleaned_cell))


def aligned(t: Column) -> Column:
    """Rows as wide as the header: short ones padded with empty cells, the excess of long ones joined by blanks into the last cell."""
    n = F.size(F.get(t, 0))
    wide = lambda row: F.concat(F.slice(row, 1, n - 1), F.array(F.array_join(F.filter(F.slice(row, n, F.greatest(F.size(row), F.lit(1))), lambda c: F.length(c) > 0), " ")))
    return F.transform(t, lambda row: F.when(F.size(row) < n, F.concat(row, F.array_repeat(F.lit(""), n - F.size(row)))).when(F.size(row) > n, wide(row)).otherwise(row))


def without_underlines(t: Column) -> Column:
    """Cells cut off where three or more underscores begin."""
    return F.transform(t, lambda row: F.transform(row, lambda c: F.when(c.contains("___"), F.rtrim(F.regexp_replace(c, r"(?s)_{3,}.*$", ""))).otherwise(c)))


def without_trailing_columns(t: Column) -> Column:
    """The table without the columns at its right that are empty in every row."""
    last = F.array_max(F.transform(t, lambda row: F.coalesce(F.array_max(F.transform(row, lambda c, i: F.when(~_blank(c), i + 1).otherwise(0))), F.lit(0))))
    return F.transform(t, lambda row: F.slice(row, 1, last))


def without_digit_blanks(t: Column) -> Column:
    """Cells below the header that hold digits and blanks only lose the blanks."""
    return _body(t, lambda c: F.when(F.trim(c).rlike(r"^[\d\s]+$") & F.trim(c).contains(" "), F.replace(F.trim(c), F.lit(" "), F.lit(""))).otherwise(c))


def without_currency(t: Column) -> Column:
    """Cells below the header that are a currency and a number keep the number."""
    form = r"^(?:RMB|CNY|USD|EUR|JPY|HKD|GBP)\s*([\-\d,]+\.?\d*)\s*$"
    return _body(t, lambda c: F.when(F.trim(c).rlike(form), F.regexp_replace(F.trim(c), form, "$1")).otherwise(c))


def without_empty_columns(t: Column) -> Column:
    """The table without the columns that are empty in all rows below the header, if their label is empty or stands there twice."""
    header = F.transform(F.get(t, 0), lambda c: F.trim(F.coalesce(c, F.lit(""))))
    below = F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))
    empty = lambda i: F.forall(below, lambda row: _blank(F.get(row, i)))
    spare = lambda i: (F.get(header, i) == "") | (F.size(F.filter(header, lambda h: h == F.get(header, i))) > 1)
    keep = F.filter(F.sequence(F.lit(0), F.size(header) - 1), lambda i: ~(empty(i) & spare(i)))
    picked = F.transform(t, lambda row: F.transform(keep, lambda i: F.coalesce(F.get(row, i), F.lit(""))))
    return F.when((F.size(t) >= 2) & (F.size(header) > 1), picked).otherwise(t)


def split_joined_cells(t: Column) -> Column:
    """Rows narrower than the header by one whose cell joins an amount and a long number get two cells for it; others stay."""
    n, form = F.size(F.get(t, 0)), r"^(\d{1,3}\.\d{2})(\d{5,}[A-Z]*\d*)"

    def split(row: Column) -> Column:
        at = F.array_min(F.filter(F.transform(row, lambda c, i: F.when(c.rlike(form), i)), lambda i: i.isNotNull()))
        new = F.flatten(F.transform(row, lambda c, i: F.when(i == at, F.array(F.regexp_extract(c, form, 1), F.regexp_extract(c, form, 2))).otherwise(F.array(c))))
        return F.when((F.size(row) == n - 1) & at.isNotNull(), new).otherwise(row)

    return F.transform(t, lambda row, i: F.when(i == 0, row).otherwise(split(row)))


def fixed(t: Column) -> list[tuple[str, object]]:
    """The steps that put a table right, in their order."""
    return [("split", split_joined_cells), ("aligned", aligned), ("cleaned", cleaned), ("underlines", without_underlines), ("trailing", without_trailing_columns), ("digits", without_digit_blanks), ("currency", without_currency), ("columns", without_empty_columns)]


def fixed_tables(df: DataFrame, table: str) -> DataFrame:
    """df with its tables put right, step by step; each step reads the values of the one before."""
    for _, step in fixed(F.col(table)):
        df = staged(df, {table: step(F.col(table))})
    return df


def is_data_row(row: Column) -> Column:
    """Whether a row holds a date or an amount."""
    return F.exists(row, lambda c: F.coalesce(c.rlike(_DATE) | F.regexp_replace(c, "[,¥ ]", "").rlike(_AMOUNT), F.lit(False)))


def is_header_cell(c: Column) -> Column:
    """Whether a cell may be a label: no date, amount, time, long number, currency or single sign, and at most 30 characters."""
    t = F.trim(c)
    data = t.rlike(_DATE) | F.regexp_replace(t, "[,¥]", "").rlike(_AMOUNT) | t.rlike(r"^\d{2}:\d{2}:\d{2}$|^\d{10,}$|^[A-Z]{2,4}\s+[\d,.]+$|^[A-Z]{2,4}$")
    return ~data & F.length(t).between(2, 30)


def is_header_row(row: Column) -> Column:
    """Whether a row of two or more filled cells holds no date, amount, time or long number, and six tenths of its cells may be labels."""
    full = F.filter(row, lambda c: ~_blank(c))
    data = F.exists(full, lambda c: c.rlike(_DATE) | F.regexp_replace(F.trim(c), "[,¥]", "").rlike(_AMOUNT) | F.trim(c).rlike(r"^\d{2}:\d{2}:\d{2}$|^\d{10,}$"))
    return (F.size(full) >= 2) & ~data & (F.size(F.filter(full, is_header_cell)) >= 0.6 * F.size(full))


def header_index(t: Column) -> Column:
    """The first of five rows that is a header, else 0 if one of the next five holds data, else -1."""
    found = F.filter(F.transform(F.slice(t, 1, 5), lambda row, i: F.when(is_header_row(row), i)), lambda i: i.isNotNull())
    data = F.exists(F.slice(t, 2, 5), is_data_row)
    return F.when(F.size(found) > 0, F.get(found, 0)).when(data, 0).otherwise(-1)


def markdown(t: Column) -> Column:
    """A pipe table as wide as its widest row."""
    n = F.array_max(F.transform(t, F.size))
    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = lambda row: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(row, cell), F.array_repeat(F.lit(""), n - F.size(row))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), n), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(F.get(t, 0)), rule), F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), line)), "\n")


def records(t: Column) -> Column:
    """Rows below the header as arrays of (label, value) pairs; cells beyond the header are dropped."""
    header = F.get(t, 0)
    return F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda row: F.slice(F.arrays_zip(header.alias("label"), row.alias("value")), 1, F.least(F.size(header), F.size(row))))


def checks(t: Column) -> dict[str, Column]:
    """Counts over the rows below the header: all, as wide as the header, equal to the row before, equal to the header, sparse, too narrow."""
    header, below = F.get(t, 0), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))
    fold = lambda row: F.transform(row, lambda c: F.lower(F.trim(c)))
    count = lambda f: F.size(F.filter(below, f))
    narrow = lambda r: F.size(r) < F.greatest(F.lit(1), F.floor(F.size(header) / 2))
    return {
        "rows": F.size(below), "as_wide": count(lambda r: F.size(r) == F.size(header)), "repeated": F.size(F.filter(below, lambda r, i: (i > 0) & (r == F.get(below, i - 1)))), "headers": count(lambda r: fold(r) == fold(header)),
        "narrow": count(narrow), "sparse": count(lambda r: ~narrow(r) & (F.size(F.filter(r, lambda c: ~_blank(c))) < 0.5 * F.size(header))),
    }


def merged_split_rows(t: Column) -> Column:
    """Rows that begin no record are folded into the one before, their cells set under its cells by a line feed: a record begins with a date, an amount or
    a number of up to six digits in its first cell. Rows before the first record stay."""
    n = F.size(F.get(t, 0))
    anchor = lambda row: F.exists(row, lambda c: F.trim(c).rlike(rf"^{_DATE}$") | F.regexp_replace(F.trim(c), "[,¥$]", "").rlike(r"^-?\d+\.\d{2}$")) | F.trim(F.get(row, 0)).rlike(r"^\d{1,6}$")
    pad = lambda row: F.slice(F.concat(row, F.array_repeat(F.lit(""), F.greatest(n - F.size(row), F.lit(0)))), 1, n)
    both = lambda a, b: F.when(_blank(b), a).when(_blank(a), F.trim(b)).otherwise(F.concat(a, F.lit("\n"), F.trim(b)))

    def fold(out: Column, row: Column) -> Column:
        row = pad(row)
        new = F.concat(out, F.array(row))
        last = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.zip_with(F.element_at(out, -1), row, both)))
        return F.when(F.forall(row, _blank), out).when(anchor(row) | (F.size(out) == 1), new).otherwise(last)

    below = F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))
    return F.aggregate(below, F.array(F.get(t, 0)), fold)


def value_class(c: Column) -> Column:
    """empty, number, date, cjk_text, latin_text or symbol."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t == "", "empty").when(F.regexp_replace(t, "[,，]", "").rlike(r"^[+-]?\d+(?:\.\d+)?$"), "number").when(t.rlike(r"\d{4}[-/年]\d{1,2}"), "date").when(t.rlike(r"[\x{4e00}-\x{9fff}]"), "cjk_text").when(t.rlike("[A-Za-z]"), "latin_text").otherwise("symbol")


def inferred_header(df: DataFrame, table: str) -> DataFrame:
    """df with `header` (the row, or -1) and `score`: of the first three rows that look like headers, the one below which columns are of one class each, that
    is filled and whose labels differ; the first on ties."""
    t = F.col(table)
    df = staged(df, {"_classes": F.transform(t, lambda row: F.transform(row, value_class)), "_labels": F.transform(F.slice(t, 1, 3), is_header_row)})
    widths = F.array_max(F.transform("_classes", F.size))

    def modal(col: Column) -> Column:
        return F.array_max(F.transform(F.array_distinct(col), lambda k: F.size(F.filter(col, lambda x: x == k)))) / F.size(col)

    def candidate(i: Column) -> Column:
        below = F.slice("_classes", i + 2, F.greatest(F.size("_classes") - i - 1, F.lit(0)))
        columns = F.transform(F.sequence(F.lit(0), widths - 1), lambda j: F.filter(F.transform(below, lambda r: F.get(r, j)), lambda k: k.isNotNull() & (k != "empty")))
        shares = F.transform(F.filter(columns, lambda c: F.size(c) >= 2), modal)
        row = F.filter(t[i], lambda c: ~_blank(c))
        fill, differ = F.size(row) / F.size(t[i]), F.size(F.array_distinct(row)) / F.greatest(F.size(row), F.lit(1))
        mean = F.when(F.size(shares) > 0, F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) / F.size(shares)).otherwise(0.0)
        return F.named_struct(F.lit("neg"), -F.round(mean * fill * (0.7 + 0.3 * differ), 6), F.lit("i"), i)

    tried = F.filter(F.transform("_labels", lambda ok, i: F.when(ok, candidate(i))), lambda x: x.isNotNull())
    df = staged(df, {"_best": F.array_min(tried)})
    return df.select(*[c for c in df.columns if not c.startswith("_")], F.coalesce("_best.i", F.lit(-1)).alias("header"), F.coalesce(-F.col("_best.neg"), F.lit(0.0)).alias("score"))
