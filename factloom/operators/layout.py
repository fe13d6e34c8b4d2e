"""Geometry of pages: columns and rows out of boxes, gaps and valleys, order of reading, bridges between pages.

Boxes are arrays [x0, y0, x1, y1]. What concerns one page is computed on arrays within the page's row, so that it costs one shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_median(values: Column) -> Column:
    """The middle value of an array, the upper one of two."""
    return F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1)


def column_bounds(xs: Column, times: float = 2.0) -> Column:
    """Array of (column_no, starts, ends) from sorted distinct left edges: a column begins where the gap is over `times` the upper median gap; a single
    edge gives one of 100 points, the last ends 10 points after the last edge. Empty arrays give none."""
    n = F.size(xs)
    gaps = F.transform(F.slice(xs, 2, F.greatest(n - 1, F.lit(0))), lambda x, i: x - xs[i])
    starts = F.filter(xs, lambda x, i: (i == 0) | (gaps[i - 1] > times * upper_median(gaps)))
    last = F.element_at(xs, -1) + 10
    of = lambda no, a, b: F.named_struct(F.lit("column_no"), no, F.lit("starts"), a, F.lit("ends"), b)
    several = F.transform(starts, lambda x, i: of(i + 1, x, F.coalesce(F.get(starts, i + 1), last)))
    return F.when(n == 1, F.array(of(F.lit(1), F.get(xs, 0), F.get(xs, 0) + 100))).when(n > 1, several)


def rows_of(items: Column, top: str, tolerance: float = 8.0) -> Column:
    """The items of a page, an array of structs sorted by `top`, with `row_no` and `row_y`: a new row begins where an item lies more than `tolerance`
    below the first of the row. Items keep their order."""

    def step(a: Column, x: Column) -> Column:
        new = (F.size(a["out"]) == 0) | (F.abs(x[top] - a["y"]) > tolerance)
        y, no = F.when(new, x[top]).otherwise(a["y"]), a["no"] + new.cast("int")
        return F.struct(y.alias("y"), no.alias("no"), F.concat(a["out"], F.array(F.struct(no.alias("row_no"), y.alias("row_y"), x.alias("item")))).alias("out"))

    # the type of the empty result is that of a result of one
    one = F.array(F.struct(F.lit(0).alias("row_no"), F.lit(0.0).alias("row_y"), F.get(items, 0).alias("item")))
    start = F.struct(F.lit(0.0).alias("y"), F.lit(0).alias("no"), F.slice(one, 1, 0).alias("out"))
    return F.aggregate(items, start, step, lambda a: a["out"])


def column_of(centre: Column, bounds: Column) -> Column:
    """The number of the column a centre lies in, else of the one whose middle is nearest, the first of two."""
    inside = F.filter(bounds, lambda b: (b["starts"] <= centre) & (centre < b["ends"]))
    far = lambda b: F.named_struct(F.lit("d"), F.abs(centre - (b["starts"] + b["ends"]) / 2), F.lit("n"), b["column_no"])
    return F.coalesce(F.get(inside, 0)["column_no"], F.array_min(F.transform(bounds, far))["n"])


def covered(spans: Column, width: int) -> Column:
    """How many spans (x0, x1) cover each whole point from 0 to width - 1, ends included."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.size(F.filter(spans, lambda s: (F.greatest(F.lit(0), s["x0"].cast("int")) <= x) & (x <= F.least(F.lit(width - 1), s["x1"].cast("int"))))))


def valleys(signal: Column, ratio: float = 0.1, least: int = 2) -> Column:
    """Array of (starts, width) of the runs of a signal, `least` wide or wider, in which it is at most `ratio` of its peak. None where the peak is 0.
    The signal is read once, a run being closed by the first value above the line, one of which is put behind the end."""
    line = ratio * F.array_max(signal)
    run = lambda a, i: F.named_struct(F.lit("starts"), a, F.lit("width"), i - a)

    def step(a: Column, v: Column) -> Column:
        low, inside, i = v <= line, a["from"] >= 0, a["i"]
        closed = inside & ~low & (i - a["from"] >= least)
        return F.named_struct(F.lit("i"), i + 1, F.lit("from"), F.when(low, F.when(inside, a["from"]).otherwise(i)).otherwise(F.lit(-1)), F.lit("runs"), F.when(closed, F.concat(a["runs"], F.array(run(a["from"], i)))).otherwise(a["runs"]))

    start = F.named_struct(F.lit("i"), F.lit(0), F.lit("from"), F.lit(-1), F.lit("runs"), F.slice(F.array(run(F.lit(0), F.lit(0))), 1, 0))
    behind = F.concat(signal, F.array(F.array_max(signal) + 1))
    return F.when(F.array_max(signal) > 0, F.aggregate(behind, start, step, lambda a: a["runs"]))


def edges(x0: Column, x1: Column, width: int) -> Column:
    """Array of (x, d): at which whole points from 0 to `width` - 1 a span begins to cover, ends included, and ceases to, with the change in how many
    cover. What ceases at `width` or later is left to the end; a span that covers none changes nothing, at 0."""
    a, b = F.least(F.lit(float(width)), F.greatest(F.lit(0.0), x0)).cast("int"), F.greatest(F.lit(-1.0), F.least(F.lit(width - 1.0), x1)).cast("int") + 1
    mark = lambda x, d: F.named_struct(F.lit("x"), F.when(a < b, x).otherwise(0), F.lit("d"), F.when(a < b, d).otherwise(0))
    return F.filter(F.array(mark(a, 1), mark(b, -1)), lambda e: e["x"] < width)


def levels(changes: Column) -> Column:
    """Array of (x, v) from changes (x, d) sorted by x: from x on v spans cover, up to the next x. None cover before the first."""
    level = lambda x, v: F.named_struct(F.lit("x"), x, F.lit("v"), v)
    return F.aggregate(changes, F.array(level(F.lit(0), F.lit(0).cast("bigint"))), lambda a, e: F.concat(a, F.array(level(e["x"], F.element_at(a, -1)["v"] + e["d"]))))


def low_runs(steps: Column, line: Column, width: int, least: int = 2) -> Column:
    """Array of (starts, width) of the runs, `least` wide or wider, in which `levels` are at most `line`; the last level reaches to `width`."""
    low = lambda i: F.get(steps, i)["v"] <= line
    starts = F.filter(steps, lambda s, i: (s["v"] <= line) & ((i == 0) | ~low(i - 1)))
    ends = F.filter(steps, lambda s, i: (s["v"] > line) & low(i - 1))
    run = lambda s, e: F.named_struct(F.lit("starts"), s["x"], F.lit("width"), e - s["x"])
    return F.filter(F.zip_with(starts, F.concat(F.transform(ends, lambda e: e["x"]), F.array(F.lit(width))), run), lambda r: r["width"] >= least)


def contains(outer: Column, inner: Column, tolerance: float = 1.0) -> Column:
    """Whether a box holds another, give or take `tolerance` points."""
    return (outer[0] - tolerance <= inner[0]) & (outer[1] - tolerance <= inner[1]) & (outer[2] + tolerance >= inner[2]) & (outer[3] + tolerance >= inner[3])


def inverse(m: list[list[Column]]) -> list[list[Column]]:
    """The inverse of a matrix of three by three by its adjugate; null if it has none."""
    minor = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    det = sum(m[0][j] * minor(0, j) for j in range(3))
    return [[F.when(F.abs(det) > 1e-12, minor(j, i) / det) for j in range(3)] for i in range(3)]


def horizontal_overlap(a: Column, b: Column) -> Column:
    """Shared width of two boxes over the width of the narrower; 0 if they share none."""
    shared, narrow = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[2] - a[0], b[2] - b[0])
    return F.when((shared > 0) & (narrow > 0), shared / narrow).otherwise(0.0)


def goes_on(a: Column, b: Column) -> Column:
    """How far a text looks like being continued by another: no end of a sentence, a small letter to begin with, no capital, number or bracket."""
    end = ~F.substring(a, -1, 1).isin(*".。!！?？:：;；")
    score = F.when(end, 0.4).otherwise(0.0) + F.when(b.rlike(r"^\p{Ll}"), 0.3).otherwise(0.0) + F.when(~b.rlike(r"^\p{Lu}") & ~b.rlike(r"^[0-9（(【\[]"), 0.2).otherwise(0.0)
    return F.when((a != "") & (b != ""), score).otherwise(0.0)
