"""Tables, pages, ledgers, gates, scenes, dictionaries: literal cases, brute force, edge cases."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import gates, layout, ledgers, lexicon, rendering, scenes, tables


def _of(spark, t, f):
    return spark.createDataFrame([(t,)], "t array<array<string>>").select(f(F.col("t")).alias("x")).first()["x"]


def test_tables(spark):
    t = [["no", "name", "amount", "", ""], ["1", "a b", "RMB 352.10", "", "x"], ["12 34", "合 同", "110.9731080243CNY", ""], ["2", "y___tot", "3", "", "p", "q"]]
    assert _of(spark, t, tables.aligned) == [t[0], t[1], [*t[2], ""], ["2", "y___tot", "3", "", "p q"]]
    assert _of(spark, t, tables.split_joined_cells)[2] == ["12 34", "合 同", "110.97", "31080243CNY", ""]
    fixed = tables.fixed_tables(spark.createDataFrame([(t,)], "t array<array<string>>"), "t").first()["t"]
    assert fixed == [["no", "name", "amount", "", ""], ["1", "a b", "352.10", "", "x"], ["1234", "合同", "110.97", "31080243CNY", ""], ["2", "y", "3", "", "p q"]]
    assert _of(spark, [["a", "", "a"], ["1", "", ""], ["2", " ", None]], tables.without_empty_columns) == [["a"], ["1"], ["2"]]
    assert _of(spark, [["a", "b", ""], ["1", "", ""]], tables.without_trailing_columns) == [["a", "b"], ["1", ""]]
    assert _of(spark, [["d", "t"], ["2024-01-02", "x"], ["", "y"], ["", ""], ["2024-01-03", "z"]], tables.merged_split_rows) == [["d", "t"], ["2024-01-02", "x\ny"], ["2024-01-03", "z"]]
    assert _of(spark, [["a|b"], ["1", "2\n3"]], tables.markdown) == "| a\\|b |  |\n| --- | --- |\n| 1 | 2 3 |"
    assert [tuple(p) for p in _of(spark, [["k", "v"], ["1", "2", "3"], ["4"]], tables.records)[1]] == [("k", "4")]
    assert _of(spark, [["x"], ["Date", "Name"], ["2024-01-02", "9.50"]], tables.header_index) == 1 and _of(spark, [["1.00", "2"], ["2024-01-02", "y"]], tables.header_index) == 0 and _of(spark, [["x"]], tables.header_index) == -1
    for f in (tables.aligned, tables.cleaned, tables.without_underlines, tables.without_trailing_columns, tables.without_digit_blanks, tables.without_currency, tables.without_empty_columns, tables.split_joined_cells):
        assert _of(spark, None, f) is None, f


def test_columns_rows_valleys(spark):
    one = lambda c, **v: spark.range(1).select(*[F.array(*[F.lit(float(y)) for y in x]).alias(n) for n, x in v.items()]).select(c.alias("x")).first()["x"]
    assert [tuple(b) for b in one(layout.column_bounds(F.col("a")), a=[10, 12, 14, 60, 62])] == [(1, 10.0, 60.0), (2, 60.0, 72.0)]
    assert [tuple(b) for b in one(layout.column_bounds(F.col("a")), a=[5])] == [(1, 5.0, 105.0)]
    signal = [0, 0, 5, 10, 1, 0, 1, 9, 0]
    assert [tuple(v) for v in one(layout.valleys(F.col("a")), a=signal)] == [(0, 2), (4, 3)] and one(layout.valleys(F.col("a")), a=[0, 0]) is None
    items = F.array(*[F.struct(F.lit(float(y)).alias("y"), F.lit(i).alias("i")) for i, y in enumerate([0, 7, 9, 16, 17, 30])])
    rows = spark.range(1).select(layout.rows_of(items, "y").alias("r")).first()["r"]
    assert [(r["row_no"], r["row_y"]) for r in rows] == [(1, 0.0), (1, 0.0), (2, 9.0), (2, 9.0), (2, 9.0), (3, 30.0)]
    m = [[2.0, 1.0, 3.0], [0.0, 4.0, 5.0], [1.0, 0.0, 6.0]]
    inv = spark.range(1).select(*[c.alias(f"c{i}{j}") for i, row in enumerate(layout.inverse([[F.lit(x) for x in r] for r in m])) for j, c in enumerate(row)]).first()
    inv = [[inv[3 * i + j] for j in range(3)] for i in range(3)]
    assert all(sum(m[i][k] * inv[k][j] for k in range(3)) == pytest.approx(float(i == j)) for i in range(3) for j in range(3))


LEDGER = "Account head\nDebit 2 30.00 Credit 1 1,000.00 Rows 3\n1 2024-01-01 09:00:00 fee\npaid 20.00 80.00\n2 2024-01-02 09:00:00 salary 1,000.00 1,080.00\n\n3 2024-01-03 10:00:00\ncard 12\nshop 10.00 1,070.00\nfooter"


def test_statement_in_text(spark):
    df = spark.createDataFrame([(1, LEDGER), (2, None), (3, ""), (4, "no rows")], "id int, t string")
    rows = ledgers.rows_of_text(df, "id", "t").orderBy("row_no")
    assert [(r["row_no"], r["time"], r["summary"], r["amount"], r["balance"]) for r in rows.collect()][:2] == [(1, "09:00:00", "fee paid", 20.0, 80.0), (2, "09:00:00", "salary", 1000.0, 1080.0)] and [r["amount"] for r in rows.collect()] == [20.0, 1000.0, 10.0]
    directed = ledgers.directed(rows, ["id"], "row_no", "amount", "balance")
    assert [r["direction"] for r in directed.orderBy("row_no").collect()] == ["income", "income", "expense"]
    heads = df.select("id", ledgers.head_totals(F.col("t")).alias("head"))
    assert [tuple(r) for r in ledgers.reconciled(directed, heads, "id").collect()] == [(1, True, True, True, True, "expense")]


def test_gates(spark):
    df = spark.createDataFrame([("a", "5"), ("b", "x"), (None, None)], "s string, n string")
    cases = [({"equals": "a"}, "s", [True, False, False]), ({"equals": None}, "s", [False, False, True]), ({"in": ["a", "b"]}, "s", [True, True, False]), ({"min": 5}, "n", [True, False, False]), ({"max": 4}, "n", [False, False, False]), ({"max_issues": 0}, "n", [False, True, True]), ({"contains": "a"}, "s", [True, False, False]), ({}, "s", [True] * 3)]
    for spec, c, want in cases:
        assert [r[0] for r in df.select(gates.passed(F.col(c), spec)).collect()] == want, spec
    observed = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "metric string, value double")
    got = {r["metric"]: r["status"] for r in gates.against_targets(spark, observed, {"a": (0.4, "min"), "b": (0.4, "max"), "c": (1.0, "min")}).collect()}
    assert got == {"a": "pass", "b": "fail", "c": "not_measured"}


def test_scenes(spark):
    texts = ["The tenant and the landlord signed the tenancy.", "The liquidator of the debenture; divorce followed.", "", "policy and cargo", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["f"] for r in df.withColumn("low", F.lower("t")).select("i", scenes.keyword_evidence(scenes.scores(F.col("low")), scenes.vetoes(F.col("low"))).alias("k"), scenes.title_evidence(F.coalesce("t", F.lit(""))).alias("h")).select("i", scenes.fused(F.col("k"), F.col("h")).alias("f")).orderBy("i").collect()]
    assert got[0]["scene"] == "tenancy" and got[0]["confidence"] > 0.9 and got[1]["scene"] == "generic" and got[2]["scene"] == "generic" and got[3]["ambiguous"]


def test_dictionary_against_brute_force(spark):
    r = random.Random(5)
    words = ["ab", "aba", "bab", "c", "cab"]
    texts = ["".join(r.choice("abc") for _ in range(60)) for _ in range(20)] + ["", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("word", F.lit("clash"))
    want = {(i, w, p) for i, t in enumerate(texts) if t for w in words for p in range(len(t)) if t.startswith(w, p)}
    assert {tuple(x) for x in lexicon.hits(df, "i", "t", words).collect()} == want
    for i, t in enumerate(texts[:5]):
        got = sorted((p, w) for k, w, p in map(tuple, lexicon.hits(df, "i", "t", words, True).collect()) if k == i)
        at, own = 0, []
        while at < len(t):
            w = max((w for w in words if t.startswith(w, at)), key=len, default=None)
            own += [(at, w)] if w else []
            at += len(w) if w else 1
        assert got == own


def test_weighted_distance():
    assert [lexicon.weighted_distance(a, b) for a, b in (("abc", "abc"), ("c0urt", "court"), ("cuort", "court"), ("cort", "court"), ("", "ab"))] == [0.0, 0.2, 0.75, 1.0, 2.0]

    def plain(a, b):
        return min((plain(a[1:], b) + 1 if a else 9), (plain(a, b[1:]) + 1 if b else 9), (plain(a[1:], b[1:]) + (a[0] != b[0]) if a and b else 9), (plain(a[2:], b[2:]) + 0.75 if len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0] else 9)) if a or b else 0

    for a, b in itertools.product(["xyz", "xzy", "zx", ""], ["xyz", "yx", "x"]):
        assert lexicon.weighted_distance(a, b) == plain(a, b)
    assert lexicon.unique_term("c0urt", ["court", "chart"]) == ("court", 0.2) and lexicon.unique_term("coxrt", ["court", "coart"]) is None and lexicon.unique_term("court", ["court"]) is None


def test_similar_labels(spark):
    assert lexicon.first_labels(["account no", "account no.", "address", "adress"]) == [("account no", "account no"), ("account no.", "account no"), ("address", "address"), ("adress", "address")]
    rows = [(1, "account no", "7"), (1, "account no.", "7"), (1, "other", "7"), (1, "alone", "8"), (2, "account no", "7"), (2, "x", None), (2, "y", " ")]
    df = spark.createDataFrame(rows, "r int, f string, v string").withColumn("kept", F.lit("clash"))
    got = {tuple(x) for x in lexicon.similar_labels(df, ["r"], "f", "v").collect()}
    assert got == {(1, "7", "account no", "account no"), (1, "7", "account no.", "account no"), (1, "7", "other", "other")}
    assert lexicon.similar_labels(df.limit(0), ["r"], "f", "v").count() == 0


def test_inferred_header(spark):
    t = [["Report of", "the year", ""], ["Date", "Name", "Sum"], ["2024-01-02", "Ann", "9.50"], ["2024-01-03", "Bob", "8"]]
    df = spark.createDataFrame([(1, t), (2, [["1.00", "2"], ["3", "4"]])], "i int, t array<array<string>>")
    got = {r["i"]: (r["header"], r["score"]) for r in tables.inferred_header(df, "t").collect()}
    assert got[1][0] == 1 and got[1][1] == 1.0 and got[2] == (-1, 0.0)


def test_markdown(spark):
    df = spark.createDataFrame([("# a\n- b\n12) c *d* | <e> ![i](u)\t.\n\n\n\nf",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(rendering.escaped(F.col("t"))).collect()]
    assert got == ["\\# a\n\\- b\n12\\) c \\*d\\* \\| &lt;e&gt;     .\n\nf", "", None]
    assert [r[0] for r in spark.createDataFrame([("![a](b) <script>",), ("<table><br/></table> a < b",)], "t string").select(F.array_join(rendering.markdown_issues(F.col("t")), ",")).collect()] == ["markdown_image_not_allowed,raw_html_not_allowed", ""]
    text = "one\ntwo three\n" * 40
    parts = rendering.cut_after_lines(text, 50, 10)
    assert all(len(p) <= 50 for p in parts) and parts[0].endswith("three\none") and rendering.cut_after_lines("short", 50, 10) == ["short"]
    assert len(rendering.cut_after_lines("x" * 500, 50, 0)) == 10
