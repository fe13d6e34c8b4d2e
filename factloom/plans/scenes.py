"""Queries that classify documents by evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.io import table
from factloom.operators import scenes
from factloom.operators.common import staged
from factloom.plans.base import Book

query = Book()
_K = ", ".join(f"('{s.name}', {s.priority}, '{w}', {3 if len(w) >= 8 else 2 if len(w) >= 5 else 1})" for s in scenes.SCENES for w in s.include)
_X = "('insolvency', 'divorce'), ('evidence', 'arbitration clause')"
_TITLE = "lower(regexp_extract(trim(text, chr(10) || ' '), '^([^\\n]*)', 1))"
_BASE = f"""k(scene, priority, word, factor) AS (VALUES {_K}), x(scene, word) AS (VALUES {_X}), u AS (SELECT word, 1.0 / count(*) AS u FROM k GROUP BY 1), d AS (SELECT doc_id, lower(text) AS low, {_TITLE} AS title FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, scene, priority, word, factor * u AS w, factor FROM d JOIN k ON contains(low, word) JOIN u USING (word)), veto AS (SELECT DISTINCT doc_id, scene FROM d JOIN x ON contains(low, word)),
e AS (SELECT doc_id, scene, least(sum(w) / 10, 0.95) AS weight FROM h GROUP BY 1, 2 HAVING sum(w) >= 0.5 UNION ALL SELECT DISTINCT doc_id, scene, 0.2 FROM d JOIN k ON contains(title, word))"""


def _docs(spark, d):
    return staged(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text"), {"low": F.lower("text")})


@query(f"""WITH {_BASE}, n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY 1), s AS (SELECT e.doc_id, e.scene, sum(weight) AS s, count(*) AS c FROM e ANTI JOIN veto USING (doc_id, scene) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, scene) AS r, lead(s) OVER (PARTITION BY doc_id ORDER BY s DESC, scene) AS second FROM s)
SELECT d.doc_id, coalesce(scene, 'generic') AS scene, round(coalesce(0.7 * s / (s + coalesce(second, 0) + 0.001) + 0.3 * c / n, 0), 6) AS confidence, coalesce((s - coalesce(second, 0)) / s < 0.15, false) AS ambiguous FROM d LEFT JOIN (SELECT * FROM r JOIN n USING (doc_id) WHERE r = 1) q ON q.doc_id = d.doc_id""")
def document_scenes(spark, d):
    """The scene of each document from keywords and title, with its confidence and whether the runner-up is close."""
    title = F.regexp_extract(F.trim(F.regexp_replace("text", r"^[\n ]+", "")), r"^([^\n]*)", 1)
    df = staged(_docs(spark, d), {"n": scenes.scores(F.col("low")), "v": scenes.vetoes(F.col("low")), "title": title}).select("doc_id", "n", "v", "title")
    df = staged(df, {"k": scenes.keyword_evidence(F.col("n"), F.col("v")), "t": scenes.title_evidence(F.col("title"))})
    df = staged(df, {"f": scenes.fused(F.col("k"), F.col("t"))})
    return df.select("doc_id", "f.scene", F.round("f.confidence", 6).alias("confidence"), "f.ambiguous")


@query(f"WITH {_BASE}, b AS (SELECT doc_id, scene, word, row_number() OVER (PARTITION BY doc_id ORDER BY least(0.99, 0.78 + 0.015 * length(word)) DESC, length(word) DESC, scene, word) AS r FROM h ANTI JOIN veto USING (doc_id, scene)) SELECT d.doc_id, coalesce(scene, 'unknown') AS scene, coalesce(word, '') AS keyword FROM d LEFT JOIN (SELECT * FROM b WHERE r = 1) q ON q.doc_id = d.doc_id")
def first_scenes(spark, d):
    """The scene of the longest keyword in each document."""
    return _docs(spark, d).select("doc_id", scenes.first_scene(F.col("low")).alias("s")).select("doc_id", "s.scene", "s.keyword")


@query(f"WITH {_BASE}, m AS (SELECT doc_id, scene, max(priority) AS p, count(*) AS c FROM h GROUP BY 1, 2) SELECT doc_id, scene, c::INTEGER AS count, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, c DESC, scene) AS rank FROM m")
def rule_matches(spark, d):
    """Every rule that a document matches, by priority and number of its keywords."""
    df = staged(_docs(spark, d), {"r": scenes.rules_matched(F.col("low"))})
    return df.select("doc_id", F.posexplode("r").alias("pos", "m")).select("doc_id", "m.scene", "m.count", (F.col("pos") + 1).cast("bigint").alias("rank"))


@query(f"WITH {_BASE} SELECT k.word, any_value(u.u)::DOUBLE AS uniqueness, count(DISTINCT h.doc_id) AS docs FROM k JOIN u USING (word) LEFT JOIN h ON h.word = k.word GROUP BY 1")
def keyword_uniqueness(spark, d):
    """How distinctive each keyword is among the scenes, and in how many documents it stands, counted in one pass over them."""
    unique = scenes.uniqueness()
    low = F.col("low")
    counts = _docs(spark, d).agg(*[F.count_if(low.contains(w)).alias(f"c{i}") for i, w in enumerate(unique)])
    one = F.inline(F.array(*[F.struct(F.lit(w).alias("word"), F.lit(u).alias("uniqueness"), F.col(f"c{i}").alias("docs")) for i, (w, u) in enumerate(unique.items())]))
    return counts.select(one)


@query(f"WITH {_BASE}, s AS (SELECT doc_id, count(DISTINCT scene) AS n, sum(w) AS w FROM h GROUP BY 1) SELECT CASE WHEN w IS NULL THEN 'manual' WHEN n = 1 THEN 'direct' WHEN w >= 10 THEN 'rich' ELSE 'mixed' END AS route, count(*) AS docs FROM d LEFT JOIN s USING (doc_id) GROUP BY 1")
def document_routes(spark, d):
    """How documents are routed: by hand without evidence, directly with one scene, else by the weight of their evidence."""
    unique, low = scenes.uniqueness(), F.col("low")
    per = {s.name: scenes.score(low, s, unique) for s in scenes.SCENES}
    df = staged(_docs(spark, d), {n: c for n, c in per.items()})
    n, w = sum((F.col(s) > 0).cast("int") for s in per), sum(F.col(s) for s in per)
    return df.groupBy(F.when(n == 0, "manual").when(n == 1, "direct").when(w >= 10, "rich").otherwise("mixed").alias("route")).agg(F.count("*").alias("docs"))


QUERIES, ORACLES = query.queries, query.oracles
