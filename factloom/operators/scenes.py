"""Classification by evidence: keywords weighted by how few scenes share them, titles and sources, fused with vetoes and a margin to the runner-up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scene:
    name: str
    priority: int
    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()


# The scenes of the engine's documents, by words of four languages; keywords are compared in lower case.
SCENES = (
    Scene("tenancy", 5, ("tenant", "landlord", "tenancy", "rent arrears", "mieter", "vermieter", "locataire", "bailleur", "arrendatario", "deposit")),
    Scene("insurance", 5, ("insurer", "policy", "premium", "versicherung", "assureur", "aseguradora", "indemnity", "consequential losses")),
    Scene("carriage", 4, ("carrier", "cargo", "vessel", "frachtführer", "transporteur", "porteador", "demurrage", "bill of lading")),
    Scene("planning", 4, ("planning authority", "by-law", "boundary", "excavation", "grundstücksgrenze", "bebauungsplan", "permis de construire", "licencia")),
    Scene("insolvency", 3, ("liquidator", "creditor", "bankruptcy", "insolvenzverwalter", "liquidateur", "administrador", "debenture", "levy"), ("divorce",)),
    Scene("employment", 3, ("employer", "dismissal", "procedurally unfair", "arbeitgeber", "kündigung", "licenciement", "despido", "twenty-four month restriction")),
    Scene("contract", 2, ("agreement", "consideration", "assignment", "written consent", "vertrag", "abtretung", "contrat", "cesión", "contractor")),
    Scene("evidence", 1, ("cross-examination", "disclosure", "burden of explanation", "sachverständige", "expert witness", "beweisaufnahme", "certificate"), ("arbitration clause",)),
)


def uniqueness(scenes: tuple[Scene, ...] = SCENES) -> dict[str, float]:
    """One over the number of scenes that a keyword belongs to."""
    words = [w for s in scenes for w in s.include]
    return {w: 1 / words.count(w) for w in words}


def length_factor(word: str) -> int:
    return 3 if len(word) >= 8 else 2 if len(word) >= 5 else 1


def _held(low: Column, word: str) -> Column:
    return low.contains(word)


def score(low: Column, scene: Scene, unique: dict[str, float]) -> Column:
    """Sum of the weights of a scene's keywords that a lower-case text holds."""
    return sum(F.when(_held(low, w), unique[w] * length_factor(w)).otherwise(0.0) for w in scene.include)


def scores(low: Column, scenes: tuple[Scene, ...] = SCENES) -> Column:
    """The score of each scene on a lower-case text, in the order of the scenes; to be staged, since what follows reads it often."""
    unique = uniqueness(scenes)
    return F.array(*[score(low, s, unique) for s in scenes])


def vetoes(low: Column, scenes: tuple[Scene, ...] = SCENES) -> Column:
    """Whether an excluding word rules each scene out."""
    out = []
    for s in scenes:
        ruled = F.lit(False)
        for w in s.exclude:
            ruled = ruled | _held(low, w)
        out.append(ruled)
    return F.array(*out)


def keyword_evidence(scored: Column, ruled_out: Column, scenes: tuple[Scene, ...] = SCENES) -> Column:
    """Array of (scene, weight, veto) from the scores and vetoes of a text: scenes that score a half or more, and those that are ruled out."""
    names = F.array(*[F.lit(s.name) for s in scenes])
    every = F.transform(F.arrays_zip(names.alias("name"), scored.alias("n"), ruled_out.alias("veto")), lambda x: F.struct(x["name"].alias("scene"), F.when(x["n"] >= 0.5, F.least(x["n"] / 10, F.lit(0.95))).otherwise(0.0).alias("weight"), x["veto"].alias("veto")))
    return F.filter(every, lambda x: x["veto"] | (x["weight"] > 0))


def title_evidence(title: Column, scenes: tuple[Scene, ...] = SCENES) -> Column:
    """Array of (scene, weight): scenes of which a keyword stands in the title."""
    return F.array_compact(F.array(*[F.when(title.rlike("(?i)" + "|".join(s.include)), F.struct(F.lit(s.name).alias("scene"), F.lit(0.2).alias("weight"))) for s in scenes]))


def fused(keywords: Column, titles: Column, scenes: tuple[Scene, ...] = SCENES) -> Column:
    """(scene, confidence, ambiguous): the scene with the most evidence that no word rules out; confidence is seven tenths its share against the runner-up
    and three tenths its share of all evidence; ambiguous if the runner-up is within 15 % of it. Without evidence it is generic, ties go by name."""
    vetoed = F.transform(F.filter(keywords, lambda e: e["veto"]), lambda e: e["scene"])
    every = F.concat(F.transform(F.filter(keywords, lambda e: e["weight"] > 0), lambda e: F.struct(e["scene"].alias("scene"), e["weight"].alias("weight"))), titles)
    sums = F.transform(F.array(*[F.lit(s.name) for s in scenes]), lambda n: F.struct((-F.aggregate(F.filter(every, lambda e: (e["scene"] == n) & ~F.array_contains(vetoed, n)), F.lit(0.0), lambda a, e: a + e["weight"])).alias("neg"), n.alias("scene")))
    ranked = F.array_sort(F.filter(sums, lambda x: x["neg"] < 0))
    best, second = F.get(ranked, 0), -F.coalesce(F.get(ranked, 1)["neg"], F.lit(0.0))
    top = -best["neg"]
    count = F.size(F.filter(every, lambda e: e["scene"] == best["scene"]))
    confidence = 0.7 * top / (top + second + 0.001) + 0.3 * count / F.greatest(F.size(every), F.lit(1))
    none = F.struct(F.lit("generic").alias("scene"), F.lit(0.0).alias("confidence"), F.lit(False).alias("ambiguous"))
    return F.when(F.size(ranked) == 0, none).otherwise(F.struct(best["scene"].alias("scene"), confidence.alias("confidence"), ((top - second) / top < 0.15).alias("ambiguous")))


def first_scene(low: Column, scenes: tuple[Scene, ...] = SCENES, least: float = 0.75) -> Column:
    """(scene, keyword): the scene of the longest keyword that a lower-case text holds, scenes with an excluding word left out; unknown below `least`."""
    hits = []
    for s in scenes:
        ruled = F.lit(False)
        for w in s.exclude:
            ruled = ruled | _held(low, w)
        hits += [F.when(_held(low, w) & ~ruled, F.struct(F.lit(-min(0.99, 0.78 + 0.015 * len(w))).alias("c"), F.lit(-len(w)).alias("n"), F.lit(s.name).alias("scene"), F.lit(w).alias("keyword"))) for w in s.include]
    best = F.array_min(F.array_compact(F.array(*hits)))
    return F.when(-best["c"] >= least, F.struct(best["scene"].alias("scene"), best["keyword"].alias("keyword"))).otherwise(F.struct(F.lit("unknown").alias("scene"), F.lit("").alias("keyword")))


def rules_matched(low: Column, scenes: tuple[Scene, ...] = SCENES) -> Column:
    """Array of (scene, count) on a lower-case text, rules of higher priority first, then those with more keywords, then by name."""
    count = lambda s: sum(_held(low, w).cast("int") for w in s.include)
    every = F.array(*[F.struct(F.lit(-s.priority).alias("p"), (-count(s)).alias("c"), F.lit(s.name).alias("scene")) for s in scenes])
    return F.transform(F.array_sort(F.filter(every, lambda h: h["c"] < 0)), lambda h: F.struct(h["scene"].alias("scene"), (-h["c"]).alias("count")))
