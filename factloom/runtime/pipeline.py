"""Stages over frames: registries, pipelines whose changes are audited, fallbacks, profiles.

A stage takes a frame and gives one; it declares what it needs and provides, and the pipeline orders stages by that. Nothing runs until the result is
read: a pipeline only composes plans. What a stage changed is found by a join of its input and output on the key, not by trusting its word."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter
from importlib.metadata import entry_points
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Stage:
    """A named transformation; `needs` and `provides` order stages, `audited` names the columns that it may change."""

    name: str
    run: Transform
    needs: tuple[str, ...] = ()
    provides: tuple[str, ...] = ()
    audited: tuple[str, ...] = ()


class Registry:
    """Things by name, the latest or, with priorities, the highest of a name's candidates; names are unique otherwise."""

    def __init__(self, what: str) -> None:
        self.what, self._held = what, {}

    def register(self, name: str, thing: Any, priority: int = 0, replace: bool = False) -> Any:
        if (name, priority) in self._held and not replace:
            raise ValueError(f"{self.what} {name!r} is registered with priority {priority}")
        self._held[name, priority] = thing
        return thing

    def names(self) -> list[str]:
        return sorted({n for n, _ in self._held})

    def get(self, name: str) -> Any:
        held = [(p, t) for (n, p), t in self._held.items() if n == name]
        if not held:
            raise KeyError(f"no {self.what} {name!r}; there are {', '.join(self.names()) or 'none'}")
        return max(held, key=lambda x: x[0])[1]

    def first(self, fits: Callable[[Any], bool]) -> Any | None:
        """The thing of highest priority that fits, the first registered on ties."""
        return next((t for _, t in sorted(self._held.items(), key=lambda x: -x[0][1]) if fits(t)), None)


class Backend(Protocol):
    """A source of facts: what it can read, and reading it."""

    def fits(self, kind: str) -> bool: ...

    def read(self, df: DataFrame) -> DataFrame: ...


class Projector(Protocol):
    """A projection of sealed facts for one edition, or None if it has none."""

    def project(self, facts: DataFrame) -> DataFrame | None: ...


@dataclass(frozen=True)
class Plugin:
    """What a plugin brings: projectors by edition, for the domains it serves."""

    name: str
    domains: tuple[str, ...]
    projectors: dict[str, Projector] = field(default_factory=dict)


class Plugins:
    """Plugins by domain and edition."""

    def __init__(self) -> None:
        self.held: dict[tuple[str, str], Plugin] = {}

    def add(self, plugin: Plugin) -> None:
        for d in plugin.domains:
            for e in plugin.projectors:
                if (d, e) in self.held:
                    raise ValueError(f"{d}/{e} is served by {self.held[d, e].name}")
                self.held[d, e] = plugin

    def project(self, domain: str, edition: str, facts: DataFrame) -> DataFrame | None:
        plugin = self.held.get((domain, edition)) or self.held.get(("*", edition))
        return plugin.projectors[edition].project(facts) if plugin else None

    def discover(self, group: str = "factloom.plugins") -> list[str]:
        """Adds the plugins that installed packages announce under an entry-point group; their names."""
        found = [e.load() for e in entry_points(group=group)]
        for p in found:
            self.add(p() if callable(p) else p)
        return [e.name for e in entry_points(group=group)]


class Pipeline:
    """Stages in the order of what they need; ties go by the order given."""

    def __init__(self, stages: Iterable[Stage]) -> None:
        stages = list(stages)
        by = {p: s.name for s in stages for p in (*s.provides, s.name)}
        missing = [(s.name, n) for s in stages for n in s.needs if n not in by]
        if missing:
            raise ValueError("; ".join(f"{a} needs {b}, which no stage provides" for a, b in missing))
        order = TopologicalSorter({s.name: {by[n] for n in s.needs} for s in stages})
        place = {s.name: i for i, s in enumerate(stages)}
        order.prepare()
        self.stages: list[Stage] = []
        while order.is_active():
            for name in sorted(order.get_ready(), key=place.get):
                self.stages.append(stages[place[name]])
                order.done(name)

    def run(self, df: DataFrame) -> DataFrame:
        for s in self.stages:
            df = df.transform(s.run)
        return df

    def audited(self, df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """The result, and (stage, key, field, old, new) of every value that a stage changed, added or removed, by a full join on the key."""
        trail = None
        for s in self.stages:
            after = df.transform(s.run)
            shared = [c for c in df.columns if c in after.columns and c != key]
            a = df.select(key, F.lit(True).alias("_a"), *[F.col(c).cast("string").alias(f"a_{c}") for c in shared])
            b = after.select(key, F.lit(True).alias("_b"), *[F.col(c).cast("string").alias(f"b_{c}") for c in shared])
            each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").alias("old"), F.col(f"b_{c}").alias("new")) for c in shared], F.struct(F.lit("_row").alias("field"), F.col("_a").cast("string").alias("old"), F.col("_b").cast("string").alias("new")))
            own = a.join(b, key, "full").select(F.lit(s.name).alias("stage"), key, F.inline(F.filter(each, lambda x: ~x["old"].eqNullSafe(x["new"]))))
            trail = own if trail is None else trail.unionByName(own)
            df = after
        return df, trail

    def unaudited(self, df: DataFrame, key: str) -> DataFrame:
        """(stage, field, n) of changes to columns that their stage doesn't declare: empty if every change is covered."""
        allowed = {s.name: [*s.audited, *([] if "_row" not in s.audited else ["_row"])] for s in self.stages}
        _, trail = self.audited(df, key)
        covered = F.lit(False)
        for name, fields in allowed.items():
            covered = covered | ((F.col("stage") == name) & F.col("field").isin(*fields)) if fields else covered
        return trail.where(~covered).groupBy("stage", "field").agg(F.count("*").alias("n"))


#: Stages of each profile for each content model, by name; a profile is looked up before `*`.
PROFILES: dict[tuple[str, str], tuple[str, ...]] = {
    ("data", "fast"): ("types",), ("data", "*"): ("types", "names", "gates"), ("page", "fast"): ("order",), ("page", "*"): ("order", "scenes", "fidelity", "gates"), ("*", "*"): ("gates",),
}


def resolve(model: str, profile: str, stages: Registry) -> Pipeline:
    """The pipeline of a content model and profile."""
    for at in ((model, profile), (model, "*"), ("*", profile), ("*", "*")):
        if at in PROFILES:
            return Pipeline([stages.get(n) for n in PROFILES[at]])
    raise KeyError(model)


def with_fallback(df: DataFrame, key: str, first: Transform, second: Transform, failed: str) -> DataFrame:
    """The rows that the first transformation read, and by the second those whose `failed` expression holds: each row comes from one of them."""
    a = df.transform(first)
    again = a.where(failed).select(key).distinct()
    return a.where(f"NOT coalesce({failed}, false)").unionByName(df.join(again, key, "left_semi").transform(second), allowMissingColumns=True)
