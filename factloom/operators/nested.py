"""Deeply nested JSON records to related flat tables that keep parent-child links.

The payload is parsed once to a VARIANT. Nested `transform` calls attach the ancestors' keys and indices to each element, `flatten`
combines the arrays of one level, and one `inline` per target table emits its rows. A list may be given as an array, as one bare
object, as an object keyed by id, or as JSON inside a string; all give the same rows. Payloads that are null, empty or not complete
JSON give no rows; elements without an id keep their index but give no link. A payload may be wrapped: what stands under `result` (an
object or JSON inside a string, at any depth of wrapping up to WRAPPED) counts where the record itself has neither `mirror` nor `datasets`.
Blocks nest to any depth: the number of levels to unroll follows from one pass over the data, and every SEGMENT levels are written out
before the next, so the plan stays bounded however deep a record is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.common import materialized, staged

#: Envelopes that are opened one inside the other, and levels of blocks unrolled in one plan.
WRAPPED, SEGMENT = 3, 32

_SUBARRAY = "array<struct<k:string,v:variant>>"


def _get(v: str, path: str, kind: str = "string") -> str:
    return f"try_variant_get({v}, '{path}', '{kind}')"


def _opened(v: str) -> str:
    """The variant itself, or what the JSON inside its string holds."""
    return f"CASE WHEN {_get(v, '$', 'array<variant>')} IS NULL AND {_get(v, '$', 'map<string,variant>')} IS NULL THEN try_parse_json({_get(v, '$')}) ELSE {v} END"


def _list(v: str, *marks: str) -> str:
    """Elements (k, v) of a list however it is laid out; `marks` are the fields by which one bare object is known. k is the key of a keyed list."""
    one = " OR ".join(f"{_get(v, '$.' + m)} IS NOT NULL" for m in marks)
    keyed = f"transform(filter(map_entries({_get(v, '$', 'map<string,variant>')}), e -> {_get('e.value', '$', 'map<string,variant>')} IS NOT NULL), e -> named_struct('k', e.key, 'v', e.value))"
    return f"coalesce(CASE WHEN {one} THEN array(named_struct('k', CAST(NULL AS STRING), 'v', {v})) ELSE coalesce(transform({_get(v, '$', 'array<variant>')}, x -> named_struct('k', CAST(NULL AS STRING), 'v', x)), {keyed}) END, array())"


def block_levels(df: DataFrame, payload: str) -> int:
    """An upper bound of the levels of blocks below the first: no more than the word `children` occurs in a payload, nor than its braces nest below
    those of the record, its mirror, a page and a first block."""
    p = F.col(payload)
    named = ((F.length(p) - F.length(F.replace(p, F.lit("children"), F.lit("")))) / len("children")).cast("int")
    braces = F.filter(F.split(F.regexp_replace(p, r"[^{}]", ""), ""), lambda c: c != "")
    step = lambda a, c: F.struct((a["now"] + F.when(c == "{", 1).otherwise(-1)).alias("now"), F.greatest(a["most"], a["now"] + F.when(c == "{", 1).otherwise(-1)).alias("most"))
    nested = F.aggregate(braces, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])
    return df.agg(F.max(F.when(named > 1, F.least(named, F.greatest(nested - 4, F.lit(0)))).otherwise(named)).alias("d")).first()["d"] or 0


def unwrapped(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """(keep, _j): each readable payload as a VARIANT object, out of its envelope if it has one."""
    j = df.select(*keep, F.expr(f"try_parse_json(`{payload}`)").alias("_j"))
    for _ in range(WRAPPED):
        inner = _opened(_get("_j", "$.result", "variant"))
        bare = " AND ".join(f"{_get('_j', '$.' + part, 'variant')} IS NULL" for part in ("mirror", "datasets"))
        j = staged(j, {"_j": F.expr(f"CASE WHEN {bare} AND {_get(inner, '$', 'map<string,variant>')} IS NOT NULL THEN {inner} ELSE _j END")})
    return j.where(F.expr(_get("_j", "$", "map<string,variant>") + " IS NOT NULL"))


def parsed(df: DataFrame, *, key: str = "artifact_id", document: str = "document_id", payload: str = "payload", levels: int | None = None) -> DataFrame:
    """One row per artifact with arrays of elements: pages, blocks, edges, datasets, rows, items; each element carries its ancestors' keys and indices."""
    if levels is None:
        levels = max(1, block_levels(df, payload))
    j = unwrapped(df.select(F.col(key), F.col(document).alias("_doc"), F.col(payload).alias("_payload")), "_payload", key, "_doc")
    j = staged(j, {
        "document_id": F.expr(f"coalesce({_get('_j', '$.mirror.document.document_id')}, _doc)"),
        "_pages": F.expr(_opened(_get("_j", "$.mirror.pages", "variant"))), "_edges": F.expr(_opened(_get("_j", "$.mirror.graph.edges", "variant"))), "_datasets": F.expr(_opened(_get("_j", "$.datasets", "variant"))),
    })
    j = staged(j.drop("_j", "_doc"), {
        "pages": F.expr(f"transform({_list('_pages', 'page_id', 'page_number', 'blocks')}, (p, i) -> named_struct('parent_id', document_id, 'id', coalesce({_get('p.v', '$.page_id')}, p.k), 'idx', i, 'v', p.v))"),
        "edges": F.expr(f"transform({_list('_edges', 'from', 'to')}, (e, i) -> named_struct('edge_id', coalesce({_get('e.v', '$.id')}, e.k), 'edge_type', {_get('e.v', '$.type')}, 'parent_id', {_get('e.v', '$.from')}, 'id', {_get('e.v', '$.to')}, 'idx', i, 'confidence', {_get('e.v', '$.confidence', 'double')}))"),
        "datasets": F.expr(f"transform({_list('_datasets', 'rows', 'columns', 'name')}, (d, i) -> named_struct('parent_id', document_id, 'id', coalesce({_get('d.v', '$.id')}, d.k), 'idx', i, 'v', d.v))"),
    })
    opened = lambda v, path: _opened(_get(v, path, "variant"))
    j = staged(j.drop("_pages", "_edges", "_datasets"), {
        "_level0": F.expr(f"flatten(transform(transform(pages, p -> named_struct('id', p.id, 'idx', p.idx, 'b', {opened('p.v', '$.blocks')})), p -> transform({_list('p.b', 'id', 'type', 'children')}, (b, i) -> named_struct('page_id', p.id, 'page_idx', p.idx, 'parent_id', p.id, 'id', coalesce({_get('b.v', '$.id')}, b.k), 'idx', i, 'level', 0, 'v', b.v))))"),
        "rows": F.expr(f"flatten(transform(transform(datasets, d -> named_struct('id', d.id, 'idx', d.idx, 'r', {opened('d.v', '$.rows')})), d -> transform({_list('d.r', 'record_id', 'raw', 'normalized', 'items')}, (r, i) -> named_struct('dataset_idx', d.idx, 'parent_id', d.id, 'id', coalesce({_get('r.v', '$.record_id')}, r.k), 'idx', i, 'v', r.v))))"),
    })
    j = staged(j, {"items": F.expr(f"flatten(transform(transform(rows, r -> named_struct('id', r.id, 'dataset_idx', r.dataset_idx, 'row_idx', r.idx, 'x', {opened('r.v', '$.items')})), r -> transform({_list('r.x', 'id', 'note')}, (x, i) -> named_struct('dataset_idx', r.dataset_idx, 'row_idx', r.row_idx, 'parent_id', r.id, 'id', coalesce({_get('x.v', '$.id')}, x.k), 'idx', i, 'v', x.v))))")})
    for n in range(1, levels + 1):
        if n % SEGMENT == 0:
            j = materialized(j)
        up = f"_level{n - 1}"
        j = staged(j, {f"_level{n}": F.expr(f"flatten(transform(transform({up}, b -> named_struct('page_id', b.page_id, 'page_idx', b.page_idx, 'id', b.id, 'c', {opened('b.v', '$.children')})), b -> transform({_list('b.c', 'id', 'type', 'children')}, (c, i) -> named_struct('page_id', b.page_id, 'page_idx', b.page_idx, 'parent_id', b.id, 'id', coalesce({_get('c.v', '$.id')}, c.k), 'idx', i, 'level', {n}, 'v', c.v))))")})
    every = F.flatten(F.array(*[F.col(f"_level{n}") for n in range(levels + 1)]))
    return j.select(key, "document_id", "pages", every.alias("blocks"), "edges", "datasets", "rows", "items")


def pages(p: DataFrame, key: str = "artifact_id") -> DataFrame:
    one = F.inline(F.expr(f"transform(pages, p -> named_struct('page_idx', p.idx, 'page_id', p.id, 'page_number', {_get('p.v', '$.page_number', 'int')}, 'width', {_get('p.v', '$.width', 'double')}, 'height', {_get('p.v', '$.height', 'double')}, 'content_mode', {_get('p.v', '$.content_mode')}))"))
    return p.select(key, "document_id", one)


def blocks(p: DataFrame, key: str = "artifact_id") -> DataFrame:
    one = F.inline(F.expr(f"transform(blocks, b -> named_struct('page_id', b.page_id, 'parent_id', b.parent_id, 'level', b.level, 'block_idx', b.idx, 'block_id', b.id, 'block_type', {_get('b.v', '$.type')}, 'text', {_get('b.v', '$.text')}, 'bbox', {_get('b.v', '$.bbox', 'array<double>')}))"))
    return p.select(key, "document_id", one)


def edges(p: DataFrame, key: str = "artifact_id") -> DataFrame:
    one = F.inline(F.expr("transform(edges, e -> named_struct('edge_idx', e.idx, 'edge_id', e.edge_id, 'edge_type', e.edge_type, 'from_id', e.parent_id, 'to_id', e.id, 'confidence', e.confidence))"))
    return p.select(key, "document_id", one)


def datasets(p: DataFrame, key: str = "artifact_id") -> DataFrame:
    one = F.inline(F.expr(f"transform(datasets, d -> named_struct('dataset_idx', d.idx, 'dataset_id', d.id, 'name', {_get('d.v', '$.name')}))"))
    return p.select(key, "document_id", one)


def rows(p: DataFrame, key: str = "artifact_id") -> DataFrame:
    amount = f"coalesce({_get('r.v', '$.normalized.amount.value')}, {_get('r.v', '$.raw.amount.value')}, {_get('r.v', '$.normalized.amount')}, {_get('r.v', '$.raw.amount')})"
    one = F.inline(F.expr(f"transform(rows, r -> named_struct('dataset_idx', r.dataset_idx, 'dataset_id', r.parent_id, 'row_idx', r.idx, 'record_id', r.id, 'label', coalesce({_get('r.v', '$.normalized.label')}, {_get('r.v', '$.raw.label')}), 'amount', {amount}, 'page', {_get('r.v', '$.source.page', 'int')}))"))
    return p.select(key, "document_id", one)


def items(p: DataFrame, key: str = "artifact_id") -> DataFrame:
    one = F.inline(F.expr(f"transform(items, x -> named_struct('dataset_idx', x.dataset_idx, 'row_idx', x.row_idx, 'record_id', x.parent_id, 'item_idx', x.idx, 'item_id', x.id, 'note', {_get('x.v', '$.note')}))"))
    return p.select(key, "document_id", one)


def links(p: DataFrame, key: str = "artifact_id") -> DataFrame:
    """(key, link_kind, parent_id, child_id): every distinct link of the flat tables; links with a missing end are left out."""
    of: Column = lambda name, kind: F.expr(f"transform({name}, x -> named_struct('link_kind', '{kind}', 'parent_id', x.parent_id, 'child_id', x.id))")
    contains = F.expr("transform(filter(edges, e -> e.edge_type = 'contains'), x -> named_struct('link_kind', 'contains', 'parent_id', x.parent_id, 'child_id', x.id))")
    every = F.flatten(F.array(of("pages", "page"), of("blocks", "block"), contains, of("datasets", "dataset"), of("rows", "row"), of("items", "item")))
    return p.select(key, F.inline(every)).where("parent_id IS NOT NULL AND child_id IS NOT NULL").distinct()


# The node fields that two graphs are compared by.
NODE_FIELDS = ("kind", "label", "value_preview", "raw_preview", "confidence", "review", "page", "bbox", "source_refs", "field_path", "edition")


def graph_elements(df: DataFrame, *keys: str, payload: str = "payload") -> DataFrame:
    """(keys, elements): the graph of each readable payload as elements (part, a, b, idx, fields): nodes by id with NODE_FIELDS as text, edges
    by their ends, and the quality decision. Nodes without an id are left out."""
    j = unwrapped(df, payload, *keys)
    j = staged(j, {"_nodes": F.expr(_opened(_get("_j", "$.mirror.graph.nodes", "variant"))), "_edges": F.expr(_opened(_get("_j", "$.mirror.graph.edges", "variant"))), "_decision": F.expr(_get("_j", "$.mirror.graph.quality_decision.decision"))})
    fields = ", ".join(f"CAST({_get('x.v', '$.' + f, 'double')} AS STRING)" if f in ("confidence", "page") else _get("x.v", "$." + f) for f in NODE_FIELDS)
    nodes = f"filter(transform({_list('_nodes', 'id', 'kind')}, (x, i) -> named_struct('part', 'node', 'a', coalesce({_get('x.v', '$.id')}, x.k), 'b', '', 'idx', i, 'fields', array({fields}))), x -> x.a IS NOT NULL)"
    edges = f"transform({_list('_edges', 'from', 'to')}, (x, i) -> named_struct('part', 'edge', 'a', coalesce({_get('x.v', '$.from')}, ''), 'b', coalesce({_get('x.v', '$.to')}, ''), 'idx', i, 'fields', CAST(array() AS array<string>)))"
    decision = "array(named_struct('part', 'quality_decision', 'a', '', 'b', '', 'idx', 0, 'fields', array(_decision)))"
    return j.select(*keys, F.expr(f"concat({nodes}, {edges}, {decision})").alias("elements"))
