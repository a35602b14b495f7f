"""Conditions, operators and meta data of plan nodes as sparse vectors, by fixed dictionaries.

A condition item's vector is: Boolean operator, columns, comparison operator, value. Vectors hold little
but zeros, so nodes carry (item, index, value) cells; dense() gives the arrays that a model takes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

#: Operators in the order of their places.
PHYSICAL = ("Sort", "Hash", "Hash Join", "Merge Join", "Nested Loop", "Aggregate", "Seq Scan", "Index Scan", "Index Only Scan", "Bitmap Heap Scan", "Bitmap Index Scan", "Materialize", "Gather", "Gather Merge", "Limit")
COMPARE = ("=", ">", "<", "!=", "~~", "!~~", "!Null", ">=", "<=")
BOOLEAN = ("AND", "OR")
HASHED = 500
CELLS = "array<struct<item: int, idx: int, value: double>>"


@dataclass(frozen=True)
class Context:
    """Dictionaries in order of declaration, bounds of numeric columns by their full names, and the sizes and label bounds of a corpus.

    columns: full names (table.column); those without bounds hold strings. prefixes: what is put before a column's strings.
    """

    tables: tuple[str, ...]
    columns: tuple[str, ...]
    indexes: tuple[str, ...]
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    vectors: dict[str, list[float]] = field(default_factory=dict)
    prefixes: dict[str, str] = field(default_factory=dict)
    most_nodes: int = 1
    most_items: int = 1
    cost: tuple[float, float] = (0.0, 1.0)
    cardinality: tuple[float, float] = (0.0, 1.0)

    @property
    def embedded(self) -> int:
        return len(next(iter(self.vectors.values()), [])) or HASHED

    @property
    def width(self) -> int:
        """Of a condition item's vector."""
        return len(BOOLEAN) + len(self.columns) + len(COMPARE) + self.embedded + HASHED

    @property
    def info_width(self) -> int:
        return max(len(self.columns), len(self.tables), len(self.indexes))


def fitted(context: Context, bounds) -> Context:
    """The context with the sizes and label bounds of json_plans.bounds()' row."""
    own = {"most_nodes": bounds.max_nodes, "most_items": max(bounds.max_condition, 1), "cost": (bounds.min_cost, bounds.max_cost), "cardinality": (bounds.min_cardinality, bounds.max_cardinality)}
    return Context(**{**context.__dict__, **own})


def text_vector(ctx: Context, text: str, column: str) -> dict[int, float]:
    """The mean over the parts between % of a word's vector, if there is one, and of marks at the hashes of its characters."""
    parts = [ctx.prefixes.get(column, "") + p for p in text.split("%") if p]
    out: dict[int, float] = {}
    for p in parts:
        own = {i: float(v) for i, v in enumerate(ctx.vectors.get(p, ())) if v}
        own.update({ctx.embedded + xxhash.xxh64_intdigest(c) % HASHED: 1.0 for c in p})
        for i, v in own.items():
            out[i] = out.get(i, 0.0) + v / len(parts)
    return out


def number(ctx: Context, column: str, value: float) -> float:
    """The value scaled to the column's bounds; 0 where these are one value."""
    low, high = ctx.bounds[column]
    return (value - low) / (high - low) if high > low else 0.0


def item_cells(ctx: Context, item: dict | None, relation: str | None) -> dict[int, float]:
    """Index and value of a condition item's vector; a null item, which ends a subtree, has none."""
    if item is None:
        return {}
    if item["op_type"] == "Bool":
        return {BOOLEAN.index(item["operator"]): 1.0} if item["operator"] in BOOLEAN else {}
    place = {c: len(BOOLEAN) + i for i, c in enumerate(ctx.columns)}
    full = lambda n: n if "." in n or relation is None else f"{relation}.{n}"
    column, op, right = full(item["left_value"]), item["operator"], item["right_value"]
    if column not in place:
        raise ValueError(f"unknown column {column}")
    compare, values = len(BOOLEAN) + len(ctx.columns), len(BOOLEAN) + len(ctx.columns) + len(COMPARE)
    mark = lambda name: {place[column]: 1.0, compare + COMPARE.index(name): 1.0}
    if isinstance(right, str) and full(right) in place and op in COMPARE and "." in right:
        return {**mark(op), place[right]: 1.0}
    if right is None:
        return {**mark("!Null"), **({values: 1.0} if op == "=" else {})}
    if column in ctx.bounds:
        texts = right if isinstance(right, list) else [right]
        v = float(np.mean([number(ctx, column, float(x)) for x in texts]))
        return {**mark("=" if op == "any" else op), **({values: v} if v else {})}
    if op == "any":
        out: dict[int, float] = {}
        for text in right:
            for i, v in text_vector(ctx, text, column).items():
                out[values + i] = out.get(values + i, 0.0) + v / len(right)
        return {**mark("="), **out}
    name = {"like": "~~", "not_like": "!~~"}.get(op, op)
    return {**mark(name), **{values + i: v for i, v in text_vector(ctx, str(right), column).items()}}


def cells(ctx: Context, condition: str | None, relation: str | None) -> list[tuple[int, int, float]]:
    """(item, idx, value) of a condition's items, from 0."""
    return [(k, i, v) for k, item in enumerate(json.loads(condition)) for i, v in sorted(item_cells(ctx, item, relation).items())] if condition else []


def info(ctx: Context, kind: str, relation: str | None, index: str | None, keys: list[str]) -> list[int]:
    """Places, from 1, of what a node refers to: columns of sorts and aggregates, else the table, else the index."""
    if kind in ("Sort", "Aggregate"):
        return sorted(ctx.columns.index(k) + 1 for k in keys if k in ctx.columns)
    if relation in ctx.tables:
        return [ctx.tables.index(relation) + 1]
    return [ctx.indexes.index(index) + 1] if index in ctx.indexes else []


def encoded(n: DataFrame, ctx: Context) -> DataFrame:
    """json_plans.nodes() with operator (1-based place, 0 if unknown), info (places), condition1, condition2 (cells) and masked.

    A join's condition and a scan's filter are condition1, a scan's index condition is condition2; masked tells the scans, whose samples count.
    """
    shared = n.sparkSession.sparkContext.broadcast(ctx)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for p in parts:
            rows = []
            for r in p.itertuples(index=False):
                scan = r.node_type in ("Seq Scan", "Index Scan")
                first = cells(c, r.condition_filter, r.relation) if scan else cells(c, r.condition, None)
                second = cells(c, r.condition_index, r.relation) if scan else []
                as_rows = lambda x: [{"item": k, "idx": i, "value": v} for k, i, v in x]
                rows.append((r.plan_id, r.pos, PHYSICAL.index(r.node_type) + 1 if r.node_type in PHYSICAL else 0, info(c, r.node_type, r.relation, r.index_name, list(r.keys if r.keys is not None else [])), as_rows(first), as_rows(second), scan))
            yield pd.DataFrame(rows, columns=["plan_id", "pos", "operator", "info", "condition1", "condition2", "masked"])

    out = n.mapInPandas(run, f"plan_id bigint, pos int, operator int, info array<int>, condition1 {CELLS}, condition2 {CELLS}, masked boolean")
    return n.select("plan_id", "pos", "depth", "parent").join(out, ["plan_id", "pos"])


def dense(some: list, items: int, width: int) -> np.ndarray:
    """The matrix of a node's cells: items by width; a condition of more items than that is an error."""
    out = np.zeros((items, width), dtype=np.float32)
    for c in some:
        out[c["item"], c["idx"]] = c["value"]
    return out
