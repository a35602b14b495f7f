"""JSON plan trees as node tables, sequences and labels."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planwise.operators import predicates

SCHEMA = """plan_id bigint, pos int, depth int, parent int, node_type string, relation string, index_name string, strategy string,
keys array<string>, condition string, condition_filter string, condition_index string"""
KINDS = ("Sort", "Hash", "Hash Join", "Merge Join", "Nested Loop", "Aggregate", "Seq Scan", "Index Scan", "Index Only Scan", "Bitmap Heap Scan", "Bitmap Index Scan", "Materialize", "Gather", "Gather Merge", "Limit")
#: Types of nodes in plans that models learn from.
LEARNED = ("Sort", "Hash", "Hash Join", "Merge Join", "Nested Loop", "Aggregate", "Seq Scan", "Index Scan")


def _aliases(node: dict, out: dict) -> dict:
    if "Relation Name" in node:
        out[node.get("Alias", node["Relation Name"])] = node["Relation Name"]
    for child in node.get("Plans", ()):
        _aliases(child, out)
    return out


def _condition(text: str | None, aliases: dict, relation: str | None) -> str | None:
    tree = predicates.parse(text)
    return None if tree is None else json.dumps(predicates.sequence(predicates.qualified(tree, aliases, relation)))


def _key(text: str, aliases: dict, relation: str | None) -> str:
    """A sort or group key with its alias replaced by the relation, without its direction."""
    alias, _, column = text.split(" ")[0].rpartition(".")
    owner = aliases.get(alias, alias) or relation
    return f"{owner}.{column}" if owner else column


def walk(plan: dict, strict: bool = True) -> list[dict]:
    """A plan's nodes in depth-first order; an aggregate at the top is left out. If strict, node types outside KINDS raise an error."""
    root = plan["Plans"][0] if plan["Node Type"] == "Aggregate" and plan.get("Plans") else plan
    aliases, out, open_nodes = _aliases(plan, {}), [], [(root, 0, None)]
    while open_nodes:
        node, depth, parent = open_nodes.pop()
        if strict and node["Node Type"] not in KINDS:
            raise ValueError(f"node type {node['Node Type']}")
        relation, index = node.get("Relation Name"), node.get("Index Name")
        owner = relation or (index.rsplit("_pkey", 1)[0] if index and index.endswith("_pkey") else None)
        joins = node.get("Hash Cond") or node.get("Merge Cond") or node.get("Join Filter")
        out.append({"pos": len(out), "depth": depth, "parent": parent, "node_type": node["Node Type"], "relation": relation, "index_name": index, "strategy": node.get("Strategy"), "keys": [_key(k, aliases, owner) for k in [*node.get("Sort Key", []), *node.get("Group Key", [])]], "condition": _condition(joins, aliases, None), "condition_filter": _condition(node.get("Filter"), aliases, owner), "condition_index": _condition(node.get("Index Cond"), aliases, owner)})
        open_nodes += [(c, depth + 1, out[-1]["pos"]) for c in reversed(node.get("Plans", []))]
    return out


def _load(line: str) -> dict:
    plan = json.loads(line)
    return (plan[0] if isinstance(plan, list) else plan)["Plan"]


def nodes(plans: DataFrame, strict: bool = True) -> DataFrame:
    """Node rows (SCHEMA) of plans(plan_id, plan): trees of any depth are beyond column expressions, hence Python, in Arrow batches."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(", ")]
        for b in batches:
            found = [{"plan_id": i, **n} for i, p in zip(b["plan_id"], b["plan"], strict=True) if p and p.strip() not in ("", "null") for n in walk(_load(p), strict)]
            out = pd.DataFrame(found, columns=names)
            yield out.astype({"parent": "Int32"})

    return plans.select("plan_id", "plan").mapInPandas(rows, SCHEMA)


def learnable(n: DataFrame, most: int | None = None) -> DataFrame:
    """(plan_id) of plans whose nodes(strict=False) are all of LEARNED types with a join or an aggregate among them; the first `most` by plan_id."""
    x = n.groupBy("plan_id").agg(F.bool_and(F.col("node_type").isin(*LEARNED)).alias("ok"), F.bool_or(F.col("node_type").isin("Hash Join", "Merge Join", "Aggregate")).alias("joined"))
    x = x.where("ok and joined").select("plan_id")
    return x if most is None else x.orderBy("plan_id").limit(most)


def labels(plans: DataFrame) -> DataFrame:
    """(plan_id, cost, cardinality): time and rows of the root below one aggregate."""
    at = lambda path: F.coalesce(F.get_json_object("plan", f"$[0].Plan{path}"), F.get_json_object("plan", f"$.Plan{path}"))
    below = (at("['Node Type']") == "Aggregate") & at(".Plans[0]").isNotNull()
    pick = lambda name: F.when(below, at(f".Plans[0]['{name}']")).otherwise(at(f"['{name}']")).cast("double")
    return plans.where("plan is not null and trim(plan) not in ('', 'null')").select("plan_id", pick("Actual Total Time").alias("cost"), pick("Actual Rows").alias("cardinality"))


def sequences(n: DataFrame) -> DataFrame:
    """(plan_id, seq) depth-first arrays of JSON nodes, a null where a subtree ends."""
    closed = F.lead("depth", 1).over(Window.partitionBy("plan_id").orderBy("pos"))
    x = n.withColumn("_ends", F.col("depth") - F.coalesce(closed, F.lit(0)) + 1)
    item = F.to_json(F.struct("node_type", "relation", "index_name", "strategy", "keys", "condition", "condition_filter", "condition_index"))
    parts = F.concat(F.array(item), F.array_repeat(F.lit(None).cast("string"), F.col("_ends").cast("int")))
    x = x.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("pos", parts.alias("parts")))).alias("all"))
    return x.select("plan_id", F.flatten(F.transform("all", lambda r: r.parts)).alias("seq"))


def bounds(n: DataFrame, known: DataFrame) -> DataFrame:
    """One row of maxima: nodes of a plan, items of a condition (joins counted), and logs of the least and greatest labels."""
    size = lambda c: F.coalesce(F.size(F.from_json(c, "array<string>")), F.lit(0))
    longest = F.greatest(*[size(c) for c in ("condition", "condition_filter", "condition_index")])
    a = n.groupBy("plan_id").agg(F.count("*").alias("n"), F.max(longest).alias("c")).agg(F.max("n").alias("max_nodes"), F.max("c").alias("max_condition"))
    log = lambda c: F.log(F.greatest(F.col(c), F.lit(1e-9)))
    b = known.agg(*[f(log(c)).alias(f"{p}_{c}") for c in ("cost", "cardinality") for p, f in (("min", F.min), ("max", F.max))])
    return a.join(b)
