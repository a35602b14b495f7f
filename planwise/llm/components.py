"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwise.llm.storage import collect, drop, materialize

#: Edges that one task joins, 16 MB; more are joined by rounds until no more are left.
ONE_TASK = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its part) that join what the edges (u, v) join."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:  # min-label hooking with pointer jumping
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        moved = low != high
        if not moved.any():
            break
        np.minimum.at(label, high[moved], low[moved])
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        u = np.concatenate([u, b.column(0).to_numpy()])
        v = np.concatenate([v, b.column(1).to_numpy()])
        if len(u) > 1 << 20:
            u, v = forest(u, v)
            if len(u) > 1 << 19:  # still large: pass it on, and start anew
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                u, v = u[:0], v[:0]
    if len(u):
        u, v = forest(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that is not the least of its component.

    edges: two columns of long; loops, repeats and nulls are ignored. component is the least node
    that is reachable. Nodes without edges, and the least ones, have no row. Each round takes a forest of each
    partition's edges, then one large-star and one small-star step (Kiveris et al., 2014); neighbours are never
    collected, only their minimum is aggregated. No step raises the least neighbour of a node, and a round that changes
    nothing leaves stars. ONE_TASK edges or fewer are joined by one task, without rounds: each round makes plans, compiled
    code, threads and task results that the driver holds. Each round's edges are written to the shared folder, and so is the result.
    """
    spark = edges.sparkSession
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = e.mapInArrow(_local, "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(e, "edges")
    seen = None
    for _ in range(rounds):
        if (now.count() if seen is None else seen[0]) <= ONE_TASK:
            before, now = now, materialize(now.coalesce(1).mapInArrow(_local, "u long, v long"), "forest")
            drop(before)
            collect(spark)
            break
        before, now = now, materialize(now.mapInArrow(_local, "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "forest")
        drop(before)
        # large star: a larger neighbour moves to the least of the node and its neighbours
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = now.select(F.col("u").alias("x"), F.col("v").alias("c")).join(least, "c").select(F.col("x").alias("u"), F.col("m").alias("v"))
        own = least.where("m < c").select(F.col("c").alias("u"), F.col("m").alias("v"))
        # small star: the node and its smaller neighbours move to the least of them
        e1 = large.union(own).where("u <> v").distinct()
        low = e1.groupBy("u").agg(F.min("v").alias("m"))
        small = e1.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = materialize(small.where("u <> v").distinct(), "edges")
        drop(now)
        now = after
        collect(spark)
        got = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if got == seen:
            break
        seen = got
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out._planwise_path = now._planwise_path  # for drop()
    return out
