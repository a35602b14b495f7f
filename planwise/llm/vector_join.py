"""Near-duplicate vectors: an exact cosine join by the subspace pigeonhole principle.

Unit vectors with cosine >= c are no further apart than d2 = 2 - 2c (squared). They are rotated by
random signs and a Walsh-Hadamard transform, which spreads what tells vectors apart over all
coordinates, and cut into blocks. Each block gets a budget of d2 in proportion to its dimensions: a
pair within d2 must be within the budget in one block at least. Each block is range-joined: its first
coordinates lay a grid, a vector goes to the cells that a cube of half the block's radius touches, and
any two vectors within the radius share a cell. Only the block's coordinates go to the cells; they tell
which vectors have a neighbour within the block's budget. These few vectors follow as a whole, and the
candidates in a cell are verified by their cosine in double precision, and counted.

A pair meets in several cells; it counts in the first block that is within its budget, and there in
the first common cell. Both are decided on rounded coordinates that travel with the vectors, in whole
numbers, so that all cells decide alike; budgets are widened by the rounding.

Exact copies are one class with a multiplicity and an id of its own. Pairs are never emitted: a cell
gives the vectors that have neighbours, then the number of links of each class, and a spanning forest of
them. A cell of more than CELL_ROWS rows is dealt to pairs of its chunks, so no task holds more than two
chunks.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components links with
nothing, as does one whose label is null; vectors of different lengths don't link; an empty table
gives an empty result; rows of one vec_id are vectors of their own, each with its links and component,
which is named by its least vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwise.llm.components import connected_components, forest
from planwise.llm.grouped import groups
from planwise.llm.storage import drop, materialize
from planwise.llm.textkernel import mix64

LEAST_COSINE = 0.98
BLOCKS = 4
GRID = 3
#: Cell width in radii of the block.
WIDTH = 3.0
CELL_ROWS = 4096
#: Rounded coordinates per unit.
UNIT = 8192
_ROWS = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthogonal transform of rows whose length is a power of 2, by additions in a fixed order."""
    n = x.shape[1]
    h = 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotate(unit: np.ndarray) -> np.ndarray:
    """Rounded rotated coordinates of unit vectors."""
    d = unit.shape[1]
    n = 1 << max(2, int(np.ceil(np.log2(max(d, 1)))))
    sign = np.where(mix64(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(63), 1.0, -1.0)
    padded = np.zeros((len(unit), n))
    padded[:, :d] = unit
    return np.rint(hadamard(padded * sign) * UNIT).astype(np.int16)


def shape(n: int, distance2: float, blocks: int) -> tuple[list[slice], float, float]:
    """Blocks, a block's squared budget in rounded units, and its radius."""
    blocks = min(blocks, n)
    size = n // blocks
    budget = (np.sqrt(distance2 / blocks) * UNIT + np.sqrt(size)) ** 2 * (1 + 1e-9)
    return [slice(i * size, (i + 1) * size) for i in range(blocks)], budget, float(np.sqrt(budget))


def touched(g: np.ndarray, radius: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """First and last cell of each coordinate that a cube of half the radius about it touches."""
    return (np.floor((g + s * radius / 2) / (width * radius)).astype(np.int64) for s in (-1, 1))


def cell_key(block: int, dimensions: int, label: np.ndarray, cells: np.ndarray) -> np.ndarray:
    h = mix64(mix64(label.astype(np.int64).view(np.uint64)) + mix64(np.full(1, dimensions * 1000 + block, dtype=np.uint64)))
    for k in range(cells.shape[1]):
        h = mix64(h * np.uint64(0x9FB21C651E98DF25) + np.ascontiguousarray(cells[:, k]).view(np.uint64))
    return h.view(np.int64)


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, and their rounded rotated coordinates; those whose norm is 0 or beyond doubles are left out."""
    for b in batches:
        lists = b.column(b.schema.get_field_index("embedding"))
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        n = lists.value_lengths().to_numpy(zero_copy_only=False)
        values, at = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(n))
        for size in np.unique(n).tolist():  # rows of one length at a time
            every = np.flatnonzero(n == size)
            for part in range(0, len(every), 2048):
                rows = every[part : part + 2048]
                raw = np.ascontiguousarray(values[at[rows][:, None] + np.arange(size)])
                x = raw.astype(np.float64)
                norm = np.sqrt((x * x).sum(axis=1))
                ok = (norm > 0) & np.isfinite(norm)
                rows, raw, x, norm = rows[ok], raw[ok], x[ok], norm[ok]
                if not len(rows):
                    continue
                take, r = pa.array(rows), rotate(x / norm[:, None])
                kept = [b.column(i).take(take) for i in range(b.num_columns) if b.schema.names[i] != "embedding"]
                names = [c for c in b.schema.names if c != "embedding"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(len(rows), size, np.int32)), pa.array([v.tobytes() for v in raw], pa.binary()), pa.array([v.tobytes() for v in r], pa.binary())], [*names, "d", "exact", "rounded"])


def _by_length(d: np.ndarray, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, coordinates) of rounded vectors, those of one length d at a time."""
    values = column.to_pylist()
    for size in np.unique(d).tolist():
        rows = np.flatnonzero(d == size)
        yield size, rows, np.frombuffer(b"".join(values[i] for i in rows.tolist()), dtype=np.int16).reshape(len(rows), -1)


def _spread(distance2: float, blocks: int, grid: int, width: float, narrow: bool):
    """A row for each cell that a point touches, with its block's coordinates; narrow: the cells alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, node = b.column(1).to_numpy(), b.column(0).to_numpy()
            for size, own, r in _by_length(b.column(2).to_numpy(), b.column(3)):
                cuts, _, radius = shape(r.shape[1], distance2, blocks)
                for k, cut in enumerate(cuts):
                    g = r[:, cut][:, :grid].astype(np.float64)
                    low, high = touched(g, radius, width)
                    rows, cells = [], []
                    for corner in range(1 << g.shape[1]):
                        bit = (corner >> np.arange(g.shape[1])) & 1
                        c = np.where(bit, high, low)
                        hit = np.flatnonzero(((bit == 0) | (high > low)).all(axis=1))
                        rows.append(hit)
                        cells.append(cell_key(k, size, label[own][hit], c[hit]))
                    rows, cell = np.concatenate(rows), np.concatenate(cells)
                    if narrow:
                        yield pa.RecordBatch.from_arrays([pa.array(cell)], ["cell"])
                        continue
                    part = [v.tobytes() for v in np.ascontiguousarray(r[:, cut])]
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(rows), size, np.int32)), pa.array(np.full(len(rows), k, np.int32)), pa.array(node[own][rows]), pa.array([part[i] for i in rows.tolist()], pa.binary())], ["cell", "d", "block", "node", "part"])

    return run


def _near(distance2: float, blocks: int):
    """(cell, block, node) of the points of a cell, or across a pair of its chunks, that have a neighbour within the block's budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 4):
            if t.num_rows < 2:
                continue
            x = np.frombuffer(b"".join(t.column("part").to_pylist()), dtype=np.int16).reshape(t.num_rows, -1).astype(np.float64)
            own = blocks if x.shape[1] > 1 else min(blocks, 4)  # vectors have 4 coordinates at least, and as many blocks at most
            _, budget, _ = shape(x.shape[1] * own, distance2, own)
            across, chunk = t.column(1)[0].as_py() != t.column(2)[0].as_py(), t.column("chunk").to_numpy()
            square, hit = (x * x).sum(axis=1), np.zeros(t.num_rows, dtype=bool)
            for a in range(0, len(x), _ROWS):
                i = slice(a, a + _ROWS)
                for b in range(a, len(x), _ROWS):
                    j = slice(b, b + _ROWS)
                    near = square[i, None] + square[None, j] - 2 * (x[i] @ x[j].T) <= budget
                    if across:
                        near &= chunk[i, None] != chunk[None, j]
                    if a == b:
                        np.fill_diagonal(near, False)
                    hit[i] |= near.any(axis=1)
                    hit[j] |= near.any(axis=0)
            if hit.any():
                yield t.select(["cell", "block", "node"]).filter(pa.array(hit)).combine_chunks().to_batches()[0]

    return run


def cell_links(cell: int, d: int, ids: np.ndarray, n: np.ndarray, label: np.ndarray, x: np.ndarray, r: np.ndarray, block: int, side: np.ndarray, least: float, blocks: int, grid: int, width: float) -> pd.DataFrame:
    """Links that count in this cell: rows (id, links, v) of link counts, and of forest edges id - v with links 0.

    side: 0 and 1 for rows of two chunks, of which only pairs across are asked for; -1 where all are.
    """
    cuts, budget, radius = shape(r.shape[1], 2 - 2 * least, blocks)
    whole = r.astype(np.float64)
    square = [(whole[:, c] ** 2).sum(axis=1) for c in cuts]
    low, _ = touched(whole[:, cuts[block]][:, :grid], radius, width)
    norm = np.sqrt((x * x).sum(axis=1))
    links = np.zeros(len(ids), dtype=np.int64)
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(ids), _ROWS):
        i = slice(a, a + _ROWS)
        for b in range(a, len(ids), _ROWS):
            j = slice(b, b + _ROWS)
            near = square[block][i, None] + square[block][None, j] - 2 * (whole[i, cuts[block]] @ whole[j, cuts[block]].T) <= budget
            if a == b:
                near &= np.tri(near.shape[0], near.shape[1], -1, dtype=bool).T
            u, v = np.nonzero(near)
            if not len(u):
                continue
            u, v = u + a, v + b
            # the first of the cells that both touch is this one
            ok = (label[u] == label[v]) & (cell_key(block, d, label[u], np.maximum(low[u], low[v])) == cell)
            if side[0] >= 0 or side[-1] >= 0:
                ok &= side[u] != side[v]
            u, v = u[ok], v[ok]
            for k in range(block):  # an earlier block has the pair
                if not len(u):
                    break
                gap = whole[u, cuts[k]] - whole[v, cuts[k]]
                first = (gap * gap).sum(axis=1) > budget
                u, v = u[first], v[first]
            if len(u):
                cos = np.einsum("ij,ij->i", x[u], x[v]) / (norm[u] * norm[v])
                u, v = u[cos >= least], v[cos >= least]
                np.add.at(links, u, n[v])
                np.add.at(links, v, n[u])
                us.append(u)
                vs.append(v)
        us, vs = ([y] for y in forest(np.concatenate(us), np.concatenate(vs)))
    u, v = ids[us[0]], ids[vs[0]]
    own = np.flatnonzero(links)
    return pd.DataFrame({"id": np.concatenate([ids[own], u]), "links": np.concatenate([links[own], np.zeros(len(u), np.int64)]), "v": np.concatenate([ids[own], v])})


def _links(least: float, blocks: int, grid: int, width: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 4):
            cell, a, b, d = (t.column(k)[0].as_py() for k in range(4))
            block = t.column("block")[0].as_py()
            ids, n, label, chunk = (t.column(k).to_numpy() for k in ("node", "n", "label", "chunk"))
            x = np.frombuffer(b"".join(t.column("exact").to_pylist()), dtype=kind).astype(np.float64)
            r = np.frombuffer(b"".join(t.column("rounded").to_pylist()), dtype=np.int16)
            side = np.full(len(ids), -1) if a == b else (chunk == b).astype(np.int64)
            got = cell_links(cell, d, ids, n, label, x.reshape(len(ids), -1), r.reshape(len(ids), -1), block, side, least, blocks, grid, width)
            if len(got):
                yield pa.RecordBatch.from_pandas(got, preserve_index=False)

    return run


def _dealt(x: DataFrame, counts: DataFrame, cell_rows: int) -> DataFrame:
    """x in order of (cell, a, b, d): once for each pair of chunks a <= b of its cell that its own chunk is in. counts(cell, count): cells of more than cell_rows rows."""
    x = x.join(counts, "cell", "left")
    chunks = F.when(F.col("count").isNull(), F.lit(1)).otherwise(F.ceil(F.col("count") * 2 / cell_rows)).cast("int")
    x = x.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    own = [c for c in x.columns if c not in ("cell", "d", "count", "chunks", "other")]
    x = x.select("cell", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "d", *own)
    return x.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b", "d")


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE, blocks: int = BLOCKS, grid: int = GRID, width: float = WIDTH, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding, label)."""
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.exists("embedding", lambda c: c != 0) & F.forall("embedding", number)
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(valid, F.lit(False)), F.col("label")).cast("long").alias("label"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    keyed = rows.where("label is not null").withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit("second"), "embedding")})
    key = ["label", "h1", "h2"]
    classes = keyed.groupBy(*key).agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    # a node for each class; the ids are fixed once the table is written
    classes = classes.withColumn("node", F.monotonically_increasing_id()).select("node", *key, "id", "n", "embedding")
    classes = materialize(classes.mapInArrow(_points, "node long, label long, h1 long, h2 long, id long, n long, d int, exact binary, rounded binary"), "points")

    options = (2 - 2 * least, blocks, grid, width)
    source = classes.select("node", "label", "d", "rounded")
    hot = materialize(source.mapInArrow(_spread(*options, True), "cell long").groupBy("cell").count().where(F.col("count") > cell_rows), "cells")
    spread = source.mapInArrow(_spread(*options, False), "cell long, d int, block int, node long, part binary")
    near = _dealt(spread, hot, cell_rows).mapInArrow(_near(options[0], blocks), "cell long, block int, node long")
    near = materialize(near.distinct(), "near")
    more = near.groupBy("cell").count().where(F.col("count") > cell_rows)
    points = _dealt(near.join(classes.select("node", "n", "label", "d", "exact", "rounded"), "node"), more, cell_rows)
    points = points.select("cell", "a", "b", "d", "block", "label", "node", "n", "chunk", "exact", "rounded")
    found = materialize(points.mapInArrow(_links(least, blocks, grid, width, kind), "id long, links long, v long"), "links")

    components = connected_components(found.where("id <> v").select("id", "v"))
    links = found.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links"))
    per = classes.select("node", *key, "id", "n").join(links, "node", "left").join(components, "node", "left")
    per = per.select(*key, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "id", F.coalesce("component", "node").alias("component"))
    names = per.groupBy("component").agg(F.min("id").alias("component_id"))
    per = materialize(per.drop("id").join(names, "component").select(*key, "n_links", "component_id"), "classes")
    drop(classes, hot, near, found, components)
    out = keyed.select("vec_id", *key).join(per, key, "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = rows.where("label is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


ORACLE_OP7 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, embedding FROM embeddings
), v AS (
  SELECT rid, vec_id, label, [x::DOUBLE FOR x IN embedding] AS e FROM d
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), l AS (
  SELECT a.rid AS u, b.rid AS v FROM v a JOIN v b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {LEAST_COSINE}
), r(n, c) AS (
  SELECT rid, vec_id FROM v UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.n
), c AS (SELECT n, min(c) AS c FROM r GROUP BY n
), k AS (SELECT u, count(*) AS k FROM l GROUP BY u)
SELECT d.vec_id, coalesce(k.k, 0)::BIGINT AS n_links, coalesce(c.c, d.vec_id) AS component_id, coalesce(coalesce(c.c, d.vec_id) = d.vec_id, true) AS kept
FROM d LEFT JOIN c ON c.n = d.rid LEFT JOIN k ON k.u = d.rid
"""
