"""Sum-product networks over integer columns, and their estimates for range workloads.

Rows are split by 2-means (sum nodes), columns by correlation (product nodes), down to histograms of one
column (leaves). fit() makes the network of all rows of a table: the executors sum what a split needs over
every row, for all open scopes in one pass, and the driver holds sums only, never rows. The histograms of
its leaves stay distributed. build() is for a sample in memory, with the same splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwise.operators import bitmaps, buckets
from planwise.operators import estimate as ranges_estimate
from planwise.operators.lineage import cut

MOST_ROWS = 20_000
LEAST_ROWS = 100
#: fit() splits the rows of a scope no further from this share of the table on, so the network is of a bounded size.
LEAST_SHARE = 0.1
ROUNDS = 25
#: fit() ends a split's rounds once the squares of the means' moves, in spreads of the columns, sum to no more than this.
TOLERANCE = 1e-4
CORRELATED = 0.3
LEAF_BUCKETS = 5


@dataclass
class Split:
    """Which rows of a sum node belong to its second child: those whose weighted sum of columns is above the bound."""

    weights: dict[str, float]
    bound: float

    @staticmethod
    def between(columns: list[str], spread: np.ndarray, means: np.ndarray) -> Split:
        """Rows nearer to the second of two means of columns divided by their spread; means are rounded, so that the order of sums tells no reruns apart."""
        m = np.round(means, 9)
        return Split(dict(zip(columns, ((m[1] - m[0]) / spread).tolist(), strict=True)), float((m[1] @ m[1] - m[0] @ m[0]) / 2))

    def second(self) -> Column:
        return reduce(add, [F.col(c).cast("double") * F.lit(w) for c, w in self.weights.items()]) > F.lit(self.bound)


@dataclass
class Node:
    """kind: sum, product or leaf. rows: of its scope. Of networks that fit() made: split of a sum node, number of a leaf."""

    kind: str
    columns: tuple[str, ...]
    rows: int
    children: list[Node] = field(default_factory=list)
    histogram: list[buckets.Bucket] = field(default_factory=list)
    ndv: int = 0
    split: Split | None = None
    number: int = -1


def correlations(x: np.ndarray) -> np.ndarray:
    """Pearson matrix of the columns of x; 0 where a column is constant."""
    d = x.astype(np.float64) - x.mean(axis=0)
    size = np.sqrt((d * d).sum(axis=0))
    size[size == 0] = np.inf
    return (d.T @ d) / size[:, None] / size[None, :]


def split_columns(corr: np.ndarray, threshold: float = CORRELATED, force: bool = False) -> tuple[list[int], list[int]] | None:
    """The largest group of columns that correlations of the threshold or more connect, and the rest.

    None where all are connected; with force, the threshold rises by half until they are not. Negative correlations connect nothing.
    """
    n = len(corr)
    while True:
        group = list(range(n))
        for i in range(n):
            for j in range(i):
                if corr[i, j] >= threshold and group[i] != group[j]:
                    a, b = sorted((group[i], group[j]))
                    group = [a if g == b else g for g in group]
        sizes = {g: group.count(g) for g in group}
        if len(sizes) > 1:
            top = min(sizes, key=lambda g: (-sizes[g], g))
            return [i for i in range(n) if group[i] == top], [i for i in range(n) if group[i] != top]
        if not force:
            return None
        threshold = threshold * 1.5 if threshold < 1 else np.inf


def split_rows(x: np.ndarray, rounds: int = ROUNDS) -> np.ndarray | None:
    """Which rows belong to the second of two means, over columns of equal spread; None where all rows are equal.

    The means start at the rows of least and greatest first differing coordinates, so reruns agree.
    """
    spread = x.std(axis=0)
    if not spread.any():
        return None
    z = x[:, spread > 0] / spread[spread > 0]
    along = z.sum(axis=1)
    if along.min() == along.max():
        along = z[:, 0]
    means = z[[int(along.argmin()), int(along.argmax())]]
    own = None
    for _ in range(rounds):
        d = ((z[:, None, :] - means[None]) ** 2).sum(axis=2)
        now = d[:, 1] < d[:, 0]
        if not now.any() or now.all():
            now = along > np.median(along)
            return now if now.any() and not now.all() else along > along.min()
        if own is not None and (now == own).all():
            break
        own, means = now, np.stack([z[~now].mean(axis=0), z[now].mean(axis=0)])
    return own


def next_step(columns: int, rows: int, least_rows: int, columns_failed: bool) -> tuple[str, bool]:
    """What becomes of a scope: a leaf, a split of columns (forced or not), or a split of rows."""
    if columns == 1:
        return "leaf", False
    if rows <= least_rows:
        return "columns", True
    return ("rows", False) if columns_failed else ("columns", False)


def construct(x: np.ndarray, columns: tuple[str, ...], least_rows: int = LEAST_ROWS) -> Node:
    """The network of a matrix, top down."""
    root = Node("", columns, len(x))
    todo = [(root, x)]
    while todo:
        node, own = todo.pop()
        failed = False
        while True:
            step, force = next_step(len(node.columns), len(own), least_rows, failed)
            if step == "leaf":
                node.kind, node.histogram, node.ndv = "leaf", buckets.build(own[:, 0], LEAF_BUCKETS), len(np.unique(own[:, 0]))
                break
            if step == "columns":
                parts = split_columns(correlations(own), force=force)
                if parts is None:
                    failed = True
                    continue
                node.kind = "product"
                for part in parts:
                    node.children.append(Node("", tuple(node.columns[i] for i in part), len(own)))
                    todo.append((node.children[-1], own[:, part]))
                break
            second = split_rows(own)
            if second is None:  # equal rows: columns are independent
                step, node.kind = "columns", "product"
                for i, c in enumerate(node.columns):
                    node.children.append(Node("", (c,), len(own)))
                    todo.append((node.children[-1], own[:, [i]]))
                break
            node.kind = "sum"
            for part in (own[~second], own[second]):
                node.children.append(Node("", node.columns, len(part)))
                todo.append((node.children[-1], part))
            break
    return root


def estimate(node: Node, ranges: dict[str, tuple[float | None, float | None]]) -> float:
    """Share of rows within open ranges by column; a column without a range counts as whole."""
    if node.kind == "leaf":
        low, high = ranges.get(node.columns[0], (None, None))
        if low is None and high is None:
            return 1.0
        b = node.histogram
        rows = buckets.between_rows(b, b[0][1] if low is None else low + 1, b[-1][2] + 1 if high is None else high, node.ndv) if b else 0.0
        return min(max(rows / node.rows, 0.0), 1.0) if node.rows else 0.0
    if node.kind == "product":
        return float(np.prod([estimate(c, ranges) for c in node.children]))
    return sum(c.rows * estimate(c, ranges) for c in node.children) / max(node.rows, 1)


def build(df: DataFrame, key: str, columns: list[str], rows: int = MOST_ROWS, least_rows: int = LEAST_ROWS) -> Node:
    """The network of a sample of at most `rows` rows (never more than MOST_ROWS) by a hash of key; a missing value counts as 0."""
    sample = bitmaps.sample(df, key, min(rows, MOST_ROWS)).select(*[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in columns])
    t = sample.toArrow()
    return construct(np.stack([t.column(c).to_numpy() for c in columns], axis=1) if t.num_rows else np.zeros((0, len(columns))), tuple(columns), least_rows)


def scopes(root: Node) -> list[tuple[Node, Column]]:
    """Leaves and unfinished nodes, and which rows are theirs."""
    out, todo = [], [(root, F.lit(True))]
    while todo:
        node, own = todo.pop()
        if node.kind == "sum":
            second = node.split.second()
            todo += [(node.children[0], own & ~second), (node.children[1], own & second)]
        elif node.kind == "product":
            todo += [(c, own) for c in node.children]
        else:
            out.append((node, own))
    return out


def _sums(table: DataFrame, wanted: dict[tuple, Column]) -> dict[tuple, object]:
    """Aggregates over all rows, by their keys, in one pass; the driver gets one row."""
    row = table.agg(*[a.alias(f"a{i}") for i, a in enumerate(wanted.values())]).first()
    return dict(zip(wanted, row, strict=True))


@dataclass
class Moments:
    rows: int
    constant: np.ndarray
    covariance: np.ndarray

    def correlations(self) -> np.ndarray:
        size = np.where(self.constant, np.inf, np.sqrt(np.diag(self.covariance)))
        return self.covariance / size[:, None] / size[None, :]


def _moments(table: DataFrame, nodes: list[Node], own: dict[int, Column], columns: tuple[str, ...]) -> dict[int, Moments]:
    """Of the rows of each node, by its number; columns that are not the node's count as constant."""
    wanted = {}
    for node in nodes:
        k, rows = node.number, own[node.number]
        x = {i: F.when(rows, F.col(c).cast("double")) for i, c in enumerate(columns) if c in node.columns}
        wanted |= {(k, "rows"): F.count_if(rows)} | {(k, "constant", i): F.min(v) == F.max(v) for i, v in x.items()}
        wanted |= {(k, i, j): F.covar_pop(x[i], x[j]) for i in x for j in x if j <= i}
    got, every = _sums(table, wanted), range(len(columns))
    covariance = lambda k, i, j: got.get((k, max(i, j), min(i, j))) or 0.0
    return {n.number: Moments(got[n.number, "rows"], np.array([got.get((n.number, "constant", i)) is not False for i in every]), np.array([[covariance(n.number, i, j) for j in every] for i in every])) for n in nodes}


def _two_means(table: DataFrame, nodes: list[tuple[Node, Moments]], own: dict[int, Column], columns: tuple[str, ...], tolerance: float) -> None:
    """Give each node the split of split_rows(), from sums over all its rows; rounds are shared by all nodes."""
    used, spread, scaled, wanted = {}, {}, {}, {}
    for node, s in nodes:
        k, at = node.number, [i for i in map(columns.index, node.columns) if not s.constant[i]]
        used[k], spread[k] = [columns[i] for i in at], np.array([float(f"{np.sqrt(s.covariance[i, i]):.12g}") for i in at])
        scaled[k] = [F.col(c).cast("double") / F.lit(float(d)) for c, d in zip(used[k], spread[k], strict=True)]
        for by, along in (("sum", reduce(add, scaled[k])), ("first", scaled[k][0])):
            ends = F.when(own[k], F.struct(along.alias("along"), *[z.alias(f"z{i}") for i, z in enumerate(scaled[k])]))
            wanted |= {(k, by, 0): F.min(ends), (k, by, 1): F.max(ends)}
    got = _sums(table, wanted)
    means = {}
    for node, _ in nodes:
        k = node.number
        by = "sum" if got[k, "sum", 0][0] != got[k, "sum", 1][0] else "first"
        means[k] = np.array([got[k, by, 0][1:], got[k, by, 1][1:]])
    moving = set(means)
    for _ in range(ROUNDS - 1):
        wanted = {}
        for k in moving:
            second = Split.between(used[k], spread[k], means[k]).second()
            for side, rows in enumerate((own[k] & ~second, own[k] & second)):
                wanted |= {(k, side, i): F.avg(F.when(rows, z)) for i, z in enumerate(scaled[k])}
        got = _sums(table, wanted)
        for k in list(moving):
            now = [[got[k, side, i] for i in range(len(scaled[k]))] for side in (0, 1)]
            if None in now[0] + now[1]:  # a side without rows
                moving.remove(k)
                continue
            if ((np.array(now) - means[k]) ** 2).sum() <= max(tolerance, 1e-20):
                moving.remove(k)
            means[k] = np.array(now)
        if not moving:
            break
    for node, _ in nodes:
        node.split = Split.between(used[node.number], spread[node.number], means[node.number])


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in columns])


def fit(df: DataFrame, columns: list[str], least_rows: int | None = None, tolerance: float = TOLERANCE) -> Node:
    """The network of all rows of df; a missing value counts as 0. Its leaves have numbers, for leaf_counts(), and no histograms.

    A scope of least_rows or fewer is split by columns only; without a number that is LEAST_SHARE of the table, at least LEAST_ROWS.
    All scopes of a level share their passes over the table: one for moments, where rows are split one for the ends and fewer than ROUNDS for the means.
    """
    table, names = _long(df, columns), tuple(columns)
    root = Node("", names, 0, number=0)
    made, least = 1, least_rows
    level = [root]
    while level:
        own = {n.number: rows for n, rows in scopes(root)}
        moments = _moments(table, level, own, names)
        splitting = []
        for node in level:
            s = moments[node.number]
            stuck = s.rows == node.rows > 0  # all rows of the scope above
            if least is None:
                least = max(LEAST_ROWS, int(np.ceil(s.rows * LEAST_SHARE)))
            corr = s.correlations()
            todo = [node]
            while todo:  # parts of a scope's columns have the same rows, so its moments are theirs
                part = todo.pop()
                part.rows = s.rows
                step, force = next_step(len(part.columns), s.rows, least, False)
                if step == "leaf":
                    part.kind = "leaf"
                    continue
                at = [names.index(c) for c in part.columns]
                groups = split_columns(corr[np.ix_(at, at)], force=force)
                if groups is None and (stuck or s.constant[at].all()):  # equal rows: columns are independent
                    groups = tuple([i] for i in range(len(at)))
                if groups is None:
                    own[part.number] = own[node.number]
                    splitting.append((part, s))
                    continue
                part.kind = "product"
                for g in groups:
                    part.children.append(Node("", tuple(part.columns[i] for i in g), s.rows, number=made))
                    made += 1
                    todo.append(part.children[-1])
        level = []
        if splitting:
            _two_means(table, splitting, own, names, tolerance)
        for node, _ in splitting:
            node.kind = "sum"
            for _ in range(2):
                node.children.append(Node("", node.columns, node.rows, number=made))
                made += 1
            level += node.children
    return root


def leaf_counts(root: Node, df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, v, n): values and their counts in each leaf of a network of fit(), over all rows; column is the leaf's number."""
    leaf = {c: F.lit(None).cast("string") for c in columns}
    for node, rows in scopes(root):  # the leaves of a column share out the rows
        leaf[node.columns[0]] = F.when(rows, F.lit(str(node.number))).otherwise(leaf[node.columns[0]])
    x = _long(df, columns).select(F.explode(F.array(*[F.struct(leaf[c].alias("column"), F.col(c).alias("v")) for c in columns])).alias("x"))
    return x.groupBy("x.column", "x.v").agg(F.count("*").alias("n"))


def leaves(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        todo += node.children
        out += [node] if node.kind == "leaf" else []
    return out


def share(node: Node, known: dict[int, float]) -> float:
    """estimate() from the leaves' shares by their numbers; leaves without one count as whole."""
    if node.kind == "leaf":
        return known.get(node.number, 1.0)
    if node.kind == "product":
        return float(np.prod([share(c, known) for c in node.children]))
    return sum(c.rows * share(c, known) for c in node.children) / max(node.rows, 1)


def fitted_estimates(root: Node, ranges: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """(query_id, spn): estimated rows of each query of ranges (query_id, column, lo, hi) by a network that fit() made of df."""
    spark = ranges.sparkSession
    own = spark.createDataFrame([(str(n.number), n.columns[0]) for n in leaves(root)], "leaf string, of string")
    asked = ranges.where("lo is not null or hi is not null").join(F.broadcast(own), F.col("column") == F.col("of"))  # a row for each leaf
    asked = cut(asked.select("query_id", F.col("leaf").alias("column"), "lo", "hi"))
    sel = ranges_estimate.placed(asked, leaf_counts(root, df, columns), LEAF_BUCKETS)
    sel = asked.select("query_id", "column").join(sel, ["query_id", "column"], "left")
    x = sel.groupBy("query_id").agg(F.collect_list(F.struct(F.col("column").cast("int").alias("leaf"), F.coalesce("sel", F.lit(0.0)).alias("sel"))).alias("known"))
    x = ranges.select("query_id").distinct().join(x, "query_id", "left")
    model = spark.sparkContext.broadcast(root)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            known = [{} if r is None else {e["leaf"]: e["sel"] for e in r} for r in p["known"]]
            yield pd.DataFrame({"query_id": p["query_id"], "spn": [share(model.value, k) * model.value.rows for k in known]})

    return x.mapInPandas(run, f"query_id {ranges.schema['query_id'].dataType.simpleString()}, spn double")


def node_rows(root: Node) -> list[tuple]:
    """(node, parent, kind, columns, rows) in depth-first order, for display."""
    out, todo = [], [(root, None)]
    while todo:
        node, parent = todo.pop()
        out.append((len(out), parent, node.kind, ",".join(node.columns), node.rows))
        todo += [(c, out[-1][0]) for c in reversed(node.children)]
    return out


def estimates(root: Node, ranges: DataFrame, total: int) -> DataFrame:
    """(query_id, spn): estimated rows of each query of ranges (query_id, column, lo, hi)."""
    model = ranges.sparkSession.sparkContext.broadcast(root)
    x = ranges.groupBy("query_id").agg(F.collect_list(F.struct("column", "lo", "hi")).alias("r"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            none = lambda v: None if v is None or v != v else float(v)
            est = [estimate(model.value, {c["column"]: (none(c["lo"]), none(c["hi"])) for c in r}) * total for r in p["r"]]
            yield pd.DataFrame({"query_id": p["query_id"], "spn": est})

    kind = ranges.schema["query_id"].dataType.simpleString()
    return x.mapInPandas(run, f"query_id {kind}, spn double")
