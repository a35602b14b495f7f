"""Exact top-k inner products by MaxScore over shards, merged.

A component of a vector is a posting of the term (dimension, sign) with the component's size as its
impact. A query scores, in dimension d, at most ub(d) = max(q_d * x_d over the shard's postings); a
posting of the other sign only lowers the score. Terms are ordered by ub. Those with the smallest
bounds whose sum, with what a document has so far, can't pass the current k-th score are
non-essential. For each query and block of a shard: essential postings are accumulated for all
documents of the block (postings of a dimension lie side by side), documents whose partial score plus
the non-essential bounds can't beat the threshold are dropped, and the rest probe the non-essential
terms, largest bound first, as long as they stay competitive. The threshold rises from block to block;
it starts from the shard's first block, so it is always the score of k real candidates.

Vectors are dealt to shards of a fixed size by a hash, and every query goes to every shard. A task holds
one shard at a time and streams the queries past it, batch by batch, so vectors travel once, however many
queries there are, and memory does not grow with the data. Each shard gives k + 1 rows per query at most.

Defined cases: a vector that is null, empty or holds null or non-finite components takes no part, nor does
one without a vec_id; vectors of different lengths are compared over the shorter one's dimensions; ties go
to the smaller vec_id; rows of one vec_id are rows of their own, as queries and as candidates (a query is
never compared with its own row, but with others of its id, equal ones included); fewer than k candidates
give fewer rows; an empty table gives an empty result. Scores beyond 64 bits are held at the largest or
smallest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planwise.llm.grouped import changes

K = 10
SCALE = 1024
#: Every so many ids is a query.
QUERY_STEP = 100
SHARD_ROWS = 65536
LEAST_SHARDS = 24
BLOCK = 2048

_EXACT = float(1 << 53)
_LONG = (-(1 << 63), (1 << 63) - 1)


def matrix(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Rows of a list column, with zeros or cut to the width (of the longest)."""
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    width = int(n.max(initial=0)) if width is None else width
    out = np.zeros((len(n), width))
    values, at = column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(n))
    for size in np.unique(n).tolist():  # rows of one length at a time
        own = np.flatnonzero(n == size)
        out[own, : min(size, width)] = values[at[own][:, None] + np.arange(min(size, width))]
    return out


class Shard:
    """Postings of integer-valued vectors: one run of impacts for each dimension, in order of ids."""

    def __init__(self, ids: np.ndarray, docs: np.ndarray, lengths: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.docs, self.lengths = ids[order], docs[order], lengths[order]
        self.postings = np.ascontiguousarray(self.docs.T)
        self.top, self.low = self.postings.max(axis=1, initial=-np.inf), self.postings.min(axis=1, initial=np.inf)
        self.most = np.abs(self.docs).max(initial=0.0)

    def topk(self, q: np.ndarray, k: int, block: int = BLOCK, stats: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best vectors; ties to the earlier place, which has the smaller id. Products must stay exact in doubles."""
        postings, n = self.postings, len(self.ids)
        bound = np.maximum(np.maximum(q * self.top, q * self.low), 0.0)
        terms = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[terms][::-1])[::-1], 0.0)  # rest[j]: bounds of terms j and on
        best_i, best_s = np.zeros(0, np.int64), np.zeros(0)
        threshold = -np.inf
        for at in range(0, n, block):
            part = postings[:, at : at + block]
            # essential terms: with only the others, no document can pass the threshold
            split = int(np.searchsorted(-rest, -threshold, side="left")) if np.isfinite(threshold) else len(terms)
            split = min(max(split, 1), len(terms))
            scores = q[terms[:split]] @ part[terms[:split]]
            alive = None
            j = split
            while j < len(terms):
                keep = np.flatnonzero(scores + rest[j] > threshold)
                alive = keep if alive is None else alive[keep]
                scores = scores[keep]
                if not len(alive):
                    break
                more = min(len(terms), j + 4)
                scores = scores + q[terms[j:more]] @ part[np.ix_(terms[j:more], alive)]
                if stats is not None:
                    stats["probed"] = stats.get("probed", 0) + (more - j) * len(alive)
                j = more
            if alive is None:
                alive = np.arange(part.shape[1])
            ok = scores > threshold  # later places lose ties
            if ok.any():
                best_i = np.concatenate([best_i, at + alive[ok]])
                best_s = np.concatenate([best_s, scores[ok]])
                o = np.lexsort((best_i, -best_s))[:k]
                best_i, best_s = best_i[o], best_s[o]
                if len(o) == k:
                    threshold = best_s[-1]
        return best_i, best_s

    def whole(self, q: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        """topk() for products beyond 53 bits, in integers of any size."""
        x = [int(v) for v in q.tolist()]
        s = sorted((-sum(map(int.__mul__, x, map(int, y))), i) for i, y in enumerate(self.docs.tolist()))[:k]
        return np.array([i for _, i in s], dtype=np.int64), [min(max(-v, _LONG[0]), _LONG[1]) for v, _ in s]

    def search(self, own: np.ndarray, q: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query's row, vec_id, score, same) of each query's k + 1 best; same: the vector has the query's id and components."""
        fits = np.abs(q).max(initial=0.0) * self.most * max(q.shape[1], 1) < _EXACT
        rows, ids, scores, same = [], [], [], []
        for i, (me, x, n) in enumerate(zip(own.tolist(), q, lengths.tolist(), strict=True)):
            at, s = self.topk(x, k + 1) if fits else self.whole(x, k + 1)
            rows.append(np.full(len(at), i))
            ids.append(self.ids[at])
            scores.append(np.array([int(v) for v in s], dtype=np.int64))
            same.append((self.ids[at] == me) & (self.lengths[at] == n) & (self.docs[at] == x).all(axis=1))
        join = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)]).astype(kind)
        return join(rows, np.int64), join(ids, np.int64), join(scores, np.int64), join(same, bool)


def _search(k: int):
    """Over rows in order of shard, vectors before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shard = None, [], None
        for b in batches:
            for s, e in zip(c := [*changes(b, 2).tolist(), b.num_rows], c[1:]):
                part = b.slice(s, e - s)
                if part.column(0)[0].as_py() != at:
                    at, held, shard = part.column(0)[0].as_py(), [], None
                if part.column(1)[0].as_py() == 0:
                    held.append(part)
                    continue
                if shard is None:
                    if not held:
                        continue
                    docs = pa.Table.from_batches(held).combine_chunks()
                    lists = docs.column(3).combine_chunks()
                    shard, held = Shard(docs.column(2).to_numpy(), matrix(lists), lists.value_lengths().to_numpy(zero_copy_only=False)), []
                lengths = part.column(3).value_lengths().to_numpy(zero_copy_only=False)
                q = matrix(part.column(3), shard.docs.shape[1])
                row, ids, scores, same = shard.search(part.column(2).to_numpy(), q, lengths, k)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(take) for i in (2, 4, 5, 6)), pa.array(ids), pa.array(scores), pa.array(same)], ["query_id", "f1", "f2", "copies", "vec_id", "score", "same"])

    return run


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, q) with q = floor(scale * x) of each component as double, of vectors that take part."""
    x = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0")
    x = x.where(F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))))
    # floor() of a double gives a long and would hold larger values at its ends; those are whole numbers already
    value = lambda c: F.when(F.abs(c.cast("double")) < 2.0**50, F.floor(c.cast("double") * scale).cast("double")).otherwise(c.cast("double") * scale)
    return x.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", value).alias("q"))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best vectors by inner product; both inputs are (vec_id, q).

    A query that is itself among the vectors leaves out one vector of its id and components.
    """
    shards = max(LEAST_SHARDS, -(-vectors.count() // shard_rows))
    d = vectors.select(F.pmod(F.xxhash64("vec_id", "q"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "q", F.lit(0).cast("long").alias("f1"), F.lit(0).cast("long").alias("f2"), F.lit(0).cast("long").alias("copies"))
    # equal queries are asked once
    q = queries.withColumns({"f1": F.xxhash64("q"), "f2": F.xxhash64(F.lit("second"), "q")})
    q = q.groupBy("vec_id", "f1", "f2").agg(F.first("q").alias("q"), F.count("*").alias("copies"))
    q = q.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "q", "f1", "f2", "copies")
    rows = d.union(q).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    found = rows.mapInArrow(_search(k), "query_id long, f1 long, f2 long, copies long, vec_id long, score long, same boolean")
    query = ["query_id", "f1", "f2"]
    # equal rows have equal scores: whichever of them goes, the rest is the same
    own = F.row_number().over(Window.partitionBy(*query, "same").orderBy("score"))
    found = found.withColumn("own", F.col("same") & (own == 1)).where("not own")
    order = Window.partitionBy(*query).orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("query_id", "rank", "vec_id", "score")


def op3_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(vectors.where(F.col("vec_id") % QUERY_STEP == 0), vectors)


ORACLE_OP3 = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.rid, a.vec_id AS query_id, b.vec_id, list_sum([(x[1] * x[2])::BIGINT FOR x IN list_zip(a.q, b.q)])::BIGINT AS score
  FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % {QUERY_STEP} = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
