"""Generated range workloads, hints in query text, and exact counts of a stated workload.

Random numbers come from md5 of a key and a seed, so reruns and other engines draw the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Queries that are counted in one pass over the table; a longer workload takes more passes.
BLOCK = 10_000


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1): 8 hex digits of md5 of seed and key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))


def masks(columns: int, most: int) -> list[int]:
    """Sets of 1 to `most` of so many columns, as bits."""
    return [m for m in range(1, 1 << columns) if m.bit_count() <= most]


def _picked(key: Column, seed: str, columns: int, most: int) -> Column:
    own = masks(columns, most)
    return F.element_at(F.array(*map(F.lit, own)), (F.floor(uniform(key, seed) * len(own)) + 1).cast("int"))


def random_ranges(spark: SparkSession, n: int, domains: dict[str, tuple[int, int]], table: str, seed: str = "w1", most: int = 4) -> DataFrame:
    """(query_id, query): n conjunctions of open ranges on 1 to `most` columns.

    A range's width is a random part of its domain times 1.5 for each column, so that more columns still select rows; its place is random.
    """
    q = F.col("query_id")
    x = spark.range(n).select(F.col("id").alias("query_id")).withColumn("mask", _picked(q, seed, len(domains), most))
    wider = F.pow(F.lit(1.5), F.bit_count("mask"))
    conditions = []
    for i, (c, (low, high)) in enumerate(domains.items()):
        span = high - low
        width = F.least(F.floor(F.floor(uniform(q, f"{seed}-w-{c}") * span) * wider), F.lit(span - 1)).cast("long")
        left = (F.lit(low) + F.floor(uniform(q, f"{seed}-l-{c}") * (F.lit(span) - width))).cast("long")
        conditions.append(F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.concat(F.lit(f"{c}>"), left.cast("string"), F.lit(f" and {c}<"), (left + width).cast("string"))))
    return x.select("query_id", F.concat(F.lit(f"select * from {table} where "), F.concat_ws(" and ", *conditions)).alias("query"))


def pass_rate_range(column: str, domain: tuple[int, int], rate: Column, key: Column, seed: str) -> Column:
    """Text of an inclusive range that covers `rate` of the domain, at a random place."""
    low, high = domain
    gap = high - low
    start = F.greatest(F.floor(F.lit(float(gap)) * (F.lit(1.0) - rate)), F.lit(1))
    left = (F.lit(low) + F.floor(uniform(key, f"{seed}-{column}") * start)).cast("long")
    return F.concat(F.lit(f"{column}>="), left.cast("string"), F.lit(f" AND {column}<="), (left + F.floor(F.lit(float(gap)) * rate).cast("long")).cast("string"))


def random_predicates(domains: dict[str, tuple[int, int]], rate: Column, key: Column, seed: str) -> Column:
    """Ranges of that rate on one or two random columns."""
    mask = _picked(key, f"{seed}-m", len(domains), 2)
    return F.concat_ws(" AND ", *[F.when(mask.bitwiseAND(1 << i) > 0, pass_rate_range(c, d, rate, key, seed)) for i, (c, d) in enumerate(domains.items())])


def shaped_queries(spark: SparkSession, n: int, table: str, domains: dict[str, tuple[int, int]], first: str, second: str, seed: str = "w4") -> DataFrame:
    """(query_id, shape, query): six query shapes for each of the pass rates 0, 1/n, ..., (n - 1)/n.

    first and second are the indexed columns; index hints name them.
    """
    x = spark.range(n).select(F.col("id").alias("i"), (F.col("id") / F.lit(float(n))).alias("rate"))
    key, rate = F.col("i"), F.col("rate")
    rest = {c: d for c, d in domains.items() if c not in (first, second)}
    most = F.lit(0.95)
    some = lambda of, r, s: random_predicates(of, r, key, f"{seed}-{s}")
    own = lambda c, s: pass_rate_range(c, domains[c], rate, key, f"{seed}-{s}")
    shapes = [
        ("table_scan", F.concat(F.lit(f"SELECT * FROM {table} USE INDEX(primary) WHERE "), some(domains, rate, "t"))),
        ("index_scan", F.concat(F.lit(f"SELECT {first} FROM {table} USE INDEX(idx_{first}) WHERE "), own(first, "i1"), F.lit(" AND "), some(rest, most, "i1"))),
        ("index_scan_2", F.concat(F.lit(f"SELECT {second} FROM {table} USE INDEX(idx_{second}) WHERE "), own(second, "i2"), F.lit(" AND "), some(rest, most, "i2"))),
        ("index_lookup", F.concat(F.lit(f"SELECT * FROM {table} USE INDEX(idx_{first}) WHERE "), own(first, "u"), F.lit(" AND "), some({c: d for c, d in domains.items() if c != first}, most, "u"))),
        ("hash_agg", F.concat(F.lit(f"SELECT /*+ HASH_AGG() */ {first}, count(*) FROM {table} WHERE "), some(domains, rate, "a"), F.lit(f" GROUP BY {first}"))),
        ("sort", F.concat(F.lit(f"SELECT {first}, {second} FROM {table} USE INDEX(idx_{first}) WHERE "), some(domains, rate, "s"), F.lit(f" ORDER BY {next(iter(rest))}"))),
    ]
    x = x.select("i", F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(s).alias("shape"), q.alias("query")) for k, (s, q) in enumerate(shapes)])).alias("x"))
    return x.select((F.col("i") * len(shapes) + F.col("x.place")).alias("query_id"), "x.shape", "x.query")


def strip_hints(query: Column) -> Column:
    """The query without its first comment hint and its first index hint."""
    return F.regexp_replace(F.regexp_replace(query, r"(?s)^(.*?)/\*.*?\*/", "$1"), r"(?s)^(.*?)USE INDEX.*?\)", "$1")


def _count(columns: list[str], shared):
    """Rows within each query's ranges, a row per task and query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, low, high = shared.value
        n = np.zeros(len(ids), dtype=np.int64)
        for b in batches:
            parts = [b.column(i) for i in range(len(columns))]
            values = [(c.fill_null(0).to_numpy(zero_copy_only=False), c.is_valid().to_numpy(zero_copy_only=False) if c.null_count else True) for c in parts]
            for q in range(len(ids)):
                fits = np.ones(b.num_rows, dtype=bool)
                for (v, known), lo, hi in zip(values, low[q], high[q], strict=True):
                    if lo is not None:
                        fits &= (v > lo) & known
                    if hi is not None:
                        fits &= (v < hi) & known
                n[q] += np.count_nonzero(fits)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, dtype=np.int64)[own]), pa.array(n[own])], ["query_id", "n"])

    return run


def range_counts(df: DataFrame, ranges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(query_id, act_rows) of a stated workload's ranges (query_id, column, lo, hi) over df, in one pass for each `block` of queries.

    Integer columns. Array comparisons on Arrow batches take a third of the time of as many conditional counts in
    one aggregation, and have no limit on generated code; the shuffle has one row per task and query.
    """
    per: dict[int, dict[str, tuple]] = {}
    for r in ranges.collect():  # a row per range of a stated workload
        per.setdefault(r.query_id, {})[r.column] = (r.lo, r.hi)
    spark, every, out = df.sparkSession, sorted(per), None
    columns = [c for c in df.columns if any(c in x for x in per.values())]
    asked = spark.createDataFrame([(int(q),) for q in every], "query_id long")
    for at in range(0, len(every), block):
        ids = every[at : at + block]
        sides = [[[per[q].get(c, (None, None))[k] for c in columns] for q in ids] for k in (0, 1)]
        own = df.select(*[F.col(c).cast("long").alias(c) for c in columns])
        found = own.mapInArrow(_count(columns, spark.sparkContext.broadcast((ids, *sides))), "query_id long, n long")
        out = found if out is None else out.union(found)
    if out is None:
        return asked.withColumn("act_rows", F.lit(0).cast("long"))
    counts = out.groupBy("query_id").agg(F.sum("n").alias("act_rows"))
    return asked.join(counts, "query_id", "left").select("query_id", F.coalesce("act_rows", F.lit(0)).alias("act_rows"))
