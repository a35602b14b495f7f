"""Cardinality estimates of conjunctive ranges, and how far they are off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwise.operators import stats
from planwise.operators.lineage import cut


def parse_table(query) -> tuple:
    """(database, table) Columns of a query's text; no database where the table has none, nulls where there is no such text."""
    name = F.nullif(F.regexp_extract(F.lower(query), r"\bfrom\s+([\w.]+)", 1), F.lit(""))
    parts = F.split(name, "\\.")
    return F.when(F.size(parts) > 1, parts[F.size(parts) - 2]), F.element_at(parts, -1)


def column_names(ranges: DataFrame) -> DataFrame:
    """(query_id, columns) that a query has a bound on, on either side, in order of their names."""
    return ranges.groupBy("query_id").agg(F.sort_array(F.collect_set("column")).alias("columns"))


def column_range(ranges: DataFrame, summary: DataFrame) -> DataFrame:
    """(query_id, column, lo, hi) with missing sides filled from summary(column, min_v, max_v)."""
    x = ranges.join(summary.select("column", "min_v", "max_v"), "column")
    return x.select("query_id", "column", F.coalesce("lo", "min_v").alias("lo"), F.coalesce("hi", "max_v").alias("hi"))


def parse_ranges(queries: DataFrame) -> DataFrame:
    """(query_id, column, lo, hi) from the text of conjunctive integer ranges; a missing side is null."""
    x = queries.select("query_id", F.explode(F.expr(r"regexp_extract_all(lower(query), '(\\w+\\s*[<>]=?\\s*-?\\d+)', 1)")).alias("c"))
    part = lambda i: F.regexp_extract("c", r"(\w+)\s*([<>]=?)\s*(-?\d+)", i)
    x = x.select("query_id", part(1).alias("column"), part(2).alias("op"), part(3).cast("long").alias("v"))
    lo = F.max(F.when(F.col("op") == ">", F.col("v")).when(F.col("op") == ">=", F.col("v") - 1))
    hi = F.min(F.when(F.col("op") == "<", F.col("v")).when(F.col("op") == "<=", F.col("v") + 1))
    return x.groupBy("query_id", "column").agg(lo.alias("lo"), hi.alias("hi"))


def selectivities(ranges: DataFrame, df: DataFrame, columns: list[str], buckets: int = 10) -> DataFrame:
    """(query_id, column, sel, total) of each range, from histograms of df's columns."""
    return placed(ranges, stats.value_counts(df, columns), buckets)


def placed(ranges: DataFrame, counts: DataFrame, buckets: int = 10) -> DataFrame:
    """selectivities() from counts(column, v, n), one row for each value."""
    counts = cut(counts)
    ends = counts.groupBy("column").agg(F.sum("n").alias("total"), F.count("*").alias("ndv"), F.min("v").alias("lower"), F.max("v").alias("last"))
    x = ranges.join(ends.select("column", "lower", "last"), "column")
    x = cut(x.select("query_id", "column", F.coalesce(F.col("lo") + 1, "lower").alias("low"), F.coalesce("hi", F.col("last") + 1).alias("high")))
    # sides are values without rows among the others: no task holds all buckets of a column
    asked = x.select("column", F.explode(F.array("low", "high")).alias("v"), F.lit(0).cast("long").alias("n"))
    places = cut(stats.running_total(counts.union(asked).groupBy("column", "v").agg(F.sum("n").alias("n")), ["column"], "v", "n", "upto"))
    # the first bucket, the only one of several values; rows below any other value are counted
    first = places.join(ends.select("column", "total"), "column").where((F.col("n") > 0) & ((F.col("upto") - F.col("n")) * buckets < F.col("total")))
    ends = ends.join(first.groupBy("column").agg(F.max("v").alias("upper"), (F.max("upto") - F.max_by("n", "v")).alias("before")), "column")
    asked = x.select("column", F.explode(F.array("low", "high")).alias("v")).distinct().join(places, ["column", "v"]).join(ends, "column")
    v = F.col("v")
    share = (v - F.col("lower")) / (F.col("upper") - F.col("lower")).cast("double")
    inside = (v >= F.col("lower")) & (v < F.col("upper"))
    asked = cut(asked.select("column", "v", "total", "ndv", F.when(inside, share * F.col("before")).otherwise((F.col("upto") - F.col("n")).cast("double")).alias("below")))
    low = asked.select("column", F.col("v").alias("low"), F.col("below").alias("lo"), "total", "ndv")
    x = x.join(low, ["column", "low"]).join(asked.select("column", F.col("v").alias("high"), F.col("below").alias("hi")), ["column", "high"])
    rows = stats.between(F.col("lo"), F.col("hi"), F.col("total"), F.col("ndv"))
    return x.select("query_id", "column", F.greatest(F.lit(0.0), F.least(F.lit(1.0), rows / F.col("total"))).alias("sel"), "total")


def column_bounds(hist: DataFrame, top: DataFrame) -> DataFrame:
    """(column, min_v, max_v) over the buckets and the top values."""
    both = hist.select("column", "lower", "upper").union(top.select("column", "v", "v"))
    return both.groupBy("column").agg(F.min("lower").alias("min_v"), F.max("upper").alias("max_v"))


def known_selectivities(ranges: DataFrame, summary: DataFrame, hist: DataFrame, top: DataFrame) -> DataFrame:
    """(query_id, column, sel, total) of each range from readers.table_statistics(), whose histograms leave the top values out.

    Rows are the histogram's estimate and the counts of the top values within the range.
    """
    known = summary.select("column", "ndv", F.col("row_count").alias("total")).join(stats.bucket_arrays(hist), "column", "left")
    known = known.join(top.groupBy("column").agg(F.collect_list(F.struct("v", "n")).alias("top")), "column", "left").join(column_bounds(hist, top), "column", "left")
    x = ranges.join(known, "column").withColumn("first", F.coalesce(F.col("lo") + 1, "min_v")).withColumn("end", F.coalesce(F.col("hi"), F.col("max_v") + 1))
    within = F.filter("top", lambda t: (t.v >= F.col("first")) & (t.v < F.col("end")))
    hot = F.coalesce(F.aggregate(within, F.lit(0).cast("long"), lambda a, t: a + t.n), F.lit(0))
    rows = F.coalesce(stats.between_rows(F.col("first"), F.col("end"), F.col("buckets"), F.col("ndv")), F.lit(0.0)) + hot
    sel = F.when(F.col("total") > 0, rows / F.col("total")).otherwise(0.0)
    return x.select("query_id", "column", F.greatest(F.lit(0.0), F.least(F.lit(1.0), sel)).alias("sel"), "total")


def shares(sel: DataFrame) -> DataFrame:
    """(query_id, total, avi, ebo, min_sel): selectivities by independence, exponential back-off over the four smallest, and the minimum."""
    product = F.aggregate("s", F.lit(1.0), lambda a, b: a * b)
    back_off = F.aggregate(F.transform(F.slice("s", 1, 4), lambda x, i: F.pow(x, F.pow(F.lit(0.5), i))), F.lit(1.0), lambda a, b: a * b)
    x = sel.groupBy("query_id").agg(F.array_sort(F.collect_list("sel")).alias("s"), F.max("total").alias("total"))
    return x.select("query_id", "total", product.alias("avi"), back_off.alias("ebo"), F.element_at("s", 1).alias("min_sel"))


def combine(sel: DataFrame) -> DataFrame:
    """(query_id, avi, ebo, min_sel) estimated rows of shares()."""
    return shares(sel).select("query_id", *[F.round(F.col(n) * F.col("total"), 4).alias(n) for n in ("avi", "ebo", "min_sel")])


def p_error(act, est):
    """Greater over smaller of actual and estimated rows; a smaller side of 0 counts as 1."""
    low = F.least(act, est).cast("double")
    return F.greatest(act, est) / F.when(low == 0, 1.0).otherwise(low)


def percentiles(df: DataFrame, group: list[str], value: str, at: tuple[float, ...] = (0.5, 0.8, 0.9, 0.99)) -> DataFrame:
    """Values at 0-based position floor(n q) in ascending order, per group.

    Counts of distinct values are summed by range partitions first, so no task has to order a group by itself.
    """
    counts = cut(df.groupBy(*group, value).agg(F.count("*").alias("n")))
    x = stats.running_total(counts, group, value, "n", "upto")
    total = counts.groupBy(*group).agg(F.sum("n").alias("total"))
    key = F.struct(*[F.col(c) for c in group]).alias("_g")
    x = x.select(key, value, "n", "upto").join(total.select(key, "total"), "_g")
    place = lambda q: F.floor(F.col("total") * F.lit(q))
    found = [F.max(F.when((F.col("upto") > place(q)) & (F.col("upto") - F.col("n") <= place(q)), F.col(value))).alias(f"p{int(q * 100)}") for q in at]
    return x.groupBy("_g").agg(*found).select(*[F.col("_g")[c].alias(c) for c in group], *[f"p{int(q * 100)}" for q in at])
