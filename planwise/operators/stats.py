"""Column statistics: histograms, top values, distinct counts, ranges, correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planwise.operators.lineage import cut


#: Cells of a range in running_total(), and cells that are summed together.
FAN = 512


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, v, n): every column's values and their counts, in one pass with map-side combining."""
    x = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("v")) for c in columns])).alias("x"))
    return x.where("x.v is not null").groupBy("x.column", "x.v").agg(F.count("*").alias("n"))


def running_total(df: DataFrame, group: list[str], order: str, amount: str, name: str) -> DataFrame:
    """df with `name`: the sum of `amount` up to and with the row, by the number `order`, which is unique within a group.

    A group's range is cut into FAN x FAN cells of equal width. Rows are summed within their cell, cells within FAN
    neighbours, and these within the group, so a task orders the rows of a cell or FAN sums, not a whole group.
    """
    df = cut(df)  # it is read four times
    key = F.struct(*[F.col(c) for c in group])  # nulls are a group, too
    ends = df.groupBy(key.alias("_g")).agg(F.min(order).cast("double").alias("_lo"), F.max(order).cast("double").alias("_hi"))
    x = df.withColumn("_g", key).join(ends, "_g")
    share = F.coalesce((F.col(order).cast("double") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(0.0))
    x = x.withColumn("_cell", F.least(F.floor(share * (FAN * FAN)), F.lit(FAN * FAN - 1))).withColumn("_coarse", F.floor(F.col("_cell") / FAN))
    up_to = lambda *of: Window.partitionBy(*of).rowsBetween(Window.unboundedPreceding, -1)
    cells = x.groupBy("_g", "_coarse", "_cell").agg(F.sum(amount).alias("_sum"))
    coarse = x.groupBy("_g", "_coarse").agg(F.sum(amount).alias("_sum")).select("_g", "_coarse", F.coalesce(F.sum("_sum").over(up_to("_g").orderBy("_coarse")), F.lit(0)).alias("_above"))
    cells = cells.select("_g", "_coarse", "_cell", F.coalesce(F.sum("_sum").over(up_to("_g", "_coarse").orderBy("_cell")), F.lit(0)).alias("_before"))
    cells = cells.join(coarse, ["_g", "_coarse"]).select("_g", "_cell", (F.col("_before") + F.col("_above")).alias("_before"))
    own = F.sum(amount).over(Window.partitionBy("_g", "_cell").orderBy(order))
    return x.withColumn(name, own).join(cells, ["_g", "_cell"]).withColumn(name, F.col(name) + F.col("_before")).select(*df.columns, name)


def histogram(counts: DataFrame, buckets: int = 10) -> DataFrame:
    """(column, bucket, row_count, lower, upper, repeats) from value_counts(); row_count is cumulative.

    Values belong to the first bucket while fewer than total / buckets rows come before; each further
    value is a bucket of its own.
    """
    counts = cut(counts)
    x = running_total(counts, ["column"], "v", "n", "upto")
    total = counts.groupBy("column").agg(F.sum("n").alias("total"))
    x = x.join(total, "column").withColumn("own", ((F.col("upto") - F.col("n")) * buckets >= F.col("total")).cast("long"))
    x = running_total(x, ["column"], "v", "own", "bucket")
    return x.groupBy("column", "bucket").agg(F.max("upto").alias("row_count"), F.min("v").alias("lower"), F.max("v").alias("upper"), F.max_by("n", "v").alias("repeats"))


def top_n(counts: DataFrame, n: int = 10) -> DataFrame:
    """(column, rank, v, n): each column's most frequent values, ties to the smaller.

    Each task keeps its first n rows of a column before they meet, as any ranking below a limit does.
    """
    w = Window.partitionBy("column").orderBy(F.desc("n"), "v")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("column", "rank", "v", "n")


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, min_v, max_v, n_rows, ndv, null_count) in one aggregation."""
    aggs = [f(F.col(c)).cast("long").alias(f"{p}_{c}") for c in columns for p, f in (("min", F.min), ("max", F.max), ("n", F.count), ("ndv", F.count_distinct))]
    one = df.agg(F.count("*").alias("_rows"), *aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"min_{c}").alias("min_v"), F.col(f"max_{c}").alias("max_v"), F.col(f"n_{c}").alias("n_rows"), F.col(f"ndv_{c}").alias("ndv"), (F.col("_rows") - F.col(f"n_{c}")).alias("null_count")) for c in columns]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of each pair of columns; 0 where a column is constant."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.coalesce(F.nanvl(F.col(f"r{i}"), F.lit(0.0)), F.lit(0.0)), 6).alias("r")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def physical_correlation(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(column, r): how closely a column of Parquet files follows the rows' order in them; files in order of their names."""
    x = spark.read.parquet(path).select(*[F.col(c).cast("double") for c in columns], F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = x.groupBy("_file").agg(F.max("_row").alias("_last"))  # a row for each file
    files = files.select("_file", F.coalesce(F.sum(F.col("_last") + 1).over(before), F.lit(0)).alias("_before"))
    x = x.join(files, "_file").withColumn("_place", (F.col("_row") + F.col("_before")).cast("double"))
    one = x.agg(*[F.corr(c, "_place").alias(c) for c in columns])
    rows = [F.struct(F.lit(c).alias("column"), F.round(F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)), 6).alias("r")) for c in columns]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def less_rows(v, buckets):
    """Estimated rows below v, from a column's buckets (array of struct row_count, lower, upper, repeats, prev in ascending order)."""
    b = F.get(F.filter(buckets, lambda x: x.upper >= v), F.lit(0))
    span = (b.upper - b.lower).cast("double")
    fraction = F.when(span <= 0, F.lit(0.5)).otherwise((v - b.lower) / span)
    fraction = F.when((fraction < 0) | (fraction > 1), F.lit(0.5)).otherwise(fraction)
    inside = b.prev + fraction * (b.row_count - b.repeats - b.prev)
    total = F.element_at(buckets, -1).row_count
    return F.when(b.isNull(), total.cast("double")).when(v < b.lower, b.prev.cast("double")).when(v == b.upper, (b.row_count - b.repeats).cast("double")).otherwise(inside)


def between_rows(low, high, buckets, ndv):
    """Estimated rows in [low, high)."""
    return between(less_rows(low, buckets), less_rows(high, buckets), F.element_at(buckets, -1).row_count, ndv)


def between(lo, hi, total, ndv):
    """Estimated rows from those below either end of a range."""
    return F.when((lo >= hi) & (ndv > 0), F.least(hi, total - lo, total / ndv)).otherwise(hi - lo)


def bucket_arrays(hist: DataFrame) -> DataFrame:
    """(column, buckets, ndv is left to column_summary()) one row per column."""
    w = Window.partitionBy("column").orderBy("bucket")
    x = hist.withColumn("prev", F.coalesce(F.lag("row_count").over(w), F.lit(0)))
    return x.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("bucket", "row_count", "lower", "upper", "repeats", "prev"))).alias("buckets"))
