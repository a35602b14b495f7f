"""Level-wise encoding of plan node tables for tree models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BATCH = 64
CHARACTERS = 500


def batched(n: DataFrame) -> DataFrame:
    """Nodes with batch_id: BATCH plans in order of a plan_id that counts from 0."""
    return n.withColumn("batch_id", F.floor(F.col("plan_id") / BATCH))


def levels(n: DataFrame) -> DataFrame:
    """Nodes of batched() with slot: the 1-based place among all nodes of the batch on that level, plans in order."""
    w = Window.partitionBy("batch_id", "depth").orderBy("plan_id", "pos")
    return n.withColumn("slot", F.row_number().over(w))


def child_slots(leveled: DataFrame) -> DataFrame:
    """levels() with left and right: slots of the first two children on the next level, 0 for none."""
    kids = leveled.where("parent is not null").groupBy("plan_id", F.col("parent").alias("pos")).agg(F.sort_array(F.collect_list("slot")).alias("_kids"))
    x = leveled.join(kids, ["plan_id", "pos"], "left")
    slot = lambda i: F.coalesce(F.try_element_at("_kids", F.lit(i)), F.lit(0))
    return x.withColumn("left", slot(1)).withColumn("right", slot(2)).drop("_kids")


def one_hot(value: Column, width: int) -> Column:
    """1-based position as an array of 0 and 1; all 0 for null."""
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.coalesce((i == value).cast("int"), F.lit(0)))


def many_hot(values: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.coalesce(F.array_contains(values, i).cast("int"), F.lit(0)))


def widths(leveled: DataFrame) -> DataFrame:
    """(batch_id, n_levels, width): levels() of a batch are padded to its widest, so that it becomes dense arrays."""
    per = leveled.groupBy("batch_id", "depth").agg(F.max("slot").alias("n"))
    return per.groupBy("batch_id").agg(F.count("*").alias("n_levels"), F.max("n").alias("width"))


def label(v: Column, low: Column, high: Column) -> Column:
    """A label's logarithm scaled to the bounds of logarithms."""
    return normalized(F.log(v), low, high)


def unlabel(y: Column, low: Column, high: Column) -> Column:
    """The value of a label()."""
    return F.exp(y * (high - low) + low)


def padded(rows: Column, n: Column, width: int) -> Column:
    """An array of vectors with zero vectors up to n of them."""
    return F.concat(rows, F.array_repeat(F.array_repeat(F.lit(0.0), width), F.greatest(F.lit(0), n - F.size(rows)).cast("int")))


def normalized(v: Column, low: Column, high: Column) -> Column:
    """(v - low) / (high - low) within 0 and 1; 0 where the range is empty."""
    return F.when(high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low)))).otherwise(F.lit(0.0))


def character_vector(text: Column, width: int = CHARACTERS) -> Column:
    """1 at the hash of each character of the text; null as empty."""
    marks = F.transform(F.split(F.coalesce(text, F.lit("")), ""), lambda c: F.when(c != "", F.pmod(F.xxhash64(c), F.lit(width))))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.exists(marks, lambda m: F.coalesce(m == i, F.lit(False))), F.lit(False)).cast("double"))
