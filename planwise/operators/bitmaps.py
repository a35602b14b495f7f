"""Samples of tables and bitmaps of predicates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwise.operators import predicates

FRACTIONS = (0.05, 0.1, 0.2, 0.4, 0.8, 1.0)


def sample(df: DataFrame, key: str, n: int = 1000, seed: int = 0) -> DataFrame:
    """n rows (all, if fewer) by the order of md5 of seed and key; reruns and other engines agree. Tasks keep n rows each before they meet."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def fraction_sample(df: DataFrame, key: str, more_than: int = 50, seed: int = 0) -> DataFrame:
    """Rows at the first of the doubling fractions that gives more than `more_than` rows; the whole table if none does."""
    place = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10_000))
    found = df.agg(*[F.count_if(place < int(f * 10_000)).alias(str(i)) for i, f in enumerate(FRACTIONS)]).first()
    fraction = next((f for i, f in enumerate(FRACTIONS) if found[i] > more_than), 1.0)
    return df if fraction == 1.0 else df.where(place < int(fraction * 10_000))


def _field(name: str):
    return lambda row: row[name]


def bitmaps(rows: DataFrame, key: str, tests: dict[str, Column], n: int = 1000) -> DataFrame:
    """(name, bits) of each test over the first n rows by key, in that order, padded with zeros to n places; one pass for all tests."""
    x = rows.orderBy(key).limit(n).select(F.col(key).alias("_k"), *[F.coalesce(t, F.lit(False)).cast("int").alias(f"t{i}") for i, t in enumerate(tests.values())])
    packed = x.agg(F.array_sort(F.collect_list(F.struct(*x.columns))).alias("all"))
    one = [F.struct(F.lit(name).alias("name"), F.concat(F.transform("all", _field(f"t{i}")), F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(n) - F.size("all")))).alias("bits")) for i, name in enumerate(tests)]
    return packed.select(F.explode(F.array(*one)).alias("x")).select("x.*")


def predicate_bitmaps(rows: DataFrame, key: str, texts: dict[str, str], types: dict[str, str], n: int = 1000) -> DataFrame:
    """bitmaps() of predicate texts; a comparison of two columns gives the neutral empty bitmap."""
    trees = {k: predicates.parse(t) for k, t in texts.items()}
    neutral = [k for k, t in trees.items() if isinstance(t, predicates.Compare) and isinstance(t.value, predicates.Word)]
    out = bitmaps(rows, key, {k: predicates.selected(t, types) for k, t in trees.items() if k not in neutral} or {"": F.lit(True)}, n)
    if not neutral:
        return out
    return out.where("name <> ''").union(rows.sparkSession.createDataFrame([(k, []) for k in neutral], "name string, bits array<int>"))


def _merge(a: Column, b: Column, pick) -> Column:
    none_a, none_b = F.coalesce(F.size(a), F.lit(0)) <= 0, F.coalesce(F.size(b), F.lit(0)) <= 0
    return F.when(none_a, b).when(none_b, a).otherwise(F.zip_with(a, b, lambda x, y: pick(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0)))))


def bit_and(a: Column, b: Column) -> Column:
    """Place by place; an empty or missing side changes nothing."""
    return _merge(a, b, F.least)


def bit_or(a: Column, b: Column) -> Column:
    return _merge(a, b, F.greatest)


def node_bitmap(*bits: Column) -> Column:
    """The conditions of one plan node together, as a string of 0 and 1."""
    out = bits[0]
    for b in bits[1:]:
        out = bit_and(out, b)
    return F.array_join(out, "")


def add_bitmaps(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Plan nodes with the bitmap of their (plan_id, pos) where found(plan_id, pos, bits) has one."""
    joined = found.groupBy("plan_id", "pos").agg(F.collect_list("bits").alias("_all"))
    folded = F.aggregate("_all", F.array().cast("array<int>"), lambda a, b: bit_and(a, b))
    return nodes.join(joined, ["plan_id", "pos"], "left").withColumn("bitmap", F.array_join(folded, "")).drop("_all")
