"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document gets the exponential key -ln(u) / w, with u drawn from a hash of its id and the seed and
w its quality weight. Within a source, documents in ascending key order are a weighted sample without
replacement of any length; the prefix sum of their sizes against the source's token budget says where
the fractional epoch ends. Complete epochs come first.

The prefix sum does not gather a source in one task: keys are first counted into a two-level histogram
of FAN x FAN cells per source. Windows over at most FAN cells find the one cell in which a source's
budget ends; only that cell's documents are ordered, and the rest are taken or left by their cell.

Defined cases: null text has size 0; a document of size 0 takes 0 words; a null source is a source of
its own, last in code point order; a null doc_id keeps its row; repeated rows each count; an empty table gives an empty result; a
source whose size is 0 has target 0; columns of other names are carried by mix() and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planwise.llm.storage import drop, fresh, materialize

#: Target weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
MAX_EPOCHS = 3
SEED = "mix-1"
#: Quality weights by label: good, bad and unlabelled documents.
GOOD, BAD, UNKNOWN = 2.0, 0.5, 1.0
FAN = 128

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words separated by white space; null has none.

    Java's regexp engine has to make a match per word; deleting what is not a word's first
    character leaves the count as a length, but costs more, so the count is kept plain.
    """
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from a hash of key and seed: 13 hex digits of md5, so reruns and other engines agree."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): water filling in closed form.

    With sources in ascending order of cap / weight, a source is at its cap when the level that the
    rest would share lies above that ratio; from the first one below it on, levels only fall. Input has one row per source; that is the only table
    that goes through a single task.
    """
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by_ratio = everything.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    x = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_epochs)
    x = x.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    x = x.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0))))
    x = x.withColumn("capped", F.col("level") >= F.col("cap") / F.col("w"))
    x = x.withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
    return x.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w")).alias("target"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, quality_weight) of labelled documents; of several labels the best counts."""
    best = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return best.select("doc_id", F.when(F.col("q") >= 1, F.lit(GOOD)).otherwise(F.lit(BAD)).alias("quality_weight"))


def plan_mix(docs: DataFrame, labels: DataFrame | None = None, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, cut_last: bool = True) -> DataFrame:
    """(doc_id, text_hash, size, source, source_size, target, taken) for each row of docs(doc_id, text, source).

    cut_last: the document in which the budget ends gives only the words up to it; otherwise it is
    taken whole if that comes nearer to the budget.
    """
    spark = docs.sparkSession
    x = docs.select("doc_id", "source", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), word_count(F.col("text")).alias("size"))
    if labels is not None:
        x = x.join(quality_weights(labels), "doc_id", "left")
    else:
        x = x.withColumn("quality_weight", F.lit(UNKNOWN))
    key = -F.log(uniform(F.col("doc_id"), seed)) / F.coalesce("quality_weight", F.lit(UNKNOWN))
    # 1 - exp(-key) rises with the key from 0 to 1, and spreads keys over cells
    cell = F.least(F.floor((1 - F.exp(-key)) * (FAN * FAN)), F.lit(FAN * FAN - 1)).cast("int")
    x = table = materialize(x.select("doc_id", "source", "text_hash", "size", key.alias("key"), cell.alias("cell")), "mix")

    cells = x.groupBy("source", "cell").agg(F.sum("size").alias("n"))
    coarse = x.groupBy("source", F.floor(F.col("cell") / FAN).cast("int").alias("coarse")).agg(F.sum("size").alias("n"))
    per = x.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = targets(per, weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("long")
    t = t.withColumn("epochs", epochs).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long"))

    # the coarse cell, then the cell, in which a source's rest ends
    up_to = Window.partitionBy("k_source").rowsBetween(Window.unboundedPreceding, -1)
    k = coarse.select(F.struct("source").alias("k_source"), "coarse", "n").join(t.select(F.struct("source").alias("k_source"), "rest"), "k_source")
    k = k.withColumn("before", F.coalesce(F.sum("n").over(up_to.orderBy("coarse")), F.lit(0))).where("before <= rest and rest < before + n")
    f = cells.select(F.struct("source").alias("k_source"), "cell", F.floor(F.col("cell") / FAN).cast("int").alias("coarse"), "n")
    # dealt by both, so that the cells of a large source do not meet in one task before the join drops most of them
    k = k.select("k_source", "coarse", "rest", F.col("before").alias("above")).repartition("k_source", "coarse")
    f = f.join(k, ["k_source", "coarse"])
    f = f.withColumn("before", F.col("above") + F.coalesce(F.sum("n").over(up_to.orderBy("cell")), F.lit(0))).where("before <= rest and rest < before + n")
    ends = f.select("k_source", F.col("cell").alias("end_cell"), F.col("before").alias("end_before"))
    t = t.select(F.struct("source").alias("k_source"), "source_size", "target", "epochs", "rest").join(ends, "k_source", "left")

    # one row per source: its size is checked, as any join's is, before Spark broadcasts it
    x = x.withColumn("k_source", F.struct("source")).join(t, "k_source")
    whole = F.col("epochs") * F.col("size")
    in_end = F.coalesce(F.col("cell") == F.col("end_cell"), F.lit(False))
    columns = ["doc_id", "text_hash", "size", "source", "source_size", "target"]
    # without an end cell the rest is the whole source, or nothing
    taken = F.when(F.col("end_cell").isNull(), F.when(F.col("rest") >= F.col("source_size"), F.col("size")).otherwise(F.lit(0)))
    taken = taken.otherwise(F.when(F.col("cell") < F.col("end_cell"), F.col("size")).otherwise(F.lit(0)))
    clear = x.where(~in_end).select(*columns, (whole + taken).cast("long").alias("taken"))
    order = Window.partitionBy("k_source").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("end_before") - F.coalesce(F.sum("size").over(order), F.lit(0))
    part = F.greatest(F.lit(0), F.least("size", left)) if cut_last else F.when(left * 2 > F.col("size"), F.col("size")).otherwise(F.lit(0))
    last = x.where(in_end).select(*columns, (whole + part).cast("long").alias("taken"))
    out = clear.union(last)
    out._planwise_path = table._planwise_path  # for drop()
    return out


def mix(docs: DataFrame, labels: DataFrame | None = None, **options) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, whole, with the columns of docs.

    Documents that the mix leaves out, and those without words, go. Rows of equal doc_id, source and text
    that the mix takes differently often share out what it takes of them all.
    """
    plan = plan_mix(docs, labels, cut_last=False, **options)
    name, times, more, copy = (fresh(n, docs) for n in ("row_key", "times", "more", "copy"))
    counted = plan.where("taken > 0").groupBy(F.struct("doc_id", "source", "text_hash").alias(name)).agg(F.sum((F.col("taken") / F.col("size")).cast("long")).alias("t"))
    rows = plan.where("size > 0").groupBy(F.struct("doc_id", "source", "text_hash").alias(name)).agg(F.count("*").alias("rows"))
    shares = counted.join(rows, name).select(name, F.floor(F.col("t") / F.col("rows")).cast("int").alias(times), (F.col("t") % F.col("rows")).cast("int").alias(more))
    shares = materialize(shares, "shares")
    drop(plan)
    x = docs.withColumn(name, F.struct(F.col("doc_id"), F.col("source"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")))
    out = x.join(shares.where(F.col(times) > 0).drop(more), name).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
    # equal rows among which a source's budget ends: one of them gives the rest
    split = x.join(shares.where(F.col(more) > 0).drop(times), name).dropDuplicates([name])
    return out.union(split.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(more)))).select(*docs.columns))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return plan_mix(docs, labels).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_OP4 = rf"""
WITH best AS (
  SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), d AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
      / coalesce(CASE WHEN q IS NULL THEN NULL WHEN q >= 1 THEN {GOOD}::DOUBLE ELSE {BAD}::DOUBLE END, {UNKNOWN}::DOUBLE) AS key
  FROM documents d LEFT JOIN best USING (doc_id)
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
    source_size * {MAX_EPOCHS} AS cap, sum(source_size) OVER () AS total FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER r, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER r, 0))::DOUBLE AS level
  FROM w WINDOW r AS (ORDER BY cap::DOUBLE / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (SELECT *, level >= cap::DOUBLE / w AS capped FROM l
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (max(CASE WHEN NOT capped THEN level END) OVER ()) * w END AS target FROM c
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {MAX_EPOCHS})::BIGINT ELSE 0 END AS epochs FROM t
), f AS (SELECT *, floor(target - epochs * source_size + 0.5)::BIGINT AS rest FROM e)
SELECT d.doc_id, d.size, f.source_size, f.target,
  (f.epochs * d.size + greatest(0, least(d.size, f.rest - coalesce(sum(d.size) OVER k, 0))))::BIGINT AS taken
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
WINDOW k AS (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""
