"""Readers of statistics, workloads, plans and header-less CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATS_SCHEMA = """database_name string, table_name string, count bigint, modify_count bigint, columns map<string, struct<
null_count: bigint, tot_col_size: bigint, correlation: double,
histogram: struct<ndv: bigint, buckets: array<struct<count: bigint, lower_bound: string, upper_bound: string, repeats: bigint>>>,
cm_sketch: struct<top_n: array<struct<data: string, count: bigint>>>>>"""

#: Columns of the movie tables, by position; those of _integers() hold integers, the rest strings.
MOVIE_TABLES = {
    "aka_name": "id person_id name imdb_index name_pcode_cf name_pcode_nf surname_pcode md5sum",
    "aka_title": "id movie_id title imdb_index kind_id production_year phonetic_code episode_of_id season_nr episode_nr note md5sum",
    "cast_info": "id person_id movie_id person_role_id note nr_order role_id",
    "char_name": "id name imdb_index imdb_id name_pcode_nf surname_pcode md5sum",
    "comp_cast_type": "id kind",
    "company_name": "id name country_code imdb_id name_pcode_nf name_pcode_sf md5sum",
    "company_type": "id kind",
    "complete_cast": "id movie_id subject_id status_id",
    "info_type": "id info",
    "keyword": "id keyword phonetic_code",
    "kind_type": "id kind",
    "link_type": "id link",
    "movie_companies": "id movie_id company_id company_type_id note",
    "movie_info": "id movie_id info_type_id info note",
    "movie_info_idx": "id movie_id info_type_id info note",
    "movie_keyword": "id movie_id keyword_id",
    "movie_link": "id movie_id linked_movie_id link_type_id",
    "name": "id name imdb_index imdb_id gender name_pcode_cf name_pcode_nf surname_pcode md5sum",
    "person_info": "id person_id info_type_id info note",
    "role_type": "id role",
    "title": "id title imdb_index kind_id production_year imdb_id phonetic_code episode_of_id season_nr episode_nr series_years md5sum",
}


def _integers(column: str) -> bool:
    return column == "id" or column.endswith(("_id", "_nr")) or column in ("production_year", "nr_order")


def movie_schema(table: str) -> str:
    """DDL of a movie table."""
    return ", ".join(f"{c} {'int' if _integers(c) else 'string'}" for c in MOVIE_TABLES[table].split())


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A header-less CSV file; rows of another number of fields are left out, whatever columns are read later."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("columnPruning", "false").option("escape", "\\").csv(path)


def movie_tables(spark: SparkSession, folder: str, names=tuple(MOVIE_TABLES)) -> dict[str, DataFrame]:
    return {t: csv(spark, f"{folder}/{t}.csv", movie_schema(t)) for t in names}


def integer_sample(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """The listed integer columns of a CSV sample, an empty value as 0."""
    return csv(spark, path, schema).select(*[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in columns])


def text_integer(encoded: Column) -> Column:
    """An integer written in decimal digits, in base64."""
    return F.decode(F.unbase64(encoded), "UTF-8").try_cast("long")


def comparable_integer(encoded: Column) -> Column:
    """A signed integer of order-preserving bytes (flag 3, then big-endian with the sign bit flipped), in base64."""
    flipped = F.conv(F.hex(F.substring(F.unbase64(encoded), 2, 8)), 16, -10).cast("long")
    return flipped.bitwiseXOR(F.lit(-(2**63)).cast("long"))


def table_statistics(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(columns, histogram, top values) of the listed columns from a statistics JSON file.

    histogram has the columns of operators.stats.histogram(), its row counts cumulative. A file with
    modifications since its statistics were taken raises an error.
    """
    raw = spark.read.schema(STATS_SCHEMA).option("multiLine", True).json(path)
    fresh = F.when(F.coalesce("modify_count", F.lit(0)) != 0, F.raise_error("statistics are stale")).otherwise(F.lit(True))
    x = raw.where(fresh).select("table_name", F.col("count").alias("row_count"), F.explode("columns").alias("column", "s")).where(F.col("column").isin(columns))
    summary = x.select("table_name", "column", "row_count", "s.null_count", "s.tot_col_size", "s.correlation", F.col("s.histogram.ndv").alias("ndv"))
    b = x.select("column", F.posexplode("s.histogram.buckets").alias("bucket", "b"))
    hist = b.select("column", "bucket", F.col("b.count").alias("row_count"), text_integer(F.col("b.lower_bound")).alias("lower"), text_integer(F.col("b.upper_bound")).alias("upper"), "b.repeats")
    t = x.select("column", F.explode("s.cm_sketch.top_n").alias("t"))
    return summary, hist, t.select("column", comparable_integer(F.col("t.data")).alias("v"), F.col("t.count").alias("n"))


def workload(spark: SparkSession, path: str) -> DataFrame:
    """(query, act_rows) from a JSON array."""
    return spark.read.schema("query string, act_rows bigint").option("multiLine", True).json(path)


def text_plans(spark: SparkSession, path: str) -> DataFrame:
    """(query, plan) from a JSON array of textual plans."""
    return spark.read.schema("query string, plan array<string>").option("multiLine", True).json(path)


def json_plan_lines(spark: SparkSession, path: str) -> DataFrame:
    """(plan_id, plan) of JSON-lines files, lines that are null left out; plan_id is 0, 1, 2, ... in order of file names and lines."""
    x = spark.read.text(path).select(F.col("value").alias("plan"), F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b")).alias("part"), F.monotonically_increasing_id().alias("at"))
    x = x.where(~F.trim("plan").isin("", "null"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = x.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # a row for each split of a file
    inside = F.row_number().over(Window.partitionBy("part").orderBy("at"))
    return x.withColumn("i", inside - 1).join(parts, "part").select((F.col("before") + F.col("i")).alias("plan_id"), "plan")


def column_bounds(spark: SparkSession, path: str) -> DataFrame:
    """(table, column, min_v, max_v, n_rows) from a JSON file of bounds by table and column."""
    text = spark.read.text(path, wholetext=True)
    kind = "map<string, map<string, struct<min: double, max: double, count: bigint>>>"
    x = text.select(F.explode(F.from_json("value", kind)).alias("table", "columns")).select("table", F.explode("columns").alias("column", "b"))
    return x.select("table", "column", F.col("b.min").alias("min_v"), F.col("b.max").alias("max_v"), F.col("b.count").alias("n_rows"))


def batches(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The batches first..last that sinks.batches() wrote; other folders are not read."""
    return spark.read.parquet(path).where(F.col("batch_id").between(first, last))


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Rows of a query at a database server whose driver is on the class path."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(token, vec) as Parquet."""
    return spark.read.parquet(path).select("token", "vec")
