"""Registry of the engine's queries and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwise import plan_queries, workload_sql
from planwise.operators import estimate, learned, lineage, predicates, spn, stats, workloads
from planwise.plans import capture, encoding
from planwise.workload_sql import DOMAINS, SHAPED

COLUMNS = list(DOMAINS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workload(spark: SparkSession) -> DataFrame:
    """(query_id, query): generated conjunctions of open ranges on lineitem."""
    return workloads.random_ranges(spark, workload_sql.QUERIES, DOMAINS, "tpch.lineitem")


def ranges(spark):
    return estimate.parse_ranges(workload(spark))


def true_counts(spark, d):
    return workloads.range_counts(table(spark, d, "lineitem"), ranges(spark))


def shares(spark, d):
    return estimate.shares(estimate.selectivities(ranges(spark), table(spark, d, "lineitem"), COLUMNS))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True counts of a range workload against the estimates of three combiners."""
    sel = estimate.selectivities(ranges(spark), table(spark, sf_dir, "lineitem"), COLUMNS)
    return true_counts(spark, sf_dir).join(estimate.combine(sel), "query_id")


def p_errors(spark, d):
    x = flagship(spark, d)
    x = x.select(F.explode(F.array(*[F.struct(F.lit(m).alias("method"), estimate.p_error(F.col("act_rows").cast("double"), F.col(m)).alias("e")) for m in ("avi", "ebo", "min_sel")])).alias("x")).select("x.*")
    return estimate.percentiles(x.withColumn("e", F.round("e", 4)), ["method"], "e")


def query_features(spark, d):
    return learned.features(ranges(spark), stats.column_summary(table(spark, d, "lineitem"), COLUMNS), shares(spark, d), COLUMNS)


def named_features(spark, d):
    names = [f"{s}_{c}" for c in COLUMNS for s in ("lo", "hi")] + ["avi", "ebo", "min_sel"]
    return query_features(spark, d).select("query_id", *[F.round(F.get("features", F.lit(i)), 6).alias(n) for i, n in enumerate(names)])


def cardinality_evaluation(spark, d):
    """(part, method, p50, p80, p90, p99) of p-errors on training and test queries: histograms, networks of sums and products, boosted trees, a neural network."""
    li = table(spark, d, "lineitem")
    sel = lineage.cut(estimate.selectivities(ranges(spark), li, COLUMNS))
    features = learned.features(ranges(spark), stats.column_summary(li, COLUMNS), estimate.shares(sel), COLUMNS)
    x = learned.labelled(features, true_counts(spark, d)).withColumn("part", F.when(F.col("query_id") % 5 == 0, "test").otherwise("train"))
    x = x.join(estimate.combine(sel), "query_id")
    x = x.join(spn.fitted_estimates(spn.fit(li, COLUMNS), ranges(spark), li, COLUMNS), "query_id")
    x = lineage.cut(x)
    train = x.where("part = 'train'")
    x = learned.mlp_predicted(learned.mlp(train, rounds=30), learned.predicted(learned.gbt(train, 10), x, "gbt"), "mlp")
    return learned.evaluation(x, ["avi", "ebo", "min_sel", "spn", "gbt", "mlp"], ["part"])


def shaped(spark):
    return workloads.shaped_queries(spark, SHAPED, "tpch.lineitem", DOMAINS, "l_suppkey", "l_linenumber")


def analyzed(spark, d):
    """(name, root_rows) of queries that were run for their plans."""
    names = ("range_scan_inclusive", "hash_agg", "index_only_scan")
    found = capture.analyzed(spark, {n: QUERIES[n](spark, d) for n in names}, 60.0)
    x = spark.createDataFrame(found, "name string, plan array<string>")
    return x.select("name", F.split(F.get("plan", F.lit(1)), "\t")[3].cast("long").alias("root_rows"))


def _lines(query):
    return lambda s, d: query(table(s, d, "lineitem"))


QUERIES = {
    "range_scan": _lines(lambda li: li.where("l_partkey > 20 and l_partkey < 60 and l_suppkey > 2 and l_suppkey < 30").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")),
    "range_count": true_counts,
    "range_scan_inclusive": _lines(lambda li: li.where(F.col("l_partkey").between(20, 25)).select("l_orderkey", "l_partkey", "l_quantity")),
    "index_only_scan": _lines(lambda li: li.where(F.col("l_suppkey").between(3, 4)).select("l_suppkey")),
    "index_lookup": lambda s, d: table(s, d, "orders").join(table(s, d, "lineitem").where("l_partkey between 5 and 9").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi").select("o_orderkey", "o_custkey"),
    "hash_agg": _lines(lambda li: li.groupBy(F.year("l_shipdate").alias("yr")).agg(F.count("*").alias("n"))),
    "sort_projection": _lines(lambda li: li.where("l_partkey < 30").orderBy("l_suppkey").select("l_partkey", "l_quantity")),
    "hash_join": lambda s, d: table(s, d, "orders").join(table(s, d, "customer").withColumnRenamed("c_custkey", "o_custkey").hint("shuffle_hash"), "o_custkey").where("c_acctbal > 9000").select("o_orderkey", "o_custkey", "c_mktsegment"),
    "merge_join": lambda s, d: table(s, d, "orders").hint("merge").join(table(s, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").where("c_nationkey = 3").select("o_orderkey", "c_name"),
    "nested_loop_theta": lambda s, d: table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") < F.col("r_regionkey")).select("n_nationkey", "r_regionkey"),
    "histogram_build": _lines(lambda li: stats.histogram(stats.value_counts(li, COLUMNS))),
    "top_values": _lines(lambda li: stats.top_n(stats.value_counts(li, COLUMNS), 5)),
    "column_summary": _lines(lambda li: stats.column_summary(li, COLUMNS)),
    "pearson_matrix": _lines(lambda li: stats.pearson(li, ["l_quantity", "l_extendedprice", "l_partkey"])),
    "index_join": lambda s, d: table(s, d, "customer").join(F.broadcast(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).where("c_acctbal > 5000").select("c_custkey", "n_name"),  # 25 nations
    "workload_generate": lambda s, d: workload(s),
    "workload_parse": lambda s, d: ranges(s),
    "workload_shapes": lambda s, d: shaped(s),
    "hint_strip": lambda s, d: shaped(s).select("query_id", workloads.strip_hints(F.col("query")).alias("query")),
    "estimates": flagship,
    "p_error_percentiles": p_errors,
    "query_features": named_features,
    "cardinality_evaluation": cardinality_evaluation,
    "physical_correlation": lambda s, d: stats.physical_correlation(s, f"{d}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"]),
    "explain_analyze": analyzed,
    "like_predicate": lambda s, d: table(s, d, "part").where(predicates.selected(predicates.parse("(p_name ~~ '%re%'::text)"), {"p_name": "string"})).select("p_partkey"),
    "in_list": lambda s, d: table(s, d, "part").where(predicates.selected(predicates.parse("(p_size = ANY ('{3,7,11}'::integer[]))"), {"p_size": "number"})).select("p_partkey", "p_size"),
    "null_compat": lambda s, d: table(s, d, "part").withColumn("x", F.when(F.col("p_size") % 5 != 0, F.col("p_size"))).where(predicates.selected(predicates.parse("(x > 30)"), {"x": "number"})).select("p_partkey", "x"),
    "label_norm": lambda s, d: table(s, d, "orders").join(F.broadcast(table(s, d, "orders").agg(F.min(F.log("o_totalprice")).alias("lo"), F.max(F.log("o_totalprice")).alias("hi")))).select("o_orderkey", F.round(encoding.label(F.col("o_totalprice"), F.col("lo"), F.col("hi")), 6).alias("y"), F.round(encoding.unlabel(encoding.label(F.col("o_totalprice"), F.col("lo"), F.col("hi")), F.col("lo"), F.col("hi")), 2).alias("back")),  # bounds are one row
    "one_hot": lambda s, d: table(s, d, "nation").select("n_nationkey", F.array_join(encoding.one_hot(F.col("n_regionkey") + 1, 5), "").alias("bits")),
}

_H = workload_sql.VALUES
ORACLES = {
    "range_scan": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_partkey > 20 AND l_partkey < 60 AND l_suppkey > 2 AND l_suppkey < 30",
    "range_count": workload_sql.COUNTS,
    "index_join": "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000",
    "workload_generate": workload_sql.TEXTS,
    "workload_parse": workload_sql.RANGES,
    "workload_shapes": workload_sql.shaped("l_suppkey", "l_linenumber"),
    "hint_strip": rf"SELECT query_id, regexp_replace(regexp_replace(query, '/\*.*?\*/', ''), 'USE INDEX.*?\)', '') AS query FROM ({workload_sql.shaped('l_suppkey', 'l_linenumber')})",
    "estimates": workload_sql.ESTIMATES,
    "p_error_percentiles": workload_sql.PERCENTILES,
    "query_features": workload_sql.FEATURES,
    "physical_correlation": "WITH o AS (SELECT *, row_number() OVER () AS i FROM orders) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(corr({c}::DOUBLE, i::DOUBLE), 6) AS r FROM o" for c in ("o_orderkey", "o_custkey", "o_totalprice")),
    "explain_analyze": "SELECT 'range_scan_inclusive' AS name, count(*) AS root_rows FROM lineitem WHERE l_partkey BETWEEN 20 AND 25 UNION ALL SELECT 'hash_agg', count(DISTINCT year(l_shipdate)) FROM lineitem UNION ALL SELECT 'index_only_scan', count(*) FROM lineitem WHERE l_suppkey BETWEEN 3 AND 4",
    "range_scan_inclusive": "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_partkey BETWEEN 20 AND 25",
    "index_only_scan": "SELECT l_suppkey FROM lineitem WHERE l_suppkey BETWEEN 3 AND 4",
    "index_lookup": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey BETWEEN 5 AND 9)",
    "hash_agg": "SELECT year(l_shipdate)::INTEGER AS yr, count(*) AS n FROM lineitem GROUP BY 1",
    "sort_projection": "SELECT l_partkey, l_quantity FROM lineitem WHERE l_partkey < 30 ORDER BY l_suppkey",
    "hash_join": "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000",
    "merge_join": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3",
    "nested_loop_theta": "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey < r_regionkey",
    "histogram_build": workload_sql.HISTOGRAM,
    "top_values": f"""WITH c AS (SELECT "column", v, count(*) AS n FROM ({_H}) GROUP BY 1, 2) SELECT "column", (row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v))::INTEGER AS rank, v, n FROM c QUALIFY rank <= 5""",
    "column_summary": f"""SELECT "column", min(v) AS min_v, max(v) AS max_v, count(v) AS n_rows, count(DISTINCT v) AS ndv, count(*) - count(v) AS null_count FROM ({_H}) GROUP BY 1""",
    "pearson_matrix": "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_partkey', round(corr(l_quantity, l_partkey), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_partkey', round(corr(l_extendedprice, l_partkey), 6) FROM lineitem",
    "like_predicate": "SELECT p_partkey FROM part WHERE coalesce(p_name, '') LIKE '%re%'",
    "in_list": "SELECT p_partkey, p_size FROM part WHERE p_size IN (3, 7, 11)",
    "null_compat": "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_size END AS x FROM part WHERE coalesce(CASE WHEN p_size % 5 <> 0 THEN p_size END > 30, true)",
    "label_norm": "SELECT o_orderkey, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (ln(o_totalprice) - (SELECT min(ln(o_totalprice)) FROM orders)) / ((SELECT max(ln(o_totalprice)) FROM orders) - (SELECT min(ln(o_totalprice)) FROM orders)))), 6) AS y, round(o_totalprice, 2) AS back FROM orders",
    "one_hot": "SELECT n_nationkey, array_to_string([(i = n_regionkey)::INTEGER FOR i IN range(5)], '') AS bits FROM nation",
}

QUERIES.update(plan_queries.QUERIES)
ORACLES.update(plan_queries.ORACLES)
