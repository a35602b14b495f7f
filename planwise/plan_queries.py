"""Queries over predicates, samples, bitmaps and plans, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planwise import plan_corpus
from planwise.operators import bitmaps, lineage, predicates
from planwise.plans import conditions, encoding, json_plans, text_plans, tree_model

PREDICATES = {"a": "((p_size > 10) AND (p_name ~~ '%re%'::text))", "b": "((p_brand)::text = ANY ('{Brand#11,Brand#12,Brand#23}'::text[]))", "c": "((p_size <= 5) OR (p_type <> 'MEDIUM'::text))"}
TYPES = {"p_size": "number", "p_retailprice": "number", "p_name": "string", "p_brand": "string", "p_type": "string"}
FACTORS = {"cpu": 0.5, "scan": 0.02, "net": 0.01, "seek": 3.0}
SAMPLE = 1000
#: Plans that the tree model learns from, in batches of 64: the first of them train it, the last three tell how good it is.
PLANS, TEST_BATCHES = 1600, 3


def part(spark, d):
    return spark.read.parquet(f"{d}/part.parquet")


def sampled(spark, d):
    return bitmaps.sample(part(spark, d), "p_partkey", SAMPLE)


def packed(rows, n=SAMPLE):
    found = bitmaps.predicate_bitmaps(rows, "p_partkey", PREDICATES, TYPES, n)
    return found.select("name", F.array_join("bits", "").alias("bits"))


def merged(rows, n=SAMPLE):
    b = bitmaps.predicate_bitmaps(rows, "p_partkey", PREDICATES, TYPES, n)
    x = b.agg(*[F.max(F.when(F.col("name") == k, F.col("bits"))).alias(k) for k in PREDICATES])
    return x.select(F.array_join(bitmaps.bit_and(F.col("a"), F.col("c")), "").alias("a_and_c"), F.array_join(bitmaps.bit_or(F.col("a"), F.col("b")), "").alias("a_or_b"), bitmaps.node_bitmap(F.col("a"), F.col("b"), F.col("c")).alias("node"))


def text_nodes(spark, d):
    return text_plans.nodes(plan_corpus.text_plans(spark, d))


def json_nodes(spark, d):
    return json_plans.nodes(plan_corpus.json_plans(spark, d))


def plan_parse(spark, d):
    n = text_nodes(spark, d)
    side = F.coalesce(F.concat(F.lit("("), F.initcap(text_plans.side(F.col("id"))), F.lit(")")), F.lit(""))
    return n.select("plan_id", "pos", "depth", "parent", "operator", F.round(text_plans.milliseconds(text_plans.field_map(F.col("execution"))["time"]), 6).alias("ms"), F.col("act_rows").cast("double").alias("n"), side.alias("mark"), text_plans.task_kind(F.col("task")).alias("task"))


def valid_plans(spark, d):
    """Plans whose projections are taken for merge joins are no valid ones."""
    plans = plan_corpus.text_plans(spark, d).withColumn("plan", F.transform("plan", lambda r: F.replace(r, F.lit("Projection"), F.lit("MergeJoin"))))
    return plans.where(text_plans.valid(F.col("plan"))).select("plan_id")


def concatenated(spark, d):
    x = text_plans.concatenated(text_nodes(spark, d))
    total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v)
    return x.select("plan_id", "n_items", F.size("features").alias("length"), F.round(total, 6).alias("total"))


def calibrated(spark, d):
    n = text_nodes(spark, d)
    return text_plans.cost_weights(n).join(text_plans.labels(n).select("plan_id", "time"), "plan_id")


def calibration(spark, d):
    x = text_plans.calibration(calibrated(spark, d))
    return x.select(*[F.round(F.log1p(c), 6).alias(c) for c in x.columns])


def cost_evaluation(spark, d):
    """(method, r, log_r): how calibrated and learned costs of every fifth plan follow its time, fitted on the others."""
    n = text_nodes(spark, d)
    w = lineage.cut(calibrated(spark, d))
    factors = text_plans.solve(text_plans.calibration(w.where("plan_id % 5 <> 0")).first())
    plain = text_plans.plan_cost(w, factors).join(w.select("plan_id", "time"), "plan_id").where("plan_id % 5 = 0")
    x = lineage.cut(text_plans.feature_array(n).join(w.select("plan_id", "time"), "plan_id"))
    learned = text_plans.learned_cost(x.where("plan_id % 5 <> 0"), x.where("plan_id % 5 = 0"), 5)
    rows = [text_plans.correlation(plain).select(F.lit("calibrated").alias("method"), "r", "log_r"), text_plans.correlation(learned, "est_time").select(F.lit("learned").alias("method"), "r", "log_r")]
    return rows[0].union(rows[1])


TABLES = ("customer", "nation", "orders")


def context(spark, d):
    """Dictionaries of the plans' tables in order of declaration, and bounds of their numeric columns."""
    frames = {t: spark.read.parquet(f"{d}/{t}.parquet") for t in TABLES}
    bounds = {}
    for t, df in frames.items():
        numbers = [f.name for f in df.schema if f.dataType.typeName() in ("integer", "long", "double")]
        one = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}_{k}") for c in numbers for k, f in (("lo", F.min), ("hi", F.max))]).first()  # one row
        bounds.update({f"{t}.{c}": (one[f"{c}_lo"], one[f"{c}_hi"]) for c in numbers if one[f"{c}_lo"] is not None})
    return conditions.Context(TABLES, tuple(f"{t}.{c}" for t, df in frames.items() for c in df.columns), ("customer_pkey", "nation_pkey"), bounds)


def condition_cells(spark, d):
    """(plan_id, pos, operator, n_info, n_bool, n_column, n_compare, number): what the first condition of each node has cells for."""
    ctx = context(spark, d)
    x = conditions.encoded(json_nodes(spark, d), ctx)
    a, b = len(conditions.BOOLEAN), len(conditions.BOOLEAN) + len(ctx.columns)
    c = b + len(conditions.COMPARE)
    count = lambda low, high: F.size(F.filter("condition1", lambda e: (e.idx >= low) & (e.idx < high)))
    number = F.aggregate(F.filter("condition1", lambda e: e.idx == c), F.lit(0.0), lambda s, e: s + e.value)
    return x.select("plan_id", "pos", "operator", F.size("info").alias("n_info"), count(0, a).alias("n_bool"), count(a, b).alias("n_column"), count(b, c).alias("n_compare"), F.round(number, 6).alias("number"))


def tree_evaluation(spark, d):
    """(label, mean, median, greatest) q-errors of a tree model on the last batches of at most PLANS plans, trained on the others."""
    plans = plan_corpus.json_plans(spark, d)
    kept = json_plans.learnable(json_plans.nodes(plans, strict=False), PLANS)
    w = F.row_number().over(Window.orderBy("plan_id")) - 1  # of PLANS rows at most
    plans = plans.join(kept.withColumn("i", w), "plan_id").select(F.col("i").cast("long").alias("plan_id"), "plan")
    n, y = json_plans.nodes(plans), json_plans.labels(plans)
    ctx = conditions.fitted(context(spark, d), json_plans.bounds(n, y).first())
    x = lineage.cut(tree_model.prepared(n, ctx, y))
    last = x.agg(F.max("batch_id")).first()[0]
    test = max(0, (last or 0) + 1 - TEST_BATCHES)
    weights, _ = tree_model.train(x.where(F.col("batch_id") < test), ctx, samples=100, rounds=3)
    out = tree_model.evaluated(x.where(F.col("batch_id") >= test), weights, ctx, samples=100)
    rows = [tree_model.q_errors(out, f"act_{c}", f"est_{c}").select(F.lit(c).alias("label"), "mean", "median", "greatest") for c in ("cost", "cardinality")]
    return rows[0].union(rows[1])


def bounds(spark, d):
    plans = plan_corpus.json_plans(spark, d)
    x = json_plans.bounds(json_plans.nodes(plans), json_plans.labels(plans))
    return x.select("max_nodes", "max_condition", *[F.round(c, 6).alias(c) for c in x.columns[2:]])


def leveled(spark, d):
    return encoding.child_slots(encoding.levels(encoding.batched(json_nodes(spark, d))))


QUERIES = {
    "predicate_filter": lambda s, d: part(s, d).where(predicates.selected(predicates.parse(PREDICATES["a"]), TYPES)).select("p_partkey"),
    "predicate_any": lambda s, d: part(s, d).where(predicates.selected(predicates.parse(PREDICATES["b"]), TYPES)).select("p_partkey", "p_brand"),
    "predicate_or": lambda s, d: part(s, d).where(predicates.selected(predicates.parse(PREDICATES["c"]), TYPES)).select("p_partkey"),
    "not_like": lambda s, d: part(s, d).where(predicates.selected(predicates.parse("(p_name !~~ '%re%'::text)"), TYPES)).select("p_partkey"),
    "is_null": lambda s, d: part(s, d).withColumn("p_name", F.when(F.col("p_size") % 3 != 0, F.col("p_name"))).where(predicates.selected(predicates.parse("(p_name IS NULL)"), TYPES)).select("p_partkey"),
    "sample_rows": lambda s, d: bitmaps.sample(part(s, d), "p_partkey", 100).select("p_partkey"),
    "predicate_bitmaps": lambda s, d: packed(sampled(s, d)),
    "bitmap_and_or": lambda s, d: merged(sampled(s, d)),
    "plan_parse": plan_parse,
    "plan_features": lambda s, d: text_plans.features(text_nodes(s, d)),
    "plan_labels": lambda s, d: text_plans.labels(text_nodes(s, d)).select("plan_id", "est_rows", "act_rows", F.round("time", 6).alias("time")),
    "plan_contains": lambda s, d: text_plans.subtrees(text_nodes(s, d)).select("plan_id", "pos", "has_IndexLookUp", "has_HashJoin", "has_HashAgg", "has_Sort"),
    "plan_concatenated": concatenated,
    "valid_plans": valid_plans,
    "cost_weights": lambda s, d: (w := text_plans.cost_weights(text_nodes(s, d))).select("plan_id", *[F.round(c, 6).alias(c) for c in w.columns[1:]]),
    "plan_cost": lambda s, d: text_plans.plan_cost(text_plans.cost_weights(text_nodes(s, d)), FACTORS).select("plan_id", F.round("cost", 6).alias("cost")),
    "calibration_xtx": calibration,
    "cost_evaluation": cost_evaluation,
    "json_plan_nodes": lambda s, d: json_nodes(s, d).select("plan_id", "pos", "depth", "parent", "node_type", "relation"),
    "json_plan_labels": lambda s, d: json_plans.labels(plan_corpus.json_plans(s, d)),
    "json_plan_sequence": lambda s, d: json_plans.sequences(json_nodes(s, d)).select("plan_id", F.size("seq").alias("n_items"), F.size(F.filter("seq", lambda x: x.isNull())).alias("n_ends")),
    "json_plan_bounds": bounds,
    "learnable_plans": lambda s, d: json_plans.learnable(json_plans.nodes(plan_corpus.json_plans(s, d), strict=False)),
    "seq_levels": lambda s, d: encoding.levels(encoding.batched(json_nodes(s, d))).select("plan_id", "pos", "batch_id", "slot"),
    "child_mapping": lambda s, d: leveled(s, d).select("plan_id", "pos", "left", "right"),
    "batch_widths": lambda s, d: encoding.widths(leveled(s, d)),
    "condition_cells": condition_cells,
    "tree_evaluation": tree_evaluation,
}

_A = "p_size > 10 AND coalesce(p_name, '') LIKE '%re%'"
_B = "coalesce(p_brand, '') IN ('Brand#11', 'Brand#12', 'Brand#23')"
_C = "(p_size <= 5 OR coalesce(p_type, '') <> 'MEDIUM')"


def _sample(n: int) -> str:
    return f"SELECT * FROM part ORDER BY md5('0:' || p_partkey::VARCHAR), p_partkey LIMIT {n}"


def _bits(test: str) -> str:
    return f"(SELECT rpad(string_agg(CASE WHEN {test} THEN '1' ELSE '0' END, '' ORDER BY p_partkey), {SAMPLE}, '0') FROM ({_sample(SAMPLE)}))"


_T = plan_corpus.text_nodes_sql()
_J = plan_corpus.json_nodes_sql()
_SHAPES, _KINDS = len(plan_corpus.SHAPES), len(plan_corpus.JSON_SHAPES)
_FEATURES = ", ".join(f"count(*) FILTER (operator = '{o}') AS \"n_{o}\", coalesce(sum(n) FILTER (operator = '{o}'), 0.0::DOUBLE) AS \"rows_{o}\"" for o in text_plans.OPERATORS)
_WEIGHTS = f"""WITH t AS ({_T}), k AS (SELECT plan_id, parent, min_by(n, pos) AS n1, min_by(size, pos) AS s1, CASE WHEN count(*) > 1 THEN max_by(n, pos) END AS n2, CASE WHEN count(*) > 1 THEN max_by(size, pos) END AS s2, CASE WHEN count(*) > 1 THEN max_by(mark, pos) END AS m2 FROM t WHERE parent IS NOT NULL GROUP BY 1, 2),
x AS (SELECT t.*, coalesce(n1, 0) AS n1, coalesce(s1, 0) AS s1, coalesce(n2, 0) AS n2, coalesce(s2, 0) AS s2, coalesce(m2, '') AS m2 FROM t LEFT JOIN k ON k.plan_id = t.plan_id AND k.parent = t.pos)
SELECT plan_id, sum(CASE operator WHEN 'HashJoin' THEN (CASE WHEN m2 = '(Build)' THEN n2 ELSE n1 END) + n WHEN 'Sort' THEN n1 * log2(greatest(n1, 1.0)) WHEN 'HashAgg' THEN n1 WHEN 'Selection' THEN n1 WHEN 'Projection' THEN n1 ELSE 0.0 END)::DOUBLE AS w_cpu,
  sum(CASE WHEN operator LIKE '%Scan' THEN n * size ELSE 0.0 END)::DOUBLE AS w_scan, sum(CASE WHEN operator LIKE '%Reader' THEN n1 * s1 WHEN operator = 'IndexLookUp' THEN n1 * s1 + n2 * s2 ELSE 0.0 END)::DOUBLE AS w_net,
  sum(CASE WHEN operator = 'IndexLookUp' THEN n1 / 20.0 ELSE 0.0 END)::DOUBLE AS w_seek FROM x GROUP BY plan_id"""
_W = ("w_cpu", "w_scan", "w_net", "w_seek")
_XTX = ", ".join([f"round(ln(1 + sum({a} * {b})), 6) AS {a}_{b}" for i, a in enumerate(_W) for b in _W[i:]] + [f"round(ln(1 + sum({a} * time)), 6) AS {a}_t" for a in _W])
_LEVELS = f"SELECT *, plan_id // 64 AS batch_id, row_number() OVER (PARTITION BY plan_id // 64, depth ORDER BY plan_id, pos)::INTEGER AS slot FROM ({_J})"
_OPERATOR = "CASE node_type " + " ".join(f"WHEN '{k}' THEN {i + 1}" for i, k in enumerate(conditions.PHYSICAL)) + " END"
_NUMBER = "(({v} - (SELECT min({c}) FROM {t})) / ((SELECT max({c}) FROM {t}) - (SELECT min({c}) FROM {t})))"
#: (n_info, n_bool, n_column, n_compare, number) of the nodes, by shape and place.
_CELLS = [
    [(0, 0, 2, 1, "0.0"), (1, 1, 2, 2, _NUMBER.format(v="(plan_id % 40 + 100.5::DOUBLE)", c="o_totalprice", t="orders")), (0, 0, 0, 0, "0.0"), (1, 0, 0, 0, "0.0")],
    [(1, 0, 0, 0, "0.0"), (0, 0, 2, 1, "0.0"), (1, 1, 2, 2, _NUMBER.format(v="(plan_id % 40 + 100.0::DOUBLE)", c="c_acctbal", t="customer")), (1, 0, 0, 0, "0.0")],
    [(1, 0, 1, 1, _NUMBER.format(v="(plan_id % 40 + 100.0::DOUBLE)", c="c_acctbal", t="customer"))],
    [(0, 0, 0, 0, "0.0"), (1, 0, 0, 0, "0.0")],
]
_CELL = lambda i: "CASE " + " ".join(f"WHEN plan_id % {_KINDS} = {k} AND pos = {p} THEN {x[i]}" for k, shape in enumerate(_CELLS) for p, x in enumerate(shape)) + " END"
_TIME = plan_corpus.JSON_TIME.replace("c_custkey", "plan_id")
_ROWS = plan_corpus.JSON_ROWS.replace("c_custkey", "plan_id")

ORACLES = {
    "predicate_filter": f"SELECT p_partkey FROM part WHERE {_A}",
    "predicate_any": f"SELECT p_partkey, p_brand FROM part WHERE {_B}",
    "predicate_or": f"SELECT p_partkey FROM part WHERE {_C}",
    "not_like": "SELECT p_partkey FROM part WHERE coalesce(p_name, '') NOT LIKE '%re%'",
    "is_null": "SELECT p_partkey FROM part WHERE p_size % 3 = 0 OR coalesce(p_name, '') = ''",
    "sample_rows": f"SELECT p_partkey FROM ({_sample(100)})",
    "predicate_bitmaps": f"SELECT 'a' AS name, {_bits(_A)} AS bits UNION ALL SELECT 'b', {_bits(_B)} UNION ALL SELECT 'c', {_bits(_C)}",
    "bitmap_and_or": f"SELECT {_bits(f'{_A} AND {_C}')} AS a_and_c, {_bits(f'({_A}) OR {_B}')} AS a_or_b, {_bits(f'{_A} AND {_B} AND {_C}')} AS node",
    "plan_parse": f"SELECT plan_id, pos, depth, parent, operator, ms, n, mark, CASE WHEN operator LIKE '%Scan' OR operator = 'Selection' THEN 'kv' ELSE 'root' END AS task FROM ({_T})",
    "plan_features": f"SELECT plan_id, count(*) AS n_nodes, {_FEATURES} FROM ({_T}) GROUP BY plan_id",
    "plan_labels": f"SELECT plan_id, n AS est_rows, n AS act_rows, ms AS time FROM ({_T}) WHERE pos = 0",
    "plan_contains": f"WITH RECURSIVE t AS ({_T}), c AS (SELECT plan_id, pos AS top, pos FROM t UNION ALL SELECT c.plan_id, c.top, t.pos FROM c JOIN t ON t.plan_id = c.plan_id AND t.parent = c.pos) SELECT c.plan_id, c.top AS pos, " + ", ".join(f"bool_or(t.operator = '{o}') AS \"has_{o}\"" for o in ("IndexLookUp", "HashJoin", "HashAgg", "Sort")) + " FROM c JOIN t ON t.plan_id = c.plan_id AND t.pos = c.pos GROUP BY 1, 2",
    "plan_concatenated": f"SELECT plan_id, (2 * count(*))::INTEGER AS n_items, {2 * max(map(len, plan_corpus.SHAPES)) * (len(text_plans.KINDS) + 1)} AS length, round(sum(1.0::DOUBLE + ln(1 + n)), 6) AS total FROM ({_T}) GROUP BY plan_id",
    "valid_plans": f"SELECT o_orderkey AS plan_id FROM orders WHERE o_orderkey % {_SHAPES} <> {_SHAPES - 1}",
    "cost_weights": f"SELECT plan_id, {', '.join(f'round({w}, 6) AS {w}' for w in _W)} FROM ({_WEIGHTS})",
    "plan_cost": f"SELECT plan_id, round({' + '.join(f'w_{k} * {v}::DOUBLE' for k, v in FACTORS.items())}, 6) AS cost FROM ({_WEIGHTS})",
    "calibration_xtx": f"SELECT {_XTX} FROM ({_WEIGHTS}) JOIN (SELECT plan_id, ms AS time FROM ({_T}) WHERE pos = 0) USING (plan_id)",
    "json_plan_nodes": f"SELECT plan_id, pos, depth, parent, node_type, relation FROM ({_J})",
    "json_plan_labels": f"SELECT plan_id, {_TIME}::DOUBLE AS cost, {_ROWS}::DOUBLE AS cardinality FROM (SELECT c_custkey AS plan_id FROM customer)",
    "json_plan_sequence": f"SELECT plan_id, (2 * count(*))::INTEGER AS n_items, count(*)::INTEGER AS n_ends FROM ({_J}) GROUP BY plan_id",
    "json_plan_bounds": f"SELECT 4::BIGINT AS max_nodes, 6 AS max_condition, round(ln(min({_TIME})), 6) AS min_cost, round(ln(max({_TIME})), 6) AS max_cost, round(ln(min({_ROWS})), 6) AS min_cardinality, round(ln(max({_ROWS})), 6) AS max_cardinality FROM (SELECT c_custkey AS plan_id FROM customer)",
    "learnable_plans": f"SELECT c_custkey AS plan_id FROM customer WHERE c_custkey % {_KINDS} < 2",
    "seq_levels": f"SELECT plan_id, pos, batch_id, slot FROM ({_LEVELS})",
    "child_mapping": f"WITH l AS ({_LEVELS}), k AS (SELECT plan_id, parent, min(slot) AS a, CASE WHEN count(*) > 1 THEN max(slot) END AS b FROM l WHERE parent IS NOT NULL GROUP BY 1, 2) SELECT l.plan_id, l.pos, coalesce(k.a, 0) AS \"left\", coalesce(k.b, 0) AS \"right\" FROM l LEFT JOIN k ON k.plan_id = l.plan_id AND k.parent = l.pos",
    "batch_widths": f"SELECT batch_id, count(*) AS n_levels, max(n) AS width FROM (SELECT batch_id, depth, max(slot) AS n FROM ({_LEVELS}) GROUP BY 1, 2) GROUP BY 1",
    "condition_cells": f"SELECT plan_id, pos, {_OPERATOR} AS operator, {_CELL(0)} AS n_info, {_CELL(1)} AS n_bool, {_CELL(2)} AS n_column, {_CELL(3)} AS n_compare, round({_CELL(4)}, 6) AS number FROM ({_J})",
}
