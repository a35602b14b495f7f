"""Plans made from tables, one for each order or customer, and the SQL that says what they hold.

These plans have the shapes and fields of a database's textual and JSON plans, and numbers from the
rows, so plan queries run over whole tables and SQL knows their nodes without parsing any text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "id\testRows\testCost\tactRows\ttask\taccess object\texecution info\toperator info\tmemory\tdisk"
_SCAN = "(o_orderkey % 97 + 3)"
_OTHER = "(o_custkey % 53 + 2)"
#: Nodes of each shape, depth first: drawn prefix, operator, mark, parent, rows (SQL over orders), access object.
SHAPES = [
    [("", "TableReader", "", None, _SCAN, ""), ("└─", "Selection", "", 0, _SCAN, ""), ("  └─", "TableFullScan", "", 1, f"{_SCAN} * 10", "table:a")],
    [("", "IndexLookUp", "", None, _SCAN, ""), ("├─", "IndexRangeScan", "(Build)", 0, _SCAN, "table:a, index:i"), ("└─", "TableRowIDScan", "(Probe)", 0, _SCAN, "table:a")],
    [("", "Sort", "", None, _OTHER, ""), ("└─", "HashAgg", "", 0, _OTHER, ""), ("  └─", "TableReader", "", 1, _SCAN, ""), ("    └─", "TableFullScan", "", 2, _SCAN, "table:b")],
    [("", "HashJoin", "", None, f"{_SCAN} + {_OTHER}", ""), ("├─", "TableReader", "(Build)", 0, _OTHER, ""), ("│ └─", "TableFullScan", "", 1, _OTHER, "table:a"), ("└─", "IndexReader", "(Probe)", 0, _SCAN, ""), ("  └─", "IndexFullScan", "", 3, _SCAN, "table:b, index:j")],
    [("", "Projection", "", None, f"{_SCAN} + {_OTHER}", ""), ("└─", "HashJoin", "", 0, f"{_SCAN} + {_OTHER}", ""), ("  ├─", "TableReader", "(Probe)", 1, _SCAN, ""), ("  │ └─", "TableRangeScan", "", 2, _SCAN, "table:b"), ("  └─", "TableReader", "(Build)", 1, _OTHER, ""), ("    └─", "TableFullScan", "", 4, _OTHER, "table:a")],
]
_SIZE = "(o_orderkey % 5 + 8)"
#: Milliseconds of the nodes by their place, and the text of such a time.
_TIMES = [("(o_orderkey % 1000 + 1)", "ms", 1.0), ("(o_orderkey % 700 + 1)", "µs", 1e-3), ("(o_orderkey % 90 + 1)", "ns", 1e-6), ("(o_orderkey % 3 + 1)", "s", 1000.0)]


def _time(place: int) -> tuple[str, str, float]:
    return _TIMES[place % len(_TIMES)]


def text_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan_id, plan): a textual plan for each order, its shape by the order's key."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    # two numbers become a hundred times their size: they are dealt out first, as a small table is one split
    orders = orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    plans = []
    for shape in SHAPES:
        lines = [F.lit(HEADER)]
        for i, (prefix, op, mark, _, rows, access) in enumerate(shape):
            t, unit, _ = _time(i)
            task = "cop[tikv]" if op.endswith("Scan") or op == "Selection" else "root"
            text = lambda e: F.expr(f"cast({e} as string)")
            info = F.concat(F.lit("eq:[a b], row_size: "), text(_SIZE), F.lit(", batch_size: 20" if op == "IndexLookUp" else ""))
            lines.append(F.concat_ws("\t", F.lit(f"{prefix}{op}_{i + 1}{mark}"), text(rows), F.lit("0"), text(rows), F.lit(task), F.lit(access), F.concat(F.lit("time:"), text(t), F.lit(f"{unit}, loops:2, cop_task: {{num: 9, max: 1ms}}")), info, F.lit("0"), F.lit("0")))
        plans.append(F.array(*lines))
    plan = F.lit(None)
    for k, p in enumerate(plans):  # only the row's own shape is made
        plan = F.when(F.col("o_orderkey") % len(SHAPES) == k, p).otherwise(plan)
    return orders.select(F.col("o_orderkey").alias("plan_id"), plan.alias("plan"))


def text_nodes_sql() -> str:
    """SQL of the plans' nodes: plan_id, pos, depth, parent, operator, n (rows), size, ms, mark."""
    parts = []
    for k, shape in enumerate(SHAPES):
        for i, (prefix, op, mark, parent, rows, _) in enumerate(shape):
            t, _, ms = _time(i)
            parts.append(f"SELECT o_orderkey AS plan_id, {i}::INTEGER AS pos, {len(prefix)}::INTEGER AS depth, {'NULL' if parent is None else parent}::INTEGER AS parent, '{op}' AS operator, ({rows})::DOUBLE AS n, {_SIZE}::DOUBLE AS size, round({t}::DOUBLE * {ms}::DOUBLE, 6) AS ms, '{mark}' AS mark FROM orders WHERE o_orderkey % {len(SHAPES)} = {k}")
    return " UNION ALL ".join(parts)


_AMOUNT, _KEY = "(c_custkey % 40 + 100)", "(c_custkey % 90 + 5)"
#: JSON plans by shape, with the places of numbers; the third has no join.
JSON_SHAPES = [
    '[{"Plan": {"Node Type": "Aggregate", "Strategy": "Plain", "Actual Total Time": 9e9, "Actual Rows": 1, "Plans": [{"Node Type": "Hash Join", "Hash Cond": "(o.o_custkey = c.c_custkey)", "Actual Total Time": <T>, "Actual Rows": <R>, "Plans": [{"Node Type": "Seq Scan", "Relation Name": "orders", "Alias": "o", "Filter": "((o_totalprice > <A>.5) AND (o_orderstatus = \'F\'::text))"}, {"Node Type": "Hash", "Plans": [{"Node Type": "Index Scan", "Relation Name": "customer", "Alias": "c", "Index Name": "customer_pkey", "Index Cond": "(c_custkey < <K>)"}]}]}]}}]',
    '[{"Plan": {"Node Type": "Sort", "Sort Key": ["c.c_acctbal"], "Actual Total Time": <T>, "Actual Rows": <R>, "Plans": [{"Node Type": "Merge Join", "Merge Cond": "(c.c_nationkey = n.n_nationkey)", "Plans": [{"Node Type": "Seq Scan", "Relation Name": "customer", "Alias": "c", "Filter": "(((c_mktsegment)::text ~~ \'%A%\'::text) OR (c_acctbal <= <A>))"}, {"Node Type": "Index Scan", "Relation Name": "nation", "Alias": "n", "Index Name": "nation_pkey", "Index Cond": "(n_nationkey >= 2)"}]}]}}]',
    '[{"Plan": {"Node Type": "Seq Scan", "Relation Name": "customer", "Alias": "customer", "Filter": "(c_acctbal > <A>)", "Actual Total Time": <T>, "Actual Rows": <R>}}]',
    '[{"Plan": {"Node Type": "Limit", "Actual Total Time": <T>, "Actual Rows": <R>, "Plans": [{"Node Type": "Seq Scan", "Relation Name": "nation", "Alias": "n"}]}}]',
]
JSON_TIME, JSON_ROWS = "((c_custkey % 500) * 2 + 1)", "(c_custkey % 300 + 1)"
#: Nodes of each shape, depth first: type, relation, depth, parent.
JSON_NODES = [
    [("Hash Join", None, 0, None), ("Seq Scan", "orders", 1, 0), ("Hash", None, 1, 0), ("Index Scan", "customer", 2, 2)],
    [("Sort", None, 0, None), ("Merge Join", None, 1, 0), ("Seq Scan", "customer", 2, 1), ("Index Scan", "nation", 2, 1)],
    [("Seq Scan", "customer", 0, None)],
    [("Limit", None, 0, None), ("Seq Scan", "nation", 1, 0)],
]


def json_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan_id, plan): a JSON plan for each customer, its shape by the customer's key."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    plan = F.element_at(F.array(*map(F.lit, JSON_SHAPES)), (F.col("c_custkey") % len(JSON_SHAPES) + 1).cast("int"))
    for mark, e in (("<T>", JSON_TIME), ("<R>", JSON_ROWS), ("<A>", _AMOUNT), ("<K>", _KEY)):
        plan = F.replace(plan, F.lit(mark), F.expr(f"cast({e} as string)"))
    return customers.select(F.col("c_custkey").alias("plan_id"), plan.alias("plan"))


def json_nodes_sql() -> str:
    """SQL of the plans' nodes: plan_id, pos, depth, parent, node_type, relation."""
    parts = []
    for k, shape in enumerate(JSON_NODES):
        for i, (kind, relation, depth, parent) in enumerate(shape):
            name = f"'{relation}'" if relation else "NULL::VARCHAR"
            parts.append(f"SELECT c_custkey AS plan_id, {i}::INTEGER AS pos, {depth}::INTEGER AS depth, {'NULL' if parent is None else parent}::INTEGER AS parent, '{kind}' AS node_type, {name} AS relation FROM customer WHERE c_custkey % {len(JSON_SHAPES)} = {k}")
    return " UNION ALL ".join(parts)
