"""Textual plan trees as node tables, their features and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("id", "est_rows", "est_cost", "act_rows", "task", "access", "execution", "info", "memory", "disk")
#: Operators in the order in which an id is held against them.
OPERATORS = ("HashAgg", "HashJoin", "Sort", "Selection", "Projection", "TableReader", "TableRangeScan", "TableFullScan", "TableRowIDScan", "IndexReader", "IndexRangeScan", "IndexFullScan", "IndexLookUp")
#: Kinds of operators in features of learned costs.
KINDS = ("Projection", "Selection", "Sort", "HashAgg", "HashJoin", "TableScan", "IndexScan", "TableReader", "IndexReader", "IndexLookUp")
FACTORS = ("cpu", "scan", "net", "seek")


def nodes(plans: DataFrame) -> DataFrame:
    """(plan_id, pos, depth, parent, operator, fields...) from plans(plan_id, plan array of tab-separated rows with a header)."""
    x = plans.select("plan_id", F.posexplode(F.slice("plan", F.lit(2), F.greatest(F.size("plan") - 1, F.lit(0)))).alias("pos", "row"))
    f = F.split("row", "\t")
    x = x.select("plan_id", "pos", *[f.getItem(i).alias(n) for i, n in enumerate(FIELDS)])
    blank = F.translate("id", "├─│└", "    ")
    x = x.withColumn("depth", F.length(blank) - F.length(F.ltrim(blank))).withColumn("id", F.trim(blank))
    operator = F.coalesce(*[F.when(F.col("id").contains(o), F.lit(o)) for o in OPERATORS])
    before = Window.partitionBy("plan_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.collect_list(F.struct("pos", "depth")).over(before)
    return x.withColumn("operator", operator).withColumn("_e", earlier).withColumn("parent", F.array_max(F.transform(F.filter("_e", lambda e: e.depth < F.col("depth")), lambda e: e.pos))).drop("_e")


def task_kind(task):
    """root for the server that gathers, kv for the storage nodes."""
    return F.when(task.contains("root"), F.lit("root")).when(task.contains("cop"), F.lit("kv"))


def side(id_):
    """Which input of its join a node is, if its id says so."""
    return F.when(id_.contains("(Build)"), F.lit("build")).when(id_.contains("(Probe)"), F.lit("probe"))


def labels(n: DataFrame) -> DataFrame:
    """(plan_id, est_rows, est_cost, act_rows, time): the root's estimates and actual rows, and the plan's milliseconds."""
    root = n.where("pos = 0")
    return root.select("plan_id", *[F.col(c).cast("double").alias(c) for c in ("est_rows", "est_cost", "act_rows")], milliseconds(field_map(F.col("execution"))["time"]).alias("time"))


def valid(plan):
    """Whether an array of plan rows can be learned from: no empty table, index join or merge join in it."""
    return plan.isNotNull() & ~F.coalesce(F.exists(plan, lambda r: r.rlike("TableDual|IndexJoin|MergeJoin")), F.lit(False))


def subtrees(n: DataFrame) -> DataFrame:
    """Nodes with has_<operator>: whether the node or one below it is such an operator. A plan's nodes meet in one row."""
    every = n.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("pos", "depth", "operator"))).alias("_all"))
    x = n.join(every, "plan_id")
    after = F.filter("_all", lambda e: (e.pos > F.col("pos")) & (e.depth <= F.col("depth")))
    x = x.withColumn("_end", F.coalesce(F.get(after, F.lit(0)).pos, F.lit(1 << 30)))
    below = F.filter("_all", lambda e: (e.pos >= F.col("pos")) & (e.pos < F.col("_end")))
    has = lambda o: F.exists(below, lambda e: F.coalesce(e.operator == o, F.lit(False)))
    return x.select(*n.columns, *[has(o).alias(f"has_{o}") for o in ("IndexLookUp", "HashJoin", "HashAgg", "Sort")])


def known(operator):
    """The operator's name, or an error for one outside OPERATORS."""
    return F.when(operator.isNull(), F.raise_error(F.lit("unknown operator in a plan")).cast("string")).otherwise(operator)


def concatenated(n: DataFrame) -> DataFrame:
    """(plan_id, n_items, features): nodes depth first, each a one-hot of its kind and ln(1 + estimated rows), zeros where a node's children end.

    All plans get the length of the longest, two items for each of its nodes.
    """
    kind = F.when(F.col("operator").startswith("Table") & F.col("operator").endswith("Scan"), "TableScan").when(F.col("operator").endswith("Scan"), "IndexScan").otherwise(F.col("operator"))
    width = len(KINDS) + 1
    own = F.concat(F.transform(F.array(*map(F.lit, KINDS)), lambda k: F.coalesce((k == kind).cast("double"), F.lit(0.0))), F.array(F.log1p(F.coalesce(F.col("est_rows").cast("double"), F.lit(0.0)))))
    # a node's parts end with as many pads as subtrees end behind it
    x = n.withColumn("_v", own).select("plan_id", "pos", "depth", "_v", F.coalesce(F.lead("depth").over(Window.partitionBy("plan_id").orderBy("pos")), F.lit(-1)).alias("_next"))
    every = x.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("pos", "depth", "_next", "_v"))).alias("_all"))
    zero = F.array_repeat(F.lit(0.0), width)
    ends = lambda e: F.size(F.filter("_all", lambda a: (a.pos <= e.pos) & (a.depth >= e._next) & ~F.exists("_all", lambda b: (b.pos > a.pos) & (b.pos <= e.pos) & (b.depth <= a.depth))))
    x = every.select("plan_id", F.flatten(F.transform("_all", lambda e: F.concat(F.array(e._v), F.array_repeat(zero, ends(e))))).alias("items"))
    most = x.agg(F.max(F.size("items")).alias("most"))  # one row
    x = x.join(F.broadcast(most))
    pad = F.array_repeat(zero, F.col("most") - F.size("items"))
    return x.select("plan_id", F.size("items").alias("n_items"), F.flatten(F.concat("items", pad)).alias("features"))


def milliseconds(text):
    """Milliseconds of a duration in ns, µs, ms, s or m."""
    number = F.regexp_extract(text, r"^([0-9.]+)", 1).cast("double")
    unit = F.regexp_extract(text, r"^[0-9.]+(.*)$", 1)
    return number * F.when(unit == "ns", 1e-6).when(unit.isin("µs", "us"), 1e-3).when(unit == "ms", 1.0).when(unit == "m", 60000.0).otherwise(1000.0)


def field_map(text):
    """Map of k:v pieces of a comma-separated list; pieces without exactly one colon are left out, the last of a key counts."""
    pieces = F.filter(F.transform(F.split(text, ","), lambda p: F.split(p, ":")), lambda p: F.size(p) == 2)
    pairs = F.transform(pieces, lambda p: F.struct(F.trim(p[0]).alias("k"), F.trim(p[1]).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p.k))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p.k == k), -1).v))


def features(n: DataFrame) -> DataFrame:
    """(plan_id, n_nodes, n_<operator>, rows_<operator>) per plan."""
    rows = F.col("est_rows").cast("double")
    aggs = [a for o in OPERATORS for a in (F.count_if(F.col("operator") == o).alias(f"n_{o}"), F.coalesce(F.sum(F.when(F.col("operator") == o, rows)), F.lit(0.0)).alias(f"rows_{o}"))]
    return n.groupBy("plan_id").agg(F.count("*").alias("n_nodes"), *aggs)


def cost_weights(n: DataFrame) -> DataFrame:
    """(plan_id, w_cpu, w_scan, w_net, w_seek): how often each cost factor is paid, by the operators' formulas; an unknown operator is an error."""
    rows = F.coalesce(F.col("act_rows").cast("double"), F.lit(0.0))
    size = F.coalesce(F.regexp_extract("info", r"row_size:\s*([0-9.]+)", 1).try_cast("double"), F.lit(0.0))
    x = n.select("plan_id", "pos", "parent", "id", known(F.col("operator")).alias("operator"), rows.alias("rows"), size.alias("size"), F.coalesce(F.regexp_extract("info", r"batch_size:\s*([0-9.]+)", 1).try_cast("double"), F.lit(1.0)).alias("batch"))
    kids = x.where("parent is not null").groupBy("plan_id", F.col("parent").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "rows", "size"))).alias("kids"))
    x = x.join(kids, ["plan_id", "pos"], "left")
    first, second = F.try_element_at("kids", F.lit(1)), F.try_element_at("kids", F.lit(2))
    in_rows, in_size = F.coalesce(first.rows, F.lit(0.0)), F.coalesce(first.size, F.lit(0.0))
    flip = F.coalesce(second.id.contains("Build"), F.lit(False))
    build = F.when(flip, second.rows).otherwise(in_rows)
    o = F.col("operator")
    cpu = F.when(o == "HashJoin", build + F.col("rows")).when(o == "Sort", in_rows * F.log2(F.greatest(in_rows, F.lit(1.0)))).when(o.isin("HashAgg", "Selection", "Projection"), in_rows)
    scan = F.when(o.endswith("Scan"), F.col("rows") * F.col("size"))
    other_rows, other_size = F.coalesce(second.rows, F.lit(0.0)), F.coalesce(second.size, F.lit(0.0))
    net = F.when(o.isin("TableReader", "IndexReader"), in_rows * in_size).when(o == "IndexLookUp", in_rows * in_size + other_rows * other_size)
    seek = F.when(o == "IndexLookUp", in_rows / F.col("batch"))
    return x.groupBy("plan_id").agg(*[F.sum(F.coalesce(e, F.lit(0.0))).alias(a) for a, e in (("w_cpu", cpu), ("w_scan", scan), ("w_net", net), ("w_seek", seek))])


def plan_cost(weights: DataFrame, factors: dict[str, float]) -> DataFrame:
    """(plan_id, cost): weights times factors, by name."""
    cost = F.lit(0.0)
    for f in FACTORS:
        cost = cost + F.col(f"w_{f}") * F.lit(float(factors[f]))
    return weights.select("plan_id", cost.alias("cost"))


def learned_cost(train: DataFrame, test: DataFrame, iterations: int = 30, seed: int = 7) -> DataFrame:
    """test(plan_id, features, time) with est_time, by boosted trees fitted to train's logarithms of time, which weighs errors relative to time."""
    from planwise.operators import learned

    model = learned.gbt(train.where("time > 0").withColumn("label", F.log("time")), iterations, seed=seed)
    return learned.predicted(model, test, "est_time")


def feature_array(n: DataFrame) -> DataFrame:
    """(plan_id, features) of features() as one array, rows as logarithms."""
    f = features(n)
    return f.select("plan_id", F.array(*[F.log1p(F.col(c).cast("double")) if c.startswith("rows_") else F.col(c).cast("double") for c in f.columns[1:]]).alias("features"))


def correlation(costs: DataFrame, cost: str = "cost", time: str = "time"):
    """One row: the correlation of estimated costs with times, plain and of logarithms."""
    log = lambda c: F.log(F.greatest(F.col(c), F.lit(1e-9)))
    return costs.agg(F.corr(cost, time).alias("r"), F.corr(log(cost), log(time)).alias("log_r"))


def calibration(weights: DataFrame, time: str = "time") -> DataFrame:
    """The 14 sums of the normal equations of time on the four weights, in one aggregation."""
    w = ["w_cpu", "w_scan", "w_net", "w_seek"]
    pairs = [(a, b) for i, a in enumerate(w) for b in w[i:]]
    return weights.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs], *[F.sum(F.col(a) * F.col(time)).alias(f"{a}_t") for a in w])


def solve(sums) -> dict[str, float]:
    """Factors of least squares without a negative one, from calibration()'s row: a 4 by 4 system."""
    import numpy as np

    w = ["w_cpu", "w_scan", "w_net", "w_seek"]
    active = [a for a in w if (sums[f"{a}_{a}"] or 0) > 0]
    while active:
        m = np.array([[sums[f"{min(a, b, key=w.index)}_{max(a, b, key=w.index)}"] for b in active] for a in active], dtype=float)
        x = np.linalg.lstsq(m, np.array([sums[f"{a}_t"] for a in active], dtype=float), rcond=None)[0]
        if (x >= 0).all():
            return {a[2:]: float(dict(zip(active, x, strict=True)).get(a, 0.0)) for a in w}
        active.pop(int(x.argmin()))
    return {a[2:]: 0.0 for a in w}
