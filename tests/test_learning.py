"""Workloads, prefix sums, sum-product networks, regressors, condition vectors, the tree model and captured plans."""

import json
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from planwise import serving
from planwise.operators import buckets, estimate, learned, spn, stats, workloads
from planwise.plans import capture, conditions, json_plans, tree_model


def test_running_total_and_percentiles(spark):
    r = random.Random(3)
    rows = [(g, v, r.randint(1, 9)) for g in ("a", "b", None) for v in sorted(r.sample(range(-1000, 100_000), 300))] + [("c", 5, 2), ("d", 1 << 60, 1), ("d", 0, 4), ("d", 1, 3)]
    df = spark.createDataFrame(rows, "g string, v long, n long").repartition(4)
    want, total = {}, {}
    for g, v, n in sorted(rows, key=lambda x: (str(x[0]), x[1])):
        total[g] = total.get(g, 0) + n
        want[g, v] = total[g]
    assert {(x.g, x.v): x.upto for x in stats.running_total(df, ["g"], "v", "n", "upto").collect()} == want
    values = [r.choice([0.0, 1.5, 2.5, 1e9, 7.0, 8.0]) for _ in range(501)]
    p = estimate.percentiles(spark.createDataFrame([("m", v) for v in values], "method string, e double"), ["method"], "e").first()
    assert (p.p50, p.p80, p.p90, p.p99) == tuple(sorted(values)[int(501 * q)] for q in (0.5, 0.8, 0.9, 0.99))


def test_buckets_follow_the_columns(spark):
    values = np.random.default_rng(1).zipf(1.6, size=2000) % 60
    own = buckets.build(values, 5)
    df = spark.createDataFrame([(int(v),) for v in values], "x long")
    hist = stats.histogram(stats.value_counts(df, ["x"]), 5)
    assert sorted(tuple(r) for r in hist.select("row_count", "lower", "upper", "repeats").collect()) == sorted(own)
    asked = spark.createDataFrame([(i, "x", lo, hi) for i, (lo, hi) in enumerate([(0, 5), (3, 4), (-9, 200), (58, 59), (None, 7), (20, None), (1, 2)])], "query_id int, column string, lo long, hi long")
    ndv = len(np.unique(values))
    for r in estimate.selectivities(asked, df, ["x"], 5).join(asked, ["query_id", "column"]).collect():
        low, high = own[0][1] if r.lo is None else r.lo + 1, own[-1][2] + 1 if r.hi is None else r.hi
        assert r.sel == pytest.approx(min(max(buckets.between_rows(own, low, high, ndv) / 2000, 0), 1)), r
    assert serving.answer("/cardinality", b"junk", {}, {})["selectivity"] is None


def test_selectivities_hold_no_column_in_one_row(spark):
    df = spark.range(20_000).select(F.col("id").alias("x"))
    asked = spark.createDataFrame([(0, "x", 100, 5000), (1, "x", 9_999, 30_000)], "query_id int, column string, lo long, hi long")
    got = estimate.selectivities(asked, df, ["x"])
    assert not any(word in got._jdf.queryExecution().toString() for word in ("collect_list", "array_sort"))
    assert {r.query_id: r.sel for r in got.collect()} == {0: pytest.approx((5000 - 101 / 1999 * 1999) / 20_000), 1: 0.5}


def test_workloads(spark):
    domains = {"a": (0, 10), "b": (100, 400), "c": (0, 7), "d": (-5, 5), "e": (0, 1000)}
    q = workloads.random_ranges(spark, 300, domains, "db.t")
    assert sorted(map(tuple, q.collect())) == sorted(map(tuple, workloads.random_ranges(spark, 300, domains, "db.t").collect()))
    found = estimate.parse_ranges(q)
    per = {}
    for r in found.collect():
        lo, hi = domains[r.column]
        assert lo <= r.lo <= r.hi <= hi
        per.setdefault(r.query_id, []).append(r.column)
    assert len(per) == 300 and {len(c) for c in per.values()} == {1, 2, 3, 4}
    assert tuple(q.select(*estimate.parse_table(F.col("query"))).first()) == ("db", "t")
    names = {r.query_id: r.columns for r in estimate.column_names(found).collect()}
    assert names == {i: sorted(c) for i, c in per.items()}
    rows = spark.createDataFrame([(i % 10, 100 + i % 300, i % 7, i % 10 - 5, i % 1000) for i in range(2000)], list(domains))
    counts = {r.query_id: r.act_rows for r in workloads.range_counts(rows, found, 64).collect()}
    local = rows.toPandas()
    for i in range(0, 300, 37):
        m = np.ones(len(local), bool)
        for r in (r for r in found.where(F.col("query_id") == i).collect()):
            m &= (local[r.column] > r.lo) & (local[r.column] < r.hi)
        assert counts[i] == m.sum()
    one = spark.createDataFrame([("SELECT /*+ A() */ x /* b */ FROM t USE INDEX(i) WHERE y",), ("SELECT 1",)], ["q"])
    assert [r[0] for r in one.select(workloads.strip_hints(F.col("q"))).collect()] == ["SELECT  x /* b */ FROM t  WHERE y", "SELECT 1"]
    junk = spark.createDataFrame([(1, "select nothing"), (2, "")], "query_id int, query string")
    assert estimate.parse_ranges(junk).count() == 0


def test_sum_product_network(spark):
    r = np.random.default_rng(2)
    a = r.integers(0, 100, size=3000)
    rows = np.stack([a, a // 10 + r.integers(0, 2, size=3000), r.integers(0, 50, size=3000)], axis=1)
    assert spn.split_columns(spn.correlations(rows)) == ([0, 1], [2])
    assert spn.split_columns(np.array([[1, -0.9], [-0.9, 1]])) == ([0], [1])
    assert spn.split_columns(np.ones((2, 2))) is None and spn.split_columns(np.ones((2, 2)), force=True) == ([0], [1])
    assert spn.split_rows(np.full((5, 2), 3)) is None
    second = spn.split_rows(np.array([[0, 0], [1, 0], [100, 9], [101, 9]]))
    assert second.tolist() in ([False, False, True, True], [True, True, False, False])
    root = spn.construct(rows, ("a", "b", "c"), 100)
    assert root.kind == "product" and {n[2] for n in spn.node_rows(root)} == {"sum", "product", "leaf"}
    assert spn.estimate(root, {}) == 1.0
    for lo, hi, low, high in ((10, 40, 0, 3), (-1, 100, 5, 9), (70, 99, 2, 5)):
        true = ((rows[:, 0] > lo) & (rows[:, 0] < hi) & (rows[:, 1] > low) & (rows[:, 1] < high)).mean()
        assert abs(spn.estimate(root, {"a": (lo, hi), "b": (low, high)}) - true) < 0.03
    leaf = lambda c, n, values: spn.Node("leaf", (c,), n, [], buckets.build(np.array(values), 5), len(set(values)))
    mix = spn.Node("sum", ("a",), 10, [leaf("a", 3, [1, 2, 3]), leaf("a", 7, [5] * 7)])
    assert spn.estimate(mix, {"a": (4, 6)}) == pytest.approx(0.7)
    assert spn.construct(np.full((300, 2), 4), ("a", "b")).kind == "product"
    df = spark.createDataFrame([(i, int(x), None if i % 50 == 0 else int(y), int(z)) for i, (x, y, z) in enumerate(rows)], "k long, a long, b long, c long")
    asked = spark.createDataFrame([(1, "a", 10, 40), (1, "b", None, 3), (2, "c", None, None)], "query_id int, column string, lo long, hi long")
    got = {r.query_id: r.spn for r in spn.estimates(spn.build(df, "k", ["a", "b", "c"], 2000), asked, 3000).collect()}
    assert got[2] == 3000 and 0 < got[1] < 1200


def test_network_of_all_rows(spark):
    r = np.random.default_rng(6)
    a = r.integers(0, 1000, size=6000)
    rows = np.stack([a, a // 10 + r.integers(0, 9, size=6000), r.integers(0, 50, size=6000), 3 * a + r.integers(0, 700, size=6000)], axis=1)
    names = ("a", "b", "c", "d")
    df = spark.createDataFrame([tuple(map(int, x)) for x in rows], ", ".join(f"{c} long" for c in names)).repartition(5)
    whole, root = spn.construct(rows, names, 600), spn.fit(df, list(names), tolerance=0)
    assert root.rows == 6000 and {n[2] for n in spn.node_rows(root)} == {"sum", "product", "leaf"}
    shape = lambda n: (n.kind, n.columns, n.rows, [shape(c) for c in n.children])
    assert shape(root) == shape(whole)
    asked = [(1, "a", 100, 400), (1, "b", None, 30), (2, "c", None, None), (3, "d", 500, None), (3, "c", 7, 40), (3, "a", 30, 31), (4, "z", 1, 2)]
    got = {r.query_id: r.spn for r in spn.fitted_estimates(root, spark.createDataFrame(asked, "query_id int, column string, lo long, hi long"), df, list(names)).collect()}
    for q in (1, 2, 3, 4):
        assert got[q] == pytest.approx(6000 * spn.estimate(whole, {c: (lo, hi) for i, c, lo, hi in asked if i == q})), q
    odd = spark.createDataFrame([(4, None)] * 300, "a long, b long")
    for table, want in ((odd, 300.0), (odd.limit(0), 0.0)):
        ask = spark.createDataFrame([(1, "a", 3, 5), (2, "b", 0, 5)], "query_id int, column string, lo long, hi long")
        assert {r.query_id: r.spn for r in spn.fitted_estimates(spn.fit(table, ["a", "b"]), ask, table, ["a", "b"]).collect()} == {1: want, 2: 0.0}


def test_cardinality_evaluation_takes_no_sample(spark, monkeypatch):
    from planwise import queries
    from planwise.operators import bitmaps

    class Seen(Exception):
        pass

    def refused(*_, **__):
        raise AssertionError("a sample")

    def stop(root, *_):
        raise Seen(root.rows)

    monkeypatch.setattr(bitmaps, "sample", refused)
    monkeypatch.setattr(spn, "fitted_estimates", stop, raising=False)
    d = "/root/testdata/sf0.001"
    with pytest.raises(Seen) as seen:
        queries.cardinality_evaluation(spark, d)
    assert seen.value.args[0] == spark.read.parquet(f"{d}/lineitem.parquet").count()


def test_regressors(spark, tmp_path):
    r = np.random.default_rng(5)
    x = r.uniform(size=(600, 4))
    rows = [(i, [float(v) for v in u], float(round(np.exp(1 + 3 * u[0] + 2 * u[1] * u[2])))) for i, u in enumerate(x)]
    df = learned.labelled(spark.createDataFrame([(i, f) for i, f, _ in rows], "query_id int, features array<double>"), spark.createDataFrame([(i, a) for i, _, a in rows] + [(9999, 0.0)], "query_id int, act_rows double"))
    train, test = df.where("query_id < 500"), df.where("query_id >= 500")
    w = learned.mlp(train, rounds=60)
    learned.save_weights(spark, w, str(tmp_path / "w"))
    back = learned.load_weights(spark, str(tmp_path / "w"))
    assert set(back) == set(w) and all(np.array_equal(back[k], w[k]) for k in w)
    out = learned.mlp_predicted(back, learned.predicted(learned.gbt(train, 20), test, "gbt"), "mlp")
    got = {r.method: r.p50 for r in learned.evaluation(out.withColumn("part", F.lit("test")), ["gbt", "mlp"], ["part"]).collect()}
    assert got["gbt"] < 1.4 and got["mlp"] < 1.4
    assert out.select(learned.log_loss(F.col("act_rows"), F.col("mlp"))).first()[0] < 0.1


CTX = conditions.Context(("t", "u"), ("t.a", "t.s", "u.b"), ("t_pkey",), {"t.a": (0.0, 10.0), "u.b": (5.0, 5.0)}, prefixes={"t.s": "p_"}, most_items=6)


def test_condition_vectors():
    item = lambda left, op, right: {"op_type": "Compare", "operator": op, "left_value": left, "right_value": right}
    c, v = 2 + 3, 2 + 3 + 9
    assert conditions.item_cells(CTX, {"op_type": "Bool", "operator": "OR"}, None) == {1: 1.0} and conditions.item_cells(CTX, None, None) == {}
    assert conditions.item_cells(CTX, item("a", "<=", 4), "t") == {2: 1.0, c + 8: 1.0, v: 0.4}
    assert conditions.item_cells(CTX, item("t.a", "=", "u.b"), None) == {2: 1.0, 4: 1.0, c: 1.0}
    assert conditions.item_cells(CTX, item("u.b", ">", 5), None) == {4: 1.0, c + 1: 1.0}
    assert conditions.item_cells(CTX, item("s", "=", None), "t") == {3: 1.0, c + 6: 1.0, v: 1.0} and conditions.item_cells(CTX, item("s", "!=", None), "t") == {3: 1.0, c + 6: 1.0}
    like = conditions.item_cells(CTX, item("s", "like", "%ab%c"), "t")
    assert like[c + 4] == 1.0 and sum(x for i, x in like.items() if i >= v) == pytest.approx((len({*"p_ab"}) + len({*"p_c"})) / 2)
    some = conditions.item_cells(CTX, item("s", "any", ["x", "y"]), "t")
    assert some[c] == 1.0 and max(i for i in some) < CTX.width
    assert conditions.item_cells(CTX, item("a", "any", ["2", "4"]), "t")[v] == pytest.approx(0.3)
    with pytest.raises(ValueError, match="unknown column"):
        conditions.item_cells(CTX, item("z", "=", 1), "t")
    assert conditions.info(CTX, "Seq Scan", "u", None, []) == [2] and conditions.info(CTX, "Index Scan", None, "t_pkey", []) == [1] and conditions.info(CTX, "Sort", None, None, ["t.s", "u.b"]) == [2, 3]
    m = conditions.dense([{"item": 1, "idx": 3, "value": 0.5}], 2, 5)
    assert m.shape == (2, 5) and m.sum() == m[1, 3] == 0.5


def plans(spark, n):
    r = random.Random(4)
    rows = []
    for i in range(n):
        x = r.randint(0, 10)
        scan = {"Node Type": "Seq Scan", "Relation Name": "t", "Alias": "t", "Filter": f"(a > {x})"}
        plan = {"Node Type": "Hash Join", "Hash Cond": "(t.a = u.b)", "Actual Total Time": 5.0 * 1.6**x, "Actual Rows": 2 * 1.3**x, "Plans": [scan, {"Node Type": "Hash", "Plans": [{"Node Type": "Seq Scan", "Relation Name": "u", "Alias": "u"}]}]}
        rows.append((i, json.dumps([{"Plan": plan}])))
    return spark.createDataFrame(rows, "plan_id long, plan string")


def test_tree_model_learns(spark):
    df = plans(spark, 200)
    n, y = json_plans.nodes(df), json_plans.labels(df)
    ctx = conditions.fitted(CTX, json_plans.bounds(n, y).first())
    assert ctx.most_items == 2 and ctx.most_nodes == 4
    x = tree_model.prepared(n, ctx, y).cache()
    w, losses = tree_model.train(x, ctx, samples=4, rounds=40, rate=0.02)
    assert losses[-1] < 0.3 * losses[0]
    out = tree_model.evaluated(x, w, ctx, 4)
    assert out.count() == 200
    q = tree_model.q_errors(out, "act_cost", "est_cost").first()
    assert 1 <= q.median <= q["mean"] <= q.greatest and q.median < 2
    assert tree_model.q_error(np.array([0.5]), np.array([0.0]), 0.0, 2.0) == pytest.approx(np.e)


def test_gradients():
    r = np.random.default_rng(1)
    batch = pd.DataFrame([(0, 0, 0, 1, 3, [1], [{"item": 0, "idx": 2, "value": 1.0}], [], True, "10", 1, 2, 0.4, 0.2), (0, 1, 1, 1, 7, [], [], [], False, None, 0, 0, 0.4, 0.2), (0, 2, 1, 2, 8, [2], [], [{"item": 1, "idx": 5, "value": 0.5}], True, None, 0, 0, 0.4, 0.2)], columns=["plan_id", "pos", "depth", "slot", "operator", "info", "condition1", "condition2", "masked", "bitmap", "left", "right", "cost", "cardinality"])
    ctx = conditions.Context(("t",), ("t.a", "t.b"), (), most_items=2)
    w = {k: a + 0.01 * r.normal(size=a.shape) for k, a in tree_model.fresh_weights(ctx, 2, 3, 4).items()}
    levels = tree_model.arrays(batch, ctx, 2)

    def loss(w):
        own = {k: tree_model.Var(a) for k, a in w.items()}
        a, b = tree_model.forward(levels, own)
        return own, tree_model.plus(tree_model.times(a, a), b)

    own, out = loss(w)
    tree_model.backward(out)
    for k in ("t_h", "t_x", "c_h", "cond", "sample", "cost_1", "cardinality_2b", "c_b"):
        i = tuple(r.integers(0, s) for s in w[k].shape)
        up, down = ({n: a.copy() for n, a in w.items()} for _ in range(2))
        up[k][i] += 1e-5
        down[k][i] -= 1e-5
        slope = (loss(up)[1].value - loss(down)[1].value)[0, 0] / 2e-5
        assert own[k].grad[i] == pytest.approx(slope, abs=1e-7, rel=1e-4), k


def test_captured_plans(spark):
    df = spark.range(1000).where("id % 10 = 3").groupBy((F.col("id") % 5).alias("k")).count()
    assert "Aggregate" in capture.explained(df) and capture.estimated(df)[1] > 0
    slow = spark.range(10**12).select(F.sum(F.sin("id")))
    began = time.time()
    found = dict(capture.analyzed(spark, {"slow": slow, "fast": df}, 3.0))
    assert found["slow"] is None and time.time() - began < 60
    assert any(line.split("\t")[3] == "100" for line in found["fast"][1:]) and found["fast"][1].split("\t")[3] == "1"
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
