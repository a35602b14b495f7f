"""Readers, sinks, predicate text, bitmaps and JSON plans on small worked examples."""

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from planwise.operators import bitmaps, predicates
from planwise.plan_queries import QUERIES
from planwise.plans import json_plans
from planwise.sources import readers, sinks


def test_statistics_file(spark, tmp_path):
    text = lambda v: base64.b64encode(str(v).encode()).decode()
    raw = {"database_name": "d", "table_name": "t", "count": 9, "modify_count": 0, "columns": {"x": {"null_count": 1, "tot_col_size": 8, "correlation": 0.5, "histogram": {"ndv": 3, "buckets": [{"count": 4, "lower_bound": text(-2), "upper_bound": text(3), "repeats": 1}]}, "cm_sketch": {"top_n": [{"data": "A4AAAAAAAAAH", "count": 2}, {"data": base64.b64encode(b"\x03\x7f" + b"\xff" * 7).decode(), "count": 3}]}}, "y": {"null_count": 0, "tot_col_size": 0, "correlation": 0.0, "histogram": {"ndv": 0, "buckets": []}, "cm_sketch": None}}}
    path = tmp_path / "s.json"
    path.write_text(json.dumps(raw))
    summary, hist, top = readers.table_statistics(spark, str(path), ["x"])
    assert [tuple(r) for r in summary.collect()] == [("t", "x", 9, 1, 8, 0.5, 3)]
    assert [tuple(r) for r in hist.collect()] == [("x", 0, 4, -2, 3, 1)]
    assert sorted(tuple(r) for r in top.collect()) == [("x", -1, 3), ("x", 7, 2)]
    path.write_text(json.dumps({**raw, "modify_count": 4}))
    with pytest.raises(Exception, match="stale"):
        readers.table_statistics(spark, str(path), ["x"])[0].collect()


def test_ragged_rows_never_count(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1,,3\n4,5\n7,8,9,10\n11,12,13\n")
    got = readers.integer_sample(spark, str(tmp_path / "x.csv"), "a int, b int, c int", ["a", "b"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0), (11, 12)] and got.count() == 2


def test_movie_schema_and_json_lines(spark, tmp_path):
    assert len(readers.MOVIE_TABLES) == 21 and readers.movie_schema("role_type") == "id int, role string"
    (tmp_path / "p.json").write_text('null\n[{"Plan": {}}]\n')
    assert readers.json_plan_lines(spark, str(tmp_path / "p.json")).count() == 1


def test_report(spark):
    m = spark.createDataFrame([("avi", 1.0, 2.0, 3.456, 4.0)], "method string, p50 double, p80 double, p90 double, p99 double")
    assert [r.line for r in sinks.report_lines(m).collect()][2] == "| avi | 1.00 | 2.00 | 3.46 | 4.00 |"


@pytest.mark.parametrize("text", ["((a > 1) AND ((b)::text ~~ '%x''y%'::text) AND (c IS NOT NULL))", "(NOT (a = 1.5))", "((a = 1) OR ((a < 3) AND (b <> 'q'::text)))"])
def test_sequence_round_trip(text):
    tree = predicates.parse(text)
    assert predicates.rebuild(predicates.sequence(tree)) == tree


def test_parser_cases():
    assert predicates.parse("(5 < a)") == predicates.Compare("a", ">", 5)
    assert predicates.parse("((x)::text = ANY ('{u,v}'::text[]))") == predicates.Compare("x", "any", ("u", "v"))
    assert predicates.parse(None) is None and predicates.parse("  ") is None
    assert predicates.qualified(predicates.parse("(t.a = b)"), {"t": "title"}, "r") == predicates.Compare("title.a", "=", predicates.Word("r.b"))
    for bad in ("(a >", "(a = 1", "a = 1 b", "a ? 1"):
        with pytest.raises(ValueError):
            predicates.parse(bad)


@pytest.mark.parametrize(("text", "want"), [("n = 3", [1]), ("n <> 3", [2, 3]), ("n < 4", [1, 3]), ("n IS NULL", [3]), ("s = ''", [2, 3]), ("s ~~ 'a_%'", [1]), ("s ~~ '%.'", []), ("s !~~ 'a%'", [2, 3]), ("s IS NULL", [2, 3]), ("s < 'b'", [1, 2, 3]), ("NOT (n = 3 OR s = '')", [])])
def test_missing_values(spark, text, want):
    rows = spark.createDataFrame([(1, 3.0, "a_b"), (2, 9.0, ""), (3, None, None)], "id int, n double, s string")
    got = rows.where(predicates.selected(predicates.parse(text), {"n": "number", "s": "string"}))
    assert sorted(r.id for r in got.collect()) == want


def test_strict_follows_sql(spark):
    rows = spark.createDataFrame([(1, 3.0), (2, None)], "id int, n double")
    assert rows.where(predicates.selected(predicates.parse("n <> 4"), {"n": "number"}, strict=True)).count() == 1


def test_bitmaps(spark):
    rows = spark.range(5).withColumnRenamed("id", "k")
    b = {r["name"]: r.bits for r in bitmaps.predicate_bitmaps(rows, "k", {"p": "k > 2", "q": "k = k"}, {"k": "number"}, 7).collect()}
    assert b == {"p": [0, 0, 0, 1, 1, 0, 0], "q": []}
    one = spark.range(1).select(F.array(F.lit(1), F.lit(0)).alias("a"), F.array(F.lit(1), F.lit(1)).alias("b"), F.array().cast("array<int>").alias("e"))
    got = one.select(bitmaps.bit_and(F.col("a"), F.col("b")), bitmaps.bit_or(F.col("a"), F.col("b")), bitmaps.bit_and(F.col("a"), F.col("e")), bitmaps.node_bitmap(F.col("a"), F.col("b"))).first()
    assert tuple(got) == ([1, 0], [1, 1], [1, 0], "10")
    found = spark.createDataFrame([(1, 0, [1, 0]), (1, 0, [1, 1])], "plan_id int, pos int, bits array<int>")
    nodes = spark.createDataFrame([(1, 0), (1, 1)], "plan_id int, pos int")
    assert {r.pos: r.bitmap for r in bitmaps.add_bitmaps(nodes, found).collect()} == {0: "10", 1: None}


@pytest.mark.parametrize("n", [1500, 600])
def test_bitmaps_of_the_whole_sample(spark, tmp_path, n):
    rows = [(k, None if k % 11 == 0 else ("red" if k % 3 else "blue"), None if k % 13 == 0 else f"Brand#{10 + k % 15}", None if k % 17 == 0 else ("MEDIUM" if k % 4 else "SMALL"), None if k % 19 == 0 else k % 50, 1.0) for k in range(n)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").repartition(3).write.parquet(f"{tmp_path}/part.parquet")
    order = sorted((hashlib.md5(f"0:{k}".encode()).hexdigest(), k) for k in range(n))[:1000]
    kept = [rows[k] for k in sorted(k for _, k in order)]
    assert len({r[0] % 7 for r in kept}) == 7
    a = [(r[4] is None or r[4] > 10) and "re" in (r[1] or "") for r in kept]  # a missing number passes all but =
    b = [r[2] in ("Brand#11", "Brand#12", "Brand#23") for r in kept]
    c = [r[4] is None or r[4] <= 5 or r[3] != "MEDIUM" for r in kept]
    bits = lambda x: "".join("01"[y] for y in x).ljust(1000, "0")
    got = {r["name"]: r.bits for r in QUERIES["predicate_bitmaps"](spark, str(tmp_path)).collect()}
    assert got == {"a": bits(a), "b": bits(b), "c": bits(c)}
    m = QUERIES["bitmap_and_or"](spark, str(tmp_path)).first()
    assert (m.a_and_c, m.a_or_b, m.node) == (bits(x and z for x, z in zip(a, c)), bits(x or y for x, y in zip(a, b)), bits(x and y and z for x, y, z in zip(a, b, c)))


def test_samples(spark):
    rows = spark.range(1000)
    a, b = (sorted(r.id for r in bitmaps.sample(rows, "id", 50, 3).collect()) for _ in range(2))
    assert a == b and len(set(a)) == 50
    assert 50 < bitmaps.fraction_sample(rows, "id").count() < 300 and bitmaps.fraction_sample(spark.range(7), "id").count() == 7


PLAN = [{"Plan": {"Node Type": "Aggregate", "Strategy": "Plain", "Actual Total Time": 30.0, "Actual Rows": 1, "Plans": [
    {"Node Type": "Hash Join", "Hash Cond": "(o.o_custkey = c.c_custkey)", "Actual Total Time": 25.5, "Actual Rows": 40, "Plans": [
        {"Node Type": "Seq Scan", "Relation Name": "orders", "Alias": "o", "Filter": "((o_totalprice > 100.5) AND (o_orderstatus = 'F'::text))"},
        {"Node Type": "Hash", "Plans": [{"Node Type": "Index Scan", "Relation Name": "customer", "Alias": "c", "Index Name": "customer_pkey", "Index Cond": "(c_custkey < 90)"}]}]}]}}]


def test_json_plan(spark):
    plan = spark.createDataFrame([(1, json.dumps(PLAN)), (2, "null")], "plan_id long, plan string")
    n = {r.pos: r for r in json_plans.nodes(plan).collect()}
    assert [(n[i].node_type, n[i].depth, n[i].parent) for i in range(4)] == [("Hash Join", 0, None), ("Seq Scan", 1, 0), ("Hash", 1, 0), ("Index Scan", 2, 2)]
    assert json.loads(n[0].condition)[0] == {"op_type": "Compare", "operator": "=", "left_value": "orders.o_custkey", "right_value": "customer.c_custkey"}
    seq = json_plans.sequences(json_plans.nodes(plan)).first().seq
    assert [s is None for s in seq] == [False, False, True, False, False, True, True, True]
    assert tuple(json_plans.labels(plan).first()) == (1, 25.5, 40.0)
    assert json_plans.bounds(json_plans.nodes(plan), json_plans.labels(plan)).first().max_condition == 6
    odd = spark.createDataFrame([(3, json.dumps([{"Plan": {"Node Type": "Sort", "Sort Key": ["o.o_orderkey DESC"], "Plans": [{"Node Type": "Custom Scan", "Relation Name": "orders", "Alias": "o"}]}}]))], "plan_id long, plan string")
    with pytest.raises(Exception, match="Custom Scan"):
        json_plans.nodes(odd).collect()
    assert json_plans.nodes(odd, strict=False).first()["keys"] == ["orders.o_orderkey"] and json_plans.learnable(json_plans.nodes(odd, strict=False)).count() == 0


def test_lines_are_numbered_in_order(spark, tmp_path):
    for f in range(2):
        (tmp_path / f"{f}.json").write_text("".join("null\n" if i % 4 == 0 else f'[{{"Plan": {{"Node Type": "{f}-{i}"}}}}]\n' for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        x = readers.json_plan_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 2  # splits of files
        got = sorted((r.plan_id, r.plan) for r in x.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [i for i, _ in got] == list(range(600)) and [json.loads(p)[0]["Plan"]["Node Type"] for _, p in got] == [f"{f}-{i}" for f in range(2) for i in range(400) if i % 4]


def test_bounds_batches_and_pictures(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"t": {"x": {"min": 1, "max": 9, "count": 5, "table": "t"}}}))
    assert [tuple(r) for r in readers.column_bounds(spark, str(tmp_path / "b.json")).collect()] == [("t", "x", 1.0, 9.0, 5)]
    sinks.batches(spark.range(300).withColumn("batch_id", F.floor(F.col("id") / 64)), str(tmp_path / "batches"))
    assert readers.batches(spark, str(tmp_path / "batches"), 1, 2).count() == 128
    sinks.scatter(spark.createDataFrame([(1.0, 2.0), (10.0, 0.0), (None, 1.0)], "a double, e double"), "a", "e", str(tmp_path / "p.svg"))
    assert (tmp_path / "p.svg").read_text().count("<circle") == 2
