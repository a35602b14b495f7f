"""Every engine query against its SQL on the smallest tables, and worked examples."""

import os

import duckdb
import pytest

from planwise.plans import text_plans
from planwise.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect())))
    want = con.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({ORACLES[name]}) q").fetchall()
    assert rows == sorted(map(repr, want))


PLAN = [
    "id\testRows\testCost\tactRows\ttask\taccess object\texecution info\toperator info\tmemory\tdisk",
    "HashJoin_1\t10\t0\t8\troot\t\ttime:12.5ms, loops:2\tinner join\t0\t0",
    "├─Sort_2(Build)\t4\t0\t4\troot\t\ttime:3ms\trow_size: 8\t0\t0",
    "│ └─TableReader_3\t4\t0\t4\troot\t\ttime:2ms\trow_size: 8\t0\t0",
    "│   └─TableFullScan_4\t4\t0\t4\tcop[tikv]\ttable:a\ttime:900µs\trow_size: 8\t0\t0",
    "└─Selection_5(Probe)\t6\t0\t6\troot\t\ttime:1s\trow_size: 16\t0\t0",
    "  └─TableRangeScan_6\t9\t0\t9\tcop[tikv]\ttable:b\ttime:500ns\trow_size: 16\t0\t0",
]


@pytest.fixture(scope="module")
def plan_nodes(spark):
    return text_plans.nodes(spark.createDataFrame([(1, PLAN)], "plan_id int, plan array<string>"))


def test_plan_tree(plan_nodes):
    parents = {r.pos: r.parent for r in plan_nodes.collect()}
    assert parents == {0: None, 1: 0, 2: 1, 3: 2, 4: 0, 5: 4}


def test_cost_weights_of_the_plan(plan_nodes):
    w = text_plans.cost_weights(plan_nodes).first()
    assert (w.w_cpu, w.w_scan, w.w_net, w.w_seek) == (4 + 8 + 4 * 2 + 9, 4 * 8 + 9 * 16, 4 * 8, 0)
    assert text_plans.plan_cost(text_plans.cost_weights(plan_nodes), {"cpu": 1, "scan": 2, "net": 3, "seek": 4}).first().cost == 29 + 2 * 176 + 3 * 32


def test_unknown_operator_is_an_error(spark):
    n = text_plans.nodes(spark.createDataFrame([(1, [PLAN[0], "StreamAgg_1\t1\t0\t1\troot\t\ttime:1ms\t\t0\t0"])], "plan_id int, plan array<string>"))
    with pytest.raises(Exception, match="unknown operator"):
        text_plans.cost_weights(n).collect()


def test_concatenated_features_of_the_plan(spark, plan_nodes):
    r = text_plans.concatenated(plan_nodes).first()
    width = len(text_plans.KINDS) + 1
    items = [r.features[i : i + width] for i in range(0, len(r.features), width)]
    kinds = [text_plans.KINDS[x.index(1.0)] if 1.0 in x[:-1] else None for x in items]
    assert kinds == ["HashJoin", "Sort", "TableReader", "TableScan", None, None, None, "Selection", "TableScan", None, None, None]
    assert r.n_items == 12


def test_estimates_are_ordered(spark):
    for r in QUERIES["estimates"](spark, SF).collect():
        assert r.min_sel >= r.ebo >= r.avi >= 0
