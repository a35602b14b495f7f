import json
import threading
import urllib.request

from pyspark.sql import functions as F

from planwise import serving
from planwise.operators import estimate
from planwise.plans import encoding


def test_levels_of_two_plans(spark):
    rows = [(p, i, d, par) for p in (0, 1) for i, d, par in ((0, 0, None), (1, 1, 0), (2, 2, 1), (3, 1, 0))] + [(64, 0, 0, None)]
    n = spark.createDataFrame(rows, "plan_id int, pos int, depth int, parent int")
    got = {(r.plan_id, r.pos): (r.batch_id, r.slot, r.left, r.right) for r in encoding.child_slots(encoding.levels(encoding.batched(n))).collect()}
    assert got[0, 0] == (0, 1, 1, 2) and got[1, 0] == (0, 2, 3, 4) and got[1, 1] == (0, 3, 2, 0) and got[1, 3] == (0, 4, 0, 0) and got[64, 0] == (1, 1, 0, 0)


def test_vectors(spark):
    one = spark.createDataFrame([(2, None, "aab")], "a int, b int, s string")
    r = one.select(encoding.one_hot(F.col("a"), 3).alias("x"), encoding.one_hot(F.col("b"), 2).alias("y"), encoding.many_hot(F.array(F.lit(1), F.lit(3)), 3).alias("z"), encoding.character_vector(F.col("s")).alias("c"), encoding.normalized(F.lit(5.0), F.lit(0.0), F.lit(10.0)).alias("n"), encoding.normalized(F.lit(5.0), F.lit(1.0), F.lit(1.0)).alias("m"), encoding.padded(F.array(F.array(F.lit(1.0))), F.lit(3), 1).alias("p")).first()
    assert (r.x, r.y, r.z, sum(r.c), r.n, r.m, r.p) == ([0, 1, 0], [0, 0], [1, 0, 1], 2.0, 0.5, 0.0, [[1.0], [0.0], [0.0]])


def test_served_estimates():
    stats = {"a": [(10, 0, 10, 1), (20, 11, 11, 10)]}
    assert serving.selectivity(stats, {"a": [None, None]}) == 1.0 and serving.selectivity(stats, {"a": [10, 12]}) == 0.5
    s = serving.server(0, stats, {"cpu": 2.0})
    threading.Thread(target=s.serve_forever, daemon=True).start()
    try:
        ask = lambda path, body: json.load(urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{s.server_port}{path}", json.dumps(body).encode()), timeout=5))
        assert ask("/cost", {"weights": {"cpu": 3}}) == {"cost": 6.0, "err_msg": ""}
        assert ask("/cardinality", {"ranges": {"z": [1, 2]}})["err_msg"] and ask("/other", {}) == ""
    finally:
        s.shutdown()


def test_warnings():
    assert serving.used(["cost(Sort)=3.5 set successfully", "selectivity set successfully"]) == (True, True)
    assert serving.used(["cost(Sort)=0 set successfully"]) == (False, False)


def test_top_values_count_in_estimates(spark):
    hist = spark.createDataFrame([("a", 0, 10, 0, 10, 1), ("a", 1, 20, 11, 20, 1)], "column string, bucket int, row_count long, lower long, upper long, repeats long")
    top = spark.createDataFrame([("a", 5, 70), ("a", 30, 10), ("b", 7, 100)], "column string, v long, n long")
    summary = spark.createDataFrame([("a", 100, 22), ("b", 100, 1)], "column string, row_count long, ndv long")
    asked = spark.createDataFrame([(1, "a", 4, 6), (2, "a", 5, 30), (3, "a", None, None), (4, "b", 6, 8), (5, "b", 7, None), (6, "a", 20, None)], "query_id int, column string, lo long, hi long")
    got = {r.query_id: r.sel for r in estimate.known_selectivities(asked, summary, hist, top).collect()}
    assert abs(got[1] - 0.709) < 1e-9 and got[3] == got[4] == 1.0 and got[5] == 0.0 and abs(got[6] - 0.1) < 0.01
    assert 0 < got[2] < 0.2
    assert {tuple(r) for r in estimate.column_bounds(hist, top).collect()} == {("a", 0, 30), ("b", 7, 7)}
    stats, hot = {"a": [(10, 0, 10, 1), (20, 11, 20, 1)], "b": []}, {"a": [(5, 70), (30, 10)], "b": [(7, 100)]}
    assert serving.selectivity(stats, {"a": [None, None]}, hot) == 1.0 and serving.selectivity(stats, {"a": [20, None]}, hot) == 0.1
    assert serving.selectivity(stats, {"a": [4, 6]}, hot) > 0.7 and serving.selectivity(stats, {"b": [6, 8]}, hot) == 1.0
    assert json.loads(json.dumps(serving.answer("/cardinality", b'{"ranges": {"b": [6, 8]}}', stats, {}, hot)))["selectivity"] == 1.0
