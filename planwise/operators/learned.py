"""Learned cardinalities: query features, log labels, regressors, and how far they are off on train and test queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planwise.operators import estimate

#: Training queries of the neural network, by their ids; it is fitted in memory.
MOST_QUERIES = 20_000
BATCH = 10


def scaled(v: Column, low: Column, high: Column) -> Column:
    """(v - low) / (high - low) within 0 and 1; 0 where the range is empty."""
    share = (v - low) / F.nullif(high - low, F.lit(0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share.cast("double"), F.lit(0.0))))


def features(ranges: DataFrame, summary: DataFrame, shares: DataFrame, columns: list[str]) -> DataFrame:
    """(query_id, features): each column's bounds scaled to its values (0 and 1 where the query has none), then the three combined selectivities.

    ranges: (query_id, column, lo, hi); summary: (column, min_v, max_v); shares: estimate.shares().
    """
    x = ranges.join(F.broadcast(summary.where(F.col("column").isin(columns)).select("column", "min_v", "max_v")), "column")  # one row per column
    x = x.select("query_id", "column", *[scaled(F.coalesce(s, m), F.col("min_v"), F.col("max_v")).alias(s) for s, m in (("lo", "min_v"), ("hi", "max_v"))])
    side = lambda c, s, none: F.coalesce(F.max(F.when(F.col("column") == c, F.col(s))), F.lit(none))
    x = x.groupBy("query_id").agg(F.array(*[side(c, s, none) for c in columns for s, none in (("lo", 0.0), ("hi", 1.0))]).alias("bounds"))
    return x.join(shares, "query_id").select("query_id", F.concat("bounds", F.array("avi", "ebo", "min_sel")).alias("features"))


def labelled(x: DataFrame, counts: DataFrame) -> DataFrame:
    """Features with act_rows and label, the logarithm of act_rows; queries without rows go, as they have no logarithm."""
    return x.join(counts.where("act_rows > 0"), "query_id").withColumn("label", F.log("act_rows"))


def log_loss(act: Column, est: Column) -> Column:
    """Mean squared difference of logarithms."""
    return F.avg(F.pow(F.log(act) - F.log(F.greatest(est, F.lit(1.0))), F.lit(2.0)))


def gbt(train: DataFrame, iterations: int = 30, depth: int = 5, seed: int = 7, weight: str | None = None):
    """Boosted trees on labelled(); give the fitted model to predicted()."""
    x = train.withColumn("vector", array_to_vector("features"))
    model = GBTRegressor(featuresCol="vector", labelCol="label", maxIter=iterations, maxDepth=depth, seed=seed)
    return (model.setWeightCol(weight) if weight else model).fit(x)


def predicted(model, x: DataFrame, name: str = "est") -> DataFrame:
    """x with the estimate of a fitted model of boosted trees."""
    out = model.transform(x.withColumn("vector", array_to_vector("features")))
    return out.withColumn(name, F.exp("prediction")).drop("vector", "prediction")


def mlp(train: DataFrame, hidden: tuple[int, ...] = (64, 32), rounds: int = 60, seed: int = 7, most: int = MOST_QUERIES) -> dict[str, np.ndarray]:
    """Weights of a network of rectified layers on labelled(), by Adam on batches of BATCH; fitted on the first `most` queries by id."""
    t = train.select("query_id", "features", "label").orderBy("query_id").limit(min(most, MOST_QUERIES)).toArrow()
    x, y = np.array(t.column("features").to_pylist(), dtype=np.float64), t.column("label").to_numpy()
    r = np.random.default_rng(seed)
    sizes = [x.shape[1] if len(x) else 1, *hidden, 1]
    w = {}
    for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
        w[f"w{i}"], w[f"b{i}"] = r.normal(size=(a, b)) * np.sqrt(2 / a), np.zeros(b)
    if not len(x):
        return w
    w[f"b{len(hidden)}"][:] = y.mean()
    m, v, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    for _ in range(rounds):
        order = r.permutation(len(x))
        for at in range(0, len(x), BATCH):
            own, step = order[at : at + BATCH], step + 1
            layers = [x[own]]
            for i in range(len(sizes) - 1):
                z = layers[-1] @ w[f"w{i}"] + w[f"b{i}"]
                layers.append(np.maximum(z, 0) if i < len(sizes) - 2 else z)
            d = 2 * (layers[-1] - y[own, None]) / len(own)
            for i in reversed(range(len(sizes) - 1)):
                g = {f"w{i}": layers[i].T @ d, f"b{i}": d.sum(axis=0)}
                d = (d @ w[f"w{i}"].T) * (layers[i] > 0)
                for k, a in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.999 * v[k] + 0.001 * a * a
                    w[k] -= 0.002 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w


def mlp_output(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    layers = len(w) // 2
    for i in range(layers):
        x = x @ w[f"w{i}"] + w[f"b{i}"]
        if i < layers - 1:
            x = np.maximum(x, 0)
    return x[:, 0]


def mlp_predicted(w: dict[str, np.ndarray], x: DataFrame, name: str = "est") -> DataFrame:
    """x with the network's estimate; its weights are of a fixed size."""
    model = x.sparkSession.sparkContext.broadcast(w)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series(np.exp(np.minimum(mlp_output(model.value, np.array(p.tolist(), dtype=np.float64)), 50.0)) if len(p) else [], dtype="float64")

    return x.withColumn(name, run("features"))


def evaluation(x: DataFrame, methods: list[str], group: list[str]) -> DataFrame:
    """(group..., method, p50, p80, p90, p99) of the p-errors of the estimates in columns `methods` against act_rows."""
    e = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), estimate.p_error(F.col("act_rows").cast("double"), F.col(m)).alias("e")) for m in methods]))
    return estimate.percentiles(x.select(*group, e.alias("x")).select(*group, "x.*"), [*group, "method"], "e")


def save_weights(spark: SparkSession, weights: dict[str, np.ndarray], path: str) -> None:
    """A model's arrays as Parquet, a row each. Models of Spark's own have their writers."""
    rows = [(k, list(a.shape), a.astype(float).ravel().tolist()) for k, a in weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data array<double>").write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r.name: np.array(r.data).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}  # one model's arrays
