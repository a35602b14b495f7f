"""Plans of this engine's own queries, as textual plan rows: explained, or run with a time limit."""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

HEADER = "id\testRows\testCost\tactRows\ttask\taccess object\texecution info\toperator info\tmemory\tdisk"
#: Plan nodes that only pass rows on.
WRAPPERS = ("InputAdapter", "WholeStageCodegen", "ColumnarToRow", "AdaptiveSparkPlan", "ReusedExchange")


def explained(df: DataFrame, mode: str = "cost") -> str:
    """Spark's own text of a query's plan with its estimates; the query does not run."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def estimated(df: DataFrame) -> tuple[float | None, float]:
    """(rows, bytes) that the optimizer expects of a query; None for rows where it has no statistics."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    rows = stats.rowCount()
    return (float(str(rows.get())) if rows.isDefined() else None), float(str(stats.sizeInBytes()))


def operator(name: str) -> str:
    """The textual plans' name of one of Spark's plan nodes, or its own without blanks."""
    for start, found in (("Scan", "TableFullScan"), ("FileScan", "TableFullScan"), ("Filter", "Selection"), ("Project", "Projection"), ("Exchange", "TableReader"), ("BroadcastExchange", "TableReader"), ("HashAggregate", "HashAgg"), ("BroadcastHashJoin", "HashJoin"), ("ShuffledHashJoin", "HashJoin"), ("Sort", "Sort")):
        if name == start or name.startswith(f"{start} "):
            return found
    return name.replace(" ", "")


def _lines(plan, ms: float) -> list[str]:
    """A physical plan's rows; a node without a row count of its own has its input's."""
    found: list[dict] = []

    def walk(node, depth: int) -> int | None:
        name = str(node.nodeName())
        if any(name.startswith(w) for w in WRAPPERS):
            return next((walk(node.children().apply(i), depth) for i in range(node.children().size())), None)
        own = {"name": operator(name), "depth": depth}
        found.append(own)
        metric = node.metrics().get("numOutputRows")
        below = [walk(node.children().apply(i), depth + 1) for i in range(node.children().size())]
        own["rows"] = int(metric.get().value()) if metric.isDefined() else next((b for b in below if b is not None), 0)
        return own["rows"]

    walk(plan, 0)
    out = [HEADER]
    for i, x in enumerate(found):
        place = "  " * (x["depth"] - 1) + "└─" if x["depth"] else ""
        out.append(f"{place}{x['name']}_{i + 1}\t{x['rows']}\t0\t{x['rows']}\troot\t\t{f'time:{ms:.3f}ms' if i == 0 else ''}\trow_size: 8\t0\t0")
    return out


def analyzed(spark: SparkSession, queries: dict[str, DataFrame], seconds: float = 4.0) -> list[tuple[str, list[str] | None]]:
    """(name, plan rows) of each query after it ran, with actual rows and the whole query's time; None for one that the time limit stopped.

    Adaptive planning is off meanwhile, so that the plan is the one that ran.
    """
    context, was = spark.sparkContext, spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    out: list[tuple[str, list[str] | None]] = []
    try:
        for name, df in queries.items():
            again = df.select("*")  # a plan of its own, made under this setting
            tag, late = f"analyze-{uuid.uuid4().hex}", threading.Event()

            def stop(tag=tag, late=late):
                late.set()
                context.cancelJobGroup(tag)

            timer = threading.Timer(seconds, stop)
            context.setJobGroup(tag, name, interruptOnCancel=True)
            began = time.time()
            timer.start()
            try:
                plan = again._jdf.queryExecution().executedPlan()
                again._jdf.queryExecution().toRdd().count()
                out.append((name, _lines(plan, (time.time() - began) * 1000)))
            except Exception:
                if not late.is_set():
                    raise
                out.append((name, None))
            finally:
                timer.cancel()
                for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                    context.setLocalProperty(key, None)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    return out
