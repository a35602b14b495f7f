"""Sinks of results: JSON, appended JSON, reports and batches."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def report_lines(metrics: DataFrame) -> DataFrame:
    """(line) Markdown of metrics(method, p50, p80, p90, p99): one row per method, ordered by name."""
    spark = metrics.sparkSession
    head = spark.createDataFrame([(0, "", "| name | p50 | p80 | p90 | p99 |"), (1, "", "|-|-|-|-|-|")], "place int, method string, line string")
    rows = metrics.select(F.lit(2).alias("place"), "method", F.format_string("| %s | %.2f | %.2f | %.2f | %.2f |", "method", "p50", "p80", "p90", "p99").alias("line"))
    return head.unionByName(rows).orderBy("place", "method").select("line")


def report(metrics: DataFrame, path: str) -> None:
    """One row per method: a table of bounded size in one file."""
    report_lines(metrics).coalesce(1).write.mode("overwrite").text(path)


def batches(df: DataFrame, path: str) -> None:
    """Encoded plans, a folder for each batch."""
    df.repartition("batch_id").write.mode("overwrite").partitionBy("batch_id").parquet(path)


def scatter(points: DataFrame, x: str, y: str, path: str, log: bool = True, most: int = 10_000) -> None:
    """An SVG picture of actual against estimated values, with lines at equal, half and twice; `most` points by a hash."""
    rows = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null").orderBy(F.xxhash64("x", "y")).limit(most).collect()
    scale = (lambda v: math.log10(max(v, 1e-3))) if log else float
    at = [(scale(r.x), scale(r.y)) for r in rows]
    low, high = min((min(p) for p in at), default=0.0), max((max(p) for p in at), default=1.0)
    size, span = 400, (high - low) or 1.0
    place = lambda v: round(20 + (v - low) / span * size, 1)
    dots = "".join(f'<circle cx="{place(a)}" cy="{size + 40 - place(b)}" r="2"/>' for a, b in at)
    lines = ""
    for factor in (0.5, 1.0, 2.0) if log else (1.0,):
        shift = math.log10(factor) if log else 0.0
        lines += f'<line x1="{place(low)}" y1="{size + 40 - place(low + shift)}" x2="{place(high)}" y2="{size + 40 - place(high + shift)}" stroke="gray"/>'
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<svg xmlns="http://www.w3.org/2000/svg" width="{size + 40}" height="{size + 60}">{lines}{dots}<text x="20" y="{size + 55}">{x} against {y}</text></svg>')
