"""Ordinal cumulative-link regression on graded ratings.

P(grade > k) = 1 / (1 + exp(threshold_k - w.x)): the grades share the weights w of hashed text features
(shares of word shapes, presence of words and prefixes) and differ by ordered thresholds. The model
gives each document its expected grade and the probability of a grade of LEAST_GRADE at least, by which
documents are selected. It is fitted on at most SAMPLE labelled documents.

Grades: 0 for bad quality, 1 for good quality but toxic, 2 for good quality. As LEAST_GRADE is 1, selection
rejects bad quality alone; toxic documents stay, and take a `least` grade of 2 to go.

Defined cases: null and empty texts have no words, and are scored from the thresholds alone; labels
with a null are left out; without labels of two grades every document is kept; an empty table gives an
empty result; repeated rows score alike; select_good() carries all columns, whatever their names, and graded()
gives its own columns other names where docs has such.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from planwise.llm.lexical import BUCKETS, SAMPLE, SHAPES, presence, sample, select, shapes
from planwise.llm.storage import fresh
from planwise.llm.textkernel import release, steps, text_bytes

GRADES = 3
LEAST_GRADE = 1
LEAST_PROBABILITY = 0.5
FEATURES = 2048
SHAPE_SCALE = 4.0
#: Keeps every document.
NO_MODEL = (np.zeros(SHAPES), np.zeros(0, np.int64), np.zeros(0), np.full(GRADES - 1, -50.0))


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from labels(doc_id, quality, toxic)."""
    return labels.where("quality is not null and toxic is not null").select("doc_id", F.when(F.col("quality") < 1, 0).when(F.col("toxic") >= 1, 1).otherwise(2).alias("grade"))


def tails(z: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > k) for each row and threshold."""
    return 1 / (1 + np.exp(np.clip(thresholds[None, :] - z[:, None], -50, 50)))


def fit(texts: pa.Table, grade: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shape weights, features, feature weights, thresholds) by maximum likelihood with a ridge penalty."""
    n = len(grade)
    if n == 0 or len(np.unique(grade)) < 2:
        return NO_MODEL
    x, rows, fs, at = np.zeros((n, SHAPES), np.float32), [], [], 0
    for batch in texts.to_batches():
        for part in steps(batch):
            data = text_bytes(part.column(part.schema.get_field_index("text")))
            x[at : at + part.num_rows] = shapes(*data)
            r, f = presence(*data)
            rows.append((r + at).astype(np.int32))
            fs.append(f.astype(np.int32))
            at += part.num_rows
    np.sqrt(x, out=x)
    x *= np.float32(SHAPE_SCALE)
    row, f = np.concatenate(rows), np.concatenate(fs)
    del rows, fs
    used = np.flatnonzero(x.any(axis=0))
    x = np.ascontiguousarray(x[:, used])
    chosen = np.unique(np.concatenate([select(row, f, grade > k, FEATURES) for k in range(GRADES - 1)]))
    keep = np.zeros(BUCKETS, dtype=bool)
    keep[chosen] = True
    hit = keep[f]
    row, at = row[hit], np.searchsorted(chosen, f[hit])
    del f, hit
    share = np.array([np.clip((grade > k).mean(), 1e-3, 1 - 1e-3) for k in range(GRADES - 1)])
    first = -np.log(share / (1 - share))
    p = np.zeros(len(used) + len(chosen) + GRADES - 1)  # weights, then the first threshold and logs of the gaps
    p[-(GRADES - 1)] = first[0]
    p[len(p) - GRADES + 2 :] = np.log(np.maximum(np.diff(first), 0.1))
    m, v = np.zeros(len(p)), np.zeros(len(p))
    for t in range(1, rounds + 1):
        ws, wf, cut = p[:len(used)], p[len(used) : len(used) + len(chosen)], p[len(used) + len(chosen) :]
        gaps = np.exp(cut[1:])
        th = np.concatenate([cut[:1], cut[0] + np.cumsum(gaps)])
        z = (x @ ws.astype(np.float32)).astype(np.float64) + np.bincount(row, weights=wf[at], minlength=n)
        c = np.concatenate([np.ones((n, 1)), tails(z, th), np.zeros((n, 1))], axis=1)
        prob = np.maximum(c[np.arange(n), grade] - c[np.arange(n), grade + 1], 1e-9)
        slope = c * (1 - c)
        upper, lower = slope[np.arange(n), grade], slope[np.arange(n), grade + 1]
        dz = -(upper - lower) / prob
        dth = np.array([(np.where(grade == k + 1, upper, 0) / prob - np.where(grade == k, lower, 0) / prob).sum() for k in range(GRADES - 1)])
        g = np.concatenate([(x.T @ dz.astype(np.float32)) + 0.02 * ws, np.bincount(at, weights=dz[row], minlength=len(chosen)) + 0.05 * wf, [dth.sum()], dth[::-1].cumsum()[::-1][1:] * gaps]) / n
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        p -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    cut = p[len(used) + len(chosen) :]
    weights = np.zeros(SHAPES)
    weights[used] = p[: len(used)]
    return weights, chosen, p[len(used) : len(used) + len(chosen)], np.concatenate([cut[:1], cut[0] + np.cumsum(np.exp(cut[1:]))])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pickled model of one task's texts and grades: the driver's memory holds neither."""
    batches = list(batches)
    if batches:
        texts = pa.Table.from_batches(batches)
        model = pickle.dumps(fit(texts, texts.column("grade").to_numpy().astype(np.int64)))
        del batches, texts
        release()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])


def linear(data: np.ndarray, offsets: np.ndarray, ws: np.ndarray, chosen: np.ndarray, wf: np.ndarray, keep: np.ndarray) -> np.ndarray:
    z = (np.sqrt(shapes(data, offsets)) * SHAPE_SCALE) @ ws
    if len(chosen):
        row, f = presence(data, offsets, keep)
        z += np.bincount(row, weights=wf[np.searchsorted(chosen, f)], minlength=len(z))
    return z


def _grade(model, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ws, chosen, wf, th = model.value
        keep = np.zeros(BUCKETS, dtype=bool)
        keep[chosen] = True
        for batch in batches:
            column = batch.schema.get_field_index("text")
            for part in steps(batch):
                tail = tails(linear(*text_bytes(part.column(column)), ws, chosen, wf, keep), th)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tail.sum(axis=1)), pa.array(tail[:, LEAST_GRADE - 1])], [*part.schema.names, *names])

    return run


def graded(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """docs with expected_grade and p_selected, the probability of LEAST_GRADE or more."""
    train = sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), grades(labels), ["grade"], rows)
    found = [pickle.loads(m) for (m,) in train.select("text", "grade").mapInArrow(_fit, "model binary").collect()]
    model = docs.sparkSession.sparkContext.broadcast(found[0] if found else NO_MODEL)
    names = fresh("expected_grade", docs), fresh("p_selected", docs)
    return docs.mapInArrow(_grade(model, names), StructType([*docs.schema.fields, *(StructField(n, DoubleType()) for n in names)]))


def select_good(docs: DataFrame, labels: DataFrame, least: float = LEAST_PROBABILITY) -> DataFrame:
    """The documents whose grade is LEAST_GRADE or more with probability `least`, with the columns of docs."""
    return graded(docs, labels).where(F.col(fresh("p_selected", docs)) >= least).select(*docs.columns)


def op9_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = graded(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "expected_grade", "p_selected", (F.col("p_selected") >= LEAST_PROBABILITY).alias("kept"))
