"""Hashed text features: word and prefix presence, and word shapes, on whole arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwise.llm.textkernel import LOWER, hash_of, mix64, powers, prefix_hash, runs, words

#: Hash space of word features.
BUCKETS = 1 << 22
#: Bytes of a word's prefixes; 0 stands for the whole word.
PREFIXES = (0, 4, 5, 6, 7)
#: Word shapes.
SHAPES = 2048
#: Pairs of row and feature that are counted at once.
PART = 1 << 20
#: Labelled documents that a model is fitted on, at most, by a hash of their id.
SAMPLE = 6000

LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True
LETTER[128:] = True


def presence(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of words and their prefixes, distinct; keep: a table of the features to give."""
    start, end, row = runs(LETTER[data], offsets)
    prefix = prefix_hash(LOWER[data])
    size, before, inverse = (end - start).astype(np.uint64), prefix[start], powers(len(prefix))[1][start]
    out = []
    for n in PREFIXES:  # each is longer than the one before
        r = row
        if n:
            long = np.flatnonzero(size > n)
            start, size, before, inverse, row = (x[long] for x in (start, size, before, inverse, row))
            r, end = row, start + n
        f = mix64((prefix[end] - before) * inverse + (np.uint64(n) if n else size))
        f = ((f + np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(42)).astype(np.int64)
        if keep is not None:
            hit = keep[f]
            f, r = f[hit], r[hit]
        out.append(r * BUCKETS + f)
    pairs = np.sort(np.concatenate(out))  # np.unique takes longer
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]
    return pairs // BUCKETS, pairs % BUCKETS


def shapes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of each word shape among a row's words: a matrix of rows by SHAPES."""
    start, end, row = words(data, offsets)
    n = len(offsets) - 1
    if not len(start):
        return np.zeros((n, SHAPES), dtype=np.float32)
    h = hash_of(prefix_hash(LOWER[data]), start, end)
    same = np.append(False, (h[1:] == h[:-1]) & (row[1:] == row[:-1]))
    first, last, before = data[start], data[end - 1], data[np.maximum(end - 2, start)]
    upper = (data >= 65) & (data < 91)
    lower = (data >= 97) & (data < 123)
    sums = [np.append(0, np.cumsum(m)) for m in (upper, lower, ~LETTER[data])]
    up, low, other = (c[end] - c[start] for c in sums)
    length = end - start
    code = (
        np.minimum(np.log2(length).astype(np.int64), 5)
        + 6 * ((up > 1) & (low == 0)) + 12 * same + 24 * ((first >= 65) & (first < 91))
        + 48 * np.select([LETTER[last], (last == 46) | (last == 44), last == before, (last >= 48) & (last < 58)], [0, 1, 2, 3], 4)
        + 240 * np.minimum(np.where(other > 1, 1 + (2 * other > length), 0), 2)
    )
    total = np.bincount(row, minlength=n)
    out = np.bincount(row * SHAPES + code, minlength=n * SHAPES).reshape(n, SHAPES)
    return (out / np.maximum(total, 1)[:, None]).astype(np.float32)


def sample(docs: DataFrame, labels: DataFrame, columns: list[str], rows: int = SAMPLE) -> DataFrame:
    """Texts and labels of at most `rows` labelled documents, chosen by a hash of the id; one partition, by doc_id."""
    own = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(c).alias(c) for c in columns])
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    got = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `rows` rows
    got = got.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.first(c).alias(c) for c in columns])
    return got.repartition(1).sortWithinPartitions("doc_id")


def select(row: np.ndarray, feature: np.ndarray, positive: np.ndarray, most: int, least_z: float = 4.0) -> np.ndarray:
    """Features whose share among positive rows differs most from that among others, by a z score."""
    n1, n = positive.sum(), len(positive)
    if not 0 < n1 < n:
        return np.zeros(0, np.int64)
    share = n1 / n
    all_, one = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for at in range(0, len(feature), PART):
        r, f = row[at : at + PART], feature[at : at + PART]
        all_ += np.bincount(f, minlength=BUCKETS).astype(np.int32)
        one += np.bincount(f[positive[r]], minlength=BUCKETS).astype(np.int32)
    seen = np.flatnonzero(all_ > 2)
    all_, one = all_[seen], one[seen]
    z = np.abs((one - all_ * share) / np.sqrt(np.maximum(all_ * share * (1 - share), 1e-9)))
    chosen, z = seen[z >= least_z], z[z >= least_z]
    return np.sort(chosen[np.argsort(-z, kind="stable")[:most]])
