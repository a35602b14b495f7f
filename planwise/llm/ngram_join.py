"""Exact n-gram Jaccard join of documents by signature trees.

A document's set holds its distinct word shingles. Two documents link when their sets' Jaccard
similarity is at least `percent` hundredths.

1. Every document gets its set's size and a 128-bit fingerprint; documents with equal sets are one
   class, a node with an id of its own, and need no comparison. All that follows sees each class once.
2. Documents that can link meet by neighbours in a global order, which puts rare shingles first by a table of
   counts that all documents are hashed into, and goes by hash where counts are equal: each shingle that only one of two linked
   sets has lies in one gap between shingles that both have, so the first gap that is empty in both comes
   after at most |A \\ B| + |B \\ A| others, and its two shingles are neighbours within the first
   2 |A| (100 - percent) / 100 + 2 of each set. Each such pair of neighbours is a key. A key says that two shingles
   are there and none between them, so sets that share a phrase by chance seldom share one, however many there are.
3. In each key's list, neighbours in order of size whose sizes allow a link are chained. The components
   are the candidate groups; no link crosses them.
4. Each group builds a signature tree: nodes hold the OR of their documents' token bitmaps, with the
   greatest count per bit, and the range of sizes. A dual traversal leaves out pairs of nodes whose
   maximum possible overlap is too small, and pairs already joined; leaf pairs are verified exactly.
   A group of more than GROUP_ROWS classes is dealt to pairs of its chunks, each a task of its own.

Defined cases: null and empty texts, and texts without words, have size 0 and link with nothing;
fewer words than the width make one shingle of the whole sequence; repeated rows are equal sets;
a null doc_id keeps its row and links with nothing; rows of one doc_id with different texts are
documents of their own, each in its own component, which is named by its least doc_id; an empty table
gives an empty result; other columns, whatever their names, are carried by representatives() and never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planwise.llm.components import connected_components
from planwise.llm.grouped import groups
from planwise.llm.storage import collect, drop, fresh, hash_side, materialize
from planwise.llm.textkernel import mix64, shingle_hashes, steps, text_bytes

WIDTH = 4
PERCENT = 85
GROUP_ROWS = 1024
FANOUT = 4
#: From this percentage on, the gaps of two linked sets outnumber the shingles that only one has.
PAIRED = 75
#: log2 of the number of counters. However many shingles share one, those of a line or passage that many texts
#: have stand out from the mean by more than the spread of the others.
COUNTERS = 24
CHUNK_COUNTERS = 1 << 18
#: Counters are held at this count, and those of a task at TASK_FULL.
FULL, TASK_FULL = 65535, 255
#: Parts of a common shingle's list in an earlier form of candidates; callers still set it, it has no effect.
SALTS = 1024
#: Fingerprints that a task remembers, to give the keys of equal sets once.
REMEMBERED = 1 << 18


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set of hashes, as two signed longs."""
    a = mix64(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) + np.uint64(len(s))
    b = np.bitwise_xor.reduce(mix64(s ^ np.uint64(0xA0761D6478BD642F))) if len(s) else np.uint64(0)
    return int(mix64(np.array([a])).view(np.int64)[0]), int(mix64(np.array([b + np.uint64(1)])).view(np.int64)[0])


def _counts(width: int, bits: int):
    """Counts of hashed shingles in a table of fixed size per task, held at 255, cut into chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, dtype=np.uint16)
        shift = np.uint64(64 - bits)
        for batch in batches:
            for part in steps(batch):
                sets = shingle_hashes(*text_bytes(part.column(0)), width)
                at, n = np.unique((np.concatenate(sets) >> shift).astype(np.int64), return_counts=True)
                table[at] = np.minimum(table[at] + n, TASK_FULL)
        if table.any():
            for at in range(0, len(table), CHUNK_COUNTERS):
                chunk = table[at : at + CHUNK_COUNTERS].astype(np.uint8)
                if chunk.any():
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([chunk.tobytes()])], ["at", "counts"])

    return run


def _add(full: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 1):
            out = np.zeros(CHUNK_COUNTERS, dtype=np.uint32)
            for x in t.column(1):
                out = np.minimum(out + np.frombuffer(x.as_buffer(), dtype=np.uint8), full)
            yield pa.RecordBatch.from_arrays([t.column(0).slice(0, 1).combine_chunks(), pa.array([out.astype(np.uint16).tobytes()])], ["at", "counts"])

    return run


def shingle_counts(docs: DataFrame, width: int = WIDTH, bits: int = COUNTERS, full: int = FULL) -> np.ndarray:
    """Counts of hashed shingles over all documents, held at `full`: 2**(bits + 1) bytes, whatever the corpus."""
    kind = "at int, counts binary"
    parts = docs.select("text").mapInArrow(_counts(width, bits), kind).repartition("at").sortWithinPartitions("at").mapInArrow(_add(full), kind)
    table = np.zeros(1 << bits, dtype=np.uint16)
    for at, counts in parts.toLocalIterator():
        table[at : at + CHUNK_COUNTERS] = np.frombuffer(counts, dtype=np.uint16)
    return table


def _sizes(width: int):
    """(doc_id, text_hash, f1, f2, n): fingerprint and size of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                sets = shingle_hashes(*text_bytes(part.column(1)), width)
                f1, f2 = zip(*map(fingerprint, sets), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "text_hash", "f1", "f2", "n"])

    return run


def ordered(sets: list[np.ndarray], counts: np.ndarray) -> list[np.ndarray]:
    """Sorted sets by the counts of their shingles, then by hash."""
    shift = np.uint64(64 - len(counts).bit_length() + 1)
    return [s[np.argsort(counts[(s >> shift).astype(np.int64)], kind="stable")] for s in sets]


def keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the set, key) of sets in a global order: two linked sets that differ share a key."""
    if percent >= PAIRED:
        heads = [s[: 2 * len(s) * (100 - percent) // 100 + 2] for s in sets]
    else:
        heads = [s[: len(s) - (percent * len(s) + 99) // 100 + 1] if len(s) else s for s in sets]
    at = np.repeat(np.arange(len(sets)), [len(h) for h in heads])
    token = np.concatenate([*heads, np.zeros(0, np.uint64)])
    if percent < PAIRED:
        return at, token
    same = at[1:] == at[:-1]
    return at[1:][same], mix64(mix64(token[:-1][same]) + token[1:][same])


def _keys(width: int, percent: int, table):
    """(key, f1, n) of each document's keys, once for most of a task's equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in steps(batch):
                own = {f: s for s in shingle_hashes(*text_bytes(part.column(0)), width) if (f := fingerprint(s)[0]) not in seen}
                seen = seen if len(seen) < REMEMBERED else set()
                seen.update(own)
                at, key = keys(ordered(list(own.values()), table.value), percent)
                f1, n = np.array(list(own), dtype=np.int64), np.array([len(s) for s in own.values()], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(f1[at]), pa.array(n[at])], ["key", "f1", "n"])

    return run


class Tree:
    """A signature tree over sets in the given order."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, bits: int):
        n = len(sets)
        counts = np.zeros((n, bits), dtype=np.uint16)
        for i, s in enumerate(sets):
            np.add.at(counts[i], (s & np.uint64(bits - 1)).astype(np.int64), 1)
        #: For each level from the leaves up: greatest counts per bit (their support is the OR of the bitmaps), least and greatest size.
        self.levels = [(counts, sizes, sizes)]
        while len(self.levels[-1][0]) > FANOUT:
            c, low, high = self.levels[-1]
            at = np.arange(0, len(c), FANOUT)
            self.levels.append((np.maximum.reduceat(c, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def tree_links(sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT, stats: dict | None = None) -> list[tuple[int, int]]:
    """Forest of the links among sets, as pairs of positions; side: as in a pair of chunks, where only pairs across count, or -1."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if n == 2:
        return [(0, 1)] if (side[0] < 0 or side[0] != side[1]) and linked(sets[0], sets[1], percent) else []
    order = np.array(sorted(range(n), key=lambda i: (int(sets[i][0]) if sizes[i] else 0, sizes[i])))
    sets, sizes, side = [sets[i] for i in order], sizes[order], side[order]
    bits = 1 << int(np.clip(np.ceil(np.log2(max(np.median(sizes), 1))), 8, 12))
    tree = Tree(sets, sizes, bits)
    parent = list(range(n))
    across = side[0] >= 0

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out: list[tuple[int, int]] = []
    top = len(tree.levels) - 1
    stack = [(top, i, j) for i in range(len(tree.levels[top][0])) for j in range(i, len(tree.levels[top][0]))][::-1]
    while stack:
        level, i, j = stack.pop()
        counts, low, high = tree.levels[level]
        if level == 0:
            if i == j or (across and side[i] == side[j]):
                continue
            a, b = find(i), find(j)
            if a == b:
                continue
        if i != j:
            # the least overlap that any link of these sizes needs, against the greatest overlap possible
            if 100 * high[i] < percent * low[j] or 100 * high[j] < percent * low[i]:
                continue
            need = max(percent * max(low[i], low[j]), -(-100 * percent * (low[i] + low[j]) // (100 + percent)))
            if 100 * int(np.minimum(counts[i], counts[j]).sum(dtype=np.int64)) < need:
                if stats is not None:
                    stats["pruned"] = stats.get("pruned", 0) + 1
                continue
        if level == 0:
            if stats is not None:
                stats["verified"] = stats.get("verified", 0) + 1
            if linked(sets[i], sets[j], percent):
                parent[max(a, b)] = min(a, b)
                out.append((int(order[i]), int(order[j])))
            continue
        below = len(tree.levels[level - 1][0])
        kids_i = range(i * FANOUT, min(below, (i + 1) * FANOUT))
        kids_j = range(j * FANOUT, min(below, (j + 1) * FANOUT))
        stack += [(level - 1, x, y) for x in kids_i for y in kids_j if x <= y or i != j][::-1]
    return out


def _verify(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 3):
            ids = t.column("node").to_numpy()
            ids, first = np.unique(ids, return_index=True)
            if len(ids) < 2:
                continue
            sets = []
            for part in pa.Table.take(t, pa.array(first)).select(["text"]).combine_chunks().to_batches():
                for some in steps(part):
                    sets += shingle_hashes(*text_bytes(some.column(0)), width)
            a, b = t.column(1)[0].as_py(), t.column(2)[0].as_py()
            side = np.full(len(ids), -1) if a == b else (t.column("chunk").to_numpy()[first] == b).astype(np.int64)
            got = tree_links(sets, side, percent)
            if got:
                u, v = (ids[np.array(x)] for x in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def _chains(each: DataFrame, percent: int) -> DataFrame:
    """(u, v): edges whose components no link of sets with each(key, f1, n) crosses."""
    order = Window.partitionBy("key").orderBy("n", "f1")
    near = each.select("f1", "n", F.lag("f1").over(order).alias("p"), F.lag("n").over(order).alias("pn"))
    return near.where(f"100 * cast(pn as long) >= {percent} * cast(n as long) and f1 <> p").select("f1", "p")


def _rows(docs: DataFrame, width: int, percent: int, bits: int, group_rows: int, full: int = FULL) -> DataFrame:
    """(doc_id, text_hash, n, component_id, leader_hash) for each row of docs(doc_id, text): the last two name the least row of its component; a written table."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    x = materialize(docs.mapInArrow(_sizes(width), "doc_id long, text_hash long, f1 long, f2 long, n long"), "sizes")
    known = x.where("n > 0 and doc_id is not null")
    # one node for each class of equal sets; the ids are fixed once the table is written
    sets = known.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("n").alias("n"))
    sets = materialize(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    # candidates go by half of the fingerprint: where halves of different sets are equal, a group is larger
    table = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, width, bits, full))
    collect(docs.sparkSession)
    each = docs.where("doc_id is not null").select("text").mapInArrow(_keys(width, percent, table), "key long, f1 long, n int")
    found = connected_components(_chains(each, percent))
    collect(docs.sparkSession)
    groups = found.select(F.col("node").alias("f1"), F.col("component").alias("grp")).union(found.select("component", "component")).distinct()

    # one document stands for each class
    classes = sets.join(groups, "f1")
    sizes = classes.groupBy("grp").count()
    classes = classes.select("node", "least.*", "grp").join(sizes, "grp")
    chunks = F.when(F.col("count") <= group_rows, F.lit(1)).otherwise(F.ceil(F.col("count") * 2 / group_rows)).cast("int")
    classes = classes.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    classes = materialize(classes.select("grp", "chunks", "chunk", "node", "doc_id", "text_hash"), "classes")
    # texts are dealt once and probe the few classes
    y = docs.join(hash_side(classes, 64), ["doc_id", "text_hash"]).select("grp", "chunks", "chunk", "node", "text")
    y = y.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    y = y.select("grp", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "chunk", "node", "text")
    # texts travel rather than sets: hashes don't compress
    y = y.repartition("grp", "a", "b").sortWithinPartitions("grp", "a", "b")
    joined = connected_components(y.mapInArrow(_verify(width, percent), "u long, v long"))
    collect(docs.sparkSession)

    # documents of a class share its component, which is named by its least row
    per = sets.select("f1", "f2", "node", "least").join(joined, "node", "left").select("f1", "f2", "least", F.coalesce("component", "node").alias("component"))
    per = per.select("f1", "f2", "component").join(per.groupBy("component").agg(F.min("least").alias("least")), "component").select("f1", "f2", F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("leader_hash"))
    linked_rows = known.select("doc_id", "text_hash", "f1", "f2", "n").join(per, ["f1", "f2"]).select("doc_id", "text_hash", "n", "component_id", "leader_hash")
    alone = x.where("n = 0 or doc_id is null").select("doc_id", "text_hash", "n", F.col("doc_id").alias("component_id"), F.col("text_hash").alias("leader_hash"))
    out = materialize(linked_rows.union(alone), "near")
    drop(x, sets, found, classes, joined)
    return out


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bits: int = COUNTERS, group_rows: int = GROUP_ROWS, full: int = FULL) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text)."""
    return _rows(docs, width, percent, bits, group_rows, full).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, width: int, percent: int, bits: int = COUNTERS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Of each component of docs(doc_id, text) the least row by doc_id, then text hash, once; rows that link with nothing all stay.

    These are documents without words and those with a null doc_id. Of rows of equal doc_id and text, one stays, whichever it is.
    """
    rows = _rows(docs, width, percent, bits, group_rows)
    own, k_doc, k_hash = fresh("text_hash", docs), fresh("k_doc", docs), fresh("k_hash", docs)
    kept = rows.where("doc_id = component_id and text_hash = leader_hash and n > 0").select(F.col("doc_id").alias(k_doc), F.col("text_hash").alias(k_hash)).distinct()
    text = F.col("text").cast("string")
    alone = F.col("doc_id").isNull() | ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    linked_docs = docs.where(~alone).withColumn(own, F.xxhash64(text))
    linked_docs = linked_docs.join(kept, (F.col("doc_id").cast("long") == F.col(k_doc)) & (F.col(own) == F.col(k_hash)), "left_semi").dropDuplicates(["doc_id", own])
    return linked_docs.select(*docs.columns).union(docs.where(alone))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
