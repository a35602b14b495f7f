"""Removal of repeated byte strings by prefix-free parsing.

A byte string of `length` bytes that starts at two places of the corpus is found as equal neighbours in
corpus (suffix) order. That order is never built over the whole text; it is taken from a parse:

1. Triggers. A rolling hash runs over all ANCHOR-byte strings; the least of each `length`-byte window
   (leftmost in a tie) triggers a phrase. So each window has exactly one trigger, fixed by the window's
   own bytes, and equal windows have it at the same offset, in whatever document. (A trigger by a fixed
   residue would leave windows of repetitive text without one.)
2. Phrases. Consecutive windows with one trigger are a phrase: it overlaps the next by length - 1
   bytes, so each window lies in exactly one phrase. The dictionary holds each distinct phrase once,
   with its number of occurrences; the parse says which phrase starts where.
3. Order. A phrase that the parse holds twice repeats with all its windows; phrases that make up more
   than one in OFTEN of the parse are looked up apart from the rest. Other windows can only equal windows
   of dictionary phrases with the same trigger string: the suffixes of these phrases are brought in byte
   order, to a depth of `length` bytes, by prefix doubling (the suffix array of a trigger's part of the
   dictionary), with the parse's number of occurrences for each phrase. Neighbours in that order that
   share `length` bytes and occur twice or more in all are repeated. Phrases with a trigger string that
   more than HOT_PHRASES others share are spread over tasks by the hashes of their suffixes instead.
4. Ranges of repeated windows are merged per document, and their bytes removed. removed_text() can leave
   merged ranges of fewer than `least_words` whole words in place.

Hashes have 64 bits; phrases and spread suffixes are only compared under an equal trigger hash, so 128 decide.

Defined cases: null text is empty; texts shorter than `length` lose nothing; a null or repeated doc_id
keeps its row and is told apart by the text's hash; a cut inside a character leaves its other bytes in
the digest, and removed_text() drops them; repeated rows repeat each other; an empty table gives an
empty result; other columns, whatever their names, are carried by removed_text() and never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planwise.llm.grouped import changes, whole_groups
from planwise.llm.piececache import spans
from planwise.llm.storage import collect, drop, fresh, hash_side, materialize
from planwise.llm.textkernel import hash_of, mix64, prefix_hash, steps, text_bytes

LENGTH = 400
ANCHOR = 64
HOT_PHRASES = 4096
#: Phrases of more than one OFTEN-th of the parse: there are fewer than OFTEN of them, whatever the corpus.
OFTEN = 10_000

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, by minima from both ends of blocks."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    b = padded.reshape(-1, width)
    before = np.minimum.accumulate(b, axis=1).ravel()
    after = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def phrases(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, trigger hash, phrase hash) of each phrase, positions within the row."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < length:
        return none
    prefix = prefix_hash(data)
    at = np.arange(len(data) - anchor + 1)
    h = hash_of(prefix, at, at + anchor)
    least = sliding_least((h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), length - anchor + 1)
    start = np.flatnonzero(np.diff(offsets) >= length)
    valid = spans(offsets[start], np.diff(offsets)[start] - length + 1)  # windows within one text
    if not len(valid):
        return none
    trigger = (least[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, trigger[1:] != trigger[:-1]))
    n = np.diff(np.append(first, len(valid)))
    low, t = valid[first], trigger[first]
    row = np.searchsorted(offsets, low, side="right") - 1
    phrase = mix64(hash_of(prefix, low, low + n - 1 + length) + (t - low).astype(np.uint64))
    return row, low - offsets[row], n, h[t], phrase


def _parse(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                row, low, n, key, phrase = phrases(*text_bytes(part.column(2)), length, anchor)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([
                    pa.array(key.view(np.int64)), pa.array(phrase.view(np.int64)), part.column(0).take(at), part.column(1).take(at), pa.array(low.astype(np.int32)), pa.array(n.astype(np.int32)),
                ], ["key", "phrase", "doc_id", "text_hash", "low", "n"])

    return run


def ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Place of each position's next `length` bytes in byte order, equal strings alike: a suffix array to that depth, by prefix doubling.

    Places of strings that go beyond the end are of no meaning.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    width = min(8, length)
    first = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        first |= padded[k : k + n] << np.uint64(56 - 8 * k)
    rank = np.unique(first, return_inverse=True)[1]
    while width < length:
        step = min(width, length - width)
        after = np.zeros(n, dtype=np.int64)
        after[: max(n - step, 0)] = rank[step:]
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
        width += step
    return rank


def _windows(t: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the phrases in t, and row, offset and place in the bytes of their windows."""
    data, offsets = text_bytes(t.column("bytes"))
    n = np.maximum(np.diff(offsets) - length + 1, 0)
    start = spans(offsets[:-1], n)
    row = np.repeat(np.arange(len(n)), n)
    return data, row, start - offsets[row], start


def _ranges(t: pa.Table, row: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
    """Runs of offsets per row, as ranges of windows of the row's document."""
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (off[1:] != off[:-1] + 1))) if len(row) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(row)) - 1 if len(row) else first
    at = pa.array(row[first])
    low = t.column("low").to_numpy()[row[first]] if len(row) else np.zeros(0, np.int64)
    ids = t.select(["doc_id", "text_hash"]).take(at).combine_chunks()
    columns = [ids.column(k).combine_chunks() for k in range(2)]
    return pa.RecordBatch.from_arrays([*columns, pa.array((low + off[first]).astype(np.int32)), pa.array((low + off[last]).astype(np.int32))], ["doc_id", "text_hash", "s", "e"])


def _shared(length: int):
    """Ranges of windows that phrases of one trigger share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 1):
            for t in _pieces(table):
                data, row, off, start = _windows(t, length)
                trigger = np.repeat(np.arange(len(g := changes(t, 1))), np.diff(np.append(g, t.num_rows)))
                place = trigger[row] * (len(data) + 1) + ranks(data, length)[start]
                order = np.argsort(place, kind="stable")  # the dictionary's suffixes of each trigger, in byte order
                run_of = np.cumsum(np.append(False, place[order][1:] != place[order][:-1])) if len(order) else order
                c = t.column("c").to_numpy()
                total = np.bincount(run_of, weights=c[row[order]])
                again = np.zeros(len(place), dtype=bool)
                again[order] = total[run_of] >= 2
                again &= c[row] == 1  # the others repeat as a whole
                yield _ranges(t, row[again], off[again])

    return run


def _pieces(t: pa.Table) -> Iterator[pa.Table]:
    """Whole groups of about a thousand rows at a time."""
    starts = [*changes(t, 1).tolist(), t.num_rows]
    at = 0
    for s, e in zip(starts[:-1], starts[1:], strict=True):
        if e - at > 1000 and s > at:
            yield t.slice(at, s - at)
            at = s
    if t.num_rows > at:
        yield t.slice(at)


def _spread(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                t = pa.Table.from_batches([b.slice(at, 1000)])
                data, row, off, start = _windows(t, length)
                key = t.column("key").to_numpy().view(np.uint64)
                h = mix64(hash_of(prefix_hash(data), start, start + length) ^ mix64(key)[row])
                take = pa.array(row)
                low = t.column("low").to_numpy()[row]
                yield pa.RecordBatch.from_arrays([
                    pa.array(h.view(np.int64)), *(t.column(k).combine_chunks().take(take) for k in ("c", "doc_id", "text_hash")), pa.array((low + off).astype(np.int32)),
                ], ["h", "c", "doc_id", "text_hash", "s"])

    return run


def repeated_ranges(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot_phrases: int = HOT_PHRASES, often: int = OFTEN) -> DataFrame:
    """(doc_id, text_hash, s, e): windows s..e of docs(doc_id, text_hash, text) that start elsewhere, too; a written table."""
    if not 0 < anchor <= length:
        raise ValueError("the trigger string must fit into the window")
    place = "doc_id long, text_hash long"
    parse = materialize(docs.mapInArrow(_parse(length, anchor), f"key long, phrase long, {place}, low int, n int"), "parse")
    dictionary = parse.groupBy("key", "phrase").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "text_hash", "low", "n")).alias("at"))
    keys = dictionary.groupBy("key").agg(F.sum("c").alias("total"), F.count("*").alias("d")).where("total > 1")
    dictionary = materialize(dictionary.join(keys, "key").select("key", "phrase", "c", "d", "at.*"), "dictionary")
    # counts add up to the parse's rows, so fewer than `often` phrases can be above this bar: few enough to broadcast
    bar = max(1, parse.count() // often)
    phrase = ["key", "phrase"]
    common = F.broadcast(dictionary.where(F.col("c") > bar).select(*phrase))
    rest = dictionary.where((F.col("c") > 1) & (F.col("c") <= bar)).select(*phrase)
    whole = parse.join(common, phrase, "left_semi").union(parse.join(common, phrase, "left_anti").join(rest, phrase, "left_semi").select(*parse.columns))
    whole = whole.select("doc_id", "text_hash", F.col("low").alias("s"), (F.col("low") + F.col("n") - 1).alias("e"))
    # phrases that share their trigger string with others, with their bytes: texts probe the few phrases
    mixed = hash_side(dictionary, 64, dictionary.where("d > 1"))
    texts = docs.where(F.octet_length("text") >= length).withColumnsRenamed({"doc_id": "t_id", "text_hash": "t_hash"})
    cut = F.substr(F.col("text").cast("binary"), F.col("low") + 1, F.col("n") + (length - 1))
    mixed = texts.join(mixed, (F.col("t_hash") == F.col("text_hash")) & F.col("t_id").eqNullSafe(F.col("doc_id"))).select("key", "c", "d", "doc_id", "text_hash", "low", "phrase", cut.alias("bytes"))
    mixed = materialize(mixed.dropDuplicates(phrase), "mixed")
    columns = ["key", "c", "doc_id", "text_hash", "low", "bytes"]
    near = mixed.where(F.col("d") <= hot_phrases).select(*columns).repartition("key").sortWithinPartitions("key")
    near = near.mapInArrow(_shared(length), f"{place}, s int, e int")
    hot = mixed.where(F.col("d") > hot_phrases).select(*columns).mapInArrow(_spread(length), f"h long, c long, {place}, s int")
    again = hot.groupBy("h").agg(F.sum("c").alias("k")).where("k > 1").select("h")
    hot = hot.where("c = 1").join(again, "h", "left_semi").select("doc_id", "text_hash", "s").distinct()
    # windows next to each other in a document become one range
    hot = hot.withColumn("run", F.col("s") - F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("s")))
    hot = hot.groupBy("doc_id", "text_hash", "run").agg(F.min("s").alias("s"), F.max("s").alias("e")).drop("run")
    out = materialize(whole.union(near).union(hot), "ranges")
    drop(parse, dictionary, mixed)
    collect(docs.sparkSession)
    return out


def _merged(ranges: list | None, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the bytes that ranges of windows cover, merged where they touch."""
    if not ranges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = np.array([(r["s"], r["e"] + length) for r in ranges], dtype=np.int64)
    x = x[np.argsort(x[:, 0], kind="stable")]
    end = np.maximum.accumulate(x[:, 1])
    new = np.append(True, x[1:, 0] > end[:-1])
    first = np.flatnonzero(new)
    return x[first, 0], end[np.append(first[1:], len(x)) - 1]


def _whole_words(raw: bytes, s: int, e: int) -> int:
    """Words of a text that lie in s..e as a whole."""
    n = sum(1 for _ in _WORD.finditer(raw, s, e))
    begun, goes_on = s > 0 and _WORD.match(raw, s - 1, s + 1), e < len(raw) and _WORD.match(raw, e - 1, e + 1)
    n -= bool(begun and begun.end() == s + 1) + bool(goes_on and goes_on.end() == e + 1)
    return max(n, 0)


def _kept(text: str | None, ranges: list | None, length: int, least_words: int = 0) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    raw = (text or "").encode()
    s, e = _merged(ranges, length)
    if least_words:
        long = np.array([_whole_words(raw, a, b) >= least_words for a, b in zip(s.tolist(), e.tolist(), strict=True)], dtype=bool)
        s, e = s[long], e[long]
    parts, at = [], 0
    for a, b in zip(s.tolist(), e.tolist(), strict=True):
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    return raw, b"".join(parts), s, e


def _digest(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in steps(b):
                rows = []
                for text, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw, kept, s, e = _kept(text, ranges, length)
                    rows.append((len(raw), int((e - s).sum()), len(s), hashlib.sha256(kept).hexdigest()))
                a, b_, c, d = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(a, pa.int64()), pa.array(b_, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _with_ranges(docs: DataFrame, length: int, anchor: int = ANCHOR) -> tuple[DataFrame, str]:
    """docs with a column of ranges, and its name; every other column is kept."""
    own, name = fresh("text_hash", docs), fresh("ranges", docs)
    x = docs.withColumn("text", F.col("text").cast("string")).withColumn(own, F.coalesce(F.xxhash64("text"), F.lit(0)))
    places = x.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(own).alias("text_hash"), "text")
    r_doc, r_hash = fresh("r_doc", x), fresh("r_hash", x)
    ranges = repeated_ranges(places, length, anchor)
    found = ranges.groupBy(F.col("doc_id").alias(r_doc), F.col("text_hash").alias(r_hash)).agg(F.collect_set(F.struct("s", "e")).alias(name))
    found = hash_side(ranges, 64, found)
    return x.join(found, (F.col(own) == F.col(r_hash)) & F.col("doc_id").cast("long").eqNullSafe(F.col(r_doc)), "left").select(*docs.columns, name), name


def _text(length: int, least_words: int) -> Column:
    def run(text, ranges):
        import pandas as pd

        return pd.Series([t if r is None or not len(r) else _kept(t, list(r), length, least_words)[1].decode("utf-8", "ignore") for t, r in zip(text, ranges, strict=True)])

    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.pandas.functions import PandasUDFType

    return pandas_udf(run, "string", PandasUDFType.SCALAR)


def removed_text(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, least_words: int = 0) -> DataFrame:
    """docs without the bytes that repeat, in runs of `least_words` whole words or more; n_chars, where there is one, follows the text."""
    x, ranges = _with_ranges(docs, length, anchor)
    out = x.withColumn("text", F.when(F.col(ranges).isNull(), F.col("text")).otherwise(_text(length, least_words)("text", ranges)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(ranges).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*docs.columns)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    x, ranges = _with_ranges(docs, LENGTH)
    return x.select("doc_id", "text", ranges).mapInArrow(_digest(LENGTH), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
