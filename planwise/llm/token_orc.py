"""Token ids of documents in ORC files: run-length encoded integers, row indexes, Bloom filters on doc_id.

write_tokens() range-partitions documents by doc_id, so that file order is doc_id order, and encodes
them in Arrow batches. Each file has stripes that readers take in parallel; row indexes (minima and
maxima per row group) and Bloom filters on doc_id let a read by id skip files, stripes and row groups.

Defined cases: null text is encoded as empty and gives only the end id; a null doc_id sorts first;
repeated doc_ids are all kept, next to each other, and start where they lie in the files; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planwise.llm.grouped import changes
from planwise.llm.piececache import CachedEncoder, spans
from planwise.llm.storage import delete, materialize, new_path
from planwise.llm.textkernel import hash_of, prefix_hash, steps, text_bytes

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
STRIPE_BYTES = 64 << 20
ROW_GROUP = 1000
#: Pieces whose ids a worker keeps; others are encoded each time.
CACHE_PIECES = 1_000_000

_state: dict = {}


def vocabulary_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x09, 0x0A, 0x0D, 0x20]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PRINTED = np.zeros(256, dtype=bool)
_PRINTED[0x21:0x7F] = True
#: ASCII, and no letter.
_PLAIN = ~_LETTER
_PLAIN[128:] = False
#: A byte's kinds as bits; those two bits higher than LETTER and PRINTED are what may follow them in another piece.
LETTER, PRINTED, LATIN = 1, 2, 16
_KIND = (_LETTER * LETTER + _PRINTED * PRINTED + _PLAIN * (LETTER << 2) + _BLANK * (PRINTED << 2)).astype(np.uint8)
_KIND[0xC3:0xC9] |= LATIN
#: Pieces that are encoded in one line.
LINE = 256
#: First bytes of U+00C0 to U+023F: letters but for two signs in C3.
_LATIN = np.zeros(256, dtype=bool)
_LATIN[0xC3:0xC9] = True
#: Bytes of printed ASCII and of U+00C0 to U+023F; among these is no white space.
_SAFE = _PRINTED | _LATIN
_SAFE[0x80:0xC0] = True


def cut_pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start that can be encoded apart.

    The pattern before the merges takes letters in runs as long as possible, and never goes on from
    another character to white space. So a piece may end after a letter before an ASCII character
    that is none, and before white space after printed ASCII or a letter. Anything else stays
    together, which is slower but not wrong.
    """
    n = len(data)
    kind = _KIND[data]
    lead = np.flatnonzero(kind & LATIN)
    lead = lead[lead < n - 1]
    second = data[lead + 1]
    kind[lead[(second >= 0x80) & ~((data[lead] == 0xC3) & ((second == 0x97) | (second == 0xB7)))] + 1] |= LETTER
    first = np.zeros(n + 1, dtype=bool)
    # a letter's bit before an ASCII character's that is none, or a printed character's before a blank's
    first[1:n] = kind[:-1] & (kind[1:] >> 2) & 3
    first[offsets] = True
    first[n] = False
    return np.flatnonzero(first)


class Encoder(CachedEncoder):
    """Encodes texts with the tokenizers library, piece by piece."""

    def __init__(self, vocabulary: str):
        super().__init__(CACHE_PIECES)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        (self.line_end,) = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of printed ASCII and letters, after one space at most, are encoded many in a line, and told apart by the line ends' id.

        A line end neither joins what is before it nor one space after it. Others are encoded alone.
        """
        other = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(~_SAFE[data], out=other[1:])
        inner = start + (data[start] == 0x20)
        safe = (other[end] == other[inner]) & (end > inner)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(start)
        alone = np.flatnonzero(~safe)
        if len(alone):
            raw = data.tobytes()
            for i, x in zip(alone.tolist(), self.ids([raw[s:e].decode() for s, e in zip(start[alone].tolist(), end[alone].tolist(), strict=True)]), strict=True):
                out[i] = x
        lengths = np.zeros(len(start), dtype=np.int64)
        lengths[alone] = [len(out[i]) for i in alone.tolist()]
        lined = np.flatnonzero(safe)
        n = (end - start)[lined] + 1
        line = data[np.minimum(spans(start[lined], n), len(data) - 1)]
        stop = np.cumsum(n)
        line[stop - 1] = 0x0A
        cut = [0, *stop[LINE - 1 :: LINE].tolist()]
        cut += [len(line)] * (cut[-1] < len(line))
        raw = line.tobytes()
        got = self.ids([raw[s:e].decode() for s, e in zip(cut[:-1], cut[1:], strict=True)])
        ids = np.concatenate([*got, np.zeros(0, np.uint32)])
        ends = np.flatnonzero(ids == self.line_end)
        if len(ends) != len(lined):
            raise ValueError("the vocabulary does not keep line ends apart")
        first = np.append(0, ends[:-1] + 1) if len(ends) else ends
        lengths[lined] = ends - first
        offsets = np.zeros(len(start) + 1, dtype=np.int64)
        np.cumsum(lengths, out=offsets[1:])
        values = np.zeros(offsets[-1], dtype=np.uint32)
        values[spans(offsets[:-1][lined], lengths[lined])] = ids[ids != self.line_end]
        for i in alone.tolist():
            values[offsets[i] : offsets[i + 1]] = out[i]
        return offsets, values

    def texts(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with the end id, and the n + 1 offsets of the texts' ids."""
        start = cut_pieces(data, offsets)
        end = np.append(start[1:], len(data)) if len(start) else start
        ids, length = self.encode(data, start, end, hash_of(prefix_hash(data), start, end))
        row = np.searchsorted(offsets, start, side="right") - 1
        per = np.bincount(row, weights=length, minlength=len(offsets) - 1).astype(np.int64)
        at = np.zeros(len(offsets), dtype=np.int64)
        np.cumsum(per, out=at[1:])
        if end_id is not None:
            ids = np.insert(ids, at[1:], end_id)
            at = at + np.arange(len(at))
        return ids, at


def _encode(vocabulary: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _state:
            _state[vocabulary] = Encoder(vocabulary)
        for batch in batches:
            for part in steps(batch):
                ids, offsets = _state[vocabulary].texts(*text_bytes(part.column(1)), end_id)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int | None = END_ID, stripe_bytes: int = STRIPE_BYTES) -> None:
    """Encode docs(doc_id, text) and write them to ORC files under path, in ascending doc_id order."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the hash parts repeated ids, however many; it is no part of the order
    x = x.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id")
    tokens = x.mapInArrow(_encode(vocabulary, end_id), "doc_id long, ids array<int>")
    tokens.write.options(**{
        "compression": "snappy",
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
        "orc.create.index": "true",
        "orc.row.index.stride": str(ROW_GROUP),
        "orc.stripe.size": str(stripe_bytes),
        "orc.rows.between.memory.checks": str(ROW_GROUP),  # long documents fill a stripe soon
    }).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, ids) from files of write_tokens(); doc_ids go down to the ORC reader, which skips stripes by them."""
    x = spark.read.schema("doc_id long, ids array<int>").orc(path)
    return x if doc_ids is None else x.where(F.col("doc_id").isin([int(i) for i in doc_ids]))


def stripe_metadata(path: str) -> list[dict]:
    """Rows and stripes of each ORC file in a local folder."""
    from pyarrow import orc

    root = path.removeprefix("file://")
    out = []
    for name in sorted(n for n in os.listdir(root) if n.endswith(".orc")):
        f = orc.ORCFile(os.path.join(root, name))
        out.append({"file": name, "rows": f.nrows, "stripes": f.nstripes, "row_index_stride": f.row_index_stride, "compression": f.compression})
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests with each row's place among those that are read from one part of a file: such rows follow each other, as in the file."""
    at, n = None, 0
    for b in batches:
        ids = b.column(3)
        offsets = np.frombuffer(ids.buffers()[1], dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * int(s) : 4 * int(e)]) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
        place = np.arange(len(ids))
        for s, e in zip(c := [*changes(b, 2).tolist(), len(ids)], c[1:]):
            now = (b.column(0)[s].as_py(), b.column(1)[s].as_py())
            n = n if now == at else 0
            place[s:e] += n - s
            at, n = now, n + e - s
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(place), b.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["part", "block", "place", "doc_id", "n_tokens", "ids_crc32"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of token files: where each document's ids start, how many, and their checksum.

    Tasks read the stripes of a file apart. Ids before a document are those of earlier files and of earlier
    parts of its file, and those before it in its part, so no task sees more than one part's rows, or one
    row per part.
    """
    x = read_tokens(spark, path).select(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("part"), F.col("_metadata.file_block_start").alias("block"), "doc_id", "ids")
    x = materialize(x.mapInArrow(_digest, "part int, block long, place long, doc_id long, n_tokens long, ids_crc32 long"), "digest")
    parts = x.groupBy("part", "block").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, ["part", "block"])
    return x.select("doc_id", (F.col("part_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    out = digest(spark, path)
    delete(spark, path)  # the digest is written
    return out
