"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Pieces and their scores, taken as log probabilities, come from a SentencePiece model file. They are
kept as bytes, with the white-space marker as a space, in a double-array trie (base and check arrays).
A text gets a space in front and is cut where a space follows another character: no piece goes across
such a place, so the best segmentation of the whole is made of those of the parts. The trie is walked
and the Viterbi recursion runs for many parts at once, position by position, or byte by byte where few
parts have about the same length, as long unbroken runs do; known parts come from a bounded cache. A character that no piece of its own covers may also be given by byte pieces, at a
score below that of every piece.

Decoding gives the pieces' bytes, markers as spaces, without the space in front: exactly the text.

Defined cases: null and empty texts have no ids; a marker character in a text is given by bytes, so it
comes back as itself; texts of any length are taken whole; ties go to the longer last piece; repeated
rows give equal rows; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwise.llm.piececache import CachedEncoder, gather_lists, spans
from planwise.llm.textkernel import hash_of, prefix_hash, steps, text_bytes

MODEL = "piece_bpe_32k.model"
MARKER = "▁"
CACHE_PIECES = 250_000
#: A character given by bytes scores so much less than the lowest piece.
PENALTY = 10.0
#: Cells of one Viterbi table.
CELLS = 1 << 18
#: Tables of fewer parts are done part by part, with the same result.
FEW = 48

_state: dict = {}


def model_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class DoubleArray:
    """A trie over byte strings in two arrays: the child of state s by byte c is base[s] + c if its check is s."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, v in keys.items():
            at = 0
            for c in key:
                to = children[at].get(c)
                if to is None:
                    to = len(children)
                    children[at][c] = to
                    children.append({})
                    value.append(-1)
                at = to
            value[at] = v
        size = 2 * len(children) + 1024
        taken = bytearray(size)
        taken[0] = 1
        base, check, values = [0] * size, [-1] * size, [-1] * size
        place = [0] * len(children)
        low = 1
        for node, own in enumerate(children):  # parents come before their children
            s = place[node]
            values[s] = value[node]
            if not own:
                continue
            codes = sorted(own)
            low = at = taken.find(0, low)
            while at >= 0:  # the first free place for all children
                b = at - codes[0]
                if b + 256 > len(taken):
                    taken += bytes(size)
                    base, check, values = base + [0] * size, check + [-1] * size, values + [-1] * size
                if b > 0 and not any(taken[b + c] for c in codes):
                    break
                at = taken.find(0, at + 1)
            base[s] = b
            for c in codes:
                taken[b + c] = 1
                check[b + c] = s
                place[own[c]] = b + c
        self.base, self.check, self.value = (np.array(x + [y] * 256, dtype=np.int32) for x, y in ((base, 0), (check, -1), (values, -1)))
        self.base.flags.writeable = self.check.flags.writeable = False

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next states, -1 where there is none."""
        to = self.base[state] + byte
        return np.where(self.check[to] == state, to, -1)


class Pieces(CachedEncoder):
    def __init__(self, model: str = MODEL):
        super().__init__(CACHE_PIECES)
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path(model))
        n = sp.get_piece_size()
        self.byte_id = np.full(256, -1, dtype=np.int64)
        self.score = np.zeros(n)
        keys: dict[bytes, int] = {}
        surface: list[bytes] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            self.score[i] = sp.get_score(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                surface.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                surface.append(b"")
            else:
                raw = piece.replace(MARKER, " ").encode()
                keys.setdefault(raw, i)
                surface.append(raw)
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces")
        inner = [k for k in keys if b" " in k.lstrip(b" ")]
        self.cut_spaces = not inner
        self.cut_lines = not any(b"\n" in k for k in keys)
        self.trie = DoubleArray(keys)
        self.plain = (*(array("i", x.tobytes()) for x in (self.trie.base, self.trie.check, self.trie.value)), self.score.tolist())
        self.longest = max(map(len, keys))
        self.fallback = min(self.score[i] for i in keys.values()) - PENALTY
        self.surface = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.surface_at = np.append(0, np.cumsum([len(x) for x in surface]))

    def viterbi(self, table: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(back, piece) for rows of bytes: where the best piece that ends at a position starts, and its id, -1 for a character in bytes."""
        n, width = table.shape
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0.0
        back = np.zeros((n, width + 1), dtype=np.int32)
        piece = np.full((n, width + 1), -1, dtype=np.int32)
        every = np.arange(n)
        for s in range(width):
            rows = every[(best[:, s] > -np.inf) & (length > s)]
            if not len(rows):
                continue
            first = table[rows, s]
            size = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
            size = np.minimum(size, length[rows] - s)
            own = np.zeros(len(rows), dtype=bool)  # whether a piece is this character
            live, state = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int32)
            for d in range(1, self.longest + 1):
                inside = length[rows[live]] >= s + d
                live, state = live[inside], state[inside]
                if not len(live):
                    break
                state = self.trie.step(state, table[rows[live], s + d - 1])
                ok = state >= 0
                live, state = live[ok], state[ok]
                v = self.trie.value[state]
                hit = v >= 0
                if hit.any():
                    r, p = live[hit], v[hit]
                    own[r[size[r] == d]] = True
                    score = best[rows[r], s] + self.score[p]
                    better = score > best[rows[r], s + d]
                    r, p = rows[r[better]], p[better]
                    best[r, s + d], back[r, s + d], piece[r, s + d] = score[better], s, p
            r = np.flatnonzero(~own)
            if len(r):
                to, score = s + size[r], best[rows[r], s] + self.fallback
                better = score > best[rows[r], to]
                r, to = rows[r[better]], to[better]
                best[r, to], back[r, to], piece[r, to] = score[better], s, -1
        return back, piece

    def viterbi_one(self, raw: bytes) -> array:
        """Ids of one part by the recursion of viterbi(), with 16 bytes of memory for each of the part's."""
        base, check, value, score = self.plain
        n = len(raw)
        best, back, piece = array("d", [-np.inf]) * (n + 1), array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        for s in range(n):
            here = best[s]
            if here == -np.inf:
                continue
            first = raw[s]
            whole = min(s + (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4), n)
            own, state = False, 0
            for e in range(s + 1, n + 1):
                to = base[state] + raw[e - 1]
                if check[to] != state:
                    break
                state, p = to, value[to]
                if p >= 0:
                    own = own or e == whole
                    if here + score[p] > best[e]:
                        best[e], back[e], piece[e] = here + score[p], s, p
            if not own and here + self.fallback > best[whole]:
                best[whole], back[whole], piece[whole] = here + self.fallback, s, -1
        out = array("i")
        while n:
            if piece[n] >= 0:
                out.append(piece[n])
            else:
                out.extend(int(self.byte_id[c]) for c in reversed(raw[back[n] : n]))
            n = back[n]
        return out[::-1]

    def encode_pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = end - start
        lists: list = [None] * len(n)
        order = np.argsort(n, kind="stable")
        at = 0
        while at < len(order):
            to = at + 1
            width = int(n[order[at]])
            while to < len(order) and (to - at + 1) * int(n[order[to]]) <= CELLS and int(n[order[to]]) <= max(8, 2 * width):
                to += 1
                if to - at > 65536:
                    break
            some = order[at:to]
            at = to
            if len(some) < FEW:
                for i in some.tolist():
                    lists[i] = np.array(self.viterbi_one(data[start[i] : end[i]].tobytes()), dtype=np.int64)
                continue
            width = int(n[some[-1]])
            table = np.zeros((len(some), width), dtype=np.uint8)
            table[np.arange(width)[None, :] < n[some][:, None]] = data[spans(start[some], n[some])]
            back, piece = self.viterbi(table, n[some])
            # walk back all rows together
            pos, out_row, out_id = n[some].copy(), [], []
            rows = np.arange(len(some))
            while len(rows):
                p, b = piece[rows, pos[rows]], back[rows, pos[rows]]
                known = p >= 0
                out_row.append(rows[known])
                out_id.append(p[known].astype(np.int64))
                for r, s, e in zip(rows[~known].tolist(), b[~known].tolist(), pos[rows[~known]].tolist(), strict=True):
                    for c in table[r, s:e][::-1]:
                        out_row.append(np.array([r]))
                        out_id.append(self.byte_id[[c]])
                pos[rows] = b
                rows = rows[b > 0]
            row, ids = np.concatenate(out_row), np.concatenate(out_id)
            by = np.argsort(row[::-1], kind="stable")
            row, ids = row[::-1][by], ids[::-1][by]
            cut = np.searchsorted(row, np.arange(len(some) + 1))
            for k, i in enumerate(some.tolist()):
                lists[i] = ids[cut[k] : cut[k + 1]]
        offsets = np.zeros(len(n) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in lists], out=offsets[1:])
        return offsets, np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.uint32)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and their n + 1 offsets."""
        full = np.flatnonzero(np.diff(offsets) > 0)
        data = np.insert(data, offsets[full], 0x20)
        offsets = offsets + np.append(0, np.cumsum(np.diff(offsets) > 0))
        first = np.zeros(len(data) + 1, dtype=bool)
        if self.cut_spaces and len(data):
            first[1:-1] = (data[1:] == 0x20) & (data[:-1] != 0x20)
        if self.cut_lines and len(data):
            line = data == 0x0A
            first[:-1] |= line
            first[1:] |= line
        first[offsets] = True
        first[len(data)] = False
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(data)) if len(start) else start
        ids, length = self.encode(data, start, end, hash_of(prefix_hash(data), start, end))
        row = np.searchsorted(offsets, start, side="right") - 1
        at = np.zeros(len(offsets), dtype=np.int64)
        np.cumsum(np.bincount(row, weights=length, minlength=len(offsets) - 1).astype(np.int64), out=at[1:])
        return ids, at

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts behind ids, and their n + 1 offsets."""
        data, length = gather_lists(self.surface_at, self.surface, ids.astype(np.int64))
        sums = np.append(0, np.cumsum(length))
        offsets = sums[at]
        full = np.diff(offsets) > 0
        return np.delete(data, offsets[:-1][full]), offsets - np.append(0, np.cumsum(full))


def _pieces(model: str) -> Pieces:
    if model not in _state:
        _state[model] = Pieces(model)
    return _state[model]


def _encode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                ids, at = _pieces(model).texts(*text_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return run


def _decode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                ids = part.column(1).fill_null(pa.scalar([], part.column(1).type)) if part.column(1).null_count else part.column(1)
                at = np.append(0, np.cumsum(ids.value_lengths().to_numpy()))
                data, offsets = _pieces(model).decode(ids.flatten().to_numpy(), at)
                text = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
                yield pa.RecordBatch.from_arrays([part.column(0), text], ["doc_id", "text"])

    return run


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids) for each row of docs(doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode(model), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) for each row of tokens(doc_id, ids)."""
    return tokens.select("doc_id", "ids").mapInArrow(_decode(model), "doc_id long, text string")


def _digest(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            for part in steps(batch):
                data, offsets = text_bytes(part.column(1))
                ids, at = pieces.texts(data, offsets)
                back, back_at = pieces.decode(ids, at)
                raw, was, now = memoryview(ids.astype("<u4")).cast("B"), data.tobytes(), back.tobytes()
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                same = [was[a:b] == now[c:d] for a, b, c, d in zip(offsets[:-1].tolist(), offsets[1:].tolist(), back_at[:-1].tolist(), back_at[1:].tolist(), strict=True)]
                is_byte = np.append(0, np.cumsum(np.isin(ids, pieces.byte_id)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(is_byte[at[1:]] - is_byte[at[:-1]]), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "n_bytes", "ids_crc32", "round_trip"])

    return run


def digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, n_bytes, ids_crc32, round_trip): ids of each whole text, how many are byte pieces, their checksum, and whether they decode to the text."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return x.mapInArrow(_digest(model), "doc_id long, n_tokens long, n_bytes long, ids_crc32 long, round_trip boolean")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
