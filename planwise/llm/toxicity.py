"""Toxicity by noisy-channel deobfuscation: disguised words are restored, then the restored text is scored.

1. A character language model (trigrams of letters) is counted over all documents.
2. Words that letters alone don't explain (digits or signs among letters, a letter twice in a row, three
   or more single letters spelled out over whatever parts them) are read as the output of a noisy channel. Each
   character opens a lattice of letters it may stand for, or of nothing for separators and repeats.
   A Viterbi search finds the strings of greatest joint probability under channel and letter model, once for
   each different word of all documents; of these the one that is most probable as a word is taken, by the
   counts of all words of all documents, a distributed table that grows with them.
   Words and spelled-out runs are decoded whole, whatever their length; where separators may part words,
   the letters are also cut into the words that all documents, plain or restored, make most probable: words of up to
   SHORT letters are broadcast, at most 18,278, and longer ones joined to the runs that hold them.
3. A logistic model over hashed words and prefixes scores a document with its restored words added.
   It is fitted on all labelled documents outside the held-out fold: their features are counted, and each step's
   gradient summed, on the executors, in integers, so that no order of rows changes a result.

Defined cases: words without any letter (numbers, prices, dates) are no disguises; null and empty texts
get the score of a text without words; an empty table gives an empty result; without labels of both kinds every score is the share of toxic labels; repeated rows
score alike; other columns are never read. A null doc_id keeps its row, in the held-out fold if the
empty text's checksum says so.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwise.llm.lexical import BUCKETS, presence
from planwise.llm.piececache import spans
from planwise.llm.storage import collect, drop, materialize
from planwise.llm.textkernel import LOWER, hash_of, prefix_hash, runs, steps, text_bytes, words

FOLDS = 5
FEATURES = 4096
LETTERS = 27
#: Letters that a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = frozenset("-_.*~^'`·• /\\,")
#: Log probabilities of the channel: a plain letter, a disguise, a separator put in, a letter repeated.
PLAIN, DISGUISED, PUT_IN, REPEATED = 0.0, -1.5, -0.5, -1.0
CACHE = 200_000
#: Longer words are decoded each time they occur.
CACHED_BYTES = 64
#: Log probability of a letter outside the vocabulary, and rows that a word of the vocabulary is in at least, as for features.
UNKNOWN, LEAST_ROWS = -4.0, 3

_WORD = re.compile("[a-z]+")
_GAP = re.compile(r"(?:_|[^\w" + re.escape("".join(LEET)) + "])+")
#: Readings that the lattice keeps, and the share of probability that readings no document has as a word get by their letters.
BEST, UNSEEN = 4, 0.01
#: Words in more than one of so many places are common; of those, readings of so many letters at most are broadcast.
HOT, HOT_LETTERS = 4096, 256
#: Letters of the words that every run is held against; the others are joined.
SHORT = 3
#: 64-bit words of a bitmap of hashes: it decides how many rows a join looks at, never what it finds.
MARKS = 1 << 18
#: Evaluations of the model's loss at most, relative gain at which it stops, pairs that it remembers, ridge, tasks that sum, and their integers' unit.
EVALUATIONS, LEAST_GAIN, PAIRS, RIDGE, TASKS, UNIT = 24, 1e-4, 8, 0.05, 128, float(1 << 30)
#: Least z score of a feature's share among toxic documents, and documents that it is in at least.
LEAST_Z, LEAST_DOCS = 4.0, 3
_PRIME = (1 << 61) - 1
_fold = np.zeros(256, dtype=np.uint8)
_fold[65:91] = np.arange(1, 27)
_fold[97:123] = np.arange(1, 27)
#: Letters of U+00C0 to U+00FF without their marks, by the second byte after C3; 0 where there is none.
_LATIN = np.array([ord(c) - 96 if c != " " else 0 for c in "aaaaaaaceeeeiiiidnooooo ouuuuyts"] * 2, dtype=np.uint8)
#: ASCII signs that may stand for a letter, and those of them that often stand beside a word.
_DISGUISE, _MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_DISGUISE[[ord(c) for c in LEET if ord(c) < 128 and not c.isdigit()]] = True
_MARK[[ord(c) for c in "!|(+"]] = True
#: ASCII bytes that are no letter, those of them that a word loses at its edges, bytes that count as letters, and first bytes of signs.
_SIGN = (_fold == 0) & (np.arange(256) < 128)
_EDGE = _SIGN & ~_DISGUISE & ~np.isin(np.arange(256), np.arange(48, 58))
_SPELT = (_fold > 0) | (np.arange(256) == 0xC3)
_LEADS = np.isin(np.arange(256), (0xC2, 0xE2))
#: What a byte is, a bit for each.
_IS_LETTER, _IS_DIGIT, _IS_DISGUISE, _IS_MARK, _IS_SIGN, _IS_EDGE, _IS_SPELT, _IS_LEAD = (np.uint8(1 << i) for i in range(8))
_CODE = np.packbits(np.stack([_fold > 0, np.isin(np.arange(256), np.arange(48, 58)), _DISGUISE, _MARK, _SIGN, _EDGE, _SPELT, _LEADS]), axis=0, bitorder="little")[0]


def letters(data: np.ndarray) -> np.ndarray:
    """Letters 1 to 26 and 0 for others; marks are dropped, and the first byte of such a letter with them."""
    x = _fold[data]
    if (data >= 0x80).any():
        second = np.zeros(len(data), dtype=bool)
        second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0)
        x[second] = _LATIN[data[second] - 0x80]
        keep = np.ones(len(data), dtype=bool)
        keep[:-1] = ~((data[:-1] == 0xC3) & second[1:])
        x = x[keep]
    return x


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LETTERS**3, dtype=np.int64)
    for b in batches:
        for part in steps(b):
            x = letters(text_bytes(part.column(0))[0]).astype(np.int64)
            if len(x) > 2:
                total += np.bincount(x[:-2] * LETTERS**2 + x[1:-1] * LETTERS + x[2:], minlength=len(total))
    code = np.flatnonzero(total)
    if len(code):
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a letter after two others, from all documents; the table has 27**3 entries whatever the corpus."""
    rows = docs.select("text").mapInArrow(_trigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(LETTERS**3)
    for code, count in rows:
        n[code] = count
    n = n.reshape(LETTERS, LETTERS, LETTERS)
    two = n.sum(axis=0)
    one = two.sum(axis=0)
    p1 = (one + 1) / (one.sum() + LETTERS)
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    p3 = (n + 20 * p2) / (n.sum(axis=2, keepdims=True) + 20)
    return np.log(p3)


@lru_cache(4096)
def _options(c: str, last: str) -> list[tuple[str, float]]:
    """What a character may stand for, with the channel's log probabilities; last: the character before it."""
    if "a" <= c <= "z":
        return [(c, PLAIN)] + ([("", REPEATED)] if c == last else [])
    if c in LEET:
        return [(x, DISGUISED) for x in LEET[c]] + [("", DISGUISED - 1)]
    if c in SEPARATORS:
        return [("", PUT_IN)]
    x = letters(np.frombuffer(c.encode(), dtype=np.uint8))
    return [(chr(96 + int(x[-1])), PLAIN)] if len(x) and x[-1] else [("", PUT_IN)]


def lattice(word: str, lm: np.ndarray | list[float], most: int = 1) -> list[tuple[float, float, str]]:
    """(log probability, the channel's part of it, letters) of the most probable letters behind a word, best first.

    Each state of the language model keeps its `most` best strings; strings are told apart by a running hash.
    lm: the model's table, or its entries in a row, which many words can share.
    """
    flat = lm if isinstance(lm, list) else lm.ravel().tolist()
    beam: dict = {0: [(0.0, 0.0, 0, None)]}  # by the last two letters
    last = ""
    for c in word.lower():
        options, last = _options(c, last), c
        now: dict = {}
        for state, paths in beam.items():
            for x, cost in options:
                if x:
                    k = ord(x) - 96
                    gain = cost + flat[state * LETTERS + k]
                    to = now.setdefault(state % LETTERS * LETTERS + k, {})
                    for score, channel, h, path in paths:
                        own = (h * 31 + k) % _PRIME
                        score += gain
                        if own not in to or score > to[own][0]:
                            to[own] = (score, channel + cost, own, (path, x))
                else:
                    to = now.setdefault(state, {})
                    for score, channel, own, path in paths:
                        score += cost
                        if own not in to or score > to[own][0]:
                            to[own] = (score, channel + cost, own, path)
        beam = {state: sorted(to.values(), key=_negative)[:most] if len(to) > 1 else list(to.values()) for state, to in now.items()}
    ends = sorted(((s + flat[state * LETTERS], channel, path) for state, paths in beam.items() for s, channel, _, path in paths), key=_negative)
    out = []
    for score, channel, path in ends[:most]:
        got = []
        while path is not None:
            path, x = path
            got.append(x)
        out.append((float(score), channel, "".join(reversed(got))))
    return out


def _negative(path: tuple) -> float:
    return -path[0]


def restore(word: str, lm: np.ndarray) -> str:
    """The most probable letters behind a word."""
    return lattice(word, lm)[0][2]


def cut(run: str, vocabulary: dict[int, dict[str, float]]) -> list[str]:
    """The most probable words of a run of letters; letters outside the vocabulary stay together."""
    best, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
    for e in range(1, len(run) + 1):
        best[e], back[e] = best[e - 1] + UNKNOWN, 0
        for n, own in vocabulary.items():
            if n > e:
                break
            s = best[e - n] + own.get(run[e - n : e], -math.inf)
            if s > best[e]:
                best[e], back[e] = s, n
    out, e, rest = [], len(run), len(run)
    while e > 0:
        n = back[e]
        if n:
            out += [run[e:rest], run[e - n : e]]
            rest = e - n
        e -= n or 1
    return [w for w in reversed([*out, run[:rest]]) if w]


def parted(word: str) -> list[str]:
    """A word, and where its gaps have different widths also what the wider ones part."""
    gaps = {len(g) for g in _GAP.findall(word)}
    return [word] + (re.split(_GAP.pattern[:-1] + f"{{{min(gaps) + 1},}}", word) if len(gaps) > 1 else [])


def composed(word: str, best: list[str], vocabulary: dict[int, dict[str, float]] | None) -> str:
    """The letters behind a word's parts, and where it has separators also the words that these may part; empty if that is the word as written."""
    out = best[:1] + (cut(best[0], vocabulary) if vocabulary and _GAP.search(word) else []) + best[1:]
    got = " ".join(dict.fromkeys(w for w in out if w))
    return "" if got == word.lower() else got


def _at(data: np.ndarray, signs: str) -> np.ndarray:
    """Where bytes are the first of one of the signs, which need two or three each."""
    out = np.zeros(len(data), dtype=bool)
    for c in signs:
        raw = c.encode()
        hit = data[: max(len(data) - len(raw) + 1, 0)] == raw[0]
        for i in range(1, len(raw)):
            hit = hit & (data[i : len(data) - len(raw) + 1 + i] == raw[i])
        out[: len(hit)] |= hit
    return out


def _sums(member: np.ndarray) -> np.ndarray:
    """Number of true bytes before each place."""
    out = np.zeros(len(member) + 1, dtype=np.int32)
    np.cumsum(member.view(np.int8), out=out[1:])
    return out


def _any(member: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether spans, none of them empty, have a true byte."""
    if not len(start):
        return np.zeros(0, dtype=bool)
    return np.logical_or.reduceat(np.append(member, False), np.stack([start, end], axis=1).ravel())[::2]


def suspects(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of words with signs or digits among letters, or a letter twice in a row."""
    start, end, row = words(data, offsets)
    code = _CODE[data]
    inside = code & _IS_EDGE == 0  # marks around a word are no part of it
    place, n_inside = np.flatnonzero(inside), _sums(inside)
    first, last = n_inside[start], n_inside[end]
    some = last > first
    start, end, row = place[first[some]], place[last[some] - 1] + 1, row[some]
    fold, sign = _fold[data], code & _IS_SIGN > 0
    # signs beyond ASCII: those of U+0080 to U+00BF and U+2000 to U+20FF
    lead = np.flatnonzero(code & _IS_LEAD)
    sign[lead[(data[lead] == 0xC2) | (data[np.minimum(lead + 1, len(data) - 1)] < 0x84)]] = True
    odd = sign.copy()
    odd[1:] |= (fold[1:] == fold[:-1]) & (fold[1:] > 0)
    # few bytes are signs or repeat a letter; a word's first byte repeats none of its own
    odd = np.flatnonzero(odd)
    word = np.searchsorted(start, odd, side="right") - 1
    odd, word = odd[word >= 0], word[word >= 0]
    word = word[(odd < end[word]) & (sign[odd] | (odd > start[word]))]
    word = word[np.append(True, word[1:] != word[:-1])[: len(word)]]
    word = word[end[word] - start[word] >= 2]
    word = word[_any(code & _IS_SPELT > 0, start[word], end[word])]
    return start[word], end[word], row[word]


def spelled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of three or more single characters next to each other, whatever parts them.

    Beside a character, signs that may be marks as well as disguises don't count: '(a s s)', '!i d i o t!'.
    """
    none = np.zeros(0, dtype=np.int64)
    if not len(data):
        return none, none, none
    code = _CODE[data]
    member = code & (_IS_LETTER | _IS_DIGIT | _IS_DISGUISE) > 0
    begins = member.copy()
    high = np.flatnonzero(data >= 128)
    if len(high):
        raw = data[high]
        first = raw >= 0xC0
        sign = (raw == 0xC2) | (raw == 0xE2) & (np.append(data[1:], 0)[high] < 0x84)
        sign &= ~_at(data, "€£¡")[high]
        # bytes of a sign beyond ASCII part characters as ASCII signs do
        lead = np.maximum.accumulate(np.where(first | (np.diff(high, prepend=-2) > 1), np.arange(len(high)), 0))
        member[high] = ~sign[lead]
        begins[high] = member[high] & first
    start, end, row = runs(member, offsets)
    n = np.zeros(len(data) + 1, dtype=np.int64)  # characters, and above them those that are no marks
    np.cumsum(begins.astype(np.int64) + ((begins & (code & _IS_MARK == 0)).astype(np.int64) << 32), out=n[1:])
    n = n[end] - n[start]
    single = (n & 0xFFFFFFFF == 1) | (n >> 32 == 1)
    joined = np.append(False, single[1:] & single[:-1] & (row[1:] == row[:-1])) if len(start) else single
    begin = np.flatnonzero(single & ~joined)
    stop = np.flatnonzero(single & ~np.append(joined[1:], False))
    long = stop - begin >= 2
    s, e, row = start[begin[long]], end[stop[long]], row[begin[long]]
    some = _any((code & _IS_LETTER > 0) | (data >= 0xC0), s, e)
    return s[some], e[some], row[some]


def suspected(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of all that may be disguised."""
    return tuple(np.concatenate(x) for x in zip(suspects(data, offsets), spelled(data, offsets), strict=True))


def distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and key of the different words of each row that may be disguised, by row; a key is two hashes of 64 bits."""
    start, end, row = suspected(data, offsets)
    # only the bytes of these words are hashed: a hash goes by them alone, wherever they are
    own, last = data[spans(start, end - start)], np.cumsum(end - start)
    key = np.stack([hash_of(prefix_hash(x), last - (end - start), last) for x in (own, 255 - own)], axis=1)
    order = np.lexsort((key[:, 1], key[:, 0], row))
    row, key = row[order], key[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1]).any(axis=1)
    return start[order][new], end[order][new], row[new], key[new]


def _binary(key: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(key), [None, pa.py_buffer(np.ascontiguousarray(key))]).cast(pa.binary())


def restored(data: np.ndarray, offsets: np.ndarray, lm: np.ndarray, known: dict[bytes, str], vocabulary: dict[int, dict[str, float]] | None = None) -> list[list[str]]:
    """Restored words of each row, but for those that are the word as written."""
    out: list[list[str]] = [[] for _ in range(len(offsets) - 1)]
    raw = data.tobytes()
    for s, e, r in zip(*(x.tolist() for x in suspected(data, offsets)), strict=True):
        w = raw[s:e]
        got = known.get(w)
        if got is None:
            word = w.decode("utf-8", "ignore")
            got = composed(word, [restore(x, lm) for x in parted(word)], vocabulary)
            if len(w) <= CACHED_BYTES:
                if len(known) >= CACHE:
                    known.clear()
                known[w] = got
        if got:
            out[r].append(got)
    return out


def vocabulary(texts: pa.Table, lm: np.ndarray) -> dict[int, dict[str, float]]:
    """Log probabilities of the words, written plainly or restored, of at least LEAST_ROWS texts, by their length."""
    seen: Counter = Counter()
    known: dict = {}
    for batch in texts.combine_chunks().to_batches():
        for part in steps(batch):
            column = part.column(part.schema.get_field_index("text"))
            for text, extra in zip(column.to_pylist(), restored(*text_bytes(column), lm, known), strict=True):
                seen.update({*_WORD.findall(text.lower()), *" ".join(extra).split()})
    seen = {w: n for w, n in seen.items() if n >= LEAST_ROWS and (len(w) > 1 or w in "aio")}
    total = sum(seen.values())
    out: dict = {n: {} for n in sorted({len(w) for w in seen})}
    for w, n in seen.items():
        out[len(w)][w] = math.log(n / total)
    return out


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in steps(b):
            data, offsets = text_bytes(part.column(0))
            start, end, _, key = distinct(data, offsets)
            order = np.lexsort((key[:, 1], key[:, 0]))
            key = key[order]
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))[: len(key)])
            n = np.diff(np.append(first, len(key)))
            raw, at = data.tobytes(), order[first]
            words = [raw[s:e].decode("utf-8", "ignore") for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([_binary(key[first]), pa.array(words, pa.string()), pa.array(n.astype(np.int64))], ["key", "word", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plain words; one with a letter three times in a row is an output of the channel, however often it is written."""
    for b in batches:
        for part in steps(b):
            data, offsets = text_bytes(part.column(0))
            start, end, _ = runs(_fold[data] > 0, offsets)
            low = LOWER[data]
            thrice = np.zeros(len(low), dtype=bool)
            thrice[2:] = (low[2:] == low[1:-1]) & (low[2:] == low[:-2])
            n_thrice = np.append(0, np.cumsum(thrice))
            plain = n_thrice[end] == n_thrice[np.minimum(start + 2, end)]
            start, end = start[plain], end[plain]
            _, first, n = np.unique(hash_of(prefix_hash(low), start, end), return_index=True, return_counts=True)
            start, size = start[first], (end - start)[first]
            at = np.append(0, np.cumsum(size)).astype(np.int32)
            plain = pa.StringArray.from_buffers(len(size), pa.py_buffer(at), pa.py_buffer(low[spans(start, size)]))
            yield pa.RecordBatch.from_arrays([plain, pa.array(n.astype(np.int64))], ["reading", "seen"])


def _lattices(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = model.value.ravel().tolist()
        for b in batches:
            for s in range(0, b.num_rows, 500):
                some = b.slice(s, 500)
                rows = []
                for key, word, n in zip(*(some.column(i).to_pylist() for i in range(3)), strict=True):
                    for i, part in enumerate(parted(word)):
                        rows += [(key, None if i or k else word, n, i, x, channel, score) for k, (score, channel, x) in enumerate(lattice(part, lm, BEST))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, (pa.binary(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64()), strict=True)], ["key", "word", "n", "part", "reading", "channel", "score"])

    return run


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, word, n, best, parted): the most probable reading of each part of a word; whether gaps may part words in it."""
    for b in batches:
        for s in range(0, b.num_rows, 500):
            some = b.slice(s, 500)
            out = []
            for found in some.column(3).to_pylist():
                best: dict = {}
                for x in found:
                    best[x["part"]] = max(best.get(x["part"], (-math.inf, "")), (x["joint"], x["reading"]))
                out.append([best[i][1] for i in sorted(best)])
            yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(out, pa.list_(pa.string())), pa.array([bool(_GAP.search(w)) for w in some.column(1).to_pylist()], pa.bool_())], ["key", "word", "n", "best", "parted"])


def _composed(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 500):
                some = b.slice(s, 500)
                out = []
                for word, best, held in zip(*(some.column(i).to_pylist() for i in (1, 3, 4)), strict=True):
                    longer: dict = {}
                    for x in held or ():
                        longer.setdefault(len(x["reading"]), {})[x["reading"]] = x["p"]
                    out.append(composed(word, best, {**model.value, **dict(sorted(longer.items()))}))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(out, pa.string()), some.column(2)], ["key", "reading", "n"])

    return run


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = np.array([zlib.crc32(w.encode()) for w in b.column(0).to_pylist()], dtype=np.uint64) % np.uint64(64 * MARKS)
        bits = np.uint64(1) << (h & np.uint64(63))
        yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(6)).astype(np.int64)), pa.array(bits.view(np.int64))], ["at", "bits"])


def _pieces(marks, most: int):
    """(key, reading): parts of more than SHORT letters of each word's letters that may be words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = marks.value
        for b in batches:
            keys, found = [], []
            for key, letters_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw, own = letters_.encode(), set()
                for s in range(len(raw)):
                    for e in range(s + SHORT + 1, min(s + most, len(raw)) + 1):
                        h = zlib.crc32(raw[s:e]) % (64 * MARKS)
                        if marked[h >> 6] >> (h & 63) & 1:
                            own.add(raw[s:e])
                keys += [key] * len(own)
                found += [x.decode() for x in own]
                if len(keys) > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["key", "reading"])
                    keys, found = [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["key", "reading"])

    return run


def lexicon(counts: DataFrame, best: DataFrame) -> DataFrame:
    """(reading, p): log probabilities of the words of all documents, plain or restored, that cut() can use, a written table.

    A word that is no more probable than as many letters outside the vocabulary is never cut out, and is left out.
    """
    restored_words = best.where("not parted").select(F.col("best")[0].alias("reading"), F.col("n").alias("seen"))
    words_ = counts.unionByName(restored_words).groupBy("reading").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= LEAST_ROWS)
    words_ = materialize(words_.where("length(reading) > 1 or reading in ('a', 'i', 'o')"), "words")
    total = words_.agg(F.sum("seen")).first()[0] or 1
    out = materialize(words_.select("reading", (F.log("seen") - math.log(total)).alias("p")).where(F.col("p") > UNKNOWN * F.length("reading")), "lexicon")
    drop(words_)
    return out


def with_words(best: DataFrame, counts: DataFrame) -> tuple[DataFrame, dict[int, dict[str, float]], DataFrame]:
    """best with the words of more than SHORT letters that each word with gaps holds, the shorter words, and the written table that is read."""
    spark, found = best.sparkSession, lexicon(counts, best)
    short: dict = {n: {} for n in range(1, SHORT + 1)}
    for w, p in found.where(F.length("reading") <= SHORT).collect():  # 26 + 26**2 + 26**3 at most
        short[len(w)][w] = p
    longer = found.where(F.length("reading") > SHORT)
    marks = np.zeros(MARKS, dtype=np.uint64)
    for at, bits in longer.select("reading").mapInArrow(_marked, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).collect():
        marks[at] = bits & 0xFFFFFFFFFFFFFFFF
    most = longer.agg(F.max(F.length("reading"))).first()[0] or 0
    runs_ = best.where("parted").select("key", F.col("best")[0].alias("letters"))
    pieces = runs_.mapInArrow(_pieces(spark.sparkContext.broadcast([int(x) for x in marks]), most), "key binary, reading string")
    held = pieces.join(longer, "reading").groupBy("key").agg(F.collect_list(F.struct("reading", "p")).alias("held"))
    return best.join(held, "key", "left").select("key", "word", "n", "best", "held"), short, found


def read_words(docs: DataFrame, lm: np.ndarray, vocabulary: dict[int, dict[str, float]] | None = None) -> DataFrame:
    """(key, reading, n): all different disguised words of docs, what they stand for, and the documents they are in.

    The lattice proposes BEST readings by letters. They are weighed by how often all documents have them as plain words: a
    table that grows with the documents' vocabulary, and is joined, neither collected nor broadcast. Runs are cut into the
    words of `vocabulary`, or of all documents where none is given.
    """
    context = docs.sparkSession.sparkContext
    counts = materialize(docs.select("text").mapInArrow(_counted, "reading string, seen long").groupBy("reading").agg(F.sum("seen").alias("seen")), "words")
    total = counts.agg(F.sum("seen")).first()[0] or 1
    found = docs.select("text").mapInArrow(_found, "key binary, word string, n long").groupBy("key", "word").agg(F.sum("n").alias("n"))
    options = found.mapInArrow(_lattices(context.broadcast(lm)), "key binary, word string, n long, part int, reading string, channel double, score double")
    joint = F.when(F.col("seen").isNull(), F.col("score") + math.log(UNSEEN)).otherwise(F.col("channel") + F.log((1 - UNSEEN) / total * F.col("seen") + UNSEEN * F.exp(F.col("score") - F.col("channel"))))
    weighed = options.join(counts, "reading", "left").groupBy("key").agg(F.max("word").alias("word"), F.max("n").alias("n"), F.collect_list(F.struct("part", joint.alias("joint"), "reading")).alias("found"))
    best = materialize(weighed.mapInArrow(_best, "key binary, word string, n long, best array<string>, parted boolean"), "best")
    if vocabulary is None:
        x, vocabulary, words_ = with_words(best, counts)
    else:
        x, words_ = best.drop("parted").withColumn("held", F.lit(None).cast("array<struct<reading: string, p: double>>")), best
    out = materialize(x.mapInArrow(_composed(context.broadcast(vocabulary)), "key binary, reading string, n long").where("reading <> ''"), "readings")
    drop(counts, best, words_)
    return out


def _own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in steps(b):
            _, _, row, key = distinct(*text_bytes(part.column(1)))
            at = np.append(0, np.cumsum(np.bincount(row, minlength=part.num_rows))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at), _binary(key))], ["place", "keys"])


def training(docs: DataFrame, labels: DataFrame, read: DataFrame) -> DataFrame:
    """(text, y) of all labelled documents outside the fold, with their restored words; a written table.

    A bitmap of the labelled ids leaves most other texts out before they travel; the join decides.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") >= 1).alias("y"))
    at, bit = F.expr(f"shiftright(pmod(xxhash64(doc_id), {64 * MARKS}), 6)"), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 64) as int))")
    marks = own.select(at.alias("mark"), bit.alias("bits")).groupBy("mark").agg(F.bit_or("bits").alias("bits"))  # MARKS rows at most
    some = docs.where("doc_id is not null").withColumn("mark", at).join(F.broadcast(marks), "mark").where(F.col("bits").bitwiseAND(bit) != 0)
    texts = some.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).join(own, "doc_id")
    texts = materialize(texts.select(F.monotonically_increasing_id().alias("place"), "text", "y"), "labelled")
    extra = readings_of(texts.select("place", "text").mapInArrow(_own_keys, "place long, keys array<binary>"), read)
    out = materialize(texts.join(extra, "place", "left").select(F.when(F.col("extra").isNull(), F.col("text")).otherwise(F.concat_ws(" ", "text", F.array_join("extra", " "))).alias("text"), "y"), "training")
    drop(texts)
    return out


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, one = np.zeros(BUCKETS, dtype=np.int32), np.zeros(BUCKETS, dtype=np.int32)
    for b in batches:
        for part in steps(b):
            row, f = presence(*text_bytes(part.column(0)))
            y = part.column(1).to_numpy(zero_copy_only=False)
            np.add.at(n, f, 1)
            np.add.at(one, f[y[row]], 1)
    seen = np.flatnonzero(n)
    for at in range(0, len(seen), 1 << 16):
        some = seen[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some].astype(np.int64)), pa.array(one[some].astype(np.int64))], ["f", "n", "one"])


def _chosen(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = model.value
        keep = np.zeros(BUCKETS, dtype=bool)
        keep[chosen] = True
        for b in batches:
            for part in steps(b):
                row, f = presence(*text_bytes(part.column(0)), keep)
                at = np.append(0, np.cumsum(np.bincount(row, minlength=part.num_rows))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at), pa.array(np.searchsorted(chosen, f).astype(np.int32))), part.column(1)], ["own", "y"])

    return run


def _slopes(model):
    """One row for each task: the loss, the gradient by feature and by bias, in units of 1 / UNIT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        total = np.zeros(len(w) + 1, dtype=np.int64)
        for b in batches:
            own, y = b.column(0), b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            row, at = np.repeat(np.arange(len(y)), own.value_lengths().to_numpy()), own.flatten().to_numpy()
            z = np.clip(w[-1] + np.bincount(row, weights=w[at], minlength=len(y)), -50, 50)
            d = np.rint((1 / (1 + np.exp(-z)) - y) * UNIT)
            total[0] += np.rint((np.logaddexp(0, z) - y * z) * UNIT).astype(np.int64).sum()
            total[1:-1] += np.bincount(at, weights=d[row], minlength=len(w) - 1).astype(np.int64)
            total[-1] += int(d.sum())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    return run


def minimum(value, start: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Where value(x), a pair of loss and gradient, is least, by limited-memory BFGS from `start`; scale: guess of the inverse second derivatives."""
    x, (f, g) = start, value(start)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    left = EVALUATIONS - 1
    while left > 0:
        q, a = g.copy(), []
        for s, y in reversed(past):
            a.append((q @ s) / (y @ s))
            q -= a[-1] * y
        q *= scale * ((past[-1][0] @ past[-1][1]) / (past[-1][1] * scale @ past[-1][1]) if past else 1)
        for (s, y), k in zip(past, reversed(a), strict=True):
            q += s * (k - (y @ q) / (y @ s))
        step, gain = 1.0, g @ q
        while left > 0:
            left -= 1
            f2, g2 = value(x - step * q)
            if f2 <= f - 1e-4 * step * gain:
                break
            step /= 3
        else:
            break
        s, y = -step * q, g2 - g
        if s @ y > 1e-10 * (y @ y):
            past = [*past, (s, y)][-PAIRS:]
        done = f - f2 < LEAST_GAIN * f
        x, f, g = x + s, f2, g2
        if done:
            break
    return x


def fit(examples: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) of a logistic model with a ridge penalty, on all rows of examples(text, y)."""
    context = examples.sparkSession.sparkContext
    n, ones = examples.agg(F.count("*"), F.coalesce(F.sum(F.col("y").cast("long")), F.lit(0))).first()
    share = (ones + 0.5) / (n + 1)
    bias = math.log(share / (1 - share))
    if not 0 < ones < n:
        return np.zeros(0, np.int64), np.zeros(0), bias
    tallies = examples.mapInArrow(_tallies, "f int, n long, one long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("one").alias("one")).where(F.col("n") >= LEAST_DOCS)
    z = F.abs(F.col("one") - F.col("n") * (ones / n)) / F.sqrt(F.col("n") * (ones / n * (1 - ones / n)))
    top = sorted(tallies.select("f", "n", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "f").limit(FEATURES).collect())
    chosen, seen = (np.array([r[i] for r in top], dtype=np.int64) for i in (0, 1))
    rows = materialize(examples.mapInArrow(_chosen(context.broadcast(chosen)), "own array<int>, y boolean"), "features")

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        sent = context.broadcast(w)
        parts = rows.coalesce(TASKS).mapInArrow(_slopes(sent), "total binary").collect()
        total = sum(np.frombuffer(x, dtype=np.int64) for (x,) in parts) / UNIT
        sent.unpersist()
        return float(total[0]) + RIDGE / 2 * float(w[:-1] @ w[:-1]), total[1:] + RIDGE * np.append(w[:-1], 0)

    curve = share * (1 - share)
    w = minimum(value, np.append(np.zeros(len(chosen)), bias), 1 / np.append(seen * curve + RIDGE, n * curve))
    drop(rows)
    return chosen, w[:-1], float(w[-1])


def _first(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, w, b = model.value
        keep = np.zeros(BUCKETS, dtype=bool)
        keep[chosen] = True
        for batch in batches:
            for part in steps(batch):
                n = part.num_rows
                data, offsets = text_bytes(part.column(2))
                row, f = presence(data, offsets, keep)
                f = np.searchsorted(chosen, f)
                z = b + np.bincount(row, weights=w[f], minlength=n) if len(chosen) else np.full(n, b)
                _, _, where, key = distinct(data, offsets)
                at, keys_at = (np.append(0, np.cumsum(np.bincount(x, minlength=n))).astype(np.int32) for x in (row, where))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(z.astype(np.float64)), pa.ListArray.from_arrays(pa.array(at), pa.array(f.astype(np.int32))), pa.ListArray.from_arrays(pa.array(keys_at), _binary(key))], ["doc_id", "held_out", "z", "own", "keys"])

    return run


def _second(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, w, b = model.value
        keep = np.zeros(BUCKETS, dtype=bool)
        keep[chosen] = True
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                z = part.column(2).to_numpy().copy()
                extra = [" ".join(x or ()) for x in part.column(4).to_pylist()]
                if any(extra):
                    row, f = presence(*text_bytes(pa.array(extra, pa.string())), keep)
                    f = np.searchsorted(chosen, f)
                    own = part.column(3)
                    had = np.repeat(np.arange(part.num_rows), own.value_lengths().to_numpy()) * FEATURES + own.flatten().to_numpy()
                    new = ~np.isin(row * FEATURES + f, had)
                    z += np.bincount(row[new], weights=w[f[new]], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], ["doc_id", "held_out", "score"])

    return run


def readings_of(rows: DataFrame, read: DataFrame) -> DataFrame:
    """(place, extra): the readings of each row of rows(place, keys) that has any.

    At most HOT words can be in more than one part in HOT of all places; these meet their readings by broadcast where they
    are short, HOT * HOT_LETTERS characters at most together, the others by a shuffle.
    """
    total = read.agg(F.sum("n")).first()[0] or 0
    often = (F.col("n") * HOT > total) & (F.length("reading") <= HOT_LETTERS)
    hot, cold = read.where(often).select("key", "reading"), read.where(~often).select("key", "reading")
    each = rows.select("place", F.explode("keys").alias("key"))
    met = each.join(F.broadcast(hot), "key").unionByName(each.join(F.broadcast(hot.select("key")), "key", "left_anti").join(cold, "key"))
    return met.groupBy("place").agg(F.collect_list("reading").alias("extra"))


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text); labels: (doc_id, toxic)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = read_words(docs, language_model(docs))
    collect(docs.sparkSession)
    examples = training(docs, labels, read)
    collect(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(examples))
    drop(examples)
    collect(docs.sparkSession)
    x = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_first(model), "doc_id long, held_out boolean, z double, own array<int>, keys array<binary>")
    x = materialize(x.withColumn("place", F.monotonically_increasing_id()), "scores")
    joined = x.drop("keys").join(readings_of(x, read), "place", "left").select("doc_id", "held_out", "z", "own", "extra")
    scored = joined.mapInArrow(_second(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
