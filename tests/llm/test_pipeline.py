"""The pipeline and registered queries on whole small documents against plain Python.

The classifier's decisions are taken from op9's rows, which other tests hold against the labels; all that follows is plain.
"""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from planwise.llm import mixing, sentence_pieces, token_orc
from planwise.llm.components import forest
from planwise.llm.registry import QUERIES
from planwise.llm.textkernel import text_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder, texts by doc_id, sources, quality labels): near copies, shared passages, empty and null texts."""
    r = random.Random(11)
    vocabulary = ["".join(r.choices("abcdeé", k=r.randint(2, 7))) + "x" for _ in range(400)]
    some = lambda n: " ".join(r.choices(vocabulary, k=n))
    base = [some(r.randint(3, 220)) for _ in range(80)]
    passage = some(120)
    texts = [*base, *(f"{some(150)} {passage} {some(r.randint(90, 150))}" for _ in range(4))]
    half = some(45)  # repeats, but has too few words
    texts += [f"{some(150)} {half} {some(90)}" for _ in range(3)]
    for t in base[:25]:
        w = t.split(" ")
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [base[0], base[0], "", None, "  \n ", "a", "z" * 1000, "ab" * 600]
    labels = {}
    for i in range(80):
        labels[i] = int(i % 4 != 1)
        if not labels[i]:
            texts[i] = " ".join(w.upper() + "!!" for w in texts[i].split(" "))
    sources = [None if i % 7 == 0 else f"s{i % 3}" for i in range(len(texts))]
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, (t, s) in enumerate(zip(texts, sources))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, dict(enumerate(texts)), sources, labels


def components(texts, width, percent):
    """(shingles, component) by doc_id."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    pairs = [(i, j) for i in sets for j in sets if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    own = {i: i for i in sets}
    if pairs:
        node, least = forest(*(np.array(c) for c in zip(*pairs)))
        own.update(zip(node.tolist(), least.tolist()))
    return {i: (len(s), own[i]) for i, s in sets.items()}


def without_repeats(texts, length, least_words=0):
    """(kept bytes, spans) by doc_id; runs of fewer whole words stay."""
    raws = {i: (t or "").encode() for i, t in texts.items()}
    seen = {}
    for raw in raws.values():
        for p in range(len(raw) - length + 1):
            seen[raw[p : p + length]] = seen.get(raw[p : p + length], 0) + 1
    out = {}
    for i, raw in raws.items():
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for p in range(len(raw) - length + 1):
            if seen[raw[p : p + length]] > 1:
                gone[p : p + length] = True
        if least_words:
            words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
            for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if sum(s <= a and b <= e for a, b in words) < least_words:
                    gone[s:e] = False
        out[i] = bytes(b for b, g in zip(raw, gone) if not g), int((gone[1:] & ~gone[:-1]).sum() + gone[0])
    return out


def copies(texts, sources, labels):
    """How often the mix takes each document, by doc_id."""
    size = {i: len(WORD.findall(t or "")) for i, t in texts.items()}
    names = sorted({sources[i] for i in texts}, key=lambda s: (s is None, (s or "").encode()))
    total, out = {s: sum(size[i] for i in texts if sources[i] == s) for s in names}, {}
    w = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    free, budget, target = set(names), sum(total.values()), {}
    while True:  # sources whose share is above three epochs get three, the rest share what is left
        level = budget / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] >= 3 * total[s]}
        if not full:
            break
        for s in full:
            target[s] = 3.0 * total[s]
            budget -= target[s]
        free -= full
    target.update({s: level * w[s] for s in free})
    for s in names:
        epochs = min(int(target[s] // total[s]), 3) if total[s] else 0
        left = math.floor(target[s] - epochs * total[s] + 0.5)

        def key(i):
            u = (int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            return -math.log(u) / {None: 1.0, 1: 2.0, 0: 0.5}[labels.get(i)], i

        for i in sorted((i for i in texts if sources[i] == s), key=key):
            if size[i]:
                out[i] = epochs + (left * 2 > size[i])
            left -= size[i]
    return out


def test_pipeline_matches_plain_stages(spark, tables):
    d, texts, sources, labels = tables
    good = {r.doc_id for r in QUERIES["op9_quality_ordinal"](spark, d).collect() if r.kept}
    assert 0 < len(good) < len(texts)
    kept = {i: t for i, t in texts.items() if i in good}
    kept = {i: kept[i] for i, (_, c) in components(kept, 5, 80).items() if c == i}
    assert len(kept) < len(good)
    cut = {i: b.decode("utf-8", "ignore") for i, (b, _) in without_repeats(kept, corpus_pipeline.PASSAGE_BYTES, 51).items()}
    assert any(cut[i] != (t or "") for i, t in kept.items())
    assert any(len(WORD.findall(cut[i])) < len(WORD.findall(kept[i] or "")) for i in kept) and any(n for i, (_, n) in without_repeats(kept, corpus_pipeline.PASSAGE_BYTES).items() if cut[i] == (kept[i] or ""))
    taken = copies(cut, sources, labels)
    pieces = sentence_pieces._pieces(sentence_pieces.MODEL)
    want = []
    for i, n in taken.items():
        ids, _ = pieces.texts(*text_bytes(pa.array([cut[i]])))
        want += [(i, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), True)] * n
    got = corpus_pipeline.run(spark, d).select("doc_id", "n_tokens", "ids_crc32", "round_trip").collect()
    assert len(set(taken.values())) > 1 and sorted(map(tuple, got)) == sorted(want)


def test_registered_suffix_dedup(spark, tables):
    d, texts, _, _ = tables
    want = {i: (len((t or "").encode()), len((t or "").encode()) - len(b), n, hashlib.sha256(b).hexdigest()) for (i, t), (b, n) in zip(texts.items(), without_repeats(texts, 400).values())}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op6_suffix_dedup"](spark, d).collect()}
    assert got == want and any(n > 0 for _, n, _, _ in want.values())


def test_registered_ngram_join(spark, tables):
    from planwise.llm.ngram_join import PERCENT, WIDTH

    d, texts, _, _ = tables
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op10_ngram_join"](spark, d).collect()}
    assert got == components(texts, WIDTH, PERCENT)


def test_registered_token_files(spark, tables):
    d, texts, _, _ = tables
    plain, start = token_orc.Encoder(token_orc.VOCABULARY).tokenizer, 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op2_token_orc"](spark, d).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


def test_registered_sentence_pieces(spark, tables):
    d, texts, _, _ = tables
    pieces = sentence_pieces._pieces(sentence_pieces.MODEL)
    got = {r.doc_id: (r.n_tokens, r.n_bytes, r.ids_crc32, r.round_trip) for r in QUERIES["op5_sentencepiece"](spark, d).collect()}
    for i, t in texts.items():
        ids, _ = pieces.texts(*text_bytes(pa.array([t or ""])))
        assert got[i] == (len(ids), int(np.isin(ids, pieces.byte_id).sum()), zlib.crc32(ids.astype("<u4").tobytes()), True)


def test_stages_begin_with_small_heaps(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if any(w in b.getName() for w in ("Old", "MarkSweep")))
    docs = spark.createDataFrame([(1, "some words", "en", "web", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    before = full()
    corpus_pipeline.encode(spark, docs, "")
    assert full() > before
