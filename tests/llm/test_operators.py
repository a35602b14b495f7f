"""The training-data operators against brute force on small fixtures, with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from planwise.llm import html_extract, maxscore, mixing, ngram_join, quality_ordinal, sentence_pieces, suffix_dedup, token_orc, toxicity, vector_join
from planwise.llm.components import forest
from planwise.llm.storage import new_path
from planwise.llm.textkernel import hash_of, mix64, prefix_hash, text_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=60, seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeé ", k=r.randint(2, 7))).replace(" ", "") + "x" for _ in range(400)]
    base = [" ".join(r.choices(vocabulary, k=r.randint(3, 220))) for _ in range(n)]
    for i in range(n // 3):
        w = r.choice(base).split(" ")
        w[r.randrange(len(w))] = "changed"
        base.append(" ".join(w))
    passage = " ".join(r.choices(vocabulary, k=120))
    return [*base, base[0], base[0], passage + " one", "two " + passage, "", None, "  \n ", "a", "Ab aB", "z" * 1000, "ab" * 600]


def frame(spark, texts):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t), "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string").repartition(3)


def test_ngram_join(spark):
    texts = corpus()
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    u, v = zip(*[(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])])
    want = np.arange(len(sets))
    node, least = forest(np.array(u), np.array(v))
    want[node] = least
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, texts), bits=18, group_rows=6).collect()}
    assert got == {i: (len(s), int(want[i])) for i, s in enumerate(sets)}


def test_linked_sets_share_a_key_and_sets_of_one_phrase_do_not():
    r = np.random.default_rng(5)
    for percent in (50, 75, 80, 85, 95):
        for _ in range(1500):
            both = r.integers(0, 1 << 63, int(r.integers(1, 60)), dtype=np.uint64)
            # near the bound, with the differing shingles where they are in the way most: before all others
            a, b = (np.unique(np.concatenate([both, r.integers(0, 1 << int(r.choice([20, 63])), int(r.integers(0, 9)), dtype=np.uint64)])) for _ in range(2))
            if ngram_join.linked(a, b, percent) and len(np.setxor1d(a, b)):
                at, key = ngram_join.keys([a, b], percent)
                assert np.isin(key[at == 0], key[at == 1]).any(), (percent, len(a), len(b))
    phrase = r.integers(0, 1 << 63, 4, dtype=np.uint64)  # in each of many sets; one shingle of it made all of them one group
    sets = [np.unique(np.concatenate([phrase, r.integers(0, 1 << 63, 300, dtype=np.uint64)])) for _ in range(500)]
    at, key = ngram_join.keys(sets, 85)
    assert len(np.unique(key)) > 0.999 * len(key)


def test_candidate_groups_stay_small_where_counters_are_full(spark):
    # each text has some of a few common phrases; counters that are all alike don't tell them from the rest
    r = random.Random(8)
    phrases = [" ".join(f"p{i}w{k}" for k in range(4)) for i in range(12)]
    texts = [" ".join(f"{r.choice(phrases)} {' '.join(f'{d}x{k}y{j}' for j in range(4))}" for k in range(9)) for d in range(300)]
    table = spark.sparkContext.broadcast(np.full(16, 9, dtype=np.uint16))
    each = frame(spark, texts).select("text").mapInArrow(ngram_join._keys(4, 85, table), "key long, f1 long, n int")
    found = ngram_join.connected_components(ngram_join._chains(each, 85)).groupBy("component").count().collect()
    assert max([x["count"] for x in found], default=0) < 60


def windows(raws, length):
    """Places (row, offset) of byte strings that start at two places."""
    seen = {}
    for raw in raws:
        for p in range(len(raw) - length + 1):
            seen[raw[p : p + length]] = seen.get(raw[p : p + length], 0) + 1
    return {(i, p) for i, raw in enumerate(raws) for p in range(len(raw) - length + 1) if seen[raw[p : p + length]] > 1}


def test_suffix_dedup(spark):
    texts = corpus()
    want = windows([(t or "").encode() for t in texts], 100)
    places = frame(spark, texts).select("doc_id", F.expr("coalesce(xxhash64(text), 0)").alias("text_hash"), "text")
    for hot, often in ((4096, 10_000), (1, 10_000), (4096, 3)):
        found = suffix_dedup.repeated_ranges(places, 100, 20, hot, often).collect()
        assert {(r.doc_id, p) for r in found for p in range(r.s, r.e + 1)} == want, (hot, often)
    out = {r.doc_id: r.text for r in suffix_dedup.removed_text(frame(spark, texts), 400).select("doc_id", "text").collect()}
    assert len(out) == len(texts) and out[texts.index(None)] is None and out[texts.index("z" * 1000)] == ""


def test_suffix_ranks():
    data = np.frombuffer(b"abracadabra" * 3 + b"\x00\xff\x00zz", dtype=np.uint8)
    for length in (1, 5, 8, 11, 20):
        own = [data.tobytes()[i : i + length] for i in range(len(data) - length + 1)]
        order = {x: k for k, x in enumerate(sorted(set(own)))}
        got = suffix_dedup.ranks(data, length)[: len(own)]
        assert [order[x] for x in own] == np.unique(got, return_inverse=True)[1].tolist(), length


def test_removed_text_keeps_runs_of_few_words_and_other_columns(spark):
    short, long = " ".join(f"s{i:06d}" for i in range(20)), " ".join(f"l{i}" for i in range(60))
    rows = [(1, f"one {short} end"), (2, f"two {short} end"), (3, f"three {long} x"), (4, f"four {long} y"), (4, f"other {long} z"), (None, f"null {short} w"), (5, None), (6, ""), (7, "ab " * 40_000)]
    df = spark.createDataFrame([(i, t, "kept", 0) for i, t in rows], "doc_id long, text string, ranges string, text_hash long").withColumnRenamed("text_hash", "Text_Hash")
    got = suffix_dedup.removed_text(df, 100, 32, 51)
    assert got.columns == df.columns
    out = sorted(((r.doc_id, r.text, r.ranges) for r in got.collect()), key=repr)
    assert len(out) == len(rows) and all(r[2] == "kept" for r in out)
    text = {}
    for i, t, _ in out:
        text.setdefault(i, []).append(t)
    assert text[1] == [f"one {short} end"] and text[None] == [f"null {short} w"] and text[5] == [None] and text[6] == [""]
    assert all(long not in t for i in (3, 4) for t in text[i]) and len(text[4]) == 2 and len(text[7][0]) < 200
    assert suffix_dedup.removed_text(df.limit(0)).count() == 0
    assert suffix_dedup._whole_words(b"ab cd ef", 1, 7) == 1 and suffix_dedup._whole_words(b"ab cd ef", 0, 8) == 3 and suffix_dedup._whole_words(b"abcd", 1, 3) == 0


def jaccard(texts, width, percent):
    """Links among rows of texts."""
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]


def test_ngram_join_of_repeated_ids_and_common_shingles(spark, monkeypatch):
    texts = corpus(40, 9)
    ids = [(i * 7) % 31 if i % 5 else None for i in range(len(texts))]
    # rows of one id have different texts; a null id links with nothing
    rows = [k for k, i in enumerate(ids) if i is not None]
    own = list(range(len(texts)))
    links = [(rows[i], rows[j]) for i, j in jaccard([texts[k] for k in rows], 4, 85)]
    if links:
        node, least = forest(*(np.array(c) for c in zip(*links)))
        for n, c in zip(node.tolist(), least.tolist()):
            own[n] = c
    members = {}
    for k, c in enumerate(own):
        members.setdefault(c, []).append(k)
    want = sorted(((ids[k], min((ids[m] for m in members[own[k]]), default=None) if ids[k] is not None else None) for k in range(len(texts))), key=repr)
    df = spark.createDataFrame([(i, t, 7) for i, t in zip(ids, texts)], "doc_id long, text string, text_hash int").repartition(3)
    for full in (255, 2):  # with 2, nearly all counters are full
        monkeypatch.setattr(ngram_join, "SALTS", 4)
        got = ngram_join.jaccard_components(df, bits=18, group_rows=6, full=full).collect()
        assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == want, full
    kept = ngram_join.representatives(df, 4, 85, 18)
    assert kept.columns == df.columns
    kept = kept.collect()
    plain = len({own[k] for k in rows if WORD.search(texts[k] or "")}) + sum(1 for k in range(len(texts)) if k not in rows or not WORD.search(texts[k] or ""))
    assert len(kept) == plain and {r.text for r in kept if r.doc_id is None} == {t for i, t in zip(ids, texts) if i is None}
    assert ngram_join.jaccard_components(df.limit(0), bits=18).count() == ngram_join.representatives(df.limit(0), 5, 80, 18).count() == 0


def test_vector_join_and_top_k(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(80, 16)).astype(np.float32)
    x[40:60] = x[:20] + 0.01 * r.normal(size=(20, 16))
    x[60:65] = x[0]
    rows = [(i, [float(c) for c in v], i % 2 if i % 11 else None) for i, v in enumerate(x)] + [(90, None, 1), (91, [0.0] * 16, 1), (92, [float("nan")] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    ok = [(i, np.array(e), k) for i, e, k in rows if k is not None and i < 90]
    links = [(i, j) for i, a, k in ok for j, b, m in ok if i != j and k == m and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98]
    comp = {i: i for i, _, _ in rows}
    node, least = forest(*(np.array(c) for c in zip(*links)))
    comp.update(zip(node.tolist(), least.tolist()))
    got = {g.vec_id: (g.n_links, g.component_id, g.kept) for g in vector_join.near_duplicates(df, cell_rows=8).collect()}
    assert got == {i: (sum(a == i for a, _ in links), comp[i], comp[i] == i) for i, _, _ in rows}

    q = np.floor(x.astype(np.float64) * 1024)
    want = {(a * 10, rank + 1): (j, int(s)) for a in range(8) for rank, (s, j) in enumerate(sorted((-q[a * 10] @ q[j], j) for j in range(80) if j != a * 10)[:10]) for s in [-s]}
    vectors = maxscore.quantized(df.select("vec_id", "embedding"))
    full = maxscore.top_k(vectors.where("vec_id % 10 = 0 and vec_id < 80"), vectors.where("vec_id < 80"))
    assert {(g.query_id, g["rank"]): (g.vec_id, g.score) for g in full.collect()} == want


def test_top_k_of_repeated_ids(spark):
    r = np.random.default_rng(8)
    rows = [(int(i), [float(v) for v in r.integers(-3, 4, size=int(n))]) for i, n in zip(r.integers(0, 25, size=90), r.choice([3, 5], size=90))]
    rows += [rows[0], rows[0], (10, [1.0, 2.0, 3.0]), (10, [1.0, 2.0]), (10, [1.0, 2.0, 3.0]), (11, [2.0**40] * 3), (11, [-(2.0**40)] * 3)]
    df = spark.createDataFrame([(i, q, 0) for i, q in rows], "vec_id long, q array<double>, rank int").repartition(3)
    want = []
    for a, (i, x) in enumerate(rows):
        if i % 5 == 0 or i == 11:
            scores = sorted((-int(sum(int(u) * int(v) for u, v in zip(x, y))), j) for b, (j, y) in enumerate(rows) if b != a)[:4]
            want += [(i, k + 1, j, -s if abs(s) < 2**63 else (2**63 - 1 if s < 0 else -(2**63))) for k, (s, j) in enumerate(scores)]
    got = maxscore.top_k(df.where("vec_id % 5 = 0 or vec_id = 11"), df, 4, shard_rows=2)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and sorted(map(tuple, got.collect())) == sorted(want)
    assert maxscore.top_k(df.limit(0), df, 4).count() == maxscore.top_k(df, df.limit(0), 4).count() == 0


def test_max_score_leaves_terms_unprobed():
    r = np.random.default_rng(4)
    docs = np.floor(r.normal(size=(4000, 32)) ** 3 * 100)
    shard, stats = maxscore.Shard(np.arange(4000), docs, np.full(4000, 32)), {}
    at, s = shard.topk(docs[7], 5, 500, stats)
    exact = docs @ docs[7]
    assert at.tolist() == np.lexsort((np.arange(4000), -exact))[:5].tolist() and s.tolist() == exact[at].tolist()
    assert stats["probed"] < 0.5 * docs.size


def test_vector_join_of_repeated_ids(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(60, 12))
    x[30:50] = x[:20] + 0.02 * r.normal(size=(20, 12))
    x[50:55] = x[0]
    rows = [(int(i), [float(c) for c in v], 1) for i, v in zip(r.integers(0, 40, size=60), x)] + [(3, [1.0, 0.0], 1), (3, [1.0, 0.01], 1), (5, [2.0], 1), (6, [3.0], 1), (5, None, 1), (None, [1.0, 0.0], 1)]
    ok = [(k, np.array(e)) for k, (i, e, _) in enumerate(rows) if e and i is not None]
    links = [(a, b) for a, u in ok for b, v in ok if a != b and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98]
    own = list(range(len(rows)))
    for n, c in zip(*(z.tolist() for z in forest(*(np.array(z) for z in zip(*links))))):
        own[n] = c
    least = {c: min((rows[k][0] for k in range(len(rows)) if own[k] == c and rows[k][0] is not None), default=None) for c in own}
    want = sorted(((i, sum(a == k for a, _ in links), least[own[k]], i is None or least[own[k]] == i) for k, (i, _, _) in enumerate(rows)), key=repr)
    df = spark.createDataFrame([(*row, 1) for row in rows], "vec_id long, embedding array<double>, label int, node int").repartition(3)
    for cells in (4096, 4):
        got = vector_join.near_duplicates(df, cell_rows=cells).collect()
        assert sorted(map(tuple, got), key=repr) == want, cells
    assert vector_join.near_duplicates(df.limit(0)).count() == 0


def test_mixing(spark):
    docs = frame(spark, corpus())
    got = mixing.plan_mix(docs).collect()
    assert len(got) == len(corpus())
    taken, target = {}, {}
    for g in got:
        assert 0 <= g.taken <= 3 * g.size
        taken[g.source] = taken.get(g.source, 0) + g.taken
        target[g.source] = g.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sorted(map(tuple, mixing.plan_mix(docs).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixing.mix(docs).columns == docs.columns
    # null and repeated ids, repeated rows, and columns of the names that mix() uses
    rows = [(None if i % 4 == 0 else i % 5, t, None if i % 7 == 0 else f"s{i % 3}", i, -i) for i, t in enumerate([*corpus(), *corpus()[:9]] * 2)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string, times int, row_key int").repartition(3)
    plan, mixed = mixing.plan_mix(odd, cut_last=False).collect(), mixing.mix(odd)
    assert len(plan) == len(rows) and mixed.columns == odd.columns
    want = {}
    for g in plan:
        if g.taken:
            key = (g.doc_id, g.source, g.text_hash)
            want[key] = want.get(key, 0) + g.taken // g.size
    mixed = mixed.withColumn("h", F.xxhash64("text")).collect()
    got = {}
    for g in mixed:
        got[g.doc_id, g.source, g.h] = got.get((g.doc_id, g.source, g.h), 0) + 1
    assert got == want and any(k[0] is None for k in want)
    assert mixing.plan_mix(docs.limit(0)).count() == 0


def test_token_files(spark):
    texts = [*corpus(), "it's  'll \t x", "\x1c!\x1cz a\x85b", "é×x ÷y'é's", "日本 語。x"]
    path = new_path(spark, "tokens")
    token_orc.write_tokens(frame(spark, texts), path)
    plain = token_orc.Encoder(token_orc.VOCABULARY).tokenizer
    start = 0
    got = {r.doc_id: r for r in token_orc.digest(spark, path).collect()}
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert [r.doc_id for r in token_orc.read_tokens(spark, path, [5]).collect()] == [5]
    assert sum(f["rows"] for f in token_orc.stripe_metadata(path)) == len(texts)


def test_new_pieces_do_not_copy_the_cache():
    """A new piece takes memory for itself, not for all that the cache holds; lists that find no room are right too."""
    import tracemalloc

    from planwise.llm.piececache import CachedEncoder

    class Lengths(CachedEncoder):
        def encode_pieces(self, data, start, end):
            return np.append(0, np.cumsum(np.full(len(start), 2))), np.stack([end - start, data[start]], axis=1).ravel().astype(np.uint32)

    e, n = Lengths(300_000), 300_000
    e.cache.add(mix64(np.arange(1, n, dtype=np.uint64)), 2 * np.arange(n), np.zeros(2 * n - 2, np.uint32))
    data, at = np.frombuffer(b"abcabd", np.uint8), np.array([0, 3, 5])
    e.encode(data, at[:1], at[1:2], np.array([5], np.uint64))  # the one that there is room for
    tracemalloc.start()
    values, length = e.encode(data, at, np.array([3, 5, 6]), np.array([5, 7, 9], np.uint64))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert values.tolist() == [3, 97, 2, 97, 1, 100] and length.tolist() == [2, 2, 2]
    assert e.cache.n == n and most < 1 << 20


def test_token_files_of_repeated_ids_stripes_and_pruning(spark, tmp_path):
    r = random.Random(2)
    rows = [(None if i % 50 == 7 else i // 3, " ".join(r.choices(["alpha", "beta", "gamma", "delta"], k=r.randint(0, 300)))) for i in range(6000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, part string, block int")
    path = new_path(spark, "tokens")
    shuffled = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        token_orc.write_tokens(df, path, stripe_bytes=50_000)
        assert max(f["stripes"] for f in token_orc.stripe_metadata(path)) >= 2
        tokens = token_orc.read_tokens(spark, path)
        assert tokens.rdd.getNumPartitions() > len(token_orc.stripe_metadata(path))  # stripes of a file are read apart
        got = token_orc.digest(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
    plain = token_orc.Encoder(token_orc.VOCABULARY).tokenizer
    want = sorted(((i, zlib.crc32(np.array([*plain.encode(t, add_special_tokens=False).ids, 2], dtype="<u4").tobytes())) for i, t in rows), key=repr)
    assert sorted(((g.doc_id, g.ids_crc32) for g in got), key=repr) == want
    at, last = 0, -1
    for g in sorted(got, key=lambda g: g.start):
        assert g.start == at and (g.doc_id is None or g.doc_id >= last)
        at, last = at + g.n_tokens, -1 if g.doc_id is None else g.doc_id
    one = token_orc.read_tokens(spark, path, [700])
    one.collect()
    plan = one._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    assert {x.doc_id for x in one.collect()} == {700} and plan.metrics().get("numOutputRows").get().value() <= 2 * token_orc.ROW_GROUP  # of 6,000
    token_orc.write_tokens(df.limit(0), f"{path}-none")
    assert token_orc.read_tokens(spark, f"{path}-none").count() == 0


def test_sentence_pieces_of_unbroken_runs(monkeypatch):
    """Parts done one by one and in tables have the same ids; a run of 400,000 bytes is no trouble."""
    rng = random.Random(3)
    signs = "abcdefghij ABC019+/=é▁漢🙂\t\n"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 300))) for _ in range(80)] + [None, "", " ", "é" * 300, "漢" * 200 + "🙂" * 50]
    column = text_bytes(pa.array(texts, pa.string()))
    found = []
    for few in (0, 48, 1 << 30):
        monkeypatch.setattr(sentence_pieces, "FEW", few)
        found.append(sentence_pieces.Pieces().texts(*column))
    for ids, at in found[1:]:
        assert np.array_equal(ids, found[0][0]) and np.array_equal(at, found[0][1])
    run = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(400_000))
    p = sentence_pieces._pieces(sentence_pieces.MODEL)
    ids, at = p.texts(*text_bytes(pa.array([run], pa.string())))
    assert p.decode(ids, at)[0].tobytes() == run.encode()


def test_sentence_pieces(spark):
    p = sentence_pieces._pieces(sentence_pieces.MODEL)
    texts = [*corpus()[:30], "a  b", "x\n\ny", "▁ é 𐍈", "日本"]
    ids, at = p.texts(*text_bytes(pa.array(texts)))
    keys = {bytes(p.surface[p.surface_at[i] : p.surface_at[i + 1]]): p.score[i] for i in range(len(p.score)) if i not in set(p.byte_id.tolist())}
    for i, t in enumerate(texts):
        raw = (b" " + t.encode()) if t else b""
        best = [0.0] + [-np.inf] * len(raw)
        for s in range(len(raw)):
            if best[s] == -np.inf:
                continue
            size = 1 if raw[s] < 0x80 else 2 if raw[s] < 0xE0 else 3 if raw[s] < 0xF0 else 4
            for e in range(s + 1, min(len(raw), s + p.longest) + 1):
                if raw[s:e] in keys:
                    best[e] = max(best[e], best[s] + keys[raw[s:e]])
            if raw[s : s + size] not in keys:
                best[s + size] = max(best[s + size], best[s] + p.fallback)
        score, k, own = 0.0, 0, ids[at[i] : at[i + 1]].tolist()
        while k < len(own):
            if own[k] in set(p.byte_id.tolist()):
                b = int(np.flatnonzero(p.byte_id == own[k])[0])
                k += 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                score += p.fallback
            else:
                score += p.score[own[k]]
                k += 1
        assert score == pytest.approx(best[-1])
    df = frame(spark, texts)
    back = {r.doc_id: r.text for r in sentence_pieces.decode(sentence_pieces.encode(df)).collect()}
    assert back == dict(enumerate(texts))
    assert all(r.round_trip for r in sentence_pieces.digest(frame(spark, corpus())).collect())


def test_html():
    page = "<html><body><header><h1>Site</h1></header><div id=menu>a b</div><div class='content'><h1>T</h1><p>Hello, world, this is a paragraph of text.<p>Second  one,\n with &amp; more text here.<ul><li>one item<li>two</ul></div><div class=comments><p>nice, post, friends, really long comment</p></div><footer>c</footer></body></html>"
    assert html_extract.main_text(page) == "T\nHello, world, this is a paragraph of text.\nSecond one, with & more text here.\none item\ntwo"
    assert html_extract.main_text(None) == html_extract.main_text("") == ""


LONG = "A long paragraph, with commas, and enough text to count, as articles have them, again and again."


def test_html_keeps_the_whole_article():
    ten, lines = f"<p>{LONG}</p>" * 10, [LONG] * 10
    small = "<section><p>Short, last section of it.</p></section><ul><li>an item</ul><dl><dt>term<dd>meaning</dl><figure><figcaption>caption</figcaption></figure><h5>minor</h5><table><tr><td>cell</table>"
    texts = ["Short, last section of it.", "an item", "term", "meaning", "caption", "minor", "cell"]
    for tag in ("article", "main", "div"):
        page = f"<body><div><ul><li><a href=a>One link</a><li><a href=b>Another link</a></ul><{tag}><section>{ten}</section>{small}</{tag}></div></body>"
        assert html_extract.main_text(page).split("\n") == lines + texts, tag
    climbed = f"<body><article><h1>Title</h1><div><div>{ten}</div></div></article></body>"
    assert html_extract.main_text(climbed).split("\n") == ["Title", *lines]
    for around in ("article", "div"):
        page = f"<body><{around}><h1>Title</h1>own text<div><div>{ten}</div></div></{around}><div><a href=x>only links here</a></div></body>"
        assert html_extract.main_text(page).split("\n") == ["Title", "own text", *lines], around


@pytest.mark.parametrize("wrapper", ["content has-sidebar", "page no-sidebar", "with-comments", "main-content nav-open", "sidebar", "header"])
def test_html_names_that_hold_the_article(wrapper):
    ten, lines = f"<p>{LONG}</p>" * 10, [LONG] * 10
    noise = f"<div class='main-sidebar'><p>{LONG}</p></div><div id=comments class='comments-area'><article><p>{LONG}</p></article></div><div class='ad-slot ad-300x250'>{LONG}</div>"
    for page in (f"<div class='{wrapper}'><div>{ten}</div></div>{noise}", f"<div class='{wrapper}'><div>{ten}</div>{noise}</div>", f"<div class='{wrapper}'><article>{ten}</article></div>{noise}"):
        assert html_extract.main_text(f"<body>{page}</body>").split("\n") == lines, page


def test_html_names_inside_the_article():
    page = f"<body><article><div class='entry-header'><h1>Title</h1></div><p>{LONG}</p><h2 id='related-work'>Related work</h2><section id='search-results'><p>{LONG}</p></section><h3 id=comments>Comments on it</h3><div class=share-buttons>tell friends</div></article></body>"
    assert html_extract.main_text(page).split("\n") == ["Title", LONG, "Related work", LONG, "Comments on it"]


def test_toxicity_and_quality(spark):
    r = random.Random(5)
    texts = corpus(120, 5)
    labels = []
    for i, t in enumerate(texts):
        toxic = i % 5 == 0 and bool(t)
        if toxic:
            texts[i] = t + r.choice([" moron", " m0r0n", " mooooron", " m.o.r.o.n"])
        bad = i % 4 == 1 and bool(t)
        if bad:
            texts[i] = " ".join(w.upper() + "!!" for w in t.split(" "))
        labels.append((i, 0 if bad else 1, int(toxic)))
    docs, known = frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, known).collect()
    assert len(got) == len(texts) and all(0 <= g.score <= 1 and g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got)
    assert sum(g.predicted == labels[g.doc_id][2] for g in got) >= 0.95 * len(got)
    kept = quality_ordinal.select_good(docs, known)
    assert kept.columns == docs.columns
    good = {i for i, q, _ in labels if q} & {i for i, t in enumerate(texts) if t and len(t) > 60}
    assert len(good - {g.doc_id for g in kept.collect()}) <= 0.05 * len(good)
    clash = docs.withColumns({"p_selected": F.lit("a"), "expected_grade": F.lit(1)})
    assert quality_ordinal.select_good(clash, known).columns == clash.columns
    assert {g.doc_id for g in quality_ordinal.select_good(clash, known).collect()} == {g.doc_id for g in kept.collect()}
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 7))  # null and repeated ids
    assert toxicity.toxicity(odd, known).count() == quality_ordinal.graded(odd, known).count() == len(texts)
    assert toxicity.toxicity(docs.limit(0), known).count() == quality_ordinal.graded(docs.limit(0), known).count() == 0


def test_digest_of_kept_bytes():
    raw, kept, s, e = suffix_dedup._kept("abcdef", [{"s": 1, "e": 1}], 3)
    assert kept == b"aef" and hashlib.sha256(raw).hexdigest() != hashlib.sha256(kept).hexdigest() and (s[0], e[0]) == (1, 4)


def letter_model(texts):
    n = np.zeros(27**3)
    for b in toxicity._trigrams([pa.record_batch({"text": texts})]):
        n[b.column(0).to_numpy()] += b.column(1).to_numpy()
    n = n.reshape(27, 27, 27) + 0.01
    return np.log(n / n.sum(axis=2, keepdims=True))


def test_toxicity_decodes_long_runs_whole():
    words = "you are such a moron and an idiot that we all leave the room when you talk about trees"
    texts = [words] * 5 + ["plain talk about trees"]
    lm = letter_model(texts)
    own = toxicity.vocabulary(pa.table({"text": texts}), lm)
    said = "we all leave the room when you talk about trees and you talk about the room and you are an idiot"
    run = " ".join(said.replace(" ", ""))
    wide = " ".join(" ".join(w) + " " for w in said.split(" "))
    stretched = "m" + "o" * 90 + "ron"
    assert len(run) > 128
    data, offsets = text_bytes(pa.array([run, wide.strip(), stretched, "nothing here", None]))
    got = [" ".join(x).split() for x in toxicity.restored(data, offsets, lm, {}, own)]
    assert "idiot" in got[0] and said.replace(" ", "") in got[0]
    assert "idiot" in got[1] and "moron" in got[2] and got[3] == got[4] == []


def test_toxicity_suspects_what_the_lattice_models():
    texts = ["you idiot and you shit ass fuck loser idiot shit ass loser"] * 5
    lm = letter_model(texts)
    disguised = {"!diot": "idiot", "say |diot": "idiot", "shi+": "shit", "los€r": "loser", "£oser": "loser", "¡diot": "idiot", "iddiot": "idiot", "a s s": "ass", "i - d - i - o - t": "idiot", "i ... d ... i ... o ... t": "idiot", "í d í ó t": "idiot", "f.u.c.k": "fuck", "(a s s)": "ass", "!i d i o t!": "idiot", "i·d·i·o·t": "idiot", "l • o • s • e • r": "loser", "a\ns\ns": "ass"}
    data, offsets = text_bytes(pa.array([*disguised, "12:30 on 2024-01-02", "a cat", "you and", "日本 語 本"]))
    got = toxicity.restored(data, offsets, lm, {})
    for (text, want), found in zip(disguised.items(), got):
        assert want in " ".join(found).split(), text
    assert got[-4] == got[-3] == got[-2] == got[-1] == []


def test_toxicity_hashes_suspect_words_only(monkeypatch):
    """A key goes by its word's bytes, wherever they are; plain text is not hashed for it."""
    data, offsets = text_bytes(pa.array(["plain words all around " * 50 + "1d10t", None, "1d10t i d i o t", ""]))
    start, end, row = toxicity.suspected(data, offsets)
    hashed = []
    monkeypatch.setattr(toxicity, "prefix_hash", lambda x: hashed.append(len(x)) or prefix_hash(x))
    s, e, r, key = toxicity.distinct(data, offsets)
    assert hashed == [(end - start).sum()] * 2
    whole = np.stack([hash_of(prefix_hash(x), s, e) for x in (data, 255 - data)], axis=1)
    assert (key == whole).all() and set(r) == set(row)
    words = [bytes(data[a:b]) for a, b in zip(s, e)]
    assert [k.tobytes() for k, w in zip(key, words) if w == b"1d10t"] == [key[words.index(b"1d10t")].tobytes()] * 2


def test_restore_finds_the_best_path_of_the_lattice():
    lm = letter_model(["you idiot and you shit ass fuck loser idiot shit ass loser"] * 5)

    def every(word):
        """All letter strings that a word may stand for, with the best joint score of each."""
        paths, last = {"": 0.0}, ""
        for c in word:
            if "a" <= c <= "z":
                options = [(c, toxicity.PLAIN)] + ([("", toxicity.REPEATED)] if c == last else [])
            elif c in toxicity.LEET:
                options = [(x, toxicity.DISGUISED) for x in toxicity.LEET[c]] + [("", toxicity.DISGUISED - 1)]
            else:
                options = [("", toxicity.PUT_IN)]
            last, now = c, {}
            for text, score in paths.items():
                a, b = ([0, 0] + [ord(x) - 96 for x in text])[-2:]
                for x, cost in options:
                    s = score + cost + (lm[a, b, ord(x) - 96] if x else 0.0)
                    now[text + x] = max(now.get(text + x, -np.inf), s)
            paths = now
        return {t: s + lm[(*([0, 0] + [ord(x) - 96 for x in t])[-2:], 0)] for t, s in paths.items()}

    for word in ("1d10t", "sh1+", "a$$", "l0s3r", "i-d-i-o-t", "fuuck", "|d!0t", "4ss", "lll1ll", "5h17", "zzz"):
        paths = every(word)
        assert paths[toxicity.restore(word, lm)] == pytest.approx(max(paths.values())), word


def test_quality_on_documents_it_was_not_fitted_on(spark):
    r = random.Random(12)
    texts = corpus(200, 12)[:250]
    bad = {i for i, t in enumerate(texts) if i % 4 in (1, 2) and t}
    texts = [" ".join(w.upper() + "!!" for w in t.split(" ")) if i in bad else t for i, t in enumerate(texts)]
    seen = {i for i in range(len(texts)) if r.random() < 0.6}
    known = spark.createDataFrame([(i, int(i not in bad), 0) for i in sorted(seen)], "doc_id long, quality int, toxic int")
    got = {g.doc_id: g for g in quality_ordinal.graded(frame(spark, texts), known).collect()}
    unseen = [i for i, t in enumerate(texts) if i not in seen and t and len(t) > 60]
    assert len(unseen) > 60 and sum((got[i].p_selected >= 0.5) == (i not in bad) for i in unseen) >= 0.95 * len(unseen)
    assert all(0 <= g.p_selected <= 1 and 0 <= g.expected_grade <= quality_ordinal.GRADES - 1 for g in got.values())


def test_toxicity_weighs_readings_by_all_documents(spark, monkeypatch):
    """Readings against a plain version over whole texts; common words and others meet the documents alike."""
    rng = random.Random(5)
    plain = ["letter", "ball", "stupid", "moron", "better", "a", "ass", "seen", "café"]
    odd = ["stuppid", "stuuupid", "m0r0n", "m.o.r.o.n", "balll", "bet7er", "a s s", "x  y z  u", "1l1", "", "¡diot", "q" * 40 + "!" + "a" * 30]
    texts = [" ".join(rng.choices(plain, k=30) + rng.choices(odd, k=4)) for _ in range(60)] + [None, "", "letter " * 50 + "m0r0n"]
    docs = frame(spark, texts)
    lm = toxicity.language_model(docs)
    read = toxicity.read_words(docs, lm, {})
    got = {bytes(r.key): (r.reading, r.n) for r in read.collect()}
    seen, found, keys = {}, {}, []

    def key_of(w):
        d = np.frombuffer(w, np.uint8)
        return b"".join(hash_of(prefix_hash(x), np.array([0]), np.array([len(d)])).tobytes() for x in (d, 255 - d))

    for t in texts:
        for w in re.findall("[A-Za-z]+", t or ""):
            if not re.search(r"(.)\1\1", w.lower()):
                seen[w.lower()] = seen.get(w.lower(), 0) + 1
        data, offsets = text_bytes(pa.array([t], pa.string()))
        raw, own = data.tobytes(), {}
        for s, e, r in zip(*(x.tolist() for x in toxicity.suspected(data, offsets)), strict=True):
            own[raw[s:e]] = key_of(raw[s:e])
        keys.append(list(own.values()))
        for w in own:
            found[w] = found.get(w, 0) + 1
    total, want = sum(seen.values()), {}
    for w, n in found.items():
        best = []
        for part in toxicity.parted(w.decode("utf-8", "ignore")):
            options = toxicity.lattice(part, lm, toxicity.BEST)
            best.append(max((c + np.log((1 - toxicity.UNSEEN) / total * seen.get(x, 0) + toxicity.UNSEEN * np.exp(s - c)), x) for s, c, x in options)[1])
        reading = toxicity.composed(w.decode("utf-8", "ignore"), best, {})
        if reading:
            want[key_of(w)] = (reading, n)
    assert got == want
    assert got[key_of(b"stuppid")][0] == got[key_of(b"stuuupid")][0] == "stupid" and got[key_of(b"m0r0n")][0] == "moron" and key_of(b"letter") not in got
    places = spark.createDataFrame(list(enumerate(keys)), "place long, keys array<binary>")
    sides = []
    for hot in (1, 20, 1 << 20):
        monkeypatch.setattr(toxicity, "HOT", hot)
        sides.append({r.place: sorted(r.extra) for r in toxicity.readings_of(places, read).collect()})
    assert sides[0] == sides[1] == sides[2] and sides[0]


def test_components_settle_in_few_rounds(spark):
    """A path of random ids and other edges, in small files: each of the rounds makes plans and tasks that the driver remembers."""
    rng = random.Random(9)
    path = rng.sample(range(10_000), 3000)
    edges = list(zip(path, path[1:])) + [(rng.randrange(20_000, 21_000), rng.randrange(20_000, 21_000)) for _ in range(900)] + [(5, 5)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in ngram_join.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(8), rounds=4).collect()}
    node, least = forest(np.array([u for u, _ in edges]), np.array([v for _, v in edges]))
    assert got == dict(zip(node.tolist(), least.tolist()))


@pytest.mark.parametrize("one_task,most", [(1 << 20, 2), (100, 60), (0, 60)])
def test_components_of_few_edges_need_no_rounds(spark, monkeypatch, one_task, most):
    """Few edges make two written tables, whatever their paths' length; more go by rounds, to the same components."""
    from planwise.llm import components

    written = []
    put = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: written.append(name) or put(df, name))
    monkeypatch.setattr(components, "ONE_TASK", one_task, raising=False)
    rng = random.Random(11)
    path = rng.sample(range(10_000), 400)
    edges = [*zip(path, path[1:]), (20_001, 20_000), (7, 7)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()}
    node, least = forest(np.array([u for u, _ in edges]), np.array([v for _, v in edges]))
    assert got == dict(zip(node.tolist(), least.tolist()))
    assert len(written) <= most


def test_quality_is_fitted_off_the_driver(spark, monkeypatch):
    """The driver sees the model alone, neither texts nor features."""
    texts = corpus(40, 3)
    texts = [t and (t if i % 2 else t.upper()) for i, t in enumerate(texts)]
    known = spark.createDataFrame([(i, i % 2, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    want = {r.doc_id: r.p_selected for r in quality_ordinal.graded(frame(spark, texts), known).collect()}
    for name in ("fit", "shapes", "presence"):
        monkeypatch.delattr(quality_ordinal, name)  # of this process; executors import the module themselves
    assert {r.doc_id: r.p_selected for r in quality_ordinal.graded(frame(spark, texts), known).collect()} == want


def test_toxicity_learns_from_all_documents(spark):
    """A word that only one of many labelled documents in hundreds has counts, and runs are cut into words of documents without labels."""
    rng = random.Random(21)
    plain = ["".join(rng.choices("bcdfglmnprst", k=2)) + rng.choice("aeiou") + rng.choice("lmnrst") + rng.choice("aeiou") for _ in range(60)]
    texts = [" ".join(rng.choices(plain, k=6)) for _ in range(9000)]
    rare = set(rng.sample(range(len(texts)), 12))
    texts = [t + " zumpkle" * (i in rare) for i, t in enumerate(texts)]
    known = spark.createDataFrame([(i, int(i in rare)) for i in range(len(texts))], "doc_id long, toxic int")
    docs = frame(spark, [*texts, "a grobian fiend", "such grobian fiend", "grobian or fiend", "g-r-o-b-i-a-n-f-i-e-n-d"])
    lm = toxicity.language_model(docs)
    read = toxicity.read_words(docs, lm)
    assert [r.reading for r in read.collect() if "grobian" in r.reading.split()] == ["grobianfiend grobian fiend"]
    examples = toxicity.training(docs, known, read)
    learnt = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5}
    assert examples.count() == len(learnt) > 6000 and examples.where("y").count() == len(rare & learnt)
    chosen, w, bias = toxicity.fit(examples)
    again = toxicity.fit(examples.repartition(7))
    assert (chosen == again[0]).all() and (w == again[1]).all() and bias == again[2]
    got = {r.doc_id for r in toxicity.toxicity(docs, known).collect() if r.predicted}
    assert got == rare


def test_lattice_takes_the_table_in_a_row():
    lm = np.log(np.random.default_rng(8).dirichlet(np.ones(27), (27, 27)))
    for word in ("1d10t", "f-o-o-l", "coool", "é$!", ""):
        assert toxicity.lattice(word, lm.ravel().tolist(), 4) == toxicity.lattice(word, lm, 4)
