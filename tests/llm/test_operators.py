import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import components, decontaminate, idstore, license_scan, lm_score, near_dedup, packing, queries, site_style, substring_dedup, tokens, topk, toxicity, wordhash
from quillon.llm.common import Scratch
from tests.oracle import check

from . import brute

pytest.importorskip("public_tokenizers")
VOCAB = tokens.default_vocabulary()


def plain_ids(text, end):
    return tokens.encoder(VOCAB).tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def rows(df):
    return sorted(df.collect(), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    check(queries.queries()[name](spark, data), queries.oracle_sql()[name], data)


def test_word_hashes_follow_the_pattern():
    texts = ["a  b\tc", None, "", "é\x0bA a", "x" * 3_000_000 + " y"]
    _, s, e, h, first = wordhash.words(texts, False)
    assert np.diff(first).tolist() == [len(brute.words(t)) for t in texts]
    low = wordhash.words(["A a B"], True)[3]
    assert low[0] == low[1] != low[2]
    assert len(wordhash.words([], True)[3]) == 0


# --- 6
def test_substring_dedup_equals_brute_force(spark):
    docs, texts = brute.awkward(spark)
    for width in (5, 50):
        out = substring_dedup.remove_repeats(docs, width, min(4, width)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
        assert sorted(map(tuple, out.collect()), key=str) == sorted(brute.substring(texts, width), key=str)


def test_substring_dedup_keeps_columns_and_empty_tables(spark):
    docs, texts = brute.awkward(spark)
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(texts)
    assert {r.doc_id: r.text for r in out.collect()}[2] == "" and {r.doc_id: r.text for r in out.collect()}[7] == " \t\n"
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_intervals_merge():
    assert substring_dedup.intervals(np.array([3, 1, 2, 20]), 5).tolist() == [[1, 8], [20, 25]]


def test_stages_keep_columns_of_any_name(spark):
    names = ["id", "row", "maybe", "starts", "twin", "KEY", "goes", "word", "bits", "__maybe", "__id", "hops", "t1", "T2", "item"]
    a = " ".join(f"alpha{i}" for i in range(130))
    texts = [(1, a), (2, a), (3, "start " + a + " end"), (4, None), (None, a), (6, "")]
    docs = spark.createDataFrame([(i, t, *[k + 10 * j for k in range(len(names))]) for j, (i, t) in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    want = {r.id: r for r in docs.collect()}
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    for out, kept in ((substring_dedup.without_repeats(docs), 6), (near_dedup.without_near_duplicates(docs), 4), (decontaminate.decontaminate(docs, bench), 2)):
        got = out.collect()
        assert out.columns == docs.columns and len(got) == kept
        assert all(tuple(r)[2:] == tuple(want[r.id])[2:] for r in got)


def test_components_of_hubs_chains_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(components, "HEAVY", 3)
    rng = np.random.default_rng(8)
    links = [(500, i) for i in range(501, 640)] + [(700, i) for i in range(10, 60)] + [(i, i + 1) for i in range(1000, 1040)] + [(640, 500), (5, 700), (3, 3)]
    links += [(int(a), int(b)) for a, b in rng.integers(2000, 2300, (150, 2))]
    label = {x: x for e in links if e[0] != e[1] for x in e}
    for _ in label:
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.label for r in components.components(df, Scratch(spark, "test")).collect()} == label
    assert components.components(df.limit(0), Scratch(spark, "test")).count() == 0


# --- 7
@pytest.mark.parametrize("width,per_cent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, per_cent):
    docs, texts = brute.awkward(spark)
    want = brute.near(texts, width, per_cent)
    got = near_dedup.near_duplicates(docs, width, per_cent).collect()
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert near_dedup.near_duplicates(docs.limit(0), width, per_cent).count() == 0


def test_a_crowd_of_near_copies_is_linked_exactly(spark):
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(60)]
    texts = []
    for i in range(420):
        w = list(base)
        for k in rng.choice(60, rng.integers(0, 4), replace=False):
            w[k] = f"q{rng.integers(1000)}"
        texts.append((i, " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute.near(texts, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, 3, 85, leaf=32, depth=4).collect()}
    assert got == want


def test_near_duplicates_on_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = brute.near([(r.doc_id, r.text) for r in docs.collect()], 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.queries()["op7_near_dedup"](spark, data).collect()}
    assert got == want


# --- 2
def test_words_encode_as_whole_texts():
    odd = ["", None, "don't I'LL we've 's <|endoftext|>x", "é ́x y", "ΣΑΣ ΟΔΟΣ'S", "İstanbul", "a\x00b \x1c", "１２３ 4x5 %%%&&& a.b, c...", "end.) (x] word!!!'s"]
    for t, got in zip(odd, tokens.encoder(VOCAB).encode(odd)):
        assert got.tolist() == plain_ids(t, 0)[:-1], t


def test_ids_do_not_depend_on_what_was_encoded_before():
    texts = ["a <|endoftext|> b", "A <|ENDOFTEXT|> B", "x<|EndOfText|>y.", "<|startoftext|>", "<|STARTOFTEXT|>", "Word word WORD <|"]
    for order in (texts, texts[::-1]):
        fresh = tokens.Encoder(VOCAB)
        for batch in (order, order[::-1]):
            for t, got in zip(batch, fresh.encode(batch)):
                assert got.tolist() == plain_ids(t, 0)[:-1], t


def test_lookup_of_many_keys_also_of_one_in_two_shards(spark):
    texts = [(10 * i if i < 80 else 10**15 + i, f"text {i}") for i in range(160)] + [(50, f"more {i}") for i in range(40)] + [(-(2**63), "least"), (2**63 - 1, "most")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    shards, parts = idstore.write_store(docs, VOCAB, 2, Scratch(spark, "keys"), limit=40)
    assert shards.where("first_key = 50 or last_key = 50").count() > 1
    asked = [50, 0, 790, 10**15 + 159, -(2**63), 2**63 - 1, 5, 10**15 - 1, 123]
    for sought in (0, 200):  # by the directory, and by the files' indexes
        got = Counter((r.doc_id, tuple(r.ids)) for r in idstore.lookup(shards, parts, spark.createDataFrame([(k,) for k in asked], "doc_id long"), sought).collect())
        assert got == Counter((i, tuple(plain_ids(t, 2))) for i, t in texts if i in asked)
        assert idstore.lookup(shards.limit(0), parts.limit(0), docs, sought).count() == 0
        assert idstore.lookup(shards, parts, docs.limit(0), sought).count() == 0


def test_a_lookup_reads_no_more_from_a_larger_store(spark):
    word = lambda i: " ".join(f"w{(i * 7919 + k) % 5003}" for k in range(400))
    read = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem
    amounts, sizes = [], []
    for n in (300, 6000):
        docs = spark.range(n).repartition(4).select(F.col("id").alias("doc_id"), F.udf(word)("id").alias("text"))
        shards, parts = idstore.write_store(docs, VOCAB, 2, Scratch(spark, "sizes"), limit=40_000)
        sizes.append(shards.agg(F.sum(F.length("payload"))).first()[0])
        before = sum(s.getBytesRead() for s in read.getAllStatistics())
        assert [r.ids for r in idstore.lookup(shards, parts, spark.createDataFrame([(77,)], "doc_id long")).collect()] == [plain_ids(word(77), 2)]
        amounts.append(sum(s.getBytesRead() for s in read.getAllStatistics()) - before)
    assert sizes[1] > 15 * sizes[0] and amounts[1] < 1.5 * amounts[0] + 100_000, (sizes, amounts)


def test_id_store_round_trip_and_lookup(spark):
    docs, texts = brute.awkward(spark)
    s = Scratch(spark, "test")
    shards, parts = idstore.write_store(docs, VOCAB, 2, s, limit=500)
    got = idstore.read_store(shards, parts).orderBy("start").collect()
    at = 0
    order = sorted((r for r in texts), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in order]
    for r, (_, t) in zip(got, order):
        ids = plain_ids(t, 2)
        assert (r.start, r.n_tokens, r.ids_crc32, list(r.ids)) == (at, len(ids), brute.crc(ids), ids)
        at += len(ids)
    keys = spark.createDataFrame([(3,), (8,), (999,), (None,)], "doc_id long")
    found = idstore.lookup(shards, parts, keys).collect()
    assert sorted(r.doc_id for r in found) == [3, 8, 8]
    s.close()
    assert idstore.read_store(*idstore.write_store(docs.limit(0), VOCAB, 2, Scratch(spark, "none"))).count() == 0


def test_perfect_hash_is_minimal_and_refuses_strangers():
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    h = idstore.PerfectHash(idstore.PerfectHash.build(keys).levels)
    assert sorted(h.slots(keys)) == list(range(5000))
    strange = np.arange(20000)
    slot = h.slots(strange)
    prints = np.zeros(5000, np.uint32)
    prints[h.slots(keys)] = idstore.fingerprint(keys)
    assert ((slot >= 0) & (prints[slot] == idstore.fingerprint(strange))).sum() == 0


# --- 3
def check_pieces(pieces, texts, end, window=2048):
    by = defaultdict(list)
    for r in pieces:
        by[r.doc_id].append(r)
    for doc in {i for i, _ in texts}:
        want = Counter(tuple(plain_ids(t, end)) for i, t in texts if i == doc)
        got = sorted(by[doc], key=lambda r: r.start)
        assert sum(r.length for r in got) == sum(len(k) * n for k, n in want.items())
        if sum(want.values()) == 1:
            ids, at = next(iter(want)), 0
            for r in got:
                assert r.start == at and r.ids_crc32 == brute.crc(ids[at : at + r.length]) and r.doc_tokens == len(ids)
                at += r.length
    seq = defaultdict(list)
    for r in pieces:
        seq[r.sequence_id].append((r.offset, r.length))
    for spans in seq.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at and n > 0
            at += n
        assert at <= window
    return len(seq)


def test_packing_places_every_id_once(spark):
    docs, texts = brute.awkward(spark)
    check_pieces(packing.pack(docs, VOCAB, 1, window=64).collect(), texts, 1, 64)
    assert packing.pack(docs.limit(0), VOCAB, 1).count() == 0


def test_packing_wastes_little(spark, data):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    pieces = queries.queries()["op3_packing"](spark, data).collect()
    n = check_pieces(pieces, texts, 1)
    total = sum(r.length for r in pieces)
    assert total / (n * 2048) > 0.95


def test_plan_uses_no_length_too_often():
    rng = np.random.default_rng(0)
    for hist in (rng.integers(0, 50, 257), np.zeros(257, int), np.bincount([130] * 40 + [126] * 30 + [85] * 9, minlength=257)):
        hist[0] = hist[256] = 0
        used = np.zeros(257, int)
        for lengths, n in packing.plan(hist[:256], 256):
            assert sum(lengths) == 256 and n > 0
            for i in lengths:
                used[i] += n
        assert (used[:256] <= hist[:256]).all()


# --- 8
def test_top_k_equals_brute_force_with_ties_and_gaps(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 0.3, (300, 9)).round(3)
    v[40:80] = v[0]
    rows_ = [(i, [float(x) for x in v[i]], 1) for i in range(300)] + [(300, None, 1), (301, [1.0, None], 1), (302, [float("nan")], 1), (303, [float("inf")] * 9, 1), (None, [1.0] * 9, 1), (350, [], 2)]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>, score int")
    vec = topk.integer_vectors(df)
    w = np.floor(v * 256).astype(int)
    for lists, block in ((1, 2048), (2, 2), (4, 2048)):
        got = defaultdict(list)
        for r in sorted(topk.top_k(vec, vec.where("vec_id % 50 = 0"), lists=lists, block=block).collect(), key=lambda r: (r.query_id, r.rank)):
            got[r.query_id].append((r.vec_id, r.score))
        assert sorted(got) == [0, 50, 100, 150, 200, 250]
        for q, best in got.items():
            s = w @ w[q]
            assert best == [(i, s[i]) for i in sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5]]
    assert topk.top_k(vec.limit(0), vec.limit(0)).count() == 0
    assert topk.top_k(vec.limit(1), vec.limit(1)).count() == 0


def test_chunks_that_cannot_reach_the_cutoff_are_not_multiplied(spark, monkeypatch):
    rng = np.random.default_rng(9)
    v = (rng.normal(0, 1, (400, 6)) * rng.exponential(1, (400, 1)) ** 3 * 50).astype(int)
    monkeypatch.setattr(topk, "CHUNK", 8)
    monkeypatch.setattr(topk, "FIRST", 1)
    df = spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(v)], "vec_id long, v array<long>").repartition(2)
    got = defaultdict(list)
    for r in sorted(topk.top_k(df, df.where("vec_id % 20 = 0"), k=4, lists=3).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 400, 20):
        s = v @ v[q]
        assert got[q] == [(i, s[i]) for i in sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:4]]
    # a pass with cutoffs multiplies few of the chunks
    order = np.argsort(-(v.astype(float) ** 2).sum(1))
    calls = []
    product = topk._product
    monkeypatch.setattr(topk, "_product", lambda c, q: (calls.append(c.size * len(q)), product(c, q))[1])
    import pandas as pd

    frame = pd.DataFrame({"vec_id": order, "v": [v[i].tolist() for i in order]})
    cut = np.array([float(got[q][3][1]) for q in range(0, 400, 20)])
    list(topk._pass(v[::20], np.arange(0, 400, 20), 4, 3, cut)([frame]))
    assert sum(calls) < 0.5 * v.size * 20


def test_vectors_of_one_id_and_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, [1, 2]), (0, [2, 1]), (0, [1, 2]), (1, [5, 0]), (2, [0, 5]), (2, [0, 5])], "vec_id long, v array<long>")
    got = sorted((r.query_id, r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 0"), k=3).collect())
    assert got == sorted([(0, 2, 10), (0, 2, 10), (0, 1, 5), (0, 1, 10), (0, 2, 5), (0, 2, 5)])
    big = spark.createDataFrame([(0, [2**30, 2**30]), (1, [2**31, -(2**31)]), (2, [2**32, 1])], "vec_id long, v array<long>")
    assert {r.vec_id: r.score for r in topk.top_k(big, big.where("vec_id = 0"), lists=1).collect()} == {1: 0, 2: 2**62 + 2**30}
    huge = spark.createDataFrame([(0, [2**40]), (1, [2**40])], "vec_id long, v array<long>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(huge, huge.where("vec_id = 0")).collect()


# --- 9
def brute_tiles(item, doc, least):
    marked_i, marked_d, total = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not marked_i[i + n] and not marked_d[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return total
        n, i, j = best
        marked_i[i : i + n], marked_d[j : j + n] = [True] * n, [True] * n
        total += n


def test_tiling_covers_as_greedy_tiling_does():
    rng = np.random.default_rng(5)
    for _ in range(40):
        item, doc = rng.integers(0, 6, 30).astype(np.uint64), rng.integers(0, 6, 60).astype(np.uint64)
        doc[10:22] = item[3:15]
        seeds = decontaminate.Seeds([wordhash.mix(item)], 3)
        got = [sum(t[2] for t in decontaminate.tiles(i, j, w, 30, 60)) for _, w, i, j in seeds.hits(wordhash.mix(doc))]
        assert got == [brute_tiles(item.tolist(), doc.tolist(), 3)]


def test_decontamination_finds_reordered_passages_and_spares_others(spark):
    item = [f"q{i}" for i in range(40)]
    docs = spark.createDataFrame(
        [(1, "x y " + " ".join(item).upper() + " z", 1.0), (2, " ".join(item[20:] + ["mid"] + item[:20]), 1.0), (3, " ".join(item[:12]) + " other words here", 1.0), (4, None, 1.0), (5, "", 1.0), (None, " ".join(item), 1.0)],
        "doc_id long, text string, coverage double",
    )
    bench = spark.createDataFrame([(7, " ".join(item), 1), (8, None, 1), (9, "tiny item", 1), (None, " ".join(item), 1)], "item_id long, text string, doc_id int")
    found = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(d, i) for d in (1, 2, None) for i in (7, None)}
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5]
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_contamination_equals_tiling_each_pair(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEED_BITS", 1 << 10)  # a filter that lets much pass
    rng = np.random.default_rng(6)
    voc = [f"w{i}" for i in range(9)]
    say = lambda n: " ".join(rng.choice(voc, n))
    bench = [(i, say(int(rng.integers(1, 40)))) for i in range(25)] + [(3, "w1 w2 w3 w4 w5 w6"), (3, "w1 w2 w3 w4 w5 w6"), (50, "W1 é"), (51, None), (52, "")]
    texts = []
    for i in range(60):
        item = (bench[int(rng.integers(0, 25))][1]).split(" ")
        k = int(rng.integers(0, len(item) + 1))
        texts.append((i, " ".join([say(10), *item[k:], say(int(rng.integers(1, 4))), *item[:k], say(5)])))
    texts += [(60, texts[0][1]), (60, texts[0][1]), (61, None), (62, ""), (63, "w1 É"), (64, "w1 é"), (65, "w1 w2 w3 w4 w5 w6 " * 3000)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in texts], "doc_id long, text string, t1 int, maybe int, item int").repartition(3)
    items = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id long, text string, seed int")
    ids = {w: n for n, w in enumerate({w for _, t in [*bench, *texts] for w in brute.words(brute.lower(t))})}
    want, gone = Counter(), set()
    for d, text in texts:
        b = [ids[w] for w in brute.words(brute.lower(text))]
        for i, t in bench:
            a = [ids[w] for w in brute.words(brute.lower(t))]
            if a and d != 65 and (covered := brute_tiles(a, b, min(4, len(a)))) >= 0.6 * len(a):
                want[d, i, covered] += 1
                gone.add(d)
    got = decontaminate.contaminated(docs, items, least=4).collect()
    assert Counter((r.doc_id, r.item_id, r.covered) for r in got if r.doc_id != 65) == want and len(want) > 40
    assert {(r.doc_id, r.item_id): r.covered for r in got if r.doc_id == 65}[65, 3] == 6
    left = decontaminate.decontaminate(docs, items, least=4)
    assert left.columns == docs.columns and Counter(r.doc_id for r in left.collect()) == Counter(d for d, _ in texts if d not in gone | {65})


# --- 5
def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(4)
    e, begin, start, change = rng.normal(0, 1, 9), np.array([0, 4, 5, 9]), rng.normal(0, 1, 2), rng.normal(0, 1, (2, 2))
    p, pairs, starts = toxicity.forward_backward(e, begin, start, change, np.array([1.0, 2.0, 1.0]))
    want_p, want_pairs, want_starts = np.zeros(9), np.zeros((2, 2)), np.zeros(2)
    for c, times in enumerate((1.0, 2.0, 1.0)):
        a, b = begin[c], begin[c + 1]
        scores = {}
        for bits in range(1 << (b - a)):
            y = [bits >> k & 1 for k in range(b - a)]
            scores[tuple(y)] = math.exp(start[y[0]] + sum(e[a + k] * y[k] for k in range(b - a)) + sum(change[y[k], y[k + 1]] for k in range(b - a - 1)))
        z = sum(scores.values())
        for y, s in scores.items():
            for k in range(b - a):
                want_p[a + k] += y[k] * s / z
            for k in range(b - a - 1):
                want_pairs[y[k], y[k + 1]] += times * s / z
            want_starts[y[0]] += times * s / z
    assert np.allclose(p, want_p) and np.allclose(pairs, want_pairs) and np.allclose(starts, want_starts)


def test_toxicity_learns_planted_words_and_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows_ = []
    for i in range(900):
        w = [f"v{rng.integers(200)}" for _ in range(30)]
        toxic = int(i % 5 == 0)
        if toxic:
            w[rng.integers(30)] = ["vile", "nastyish", "nastyfoo"][rng.integers(3)]
        rows_.append((i, " ".join(w) + ".", toxic))
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows_] + [(1000, None, 0.1), (1001, "", 0.1), (None, "so vile", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows_] + [(None, 1), (1000, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, hold_out=5)
    out = {r.doc_id: r for r in toxicity.tag(docs, model).collect()}
    held = [(y, out[i].score) for i, _, y in rows_ if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == bool(y) for y, s in held]) > 0.95
    assert out[None].score > 0.5 and list(map(list, out[None].spans)) == [[3, 7]] and out[1000].score == out[1001].score < 0.5
    # spans are characters of the text, and copies don't change them; long texts are scored whole
    long_text = "één v1 v2 " * 20_000 + "é. Vile, nastyfoo v3"
    score, spans = toxicity.score_texts(["é v1. vile", long_text, "é v1. vile", None], model)
    assert [["é v1. vile"[a:b] for a, b in x] for x in (spans[0], spans[2])] == [["vile"], ["vile"]] and score[0] == score[2]
    assert [long_text[a:b] for a, b in spans[1]] == ["Vile, nastyfoo"] and spans[3] == []
    # neither the dealing to partitions nor repeated rows change the model
    again = toxicity.fit(docs.unionByName(docs).repartition(7), labels.repartition(3), hold_out=5)
    assert np.array_equal(again.keys, model.keys) and np.allclose(again.weights, model.weights) and np.allclose(again.scale, model.scale)
    clean = toxicity.without_toxic(docs, model)
    assert clean.columns == docs.columns and 1000 in {r.doc_id for r in clean.collect()}
    nothing = toxicity.fit(docs, labels.limit(0))
    assert toxicity.tag(docs, nothing).agg(F.max("score")).first()[0] < 1e-6
    assert toxicity.tag(docs.limit(0), model).count() == 0


# --- 1
def test_language_model_counts_and_probabilities(spark):
    docs, texts = brute.awkward(spark)
    got = lm_score.log_likelihood(docs, share=1).collect()
    assert len(got) == len(texts)
    count = Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    toks = lambda t: brute.words(brute.lower(t)) + [None]
    for i, t in texts:
        if not held(i):
            count.update(toks(t))
    n, v = sum(count.values()), len(count)
    text_of = dict(texts)
    for r in got:
        w = toks(text_of[r.doc_id])
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(count[x] > 0 for x in w), n, held(r.doc_id))
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert lm_score.log_likelihood(docs.limit(0)).count() == 0


def vocabulary():
    totals, types = np.zeros(lm_score.TAIL), np.zeros(lm_score.TAIL, int)
    totals[:48], types[:48] = 30, 10
    return lm_score.Vocabulary(5000, 1500, np.arange(100), np.arange(100), np.arange(200, 100, -1), totals, types)


def test_probabilities_sum_to_one_in_any_state():
    v = vocabulary()
    net = lm_score.Network.fresh(v)
    h = np.random.default_rng(0).normal(0, 1, (1, lm_score.HIDDEN)).astype(np.float32)
    every = np.array([*range(100), *(lm_score.HEAD + np.flatnonzero(v.types)), lm_score.UNKNOWN])
    p, _ = net.log_likelihood(np.repeat(h.T, len(every), 1), every)
    assert math.isclose(np.exp(p).sum(), 1, rel_tol=1e-4)


def test_back_propagation_equals_differences(monkeypatch):
    v, rng = vocabulary(), np.random.default_rng(2)
    sizes = np.array([5, 1, 9, 4])
    symbols = rng.choice([*range(100), *range(lm_score.HEAD, lm_score.HEAD + 48), lm_score.UNKNOWN], sizes.sum())
    net, seen = lm_score.Network.fresh(v), []
    monkeypatch.setattr(lm_score.Trainer, "_update", lambda self, g: seen.append(g.astype(float)))
    lm_score.Trainer(net).train(symbols, sizes, most=1, window=19)
    total = lambda flat: lm_score.score(lm_score.Network(flat, net.missing_classes, net.missing_words), symbols, sizes, most=1)[0].sum() * lm_score.LN10 / sizes.sum()
    (g,) = seen
    assert np.isfinite(g).all()
    for way in (g, *rng.normal(0, 1, (6, len(g))) * (np.abs(g) > 0)):  # along the gradient, and along others
        step = way / np.linalg.norm(way) * 0.02
        got, want = (total(net.flat + step) - total(net.flat - step)) / 2, g @ step
        assert math.isclose(got, want, rel_tol=0.05, abs_tol=2e-5), (got, want)


def test_gradients_and_state_across_windows():
    v = vocabulary()
    rng = np.random.default_rng(1)
    sizes = np.array([70, 3, 41])
    symbols = rng.integers(0, 100, sizes.sum())
    net = lm_score.Network.fresh(v)
    one = lm_score.score(net, symbols, sizes, most=1, window=500)
    assert np.allclose(one, lm_score.score(net, symbols, sizes, most=3, window=16), rtol=1e-4)
    alone = [lm_score.score(net, symbols[a:b], np.array([b - a]))[0][0] for a, b in ((0, 70), (70, 73), (73, 114))]
    assert np.allclose(one[0], alone, rtol=1e-4) and np.allclose(one[0], one[1])
    before = one[0].sum()
    t = lm_score.Trainer(net, 0.02)
    for _ in range(60):
        t.train(symbols, sizes, most=2, window=16)
    assert lm_score.score(net, symbols, sizes)[0].sum() > before * 0.7


# --- 10
def page(article, extra=""):
    return f"<html><head><title>T</title><script>var x='<p>no</p>';</script></head><body><nav><a href=/>Menu</a></nav><!-- c -->{extra}<article>{article}</article><footer>foot &copy;</footer></body></html>"


def test_main_text_of_a_page():
    a = "<h1>A &amp;amp; B</h1><p>one  two<b>three<br>four<p>five &lt;tag&gt;</p><div class='comments'><p>me too</p></div><aside>side</aside><ul><li>x<li>y</ul><form>f</form>"
    assert site_style.main_text(page(a), {}) == "A &amp; B one twothree four five <tag> x y"
    assert site_style.main_text("", {}) == "" and site_style.main_text("plain < text", {}) == "plain < text"
    assert site_style.main_text("<div id=menu>m</div><div class=body>t</div><p>u", {}) == "t u"


@pytest.mark.parametrize(
    "part",
    [
        "<h2 id='discussion'>Kept</h2>", "<section id='related-work'>Kept</section>", "<div class='post share-enabled'>Kept</div>", "<div style='overflow:hidden'>Kept</div>",
        "<div title='the hidden valley'>Kept</div>", "<div data-id='ad'>Kept</div>", "<a href='/p?id=reply'>Kept</a>", "<a href=/p?id=reply>Kept</a>",
        "<figure><figcaption>Kept</figcaption></figure>", "<math><mi>Ke</mi><mo>pt</mo></math>", "<object>Kept</object>",
    ],
)
def test_main_text_keeps_what_only_looks_like_a_part(part):
    assert site_style.main_text(page(f"<p>a</p>{part}<p>b</p>"), {}) in ("a Kept b", "aKept b", "a Keptb")


@pytest.mark.parametrize("part", ["<div hidden>no</div>", "<div class='x ads'>no</div>", "<ul class=comments><li>no</ul>", "<div role=navigation>no</div>"])
def test_main_text_drops_parts_within_an_article(part):
    assert site_style.main_text(page(f"<p>a</p>{part}<p>b</p>"), {}) == "a b"


BESIDE = [
    "<section id='comments'><article class='comment'><p>{no}</p></article><article class='comment'><p>{no}</p></article></section>", "<ol class='commentlist'><li><article><p>{no}</p></article></li></ol>",
    "<div class='comments-area'><article>{no}</article></div>", "<aside class='related'><article><h3>{no}</h3></article></aside>", "<div class='more'><article><a href=x>{no}</a></article><article>{no}</article></div>",
    "<div class='widget'><article>{no}</article></div>", "<article class='teaser'>{no}</article>", "<footer><article>{no}</article></footer>", "<header>{no}</header>", "<div class='comments'>{no}</div>",
]
WITHIN = [
    "<div class='ad-slot'><p>{no}</p></div>", "<div class='ad-banner'>{no}</div>", "<div class='newsletter-signup'>{no}</div>", "<aside>{no}</aside>", "<section class='comments-area'><article>{no}</article></section>",
    "<div id='comment_12'>{no}</div>", "<ul class='breadcrumb-trail'><li>{no}</li></ul>", "<article class='related'>{no}</article>",
]


@pytest.mark.parametrize("part", BESIDE)
@pytest.mark.parametrize("around", ["{article}{part}", "<main>{article}{part}</main>", "<main>{part}{article}</main>", "<div class=site><main>{article}</main>{part}</div>"])
def test_what_stands_beside_an_article_goes(part, around):
    story = " ".join(f"word{i}" for i in range(30))
    part = part.format(no="no not this")
    html = around.format(article=f"<article class='post'><header><h1>Title</h1></header><p>{story}</p></article>", part=part)
    assert site_style.main_text(f"<body><nav>m</nav>{html}<footer>f</footer></body>", {}) == f"Title {story}"


@pytest.mark.parametrize("part", WITHIN)
def test_what_is_apart_within_an_article_goes(part):
    assert site_style.main_text(page(f"<p>{'some story ' * 9}</p>{part.format(no='no')}<p>end</p>"), {}) == f"{'some story ' * 9}end"


@pytest.mark.parametrize(
    "html",
    [
        "<main><header><h1>Kept</h1></header><p>Kept</p></main>", "<article>Kept</article><article>Kept</article>", "<article>Kept and kept and kept</article>" + "<article>Kept</article>" * 9,
        "<div class='post ad-free'><p>Kept</p></div>", "<article><section class='comment-on-law'>Kept Kept Kept</section></article>", "<article class='post'><article>Kept</article>Kept</article>",
    ],
)
def test_articles_of_any_build_stay(html):
    want = " ".join(re.sub("<[^>]*>", " ", html).split())
    assert " ".join(site_style.main_text(f"<body><nav>m</nav>{html}<footer>f</footer></body>", {}).split()) == want


def test_a_site_keeps_its_stories_only(spark):
    """Comments, teasers and adverts differ on every page, so the tree alone would keep them."""
    rng = np.random.default_rng(5)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    rows_, want = [], []
    for i in range(120):
        story, late = say(60), say(20)
        want.append(f"T{i} {story} {late}")
        comments = "".join(f"<article class=comment id=c{k}>{say(15)}</article>" for k in range(rng.integers(0, 9)))
        body = f"<article><h1>T{i}</h1><p>{story}</p><div class='ad-slot'>{say(9)}</div><p>{late}</p></article>"
        beside = f"<section id=comments>{comments}</section><aside class=related><article>{say(8)}</article></aside>"
        html = [f"<header>{say(3)}</header>{body}{beside}", f"<main><header>{say(3)}</header>{body}{beside}</main>", f"<div class=w><main>{body}</main>{beside}</div>"][i % 3]
        rows_.append((i, f"http://h{i % 3}.example/{i}", f"<html><body><nav>menu</nav>{html}<footer>foot</footer></body></html>"))
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string")
    for limit in (100_000, 0):
        got = {r.page_id: r.text for r in site_style.extract(pages, broadcast_rows=limit).collect()}
        assert [got[i] for i in range(120)] == want


def test_pages_of_thousands_of_articles_are_read_in_linear_time():
    import time

    html = "<main>" + "".join(f"<article><p>post {i}</p></article>" for i in range(20_000)) + "</main>" + "<div>" * 20_000 + "deep"
    began = time.time()
    assert len(site_style.main_text(html, {}).split()) == 40_000 and time.time() - began < 20


def test_style_tree_drops_what_all_pages_of_a_site_share(spark):
    body = lambda i: f"<div class='c1'><p>story {i} is its own</p></div><div class='c2'>subscribe today</div>"
    rows_ = [(i, f"http://a.example/{i}", f"<html><body>{body(i)}</body></html>", 1) for i in range(20)]
    rows_ += [(20, None, None, 1), (21, "::bad", "", 1), (22, "http://b.example/", page("<p>alone</p>"), 1), (22, "http://b.example/", page("<p>alone</p>"), 1)]
    rows_ += [(30 + i, f"http://c.example/{i}", page("<p>the same article</p>"), 1) for i in range(12)]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string, host int")
    for limit in (100_000, 0):
        got = {r.page_id: (r.text, r.n_chars) for r in site_style.extract(pages, broadcast_rows=limit).collect()}
        assert all(got[i][0] == f"story {i} is its own" for i in range(20))
        assert got[20] == got[21] == ("", 0) and got[22] == ("alone", 5) and got[33][0] == "the same article"
    assert site_style.extract(pages).count() == len(rows_) and site_style.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "html",
    [
        "<div class='page has-sidebar'><p>Kept</p></div>", "<div id='main-content' class='layout-no-sidebar'><article>Kept</article></div>", "<form id=aspnet><div>menu</div><article>Kept</article></form>",
        "<form><p>Kept</p></form>", "<div class='social-history'><p>Kept</p></div>", "<div class=sidebar><main><p>Kept</p></main></div>", "<article><div class='social-history'>Kept</div></article>",
    ],
)
def test_no_name_empties_what_holds_the_text(html):
    assert site_style.main_text(f"<body><nav>a b</nav>{html}<footer>f</footer></body>", {}) == "Kept"


def test_style_tree_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows_ = []
    for i in range(300):
        story = "".join(f"<p>{' '.join(f'w{rng.integers(500)}' for _ in range(12))}</p>" for _ in range(rng.integers(1, 6)))
        links = "".join(f"<li><a href=x>l{rng.integers(9)}</a></li>" for _ in range(4))
        note = ["<div class=n>we use them</div>", "<div class=n>we <b>do</b> use them</div>"][i % 7 == 0]
        rows_.append((f"http://h{i % 3 if i < 290 else i}.example/{i}", f"<body class=p{i}><ul class=m>{links}</ul>{note}<div class=t><h2>t{i}</h2>{story}</div></body>"))
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows_)], "page_id long, url string, html string")
    seen, shares = {}, {}
    for url, html in rows_:
        for path, (content, build, share) in site_style.nodes(html).items():
            seen.setdefault((site_style.host(url), path), []).append((content, build))
            shares.setdefault((site_style.host(url), path), []).append(share)

    def bits(values):
        n = Counter(values)
        return -sum(c / len(values) * math.log2(c / len(values)) for c in n.values()) / math.log2(len(values)) if len(values) > 1 else 1.0

    want = {k: (len(x), bits([c for c, _ in x]) / 2 + max(bits([b for _, b in x]), sum(shares[k]) / len(x)) / 2) for k, x in seen.items()}
    got = {(r.host, r.path): (r.pages, r.importance) for r in site_style.importance(site_style.style_tree(pages), ["host", "path"]).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], abs_tol=1e-9) for k in want)
    # the tree changes the pages of a site without semantic tags: menu and notice go, which no name tells
    plain = [" ".join(re.sub("<[^>]*>", " ", html).split()) for _, html in rows_]
    story = [" ".join(re.sub("<[^>]*>", " ", html[html.index("<div class=t>") :]).split()) for _, html in rows_]
    texts = {r.page_id: r.text for r in site_style.extract(pages).collect()}
    assert [site_style.main_text(html, {}) for _, html in rows_] == plain
    assert [texts[i] for i in range(300)] == story
    assert {r.page_id: r.text for r in site_style.extract(pages, names=False).collect()} == texts


def test_long_pages_and_copies_are_whole():
    p = "".join(f"<p>word{i} and {i}</p>" for i in range(20_000))
    assert site_style.main_text(page(p), {}) == " ".join(f"word{i} and {i}" for i in range(20_000))
    low = {x: 0.0 for x in site_style.nodes(page("<h1>a</h1><p>b <b>c</b></p>"))}
    assert site_style.main_text(page("<h1>a</h1><p>b <b>c</b></p>"), low) == "a b c"


def test_main_text_does_not_depend_on_the_number_of_template_branches(spark):
    urls = ["http://my_site.example/{}", "http://d.example/a b|{}", "http://E.example:80/{}?q=<{}>", "http://u:p@f.example/{}", "http://[::1]/{}", "//g.example/{}", "{}", None]
    html = "<html><body><div class='c1'><p>story {} is its own</p></div><div class='c2'>subscribe today</div></body></html>"
    rows_ = [(100 * k + i, u and u.format(i, i), html.format(i)) for k, u in enumerate(urls) for i in range(10)]
    rows_ += [(10_000 + i, f"http://own.example/{i}", f"<html><body><div class='c2'>text {i} of its own</div></body></html>") for i in range(200)]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string")
    few, many = ({r.page_id: r.text for r in site_style.extract(pages, broadcast_rows=n).collect()} for n in (100_000, 0))
    assert few == many and all(few[100 * k + i] == f"story {i} is its own" for k in range(len(urls)) for i in range(10))


def test_style_tree_sees_one_template_behind_values_of_a_page(spark):
    page_ = "<html><body class='postid-{0} x'><div id='page-{0}'><div class='post-{0} k{1}'><p>story {0} is its own</p></div><div class='c2'>subscribe today</div></div></body></html>"
    keys = [f"{i * 2654435761 % (1 << 32):08x}a1" for i in range(20)]
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", page_.format(i, f" {k}")) for i, k in enumerate(keys)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in site_style.extract(pages).collect()} == {i: f"story {i} is its own" for i in range(20)}
    # numbers that tell columns apart stay
    assert len(site_style.nodes("<div class='col-4'>a</div><div class='col-8'>b</div>")) == 2


# --- 4
def test_licence_scan_of_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "Text here.\n  RELEASED under the MIT license!\nmore", 1), (2, None, 1), (3, "", 1), (4, "Released under the MIT License.", 1), (4, "Released under the MIT License.", 1), (5, "one", 1), (6, "a " * 30000, 1)],
        "doc_id long, text string, line int",
    )
    got = [(r.doc_id, r.line, r.license, r.dice) for r in rows(license_scan.scan(docs))]
    assert got == [(1, 1, "MIT", 1.0), (4, 0, "MIT", 1.0), (4, 0, "MIT", 1.0)]
    assert license_scan.scan(docs.limit(0)).count() == 0
    assert "Python" not in license_scan.scan(docs)._jdf.queryExecution().executedPlan().toString()


def test_all_documents_that_are_not_held_out_are_trained_on(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 7} and again word{i % 3} w{i}") for i in range(60)], "doc_id long, text string")
    seen, fit = [], lm_score.fit

    def watched(coded, v, s):
        for r in coded.collect():
            symbols, sizes = lm_score._taught(r)
            assert len(symbols) == sizes.sum()
            seen.extend(sizes.tolist())
            known = np.asarray(lm_score.unplane([r.s0, r.s1]))[np.repeat(~np.asarray(r.held), r.n_tokens)]
            # a word that occurs once teaches the unknown; words of the head stay
            assert (symbols[known < lm_score.HEAD] == known[known < lm_score.HEAD]).all() and (symbols <= lm_score.UNKNOWN).all()
        return fit(coded, v, s)

    monkeypatch.setattr(lm_score, "fit", watched)
    got = lm_score.log_likelihood(docs).collect()
    assert len(seen) == sum(not r.held_out for r in got) and sum(seen) == sum(r.n_tokens for r in got if not r.held_out)


def test_licenses_are_found_in_wrapped_notices_and_within_lines(spark):
    def wrapped(name, n=9):
        w = license_scan.TEMPLATES[name].split(" ")
        return "\n".join(" * " + " ".join(w[i : i + n]) for i in range(0, len(w), n))

    long = "\n".join(f"other words of line {i} that say nothing" for i in range(40))
    texts = [f"{long}\n{wrapped(n)}\n{long}" for n in ("MIT-grant", "ISC", "Apache-2.0-notice", "GPL-3.0-notice")]
    texts += [f"{long}\nThis tool is old and it was made by many. Released under the MIT License. Have fun with it and tell us of it.", long]
    texts += ["Released under the MIT License.\n" + long, f"{texts[0]}\n{texts[1]}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = license_scan.scan(docs)
    got = {(r.doc_id, r.line, r.license, round(r.dice, 2)) for r in out.collect()}
    want = {(0, 40, "MIT-grant", 1.0), (1, 40, "ISC", 1.0), (2, 40, "Apache-2.0-notice", 1.0), (3, 40, "GPL-3.0-notice", 1.0), (4, 40, "MIT", 1.0), (6, 0, "MIT", 1.0)}
    assert want <= got and {(i, x) for i, _, x, _ in got if i == 7} == {(7, "MIT-grant"), (7, "ISC")}
    assert not [x for x in got if x[0] == 5] and len([x for x in got if x[0] == 6]) == 1
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
