"""Operators 11 to 13 against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import collocations, fill_middle, url_rules

from . import brute

ODD = "id long, a long, b long, n long, f long, key string, kind int, range int, rank int, lang string, text string, block long"


# --- 11
def plain_phrases(rows, longest, least, share, top):
    total, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    gone = set()
    for (lang, longer), a in candidates.items():
        for k in range(2, len(longer)):
            for i in range(len(longer) - k + 1):
                part = (lang, longer[i : i + k])
                if 100 * a >= share * f[part]:
                    gone.add(part)
    out = defaultdict(list)
    for (lang, words), a in candidates.items():
        if (lang, words) not in gone:
            cuts = [(10**6 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out[lang].append((" ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], total[lang], score))
    result = []
    for lang, rows in out.items():
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        result += [(lang, i, *r) for i, r in enumerate(rows[:top], 1)]
    return sorted(result)


def phrase_rows(seed, texts=120, words=7):
    rng = np.random.default_rng(seed)
    voc = ["a", "B", "b", "cé", "d.", "e,f", "g\n", "h", "x\x0by", "\x1c", "\x85"][:words]
    rows = [(str(rng.choice(["en", "de"])), " \t".join(rng.choice(voc, rng.integers(0, 30)))) for _ in range(texts)]
    return [*rows, (None, "z z z z z z z z z z z z"), ("en", None), ("en", ""), ("en", " \t "), ("und", "z z"), ("en", "..,;"), rows[0], rows[0]]


@pytest.mark.parametrize("longest", [2, 3, 5])
def test_collocations_equal_brute_force(spark, longest, monkeypatch):
    rows = phrase_rows(longest)
    docs = spark.createDataFrame([(i, 1, 2, 3, 4, "k", 5, 6, 7, lang, text, 8) for i, (lang, text) in enumerate(rows)], ODD)
    want = plain_phrases(rows, longest, 4, 50, 25)
    for block in (1 << 20, 200):  # one block, and many
        monkeypatch.setattr(collocations, "BLOCK", block)
        got = collocations.collocations(docs.repartition(3), longest, 4, 50, 25)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_collocations_of_long_texts_and_of_none(spark):
    long = "one two three " * 20_000
    rows = [("en", long), ("en", "four five. " * 12)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == plain_phrases(rows, 3, 10, 50, 2000)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.where("text is null")).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", "few words only")], "lang string, text string")).count() == 0


def test_a_full_filter_changes_no_phrase(spark, monkeypatch):
    """A filter that passes all has rare phrases counted, too; what is frequent, and what is returned, stays."""
    rows = phrase_rows(9)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    monkeypatch.setattr(collocations, "_filter", lambda names, keys: np.full(1 << (collocations.FILTER_POWER - 6), -1, np.int64))
    assert sorted(map(tuple, collocations.collocations(docs, 4, 4, 50, 25).collect())) == plain_phrases(rows, 4, 4, 50, 25)


def test_phrases_of_a_block_pass_their_filter():
    body, ids = np.array([-1, 0, 1, 2, 0, 1, -1, 2, 0, 1]), np.array([70, 1 << 40, 3])
    of = lambda words, *filters: {tuple(map(int, x[:-1])): int(x[-1]) for own, n in [collocations._phrases(body, ids, words, list(filters))] for x in zip(*own, n)}
    a, b, c = ids.tolist()
    none = np.zeros(1 << (collocations.FILTER_POWER - 6), np.int64)
    assert of(2) == {(a, b): 3, (b, c): 1, (c, a): 2}
    assert of(3, ~none) == {(a, b, c): 1, (b, c, a): 1, (c, a, b): 2} and of(3, none) == of(4, none, none) == {}
    some = none.copy()
    for pair in ((c, a), (a, b)):
        at = collocations._place([np.array([x]) for x in pair])[0]
        some[at >> 6] |= np.left_shift(np.int64(1), at & 63)
    assert of(3, some) == {(c, a, b): 2} and of(4, some, ~none) == {}


def test_pairs_are_shuffled_once(spark):
    """A block more costs the shuffle of its pairs' counts alone: pairs don't go back to it, however many of them have become frequent."""
    context = spark.sparkContext._jsc.sc()
    text = " ".join(f"w{a} w{b}." for a in range(120) for b in range(120))  # no phrase of three words

    def shuffled(blocks):
        def total():
            context.listenerBus().waitUntilEmpty()
            return context.statusStore().executorList(False).apply(0).totalShuffleWrite()

        docs = spark.range(0, blocks, 1, blocks).select(F.lit("en").alias("lang"), F.lit(text).alias("text"))
        start = total()
        assert collocations.collocations(docs, min_count=2).count() == 2000
        return total() - start

    assert (shuffled(12) - shuffled(4)) / 8 < 5 * 120 * 120  # some 2 bytes a pair; 12 when pairs were joined with names, and their ids sent back


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 4_000_000_000_003, 4_000_000_000_019, 4_000_000_000_007
    level = spark.createDataFrame([(1, "en", "x y", a, [left], [right])], "id long, lang string, phrase string, f long, heads array<long>, tails array<long>")
    assert collocations._rated(level, 2).first().score == 10**6 * a * a // (left * right)


# --- 12
def plain_verdict(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (brute.lower(m[1]), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, default))
    return host, path, best[3], best[4]


URLS = [
    None, "", "example.net/en/", "http://", "http://example.net", "http://example.net/", "HTTP://EXAMPLE.NET/en/1", "http://a.b.example.net/en/?q=/x", "http://notexample.net/en/", "x://example.com/de/1#/", "http://example.com/de",
    "https://org/fr/é", "http://fr.org/fr/a://b", "http://.net/x", "http://net./x", "http://a..net/", "http://u@example.net:80/en/", "http://example.net?x://y/z", "file:///etc/en/", "ftp://É.example.net/en/ü", "http://\n.net/\n",
]


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_rules_decide_as_each_alone_would(spark, ranges):
    rng = np.random.default_rng(4)
    hosts = [".".join(rng.choice(["a", "b", "net", "aa", "B"], rng.integers(1, 5))) for _ in range(150)]
    paths = ["", "/", "/a", "/a/b", "/a/bc/d", "/é/"]
    urls = [*URLS, *(f"http://{h}{rng.choice(paths)}" for h in hosts for _ in range(2)), *["http://a.net/a/b"] * 300]
    rules = [*url_rules.RULES, ("allow", None, "/"), ("block", "", "/"), ("allow", "a.net", None), ("allow", "A.net", "/a"), ("block", "a.net", "/a"), ("block", "net", "/a/b")]
    rules += [(str(rng.choice(["allow", "block"])), h.lower(), str(rng.choice(paths))) for h in set(hosts[:40])]
    pages = spark.createDataFrame([(None if i == 7 else i, 0, 0, "k", u, "r", "v", "p") for i, u in enumerate(urls)], "page_id long, kind int, range int, key string, url string, rule string, verdict string, path string").repartition(4)
    got = url_rules.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), ranges=ranges)
    known = [(v, brute.lower(h or ""), p or "") for v, h, p in rules]
    want = [(None if i == 7 else i, *plain_verdict(u, known)) for i, u in enumerate(urls)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_no_pages_no_rules_and_another_default(spark):
    rules = spark.createDataFrame(url_rules.RULES, "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://a.org/x")], "page_id long, url string")
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(pages, rules, "block").collect()} == {1: ("net/", "block"), 2: (None, "block")}


def test_a_common_host_is_dealt_to_several_ranges(spark):
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 > 0, "http://hot.example.net/en/1").otherwise(F.concat(F.lit("http://h"), "id", F.lit(".org/fr/"))).alias("url"))
    out = url_rules.judge(pages, spark.createDataFrame(url_rules.RULES, "verdict string, host string, path string"), ranges=12)
    sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 4000 and len(sizes) == 12 and max(sizes) < 3 * 4000 / 12
    assert {(r.rule, r.verdict) for r in out.select("rule", "verdict").distinct().collect()} == {("example.net/en/", "allow"), ("org/fr/", "allow")}


# --- 13
def plain_middle(doc_id, text, rate=90, spm=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("size", [1, 2, 7, fill_middle.CHUNK])
def test_middles_equal_brute_force_and_come_back(spark, size):
    rng = np.random.default_rng(size)
    signs = list("abZ zé😀\n\x00<PSM>-9\u2028")
    texts = [None, "", "a", "é", "<P>", "x<S", "<M> <S>y", "S> <P", "ab" * 9, "a" * 40, "  ", "😀a😀", *("".join(rng.choice(signs, rng.integers(1, 60))) for _ in range(150))]
    rows = [*enumerate(texts), (None, "no id at all"), (3, "é"), (3, "another text")]
    docs = spark.createDataFrame([(i, t, "n", "f", 1) for i, t in rows], "doc_id long, text string, n string, form string, parts int")
    out = fill_middle.fill_in_middle(docs, size=size).select("*", fill_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted((tuple(r)[:6] for r in out), key=str) == sorted((plain_middle(i, t) for i, t in rows), key=str)
    assert sorted(r.back for r in out) == sorted(t or "" for _, t in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_middles_of_long_texts(spark):
    texts = {i: t for i, t in enumerate(["word " * 60_000, "x" * 300_000, "é!" * 50_000, "aé" * 100_000, "a" * 8191 + "b" * 2 + " c" * 9000])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(map(tuple, fill_middle.fill_in_middle(docs, rate=100).collect())) == [plain_middle(i, t, 100) for i, t in texts.items()]
