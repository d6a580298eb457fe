"""Licence notices of any shape against a plain scan by the module's rules."""

import random
from fractions import Fraction

from quillon.llm import license_scan as L

from . import brute

TOP = Fraction(8, 10)
KNOWN = {name: L._pairs(L.template_words(text)) for name, text in L.TEMPLATES.items()}
BOUNDS = {name: (-(-2 * len(p) // 3), len(p) * 3 // 2) for name, p in KNOWN.items()}


def pairs(words):
    return {f"{a} {b}" for a, b in zip(words, words[1:])} or {f"{w} " for w in words}


def enough(shared, n, m):
    return 2 * shared >= TOP * (n + m)


def plain_scan(text):
    if text is None:
        return []
    lines = [L.template_words(brute.lower(x)) for x in text.split("\n")]
    words = [w for x in lines for w in x]
    line_of = [i for i, x in enumerate(lines) for _ in x]

    def fits(ws):
        p = pairs(ws)
        return {t for t, q in KNOWN.items() if BOUNDS[t][0] <= len(p) <= BOUNDS[t][1] and enough(len(p & q), len(p), len(q))} if ws else set()

    out = []
    for line, ws in [*enumerate(lines), *([(-1, words)] if len(lines) > 1 else [])]:
        if found := fits(ws):
            p = pairs(ws)
            best = min(found, key=lambda t: (-Fraction(2 * len(p & KNOWN[t]), len(p) + len(KNOWN[t])), t))
            out.append((line, best, len(p & KNOWN[best]), len(p), len(KNOWN[best])))
    windows = []
    for t, q in sorted(KNOWN.items()):
        low, high = BOUNDS[t]
        hits = [i for i in range(len(words) - 1) if f"{words[i]} {words[i + 1]}" in q]
        for start in hits:
            of = []
            for end in hits:
                if start <= end < start + high:
                    p = pairs(words[start : end + 2])
                    if len(p) >= low and enough(len(p & q), len(p), len(q)):
                        of.append((-len(p & q) * 2.0 / (len(p) + len(q)), -len(p & q), end, len(p)))
            if of:
                less, fewer, end, n = min(of)
                windows.append((fewer, less, t, start, end, n))
    kept = []
    for x in sorted(windows):
        if all(x[3] > y[4] + 1 or y[3] > x[4] + 1 for y in kept):
            kept.append(x)
    whole = fits(words) if len(lines) > 1 else set()
    for fewer, _, t, start, end, n in kept:
        line, last = line_of[start], line_of[end + 1]
        said = set().union(*(fits(lines[k]) for k in range(line, last + 1)))
        longer = {u for u, q in KNOWN.items() if KNOWN[t] <= q}
        if not (longer & (said | whole) or line == last and said):
            out.append((line, t, -fewer, n, len(KNOWN[t])))
    return sorted(out)


def shapes(rng):
    """A text of notices that are cut, changed, wrapped, repeated and set between other words."""
    out = []
    for _ in range(rng.randint(1, 4)):
        words = rng.choice(list(L.TEMPLATES.values())).split(" ")
        kind = rng.random()
        if kind < 0.3:
            words = words[rng.randint(0, 2) : len(words) - rng.randint(0, 2)]
        elif kind < 0.6:
            words = [w if rng.random() > 0.06 else rng.choice(["", "other", "THE", "x.y"]) for w in words]
        elif kind < 0.7:
            words = words * rng.randint(2, 3)
        out += ["some", "words"] * rng.randint(0, 3) + words
    glue = rng.choice([0.0, 0.1, 0.4])
    return "".join(w + ("\n * " if rng.random() < glue else " ") for w in out)


def test_scans_equal_plain_rules(spark):
    rng = random.Random(7)
    texts = [shapes(rng) for _ in range(150)] + [None, "", "\n", "the license", "license", "Released under the MIT License.", "a\nLicensed under\nCC BY 4.0.\nb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = sorted((i, *r) for i, t in enumerate(texts) for r in plain_scan(t))
    got = sorted((r.doc_id, r.line, r.license, r.shared, r.segment_bigrams, r.template_bigrams) for r in L.scan(docs).collect())
    assert got == want
    assert sum(r[1] >= 0 for r in want) > 100


def test_no_text_without_a_telling_word_reaches_the_limit():
    words = set(L.telling_words({n: sorted(p) for n, p in KNOWN.items()}, {n: b[0] for n, b in BOUNDS.items()}))
    for name, p in KNOWN.items():
        assert sum(not words & set(x.split(" ")) for x in p) < BOUNDS[name][0], name


def test_thousands_of_notices_in_one_text(spark):
    n = 2000
    text = "Released under the MIT License. Some words then. " * n
    docs = spark.createDataFrame([(1, text), (2, "\n".join([text[: 48 * 300]] * 3))], "doc_id long, text string")
    got = [(r.doc_id, r.license, r.shared) for r in L.scan(docs).collect()]
    assert sum(d == 1 for d, _, _ in got) == n and set(got) == {(1, "MIT", 4), (2, "MIT", 4)}
