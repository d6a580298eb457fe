"""Plain versions of the operators, and a small table with awkward rows."""

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, score double, row long, rep long, label long, source string, n_chars long, part int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, a copy, a near copy, clashing columns."""
    long = " ".join(f"w{i % 977}x{i // 7}" for i in range(6000))
    a = " ".join(f"alpha{i}" for i in range(130))
    b = a.replace("alpha64", "omega")
    c = "start of this " + " ".join(f"alpha{i}" for i in range(30, 100)) + " and an end"
    texts = [
        (1, a), (2, a), (3, b), (4, c), (5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "one two"), (10, long), (11, long + " tail"), (12, "One TWO"), (None, a), (14, "Ünïcode é"),
        (8, "one"), (15, "x"), (16, "x"),
    ]
    rows = [(i, t, None, 1.5, None, 2, 3, None, len(t) if t else None, 4) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA), texts


def substring(texts, width):
    first = {}
    for i, t in texts:
        w = words(t)
        for k in range(len(w) - width + 1):
            if i is not None:
                first[tuple(w[k : k + width])] = min(first.get(tuple(w[k : k + width]), i), i)
    out = []
    for i, t in texts:
        w = words(t)
        keep = [True] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                keep[k : k + width] = [False] * width
        kept = " ".join(x for x, y in zip(w, keep) if y)
        out.append((i, len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, width):
    w = words(lower(text))
    if 0 < len(w) < width:
        return {tuple(w)}
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}


def near(texts, width, per_cent):
    sets = {i: shingles(t, width) for i, t in texts if i is not None}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= per_cent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def crc(ids):
    return zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids))
