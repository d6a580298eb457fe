"""Phrases whose words belong together, found level by level.

Texts of a language are cut into blocks; a block is its sequence of local word
numbers, with gaps between pieces, and a dictionary of its words with their counts.
The entries of all dictionaries are counted by one shuffle and those that are frequent
get a global id.  The ids go back to the blocks that have the entries, and the
blocks, with ids instead of words, are written.  A level reads them and counts the
distinct phrases of k words of each block by one shuffle.  A phrase is counted only if
the two phrases of k - 1 words in it may be frequent: the frequent ones mark the bits of a
filter of fixed size, which goes to all tasks.  A filter may pass a rare
phrase, so that one is counted in vain, but a frequent phrase is never missed, as
its parts are as frequent.  Only entries of dictionaries and one row a block
are shuffled, never single words of a text, and no phrase goes back to the blocks.

The frequent phrases of k words are joined with those of k - 1 words, by all words but
the last (a) and by all but the first (b).  From these a phrase inherits what its
cuts need: the counts of its leading words are those of a, and a itself; the
counts of its trailing words are those of b, and b itself.  And what contains a
phrase is, one word longer, its children: as no longer phrase is more
frequent than a child that it contains, a phrase is subsumed if a child is
frequent enough.

Counts, products and quotients are exact: longs, and decimals of 38 digits.

Defined results: a null text is an empty one, a null lang is ``und``; repeated
rows count each; texts without a candidate add to n only; a phrase of unequal
scores at its cuts has that of the lowest, of equal ones that of the shortest first
part; columns other than text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table, trim, wanted_rows

#: Bytes of text in a block at most, but for a text that is longer.
BLOCK = 8 << 20
#: Bits of a filter of words or phrases, as a power of two: eight megabytes.
FILTER_POWER = 26
#: Dictionary entries in an Arrow batch.
ENTRIES = 100_000
# What ends a piece, and what else stands between words.
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: An entry's number in its block takes the low bits of ``at``; a sequence stands behind its block's entries.
_BITS, _SEQ = 31, 11
_LAST = (1 << _BITS) - 1
_WORDS = "at long, body binary, lang string, word string, n long"


def _packed(body: np.ndarray, kind: str = "<i4") -> bytes:
    """A sequence by planes of bytes, compressed: most numbers are small, so the high planes are next to nothing."""
    planes = np.ascontiguousarray(body.astype(kind).view(np.uint8).reshape(-1, int(kind[2])).T)
    return len(body).to_bytes(8, "little") + pa.compress(pa.py_buffer(planes), codec="zstd", asbytes=True)


def _unpacked(raw: pa.Buffer, kind: str = "<i4") -> np.ndarray:
    n, size = int.from_bytes(raw.slice(0, 8).to_pybytes(), "little"), int(kind[2])
    planes = np.frombuffer(pa.decompress(raw.slice(8), size * n, codec="zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _by_count(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the entries by falling count, and the new number of each."""
    order = np.argsort(-n, kind="stable")
    number = np.empty(len(n), np.int64)
    number[order] = np.arange(len(n))
    return order, number


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words, their lengths, and whether a piece begins with the word."""
    buf = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    gap = _GAP[buf]
    edge = np.diff(np.concatenate([[True], gap]).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    breaks = np.flatnonzero(_BREAK[buf])
    piece = np.searchsorted(breaks, start)  # breaks before the word
    return buf[~gap], (end - start).astype(np.int64), np.diff(piece, prepend=-1) > 0


def _rows(schema: pa.Schema, block: int, body: np.ndarray, lang: str, words: int, entries: dict) -> Iterator[pa.RecordBatch]:
    """A block's sequence and its entries, numbered as they come."""

    def batch(n: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    first = block << _BITS
    yield batch(1, {"at": pa.array([first | _LAST], pa.int64()), "body": pa.array([_packed(body)], pa.binary()), "lang": pa.array([lang], pa.string()), "n": pa.array([words], pa.int64())})
    total = len(entries["n"])
    for lo in range(0, total, ENTRIES):
        hi = min(lo + ENTRIES, total)
        yield batch(hi - lo, {"at": pa.array(first + np.arange(lo, hi, dtype=np.int64)), "word": entries["word"][lo:hi], "n": pa.array(entries["n"][lo:hi])})


def _word_block(schema: pa.Schema, block: int, lang: str, held: list) -> Iterator[pa.RecordBatch]:
    """The rows of a block; a word's key begins with its language and that one's length."""
    letters, size, begins = (np.concatenate(x) for x in zip(*held))
    upto = np.concatenate([[0], np.cumsum(size)])
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(upto), pa.py_buffer(letters)]).dictionary_encode()
    idx, known = words.indices.to_numpy(), words.dictionary
    n = np.bincount(idx, minlength=len(known))
    body = np.full(len(idx) + int(begins.sum()), -1, np.int32)  # -1 before every piece
    order, number = _by_count(n)
    body[np.arange(len(idx)) + np.cumsum(begins)] = number[idx]
    total = len(idx)
    del idx, words, letters, size, upto
    words = known.take(pa.array(order)).cast(pa.large_string()).cast(pa.string())
    words = pc.binary_join_element_wise(pa.scalar(f"{len(lang)}:{lang}"), words, pa.scalar(""))
    yield from _rows(schema, block, body, lang, total, {"word": words, "n": n[order]})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the texts of a task, each of one language."""
    schema = pa.schema([("at", pa.int64()), ("body", pa.binary()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
    part, made = TaskContext.get().partitionId(), 0
    held: dict[str, list] = {}
    size: dict[str, int] = {}

    def close(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal made
        if made >> _SEQ or part >> (63 - _BITS - _SEQ):
            raise ValueError("more blocks than numbers: read the texts in more partitions")
        del size[lang]
        yield from _word_block(schema, part << _SEQ | made, lang, held.pop(lang))
        made += 1
        trim()

    for batch in batches:
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            if text:
                by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            lo = 0
            while lo < len(texts):
                hi, n = lo, 0
                while hi < len(texts) and (hi == lo or n + len(texts[hi]) <= BLOCK // 4):
                    n += len(texts[hi])
                    hi += 1
                if lang in size and size[lang] + n > BLOCK:
                    yield from close(lang)
                tokens = _tokens(texts[lo:hi])
                if len(tokens[1]):
                    held.setdefault(lang, []).append(tokens)
                    size[lang] = size.get(lang, 0) + n
                lo = hi
        while sum(size.values()) > 2 * BLOCK:  # many languages in a task
            yield from close(max(size, key=size.__getitem__))
    for lang in list(size):
        yield from close(lang)


def _with_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks as the sequence of their named words, numbered anew, and the ids of these."""
    held: list[pa.RecordBatch] = []  # names of the block whose sequence is to come
    for batch in batches:
        lo = 0
        for k in np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False)).tolist():
            held.append(batch.slice(lo, k - lo))
            at, ids = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held]).astype(np.int64) for c in (0, 2))
            body = _unpacked(batch.column(1)[k].as_buffer())
            held, lo = [], k + 1
            if len(ids):
                to = np.full(int(body.max(initial=-1)) + 2, -1, np.int32)  # -1, the gap, reads the last place
                to[at & _LAST] = np.arange(len(ids))
                x = to[body]
                x = x[(x >= 0) | np.concatenate([[True], x[:-1] >= 0])]  # a gap is one place
                yield pa.RecordBatch.from_arrays([pa.array([_packed(x)], pa.binary()), pa.array([_packed(ids, "<i8")], pa.binary())], names=["body", "ids"])
                trim()
        held.append(batch.slice(lo))


def _place(columns: list[np.ndarray]) -> np.ndarray:
    """The bit of a filter that stands for the ids of a phrase."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - FILTER_POWER)).astype(np.int64)


def _filter(names: DataFrame, keys: list[str]) -> np.ndarray:
    """The bits of all named phrases, by words of 64: of a fixed size, whatever the table."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_place([c.to_numpy() for c in batch.columns]))], names=["place"])

    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = names.select(*keys).mapInArrow(places, "place long").groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_POWER - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def _phrases(body: np.ndarray, ids: np.ndarray, words: int, filters: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The block's distinct phrases of as many words, as columns of ids, and their counts; parts that their filter doesn't pass make none."""
    x, names = body.astype(np.int64), len(ids)
    phrase, own = x, [np.arange(names)]  # the number of the phrase that begins at a place, and the words of each
    for k in range(2, words + 1):
        begins = np.flatnonzero((phrase[1:] >= 0) & (phrase[:-1] >= 0))
        keys, at, n = np.unique(phrase[begins] * names + x[begins + k - 1], return_inverse=True, return_counts=True)
        own = [*(c[keys // max(names, 1)] for c in own), keys % max(names, 1)]
        if k < words:
            place = _place([ids[c] for c in own])
            passed = (filters[k - 2][place >> 6] >> (place & 63)) & 1 > 0
            phrase = np.full(len(phrase) - 1, -1, np.int64)
            phrase[begins] = np.where(passed[at], at, -1)
    return [ids[c] for c in own], n


def _counted(words: int, filters: list):
    """Entries of all blocks: the ids of phrases and their counts; filters are broadcast, one for each number of words from 2."""
    schema = pa.schema([*((f"w{i}", pa.int64()) for i in range(1, words + 1)), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, ids in zip(batch.column(0), batch.column(1)):
                own, n = _phrases(_unpacked(body.as_buffer()), _unpacked(ids.as_buffer(), "<i8"), words, [x.value for x in filters])
                for lo in range(0, len(n), ENTRIES):
                    yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + ENTRIES]) for c in (*own, n)], schema=schema)
                del own, n
                trim()

    return run


def _names(s: Scratch, entries: DataFrame, key: str, min_count: int, name: str) -> DataFrame:
    """The frequent entries with their counts f, numbered from 0: short numbers, as they are shuffled often."""
    counts = entries.groupBy(key).agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    bits = 33  # of a number within its partition
    found = s.save(counts.select(F.monotonically_increasing_id().alias("at"), key, "f"), f"{name}_found")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.groupBy(F.shiftright("at", bits).alias("part")).agg(F.count("*").alias("n"))  # a row a partition
    starts = F.broadcast(sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    numbered = found.withColumn("part", F.shiftright("at", bits)).withColumn("place", F.col("at") - F.shiftleft("part", bits)).join(starts, "part")
    out = s.save(numbered.select((F.col("start") + F.col("place")).alias("id"), key, "f"), name)
    s.drop(f"{name}_found")
    return out


def _answered(bodies: DataFrame, entries: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Each block's sequence, behind the local numbers and ids of its named entries: a row each, so that nothing but a sequence is as long as a block."""
    hashed = F.xxhash64(key).alias("key")
    maybe = wanted_rows(entries.select("at", key, hashed), "key", names.select(hashed), 1 << FILTER_POWER)
    named = maybe.drop("key").join(names.select(key, "id"), key).select("at", F.lit(None).cast("binary").alias("body"), "id")
    both = bodies.select("at", "body", F.lit(None).cast("long").alias("id")).unionByName(named)
    return both.repartition(F.shiftright("at", _BITS)).sortWithinPartitions("at")


def _heirs(names: DataFrame, above: DataFrame, words: int) -> DataFrame:
    """names with a, b (ids of the phrases without the last and without the first word), lang, phrase, last (word), heads and tails: counts of the first and of the last 1, 2 ... words."""
    keys = [f"w{i}" for i in range(1, words + 1)]
    left = above.select(*keys[:-1], F.col("id").alias("a"), "lang", F.col("phrase").alias("ahead"), F.concat("heads", F.array("f")).alias("heads"))
    right = above.select(*(F.col(k).alias(then) for k, then in zip(keys, keys[1:])), F.col("id").alias("b"), "last", F.concat("tails", F.array("f")).alias("tails"))
    both = names.join(left, keys[:-1]).join(right, keys[1:])
    return both.select("id", *keys, "a", "b", "f", "lang", F.concat_ws(" ", "ahead", "last").alias("phrase"), "last", "heads", "tails")


def _rated(level: DataFrame, words: int) -> DataFrame:
    """lang, phrase, a, l, r, score of phrases of as many words: the cut with the lowest score, of equals the first."""
    big = lambda c, digits=16: c.cast(f"decimal({digits},0)")  # noqa: E731  a count has at most 16 digits

    def cut(k: int):
        left, right = F.col("heads")[k - 1], F.col("tails")[words - k - 1]
        over = big(big(F.col("f")) * big(F.col("f")) * F.lit(1_000_000).cast("decimal(7,0)"), 38)
        under = big(big(left) * big(right), 38)
        whole = F.floor((over - over % under) / under).cast("long")  # the division has no remainder, so its digits don't matter
        return F.struct(whole.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))

    best = F.array_min(F.array(*(cut(k) for k in range(1, words))))
    return level.select("id", "lang", "phrase", F.col("f").alias("a"), best.alias("x")).select("id", "lang", "phrase", "a", "x.l", "x.r", "x.score")


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, subsumed: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``max_words`` words.

    A phrase that a longer candidate contains goes if that has at least
    ``subsumed`` percent of its occurrences.
    """
    s = Scratch(docs.sparkSession, "collocations")
    kind = lambda wanted: F.col("body").isNotNull() if wanted else F.col("body").isNull()
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    level = s.save(texts.mapInArrow(_blocks, _WORDS), "words", options={"compression": "zstd"})
    entries, bodies = level.where(kind(False)), level.where(kind(True))
    total = s.save(bodies.groupBy("lang").agg(F.sum("n").alias("n")), "total")
    names = _names(s, entries, "word", min_count, "names1")
    blocks = s.save(_answered(bodies, entries, names, "word").mapInArrow(_with_ids, "body binary, ids binary"), "blocks")
    s.drop("words")
    s.release()
    size = F.substring_index("word", ":", 1)
    split = names.select("id", "f", F.substring("word", F.length(size) + 2, size.cast("int")).alias("lang"), F.substring("word", F.length(size) + 2 + size.cast("int"), F.length("word")).alias("word"))
    above = split.select("id", F.col("id").alias("w1"), "f", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array().cast("array<long>").alias("heads"), F.array().cast("array<long>").alias("tails"))
    rated: list[DataFrame] = []
    filters: list = []
    for words in range(2, max_words + 1):
        keys = [f"w{i}" for i in range(1, words + 1)]
        found = blocks.mapInArrow(_counted(words, list(filters)), ", ".join(f"{k} long" for k in [*keys, "n"]))
        frequent = found.groupBy(*keys).agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
        names = s.save(frequent.select(F.monotonically_increasing_id().alias("id"), *keys, "f"), f"names{words}")
        s.release()
        if words < max_words:
            filters.append(docs.sparkSession.sparkContext.broadcast(_filter(names, keys)))
        here = s.save(_heirs(names, above, words), f"heirs{words}")
        if rated:  # the phrases one word shorter lose those which a child contains
            child = here.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("id"), "f").groupBy("id").agg(F.max("f").alias("most"))
            kept = rated[-1].join(child, "id", "left").where(F.coalesce(100 * F.col("most") < subsumed * F.col("a"), F.lit(True)))
            rated[-1] = kept.drop("most")
        rated.append(_rated(here, words))
        above = here
    s.drop("blocks")
    for bits in filters:
        bits.destroy()
    every = rated[0]
    for more in rated[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")  # cut off to ``top`` rows a task before the shuffle
    best = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    return s.close(out)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL11 = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    p AS (SELECT k, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece, generate_subscripts(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]'), 1) AS pno FROM d),
    w AS (SELECT k, lang, pno, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
    t AS (SELECT k, lang, pno, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
    g AS (SELECT lang, w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM t WINDOW o AS (PARTITION BY k, pno ORDER BY i)),
    n AS (SELECT lang, count(*) AS n FROM g GROUP BY lang),
    f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
    f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
    f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
    c2 AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, x.f AS l, y.f AS r, f2.f::HUGEINT * f2.f * 1000000 // (x.f::HUGEINT * y.f) AS score
           FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
           WHERE f2.f >= 10 AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND (f3.w1 = f2.w1 AND f3.w2 = f2.w2 OR f3.w2 = f2.w1 AND f3.w3 = f2.w2) AND 100 * f3.f >= 50 * f2.f)),
    s3 AS (SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.f AS a, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2,
                  f3.f::HUGEINT * f3.f * 1000000 // (x.f::HUGEINT * yz.f) AS s1, f3.f::HUGEINT * f3.f * 1000000 // (xy.f::HUGEINT * z.f) AS s2
           FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 yz ON yz.lang = f3.lang AND yz.w1 = f3.w2 AND yz.w2 = f3.w3
           JOIN f2 xy ON xy.lang = f3.lang AND xy.w1 = f3.w1 AND xy.w2 = f3.w2 JOIN f1 z ON z.lang = f3.lang AND z.w1 = f3.w3),
    c AS (SELECT * FROM c2 UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM s3),
    k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
    SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM k JOIN n USING (lang) WHERE rank <= 2000"""
