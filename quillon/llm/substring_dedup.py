"""Exact substring dedup: fixed windows of words that also start in an earlier document are removed.

Every window of ``width`` words has a Rabin-Karp hash of 128 bits (two
polynomials over unlike hashes of its words).  A window is redundant in
a document if the same words also start a window of a document with a smaller
id.  Redundant windows merge into maximal intervals, which are cut out.

All windows take part.  Three lossless reductions keep the shuffles small:

* texts with the same words are counted as one text, that of the smallest id
  (in the others every window is redundant, so all words of one with ``width``
  words or more go);
* the minimizer of a window (the least hash of the ``seed``-word runs inside)
  is the same wherever the window occurs, so only windows whose minimizer occurs
  in two documents can repeat; the others are dropped before the full count;
* counts are minima of document ids, hence pre-aggregated before the shuffle,
  and the join back to the windows is one that Spark can split where a passage
  is very common.

Defined results: null text has no words; texts under ``width`` words are kept
whole; rows repeating a doc_id count as the same document (a window must start
in a document with a *smaller* id), each row is returned; a null doc_id neither
removes nor loses words.  Kept words are joined by one space.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import Scratch, by_batch, documents, marked_rows, unused, wanted_rows

WIDTH, SEED = 50, 8


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _sequence_hash(h: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a sequence of word hashes, as signed numbers."""
    n = wh.mix(np.arange(1, len(h) + 1, dtype=np.uint64))
    return int(wh.mix(h + n).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(wh.mix(h * np.uint64(3) ^ n)).view(np.int64))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def second(h: np.ndarray) -> np.ndarray:
    """Other hashes of the same words, for the second half of a window's hash."""
    return wh.mix(h ^ np.uint64(0xA0761D6478BD642F))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp: the hash of h[i:i + width] as a difference of one running polynomial."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = wh._tables(len(h) + 1)
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=run[1:])
    return wh.mix((run[width:] - run[:-width]) * down[:n])


def _scan(width: int, seed: int):
    """A row per document: its words' number and hashes, and the minimizers of its windows, each once."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        _, _, _, h, first = wh.words(frame["text"].tolist(), False)
        rows = []
        for k, (doc, row) in enumerate(zip(frame["doc_id"].tolist(), frame["row"].tolist())):
            x = h[first[k] : first[k + 1]]
            if len(x) >= width and not pd.isna(doc):
                seeds = _signed(np.unique(sliding_min(wh.chain(x, seed), width - seed + 1))).tolist()
                rows.append((int(doc), row, len(x), *_sequence_hash(x), seeds))
        return pd.DataFrame(rows, columns=["doc_id", "row", "n_words", "h1", "h2", "seeds"])

    return run


def _windows(width: int, seed: int):
    """Windows of a document whose minimizer is in its list of shared ones."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        _, _, _, h, first = wh.words(frame["text"].tolist(), False)
        out = []
        for k, (doc, row, shared) in enumerate(zip(frame["doc_id"].tolist(), frame["row"].tolist(), frame["shared"].tolist())):
            x = h[first[k] : first[k + 1]]
            least = _signed(sliding_min(wh.chain(x, seed), width - seed + 1))
            at = np.flatnonzero(np.isin(least, np.asarray(shared, np.int64)))
            both = (_signed(window_hashes(y, width))[at] for y in (x, second(x)))
            out.append((*both, np.full(len(at), doc), np.full(len(at), row), at.astype(np.int32)))
        return pd.DataFrame(dict(zip(("w", "w2", "doc_id", "row", "at"), map(np.concatenate, zip(*out))))) if out else None

    return run


def intervals(starts: np.ndarray, width: int) -> np.ndarray:
    """Maximal intervals [a, b) of words that windows starting at ``starts`` cover."""
    s = np.unique(starts)
    if not len(s):
        return np.zeros((0, 2), np.int64)
    new = np.flatnonzero(np.concatenate([[True], s[1:] > s[:-1] + width]))
    last = np.concatenate([new[1:] - 1, [len(s) - 1]])
    return np.stack([s[new], s[last] + width], 1)


def _marked(docs: DataFrame, s: Scratch, width: int, seed: int) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: starts (of redundant windows), twin (all words are an earlier document's)."""
    id_, row, maybe, own, twin = unused(docs.columns, "id", "row", "maybe", "starts", "twin")
    texts = documents(docs).withColumn("row", F.xxhash64("text"))
    scan = s.save(texts.mapInPandas(by_batch(_scan(width, seed)), "doc_id long, row long, n_words long, h1 long, h2 long, seeds array<long>"), "scan")
    # the smallest id stands for all texts of the same words: the others repeat its windows, all of them and no more
    same = scan.groupBy("h1", "h2", "n_words").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    same = s.save(same.where("least <> most").select("h1", "h2", "n_words", "least"), "same")
    twins = s.save(scan.join(same, ["h1", "h2", "n_words"]).where("doc_id > least").select("doc_id", "row").distinct(), "twins")
    seeds = s.save(scan.join(twins, ["doc_id", "row"], "left_anti").select("doc_id", "row", F.explode("seeds").alias("m")), "seeds")
    common = s.save(seeds.groupBy("m").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("m"), "common")
    lists = seeds.join(common, "m").groupBy("doc_id", "row").agg(F.collect_set("m").alias("shared"))
    lists = s.save(lists, "lists")
    windows = wanted_rows(texts, "doc_id", lists.select("doc_id")).join(lists, ["doc_id", "row"]).mapInPandas(by_batch(_windows(width, seed)), "w long, w2 long, doc_id long, row long, at int")
    windows = s.save(windows, "windows")
    first = windows.groupBy("w", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    first = s.save(first.where("least <> most").select("w", "w2", "least"), "first")
    starts = windows.join(first, ["w", "w2"]).where("doc_id > least").groupBy("doc_id", "row").agg(F.collect_list("at").alias(own))
    key = [F.col("doc_id").cast("long").alias(id_), F.xxhash64(F.col("text").cast("string")).alias(row)]
    starts = s.save(starts.withColumnsRenamed({"doc_id": id_, "row": row}), "starts")
    twins = twins.withColumnsRenamed({"doc_id": id_, "row": row}).withColumn(twin, F.lit(True))
    # only texts that may lose words are dealt out by id to meet their windows
    rows = marked_rows(docs.select("*", *key), id_, starts.select(id_).unionByName(twins.select(id_)), maybe)
    met = rows.where(F.col(maybe)).join(starts, [id_, row], "left").join(twins, [id_, row], "left")
    whole = rows.where(~F.col(maybe)).withColumns({own: F.lit(None).cast("array<int>"), twin: F.lit(False)})
    out = met.unionByName(whole).drop(id_, row, maybe)
    return out.withColumn(twin, F.coalesce(twin, F.lit(False))), own, twin


def _cut(frame: pd.DataFrame, width: int, own: str, twin: str) -> list[tuple[int, int, str, list[list[int]]]]:
    """(words, words removed, kept words, removal intervals) of each row; its columns own and twin are those of _marked."""
    out = []
    buf, start, end, first = wh.word_spans(frame["text"].tolist())
    raw = buf.tobytes()
    for k, (starts, all_go) in enumerate(zip(frame[own].tolist(), frame[twin].tolist())):
        a, b = int(first[k]), int(first[k + 1])
        n, keep = b - a, np.ones(b - a, bool)
        spans = np.array([[0, n]] if all_go and n >= width else [], np.int64).reshape(-1, 2)
        if starts is not None and not len(spans):
            spans = intervals(np.asarray(starts, np.int64), width)
        for x, y in spans:
            keep[x:y] = False
        words = [raw[i:j] for i, j in zip(start[a:b][keep].tolist(), end[a:b][keep].tolist())]
        out.append((n, n - int(keep.sum()), b" ".join(words).decode("utf-8", "surrogatepass"), spans.tolist()))
    return out


def remove_repeats(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text), intervals (of word positions) for every row of docs."""
    s = Scratch(docs.sparkSession, "repeats")
    marked, own, twin = _marked(documents(docs), s, width, seed)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(_cut(frame, width, own, twin), columns=["n_words", "n_removed", "kept", "intervals"])
        out.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy())
        return out

    kind = "doc_id long, n_words long, n_removed long, kept string, intervals array<array<long>>"
    return s.close(marked.mapInPandas(by_batch(run), kind))


def without_repeats(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """docs, all columns and rows, with the kept words as text (and n_chars, if there is one) where words were removed."""
    s = Scratch(docs.sparkSession, "repeats")
    columns = docs.columns
    marked, own, twin = _marked(docs, s, width, seed)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = frame[columns].copy()
        rows = _cut(frame, width, own, twin)
        out["text"] = [kept if removed else text for text, (_, removed, kept, _) in zip(frame["text"].tolist(), rows)]
        if "n_chars" in columns:
            out["n_chars"] = [len(kept) if removed else n for n, (_, removed, kept, _) in zip(frame["n_chars"].tolist(), rows)]
        return out

    return s.close(marked.mapInPandas(by_batch(run), docs.schema))


def op6(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


SQL6 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(0, 50)) AS k FROM win JOIN f USING (s) WHERE m < doc_id)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
