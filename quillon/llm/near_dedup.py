"""Near duplicates by a chosen-path set similarity join.

A document is the set of its distinct shingles, and that set is known by
``HASHES`` minwise hashes.  In each of ``trees`` independent trees a node chooses
one of those hashes at random (and a second with probability 1/threshold - 1),
and its documents go to the child that belongs to the value they have there.
Pairs of similar documents thus take the same path more often than others; a
pair at the threshold meets in about 0.7 of the trees at depth three.

* Documents of equal sets are one node of the graph from the start.
* A node of at most ``leaf`` documents is compared exhaustively by sketches (the
  least shingle hash of each of ``BINS`` ranges): pairs whose sketches agree
  enough, 4.5 standard deviations below the threshold, are candidates.  A larger
  one branches on.  What is still larger at ``depth`` is a crowd of near copies,
  in which branching parts nobody; such nodes of all trees are united where they
  share documents, and each union is compared exhaustively once, in blocks that
  are tasks' groups of their own.
* Candidates are confirmed on the full sets.  Only links between different
  components matter, so in a first round a document names its ``most`` likeliest
  partners, in a second eight times as many outside its component; the third and
  last round confirms every candidate that still lies between components,
  however many there are.

Defined results: n_shingles 0 (null text, no words): linked with nothing, its
component is itself; fewer words than a shingle: the whole sequence is one
shingle; rows of one doc_id are one document; without doc_id a row is linked
with nothing, has no component and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import wordhash as wh
from .common import Scratch, by_batch, documents, groups, marked_rows, unused, wanted_rows
from .components import components

HASHES, BINS = 64, 1024
#: Documents of a leaf that are compared at a time.
BLOCK = 1024
_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    _, _, _, h, first = wh.words(texts, True)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        x = h[a:b]
        if 0 < len(x) < width:
            out.append(wh.mix(wh.chain(x, len(x)) + np.uint64(len(x))))
        else:
            out.append(np.unique(wh.chain(x, width)))
    return out


def minwise(u: np.ndarray) -> np.ndarray:
    """Sixteen bits of the least product with each of the fixed factors."""
    if len(u) * HASHES <= 1 << 20:
        least = (u[None, :] * _FACTORS[:, None]).min(1)
    else:
        least = np.array([(u * f).min() for f in _FACTORS], np.uint64)
    return (least >> np.uint64(20)).astype(np.uint16)


def sketch(u: np.ndarray) -> np.ndarray:
    """For each of BINS equal ranges of hashes, seven and a bit bits of the least one in it; 0 where there is none."""
    out = np.zeros(BINS, np.uint8)
    at = (u >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    out[at[first]] = (u[first] % np.uint64(255)).astype(np.uint8) + 1
    return out


def _sets(width: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for doc, u in zip(frame["doc_id"].tolist(), shingle_sets(frame["text"].tolist(), width)):
            doc = None if pd.isna(doc) else int(doc)
            if len(u):
                h1, h2 = wh.mix(u).sum(dtype=np.uint64), np.bitwise_xor.reduce(wh.mix(u * np.uint64(3)))
                rows.append((doc, len(u), int(h1.view(np.int64)), int(h2.view(np.int64)), *((minwise(u).tobytes(), sketch(u).tobytes()) if doc is not None else (None, None))))
            else:
                rows.append((doc, 0, None, None, None, None))
        out = pd.DataFrame(rows, columns=["doc_id", "n", "h1", "h2", "sig", "sketch"])
        return out.astype({"doc_id": "Int64", "h1": "Int64", "h2": "Int64"})

    return run


def _children(path: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) for documents at the nodes ``path``: the node's hash alone decides which values count."""
    out_row, out_child = [], []
    rows = np.arange(len(path))
    share = np.uint64(int((1 / threshold - 1) * 2**32))
    for turn in range(2):
        chosen = rows if not turn else rows[(wh.mix(path ^ np.uint64(0xA5A5)) >> np.uint64(32)) < share]
        p = path[chosen]
        at = (wh.mix(p + np.uint64(0x51ED + turn)) % np.uint64(HASHES)).astype(np.int64)
        value = sig[chosen, at].astype(np.uint64)
        out_row.append(chosen)
        out_child.append(wh.mix(wh.mix(p + np.uint64(turn + 1)) ^ wh.mix(value + (at.astype(np.uint64) << np.uint64(40)))))
    return np.concatenate(out_row), np.concatenate(out_child)


def _signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column.tolist()), np.uint16).reshape(-1, HASHES)


def _roots(trees: int, depth: int, threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            sig, rep = _signatures(frame["sig"]), frame["rep"].to_numpy()
            for tree in range(trees):
                row, path = np.arange(len(rep)), wh.mix(np.full(len(rep), 7919 * (tree + 1), np.uint64))
                for _ in range(depth):
                    r, path = _children(path, sig[row], threshold)
                    row = row[r]
                yield pd.DataFrame({"node": path.view(np.int64), "rep": rep[row]})

    return run


def _branch(threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                row, path = _children(frame["node"].to_numpy(np.int64).view(np.uint64), _signatures(frame["sig"]), threshold)
                yield pd.DataFrame({"node": path.view(np.int64), "rep": frame["rep"].to_numpy()[row]})

    return run


_PAIRS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Best:
    """The ``most`` likeliest partners of each of m documents, however many pairs are offered."""

    def __init__(self, m: int, most: int):
        self.est, self.other, self.offered = np.full((m, most), -1), np.full((m, most), -1), 0

    def add(self, i: int, y: np.ndarray, est: np.ndarray) -> None:
        """Pairs of i with the documents y."""
        most = self.est.shape[1]
        self.offered += len(y)
        e, o = np.concatenate([self.est[i], est]), np.concatenate([self.other[i], y])
        order = np.argsort(-e, kind="stable")[:most]
        self.est[i], self.other[i] = e[order], o[order]
        k = self.est[y].argmin(1)
        better = est > self.est[y, k]
        self.est[y[better], k[better]], self.other[y[better], k[better]] = est[better], i

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        """(x, y, est) that are among the best of either document, each once; whether any was left out."""
        x, k = np.nonzero(self.other >= 0)
        y, est = self.other[x, k], self.est[x, k]
        _, once = np.unique(np.minimum(x, y) * len(self.est) + np.maximum(x, y), return_index=True)
        return x[once], y[once], est[once], len(once) < self.offered


def _compare(threshold: float, most: int | None):
    """Candidates (a, b, est, key) of each leaf or pair of blocks: every document's ``most`` likeliest partners of other components.

    key is that of the group where some were left out, else null.
    """

    def likely(sk, n, label, side, x, y) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the pairs (x, y) are candidates, and how far their sketches agree (in thousandths)."""
        fit = (label[x] != label[y]) & (np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y]))
        if side is not None:
            fit &= side[x] != side[y]
        x, y = x[fit], y[fit]
        a, b = sk[x], sk[y]
        same, used = ((a == b) & (a > 0)).sum(1), ((a | b) > 0).sum(1)
        # the sketch is a sample without replacement of the union, whose size follows from the threshold
        union = np.maximum(used, (n[x] + n[y]) / (1 + threshold))
        slack = 4.5 * np.sqrt(threshold * (1 - threshold) / used * np.maximum(0.02, 1 - used / union)) + 1 / used
        fit = same >= (threshold - slack) * used
        return x[fit], y[fit], (1000 * same[fit]) // used[fit]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[np.ndarray, ...]] = []
        size = 0
        for g in groups(frames, "key"):
            m = len(g)
            if m < 2:
                continue
            sk = np.frombuffer(b"".join(g["sketch"].tolist()), np.uint8).reshape(m, BINS)
            rep, n, label, side = (g[c].to_numpy() for c in ("rep", "n", "label", "side"))
            if side.min() == side.max():
                side = None
            left_out = False
            if m <= 48:
                x, y, est = likely(sk, n, label, side, *_PAIRS.setdefault(m, np.triu_indices(m, 1)))
                if most is not None and m > most + 1:
                    best = Best(m, most)
                    for i in np.unique(x).tolist():
                        best.add(i, y[x == i], est[x == i])
                    x, y, est, left_out = best.pairs()
            else:
                best, parts = Best(m, most or 1), []
                for i in range(m - 1):
                    other = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
                    if len(other):
                        part = likely(sk, n, label, side, np.full(len(other), i), other)
                        if most is None:
                            parts.append(part)
                        else:
                            best.add(i, *part[1:])
                if most is None:
                    x, y, est = map(np.concatenate, zip(*parts)) if parts else (np.zeros(0, int),) * 3
                else:
                    x, y, est, left_out = best.pairs()
            if len(x):
                a, b = np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y])
                found.append((a, b, est, np.full(len(a), g["key"].iloc[0]), np.full(len(a), left_out)))
                size += len(a)
            if size > 50_000:
                yield _frame(found)
                found, size = [], 0
        if found:
            yield _frame(found)

    return run


def _frame(found: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    a, b, est, key, left_out = map(np.concatenate, zip(*found))
    return pd.DataFrame({"a": a, "b": b, "est": est, "key": pd.array(np.where(left_out, key, 0), "Int64").astype("Int64")}).assign(key=lambda f: f["key"].where(left_out))


def _confirm(width: int, per_cent: int):
    """Which of the pairs of a document (the row whose doc_id is a) are links."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for g in groups(frames, "key"):
            sets = dict(zip(g["doc_id"].tolist(), shingle_sets(g["text"].tolist(), width)))
            a = int(g["a"].iloc[0])
            for b, y in sets.items():
                if b != a and a in sets:
                    both = len(np.intersect1d(sets[a], y, assume_unique=True))
                    out.append((a, b, 100 * both >= per_cent * (len(sets[a]) + len(y) - both)))
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=["a", "b", "linked"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["a", "b", "linked"])

    return run


def _told(pairs: DataFrame, texts: DataFrame, width: int, per_cent: int) -> DataFrame:
    """(a, b, linked) of pairs (a, b); a document's text travels once for up to 256 of its pairs."""
    turn = F.floor((F.row_number().over(Window.partitionBy("a").orderBy("b")) - 1) / 256)
    pairs = pairs.select("a", "b", F.xxhash64("a", turn).alias("key"))
    ends = pairs.select("key", "a", F.col("b").alias("doc_id")).unionByName(pairs.select("key", "a", F.col("a").alias("doc_id")).distinct())
    ends = ends.join(texts, "doc_id").repartition("key").sortWithinPartitions("key")
    return ends.select("key", "a", "doc_id", "text").mapInPandas(_confirm(width, per_cent), "a long, b long, linked boolean")


def _labelled(rows: DataFrame, labels: DataFrame | None, column: str, out: str) -> DataFrame:
    """rows with the component of a document's column; its own id without one."""
    if labels is None:
        return rows.withColumn(out, F.col(column))
    known = labels.select(F.col("node").alias(column), F.col("label").alias("known_label"))
    return rows.join(known, column, "left").withColumn(out, F.coalesce("known_label", column)).drop("known_label")


def _crowds(rows: DataFrame, s: Scratch) -> DataFrame:
    """(node, rep, size) of the unions of nodes (node, rep) that share documents."""
    rows = s.save(rows.select("node", "rep"), "crowded")
    least = s.save(rows.groupBy("node").agg(F.min("rep").alias("a")), "least")
    labels = components(rows.join(least, "node").select("a", F.col("rep").alias("b")).distinct(), s, "crowds")
    size = s.save(labels.groupBy("label").agg(F.count("*").alias("size")), "crowdsizes")
    return labels.join(size, "label").select(F.xxhash64(F.lit("crowd"), "label").alias("node"), F.col("node").alias("rep"), "size")


def near_duplicates(
    docs: DataFrame, width: int = 5, per_cent: int = 80, trees: int = 12, start: int = 3, depth: int = 5, leaf: int = 256, most: int = 4
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Documents are linked at 100 * intersection >= per_cent * union of their sets
    of ``width``-word shingles; a component keeps its smallest doc_id.
    """
    s = Scratch(docs.sparkSession, "near")
    docs = documents(docs)
    threshold = per_cent / 100
    sets = s.save(docs.mapInPandas(by_batch(_sets(width)), "doc_id long, n long, h1 long, h2 long, sig binary, sketch binary"), "sets")
    classes = sets.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("sig", "sketch"), "doc_id").alias("x"))
    classes = classes.select("h1", "h2", "n", "rep", "x.sig", "x.sketch")
    classes = s.save(classes, "classes")

    # branch until nodes are small
    rows = s.save(classes.select("rep", "sig").mapInPandas(_roots(trees, start, threshold), "node long, rep long"), "level")
    leaves, level = None, start
    while True:
        counts = rows.groupBy("node").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
        counts = s.save(counts.where("size > 1"), f"counts{level}")
        # nodes of the same documents, as most trees have them, are compared once
        once = counts.where(F.col("size") <= leaf).groupBy("size", "x", "y").agg(F.min("node").alias("node")).select("node", "size")
        kept = s.save(rows.join(once, "node"), f"leaves{level}")
        leaves = kept if leaves is None else leaves.unionByName(kept)
        large = s.save(counts.where(F.col("size") > leaf).select("node"), f"nodes{level}")
        if not large.limit(1).count():
            break
        if level >= depth:
            leaves = leaves.unionByName(_crowds(rows.join(large, "node"), s))
            break
        large = s.save(rows.join(large, "node"), f"large{level}")
        deeper = large.join(wanted_rows(classes.select("rep", "sig"), "rep", large.select("rep")), "rep")
        level += 1
        rows = s.save(deeper.mapInPandas(_branch(threshold), "node long, rep long"), f"level{level}")
        s.drop("level" if level == start + 1 else f"level{level - 1}")

    # a leaf, or two of its blocks, is a group; the number of blocks grows with the leaf
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    members = leaves.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    members = s.save(members.select(key.alias("key"), "rep", side.alias("side")), "places")
    wanted = s.save(members.select("rep").distinct(), "wanted")
    members = s.save(members.join(wanted_rows(classes.select("rep", "n", "sketch"), "rep", wanted), "rep"), "members")
    texts = s.save(wanted_rows(docs, "doc_id", wanted), "texts")

    labels, done, work, left = None, None, members, None
    for turn, named in enumerate((most, 8 * most, None)):
        m = _labelled(work, labels, "rep", "label").select("key", "rep", "side", "n", "label", "sketch").repartition("key").sortWithinPartitions("key")
        found = s.save(m.mapInPandas(_compare(threshold, named), "a long, b long, est int, key long"), f"found{turn}")
        pairs = found.groupBy("a", "b").agg(F.max("est").alias("est"))
        if left is not None:
            pairs = pairs.unionByName(left).groupBy("a", "b").agg(F.max("est").alias("est")).join(done.select("a", "b"), ["a", "b"], "left_anti")
            pairs = _labelled(_labelled(pairs, labels, "a", "la"), labels, "b", "lb").where("la <> lb").select("a", "b", "est")
        pairs = s.save(pairs, f"pairs{turn}")
        chosen = pairs
        if named is not None:  # of all trees together, the likeliest
            ends = pairs.select("a", "b", "est", F.col("a").alias("rep")).unionByName(pairs.select("a", "b", "est", F.col("b").alias("rep")))
            place = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("est"), "a", "b"))
            chosen = s.save(ends.withColumn("place", place).where(F.col("place") <= named).select("a", "b").distinct(), f"chosen{turn}")
        told = s.save(_told(chosen, texts, width, per_cent), f"told{turn}")
        done = told if done is None else done.unionByName(told)
        if told.where("linked").limit(1).count():  # else the components are as before
            labels = components(done.where("linked").select("a", "b"), s, f"components{turn}")
        if named is None:
            break
        left = s.save(pairs.join(chosen, ["a", "b"], "left_anti"), f"left{turn}")
        again = s.save(found.where("key is not null").select("key").distinct(), f"again{turn}")
        if not left.limit(1).count() and not again.limit(1).count():
            break
        work = work.join(again, "key", "left_semi")
    comp = classes.select("h1", "h2", "n", "rep")
    comp = _labelled(comp, labels, "rep", "component_id")
    comp = s.save(comp.select("h1", "h2", "n", "component_id"), "comp")
    out = sets.select("doc_id", "n", "h1", "h2").join(comp, ["h1", "h2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return s.close(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def without_near_duplicates(docs: DataFrame, width: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows of docs, all columns as they are, that their component keeps."""
    key, goes, maybe = unused(docs.columns, "key", "goes", "maybe")
    gone = near_duplicates(docs, width, per_cent).where(~F.col("kept")).select(F.col("doc_id").alias(goes)).distinct()
    # only rows that may go are dealt out by id
    rows = marked_rows(docs.withColumn(key, F.col("doc_id").cast("long")), key, gone, maybe)
    asked = rows.where(F.col(maybe)).join(gone, F.col(key) == F.col(goes), "left_anti")
    return rows.where(~F.col(maybe)).unionByName(asked).drop(key, maybe)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, per_cent=85)


SQL7 = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w, ' ') AS s FROM d WHERE len(w) BETWEEN 1 AND 2
      UNION SELECT doc_id, array_to_string(w[i : i + 2], ' ') FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(v, w) AS (SELECT a, b FROM u UNION SELECT r.v, u.b FROM r JOIN u ON u.a = r.w),
m AS (SELECT v, min(w) AS w FROM r GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.w, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m.w, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.v = d.doc_id
"""
