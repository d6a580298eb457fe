"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are words; a chain is a sentence, or ``CHAIN`` words of a longer one.  A
token's features are its word (lower-case, marks cut off) and its first three,
four and five bytes.  Training takes labelled documents:

1. a feature that occurs in toxic documents far beyond chance (a binomial tail,
   corrected for the number of features) labels the tokens that carry it, in
   toxic documents, as toxic, as surely as it parts toxic from clean documents:
   1 - (share of clean documents with it) / (share of toxic ones with it), if
   that is a half at least.  All other tokens are labelled clean;
2. feature weights and the transition weights of the chain are fitted to these
   soft labels by gradient ascent on the expected conditional likelihood
   (forward-backward);
3. 1 - product(1 - marginal) and the sum of marginals over a document's tokens,
   as such and by its length, are calibrated to a probability by a logistic
   regression on the same documents' labels.

Training is bounded by ``max_docs`` labelled rows and ``max_chars`` characters
of text, taken in the order of a hash of doc_id; rows whose text alone exceeds
what is left of the bound are skipped, texts are never cut.  Texts become numbers
in the tasks that read them, and one task fits the bounded sample, so that
neither texts nor the fit take memory of the driver.  Scoring covers all words of
all texts.

Defined results: null and empty texts have no tokens and get the score of a text
without any toxic token; a doc_id with several labels counts as toxic if one
says so; a null label is no label; repeated labelled rows count once; without
both kinds of label every score is the share of toxic ones (0 where there is
none).  Spans are ranges of characters (code points) of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import by_batch, crc_mod, documents, small_batches, trim
from .tokens import _MARK

PREFIXES = (3, 4, 5)
KINDS = 1 + len(PREFIXES)
#: Words of a chain at most.
CHAIN = 128
#: Tokens whose marginals are computed at a time in training.
AT_ONCE = 200_000
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


@dataclass
class Model:
    """Weights of known features (sorted hashes), transitions, and the calibration."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -20.0
    change: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(3))
    base: float = -30.0


@dataclass
class Tokens:
    """Words of some texts: distinct ones with their features, and the chains."""

    word: np.ndarray  # distinct word of each token
    features: np.ndarray  # distinct word x kind
    first: np.ndarray  # first token of each document, and the end
    begin: np.ndarray  # first token of each chain, and the end
    distinct: np.ndarray  # hashes of the distinct words
    start: np.ndarray  # bytes
    end: np.ndarray
    buf: np.ndarray


def tokenize(texts: list[str | None]) -> Tokens:
    buf, start, end, first = wh.word_spans(texts)
    raw = wh.hash_spans(buf, start, end, True)
    distinct, at, word = np.unique(raw, return_index=True, return_inverse=True)
    a, b = start[at], end[at]
    order = np.argsort(a, kind="stable")
    s, e = a[order], b[order]
    core = e.copy()
    for _ in range(4):
        core -= (core - 1 > s) & _MARK[buf[core - 1]]
    lead = s.copy()
    for _ in range(2):
        lead += (lead + 1 < core) & _MARK[buf[np.minimum(lead, len(buf) - 1)]]
    features = np.zeros((len(distinct), KINDS), np.uint64)
    features[order, 0] = wh.mix(wh.hash_spans(buf, lead, core, True) + np.uint64(1))
    for k, n in enumerate(PREFIXES, 1):
        # a word of no more bytes has no such prefix
        cut = np.minimum(lead + n, core)
        h = wh.mix(wh.hash_spans(buf, lead, cut, True) + np.uint64(k + 1))
        features[order, k] = np.where(core - lead > n, h, np.uint64(0))
    # a chain ends at a stop or a line's end
    if len(start):
        gap = np.concatenate([[0], np.cumsum(buf == 10)])
        line = np.concatenate([[True], gap[start[1:]] > gap[end[:-1]]])
        stop = np.concatenate([[True], _STOP[buf[end[:-1] - 1]]])
        begin = np.flatnonzero(line | stop)
        begin = np.unique(np.concatenate([begin, first[:-1][first[:-1] < len(start)]]))
        size = np.diff(np.append(begin, len(start)))
        turn = np.arange(len(start)) - np.repeat(begin, size)
        begin = np.flatnonzero(turn % CHAIN == 0)
    else:
        begin = np.zeros(0, np.int64)
    return Tokens(word, features, first, np.concatenate([begin, [len(start)]]).astype(np.int64), distinct, start, end, buf)


def emissions(features: np.ndarray, model: Model) -> np.ndarray:
    """For each distinct word, how much more its features speak for toxic than for clean."""
    out = np.full(len(features), model.bias)
    if len(model.keys):
        for k in range(features.shape[1]):
            at = np.minimum(np.searchsorted(model.keys, features[:, k]), len(model.keys) - 1)
            out += np.where(model.keys[at] == features[:, k], model.weights[at], 0.0)
    return out


def forward_backward(e: np.ndarray, begin: np.ndarray, start: np.ndarray, change: np.ndarray, times: np.ndarray):
    """Marginals of toxic for every token, expected transitions (2 x 2) and first states; chain c counts times[c].

    All chains advance together, longest first, so that ended ones drop out.
    """
    n, size = len(e), np.diff(begin)
    order = np.argsort(-size, kind="stable")
    b, size = begin[:-1][order], size[order]
    alpha, beta = np.zeros((n, 2)), np.ones((n, 2))
    grow = np.exp(np.clip(e, -30, 30))
    # psi of a token: 1 for clean, exp(e) for toxic, scaled to sum 1
    psi = np.stack([1 / (1 + grow), grow / (1 + grow)], 1)
    m = np.exp(change)
    longest = int(size[0]) if len(size) else 0
    alive = [int(x) for x in np.searchsorted(-size, -np.arange(1, longest + 1), "right")]
    for t in range(longest):
        k = alive[t]
        at = b[:k] + t
        a = psi[at] * (np.exp(start) if t == 0 else alpha[at - 1] @ m)
        alpha[at] = a / a.sum(1)[:, None]
    for t in range(longest - 2, -1, -1):
        at = b[: alive[t + 1]] + t
        x = (psi[at + 1] * beta[at + 1]) @ m.T
        beta[at] = x / x.sum(1)[:, None]
    p = alpha * beta
    p /= p.sum(1)[:, None]
    inner = np.ones(n, bool)
    inner[begin[:-1]] = False
    at = np.flatnonzero(inner)
    pair = alpha[at - 1][:, :, None] * m[None] * (psi[at] * beta[at])[:, None, :]
    pair /= pair.sum((1, 2))[:, None, None]
    many = np.repeat(times, np.diff(begin))[at]
    return p[:, 1], (pair * many[:, None, None]).sum(0), (p[begin[:-1]] * times[:, None]).sum(0)


def distinct_chains(plain: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chains, stand-in of every chain): chains of plain tokens only are alike if they are as long, and one stands for all."""
    size = np.diff(begin)
    alike = np.logical_and.reduceat(plain, begin[:-1])
    key = np.where(alike, size, -1 - np.arange(len(size)))
    _, chains, standin = np.unique(key, return_index=True, return_inverse=True)
    return chains, standin


def _of_chains(begin: np.ndarray, chains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of some chains, one after the other, and where each begins."""
    size = np.diff(begin)[chains]
    own = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(begin[chains] - own[:-1], size) + np.arange(own[-1]), own


def marginals(e: np.ndarray, begin: np.ndarray, model: Model) -> np.ndarray:
    """Probability of toxic of every token."""
    if not len(e):
        return np.zeros(0)
    chains, standin = distinct_chains(e == model.bias, begin)
    at, own = _of_chains(begin, chains)
    p = forward_backward(e[at], own, model.start, model.change, np.ones(len(chains)))[0]
    return p[np.repeat(own[standin] - begin[:-1], np.diff(begin)) + np.arange(len(e))]


def summaries(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each document: log odds that some token is toxic, and the log of 1 + the sum of marginals, as such and in a hundred words."""
    clean = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-9)))])
    total = np.concatenate([[0.0], np.cumsum(p)])
    some = -np.expm1(clean[first[1:]] - clean[first[:-1]])
    some = np.clip(some, 1e-6, 1 - 1e-6)
    total = np.maximum(0, total[first[1:]] - total[first[:-1]])
    return np.stack([np.log(some / (1 - some)), np.log1p(total), np.log1p(100 * total / np.maximum(1, np.diff(first)))], 1)


def telling(t: Tokens, toxic: np.ndarray, risk: float = 0.01, least: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) of the features whose share of toxic documents can't be chance, and how surely each speaks for toxic."""
    docs, words = len(t.first) - 1, len(t.features)
    all_toxic, share = float(toxic.sum()), float(toxic.mean())
    pairs = np.unique(np.repeat(np.arange(docs), np.diff(t.first)) * words + t.word)
    doc, word = pairs // max(1, words), pairs % max(1, words)
    keys, yes, no = [], [], []
    for k in range(KINDS):
        found, number = np.unique(t.features[:, k], return_inverse=True)
        own = np.unique(number[word] * docs + doc)
        n = np.bincount(own // docs, minlength=len(found))
        y = np.bincount(own // docs, toxic[own % docs], len(found))
        real = found != 0
        keys.append(found[real])
        yes.append(y[real])
        no.append((n - y)[real])
    key, y, x = np.concatenate(keys), np.concatenate(yes), np.concatenate(no)
    # Chernoff's bound of the binomial tail, for all features at once
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = y / (y + x)
        gain = (y + x) * (np.where(y > 0, rate * np.log(rate / share), 0) + np.where(x > 0, (1 - rate) * np.log((1 - rate) / (1 - share)), 0))
        sure = 1 - (x + 0.5) / (docs - all_toxic + 1) * all_toxic / y
    kept = np.flatnonzero((rate > share) & (sure >= least) & (gain > np.log(max(1, len(key)) / risk)))
    kept = kept[np.argsort(key[kept], kind="stable")]
    return key[kept], sure[kept]


def _fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights, the last for the constant, by Newton's method with a small ridge."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (y - p) - 0.1 * w
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + 0.1 * np.eye(len(w)), g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: list[str | None], toxic: np.ndarray, rounds: int = 60, rate: float = 0.5) -> Model:
    return train_tokens(tokenize(texts), toxic, rounds, rate)


def train_tokens(t: Tokens, toxic: np.ndarray, rounds: int = 60, rate: float = 0.5) -> Model:
    model = Model()
    y = np.asarray(toxic, float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        model.base = float(np.log(max(share, 1e-12) / max(1 - share, 1e-12)))
        return model
    keys, sure = telling(t, y)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, t.features), len(keys) - 1)
        label = np.where(keys[at] == t.features, sure[at], 0.0).max(1)[t.word] * np.repeat(y, np.diff(t.first))
        used = np.unique(np.concatenate([keys, t.features[np.unique(t.word[label > 0])].ravel()]))
        model.keys = used[used != 0]
        model.weights = np.zeros(len(model.keys))
        _ascend(t, label, model, rounds, rate)
    p = marginals(emissions(t.features, model)[t.word], t.begin, model)
    w = _fit_logistic(summaries(p, t.first), y)
    model.scale, model.base = w[:-1], float(w[-1])
    return model


def _ascend(t: Tokens, label: np.ndarray, model: Model, rounds: int, rate: float) -> None:
    """Gradient ascent with a step per weight (Adam) on the chains' expected conditional log-likelihood."""
    at = np.searchsorted(model.keys, t.features)
    known = model.keys[np.minimum(at, len(model.keys) - 1)] == t.features
    row, kind = np.nonzero(known)
    slot = at[row, kind]
    # chains without known features are told apart by their length only
    chains, standin = distinct_chains(~known.any(1)[t.word], t.begin)
    times = np.bincount(standin).astype(float)
    order = np.argsort(np.diff(t.begin)[chains], kind="stable")  # chains of a piece are about as long
    chains, times = chains[order], times[order]
    upto = np.cumsum(np.diff(t.begin)[chains])
    pieces = np.split(np.arange(len(chains)), np.searchsorted(upto, np.arange(AT_ONCE, upto[-1], AT_ONCE)))
    n = len(t.word)
    first = np.zeros(n, bool)
    first[t.begin[:-1]] = True
    inner = np.flatnonzero(~first)
    a, b = label[inner - 1], label[inner]
    seen = np.array([[((1 - a) * (1 - b)).sum(), ((1 - a) * b).sum()], [(a * (1 - b)).sum(), (a * b).sum()]])
    began = np.array([(1 - label[first]).sum(), label[first].sum()])
    model.bias = float(np.log((label.sum() + 1) / (n - label.sum() + 1)))
    # what a word's tokens are labelled, over all chains; those merged above have no labels
    want = np.bincount(t.word, label, len(t.features))
    size = [len(model.weights), 1, 4, 2]
    w = np.concatenate([model.weights, [model.bias], model.change.ravel(), model.start])
    m1, m2 = np.zeros(len(w)), np.zeros(len(w))
    for i in range(1, rounds + 1):
        model.weights, model.bias = w[: size[0]], float(w[size[0]])
        model.change, model.start = w[size[0] + 1 : size[0] + 5].reshape(2, 2), w[-2:]
        e = emissions(t.features, model)
        diff, pairs, starts = want.copy(), np.zeros((2, 2)), np.zeros(2)
        for piece in pieces:
            if not len(piece):
                continue
            tokens, own = _of_chains(t.begin, chains[piece])
            word = t.word[tokens]
            p, some_pairs, some_starts = forward_backward(e[word], own, model.start, model.change, times[piece])
            diff -= np.bincount(word, p * np.repeat(times[piece], np.diff(own)), len(t.features))
            pairs, starts = pairs + some_pairs, starts + some_starts
        g = np.concatenate([np.bincount(slot, diff[row], size[0]), [diff.sum()], (seen - pairs).ravel(), began - starts])
        g -= 0.05 * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w = w + rate * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.99**i)) + 1e-8)
    model.weights, model.bias = w[: size[0]], float(w[size[0]])
    model.change, model.start = w[size[0] + 1 : size[0] + 5].reshape(2, 2), w[-2:]


def score_texts(texts: list[str | None], model: Model) -> tuple[np.ndarray, list[list[list[int]]]]:
    """A score from 0 to 1 for each text, and its toxic spans as [first character, end]."""
    t = tokenize(texts)
    p = marginals(emissions(t.features, model)[t.word], t.begin, model)
    z = summaries(p, t.first) @ model.scale + model.base
    scores = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    hot = np.flatnonzero(p >= 0.5)
    spans: list[list[list[int]]] = [[] for _ in texts]
    if not len(hot):
        return scores, spans
    docs = np.searchsorted(t.first, hot, "right") - 1
    # bytes that don't begin a character, and the characters of earlier texts (each ends by a line break)
    inner = np.concatenate([[0], np.cumsum((t.buf & 0xC0) == 0x80)])
    before = np.cumsum([0, *(len(x or "") + 1 for x in texts)])
    start, end = t.start[hot] - inner[t.start[hot]], t.end[hot] - inner[t.end[hot]]
    last = -2
    for d, k, a, b in zip(docs.tolist(), hot.tolist(), (start - before[docs]).tolist(), (end - before[docs]).tolist()):
        if spans[d] and last == k - 1:
            spans[d][-1][1] = b
        else:
            spans[d].append([a, b])
        last = k
    return scores, spans


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int, max_chars: int, hold_out: int | None) -> DataFrame:
    """doc_id, text and toxic of the labelled rows that training takes."""
    toxic = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    toxic = toxic.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if hold_out:
        toxic = toxic.where(crc_mod("doc_id", hold_out) != 0)
    chosen = toxic.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)  # a bounded sample, so it can be broadcast
    docs = documents(docs)
    sizes = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.xxhash64("doc_id").alias("o"))
    sizes = sizes.groupBy("doc_id", "o").agg(F.sum("n").alias("n")).orderBy("o", "doc_id").select("doc_id", "n").toPandas()  # max_docs rows at most
    ids, left = [], max_chars
    for doc, n in zip(sizes["doc_id"].tolist(), sizes["n"].tolist()):
        if n <= left:
            ids.append(doc)
            left -= n
    wanted = docs.sparkSession.createDataFrame(pd.DataFrame({"doc_id": np.array(ids, np.int64)}), "doc_id long")
    return docs.join(F.broadcast(chosen), "doc_id").join(F.broadcast(wanted), "doc_id").select("doc_id", "text", "toxic")


CODED = "docs array<long>, toxic array<int>, sizes array<int>, words binary, begins binary, distinct binary, features binary"
FITTED = "keys binary, weights binary, numbers array<double>"


def _coded(frame: pd.DataFrame) -> pd.DataFrame:
    """The texts of a batch as numbers of the batch's distinct words, with their features."""
    t = tokenize(frame["text"].tolist())
    begins = np.zeros(len(t.word), np.uint8)
    begins[t.begin[:-1]] = 1
    row = {
        "docs": frame["doc_id"].tolist(), "toxic": frame["toxic"].tolist(), "sizes": np.diff(t.first).tolist(), "words": t.word.astype(np.int32).tobytes(),
        "begins": begins.tobytes(), "distinct": t.distinct.tobytes(), "features": t.features.tobytes(),
    }
    return pd.DataFrame([row])


def joined_tokens(rows) -> tuple[Tokens, np.ndarray]:
    """Tokens and labels of coded batches, documents by id; what doesn't depend on how they were dealt to batches."""
    texts, hashes, features, known = [], [], [], 0
    for r in rows:
        word = np.frombuffer(r.words, np.int32) + known
        begins = np.frombuffer(r.begins, np.uint8)
        hashes.append(np.frombuffer(r.distinct, np.uint64))
        features.append(np.frombuffer(r.features, np.uint64).reshape(-1, KINDS))
        known += len(hashes[-1])
        cuts = np.cumsum([0, *r.sizes])
        texts += [(int(d), int(y), word[a:b], begins[a:b]) for d, y, a, b in zip(r.docs, r.toxic, cuts[:-1], cuts[1:])]
    if not texts:
        return tokenize([]), np.zeros(0)
    distinct, at, number = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    number = number.astype(np.int32)
    texts = [(d, y, number[w], b) for d, y, w, b in texts]
    texts.sort(key=lambda x: (x[0], len(x[2]), x[2].tobytes()))
    texts = [x for i, x in enumerate(texts) if not i or x[0] != texts[i - 1][0] or len(x[2]) != len(texts[i - 1][2]) or (x[2] != texts[i - 1][2]).any()]
    word, begins = np.concatenate([x[2] for x in texts]), np.concatenate([x[3] for x in texts])
    first = np.cumsum([0, *(len(x[2]) for x in texts)])
    none = np.zeros(0, np.int64)
    begin = np.append(np.flatnonzero(begins), len(word))
    return Tokens(word, np.concatenate(features)[at], first, begin, distinct, none, none, none), np.array([x[1] for x in texts], float)


def _fitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    model = train_tokens(*joined_tokens(r for frame in frames for r in frame.itertuples(index=False)))
    numbers = [model.bias, model.base, *model.scale, *model.start, *model.change.ravel()]
    yield pd.DataFrame([{"keys": model.keys.tobytes(), "weights": model.weights.astype(float).tobytes(), "numbers": [float(x) for x in numbers]}])
    trim()


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 20_000, max_chars: int = 12_000_000, hold_out: int | None = None) -> Model:
    """A model from labelled documents; those whose crc32(doc_id) mod hold_out is 0 take no part."""
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, max_docs, max_chars, hold_out).mapInPandas(by_batch(_coded), CODED)
    (r,) = rows.repartition(1).mapInPandas(_fitted, FITTED).collect()  # one row
    n = r.numbers
    return Model(np.frombuffer(r.keys, np.uint64), np.frombuffer(r.weights, float), n[0], np.array(n[7:]).reshape(2, 2), np.array(n[5:7]), np.array(n[2:5]), n[1])


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, spans (characters of toxic runs of words) of every document."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        scores, spans = score_texts(frame["text"].tolist(), model)
        return pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": scores, "spans": spans})

    small_batches(docs.sparkSession)
    return documents(docs).mapInPandas(by_batch(run), "doc_id long, score double, spans array<array<int>>")


def without_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, with a score under ``limit``."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return frame[score_texts(frame["text"].tolist(), model)[0] < limit]

    small_batches(docs.sparkSession)
    return docs.mapInPandas(by_batch(run), docs.schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), hold_out=5)
    out = tag(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
