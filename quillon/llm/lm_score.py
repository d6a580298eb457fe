"""Log-likelihood of whole documents under a gated recurrent language model.

Tokens are the lower-cased words of a text and one end.  The output is factored:
the model predicts a class, then the word within it.

* The ``HEAD`` most frequent words form classes of ``SLOTS`` words each; the word
  within the class is predicted from the recurrent state as well.
* All other words of the training documents belong to a class by their count's
  magnitude and, within it, to a form (last bytes, marks, non-ASCII bytes), which
  is predicted from the state too; of a magnitude and form, a word has its share
  of their training tokens.
* One class is for words that training didn't see; as in the unigram base, they
  are one event, however they are spelt.

Probabilities of all known words and the unknown one sum to 1 in every state.
For training, a word counts without the occurrence at hand, so words seen once
teach what unseen words look like.

Counts come from all training documents: texts are coded block by block (some
megabytes), each block's distinct words are counted in Spark, and the counts
return to the blocks that need them, so no task ever holds the vocabulary.
Weights: gated recurrent units, truncated back-propagation through time in numpy
with states carried from window to window.  A warm start on a bounded number of
blocks (``WARM_BLOCKS``) is followed by training in every partition of the
corpus, on all words of all documents that aren't held out, and the partitions'
weights are averaged, weighted by their tokens, in a tree.  Scoring carries the state through the whole document.

Defined results: null and empty texts have one token, the end; a row without
doc_id is not held out; repeated rows count and are scored each; without any
training tokens nothing but the unknown word has probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import Scratch, by_batch, documents, trim
from .tokens import _MARK

HEAD, SLOTS, FORMS, HIDDEN = 1024, 32, 24, 24
#: Least counts of the tail's magnitudes.
BINS = (1, 2, 4, 16, 128)
BLOCK, WARM_BLOCKS, SHARE, WARM_UPDATES = 10 << 20, 3, 1, 240
GROUPS = HEAD // SLOTS
TAIL = len(BINS) * FORMS
#: Classes that have slots: those of the head, then the magnitudes of the tail.
SLOTTED = GROUPS + len(BINS)
CLASSES = SLOTTED + 1
UNKNOWN = HEAD + TAIL
START = UNKNOWN + 1
END = np.uint64((1 << 64) - 1)
LN10 = np.log(10.0)


def held_out(doc: int | None, modulus: int, remainder: int) -> bool:
    return doc is not None and zlib.crc32(str(doc).encode()) % modulus == remainder


def forms(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number under FORMS by what a word looks like."""
    core = end.copy()
    for _ in range(3):
        core -= (core - 1 > start) & _MARK[buf[core - 1]]
    high = np.concatenate([[0], np.cumsum(buf >= 128)])
    last = buf[core - 1].astype(np.uint64)
    before = np.where(core - 1 > start, buf[np.maximum(core - 2, 0)], 0).astype(np.uint64)
    tail = (wh.mix(last * np.uint64(256) + before) % np.uint64(FORMS // 4)).astype(np.int64)
    return (tail * 4 + 2 * (high[end] > high[start]) + (core < end)).astype(np.int16)


def planes(x: np.ndarray, n: int) -> list[bytes]:
    """The bytes of numbers by significance, which compresses better than side by side."""
    return [((x >> (8 * k)) & 255).astype(np.uint8).tobytes() for k in range(n)]


def unplane(parts: list[bytes]) -> np.ndarray:
    return sum(np.frombuffer(p, np.uint8).astype(np.int64) << (8 * k) for k, p in enumerate(parts))


def _code(modulus: int, remainder: int):
    """Blocks of documents as numbers of the block's own distinct words; word 0 is the end."""
    state = {"seq": 0}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        buf, start, end, h, first = wh.words(frame["text"].tolist(), True)
        docs = [None if pd.isna(d) else int(d) for d in frame["doc_id"].tolist()]
        held = np.array([held_out(d, modulus, remainder) for d in docs])
        distinct, at, word = np.unique(h, return_index=True, return_inverse=True)
        size = np.diff(first)
        teaches = np.repeat(~held, size)
        # frequent words get small numbers
        n = np.bincount(word, minlength=len(distinct))
        order = np.argsort(-n, kind="stable")
        if len(order) >= 1 << 24:
            raise ValueError("more distinct words in a block than three bytes can number; use smaller blocks")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(1, len(order) + 1)
        counts = np.bincount(word, teaches, len(distinct)).astype(np.int64)[order]
        form = np.zeros(len(distinct), np.int16)
        by_place = np.argsort(at, kind="stable")
        form[by_place] = forms(buf, start[at[by_place]], end[at[by_place]]) if len(at) else 0
        block = TaskContext.get().partitionId() << 24 | state["seq"]
        state["seq"] += 1
        row = {
            "block": block, "docs": docs, "held": held.tolist(), "sizes": size.tolist(), "words": np.concatenate([[END], distinct[order]]).astype(np.uint64).tobytes(),
            "counts": np.concatenate([[int((~held).sum())], counts]).astype(np.uint32).tobytes(), "forms": np.concatenate([[0], form[order]]).astype(np.int16).tobytes(),
        }
        return pd.DataFrame([row | dict(zip(("p0", "p1", "p2"), planes(number[word], 3)))])

    return run


BLOCKS = "block long, docs array<long>, held array<boolean>, sizes array<int>, words binary, counts binary, forms binary, p0 binary, p1 binary, p2 binary"


def _dictionary(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for r in frame.itertuples(index=False):
            words = np.frombuffer(r.words, np.int64)
            yield pd.DataFrame(
                {"block": np.full(len(words), r.block), "k": np.arange(len(words), dtype=np.int32), "w": words, "c": np.frombuffer(r.counts, np.uint32).astype(np.int64), "form": np.frombuffer(r.forms, np.int16)}
            )


@dataclass
class Vocabulary:
    """What all tasks need of the counts; its size doesn't depend on the corpus."""

    tokens: int
    distinct: int
    head: np.ndarray  # hashes of the head's words, sorted
    rank: np.ndarray  # their ranks
    head_counts: np.ndarray  # by rank
    totals: np.ndarray  # training tokens of each tail class
    types: np.ndarray  # words of each tail class

    def symbols(self, rank: np.ndarray, c: np.ndarray, form: np.ndarray, leave: bool) -> np.ndarray:
        """Symbol of each word by its rank in the head (-1: none), count and form; with ``leave``, as if it occurred once less."""
        out = self._tail(c, form)
        if leave:
            less = self._tail(c - 1, form)
            out = np.where((less == UNKNOWN) | (self.types[np.minimum(less - HEAD, TAIL - 1)] > 0), less, out)
        return np.where(rank >= 0, rank, out)

    @staticmethod
    def _tail(c: np.ndarray, form: np.ndarray) -> np.ndarray:
        magnitude = np.searchsorted(BINS, c, "right") - 1
        return np.where(magnitude < 0, UNKNOWN, HEAD + magnitude * FORMS + form)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From (w, c, form) of all words of the training documents."""
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("c"), "w").limit(HEAD).select("w", "c").collect()
    ranks = np.array([r.w for r in top], np.int64)
    order = np.argsort(ranks)
    magnitude = F.lit(-1)
    for i, least in enumerate(BINS):
        magnitude = F.when(F.col("c") >= least, i).otherwise(magnitude)
    totals, types = np.zeros(TAIL), np.zeros(TAIL, np.int64)
    tail = counts.withColumn("class", magnitude * FORMS + F.col("form")).groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    for r in tail:  # a row per class
        totals[r["class"]], types[r["class"]] = r.n, r.v
    out = Vocabulary(total.n or 0, total.v, ranks[order], order.astype(np.int64), np.array([r.c for r in top], np.int64), totals, types)
    if top:  # the head's words are not in the tail
        forms_of = {r.w: r.form for r in counts.join(F.broadcast(counts.sparkSession.createDataFrame([(r.w,) for r in top], "w long")), "w").collect()}
        own = Vocabulary._tail(out.head_counts, np.array([forms_of[r.w] for r in top])) - HEAD
        np.subtract.at(out.totals, own, out.head_counts)
        np.subtract.at(out.types, own, 1)
    return out


def _symbols(v: Vocabulary, share: int):
    """Coded blocks with counts in place of words: symbols, and what of a document's score doesn't depend on weights."""

    def run(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=[c.split()[0] for c in CODED.split(", ")])
        r = left.iloc[0]
        form = np.frombuffer(r.forms, np.int16).astype(np.int64)
        c, rank = np.zeros(len(form), np.int64), np.full(len(form), -1)
        own = right["k"].to_numpy(np.int64)
        c[own], rank[own] = right["c"].to_numpy(np.int64), right["rank"].to_numpy(np.int64)
        symbol, taught = v.symbols(rank, c, form, False), v.symbols(rank, c, form, True)
        base = np.log10((c + 1) / (v.tokens + v.distinct + 1))
        tail = (symbol >= HEAD) & (symbol < UNKNOWN)
        inside = np.zeros(len(form))
        inside[tail] = np.log10(c[tail] / v.totals[symbol[tail] - HEAD])
        size = np.asarray(r.sizes, np.int64)
        word = np.zeros(int(size.sum()) + len(size), np.int64)  # every document ends by word 0
        end = np.cumsum(size + 1) - 1
        is_word = np.ones(len(word), bool)
        is_word[end] = False
        word[is_word] = unplane([r.p0, r.p1, r.p2])
        sums = lambda x: np.add.reduceat(x[word], end - size).tolist()
        docs = [None if d is None or d != d else int(d) for d in r.docs]
        held = np.asarray(r.held, bool)
        chosen = ~held & (np.array([zlib.crc32(f"{d}-train".encode()) % share for d in docs]) == 0)
        row = {
            "block": r.block, "docs": docs, "held": held.tolist(), "n_tokens": (size + 1).tolist(), "n_known": sums((c > 0).astype(np.int64)),
            "base": sums(base), "inside": sums(inside), "chosen": chosen.tolist(), "lower": np.packbits((taught != symbol)[word]).tobytes(),
        }
        trim()
        row |= dict(zip(("s0", "s1"), planes(symbol[word], 2)))
        return pd.DataFrame([row])

    return run


CODED = (
    "block long, docs array<long>, held array<boolean>, n_tokens array<int>, n_known array<long>, base array<double>, inside array<double>, "
    "chosen array<boolean>, lower binary, s0 binary, s1 binary"
)


def place(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and slot of each symbol; what is unknown has no slot (0)."""
    tail = symbol - HEAD
    head = symbol < HEAD
    cls = np.where(head, symbol // SLOTS, np.where(symbol == UNKNOWN, SLOTTED, GROUPS + tail // FORMS))
    return cls, np.where(head, symbol % SLOTS, np.where(symbol == UNKNOWN, 0, tail % FORMS))


class Network:
    """Gated recurrent units with a class-factored output; all weights in one vector."""

    SHAPES = (
        ("x", (START + 1, 3 * HIDDEN)), ("u", (HIDDEN, 3 * HIDDEN)), ("wc", (CLASSES, HIDDEN)), ("bc", (CLASSES, 1)),
        ("ww", (SLOTTED, SLOTS, HIDDEN)), ("bw", (SLOTTED, SLOTS, 1)),
    )

    def __init__(self, flat: np.ndarray, missing_classes: np.ndarray, missing_words: np.ndarray):
        self.flat, self.missing_classes, self.missing_words = flat.astype(np.float32), missing_classes, missing_words
        at = 0
        for name, shape in self.SHAPES:
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(shape)) for _, shape in cls.SHAPES)

    @classmethod
    def fresh(cls, v: Vocabulary, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        words = np.zeros(HEAD)
        words[: len(v.head_counts)] = v.head_counts
        slots = np.zeros((SLOTTED, SLOTS))
        slots[:GROUPS] = words.reshape(GROUPS, SLOTS)
        slots[GROUPS:, :FORMS] = v.totals.reshape(len(BINS), FORMS)
        # one occurrence of each word left out: those seen once become unknown
        classes = np.append(slots.sum(1), max(1.0, float(v.types[:FORMS].sum())))
        missing_classes, missing_words = classes <= 0, slots <= 0
        net = cls(rng.normal(0, 0.1, cls.size()), missing_classes, missing_words)
        net.bc[:, 0] = np.where(missing_classes, -1e4, np.log(np.maximum(classes, 1)))
        net.bc -= net.bc.max()
        net.bw[:, :, 0] = np.where(missing_words, -1e4, np.log(np.maximum(slots, 1)))
        net.bw -= net.bw.max(1, keepdims=True)
        net.wc *= 0.5
        net.ww *= 0.5
        return net

    def step(self, h: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state from the last one and the input's part of the gates (a row of x per lane); and z, r, n, u's part of n."""
        g = h @ self.u
        zr = a[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN]
        zr *= 0.5  # the logistic function by tanh
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        z, r, g = zr[:, :HIDDEN], zr[:, HIDDEN:], g[:, 2 * HIDDEN :]
        n = r * g
        n += a[:, 2 * HIDDEN :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, g

    def log_likelihood(self, hs: np.ndarray, target: np.ndarray, grad: Network | None = None):
        """Natural log-probability of each target (a symbol, -1: none) in the states hs (HIDDEN x targets).

        With grad, also d/dhs, and weights' gradients are added to it.
        """
        there = target >= 0
        cls, slot = place(np.where(there, target, UNKNOWN))
        logit = self.wc @ hs
        logit += self.bc
        logit -= logit.max(0)
        rows = np.arange(len(target))
        out = logit[cls, rows]
        e = np.exp(logit, out=logit)
        total = e.sum(0)
        out = np.where(there, out - np.log(total), 0.0)
        dh = None
        if grad is not None:
            e *= np.where(there, -1 / total, 0).astype(np.float32)
            e[cls, rows] += there
            e[self.missing_classes] = 0
            grad.wc += e @ hs.T
            grad.bc += e.sum(1, keepdims=True)
            dh = self.wc.T @ e
        order = np.argsort(np.where(there, cls, SLOTTED).astype(np.int16), kind="stable")
        cuts = np.searchsorted(cls[order][: int((there & (cls < SLOTTED)).sum())], np.arange(SLOTTED + 1))
        order = order[: cuts[-1]]
        x, slot = hs[:, order], slot[order]
        own_out, own_dh = np.empty(len(order)), np.empty_like(x)
        for k in range(SLOTTED):
            a, b = int(cuts[k]), int(cuts[k + 1])
            if a == b:
                continue
            own, mine = x[:, a:b], np.arange(b - a)
            logit = self.ww[k] @ own
            logit += self.bw[k]
            logit -= logit.max(0)
            said = logit[slot[a:b], mine]
            e = np.exp(logit, out=logit)
            total = e.sum(0)
            own_out[a:b] = said - np.log(total)
            if grad is not None:
                e *= -1 / total
                e[slot[a:b], mine] += 1
                e[self.missing_words[k]] = 0
                grad.ww[k] += e @ own.T
                grad.bw[k] += e.sum(1, keepdims=True)
                own_dh[:, a:b] = self.ww[k].T @ e
        out[order] += own_out
        if grad is not None:
            dh[:, order] += own_dh
        return out, dh


def lanes(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Deals documents to lanes, longest first to the shortest lane: (lane, first step) of each, and the steps."""
    import heapq

    n = max(1, min(most, len(sizes)))
    heap = [(0, k) for k in range(n)]
    lane, begin = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for d in np.argsort(-sizes, kind="stable").tolist():
        at, k = heapq.heappop(heap)
        lane[d], begin[d] = k, at
        heapq.heappush(heap, (at + int(sizes[d]), k))
    return lane, begin, max(at for at, _ in heap)


@dataclass
class Lanes:
    """Documents one after the other in lanes; tokens of a lane lie together."""

    target: np.ndarray
    given: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    start: np.ndarray  # of each lane
    size: np.ndarray

    def window(self, a: int, b: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Target (-1: none), input, document and beginnings at steps a..b-1 of some lanes."""
        step = np.arange(a, b)[:, None]
        there = step < self.size[live][None, :]
        at = np.where(there, self.start[live][None, :] + step, 0)
        return np.where(there, self.target[at], -1), np.where(there, self.given[at], START), self.doc[at], self.first[at] & there


def deal(symbols: np.ndarray, sizes: np.ndarray, most: int) -> Lanes:
    lane, begin, _ = lanes(sizes, most)
    order = np.lexsort((begin, lane))  # documents as they follow in the lanes
    own = sizes[order]
    ends = np.cumsum(own)
    first_of = np.cumsum(sizes) - sizes
    at = np.repeat(first_of[order] - (ends - own), own) + np.arange(int(ends[-1]) if len(ends) else 0)
    target = symbols[at].astype(np.int32)
    first = np.zeros(len(target), bool)
    first[(ends - own)[own > 0]] = True
    given = np.where(first, START, np.concatenate([[START], target[:-1]])).astype(np.int32)
    size = np.bincount(lane, sizes, int(lane.max()) + 1).astype(np.int64)
    return Lanes(target, given, np.repeat(order, own).astype(np.int32), first, np.cumsum(size) - size, size)


def _stream(symbols: np.ndarray, sizes: np.ndarray, most: int, window: int):
    """Target, input and beginnings of all documents one after the other, cut into lanes of equal length.

    Only training cuts: a lane's state begins empty even where that is within a
    document, so lanes are all busy to the end however long documents are.
    """
    n = len(symbols)
    width = max(1, min(most, n // window))
    steps = -(-n // width)
    begins = np.zeros(n, bool)
    begins[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    given = np.where(begins, START, np.concatenate([[START], symbols[:-1]]))
    deal = lambda x, fill: np.concatenate([x, np.full(steps * width - n, fill, x.dtype)]).reshape(width, steps).T
    target, given, first = deal(symbols.astype(np.int32), -1), deal(given.astype(np.int32), START), deal(begins, True)
    first = first.copy()
    first[0] = True
    return np.ascontiguousarray(target), np.ascontiguousarray(given), first


def score(net: Network, symbols: np.ndarray, sizes: np.ndarray, most: int = 768, window: int = 32) -> np.ndarray:
    """log10 probability of each document's symbols, in all (row 0) and of known words and ends only (row 1); the state goes on from window to window to the document's end."""
    out = np.zeros((2, len(sizes)))
    if not len(symbols):
        return out
    dealt = deal(symbols, sizes, most)
    h = np.zeros((len(dealt.size), HIDDEN), np.float32)
    for a in range(0, int(dealt.size.max()), window):
        b = min(a + window, int(dealt.size.max()))
        live = np.flatnonzero(dealt.size > a)  # a lane that has ended stays ended
        target, given, docs, first = dealt.window(a, b, live)
        hs = np.zeros((b - a, len(live), HIDDEN), np.float32)
        own = h[live]
        for t in range(b - a):
            own[first[t]] = 0
            own = net.step(own, net.x[given[t]])[0]
            hs[t] = own
        h[live] = own
        target, docs = target.ravel(), docs.ravel()
        logp, _ = net.log_likelihood(np.ascontiguousarray(hs.reshape(-1, HIDDEN).T), target)
        out[0] += np.bincount(docs, logp, len(sizes))
        out[1] += np.bincount(docs, np.where(target == UNKNOWN, 0.0, logp), len(sizes))
    return out / LN10


class Trainer:
    """Adam over windows of truncated back-propagation."""

    def __init__(self, net: Network, rate: float = 0.004):
        self.net, self.rate, self.m, self.v, self.t = net, rate, np.zeros_like(net.flat), np.zeros_like(net.flat), 0

    def train(self, symbols: np.ndarray, sizes: np.ndarray, most: int = 256, window: int = 32, updates: int | None = None) -> int:
        """Tokens trained on."""
        if not len(symbols):
            return 0
        net, done = self.net, 0
        target, given, first = _stream(symbols, sizes, most, window)
        width = target.shape[1]
        h = np.zeros((width, HIDDEN), np.float32)
        grad = Network(np.zeros_like(net.flat), net.missing_classes, net.missing_words)
        for a in range(0, len(target), window):
            if updates is not None and self.t >= updates:
                break
            steps = min(window, len(target) - a)
            prev, z, r, n, g, hs = np.empty((6, steps, width, HIDDEN), np.float32)
            inputs = net.x[given[a : a + steps]]
            for t in range(steps):
                prev[t] = h
                prev[t][first[a + t]] = 0
                h, z[t], r[t], n[t], g[t] = net.step(prev[t], inputs[t])
                hs[t] = h
            goal = target[a : a + steps].ravel()
            tokens = int((goal >= 0).sum())
            grad.flat[:] = 0
            _, dh = net.log_likelihood(np.ascontiguousarray(hs.reshape(-1, HIDDEN).T), goal, grad)
            dh = np.ascontiguousarray(dh.T).reshape(steps, width, HIDDEN)
            # what doesn't depend on the flow back is made for all steps at once
            by_n, by_z, by_r = (1 - z) * (1 - n * n), (prev - n) * z * (1 - z), g * r * (1 - r)
            flow, inner = np.empty((2, steps, width, 3 * HIDDEN), np.float32)
            carry, back = np.zeros_like(h), np.ascontiguousarray(net.u.T)
            for t in range(steps - 1, -1, -1):
                d = dh[t] + carry
                dn = d * by_n[t]
                own = flow[t]
                np.multiply(d, by_z[t], out=own[:, :HIDDEN])
                np.multiply(dn, by_r[t], out=own[:, HIDDEN : 2 * HIDDEN])
                own[:, 2 * HIDDEN :] = dn
                inner[t] = own
                inner[t][:, 2 * HIDDEN :] *= r[t]
                carry = inner[t] @ back
                d *= z[t]
                carry += d
                carry[first[a + t]] = 0
            grad.u += prev.reshape(-1, HIDDEN).T @ inner.reshape(-1, 3 * HIDDEN)
            rows, flow = given[a : a + steps].ravel(), flow.reshape(-1, 3 * HIDDEN)
            order = np.argsort(rows.astype(np.int16), kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], np.diff(rows[order]) > 0]))
            grad.x[rows[order[cut]]] += np.add.reduceat(flow[order], cut)
            self._update(grad.flat / max(1, tokens))
            done += tokens
        return done

    def _update(self, g: np.ndarray) -> None:
        g *= min(1.0, 1.0 / (float(np.sqrt((g * g).sum())) + 1e-9))
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        self.net.flat += self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-6)


TAUGHT = ("n_tokens", "chosen", "lower", "s0", "s1")


def _taught(r) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and sizes of a block's chosen documents; where a word without the occurrence at hand has another symbol, it is that of the next lower magnitude."""
    symbol, sizes, chosen = unplane([r.s0, r.s1]), np.asarray(r.n_tokens, np.int64), np.asarray(r.chosen, bool)
    lower = np.unpackbits(np.frombuffer(r.lower, np.uint8), count=len(symbol)).astype(bool)
    less = np.where(symbol - FORMS < HEAD, UNKNOWN, symbol - FORMS)
    return np.where(lower, less, symbol)[np.repeat(chosen, sizes)], sizes[chosen]


def _train_part(start: np.ndarray, missing: tuple[np.ndarray, np.ndarray], rate: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trainer, tokens = None, 0
        for frame in frames:
            for r in frame.itertuples(index=False):
                trainer = trainer or Trainer(Network(start.copy(), *missing), rate)
                tokens += trainer.train(*_taught(r))
                trim()
        if tokens:
            yield pd.DataFrame([{"tokens": tokens, "weights": (trainer.net.flat.astype(np.float64) * tokens).tobytes()}])

    return run


def _add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tokens, total = 0, None
    for frame in frames:
        for r in frame.itertuples(index=False):
            w = np.frombuffer(r.weights, np.float64)
            tokens, total = tokens + r.tokens, w.copy() if total is None else total + w
    if tokens:
        yield pd.DataFrame([{"tokens": tokens, "weights": total.tobytes()}])


def fit(coded: DataFrame, v: Vocabulary, s: Scratch) -> Network:
    """Warm start on WARM_BLOCKS blocks, then one pass in every partition and the average."""
    net = Network.fresh(v)
    trainer = Trainer(net)
    first = [r.block for r in coded.select("block").orderBy(F.xxhash64("block"), "block").limit(WARM_BLOCKS).collect()]
    warm = coded.where(F.col("block").isin(first)).select("block", *TAUGHT).orderBy("block").collect()
    for _ in range(6):  # small corpora are gone through again
        for r in warm:
            trainer.train(*_taught(r), updates=WARM_UPDATES)
        if trainer.t >= WARM_UPDATES:
            break
    kind = "tokens long, weights binary"
    parts = coded.select(*TAUGHT).mapInPandas(_train_part(net.flat, (net.missing_classes, net.missing_words), trainer.rate / 3), kind)
    parts = s.save(parts, "weights")
    n = parts.count()
    if n > 64:  # sums of sums
        parts = parts.repartition(int(n**0.5)).mapInPandas(_add, kind)
    total = parts.coalesce(1).mapInPandas(_add, kind).collect()
    if total:
        net = Network((np.frombuffer(total[0].weights, np.float64) / total[0].tokens).astype(np.float32), net.missing_classes, net.missing_words)
    return net


def _score(flat: np.ndarray, missing: tuple[np.ndarray, np.ndarray], tokens: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Network(flat, *missing)
        for frame in frames:
            for r in frame.itertuples(index=False):
                sizes = np.asarray(r.n_tokens, np.int64)
                total, known = score(net, unplane([r.s0, r.s1]), sizes) + np.asarray(r.inside)
                out = {"doc_id": r.docs, "held_out": r.held, "n_tokens": sizes, "n_known": r.n_known, "train_tokens": tokens, "base_score": r.base, "score": total, "known_score": known}
                yield pd.DataFrame(out).astype({"doc_id": "Int64"})
                trim()

    return run


def log_likelihood(docs: DataFrame, modulus: int = 7, remainder: int = 2, share: int = SHARE, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, known_score of every row.

    known_score is the part of score that known words and ends have; the rest is that of unseen words.

    Rows whose crc32(doc_id) mod modulus is ``remainder`` are held out of all
    counts and of training.
    """
    s = Scratch(docs.sparkSession, "lm")
    blocks = s.save(documents(docs).mapInPandas(by_batch(_code(modulus, remainder), block), BLOCKS), "blocks")
    kind = "block long, k int, w long, c long, form smallint"
    words = blocks.select("block", "words", "counts", "forms").mapInPandas(_dictionary, kind)
    counts = s.save(words.groupBy("w").agg(F.sum("c").alias("c"), F.min("form").alias("form")).where("c > 0"), "counts")
    s.release()
    v = vocabulary(counts)
    head = docs.sparkSession.createDataFrame([(int(w), int(r)) for w, r in zip(v.head, v.rank)], "w long, rank int")
    ranked = counts.select("w", "c").join(F.broadcast(head), "w", "left").select("w", "c", F.coalesce("rank", F.lit(-1)).alias("rank"))
    known = words.select("block", "k", "w").join(ranked, "w").select("block", "k", "c", "rank")
    coded = blocks.drop("words", "counts").groupBy("block").cogroup(known.groupBy("block")).applyInPandas(_symbols(v, share), CODED)
    coded = s.save(coded, "coded")
    s.drop("blocks", "counts")
    s.release()
    net = fit(coded, v, s)
    out = coded.mapInPandas(_score(net.flat, (net.missing_classes, net.missing_words), v.tokens), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, known_score double")
    return s.close(out)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_likelihood(spark.read.parquet(f"{sf_dir}/documents.parquet"))
