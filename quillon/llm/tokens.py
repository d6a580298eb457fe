"""Token ids of whole texts by a public vocabulary that splits at white space.

``word_bpe`` vocabularies lower-case, drop white space and never merge across
it, nor between a letter or digit and the marks behind it, so a text's ids are
those of its pieces one after the other.  A piece is a word, or a word's ASCII
letters and the run of marks at its end.  Each distinct piece of a batch is
encoded once; a bounded memory of earlier pieces saves most of that.  Pieces that
differ in the case of A-Z are one, but for those with ``<|``: the library looks
for its special units before it lower-cases.
``direct`` encodes texts as they are, for vocabularies that don't split so.

Defined results: null and empty texts have no ids of their own; ids depend on the
text alone, not on the texts that were encoded before.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd

from . import wordhash as wh

#: Pieces remembered by a Python worker; beyond that the memory starts anew.
REMEMBERED = 600_000
#: Pieces encoded at a time: what the library returns for a piece takes a kilobyte or two.
AT_ONCE = 2048
#: Marks that may be cut off a word's end: an apostrophe or an angle bracket could belong to a longer unit.
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<>|"]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[b for b in range(128) if chr(b).isalnum()]] = True
_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(buf: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of pieces; first piece of each text."""
    cut = end.copy()
    for _ in range(4):
        cut -= (cut - 1 > start) & _MARK[buf[cut - 1]]
    cut = np.where((cut < end) & _PLAIN[buf[cut - 1]], cut, end)
    two = cut < end
    at = np.arange(len(start)) + np.concatenate([[0], np.cumsum(two)])[:-1].astype(np.int64) if len(start) else np.zeros(0, np.int64)
    n = len(start) + int(two.sum())
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    a[at], b[at] = start, cut
    a[at[two] + 1], b[at[two] + 1] = cut[two], end[two]
    return a, b, np.concatenate([at, [n]])[first]


class Encoder:
    def __init__(self, path: str, by_word: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        sizes, flats = [], []
        for a in range(0, len(texts), AT_ONCE):
            new = [e.ids for e in self.tokenizer.encode_batch_fast(texts[a : a + AT_ONCE], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, new), np.int64, len(new)))
            flats.append(np.fromiter((i for ids in new for i in ids), np.uint32, int(sizes[-1].sum())))
        size, flat = np.concatenate(sizes), np.concatenate(flats)
        begin = len(self.ids) + np.cumsum(size) - size
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.ids = known[order], np.concatenate([self.ids, flat])
        self.begin, self.size = np.concatenate([self.begin, begin])[order], np.concatenate([self.size, size])[order]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (uint32) of every text; none for null."""
        if not self.by_word:
            return self.direct([t or "" for t in texts])
        buf, start, end, first = wh.word_spans(texts)
        start, end, first = pieces(buf, start, end, first)
        h = wh.hash_spans(buf, start, end, True)
        marks = np.flatnonzero((buf[:-1] == ord("<")) & (buf[1:] == ord("|")))
        if len(marks):
            special = np.unique(np.searchsorted(start, marks, "right") - 1)
            h[special] = wh.mix(wh.hash_spans(buf, start[special], end[special], False) + np.uint64(1))
        distinct, at, where = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED:
            self._forget()
        new = ~np.isin(distinct, self.known, assume_unique=True)
        if new.any():
            raw = buf.tobytes()
            words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist())]
            self._learn(distinct[new], words)
        place = np.searchsorted(self.known, distinct)
        begin, size = self.begin[place][where], self.size[place][where]
        # all ids of the batch: for each word, size consecutive ids from begin
        upto = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
        cuts = upto[first]
        return [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def encoder(path: str, by_word: bool = True) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if (path, by_word) not in _ENCODERS:
        _ENCODERS[path, by_word] = Encoder(path, by_word)
    return _ENCODERS[path, by_word]


def encode_frame(frame: pd.DataFrame, path: str, end_id: int | None, by_word: bool = True) -> list[np.ndarray]:
    """Ids of the frame's texts, each followed by end_id if one is given."""
    out = encoder(path, by_word).encode(frame["text"].tolist())
    if end_id is None:
        return out
    tail = np.array([end_id], np.uint32)
    return [np.concatenate([ids, tail]) for ids in out]
