"""Words of a batch of texts as numpy arrays, hashed without a Python loop per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8
text, i.e. ``[^\\x20\\x09-\\x0D]+``.  A word's hash is a polynomial in a random
64-bit value per byte; differences of one running sum give every word's
polynomial, and a bijective mixer spreads the result.  The hash depends only on
the word (and on ``lower``), so every executor computes the same value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
_CHUNK = 1 << 20  # bytes of text hashed at a time


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POW: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POW or len(_POW["up"]) < n:
        size = max(n, _CHUNK + (1 << 12))
        _POW["up"] = _powers(_BASE, size)
        _POW["down"] = _powers(pow(_BASE, -1, 1 << 64), size)
    return _POW["up"], _POW["down"]


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~_SPACE[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of buf[start:end] for sorted spans that do not overlap."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        # as many words as fit a chunk; one longer than a chunk is a chunk of its own
        j = max(i + 1, int(np.searchsorted(end, start[i] + _CHUNK, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        up, down = _tables(hi - lo + 1)
        run = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((_LOWER if lower else _TABLE)[buf[lo:hi]] * up[: hi - lo], out=run[1:])
        a, b = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (run[b] - run[a]) * down[a] + (b - a).astype(np.uint64)
        i = j
    return mix(out)


def word_spans(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first): words first[d]:first[d + 1] belong to texts[d].

    A null text has no words, as an empty one.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(raw), np.uint8)
    ends_at = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    start, end = spans(buf)
    return buf, start, end, np.concatenate([[0], np.searchsorted(start, ends_at, "left")]).astype(np.int64)


def words(texts: list[str | None], lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, hashes, first) of the words of the texts."""
    buf, start, end, first = word_spans(texts)
    return buf, start, end, hash_spans(buf, start, end, lower), first


def batches(texts, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters; a longer text stands alone."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def chain(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width`` consecutive values of h (fewer values: none)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out + h[k : k + n] * np.uint64(2 * k + 3))
    return out
