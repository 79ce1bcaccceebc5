"""Hashes of words and word shingles for whole batches of texts, in NumPy.

A batch of texts is one byte array. A word is a maximal run of bytes other than
the space and U+0009 to U+000D (these are single bytes in UTF-8 and never part
of another character); A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

SHINGLE_WORDS = 5
BATCH_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15 | 1          # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_PLACES = np.array([pow(0xD6E8FEB86659FD93, 2 * j + 1, 1 << 64) for j in range(64)], dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finalizer of 64-bit hashes (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, BATCH_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            _powers[name] = np.multiply.accumulate(factors)
    return _powers["up"][:n], _powers["down"][:n]


def batches(texts: Sequence[str | None], limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """First index and UTF-8 texts (null: empty) of runs of about `limit` bytes; a longer text is alone."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if held and size + len(raw) > limit:
            yield start, held
            start, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield start, held


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a batch, and for each text the number of words before it (with the total)."""
    data = _FOLD[np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)]
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power_tables(len(data))
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    hashes += (ends - starts).astype(np.uint64) * _PLACES[32]
    lengths = np.array([len(r) + 1 for r in raw])
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    return mix(hashes), bounds


def shingle_sets(texts: Sequence[str | None], words: int = SHINGLE_WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) per text, in order.

    A text with fewer words has its whole sequence as one shingle; one without
    words, an empty or a null text has none.
    """
    for start, raw in batches(texts):
        hashes, bounds = word_hashes(raw)
        n = len(hashes)
        rolled = np.zeros(max(0, n - words + 1), dtype=np.uint64)
        for j in range(words):
            rolled += hashes[j:j + len(rolled)] * _PLACES[j]
        rolled = mix(rolled)
        for i in range(len(raw)):
            first, last = bounds[i], bounds[i + 1]
            if last - first >= words:
                yield start + i, np.unique(rolled[first:last - words + 1])
            elif last > first:
                own = hashes[first:last]
                short = (own * _PLACES[:len(own)]).sum(dtype=np.uint64) + np.uint64(last - first)
                yield start + i, mix(np.array([short], dtype=np.uint64))
            else:
                yield start + i, np.empty(0, dtype=np.uint64)
