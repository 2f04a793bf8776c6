"""Word shingles of whole Arrow batches of text, hashed with numpy.

Words are the runs of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased.
A shingle is a 64-bit hash of ``width`` consecutive words; a text with fewer
words has its whole word sequence as its only shingle, and a text that is null
or has no words has none.  Hashes depend on nothing but the words, so they
agree between tasks, executors and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)


def _odd(n: int) -> np.ndarray:
    return _RNG.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


_PLAIN = _odd(256)
_FOLDED = _PLAIN.copy()
_FOLDED[65:91] = _PLAIN[97:123]  # A-Z hash as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 & ~7 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
PLACE = _odd(64)
_LENGTH = _odd(1)[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its row offsets; null rows are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


#: Bytes whose words are hashed at a time, few enough for a processor's cache.
SPAN = 1 << 16
_UP, _DOWN = _powers(_BASE, 2 * SPAN), _powers(_INVERSE, 2 * SPAN)


def _spans(begin: np.ndarray, size: int = SPAN) -> Iterator[tuple[int, int]]:
    """Runs of words that begin in the same ``size`` bytes, so that long texts take bounded memory."""
    cuts = np.flatnonzero(np.diff(begin // size, prepend=-1)).tolist()
    yield from zip(cuts, [*cuts[1:], len(begin)][: len(cuts)], strict=True)


def word_hashes(raw: np.ndarray, offs: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, with A-Z as a-z if ``fold``, and for each row where its words begin."""
    table = _FOLDED if fold else _PLAIN
    n = len(raw)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offs), dtype=np.int64)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = offs[:-1][offs[:-1] < n]
    first[starts] = inside[starts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_at = offs[1:][offs[1:] > 0] - 1
    last[ends_at] = inside[ends_at]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    words = np.empty(len(begin), dtype=np.uint64)
    for a, b in _spans(begin):
        at, to = begin[a], end[b - 1]
        # Only a word longer than a span needs more powers than are at hand.
        up, down = (_UP[: to - at], _DOWN) if to - at <= len(_UP) else (_powers(_BASE, to - at), _powers(_INVERSE, to - at))
        total = np.zeros(to - at + 1, dtype=np.uint64)
        np.cumsum(table[raw[at:to]] * up, out=total[1:])
        # Bringing each word back to power 0 makes its hash free of its place.
        own = (total[end[a:b] - at] - total[begin[a:b] - at]) * down[begin[a:b] - at]
        words[a:b] = mix(own + (end[a:b] - begin[a:b]).astype(np.uint64) * _LENGTH)
    return words, np.searchsorted(begin, offs)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct shingle hashes."""
    return counted_sets(texts, width)[1]


def counted_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """For each row the number of its words, and its sorted distinct shingle hashes."""
    words, bounds = word_hashes(*text_buffers(texts))
    return np.diff(bounds), _sets(words, bounds, width)


def _sets(words: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    if len(words) >= width:
        runs = words[: len(words) - width + 1] * PLACE[0]
        for k in range(1, width):
            runs = runs + words[k : len(words) - width + 1 + k] * PLACE[k]
        runs = mix(runs)
    else:
        runs = words[:0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = b - a
        if n >= width:
            yield np.unique(runs[a : b - width + 1])
        elif n:
            yield mix((words[a:b] * PLACE[:n]).sum(keepdims=True) + _LENGTH * np.array([n], dtype=np.uint64))
        else:
            yield words[:0]


LANES = 32
_SCALE, _SHIFT = _odd(LANES), _odd(LANES)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """32 symbols of 16 bits: low bits of the least of each of 32 hashes of a non-empty set."""
    least = np.full(LANES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 2048):
        hashes = shingles[at : at + 2048] * _SCALE[:, None]
        hashes += _SHIFT[:, None]
        np.minimum(least, hashes.min(axis=1), out=least)
    return mix(least).astype(np.uint16)
