"""Vectorised word and shingle hashes over Arrow text buffers.

Words are maximal runs of bytes other than space and tab to carriage return
(``[^\\x20\\x09-\\x0D]+``), A-Z lower-cased. A word's hash is a polynomial over
its bytes modulo 2**64, taken as a difference of prefix sums times an inverse
power, so that no Python loop runs over words but the rare very long ones.
"""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_VALUE = (_LOWER.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
_SEGMENT = 1 << 18
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; a document's edge ends a word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends


#: Words of more bytes have a cryptographic hash: among long words a polynomial hash has collisions that can be built.
LONG_WORD = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash a word of lower-cased bytes."""
    out = _span_hashes(lambda low, high: _VALUE[data[low:high]], starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        raw = _LOWER[data[starts[i] : ends[i]]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
    return out


def text_digests(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Of each document two 64-bit numbers: a cryptographic digest of its lower-cased words, set apart by one space."""
    starts, ends = word_spans(data, offs)
    first = np.searchsorted(starts, offs)
    word = ~_SPACE[data]
    kept = word.copy()
    kept[1:] |= word[:-1]
    text = np.where(word, _LOWER[data], np.uint8(0x20))[kept]
    place = np.concatenate([[0], np.cumsum(kept)])
    out = np.zeros((len(offs) - 1, 2), np.int64)
    for i, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist(), strict=False)):
        if b > a:
            out[i] = np.frombuffer(hashlib.blake2b(text[place[starts[a]] : place[ends[b - 1]]], digest_size=16).digest(), np.int64)
    return out


def point_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash a span of code points."""
    return _span_hashes(lambda low, high: (points[low:high].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), starts, ends)


def _span_hashes(values, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ascending spans, in segments of a quarter of a megabyte or one word."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + _SEGMENT, "right")))
        high = int(ends[j - 1])
        up, down = _power_tables(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values(low, high) * up[: high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def doc_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each document and the total), in text order."""
    starts, ends = word_spans(data, offs)
    return word_hashes(data, starts, ends), np.searchsorted(starts, offs)


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k successive words; runs over document edges are for the caller to leave out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(k))
    for j in range(k):
        h = h * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : j + n]
    return mix(h)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5):
    """For each document the sorted distinct hashes of its k-word shingles.

    A text of fewer words has its whole sequence as the only one, a text
    without words has none.
    """
    words, first = doc_words(data, offs)
    all_runs = runs(words, k)
    for i in range(len(offs) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            yield np.unique(all_runs[a : b - k + 1])
        elif b > a:
            yield runs(words[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)
