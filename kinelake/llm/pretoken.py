"""Text to words as the word-BPE tokenizer file lays down: NFC, white space, lower case, then one pattern.

The two special strings are found in the raw text first and stay whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache, lru_cache

import numpy as np
import pandas as pd

from .textvec import point_hashes

# The tokenizer file's pattern and special strings.
SPECIAL = {"<|startoftext|>": 49406, "<|endoftext|>": 49407}
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_PATTERN = rf"{_CONTRACTIONS}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+"

# Below U+0250 the same classes are short lists of ranges, which the standard library matches several times faster.
_WHITE = "\t-\r \x85\xa0"
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(rf"[{_LETTER}]+|{_CONTRACTIONS}|[{_NUMBER}]|[^{_WHITE}{_LETTER}{_NUMBER}]+")
_BEYOND = re.compile("[^\x00-\u024f]")
_SPLIT = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")
#: White space in every Unicode version; nothing composes, folds or matches across it.
_GAP = re.compile("[\t-\r ]+")
_MEMO_CHUNKS, _MEMO_LETTERS = 250_000, 40


@cache
def _library():
    """(normaliser, splitter) of the tokenizers library: which code points are letters, numbers or white space, and what
    composes or folds to what, is a matter of its Unicode version, which is not Python's."""
    from tokenizers import Regex
    from tokenizers import normalizers as N
    from tokenizers.pre_tokenizers import Split

    return N.Sequence([N.NFC(), N.Replace(Regex(r"\s+"), " "), N.Lowercase()]), Split(Regex(_PATTERN), "removed", invert=True)


def _chunk_words(chunk: str) -> tuple[str, ...]:
    normaliser, splitter = _library()
    return tuple(w for w, _ in splitter.pre_tokenize_str(normaliser.normalize_str(chunk)))


_known_words = lru_cache(_MEMO_CHUNKS)(_chunk_words)


def _plain(text: str) -> list[str]:
    if text.isascii() or not _BEYOND.search(text):
        low = text.lower()
        if low.isascii() or not _BEYOND.search(low):
            return _LATIN.findall(low)
    out: list[str] = []
    for chunk in _GAP.split(text):
        if chunk:
            out += (_known_words if len(chunk) <= _MEMO_LETTERS else _chunk_words)(chunk)
    return out


def words(text: str) -> list[str]:
    if "<|" not in text:
        return _plain(text)
    out: list[str] = []
    for part in _SPLIT.split(text):
        if part in SPECIAL:
            out.append(part)
        elif part:
            out += _plain(part)
    return out


# Whole batches at once: the same pattern as numpy operations on code points. Texts with
# others than these, or with a special string, take ``words``.
_WHITE_CLASS, _LETTER_CLASS, _NUMBER_CLASS, _OTHER_CLASS, _SLOW_CLASS = range(5)
_LATIN_END = 0x250


@cache
def _latin_tables() -> tuple[np.ndarray, np.ndarray]:
    """(class, lower case) of each code point below U+0250, and of all others at its place."""
    kind = np.full(_LATIN_END + 1, _OTHER_CLASS, np.uint8)
    low = np.arange(_LATIN_END + 1, dtype=np.uint32)
    for i in range(_LATIN_END):
        c = chr(i)
        kind[i] = {"L": _LETTER_CLASS, "N": _NUMBER_CLASS}.get(unicodedata.category(c)[0], _OTHER_CLASS)
        if c.isspace() and not 0x1C <= i <= 0x1F:
            kind[i] = _WHITE_CLASS
        if len(c.lower()) == 1 and ord(c.lower()) < _LATIN_END:
            low[i] = ord(c.lower())
        else:
            kind[i] = _SLOW_CLASS
    kind[_LATIN_END] = _SLOW_CLASS
    return kind, low


def _join_contractions(points: np.ndarray, kind: np.ndarray, start: np.ndarray, edge: np.ndarray) -> None:
    """A lone apostrophe takes s, t, m, d, re, ve or ll with it, and the letters after those begin a word."""
    at = np.flatnonzero(start & (points == 39))
    at = at[at + 1 < len(points)]
    at = at[(kind[at + 1] == _LETTER_CLASS) & ~edge[at + 1]]
    if not len(at):
        return
    one = points[at + 1]
    two = np.where(at + 2 < len(points), at + 2, at)
    follows = (two > at) & (kind[two] == _LETTER_CLASS) & ~edge[two]
    pair = np.where(follows, one.astype(np.uint64) << np.uint64(32) | points[two], np.uint64(0))
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
    start[at[single | double] + 1] = False
    for hit, n in ((at[single], 2), (at[double & ~single], 3)):
        after = hit[hit + n < len(points)] + n
        start[after[kind[after] == _LETTER_CLASS]] = True


def batch_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(points, starts, ends, hashes, first, last): the words of a batch as spans of one array of lower-case
    code points, a 64-bit hash each, and each text's first and last word."""
    table, low = _latin_tables()
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    kind = table[np.minimum(points, _LATIN_END)]
    points = low[np.minimum(points, _LATIN_END)]
    odd = np.flatnonzero(kind == _SLOW_CLASS)
    slow = set(np.unique(np.searchsorted(offs, odd, "right") - 1).tolist())
    if "<|" in joined:
        slow |= {i for i, t in enumerate(texts) if "<|" in t}
    for i in slow:
        kind[offs[i] : offs[i + 1]] = _WHITE_CLASS
    n = len(points)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start = (start | edge[:-1] | (kind == _NUMBER_CLASS)) & (kind != _WHITE_CLASS)
    _join_contractions(points, kind, start, edge)
    stop = np.ones(n, bool)
    stop[:-1] = start[1:] | (kind[1:] == _WHITE_CLASS)
    starts, ends = np.flatnonzero(start), np.flatnonzero((stop | edge[1:]) & (kind != _WHITE_CLASS)) + 1
    cut = np.searchsorted(starts, offs)
    first, last = cut[:-1].copy(), cut[1:].copy()
    more, spans, base, count = [], [], n, len(starts)
    for i in sorted(slow):
        own = words(texts[i])
        more.append(np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32))
        sizes = np.array([len(w) for w in own], np.int64)
        spans.append((base + np.cumsum(sizes) - sizes, base + np.cumsum(sizes)))
        base += int(sizes.sum())
        first[i], last[i] = count, count + len(own)
        count += len(own)
    if more:
        points = np.concatenate([points, *more])
        starts, ends = (np.concatenate([a, *[s[k] for s in spans]]) for k, a in enumerate((starts, ends)))
    return points, starts, ends, point_hashes(points, starts, ends), first, last


def word_at(points: np.ndarray, start: int, end: int) -> str:
    return points[start:end].tobytes().decode("utf-32-le", "surrogatepass")


def spelled(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The spans as strings; none holds a space."""
    if not len(starts):
        return []
    size = ends - starts
    upto = np.cumsum(size + 1)
    spaced = np.full(int(upto[-1]), 32, np.uint32)
    own = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    spaced[own + np.repeat(upto - size - 1, size)] = points[own + np.repeat(starts, size)]
    return spaced[:-1].tobytes().decode("utf-32-le", "surrogatepass").split(" ")


_LETTERS_AT_ONCE = 1 << 20


def same_letters(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span spells what the span at ``other`` spells."""
    size = ends - starts
    if not np.array_equal(size, size[other]):
        return False
    far = np.flatnonzero(starts != starts[other])
    low, shift, size = starts[far], (starts[other] - starts)[far], size[far]
    upto = np.cumsum(size)
    i = 0
    while i < len(far):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + _LETTERS_AT_ONCE, "right")))
        n = size[i:j]
        at = np.arange(int(n.sum())) + np.repeat(low[i:j] - np.cumsum(n) + n, n)
        if not np.array_equal(points[at], points[at + np.repeat(shift[i:j], n)]):
            return False
        i = j
    return True


def distinct_words(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(of, words, first, last): the distinct words of a batch, for each word of it, in text order, which of
    them it is, and each text's first and last.

    Hashes bring alike words together; every word is then held against its like letter by letter, and a batch
    in which two words share a hash is told apart by the words themselves.
    """
    points, starts, ends, hashes, first, last = batch_words(texts)
    of, distinct = pd.factorize(hashes)
    example = np.empty(len(distinct), np.int64)
    example[of[::-1]] = np.arange(len(of))[::-1]
    if same_letters(points, starts, ends, example[of]):
        return of, spelled(points, starts[example], ends[example]), first, last
    of, found = pd.factorize(np.array(spelled(points, starts, ends), object))
    return of, found.tolist(), first, last
