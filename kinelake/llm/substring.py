"""Substring dedup by collinear chaining.

1. Every text becomes its sequence of word hashes; equal sequences are one node,
   so copies take part once. Winnowing picks seed places: the least 4-word hash of
   each 12 successive ones. A place gives a key with each of the next two seed
   places (the pair survives edits around and between them), and of each 7 successive
   places one has a key of 22 words, which ties exact passages to texts that share as much.
2. Keys join through a star: each place of a key meets the key's first place
   (its hub), and a further place in the hub's text the key's last text; as many
   matches as places, however many texts share a passage. Keys of two seeds are
   said by the passage's own texts almost alone, so unrelated texts that share
   one phrase with it do not become its hubs.
3. A text's matches with one hub are merged along diagonals into fragments and
   chained: ordered in both texts, each gap costed by its words, the best
   predecessor found in a Fenwick tree of prefix maxima.
4. Chains are aligned word by word (the diagonals compared, the gaps by longest
   common subsequence, the ends extended while they score, over small shifts too)
   on the 64-word blocks around them; only those blocks are moved.

An exact passage of 28 words holds a 22-word key, in both texts at the same place. A key's
texts are compared with its hub, not with each other, so a passage is certain to be found
where no other text shares 22 words of it, or where the hub shares all of it. Where many
texts say one phrase of 22 words or more, and two of them a few words more around
it, those two meet only through a key that goes beyond the phrase: tests
measure how often they do. Fuzzy passages need two seeds in order, unharmed and with at
most one other between them: tests measure the share found at 10 and 15 % of changed words. Keys are 64-bit hashes;
matches by chance are thrown out in the alignment. Equal texts are told by a
128-bit cryptographic digest of their words.

No step gathers more than one text's own places: no pair of texts is formed but
by a shared key, and a passage that thousands share costs each of them one star.

Defined cases: null, empty and shorter texts than a passage give no rows; a very
long text is read whole, its seeds gathered as one text's; a null doc_id is
carried and is never a representative where another exists; repeated rows are
copies: of equal texts one row stays, by doc_id and then in no set order; a run of
one word or line is a passage like any other (its seeds are thinned to one a
window); a passage said twice in one text counts only with ``within``; the hub of
a key is the text with the least number, which hashes give; an empty table gives
an empty result; other columns are ignored, and kept by ``cut_repeats``.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bloom_filter, filter_bits, free_name, in_filter, materialise, small_batches, table, utf8
from .textvec import doc_words, mix, runs, text_digests, word_spans

#: Words of a seed, and seeds of which one is kept.
SEED, WINDOW = 4, 12
#: A seed makes a key with so many of those that follow it.
PARTNERS = 2
#: Words of a long key, and successive places of which one makes a key: any 28 words hold one whole.
LONG, LONG_EACH = 22, 7
#: A long key said again within so many words of its last place counts once; fragments with no more between them are one.
LONG_WINDOW = 20
#: A key's place and the distance to its second seed in one number; 0 is a long key.
DISTANCE_BITS = 12
MIN_WORDS = 28
IDENTITY = 0.8
GAP_COST = 0.25
MAX_GAP = 40
DROP = 6
SHIFT, REANCHOR = 4, 6
#: Words to leave out of x and of y, fewest first.
SHIFTS = sorted(((dx, dy) for dx in range(SHIFT + 1) for dy in range(SHIFT + 1) if dx + dy), key=lambda d: (d[0] + d[1], d))
BLOCK = 64
#: Numbers shared by unequal texts that may reach the driver.
MOST_DOUBLES = 1_000_000
SEEN_TEXTS = 200_000


def text_ids(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit number of each text's word sequence; 0 for a text without words."""
    size = np.diff(first)
    place = (np.arange(len(words)) - np.repeat(first[:-1], size)).astype(np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(words + place * np.uint64(0x9E3779B97F4A7C15)))])
    out = mix(sums[first[1:]] - sums[first[:-1]] + size.astype(np.uint64))
    out[size == 0] = 0
    return out.view(np.int64)


def thinned(at: np.ndarray, h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of the places ``at`` (ascending) stay: a hash said again within ``window`` words of its last place that stays counts once."""
    keep = np.ones(len(at), bool)
    order = np.argsort(h, kind="stable")
    close = (np.diff(h[order]) == 0) & (np.diff(at[order]) < window)
    last, at_before = 0, -1
    for i in (np.flatnonzero(close) + 1).tolist():
        if i - 1 != at_before:
            last = at[order[i - 1]]
        if at[order[i]] - last < window:
            keep[order[i]] = False
        else:
            last = at[order[i]]
        at_before = i
    return keep


def _slid(values: np.ndarray, window: int, pick) -> np.ndarray:
    """The least or greatest (``pick``) of each ``window`` successive values, by doubling."""
    n, out = 1, values
    while 2 * n <= window:
        out, n = pick(out[:-n], out[n:]), 2 * n
    return pick(out[: len(out) - window + n], out[window - n :]) if n < window else out


def seed_places(words: np.ndarray, first: np.ndarray, size: int = SEED, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in it, hash of ``size`` words) of the least hash of every window of every text, all at once.

    A text with fewer hashes than a window is one window; equal least hashes all count.
    """
    count = np.maximum(np.diff(first) - size + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    begin = np.cumsum(count) - count
    place = np.arange(len(text)) - begin[text]
    h = np.maximum(runs(words, size)[first[:-1][text] + place], np.uint64(1)) if len(text) else np.zeros(0, np.uint64)
    chosen = np.zeros(len(h), bool)
    if len(h) >= window:
        low = _slid(h, window, np.minimum)
        low[place[: len(low)] + window > count[text[: len(low)]]] = 0  # it would go on into the next text
        none = np.zeros(window - 1, np.uint64)
        chosen = _slid(np.concatenate([none, low, none]), window, np.maximum) == h
    few = np.flatnonzero((count > 0) & (count < window))
    if len(few):
        inside = np.flatnonzero(np.isin(text, few))
        least = np.minimum.reduceat(h[inside], np.searchsorted(text[inside], few))
        chosen[inside] = h[inside] == np.repeat(least, count[few])
    return text[chosen], place[chosen], h[chosen]


def _of_text(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes that tell texts of a batch apart."""
    return h + mix(text.astype(np.uint64) + np.uint64(1))


def paired_places(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, distance to the second seed, key) of the pairs of seeds; a seed, and then a pair, said again in a run stays once a window."""
    text, at, h = seed_places(words, first)
    keep = thinned(at + first[text], _of_text(text, h))
    text, at, h = text[keep], at[keep], h[keep]
    found = []
    for n in range(1, PARTNERS + 1):
        both = text[:-n] == text[n:]
        key = mix(h[:-n] * np.uint64(0x9E3779B97F4A7C15) + h[n:])
        found.append(np.stack([text[:-n], at[:-n], at[n:] - at[:-n], key.view(np.int64)])[:, both])
    text, place, distance, key = np.concatenate(found, axis=1)
    order = np.lexsort((place, text))
    text, place, distance, key = text[order], place[order], distance[order], key[order].view(np.uint64)
    keep = thinned(place + first[text], _of_text(text, key)) & (distance < 1 << DISTANCE_BITS)
    return text[keep], place[keep], distance[keep], key[keep]


def long_places(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, key) of the long keys: no key of a text is lost, and one a window or so stays in a run."""
    text, at, _ = seed_places(words, first, 6, LONG_EACH)
    whole = at + LONG <= np.diff(first)[text]
    text, at = text[whole], at[whole]
    key = mix(runs(words, LONG)[first[text] + at] + np.uint64(LONG)) if len(at) else np.zeros(0, np.uint64)
    keep = thinned(at + first[text], _of_text(text, key), LONG_WINDOW)
    return text[keep], at[keep], key[keep]


def keyed_places(words: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Of one text: (places, distances, keys) of its pairs of seeds and (places, keys) of its long keys."""
    first = np.array([0, len(words)])
    return paired_places(words, first)[1:], long_places(words, first)[1:]


def _texts(batch: pa.RecordBatch, column: int, doubles: frozenset = frozenset()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each text, words, each text's first word and the total).

    ``doubles`` are numbers that unequal texts share; those have a half of their digest instead.
    """
    data, offs = utf8(batch.column(column))
    words, first = doc_words(data, offs)
    sids = text_ids(words, first)
    for i in np.flatnonzero(np.isin(sids, list(doubles))).tolist() if doubles else ():
        sids[i] = text_digests(data[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]]))[0, 1]
    return sids, words, first


def _fresh(sids: np.ndarray, seen: set) -> np.ndarray:
    """Which texts this task has not met, as far as it remembers."""
    out = np.zeros(len(sids), bool)
    for i, sid in enumerate(sids.tolist()):
        if sid not in seen:
            if len(seen) >= SEEN_TEXTS:
                seen.clear()
            seen.add(sid)
            out[i] = True
    return out


def _members(batches):
    for batch in batches:
        sids, _, first = _texts(batch, 2)
        digests = text_digests(*utf8(batch.column(2)))
        columns = [pa.array(x) for x in (sids, np.diff(first), np.ascontiguousarray(digests[:, 0]), np.ascontiguousarray(digests[:, 1]))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["uid", "doc_id", "sid", "n_words", "digest", "digest2"])


def _seeds(doubles: frozenset, wanted=None):
    """(key, sid, spot) of the distinct texts of a task; ``wanted`` is a filter of keys."""

    def task(batches):
        seen: set = set()
        for batch in batches:
            sids, words, first = _texts(batch, 0, doubles)
            fresh = _fresh(sids, seen)
            text, at, distance, key = paired_places(words, first)
            text2, at2, key2 = long_places(words, first)
            text = np.concatenate([text, text2])
            spot = np.concatenate([at << DISTANCE_BITS | distance, at2 << DISTANCE_BITS])
            key = np.concatenate([key, key2]).view(np.int64)
            keep = fresh[text]
            if wanted is not None:
                keep &= in_filter(wanted.value, key)
            text, spot, key = text[keep], spot[keep], key[keep]
            order = np.argsort(text, kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array(key[order]), pa.array(sids[text[order]]), pa.array(spot[order])], ["key", "sid", "spot"])

    return task


class Fenwick:
    """Prefix maxima: ``put`` a value at a rank, ask for the best at or below a rank."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, rank: int, value: float, who: int) -> None:
        i = rank + 1
        while i < len(self.best):
            if value > self.best[i][0]:
                self.best[i] = (value, who)
            i += i & -i

    def at_most(self, rank: int) -> tuple[float, int]:
        out, i = (float("-inf"), -1), rank + 1
        while i > 0:
            if self.best[i][0] > out[0]:
                out = self.best[i]
            i -= i & -i
        return out


def fragments(x: np.ndarray, y: np.ndarray, span: np.ndarray) -> list[tuple[int, int, int, int, bool]]:
    """(x start, x end, y start, seeds, long) of matches merged along diagonals."""
    diagonal = x - y
    order = np.lexsort((x, diagonal))
    out: list[tuple[int, int, int, int, bool]] = []
    d_now, lo, hi, n, long = None, 0, 0, 0, False
    for d, a, s in zip(diagonal[order].tolist(), x[order].tolist(), span[order].tolist(), strict=True):
        if d == d_now and a <= hi + LONG_WINDOW:
            n += a != last
            hi, long, last = max(hi, a + s), long or s == LONG, a
            continue
        if d_now is not None:
            out.append((lo, hi, lo - d_now, n, long))
        d_now, lo, hi, n, long, last = d, a, a + s, 1, s == LONG, a
    if d_now is not None:
        out.append((lo, hi, lo - d_now, n, long))
    return sorted(out)


def chains(parts: list[tuple[int, int, int, int, bool]]) -> list[list[int]]:
    """Indices of collinear fragments, best chains first; each fragment is in one chain.

    f(i) = length + the best of 0 and f(j) - GAP_COST * (gap in x + gap in y) over
    the fragments that end before i begins in both texts.
    """
    n = len(parts)
    if n == 1:
        return [[0]]
    ends = sorted({p[2] + p[1] - p[0] for p in parts})
    tree = Fenwick(len(ends))
    events = sorted([(p[0], 1, i) for i, p in enumerate(parts)] + [(p[1], 0, i) for i, p in enumerate(parts)])
    f, before = [0.0] * n, [-1] * n
    for _, begins, i in events:
        x0, x1, y0 = parts[i][:3]
        if begins:
            f[i] = float(x1 - x0)
            value, j = tree.at_most(bisect_right(ends, y0) - 1)
            if j >= 0 and (gain := value - GAP_COST * (x0 + y0)) > 0:
                f[i] += gain
                before[i] = j
        else:
            y1 = y0 + x1 - x0
            tree.put(bisect_right(ends, y1) - 1, f[i] + GAP_COST * (x1 + y1), i)
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -f[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def matched_seeds(y: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(other text, place in x, place in y, words) of the seeds that matched keys stand for: a long key is one, a pair two."""
    mask = (1 << DISTANCE_BITS) - 1
    x, dx, at, dy = xs >> DISTANCE_BITS, xs & mask, ys >> DISTANCE_BITS, ys & mask
    two = dx > 0
    span = np.where(two, SEED, LONG)
    return np.concatenate([y, y[two]]), np.concatenate([x, (x + dx)[two]]), np.concatenate([at, (at + dy)[two]]), np.concatenate([span, span[two]])


def _chained(batches):
    """Pieces (fragments of a chain without a gap over MAX_GAP) that are worth an alignment."""
    for batch in batches:
        cols: list[list] = [[] for _ in range(7)]
        for x, matches in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            y, xs, ys, spans = matched_seeds(*(np.array([m[k] for m in matches], np.int64) for k in ("y", "xs", "ys")))
            order = np.argsort(y, kind="stable")
            for pick in np.split(order, np.flatnonzero(np.diff(y[order])) + 1):
                parts = fragments(xs[pick], ys[pick], spans[pick])
                for chain in chains(parts):
                    piece: list[tuple] = []
                    for i in [*chain, None]:
                        p = parts[i] if i is not None else None
                        if piece and (p is None or p[0] - piece[-1][1] > MAX_GAP or p[2] - (piece[-1][2] + piece[-1][1] - piece[-1][0]) > MAX_GAP):
                            if any(q[4] for q in piece) or sum(q[3] for q in piece) > 1:
                                flat = [v for q in piece for v in q[:3]]
                                last = piece[-1]
                                row = (x, int(y[pick[0]]), piece[0][0], last[1], piece[0][2], last[2] + last[1] - last[0], flat)
                                for col, v in zip(cols, row, strict=True):
                                    col.append(v)
                            piece = []
                        if p is not None:
                            piece.append(p)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["x", "y", "x0", "x1", "y0", "y1", "parts"])


def _block_keys(sids: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return sids ^ ((blocks.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _wanted_keys(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_block_keys(np.asarray(batch.column(0)), np.asarray(batch.column(1))))], ["key"])


def _blocks(wanted, doubles: frozenset):
    def task(batches):
        seen: set = set()
        for batch in batches:
            sids, words, first = _texts(batch, 0, doubles)
            count = np.where(_fresh(sids, seen), -(-np.diff(first) // BLOCK), 0)
            text = np.repeat(np.arange(len(count)), count)
            block = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
            hit = in_filter(wanted.value, _block_keys(sids[text], block))
            text, block = text[hit], block[hit]
            low = first[text] + block * BLOCK
            high = np.minimum(low + BLOCK, first[text + 1])
            data = [words[a:b].tobytes() for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(sids[text]), pa.array(block.astype(np.int32)), pa.array(data, pa.binary())], ["sid", "block", "words"])

    return task


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by whole-number bit operations."""
    if not len(a) or not len(b):
        return 0
    where: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b.tolist():
        m = where.get(w, 0)
        v = ((v + (v & m)) | (v & ~m)) & full
    return len(a) - v.bit_count()


def extension(same: np.ndarray) -> tuple[int, int]:
    """(words, matches) of the best end of a run that scores +1 for a match and -1 else, given up at DROP below its best."""
    if not len(same):
        return 0, 0
    score = np.cumsum(np.where(same, 1, -1))
    stop = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > DROP)
    score = score[: stop[0]] if len(stop) else score
    if not len(score) or score.max() <= 0:
        return 0, 0
    n = len(score) - int(score[::-1].argmax())
    return n, int(same[:n].sum())


def stretch(xw: np.ndarray, yw: np.ndarray) -> tuple[int, int, int]:
    """(words of x, words of y, matches) by which a passage goes on at the beginning of both arrays.

    Where one diagonal ends, up to SHIFT words may be left out of either side if REANCHOR equal words follow.
    """
    i = j = hits = 0
    while True:
        far = min(len(xw) - i, len(yw) - j)
        n, m = extension(xw[i : i + far] == yw[j : j + far])
        i, j, hits = i + n, j + n, hits + m
        for dx, dy in SHIFTS:
            a, b = xw[i + dx : i + dx + REANCHOR], yw[j + dy : j + dy + REANCHOR]
            if len(a) == len(b) == REANCHOR and (a == b).all():
                i, j = i + dx, j + dy
                break
        else:
            return i, j, hits


def align(xw: np.ndarray, yw: np.ndarray, parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, float]]:
    """(x start, x end, y start, y end, identity) of the passages along one piece; parts: (x start, x end, y start) inside both word arrays."""
    out: list[tuple[int, int, int, int, float]] = []

    def close(x0: int, x1: int, y0: int, y1: int, hits: int) -> None:
        n, m, more = stretch(xw[:x0][::-1], yw[:y0][::-1])
        x0, y0, hits = x0 - n, y0 - m, hits + more
        n, m, more = stretch(xw[x1:], yw[y1:])
        x1, y1, hits = x1 + n, y1 + m, hits + more
        share = hits / max(x1 - x0, y1 - y0, 1)
        if x1 - x0 >= MIN_WORDS and share >= IDENTITY:
            out.append((x0, x1, y0, y1, share))

    now = None
    for a, b, c in parts:
        d = c + b - a
        hits = int((xw[a:b] == yw[c:d]).sum())
        if now is None:
            now = [a, b, c, d, hits]
            continue
        gx, gy = xw[now[1] : a], yw[now[3] : c]
        both = common_words(gx, gy)
        if max(len(gx), len(gy)) > 12 and 2 * both < max(len(gx), len(gy)):
            close(*now)
            now = [a, b, c, d, hits]
        else:
            now = [now[0], b, now[2], d, now[4] + both + hits]
    if now is not None:
        close(*now)
    return out


def _sides(pairs: list[dict], low: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(p["words"], np.uint64) for p in sorted(pairs, key=lambda p: p["block"])]) if pairs else np.zeros(low, np.uint64)


def _aligned(batches):
    names = ["x", "y", "x0", "x1", "y0", "y1", "identity"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
    for batch in batches:
        cols: list[list] = [[] for _ in names]
        for x, y, flat, got in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            sides = [{g["block"]: g for g in got if g["side"] == s} for s in (0, 1)]
            if not sides[0] or not sides[1]:
                continue
            low = [min(s) * BLOCK for s in sides]
            xw, yw = (_sides(list(s.values()), 0) for s in sides)
            parts = [(flat[i] - low[0], flat[i + 1] - low[0], flat[i + 2] - low[1]) for i in range(0, len(flat), 3)]
            for x0, x1, y0, y1, share in align(xw, yw, parts):
                row = (x, y, x0 + low[0], x1 + low[0], y0 + low[1], y1 + low[1], share)
                for col, v in zip(cols, row, strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _passages(docs: DataFrame, doubles: frozenset, within: bool) -> DataFrame:
    """(x, y, x0, x1, y0, y1, identity) between texts; ``docs`` has one column, text."""
    spark = docs.sparkSession
    kinds = "key long, sid long, spot long"
    # Keys of several texts; within: or of one text that says it again.
    ends = docs.mapInArrow(_seeds(doubles), kinds).groupBy("key").agg(F.min("sid").alias("y"), F.max("sid").alias("z"), *([F.count(F.lit(1)).alias("places")] if within else []))
    shared = materialise(ends.where("y < z or places > 1" if within else "y < z").select("key", "y", "z"), "passage-keys")
    wanted = spark.sparkContext.broadcast(bloom_filter(shared.select("key"), filter_bits(shared.count())))
    seeds = materialise(docs.mapInArrow(_seeds(doubles, wanted), kinds).join(shared, "key"), "passage-seeds")

    def first_spot(sid: str, name: str) -> DataFrame:
        return seeds.where(F.col("sid") == F.col(sid)).groupBy("key").agg(F.min("spot").alias(name))

    # One join of written tables, which Spark may split where thousands of texts say a key.
    spots = materialise(first_spot("y", "ys").join(first_spot("z", "zs"), "key"), "passage-hubs")
    placed = seeds.join(spots, "key").where("sid <> y or spot <> ys")
    # Further places of the key in the hub's own text meet the key's last text, so that all of a run in it is covered too.
    own = F.col("sid") == F.col("y")
    x, xs, ys = F.when(own, F.col("z")).otherwise(F.col("sid")), F.when(own, F.col("zs")).otherwise(F.col("spot")), F.when(own, F.col("spot")).otherwise(F.col("ys"))
    across = F.struct(x.alias("x"), xs.alias("xs"), ys.alias("ys"))
    here = F.struct(F.col("y").alias("x"), F.col("spot").alias("xs"), "ys")
    if within:  # a further place in the hub's text meets its first one, too
        met = placed.select("y", F.explode(F.when(own & (F.col("z") == F.col("y")), F.array(here)).when(own, F.array(across, here)).otherwise(F.array(across))).alias("m"))
    else:
        met = placed.select("y", across.alias("m"))
    met = met.select("m.x", F.struct("y", "m.xs", "m.ys").alias("m"))
    per_text = met.groupBy("x").agg(F.collect_set("m").alias("matches"))  # a few a seed place of the text, and a key's further places in one hub
    pieces = per_text.mapInArrow(_chained, "x long, y long, x0 int, x1 int, y0 int, y1 int, parts array<int>")
    pieces = materialise(pieces.withColumn("piece", F.monotonically_increasing_id()), "passage-pieces")

    def around(sid: str, lo: str, hi: str, side: int) -> DataFrame:
        first = F.greatest(F.lit(0), F.floor((F.col(lo) - BLOCK) / BLOCK).cast("int"))
        last = F.floor((F.col(hi) + BLOCK) / BLOCK).cast("int")
        return pieces.select("piece", F.col(sid).alias("sid"), F.explode(F.sequence(first, last)).alias("block"), F.lit(side).alias("side"))

    asked = around("x", "x0", "x1", 0).union(around("y", "y0", "y1", 1))
    at_most = pieces.agg(F.sum((F.col("x1") - F.col("x0") + F.col("y1") - F.col("y0")) / BLOCK + 8)).first()[0]
    keys = asked.select("sid", "block").distinct().mapInArrow(_wanted_keys, "key long")
    wanted = spark.sparkContext.broadcast(bloom_filter(keys, filter_bits(at_most or 0)))
    # Written, so that the join below is one that Spark may split where a hub's block is asked for by many.
    blocks = materialise(docs.mapInArrow(_blocks(wanted, doubles), "sid long, block int, words binary").dropDuplicates(["sid", "block"]), "passage-blocks")
    got = asked.join(blocks, ["sid", "block"]).groupBy("piece").agg(F.collect_list(F.struct("side", "block", "words")).alias("got"))
    rows = pieces.join(got, "piece").select("x", "y", "parts", "got")
    return materialise(rows.mapInArrow(_aligned, "x long, y long, x0 int, x1 int, y0 int, y1 int, identity double"), "passages")


def _analysed(rows: DataFrame, within: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, texts, spans) of ``rows`` (uid, doc_id, text).

    members: a row each, with its text's number. texts: a row a text with the row that stays for it.
    spans: a text's passages, of which ``repeat`` marks those that another text keeps.
    """
    kinds = "uid long, doc_id long, sid long, n_words long, digest long, digest2 long"
    members = materialise(rows.mapInArrow(_members, kinds), "passage-members")

    def grouped(members: DataFrame) -> DataFrame:
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("f")
        unlike = F.max("digest") != F.min("digest")
        out = members.where("n_words > 0").groupBy("sid").agg(first, F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("copies"), unlike.alias("unlike"))
        return materialise(out.select("sid", F.col("f.doc_id").alias("first_id"), F.col("f.uid").alias("first_uid"), "last_id", "copies", "unlike"), "passage-texts")

    texts = grouped(members)
    # Numbers that unequal texts share: none is expected below 10 ** 9 texts, hundreds at 10 ** 11.
    doubles = frozenset(r["sid"] for r in texts.where("unlike").select("sid").limit(MOST_DOUBLES + 1).collect())
    if len(doubles) > MOST_DOUBLES:
        raise ValueError("far too many texts share a number")
    if doubles:
        members = members.withColumn("sid", F.when(F.col("sid").isin(list(doubles)), F.col("digest2")).otherwise(F.col("sid")))
        texts = grouped(members)
    found = _passages(rows.select("text"), doubles, within)
    one_way = found.select(F.col("x").alias("sid"), F.col("y").alias("other"), F.col("x0").alias("lo"), F.col("x1").alias("hi"), "identity", F.lit(True).alias("repeat"))
    back = found.select(F.col("y").alias("sid"), F.col("x").alias("other"), F.col("y0").alias("lo"), F.col("y1").alias("hi"), "identity", F.lit(False).alias("repeat"))
    # A hub of thousands has at most one row a word that a passage begins at.
    best = one_way.union(back).groupBy("sid", "repeat", "lo").agg(F.max(F.struct("hi", "identity", "other")).alias("b"))
    best = best.select("sid", "repeat", "lo", "b.hi", "b.identity", "b.other")
    order = Window.partitionBy("sid", "repeat").orderBy("lo")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("lo") <= reach, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = best.withColumn("island", island).groupBy("sid", "repeat", "island").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(F.struct((F.col("hi") - F.col("lo")).alias("n"), "identity", "other")).alias("b")
    )
    return members, texts, merged.select("sid", "repeat", "lo", "hi", F.col("b.identity").alias("identity"), F.col("b.other").alias("other"))


def _rows(docs: DataFrame, id_col: str, text_col: str, uid) -> DataFrame:
    return docs.select(uid.alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", within: bool = False) -> DataFrame:
    """One row a document and passage: doc_id, start_word, end_word, n_words, other_doc_id, identity, repeat.

    ``repeat`` is false where the document is the passage's hub, whose text stays in ``cut_repeats``.
    Overlapping passages of a document are one row, with the partner of the longest. ``within`` adds
    passages that a text says again itself (the later ones repeat the first).
    """
    small_batches(docs.sparkSession, 1000)
    members, texts, spans = _analysed(_rows(docs, id_col, text_col, F.monotonically_increasing_id()), within)
    names = texts.select("sid", F.col("first_id").alias("doc_id"))
    partner = texts.select(F.col("sid").alias("other"), F.col("first_id").alias("other_doc_id"))
    parts = spans.join(names, "sid").join(partner, "other")
    parts = parts.select("doc_id", F.col("lo").cast("long").alias("start_word"), F.col("hi").cast("long").alias("end_word"), (F.col("hi") - F.col("lo")).cast("long").alias("n_words"), "other_doc_id", "identity", "repeat")
    copied = members.where(F.col("n_words") >= MIN_WORDS).join(texts.where("copies > 1"), "sid")
    stays = F.col("uid") == F.col("first_uid")
    whole = copied.select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n_words").alias("end_word"), "n_words", F.when(stays, F.col("last_id")).otherwise(F.col("first_id")).alias("other_doc_id"), F.lit(1.0).alias("identity"), (~stays).alias("repeat"))
    return whole.union(parts)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", within: bool = False) -> DataFrame:
    """``docs`` with the repeated passages taken out of the text of every row but each passage's hub; of equal texts one row stays."""
    small_batches(docs.sparkSession, 1000)
    uid, sid, gone, found = (free_name(c, docs.columns) for c in ("uid_of", "sid_of", "copy_of", "spans_of"))
    held = materialise(docs.withColumn(uid, F.monotonically_increasing_id()), "passage-rows")
    members, texts, spans = _analysed(_rows(held, id_col, text_col, F.col(uid)), within)
    cuts = spans.where("repeat").groupBy("sid").agg(F.collect_list(F.struct("lo", "hi")).alias(found)).withColumnRenamed("sid", sid)
    copy = (F.col("n_words") >= MIN_WORDS) & (F.col("uid") != F.col("first_uid"))
    whose = members.join(texts, "sid").select(F.col("uid").alias(uid), F.col("sid").alias(sid), copy.alias(gone))
    names = docs.columns
    rows = held.join(whose, uid, "left").join(cuts, sid, "left").select(*[held[c] for c in names], gone, found)
    at = names.index(text_col)

    def task(batches):
        for batch in batches:
            out = []
            for text, copied, spans in zip(*(batch.column(i).to_pylist() for i in (at, len(names), len(names) + 1)), strict=True):
                if not text or not (copied or spans):
                    out.append(text)
                    continue
                raw = text.encode()
                starts, ends = word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                keep = np.ones(len(raw), bool)
                for lo, hi in [(0, len(starts))] if copied else [(s["lo"], s["hi"]) for s in spans]:
                    keep[starts[lo] : ends[hi - 1]] = False
                out.append(np.frombuffer(raw, np.uint8)[keep].tobytes().decode())
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(out, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(task, docs.schema)


NAME = "op3_substring_dedup"
SQL = None  # chaining and alignment have no SQL form; tests compare with brute force and measure recall


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
