"""Periodic runs of words in linear time, over any ordered alphabet.

A run is a longest stretch with a period: with the letters' order or with the
opposite one, each run's root occurs in it as a Lyndon word, and the next smaller
suffix of such an occurrence is the occurrence after it. So the Lyndon arrays of
both orders hold every run, and how far the two suffixes agree tells where it ends.

``lyndon_edges`` scans from left to right with the suffixes that still wait for a
smaller one on a stack. A comparison starts where the last one on the same stack
ended. Where the text being read repeats text that has been compared before (the
stretch that reaches furthest to the right is remembered), what was found there is
taken over; only words beyond that stretch are compared, so that no word is matched
twice, and n words cost O(n) comparisons. There is no suffix array, no hash of
words, no sorting of words: only whether two words are equal, and which is smaller.
Where a run begins is found by the same scan over the reversed text.

Each document is handled alone in its task, so the job has no shuffle and a lost
executor costs its tasks only.

Defined cases: null and empty texts have no words, no runs and an empty collapsed
text; a very long text is handled whole (its words and eight numbers a word are in
memory at once); repeated rows give equal rows; a null identifier is carried; other
columns are ignored or carried; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_name, small_batches, table

#: A run counts from so many periods on, and from so many words on.
LEAST_PERIODS, LEAST_WORDS = 4, 6


def lyndon_edges(x: list, down: bool = False) -> tuple[list[int], list[int]]:
    """(next, agree): the start of the next smaller suffix of each suffix (len(x): none), and the words that both begin with.

    ``down`` turns the order of the words; the end of the text is smaller than any word in both orders.
    """
    n = len(x)
    after, agree = [n] * n, [0] * n
    before, agree_before = [-1] * n, [0] * n
    # x[b:e] repeats x[b - shift:]; nothing has been read beyond e.
    b = shift = e = 0
    for r in range(1, n):
        p = r - 1
        known = r < e
        twin = r - shift
        if known:
            q = p - shift
            same = agree[q] if after[q] == twin else agree_before[twin]
            if r + same >= e:
                same = e - r
                while r + same < n and x[p + same] == x[r + same]:
                    same += 1
        else:
            same = 0
            while r + same < n and x[p + same] == x[r + same]:
                same += 1
        while True:
            at = r + same
            if at < n and (x[at] < x[p + same]) == down:
                before[r], agree_before[r] = p, same  # the suffix at p is smaller and stays
                best, most = p, same
                break
            after[p], agree[p] = r, same
            best, most = p, same
            q, own = before[p], agree_before[p]
            if q < 0:
                break
            if own < same:
                before[r], agree_before[r] = q, own
                break
            p = q
            if own > same:
                continue
            if known and at < e:
                q = p - shift if p >= b else p
                same = agree[q] if after[q] == twin else agree_before[twin]
                if r + same < e:
                    continue
                same = e - r
            while r + same < n and x[p + same] == x[r + same]:
                same += 1
        if most and r + most >= e:
            b, shift, e = r, r - best, r + most
    return after, agree


def _ends(x: list) -> list[tuple[int, int, int]]:
    """(period, place of the first root, end) of all runs of LEAST_PERIODS periods, and of some that are one shorter."""
    n, out = len(x), []
    for down in (False, True):
        after, agree = lyndon_edges(x, down)
        for i, (j, same) in enumerate(zip(after, agree, strict=True)):
            period = j - i
            # The first root lies in the first period, so all periods but that one and the last are matched words.
            if same >= (LEAST_PERIODS - 2) * period and j < n and not (i >= period and after[i - period] == i and agree[i - period] >= period):
                out.append((period, i, j + same))
    return sorted(out)


def runs_of(x: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of at least LEAST_PERIODS periods and LEAST_WORDS words, by start and period."""
    found = _ends(x)
    if not found:
        return []
    n = len(x)
    starts = sorted((period, n - end) for period, _, end in _ends(x[::-1]))
    out, k = [], 0
    for period, root, end in found:
        # Two runs of one period share less than a period, so one start at most is in reach of a root.
        while k < len(starts) and starts[k] <= (period, root - period):
            k += 1
        if k < len(starts) and starts[k][0] == period and starts[k][1] <= root:
            length = end - starts[k][1]
            run = (starts[k][1], length, period)
            # A run up to the end of the text is in the arrays of both orders, with two roots.
            if length >= max(LEAST_WORDS, LEAST_PERIODS * period) and run not in out[-1:]:
                out.append(run)
    return sorted(out, key=lambda run: (run[0], run[2]))


def kept_words(x: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run repeats: those outside all runs and those of each first period that lie in no other run's repeats."""
    if not runs:
        return x
    depth = [0] * (len(x) + 1)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    out, open_runs = [], 0
    for word, step in zip(x, depth, strict=False):
        open_runs += step
        if not open_runs:
            out.append(word)
    return out


def collapse_runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = (), rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``id_col`` and ``keep``, then runs (array of start, length, period in words) and collapsed (the text without the
    repeats of its runs, one space between words), for every row; where a column has such a name, runs_1 and so on.

    ``rewrite`` gets a row's identifier and its words, and gives the words to use.
    """
    small_batches(docs.sparkSession, 500)
    own = [id_col, *keep]
    text, runs_col, collapsed_col = (free_name(c, own) for c in ("text_of", "runs", "collapsed"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    names = [*own, runs_col, collapsed_col]

    def task(batches):
        for batch in batches:
            runs, collapsed = [], []
            for doc, raw in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
                words = raw.split() if raw else []  # bytes part at these six characters alone
                if rewrite:
                    words = rewrite(doc, words)
                found = runs_of(words)
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                collapsed.append(b" ".join(kept_words(words, found)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(runs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())], names)

    rows = docs.select(F.col(text_col).cast("string").cast("binary").alias(text), *own)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(task, f"{schema}, `{runs_col}` array<struct<start:bigint,length:bigint,period:bigint>>, `{collapsed_col}` string")


def planted(doc: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the periodic tail that the query's contract gives every tenth document, by its identifier's crc32."""
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


NAME = "op12_periodic_runs"
SQL = None  # runs of a word sequence have no SQL form that ends in time; tests compare with all stretches of all periods


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(table(spark, sf_dir, "documents"), rewrite=planted)
    # Runs are ordered by start, then period: of equal lengths the first is the one with the least start.
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.withColumn("top", longest)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.back")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.less")).alias("period"),
        F.floor(F.lit(1000) * F.col("top.length") / (-F.col("top.less"))).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
