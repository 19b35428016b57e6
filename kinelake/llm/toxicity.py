"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model is counted over every text of the table (the
   counts are summed by Spark; the table of all trigrams has a fixed size).
2. A token that is not plain letters, or that repeats a letter, is
   a lattice: a digit or sign may stand for letters, may be noise or may part
   words, and a repeated letter may be one. Letters and signs set apart by single
   spaces are joined into such a token first, in which a word may end before any
   letter. Viterbi decoding finds the most likely letters under the model. Plain
   tokens have one path and need no search; those with a doubled letter also count
   as they are. A space between two words may be noise, too: where the two make
   up a marked word, both readings are decoded (of other pairs none would count).
3. The restored words, and the stems (first four to eight letters) of
   longer ones, that mark toxic texts in the labelled sample are weighed by a logistic
   fit; a document's score is the model's probability.

Every document is scored alone in its task from a broadcast of fixed size.

Defined cases: null and empty texts score as a text without any marked word;
labels other than 0 and 1 and labels of unknown documents are ignored; without
labelled rows of both classes every score is the share of label 1 (0 without
any); a very long text is scored whole; repeated rows score alike; an empty table gives an empty result; other
columns are never inputs.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .labels import FIT_ROWS, labelled_sample, remainder
from .shared import free_name, materialise, small_batches, table

# What signs may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "[": "c", "€": "e", "£": "l", "¡": "i"}
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
CODE = {c: i + 1 for i, c in enumerate(_LETTERS)}
OTHER = len(_LETTERS) + 1
SIZE = OTHER + 1  # 0 parts words
#: Log-probabilities of the channel.
KEEP, STANDS_FOR, NOISE, SIGN_NOISE, PARTS, REPEAT_RUN, REPEAT_TWO, SPACE_NOISE = -0.05, -0.7, -0.2, -6.0, -0.9, -0.3, -3.0, -2.0
MAX_FEATURES = 4096
MEMO_TOKENS = 120_000
#: Tokens whose features are remembered, and features counted, before a task lets go of them.
COUNTED_TOKENS, COUNTED_FEATURES = 30_000, 150_000
_ONE = r"(?:[^\W_]|[" + re.escape("".join(c for c in LEET if not c.isalnum())) + "])"
_SPACED = re.compile(rf"(?<![^\s])(?:{_ONE}[ .\-_*]{{1,2}}){{2,}}{_ONE}(?![^\s.,!?;:])")
_RUN, _DOUBLE = re.compile(r"(\w)\1\1"), re.compile(r"(\w)\1")
#: Begins a token that was joined from spaced signs; a word may end before any of its letters.
JOINED = "\x01"
_EDGE = ".,;:?!\"'()[]{}<>«»„“”‘’-–—_*#%&/\\|=~^`"


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return _table()[np.minimum(points, 0x3000)]


@lru_cache(1)
def _table() -> np.ndarray:
    out = np.zeros(0x3001, np.int64)
    for point in range(0x3001):
        c = chr(point)
        out[point] = CODE.get(c, OTHER if c.isalpha() else 0)
    out[0x3000] = OTHER  # everything from here on counts as one letter
    return out


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Trigram counts of all texts; runs of non-letters are one parting. SIZE ** 3 numbers at most reach the driver."""

    def task(batches):
        counts = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            codes = _codes(" " + " ".join(t for t in batch.column(0).to_pylist() if t) + " ")
            codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
            counts += np.bincount((codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:], minlength=SIZE**3)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["gram", "n"])

    found = docs.select("text").mapInArrow(task, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIZE**3, np.int64)
    out[found["gram"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """log p(c | a, b), interpolated from trigrams, bigrams and letters; float32 of a fixed size."""
    three = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
    two, one = three.sum(0), three.sum((0, 1))
    uni = (one + 1) / (one.sum() + SIZE)
    bi = (two + 5 * uni) / (two.sum(1, keepdims=True) + 5)
    tri = (three + 5 * bi[None]) / (three.sum(2, keepdims=True) + 5)
    return np.log(tri).astype(np.float32)


def _options(token: str, i: int) -> list[tuple[str, float]]:
    """What the i-th sign of a token may stand for: a letter, '' (noise) or ' ' (parts words)."""
    c = token[i]
    if c == " ":
        return [(" ", KEEP), ("", SPACE_NOISE)]
    if c.isalpha():
        out = [(c, KEEP)]
        if i and token[i - 1] == c:
            long_run = token[i - 2 : i] == c * 2 if i > 1 else False
            long_run |= token[i + 1 : i + 2] == c
            out.append(("", REPEAT_RUN if long_run else REPEAT_TWO))
        return out
    out = [(x, STANDS_FOR) for x in LEET.get(c, "")]
    return out + [("", SIGN_NOISE if out else NOISE), (" ", PARTS + (SIGN_NOISE if out else 0.0))]


def viterbi(token: str, model: np.ndarray, joined: bool = False) -> str:
    """The most likely reading of a token; ' ' parts words in it, in ``joined`` ones also between letters. States are the last two letters."""
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for i in range(len(token)):
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for option, cost in _options(token, i):
            code = 0 if option == " " else CODE.get(option, OTHER) if option else -1
            for (a, b), (score, path) in best.items():
                if code < 0 or (code == 0 and b == 0):
                    ways = [((a, b), score + cost, path)]
                else:
                    ways = [((b, code), score + cost + float(model[a, b, code]), (path, option))]
                    if joined and code and b:
                        ways.append(((0, code), score + cost + PARTS + float(model[a, b, 0]) + float(model[b, 0, code]), (path, " " + option)))
                for state, total, way in ways:
                    if state not in after or total > after[state][0]:
                        after[state] = (total, way)
        best = after
    (_, _), (_, path) = max(best.items(), key=lambda x: x[1][0] + (float(model[x[0][0], x[0][1], 0]) if x[0][1] else 0.0))
    out = []
    while path:
        path, option = path
        out.append(option)
    return "".join(reversed(out))


def restored(token: str, model: np.ndarray) -> list[str]:
    """Words of one lower-case token without white space. A token that is letters, some doubled, counts as it is, too."""
    joined = token.startswith(JOINED)
    token = token.removeprefix(JOINED)
    core = token.strip(_EDGE)
    plain = core.isalpha() and not _RUN.search(core) and (core == token.strip(".,;:?!\"'") or not any(c in LEET for c in token[: token.find(core)]))
    if plain and not joined:
        return list(dict.fromkeys([core, *viterbi(core, model).split()])) if _DOUBLE.search(core) else [core]
    body = re.sub(r"([^\w\s])\1+$", "", token.rstrip(".,;:?\"'"))
    if not any(c.isalpha() for c in body):
        return []
    return viterbi(body, model, joined).split()


def tokens(text: str) -> set[str]:
    """Distinct lower-case tokens of a text, with spaced-out letters and signs joined into further ones, as one word and (after JOINED) as any number."""
    low = text.lower()
    out = set(low.split())
    for m in _SPACED.finditer(low):
        for part in re.split(r"\s{2,}", m.group()):
            joined = re.sub(r"[\s.\-_*]", "", part)
            for one in {joined, joined.strip(_EDGE)}:
                if len(one) > 2:
                    out.update((one, JOINED + one))
    return out


def split_words(words: list[str]) -> dict[str, dict[str, str]]:
    """For each first part of a word its rests, and the word they make up."""
    out: dict[str, dict[str, str]] = {}
    for w in words:
        for i in range(1, len(w)):
            out.setdefault(w[:i], {})[w[i:]] = w
    return out


def joined_pairs(text: str, parts: dict[str, dict[str, str]], model: np.ndarray) -> set[str]:
    """Words of ``parts`` whose halves stand next to each other and read best as one."""
    out, words = set(), text.lower().split()
    for a, b in zip(words, words[1:], strict=False):
        rests = parts.get(a)
        if rests is not None and (word := rests.get(b.strip(_EDGE))) is not None and word not in out and viterbi(f"{a} {b.strip(_EDGE)}", model) == word:
            out.add(word)
    return out


def features(words: list[str]) -> set[str]:
    """Words and their stems of four to eight letters; a stem is written with a star."""
    out = set()
    for w in words:
        out.add(w)
        out.update(w[:k] + "*" for k in range(4, 9) if len(w) > k)
    return out


def _doc_features(text: str, model: np.ndarray, memo: dict) -> set[str]:
    out: set[str] = set()
    for t in tokens(text):
        if t not in memo:
            if len(memo) >= COUNTED_TOKENS:
                memo.clear()
            memo[t] = tuple(features(restored(t, model)))
        out.update(memo[t])
    return out


def _class_counts(model):
    def task(batches):
        memo: dict = {}
        counts: dict[str, list[int]] = {}

        def flush():
            rows = [(k, a, b) for k, (a, b) in counts.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["feature", "neg", "pos"])

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in _doc_features(text or "", model.value, memo):
                    counts.setdefault(f, [0, 0])[label] += 1
            if len(counts) > COUNTED_FEATURES:
                yield flush()
        if counts:
            yield flush()

    return task


def choose_features(sample: DataFrame, model, limit: int = MAX_FEATURES) -> dict[str, int]:
    """Features that mark label 1: chi-square above 40 and at least four documents; the strongest ``limit``."""
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return {}
    counts = sample.select("text", "label").mapInArrow(_class_counts(model), "feature string, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("a"), F.sum("pos").alias("b"))
    n0, n1 = float(n[0]), float(n[1])
    seen = F.col("a") + F.col("b")
    chi = (n0 + n1) * F.pow(F.col("b") * n0 - F.col("a") * n1, 2) / (n0 * n1 * seen * F.greatest(F.lit(n0 + n1) - seen, F.lit(1.0)))
    marked = counts.where((F.col("b") >= 4) & (F.col("b") * n0 > 3 * F.col("a") * n1)).withColumn("chi", chi).where("chi > 40")
    return {r["feature"]: i for i, r in enumerate(marked.orderBy(F.desc("chi"), "feature").limit(limit).collect())}


def _present(model, chosen):
    def task(batches):
        memo: dict = {}
        index = chosen.value
        for batch in batches:
            found = [sorted(index[f] for f in _doc_features(t or "", model.value, memo) if f in index) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["label", "found"])

    return task


def fit_logistic(rows: list[tuple[int, list[int]]], width: int, ridge: float = 0.1, steps: int = 600) -> np.ndarray:
    """Weights and, last, the bias; full-batch steps scaled by past gradients."""
    y = np.array([r[0] for r in rows], np.float64)
    of = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    at = np.array([i for r in rows for i in r[1]], np.int64)
    w, past = np.zeros(width + 1), np.full(width + 1, 1e-6)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w[-1] = math.log(share / (1 - share))
    for _ in range(steps):
        z = np.bincount(of, w[at], len(rows)) + w[-1]
        off = 1 / (1 + np.exp(-z)) - y
        grad = np.append(np.bincount(at, off[of], width) + ridge * w[:-1], off.sum())
        past += grad * grad
        w -= 0.5 * grad / np.sqrt(past)
    return w


def _scorer(model, weights):
    """Scores of a list of texts. A token's marked features are looked up once a worker task and remembered."""
    lm, (index, bias) = model.value, weights.value
    memo: dict[str, tuple] = {}
    parts = split_words([f for f in index if not f.endswith("*")])

    def scores(texts: list[str | None]) -> pa.Array:
        out = []
        for text in texts:
            found: set = set()
            for t in tokens(text or ""):
                hit = memo.get(t)
                if hit is None:
                    if len(memo) >= MEMO_TOKENS:
                        memo.clear()
                    hit = memo[t] = tuple(f for f in features(restored(t, lm)) if f in index)
                if hit:
                    found.update(hit)
            for word in joined_pairs(text, parts, lm) if text and parts else ():
                found.update(f for f in features([word]) if f in index)
            z = bias + math.fsum(index[f] for f in found)
            out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
        return pa.array(out, pa.float64())

    return scores


class ToxicityModel:
    """The language model and the weighed features, both of bounded size."""

    def __init__(self, spark: SparkSession, lm: np.ndarray, weights: dict[str, float], bias: float):
        self.lm, self.weights, self.bias = lm, weights, bias
        self._model, self._weights = spark.sparkContext.broadcast(lm), spark.sparkContext.broadcast((weights, bias))

    @classmethod
    def fit(cls, docs: DataFrame, sample: DataFrame) -> "ToxicityModel":
        """``docs``: every text the language model counts. ``sample``: (doc_id, text, label), a bounded set."""
        spark = docs.sparkSession
        small_batches(spark, 1000)
        lm = language_model(count_trigrams(docs))
        model = spark.sparkContext.broadcast(lm)
        sample = materialise(sample, "toxic-sample")
        index = choose_features(sample, model)
        chosen = spark.sparkContext.broadcast(index)
        rows = [(r["label"], r["found"]) for r in sample.select("text", "label").mapInArrow(_present(model, chosen), "label int, found array<int>").collect()]
        if len({y for y, _ in rows}) < 2:
            return cls(spark, lm, {}, 500.0 if rows and rows[0][0] else -500.0)
        w = fit_logistic(rows, len(index))
        return cls(spark, lm, {f: float(w[i]) for f, i in index.items()}, float(w[-1]))

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, score) of every row."""
        model, weights = self._model, self._weights

        def task(batches):
            scores = _scorer(model, weights)
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), scores(batch.column(1).to_pylist())], ["doc_id", "score"])

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, "doc_id long, score double")

    def with_score(self, docs: DataFrame, column: str = "toxic_score") -> DataFrame:
        """``docs`` with the score of each row as one more column, its last; see ``free_name`` for a name that is taken."""
        names, model, weights = docs.columns, self._model, self._weights
        column, at = free_name(column, names), names.index("text")

        def task(batches):
            scores = _scorer(model, weights)
            for batch in batches:
                texts = batch.column(at).cast(pa.string()).to_pylist()
                yield pa.RecordBatch.from_arrays([*batch.columns, scores(texts)], [*names, column])

        return docs.mapInArrow(task, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns kept."""
    scored = fit_on(docs, labels).with_score(docs)
    return scored.where(F.col(scored.columns[-1]) < threshold).drop(scored.columns[-1])


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> ToxicityModel:
    return ToxicityModel.fit(docs, labelled_sample(docs, labels, "toxic", 5, lambda r: r != 0, rows))


NAME = "op10_toxicity"
SQL = None  # Viterbi decoding and a fitted model have no SQL form; tests check decodings and held-out accuracy


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = fit_on(docs, table(spark, sf_dir, "labels")).score(docs)
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
