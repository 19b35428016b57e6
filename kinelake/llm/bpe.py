"""BPE encoding and decoding with a public vocabulary file.

A word's symbols form a doubly linked list; a priority queue holds the ranks of
the merges open between neighbours, and an entry whose pair has changed by the
time it is taken is stale and skipped. A word of n characters costs
O(n log n), however long it is. Decoding concatenates vocabulary strings (the
file names no decoder, so they are set apart by one space, as the library does).

Every document is handled alone in its task, with a bounded memo of words a
worker, so the job has no shuffle and a lost executor costs its tasks only.

Defined cases: null text counts as empty and gives no ids and an empty decoded
text; a very long text or word is encoded whole; special strings inside a text are the special ids; repeated rows give
equal rows; an empty table gives an empty result; null identifiers and other
columns are carried or ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pretoken import SPECIAL, distinct_words
from .shared import free_name, small_batches, table

MEMO_WORDS = 250_000
MEMO_LETTERS = 40
_LOADED: dict[str, "WordBpe"] = {}


def vocabulary_path(path: str | None) -> str:
    """The given file, or the one of the installed package of public vocabularies."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.final = [vocab[x + self.suffix] for x in letters]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate(model["merges"]):
            self.rank[vocab[a] << 20 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.strings = {i: s for s, i in (vocab | SPECIAL).items()}
        self.memo: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str | None) -> "WordBpe":
        """One copy a worker process."""
        where = vocabulary_path(path)
        if where not in _LOADED:
            _LOADED[where] = cls(where)
        return _LOADED[where]

    def merge(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.final[raw[-1]]
        n = len(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        rank_of = self.rank.get
        queue = []
        for i in range(n - 1):
            rank = rank_of(symbols[i] << 20 | symbols[i + 1])
            if rank is not None:
                queue.append(rank << 32 | i)
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i = entry & 0xFFFFFFFF
            left = symbols[i]
            j = after[i]
            if left < 0 or j >= n or rank_of(left << 20 | symbols[j]) != entry >> 32:
                continue  # stale: one of the two symbols has been merged since
            made = symbols[i] = self.made[entry >> 32]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = rank_of(made << 20 | symbols[k])
                if rank is not None:
                    heapq.heappush(queue, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = rank_of(symbols[h] << 20 | made)
                if rank is not None:
                    heapq.heappush(queue, rank << 32 | h)
        return [s for s in symbols if s >= 0]

    def decode(self, ids) -> str:
        return " ".join(self.strings[i] for i in ids)

    def ids_of(self, word: str) -> bytes:
        """Ids of one word as little-endian 32-bit integers."""
        return np.array([SPECIAL[word]] if word in SPECIAL else self.merge(word), "<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids, decoded text) of each text; a word that this worker remembers is not merged again."""
        of, distinct, first, last = distinct_words(texts)
        if len(self.memo) + len(distinct) > MEMO_WORDS:
            self.memo.clear()
        ids, decoded = [], []
        for word in distinct:
            raw = self.memo.get(word)
            if raw is None:
                raw = self.ids_of(word)
                if len(word) <= MEMO_LETTERS:
                    self.memo[word] = raw
            ids.append(raw)
            decoded.append(self.decode(np.frombuffer(raw, "<u4").tolist()))
        out = []
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            own = of[a:b].tolist()
            out.append((b"".join([ids[j] for j in own]), " ".join([decoded[j] for j in own])))
        return out

    def encode(self, text: str) -> tuple[bytes, str]:
        return self.encode_batch([text])[0]


def encode_texts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), vocab: str | None = None) -> DataFrame:
    """``keep`` columns, then ids (array<int>) and decoded, for every row of ``docs``; where a kept column has such a name, ids_1 and so on."""
    small_batches(docs.sparkSession, 500)
    ids_col, decoded_col, text = (free_name(c, list(keep)) for c in ("ids", "decoded", "text_of"))
    names = [*keep, ids_col, decoded_col]

    def task(batches):
        model = WordBpe.load(vocab)
        for batch in batches:
            ids, decoded = [], []
            for raw, back in model.encode_batch([t or "" for t in batch.column(0).to_pylist()]):
                ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
                decoded.append(back)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names)

    rows = docs.select(F.col(text_col).cast("string").alias(text), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(task, f"{schema}, `{ids_col}` array<int>, `{decoded_col}` string")


def token_digests(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), vocab: str | None = None) -> DataFrame:
    """As ``encode_texts``, with counts and digests in place of the ids and the text."""
    small_batches(docs.sparkSession, 500)
    made = [free_name(c, list(keep)) for c in ("n_tokens", "ids_sha256", "decoded_sha256")]
    names, text = [*keep, *made], free_name("text_of", list(keep))

    def task(batches):
        model = WordBpe.load(vocab)
        for batch in batches:
            n, ids, decoded = [], [], []
            for raw, back in model.encode_batch([t or "" for t in batch.column(0).to_pylist()]):
                n.append(len(raw) // 4)
                ids.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names)

    rows = docs.select(F.col(text_col).cast("string").alias(text), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(task, f"{schema}, `{made[0]}` long, `{made[1]}` string, `{made[2]}` string")


NAME = "op4_bpe"
SQL = None  # merges by rank have no SQL form; tests compare with the tokenizers library


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))
