"""Token-ID output: one wavelet matrix a shard.

Documents are dealt by ranges of doc_id and sorted, so that shards follow each
other in ascending order; a task writes one shard for every so many tokens.

A shard is one compressed file. Its ids are numbered by how often it says them (the
alphabet comes first), so that most high bits are 0; the file holds one bit-plane for
each bit of such a number, most significant first, and at each plane the sequence is
parted stably by its bit. One more bit vector marks the last token of each document,
and the identifiers follow, as differences. A bit vector is cut into pieces of 4 KB,
deflated where few of the bits, or few of the others, are set, beside the number of
ones of every 512 bits; access, rank (counting) and select (occurrence lookup)
unpack the pieces that they touch, and no others.

Files are a binary column of a Parquet table in the shared folder (Spark's commit
protocol makes them whole or absent); ``to_files`` writes each to a folder. Global
starts need one token count a partition on the driver.

Defined cases: null text counts as empty and holds the end id only; a null doc_id
sorts first; a very long text is one document in one shard; repeated rows are
documents of their own, next to each other, and many rows with one identifier or none are
spread by their texts; ids may have 32 bits; an empty table gives no shards; other
columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import MEMO_LETTERS, vocabulary_path
from .pretoken import SPECIAL, distinct_words
from .shared import materialise, small_batches, table

END_ID = 2
SHARD_TOKENS = 1 << 20
_MAGIC = b"WVM2"
_HEAD = "<4sQIIQQ"  # magic, tokens, planes, alphabet, documents, documents without an identifier
_BLOCK = 512
_PIECE = 4096
#: A piece is deflated if less than this share of its bits are ones, or zeros.
_SKEWED = 0.25
MEMO_WORDS = 1_200_000
#: Ids below this are counted in a table.
_TABLE = 1 << 22
#: Shards whose starts (24 bytes each) are broadcast, at most.
BROADCAST_SHARDS = 200_000


class BitVector:
    """Bits in pieces, each deflated where that is shorter, and the ones before every _BLOCK bits."""

    def __init__(self, data: bytes, at: int):
        self.n, counted, pieces = struct.unpack_from("<QII", data, at)
        at += 16
        ones = np.frombuffer(zlib.decompress(data[at : at + counted]), "<u2").astype(np.int64)
        at += counted
        sizes = np.frombuffer(data, "<u2", pieces, at).astype(np.int64)
        at += 2 * pieces
        self.before = np.cumsum(ones) - ones
        self.data, self.starts, self.sizes = data, at + np.cumsum(sizes) - sizes, sizes
        self.end = at + int(sizes.sum())
        self.held: tuple[int, bytes] = (-1, b"")

    @staticmethod
    def build(bits: np.ndarray) -> bytes:
        packed = np.packbits(bits)
        blocks = len(bits) // _BLOCK + 1
        whole = np.zeros(-(-blocks * (_BLOCK // 8) // _PIECE) * _PIECE, np.uint8)
        whole[: len(packed)] = packed
        ones = np.bitwise_count(whole).reshape(-1, _BLOCK // 8).sum(1, dtype=np.int64)
        share = ones.reshape(-1, _PIECE * 8 // _BLOCK).sum(1) / (_PIECE * 8)
        pieces = []
        for i, skewed in enumerate(((share < _SKEWED) | (share > 1 - _SKEWED)).tolist()):
            raw = whole[i * _PIECE : (i + 1) * _PIECE].tobytes()
            small = zlib.compress(raw, 1) if skewed else raw
            pieces.append(small if len(small) < len(raw) else raw)
        counts = zlib.compress(ones[:blocks].astype("<u2").tobytes(), 1)
        return struct.pack("<QII", len(bits), len(counts), len(pieces)) + counts + np.array([len(p) for p in pieces], "<u2").tobytes() + b"".join(pieces)

    def _piece(self, i: int) -> bytes:
        if self.held[0] != i:
            raw = self.data[self.starts[i] : self.starts[i] + self.sizes[i]]
            self.held = (i, raw if len(raw) == _PIECE else zlib.decompress(raw))
        return self.held[1]

    def bits(self) -> np.ndarray:
        raw = b"".join(self._piece(i) for i in range(len(self.sizes)))
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).astype(bool)

    def _block(self, i: int) -> np.ndarray:
        at = i * (_BLOCK // 8)
        return np.unpackbits(np.frombuffer(self._piece(at // _PIECE), np.uint8)[at % _PIECE : at % _PIECE + _BLOCK // 8])

    def get(self, i: int) -> int:
        return int(self._block(i // _BLOCK)[i % _BLOCK])

    def ones(self, i: int) -> int:
        """Ones among the first i bits."""
        return int(self.before[i // _BLOCK]) + int(self._block(i // _BLOCK)[: i % _BLOCK].sum())

    def select(self, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit."""
        before = self.before if bit else np.arange(len(self.before)) * _BLOCK - self.before
        block = int(np.searchsorted(before, k, "right")) - 1
        return block * _BLOCK + int(np.flatnonzero(self._block(block) == bit)[k - int(before[block])])


class WaveletMatrix:
    """Reads a shard's file; ``build`` writes one."""

    def __init__(self, data: bytes):
        magic, self.n, self.levels, size, self.n_docs, self.n_null = struct.unpack_from(_HEAD, data)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix")
        at = struct.calcsize(_HEAD)
        self.alphabet = np.frombuffer(data, "<u4", size, at)
        at += 4 * size
        self.code = {t: i for i, t in enumerate(self.alphabet.tolist())}
        self.planes: list[BitVector] = []
        for _ in range(self.levels):
            self.planes.append(BitVector(data, at))
            at = self.planes[-1].end
        self.zeros = [p.n - p.ones(p.n) for p in self.planes]
        self.ends = BitVector(data, at)
        self._ids = data[self.ends.end :]

    @staticmethod
    def build(ids: np.ndarray, levels: int, lengths: list[int] | None = None, docs: list[int | None] | None = None) -> bytes:
        """``levels``: the bits that an id may have. ``lengths`` and ``docs``: of the documents, in order, those without an identifier first."""
        n = len(ids)
        if n and int(ids.max()) >> levels:
            raise ValueError("an id needs more bit-planes")
        if n and int(ids.max()) >= _TABLE:  # a table by id would be too large
            used, place, counts = np.unique(ids, return_inverse=True, return_counts=True)
        else:
            place, counts = ids, np.bincount(ids) if n else np.zeros(0, np.int64)
            used = np.arange(len(counts))
        by_count = np.argsort(-counts, kind="stable")
        by_count = by_count[: np.count_nonzero(counts)]
        alphabet = used[by_count]
        planes = max(1, (len(alphabet) - 1).bit_length()) if len(alphabet) else 0
        kind = np.uint16 if planes <= 16 else np.uint32
        code = np.zeros(len(counts), kind)
        code[by_count] = np.arange(len(by_count), dtype=kind)
        current = code[place] if n else code
        body = []
        for level in reversed(range(planes)):
            bit = (current & kind(1 << level)).astype(bool)
            body.append(BitVector.build(bit))
            current = np.concatenate([current[~bit], current[bit]])
        ends = np.zeros(n, bool)
        ends[np.cumsum(np.array(lengths or [], np.int64)) - 1] = True
        named = [d for d in docs or [] if d is not None]
        first = np.array(named[:1], np.int64)
        steps = np.concatenate([first, np.diff(np.array(named, np.int64))])
        head = struct.pack(_HEAD, _MAGIC, n, planes, len(alphabet), len(lengths or []), len(docs or []) - len(named))
        return head + alphabet.astype("<u4").tobytes() + b"".join(body) + BitVector.build(ends) + zlib.compress(steps.astype("<i8").tobytes(), 1)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """(identifiers, tokens of each) in order."""
        steps = np.frombuffer(zlib.decompress(self._ids), "<i8")
        ends = np.flatnonzero(self.ends.bits())
        return [None] * self.n_null + np.cumsum(steps).tolist(), np.diff(ends, prepend=-1)

    def access(self, i: int) -> int:
        value = 0
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            bit, ones = plane.get(i), plane.ones(i)
            i = zeros + ones if bit else i - ones
            value = value << 1 | bit
        return int(self.alphabet[value])

    def _range(self, token: int, i: int) -> tuple[int, int]:
        if token not in self.code:
            return 0, 0
        low, high, code = 0, i, self.code[token]
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            a, b = plane.ones(low), plane.ones(high)
            if code >> (self.levels - 1 - level) & 1:
                low, high = zeros + a, zeros + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` occurs among the first i."""
        low, high = self._range(token, i)
        return high - low

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``token``."""
        low, high = self._range(token, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i = low + k
        for level in reversed(range(self.levels)):
            bit = self.code[token] >> (self.levels - 1 - level) & 1
            i = self.planes[level].select(bit, i - self.zeros[level] if bit else i)
        return i

    def document_of(self, i: int) -> int:
        """Which document (from 0) holds token i."""
        return self.ends.ones(i)

    def all(self) -> np.ndarray:
        """Every id in order: the planes undone from the last to the first."""
        out = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in reversed(range(self.levels)):
            bit = self.planes[level].bits()
            merged = np.empty_like(out)
            merged[~bit] = out[: self.zeros[level]]
            merged[bit] = out[self.zeros[level] :] | out.dtype.type(1 << (self.levels - 1 - level))
            out = merged
        return self.alphabet[out] if self.n else np.zeros(0, np.uint32)


_TOKENIZERS: dict[str, tuple] = {}


def _library(path: str | None):
    """(tokenizer, whether an id ends a word, memo of words' ids) of this worker."""
    where = vocabulary_path(path)
    if where not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        made = Tokenizer.from_file(where)
        made.normalizer = normalizers.Sequence([])  # words come normalised, and twice is not always once
        made.no_truncation()
        made.no_padding()
        size = made.get_vocab_size()
        final = np.array([t.endswith("</w>") or t in SPECIAL for t in map(made.id_to_token, range(size))])
        _TOKENIZERS[where] = (made, final, {})
    return _TOKENIZERS[where]


def _encode_words(tokenizer, final: np.ndarray, words: list[str]) -> list[bytes]:
    """Ids of each word by the library: many words a call, parted again after each id that ends a word."""
    out: list[bytes] = []
    for i in range(0, len(words), 4000):
        some = words[i : i + 4000]
        ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
        cut = np.flatnonzero(final[ids]) + 1
        if len(cut) == len(some):
            raw, at = ids.tobytes(), [0, *(cut * 4).tolist()]
            out += [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
        else:  # some word is more than one to the library
            out += [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]
    return out


def encode_batch(texts: list[str], path: str | None = None) -> list[np.ndarray]:
    """Ids of each text by the library; its pattern keeps words apart, so a word that this worker has met is not encoded again."""
    tokenizer, final, memo = _library(path)
    of, words, first, last = distinct_words(texts)
    new = [w for w in words if w not in memo]
    if len(memo) + len(new) > MEMO_WORDS:
        memo.clear()
        new = words
    memo.update(zip(new, _encode_words(tokenizer, final, new), strict=True))
    parts = [memo[w] for w in words]
    pool = np.frombuffer(b"".join(parts), "<u4")
    size = np.array([len(p) for p in parts], np.int64) >> 2
    begin = np.cumsum(size) - size
    each = size[of]
    upto = np.concatenate([[0], np.cumsum(each)])
    ids = pool[np.repeat(begin[of] - upto[:-1], each) + np.arange(upto[-1])]
    for w in new:
        if len(w) > MEMO_LETTERS:
            del memo[w]
    return [ids[a:b] for a, b in zip(upto[first].tolist(), upto[last].tolist(), strict=True)]


_SHARD = "part int, seq int, file binary"


def write_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, levels: int = 32) -> DataFrame:
    """The table of shards (part, seq, file), in ascending doc_id by (part, seq)."""
    small_batches(docs.sparkSession, 500)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Rows that share an identifier, or have none, are parted by their texts.
    rows = rows.withColumn("own", F.xxhash64("text")).repartitionByRange("doc_id", "own").sortWithinPartitions("doc_id", "own", "text").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def task(batches):
        part, seq, ids, docs_here, lengths, held = 0, 0, [], [], [], 0

        def shard():
            file = WaveletMatrix.build(np.concatenate(ids), levels, lengths, docs_here)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([file], pa.binary())], ["part", "seq", "file"])

        for batch in batches:
            for doc, part, found in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), encode_batch([t or "" for t in batch.column(1).to_pylist()], vocab), strict=True):
                ids += [found, np.array([end_id], "<u4")]
                docs_here.append(doc)
                lengths.append(len(found) + 1)
                held += len(found) + 1
                if held >= shard_tokens:
                    yield shard()
                    seq, ids, docs_here, lengths, held = seq + 1, [], [], [], 0
        if docs_here:
            yield shard()

    return materialise(rows.mapInArrow(task, _SHARD), "token-shards")


def _heads(batches):
    for batch in batches:
        n = [struct.unpack_from(_HEAD, file)[1] for file in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["part", "seq", "n"])


def with_starts(shards: DataFrame) -> DataFrame:
    """``shards`` with ``shard_start``: the tokens of all shards before, by the files' own heads."""
    spark = shards.sparkSession
    heads = materialise(shards.select("part", "seq", F.substring("file", 1, struct.calcsize(_HEAD)).alias("file")).mapInArrow(_heads, "part int, seq int, n long"), "shard-heads")
    starts, at = [], 0
    for r in heads.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # one number a partition
        starts.append((r["part"], at))
        at += r["n"]
    offsets = spark.createDataFrame(starts, "part int, part_start long")
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n")
    placed = heads.withColumn("inside", inside).join(F.broadcast(offsets), "part")  # a row a partition
    placed = placed.select("part", "seq", (F.col("part_start") + F.col("inside")).alias("shard_start"))
    if heads.count() <= BROADCAST_SHARDS:  # else the files are shuffled to their starts
        placed = F.broadcast(placed)
    return shards.join(placed, ["part", "seq"])


def read_shards(shards: DataFrame) -> DataFrame:
    """One row a document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    rows = with_starts(shards).select("file", "shard_start")

    def task(batches):
        for batch in batches:
            for file, start in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                shard = WaveletMatrix(file)
                docs, lengths = shard.documents()
                flat, ends = shard.all().astype("<u4"), np.cumsum(lengths)
                crc = [zlib.crc32(flat[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def count_tokens(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences of each asked token, by rank alone."""

    def task(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                shard = WaveletMatrix(file)
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([shard.rank(t, shard.n) for t in tokens], pa.int64())], ["token", "n"])

    return shards.select("file").mapInArrow(task, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def locate_tokens(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, doc_id, place): every occurrence of the asked tokens, by select; ``place`` counts from the document's first token."""

    def task(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                shard = WaveletMatrix(file)
                docs, lengths = shard.documents()
                begins = np.cumsum(lengths) - lengths
                found = [(t, shard.select(t, k)) for t in tokens for k in range(shard.rank(t, shard.n))]
                of = [shard.document_of(i) for _, i in found]
                columns = [pa.array([t for t, _ in found], pa.int64()), pa.array([docs[d] for d in of], pa.int64()), pa.array([i - int(begins[d]) for (_, i), d in zip(found, of, strict=True)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["token", "doc_id", "place"])

    return shards.select("file").mapInArrow(task, "token long, doc_id long, place long")


def to_files(shards: DataFrame, folder: str) -> DataFrame:
    """Write every shard to ``folder``, which all executors must see, as <part>-<seq>.wvm; gives (path, n_bytes).

    A file appears whole or not at all: a task that is run again replaces it by an equal one.
    """

    def task(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            paths, sizes = [], []
            for part, seq, file in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                path = os.path.join(folder, f"{part:06d}-{seq:06d}.wvm")
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(file)
                os.replace(f.name, path)
                paths.append(path)
                sizes.append(len(file))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "n_bytes"])

    folder = folder.removeprefix("file://")
    return shards.select("part", "seq", "file").mapInArrow(task, "path string, n_bytes long")


NAME = "op7_token_shards"
SQL = None  # needs the tokenizers library; tests compare with it directly


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(table(spark, sf_dir, "documents")))
