import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.llm import bpe, pretoken
from kinelake.llm.bpe import WordBpe, encode_texts, token_digests, vocabulary_path
from kinelake.llm.token_shards import WaveletMatrix, count_tokens, encode_batch, locate_tokens, read_shards, to_files, write_shards

from .helpers import awkward, docs, prose


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(vocabulary_path(None))
    made.no_truncation()
    made.no_padding()
    return made


TEXTS = ["", "It's we've they'll I'd o'clock 'since ''s '", "a'b 's't 're've 'lla", "x<|endoftext|>y's <|startoftext|>", "ÀÉ Ⱥ İstanbul ΣΑΣ ς", "12 3½ a1b2", "日本語 text", "\x85\xa0x y", "é é á", "!!!'s ??", "K-\x1c\x1dq", "ẞ ß ŉ ǅ", "a" * 300, "\U0001f600\U0001f600 ok", "<| not special |>"]


def noisy(seed):
    rng = random.Random(seed)
    alphabet = "abcXYZ'’ 0129.,!?\t\néßÉİΣςſŉ日本½²_-<|>́"
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200)))


def test_ids_and_decoding_are_the_librarys(library):
    model = WordBpe.load(None)
    for text in TEXTS + [noisy(i) for i in range(300)]:
        expected = library.encode(text, add_special_tokens=False).ids
        raw, back = model.encode(text)
        assert np.frombuffer(raw, "<u4").tolist() == expected, text
        assert back == library.decode(expected, skip_special_tokens=False), text


def test_batches_are_the_librarys(library):
    texts = TEXTS + [noisy(i) for i in range(300, 600)]
    for text, got in zip(texts, encode_batch(texts), strict=True):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_every_code_point_is_read_as_the_library_reads_it(library):
    """Alone between letters, doubled, and after an apostrophe; words and ids of both operators."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}a {c}{c} '{c} " for c in points[i : i + 40]) for i in range(0, 0x3400, 40)]
    texts += ["".join(f"{c} " for c in points[i : i + 4000]) for i in range(0x3400, len(points), 4000)]
    model = WordBpe.load(None)
    for i in range(0, len(texts), 200):
        some = texts[i : i + 200]
        expected = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
        assert [x.tolist() for x in encode_batch(some)] == expected
        assert [np.frombuffer(raw, "<u4").tolist() for raw, _ in model.encode_batch(some)] == expected


def test_mixed_texts_of_all_scripts(library):
    rng = random.Random(8)

    def text():
        return "".join(rng.choice([lambda: chr(rng.randrange(0x250, 0x3000)), lambda: chr(rng.choice([rng.randrange(0x3000, 0xD800), rng.randrange(0xE000, 0x30000)])), lambda: rng.choice([" ", "\n", "'s", "J\u030c", "\u0130", "\u03a3", "\x85", "<|endoftext|>"]), lambda: rng.choice("abcABC12.,!\xe9")])() for _ in range(rng.randrange(1, 30)))

    texts = [text() for _ in range(6000)]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encode_batch(texts)] == expected
    assert [np.frombuffer(raw, "<u4").tolist() for raw, _ in WordBpe.load(None).encode_batch(texts)] == expected


def test_batch_words_are_the_plain_ones():
    texts = TEXTS + [noisy(i) for i in range(600, 900)]
    points, starts, ends, _, first, last = pretoken.batch_words(texts)
    for i, text in enumerate(texts):
        got = [pretoken.word_at(points, int(s), int(e)) for s, e in zip(starts[first[i] : last[i]], ends[first[i] : last[i]], strict=True)]
        assert got == pretoken.words(text), text


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 40)
    model = WordBpe(vocabulary_path(None))
    a = [model.encode(prose(30, i)) for i in range(5)]
    assert len(model.memo) <= 40
    assert a == [WordBpe.load(None).encode(prose(30, i)) for i in range(5)]


def test_tables(spark, library):
    rows = awkward()
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in token_digests(docs(spark, rows)).collect()}
    expected = set()
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        expected.add((doc, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == expected
    some = encode_texts(docs(spark, rows), keep=("doc_id", "source")).where("doc_id = 4").first()
    assert some["ids"] == library.encode("Same Text", add_special_tokens=False).ids and some["source"] == "a"
    assert token_digests(docs(spark, [])).count() == 0


def test_wavelet_matrix_operations():
    rng = np.random.default_rng(4)
    for n, top in ((0, 5), (1, 5), (511, 3), (512, 49408), (513, 7), (5000, 300)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        w = WaveletMatrix(WaveletMatrix.build(ids, 16))
        assert w.all().tolist() == ids.tolist()
        for i in rng.integers(0, max(n, 1), 20 if n else 0).tolist():
            t = int(ids[i])
            assert w.access(i) == t
            assert w.rank(t, i) == int((ids[:i] == t).sum())
            assert w.select(t, w.rank(t, i)) == i
        assert w.rank(65_000, n) == 0
        with pytest.raises(IndexError):
            w.select(65_000, 0)


def test_shards_in_document_order(spark, library):
    import zlib

    rows = [r for r in awkward() if r[0] is not None] + [(100 + i, prose(40, i)) for i in range(60)]
    shards = write_shards(docs(spark, rows), shard_tokens=500)
    assert shards.count() > 3
    got = [tuple(r) for r in read_shards(shards).orderBy("start").collect()]
    at, expected = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == expected
    assert read_shards(write_shards(docs(spark, []))).count() == 0


def thue_morse(n, letters="ab"):
    return "".join(letters[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_whose_hashes_collide_are_told_apart(library, n):
    a, b = thue_morse(n), thue_morse(n, "ba")
    _, _, _, hashes, _, _ = pretoken.batch_words([a, b])
    assert n < 2048 or hashes[0] == hashes[1]  # the case is real
    texts = [f"{a} {b}", b, f"x {a}"]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [g.tolist() for g in encode_batch(texts)] == expected
    model = WordBpe.load(None)
    assert [np.frombuffer(raw, "<u4").tolist() for raw, _ in model.encode_batch(texts)] == expected
    for text, ids in zip(texts, expected, strict=True):  # met before, in another batch
        assert encode_batch([text])[0].tolist() == ids == np.frombuffer(model.encode(text)[0], "<u4").tolist()


def test_kept_columns_may_have_any_name(spark):
    df = docs(spark, [(1, "one two"), (2, None)]).withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded").withColumn("text_of", F.lit(3)).withColumn("n_tokens", F.lit(4))
    out = encode_texts(df, keep=("doc_id", "ids", "decoded", "text_of"))
    assert out.columns == ["doc_id", "ids", "decoded", "text_of", "ids_1", "decoded_1"] and out.count() == 2
    assert token_digests(df, keep=("doc_id", "n_tokens")).columns == ["doc_id", "n_tokens", "n_tokens_1", "ids_sha256", "decoded_sha256"]


def test_files_count_locate_and_hold_their_documents(spark, library, tmp_path):
    rows = [(i, f"{prose(60, i)} stop {prose(i % 40, i + 500)} ## stop") for i in range(80)] + [(None, "stop ##"), (7, ""), (7, None)]
    shards = write_shards(docs(spark, rows), shard_tokens=1500)
    stop = library.encode("stop", add_special_tokens=False).ids[0]
    truth = {2: [], stop: [], 49000: []}
    for doc, text in rows:
        for place, t in enumerate([*library.encode(text or "", add_special_tokens=False).ids, 2]):
            if t in truth:
                truth[t].append((doc, place))
    assert {r["token"]: r["n"] for r in count_tokens(shards, list(truth)).collect()} == {t: len(v) for t, v in truth.items()}
    found = {t: [] for t in truth}
    for r in locate_tokens(shards, list(truth)).collect():
        found[r["token"]].append((r["doc_id"], r["place"]))
    assert all(sorted(found[t], key=repr) == sorted(truth[t], key=repr) for t in truth)
    written = to_files(shards, f"file://{tmp_path}/out").collect()
    assert len(written) == shards.count() > 2
    docs_back = []
    for r in sorted(written, key=lambda r: r["path"]):
        with open(r["path"], "rb") as f:
            data = f.read()
        shard = WaveletMatrix(data)
        ids, lengths = shard.documents()
        docs_back += ids
        assert len(data) == r["n_bytes"] and lengths.sum() == shard.n and len(ids) == len(lengths)
    assert docs_back == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))


def test_files_are_smaller_than_plain_ids():
    rng = np.random.default_rng(9)
    ids = np.minimum(rng.zipf(1.3, 200_000), 49_000).astype(np.uint32)
    data = WaveletMatrix.build(ids, 16, [len(ids)], [1])
    assert len(data) < 1.6 * len(ids) and WaveletMatrix(data).all().tolist() == ids.tolist()


@pytest.mark.parametrize("most", [70_000, 1 << 31])
def test_shards_of_large_vocabularies(most):
    ids = np.random.default_rng(3).integers(0, most, 3000).astype(np.uint32)
    ids[::7] = most - 1
    shard = WaveletMatrix(WaveletMatrix.build(ids, 32, [1000, 2000], [4, 9]))
    assert (shard.all() == ids).all() and shard.documents() == ([4, 9], pytest.approx([1000, 2000]))
    assert shard.rank(most - 1, 3000) == int((ids == most - 1).sum()) and shard.access(14) == most - 1 and shard.select(most - 1, 2) == 14


def test_many_rows_without_an_identifier_are_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = write_shards(docs(spark, [(None, prose(30, i)) for i in range(400)] + [(7, prose(30, 900 + i)) for i in range(400)]), shard_tokens=1 << 20)
        assert shards.select("part").distinct().count() > 2
        rows = read_shards(shards).collect()
        assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])] == [None] * 400 + [7] * 400
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
