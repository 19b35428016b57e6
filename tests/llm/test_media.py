import hashlib
import io
import zlib

import numpy as np
import pytest

from kinelake.llm import avi as A
from kinelake.llm.jpeg import luma

from .helpers import awkward, docs, prose


def test_samples_come_back_exactly():
    rng = np.random.default_rng(1)
    for payload in (rng.integers(0, 256, A.SAMPLES * 7), np.zeros(A.SAMPLES), np.full(A.SAMPLES, 255), np.tile([0, 255], A.SAMPLES)):
        payload = payload.astype(np.uint8)
        frames = A.encode_frames(payload)
        file = A.write_avi(frames)
        index, micros = A.read_index(file)
        assert micros == 40_000 and [file[o : o + n] for o, n in index] == frames
        assert A.decode_frames(frames).tobytes() == payload.tobytes()


def test_frames_are_jpegs_that_others_read():
    image = pytest.importorskip("PIL.Image")
    payload = np.random.default_rng(2).integers(0, 256, A.SAMPLES).astype(np.uint8)
    seen = np.asarray(image.open(io.BytesIO(A.encode_frames(payload)[0])))
    assert seen.shape == (A.DOWN * 8, A.ACROSS * 8)
    assert np.abs(seen[::8, ::8].astype(int) - payload.reshape(A.DOWN, A.ACROSS)).max() <= 1


def test_cuts_follow_sudden_changes():
    calm = np.full((12, A.SAMPLES), 40, np.uint8)
    other = np.full((12, A.SAMPLES), 200, np.uint8)
    assert A.cuts(np.concatenate([calm, other, calm])) == [12, 24]
    assert A.cuts(calm) == [] and A.cuts(calm[:1]) == []


def test_documents(spark):
    rows = awkward() + [(50, prose(300, 3))]
    media = A.store(docs(spark, rows))
    got = {(r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in A.features(media).collect()}
    expected = set()
    for doc, text in rows:
        raw = (text or "").encode()
        padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        expected.add((doc, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])))
    assert got == expected
    clips = A.clips(media).where("doc_id = 8").orderBy("clip_no").collect()
    assert clips[0]["start_sec"] == 0.0 and all(a["end_sec"] == b["start_sec"] for a, b in zip(clips, clips[1:], strict=False))
    assert A.features(A.store(docs(spark, []))).count() == 0


def test_damaged_files_are_refused():
    with pytest.raises(ValueError):
        A.read_index(b"RIFF....WAVE")
    frame = A.encode_frames(np.zeros(A.SAMPLES, np.uint8))[0]
    with pytest.raises(ValueError):
        A.decode_frames([frame, frame[:30] + b"x" + frame[31:]])


def through_java(spark, frame):
    """A frame as the JVM's own image library decodes it: height x width x channels."""
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(frame))
    raster = image.getRaster()
    n = raster.getNumBands()
    flat = raster.getPixels(0, 0, image.getWidth(), image.getHeight(), spark.sparkContext._gateway.new_array(jvm.int, image.getWidth() * image.getHeight() * n))
    return np.array(list(flat)).reshape(image.getHeight(), image.getWidth(), n)


def java_jpeg(spark, pixels):
    """A JPEG that the JVM's image library writes from height x width (grey) or height x width x 3 numbers."""
    jvm = spark.sparkContext._jvm
    grey = pixels.ndim == 2
    image = jvm.java.awt.image.BufferedImage(pixels.shape[1], pixels.shape[0], 10 if grey else 1)
    for y in range(pixels.shape[0]):
        for x in range(pixels.shape[1]):
            if grey:
                image.getRaster().setSample(x, y, 0, int(pixels[y, x]))
            else:
                r, g, b = (int(v) for v in pixels[y, x])
                image.setRGB(x, y, r << 16 | g << 8 | b)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


def test_the_jvm_reads_our_frames(spark):
    payload = np.random.default_rng(2).integers(0, 256, A.SAMPLES).astype(np.uint8)
    seen = through_java(spark, A.encode_frames(payload)[0])
    assert seen.shape == (A.DOWN * 8, A.ACROSS * 8, 1)
    assert (seen[::8, ::8, 0] == payload.reshape(A.DOWN, A.ACROSS)).all()


@pytest.mark.parametrize("shape", [(16, 16), (21, 37), (16, 16, 3), (19, 35, 3)])
def test_frames_of_other_make_are_decoded(spark, shape):
    rng = np.random.default_rng(sum(shape))
    y, x = np.mgrid[: shape[0], : shape[1]]
    wave = 128 + 60 * np.sin(x / 3) + 50 * np.cos(y / 4)
    pixels = np.clip(wave + rng.normal(0, 10, shape[:2]), 0, 255)
    if len(shape) == 3:
        pixels = np.stack([pixels, np.roll(pixels, 3, 0), 255 - pixels], 2)
    frame = java_jpeg(spark, pixels.astype(int))
    got = luma(frame).astype(float)
    assert got.shape == shape[:2]
    if len(shape) == 2:
        assert np.abs(got - through_java(spark, frame)[:, :, 0]).max() <= 1
    else:  # the library gives colours, whose luma is this within the clipping and the rounding of three channels
        expected = through_java(spark, frame) @ np.array([0.299, 0.587, 0.114])
        assert np.median(np.abs(got - expected)) <= 2 and np.abs(got - pixels @ np.array([0.299, 0.587, 0.114])).mean() < 8


def test_clips_of_foreign_damaged_and_missing_files(spark):
    dark, light = (java_jpeg(spark, np.full((16, 24), v)) for v in (30, 220))
    film = A.write_avi([dark] * 6 + [light] * 4)
    at = film.index(b"idx1")
    entries = bytearray(film[at + 8 :])
    movi = film.index(b"movi")
    for i in range(0, len(entries), 16):  # the same with offsets from the beginning
        entries[i + 8 : i + 12] = (int.from_bytes(entries[i + 8 : i + 12], "little") + movi).to_bytes(4, "little")
    absolute = film[: at + 8] + bytes(entries)
    bare = film[:at]
    own = A.write_avi(A.encode_frames(np.full(A.SAMPLES, 65, np.uint8)))
    broken = own[: own.index(b"\xff\xda") + 12] + b"\xfe" * 40 + own[own.index(b"\xff\xda") + 52 :]
    rows = [(1, film), (2, absolute), (3, bare), (4, own), (5, broken), (6, None), (7, b"RIFF....WAVE"), (8, b"")]
    media = spark.createDataFrame([(i, 1, f) for i, f in rows], "doc_id long, n_bytes long, media binary").coalesce(1)
    got = {}
    for r in A.clips(media).orderBy("doc_id", "clip_no").collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i in (1, 2, 3):
        assert [(r["first_frame"], r["frames"], r["start_sec"], r["end_sec"], round(r["mean_level"])) for r in got[i]] == [(0, 6, 0.0, 0.24, 30), (6, 4, 0.24, 0.4, 220)]
    assert got[4][0]["mean_level"] == 65.0 and got[4][0]["problem"] is None
    for i in (5, 6, 7, 8):
        assert len(got[i]) == 1 and got[i][0]["problem"] and got[i][0]["clip_no"] is None
    said = {r["doc_id"]: r["feature"] for r in A.features(media).collect()}
    assert all(said[i].startswith("unreadable") == (i > 4) for i in said)
