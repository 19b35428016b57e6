"""Media columns as AVI motion-JPEG.

A payload is stored as 8-bit samples of grey frames: sample s becomes the flat
8x8 block of level s, whose only coefficient, quantised by 8, is s - 128. Any
JPEG decoder gives the sample back exactly. A frame holds 16 x 12 samples
(128 x 96 pixels), is a complete baseline JPEG and is listed in the file's
RIFF index. The reader walks the RIFF chunks, takes the frames from the index,
decodes them from their own Huffman tables, and detects shots where the
difference of successive histograms exceeds an adaptive limit.

Entropy coding and decoding run in lockstep over all frames of an Arrow batch:
step i handles the i-th sample of every frame with a handful of array
operations, so there is no Python loop over samples.

Files of other make are decoded frame by frame (``jpeg``: baseline, grey or colour,
any tables); their samples are the luma of all pixels. A file that can't be read is
a row with the reason and ends no job.

Defined cases: null text counts as empty, and an empty payload is one frame of
spaces; a very long text is one long film; equal texts give equal files; a payload of one frame is one shot;
repeated rows give equal rows; an empty table gives an empty result; null
identifiers are carried and other columns ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jpeg import canonical_codes as _codes
from .jpeg import huffman_tables, luma
from .shared import small_batches, table, utf8

ACROSS, DOWN = 16, 12
SAMPLES = ACROSS * DOWN
FPS = 25
PAD = 32
HISTOGRAM_BINS = 16
WINDOW, FACTOR, FLOOR = 8, 3.0, 0.2

# The usual luminance DC code lengths (categories 0 to 11), and an AC code with end-of-block only.
_DC_BITS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
_DC_VALUES = tuple(range(12))
_AC_BITS = (1,) + (0,) * 15
_AC_VALUES = (0,)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@cache
def _frame_head() -> bytes:
    size = struct.pack(">BHHB", 8, DOWN * 8, ACROSS * 8, 1) + bytes((1, 0x11, 0))
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xE0, b"AVI1" + bytes(10)),
            _segment(0xDB, b"\x00" + bytes([8] * 64)),
            _segment(0xC0, size),
            _segment(0xC4, b"\x00" + bytes(_DC_BITS) + bytes(_DC_VALUES) + b"\x10" + bytes(_AC_BITS) + bytes(_AC_VALUES)),
            _segment(0xDA, bytes((1, 1, 0x00, 0, 63, 0))),
        )
    )


@cache
def _encoder() -> tuple[np.ndarray, np.ndarray]:
    """(bits, length) of a block for each difference -255..255: category, difference, end of block."""
    dc, (eob, eob_length) = _codes(_DC_BITS, _DC_VALUES), _codes(_AC_BITS, _AC_VALUES)[0]
    bits, lengths = [], []
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, length = dc[category]
        extra = d if d >= 0 else d + (1 << category) - 1
        bits.append(((code << category | extra) << eob_length) | eob)
        lengths.append(length + category + eob_length)
    return np.array(bits, np.int64), np.array(lengths, np.int64)


def encode_frames(payload: np.ndarray) -> list[bytes]:
    """JPEG files of as many whole frames as ``payload`` (uint8) holds."""
    levels = payload.reshape(-1, SAMPLES).astype(np.int64)
    diffs = np.diff(levels, axis=1, prepend=128)
    bits, lengths = _encoder()
    code, length = bits[diffs + 255], lengths[diffs + 255]
    ends = np.cumsum(length, axis=1)
    total = ends[:, -1]
    width = int((total.max() + 7) // 8) + 3
    at = ends - length
    value = code << (24 - length - (at & 7))
    place = (at >> 3) + (np.arange(len(levels)) * width)[:, None]
    out = np.zeros(len(levels) * width, np.float64)
    for k in range(3):
        out += np.bincount((place + k).ravel(), (value >> (16 - 8 * k) & 255).ravel(), len(out))
    raw = out.astype(np.uint8).reshape(-1, width)
    spare = -total % 8
    last = (total + 7) // 8 - 1
    raw[np.arange(len(raw)), last] |= ((1 << spare) - 1).astype(np.uint8)  # filled up with ones
    head, rows = _frame_head(), raw.tobytes()
    return [head + rows[i * width : i * width + n].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for i, n in enumerate((last + 1).tolist())]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def write_avi(frames: list[bytes], fps: int = FPS) -> bytes:
    width, height = ACROSS * 8, DOWN * 8
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    streams = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        chunk = _chunk(b"00dc", f)
        movi.append(chunk)
        at += len(chunk)
    body = b"AVI " + _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + streams) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def read_index(file: bytes) -> tuple[list[tuple[int, int]], int]:
    """(offset, size) of each frame, by the index, and the microseconds a frame lasts."""
    if file[:4] != b"RIFF" or file[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    frames, movi, micros, at = [], None, 0, 12
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"LIST" and file[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"LIST" and file[at + 8 : at + 12] == b"hdrl":
            micros = struct.unpack_from("<I", file, at + 20)[0]
        elif name == b"idx1":
            if movi is None:
                raise ValueError("index before frames")
            for kind, _, offset, length in struct.iter_unpack("<4sIII", file[at + 8 : at + 8 + size]):
                if kind[2:] in (b"dc", b"db"):
                    # Offsets count from the word movi, or, in some files, from the beginning.
                    base = movi if file[movi + offset : movi + offset + 4] == kind else 0
                    if file[base + offset : base + offset + 4] != kind:
                        raise ValueError("an index that points at no frame")
                    frames.append((base + offset + 8, length))
        at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("no frames")
    return frames or walked(file, movi), micros


def walked(file: bytes, movi: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a file without an index, by their chunks."""
    out, at = [], movi + 4
    end = min(len(file), movi + struct.unpack_from("<I", file, movi - 4)[0])
    while at + 8 <= end:
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name[2:] in (b"dc", b"db"):
            out.append((at + 8, size))
        at += 12 if name == b"LIST" else 8 + size + (size & 1)
    return out


@cache
def _decoder(head: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(difference, bits) by the next 16 bits, and samples a frame, from a frame's own segments."""
    tables, quant, shape, at = {}, None, None, 2
    while at < len(head):
        marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        if marker == 0xDB:
            quant = body[1]
        elif marker == 0xC0:
            depth, high, wide, parts = struct.unpack_from(">BHHB", body)
            if depth != 8 or parts != 1:
                raise ValueError("only grey 8-bit frames are decoded")
            shape = -(-high // 8) * -(-wide // 8)
        elif marker == 0xC4:
            tables |= huffman_tables(body)
        at += 2 + size
    if quant != 8 or shape is None:
        raise ValueError("only frames with DC steps of 8 are decoded")
    eob, eob_length = tables[0x10][0]
    diff, used = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
    for category, (code, length) in tables[0x00].items():
        for extra in range(1 << category) if category <= 8 else ():
            d = extra if category == 0 or extra >> (category - 1) else extra - (1 << category) + 1
            bits, n = ((code << category | extra) << eob_length) | eob, length + category + eob_length
            if n <= 16:
                diff[bits << (16 - n) : (bits + 1) << (16 - n)] = d
                used[bits << (16 - n) : (bits + 1) << (16 - n)] = n
    return diff, used, shape


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Samples (frames x samples) of JPEG files that share their header."""
    cut = frames[0].index(b"\xff\xda")
    cut += 2 + struct.unpack_from(">H", frames[0], cut + 2)[0]
    head = frames[0][:cut]
    diff, used, samples = _decoder(head)
    scans = []
    for f in frames:
        if not f.startswith(head):
            raise ValueError("frames of one file differ in their headers")
        scans.append(f[cut:-2].replace(b"\xff\x00", b"\xff"))
    sizes = np.array([len(s) for s in scans], np.int64)
    data = np.frombuffer(b"".join(scans) + bytes(4), np.uint8).astype(np.int32)
    words = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    at = (np.cumsum(sizes) - sizes) * 8
    out = np.empty((samples, len(scans)), np.int32)
    for i in range(samples):
        peek = words[at >> 3] >> (8 - (at & 7)) & 0xFFFF
        out[i] = diff[peek]
        n = used[peek]
        if not n.all():
            raise ValueError("a block is not flat, or the data are damaged")
        at += n
    return (np.cumsum(out, axis=0) + 128).astype(np.uint8).T


def cuts(samples: np.ndarray) -> list[int]:
    """Frames that begin a new shot.

    The difference of two successive histograms must exceed FLOOR and the mean
    plus FACTOR standard deviations of the differences in the window before it.
    """
    n = len(samples)
    if n < 2:
        return []
    bins = (samples >> 4).astype(np.int64) + np.arange(n)[:, None] * HISTOGRAM_BINS
    hist = np.bincount(bins.ravel(), minlength=n * HISTOGRAM_BINS).reshape(n, HISTOGRAM_BINS)
    change = np.abs(np.diff(hist, axis=0)).sum(1)  # whole numbers: the same on every machine
    sums, squares = np.concatenate([[0], np.cumsum(change)]), np.concatenate([[0], np.cumsum(change * change)])
    i = np.arange(len(change))
    low = np.maximum(0, i - WINDOW)
    held = np.maximum(1, i - low)
    mean = (sums[i] - sums[low]) / held
    spread = np.sqrt(np.maximum(0.0, (squares[i] - squares[low]) / held - mean * mean))
    limit = np.maximum(FLOOR * 2 * samples.shape[1], mean + FACTOR * spread)
    return (np.flatnonzero(change > limit) + 1).tolist()


def _payload(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all padded payloads, frames of each)."""
    sizes = np.diff(offs)
    frames = np.maximum(1, -(-sizes // SAMPLES))
    out = np.full(int(frames.sum()) * SAMPLES, PAD, np.uint8)
    starts = (np.cumsum(frames) - frames) * SAMPLES
    for s, a, b in zip(starts.tolist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        out[s : s + b - a] = data[a:b]
    return out, frames


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as an AVI file."""
    small_batches(docs.sparkSession, 500)

    def task(batches):
        for batch in batches:
            if not len(batch):
                continue
            data, offs = utf8(batch.column(1))
            payload, frames = _payload(data, offs)
            encoded = encode_frames(payload)
            ends = np.cumsum(frames).tolist()
            media = [write_avi(encoded[e - n : e]) for e, n in zip(ends, frames.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id long, n_bytes long, media binary")


def _foreign(parts: list[bytes]) -> np.ndarray:
    """Samples of frames of any make, each decoded by itself; frames without bytes repeat the one before."""
    planes: list[np.ndarray] = []
    for f in parts:
        planes.append(planes[-1] if not f and planes else luma(f).ravel())
    if len({len(x) for x in planes}) > 1:
        raise ValueError("frames of one file differ in size")
    return np.stack(planes)


def _read(files: list[bytes | None]) -> list[tuple[np.ndarray | None, int, str | None]]:
    """(samples by frame, microseconds a frame, why there are none) of each file; frames as ``encode_frames`` writes them are decoded together."""
    out: list[tuple[np.ndarray | None, int, str | None]] = []
    own, parts = [], []
    for f in files:
        try:
            index, micros = read_index(f or b"")
            frames = [f[o : o + n] for o, n in index]
            if not frames:
                raise ValueError("no frames")
            if all(x.startswith(_frame_head()) for x in frames):
                own.append((len(out), len(frames)))
                parts += frames
                out.append((None, micros, None))
            else:
                out.append((_foreign(frames), micros, None))
        except (ValueError, struct.error, IndexError) as e:
            out.append((None, 0, str(e) or type(e).__name__))
    if own:
        try:
            samples = decode_frames(parts)
        except ValueError:  # one of them is damaged: each by itself
            samples = None
        at = 0
        for i, n in own:
            try:
                out[i] = (samples[at : at + n] if samples is not None else decode_frames(parts[at : at + n]), out[i][1], None)
            except ValueError as e:
                out[i] = (None, 0, str(e))
            at += n
    return out


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows: doc_id, clip_no, first_frame, frames, start_sec, end_sec, mean_level, problem (a file that can't be read is one row with the reason alone)."""

    def task(batches):
        for batch in batches:
            if not len(batch):
                continue
            rows: list[tuple] = []
            for doc, (samples, micros, problem) in zip(batch.column(0).to_pylist(), _read(batch.column(1).to_pylist()), strict=True):
                if samples is None:
                    rows.append((doc, *[None] * 6, problem))
                    continue
                edges = [0, *cuts(samples), len(samples)]
                rows += [(doc, i, a, b - a, a * micros / 1e6, b * micros / 1e6, float(samples[a:b].mean()), None) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            kinds = (*[pa.int64()] * 4, *[pa.float64()] * 3, pa.string())
            names = ["doc_id", "clip_no", "first_frame", "frames", "start_sec", "end_sec", "mean_level", "problem"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return media.select("doc_id", "media").mapInArrow(task, "doc_id long, clip_no long, first_frame long, frames long, start_sec double, end_sec double, mean_level double, problem string")


def features(media: DataFrame) -> DataFrame:
    """One row a file with what its stored bytes give back: payload digests and the shots (nulls and the reason for a file that can't be read)."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64() if c.endswith("long") else pa.string() for c in schema.split(", ")]

    def task(batches):
        for batch in batches:
            if not len(batch):
                continue
            cols: list[list] = [[] for _ in names]
            files = batch.column(2).to_pylist()
            for doc, n, file, (samples, _, problem) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), files, _read(files), strict=True):
                if samples is None:
                    for col, v in zip(cols, (doc, n, None, None, None, None if file is None else len(file), None if file is None else hashlib.sha256(file).hexdigest(), f"unreadable: {problem}"), strict=True):
                        col.append(v)
                    continue
                payload = samples.tobytes()
                found = cuts(samples)
                feature = f"frames={len(samples)};shots={len(found) + 1};cuts={','.join(map(str, found))};level={int(samples.sum(dtype=np.int64)) // samples.size}"
                row = (doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature)
                for col, v in zip(cols, row, strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(task, schema)


NAME = "op8_avi_mjpeg"
SQL = None  # a container format; tests make an exact round trip


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(table(spark, sf_dir, "documents")))
