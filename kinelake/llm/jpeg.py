"""Baseline JPEG frames of any make: the luma plane as 8-bit samples.

Huffman-coded sequential frames (SOF0, and SOF1 with 8 bits) of one or three
components, any sampling factors, tables and restart intervals. Coefficients are
read block by block; dequantisation and the inverse transform are two matrix
products over all blocks. What is not such a frame raises ``ValueError``.
"""

from __future__ import annotations

import struct

import numpy as np


def canonical_codes(bits, values) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), by the canonical rule of the format."""
    out, code, i = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out[values[i]] = (code, length)
            code, i = code + 1, i + 1
        code <<= 1
    return out


def huffman_tables(body: bytes) -> dict[int, dict[int, tuple[int, int]]]:
    """Class and number -> codes, of one DHT segment."""
    out, i = {}, 0
    while i < len(body):
        n = sum(body[i + 1 : i + 17])
        out[body[i]] = canonical_codes(body[i + 1 : i + 17], body[i + 17 : i + 17 + n])
        i += 17 + n
    return out


def _zigzag() -> np.ndarray:
    """Place in an 8x8 block of each coefficient in the order of the file: along the diagonals, turning at the edges."""
    return np.array(sorted(range(64), key=lambda p: (s := p // 8 + p % 8, p // 8 if s % 2 else p % 8)))


ZIGZAG = _zigzag()
_K = np.arange(8)
#: Row u: the u-th cosine at the eight places of a block.
BASIS = np.where(_K[:, None] == 0, np.sqrt(1 / 8), np.sqrt(1 / 4)) * np.cos((2 * _K[None] + 1) * _K[:, None] * np.pi / 16)


class _Bits:
    """The entropy-coded bytes of one restart interval."""

    def __init__(self, data: bytes):
        self.data, self.at, self.hold, self.held = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.held < n:
            more = self.data[self.at : self.at + 4]
            self.at += 4
            self.hold = (self.hold & (1 << self.held) - 1) << 32 | int.from_bytes(more.ljust(4, b"\xff"), "big")
            self.held += 32
            if self.at > len(self.data) + 64:
                raise ValueError("the data of a frame end early")

    def symbol(self, table: list[int]) -> int:
        self.need(16)
        entry = table[self.hold >> self.held - 16 & 0xFFFF]
        if entry < 0:
            raise ValueError("a code that is in no table")
        self.held -= entry >> 8
        return entry & 255

    def extra(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.held -= n
        v = self.hold >> self.held & (1 << n) - 1
        return v if v >> n - 1 else v - (1 << n) + 1


def _lookup(codes: dict[int, tuple[int, int]]) -> list[int]:
    """length << 8 | symbol by the next 16 bits; -1 where no code begins so."""
    out = [-1] * (1 << 16)
    for symbol, (code, length) in codes.items():
        low = code << 16 - length
        out[low : low + (1 << 16 - length)] = [length << 8 | symbol] * (1 << 16 - length)
    return out


def _segments(data: bytes):
    """(marker, body, where the body ends) up to the scan."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("not a JPEG frame")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        yield marker, data[at + 4 : at + 2 + size], at + 2 + size
        at += 2 + size
        if marker == 0xDA:
            return


def luma(data: bytes) -> np.ndarray:
    """The first component (height x width, uint8)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    quant: dict[int, np.ndarray] = {}
    tables: dict[int, list[int]] = {}
    frame = scan = None
    restart, begin = 0, 0
    for marker, body, end in _segments(data):
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                quant[body[i] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, i + 1).astype(np.float64)
                i += 65 + 64 * (wide > 0)
        elif marker in (0xC0, 0xC1):
            depth, high, across, n = struct.unpack_from(">BHHB", body)
            frame = (high, across, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)])
            if depth != 8 or not high or not across:
                raise ValueError("only 8-bit frames of a known size are decoded")
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif marker == 0xC4:
            tables |= {k: _lookup(v) for k, v in huffman_tables(body).items()}
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            scan, begin = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}, end
    if frame is None or scan is None or any(c not in scan for c, *_ in frame[2]):
        raise ValueError("a frame without its parts in one scan")
    high, across, parts = frame
    if any(t not in quant for *_, t in parts) or any(k not in tables for s in scan.values() for k in (s >> 4, 0x10 | s & 15)):
        raise ValueError("a frame without its tables")
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    mcus_across, mcus = -(-across // (8 * most_h)), -(-across // (8 * most_h)) * -(-high // (8 * most_v))
    own_h, own_v = parts[0][1:3]
    stride = mcus_across * own_h
    blocks = np.zeros((mcus // mcus_across * own_v * stride, 64))
    intervals = _intervals(data[begin:])
    order = ZIGZAG.tolist()
    bits, last = _Bits(next(intervals)), [0] * len(parts)
    for m in range(mcus):
        if restart and m and m % restart == 0:
            bits, last = _Bits(next(intervals, b"")), [0] * len(parts)
        for p, (c, h, v, _) in enumerate(parts):
            dc, ac = tables[scan[c] >> 4], tables[0x10 | scan[c] & 15]
            for y in range(v):
                for x in range(h):
                    last[p] += bits.extra(bits.symbol(dc))
                    found, k = [(0, last[p])], 1
                    while k < 64:
                        s = bits.symbol(ac)
                        if not s & 15:
                            if s != 0xF0:
                                break
                            k += 16
                            continue
                        k += s >> 4
                        if k > 63:
                            raise ValueError("a block with too many coefficients")
                        found.append((k, bits.extra(s & 15)))
                        k += 1
                    if not p:
                        row = blocks[(m // mcus_across * own_v + y) * stride + m % mcus_across * own_h + x]
                        for k, value in found:
                            row[order[k]] = value
    steps = np.zeros(64)
    steps[ZIGZAG] = quant[parts[0][3]]
    values = BASIS.T @ (blocks * steps).reshape(-1, 8, 8) @ BASIS
    plane = values.reshape(-1, stride, 8, 8).transpose(0, 2, 1, 3).reshape(-1, stride * 8)
    own_high, own_across = -(-high * own_v // most_v), -(-across * own_h // most_h)
    return np.clip(np.rint(plane[:own_high, :own_across] + 128), 0, 255).astype(np.uint8)


def _intervals(data: bytes):
    """The bytes between restart markers, without stuffing, up to the next other marker."""
    at = start = 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            yield data[start:].replace(b"\xff\x00", b"\xff")
            return
        follows = data[at + 1]
        if follows == 0 or follows == 0xFF:
            at += 2 if follows == 0 else 1
            continue
        yield data[start:at].replace(b"\xff\x00", b"\xff")
        if not 0xD0 <= follows <= 0xD7:
            return
        at = start = at + 2
