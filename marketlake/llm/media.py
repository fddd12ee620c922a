"""Operator 1, media columns: AVI motion-JPEG in a binary column.

``encode_avi`` stores bytes as the luma samples of a motion-JPEG stream; ``probe_avi`` parses the RIFF index of
a stored AVI, decodes its intra frames and finds shots by adaptive histogram differences; ``clip_rows`` yields
one timed row per shot.

Lossless storage in a baseline JPEG: each sample is the DC term of one flat 8x8 block, quantized by 8, so that
a decoder gets the sample back in all 64 pixels. The Huffman table gives category c a code of 9 - c bits, which
makes every difference 9 bits and, with a one-bit end of block, every block 10 bits. A frame of 16 x 12 blocks
carries 192 samples. Reading knows nothing of this: it parses the index, reads each frame's own tables (the standard's where it has none), and
decodes frames without AC terms side by side and all others one by one.

Defined results: a null text counts as empty and an empty one as 192 blanks; a null AVI gives a struct of nulls; an AVI that
cannot be read gives a struct with ``error`` set and the other fields null; repeated rows give equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, small_batches

BLOCKS_W, BLOCKS_H, FPS = 16, 12, 25
FRAME = BLOCKS_W * BLOCKS_H
#: A cut needs a histogram difference of FLOOR samples and of FACTOR times the mean of the last WINDOW differences.
FLOOR, FACTOR, WINDOW, BINS = 24, 2, 8, 16


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header() -> bytes:
    dqt = bytes([0, 8] + [1] * 63)
    sof = struct.pack(">BHHB3B", 8, BLOCKS_H * 8, BLOCKS_W * 8, 1, 1, 0x11, 0)
    dc = bytes([0x00] + [1] * 9 + [0] * 7 + list(range(8, -1, -1)))
    ac = bytes([0x10, 1] + [0] * 15 + [0])
    sos = bytes([1, 1, 0x00, 0, 63, 0])
    parts = ((0xDB, dqt), (0xC0, sof), (0xC4, dc), (0xC4, ac), (0xDA, sos))
    return b"\xff\xd8" + b"".join(_segment(m, b) for m, b in parts)


HEADER = _header()


def _codes() -> np.ndarray:
    """The 10-bit block of each difference -255..255."""
    code = np.zeros(511, np.uint64)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        prefix = ((1 << (8 - c)) - 1) << 1
        extra = d if d > 0 else d + (1 << c) - 1
        code[d + 255] = ((prefix << c) | extra) << 1
    return code


CODE = _codes()


def frames_to_scans(samples: np.ndarray) -> list[bytes]:
    """Entropy-coded data of each row of ``samples`` (frames x 192)."""
    x = samples.astype(np.int16)
    before = np.empty_like(x)
    before[:, 0], before[:, 1:] = 128, x[:, :-1]
    four = CODE[x - before + 255].reshape(len(x), -1, 4)
    joined = (four[..., 0] << np.uint64(30)) | (four[..., 1] << np.uint64(20)) | (four[..., 2] << np.uint64(10)) | four[..., 3]
    packed = joined.astype(">u8").view(np.uint8).reshape(len(x), -1, 8)[:, :, 3:]
    return [row.tobytes().replace(b"\xff", b"\xff\x00") for row in packed]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(jpegs: list[bytes], width: int = BLOCKS_W * 8, height: int = BLOCKS_H * 8, fps: int = FPS) -> bytes:
    """An AVI of one motion-JPEG stream with an ``idx1`` index."""
    n, largest = len(jpegs), max(map(len, jpegs), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, n, 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    bodies = [_chunk(b"00dc", j) for j in jpegs]
    index, at = [], 4
    for j, b in zip(jpegs, bodies):
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(j)))
        at += len(b)
    movi = _chunk(b"LIST", b"movi" + b"".join(bodies))
    return _chunk(b"RIFF", b"AVI " + hdrl + movi + _chunk(b"idx1", b"".join(index)))


def bytes_to_avi(payload: bytes) -> bytes:
    """Stores a payload of whole frames."""
    scans = frames_to_scans(np.frombuffer(payload, np.uint8).reshape(-1, FRAME))
    return write_avi([HEADER + s + b"\xff\xd9" for s in scans])


def pad(data: bytes) -> bytes:
    return data.ljust(max(1, -(-len(data) // FRAME)) * FRAME, b" ")


def _chunks(data: bytes, at: int, end: int):
    """(name, list kind, body start, body end) of the chunks between two places."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        stop = min(at + 8 + size, end)
        yield name, data[at + 8 : at + 12] if name in (b"RIFF", b"LIST") else b"", at + 8, stop
        at += 8 + size + (size & 1)


_VIDEO = (b"00dc", b"00db")


def _walked(data: bytes, at: int, end: int) -> list[tuple[int, int]]:
    """Places of the video chunks of a movi list in file order; ``rec`` lists are entered."""
    found = []
    for name, kind, start, stop in _chunks(data, at, end):
        if name in _VIDEO:
            found.append((start, stop))
        elif kind == b"rec ":
            found += _walked(data, start + 4, stop)
    return found


def _standard_index(data: bytes, start: int) -> list[tuple[int, int]]:
    """Places that an OpenDML standard index (the body of an ``ix##`` chunk) lists."""
    n, base = struct.unpack_from("<I", data, start + 4)[0], struct.unpack_from("<Q", data, start + 12)[0]
    rows = np.frombuffer(data, "<u4", 2 * n, start + 24).reshape(-1, 2).astype(np.int64)
    return [(base + o, base + o + (size & 0x7FFFFFFF)) for o, size in rows.tolist()]


def parse_avi(data: bytes) -> tuple[list[bytes], float]:
    """The video chunks in index order (file order without an index) and the frames per second.

    The index is OpenDML's where there is one (a super index in the stream header, standard indexes in any RIFF part), else
    ``idx1``; without either, all movi lists of all parts are walked.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI")
    fps, movis, index, standard = 0.0, [], None, []
    for name, _, start, stop in _chunks(data, 0, len(data)):
        if name != b"RIFF":
            continue
        for name, kind, at, end in _chunks(data, start + 4, stop):
            if kind == b"hdrl":
                for name, kind, at, end in _chunks(data, at + 4, end):
                    if name == b"avih":
                        fps = 1e6 / max(1, struct.unpack_from("<I", data, at)[0])
                    elif kind == b"strl":
                        for name, _, inner, _ in _chunks(data, at + 4, end):
                            if name == b"indx" and data[inner + 8 : inner + 12] in _VIDEO and data[inner + 3] == 0:
                                n = struct.unpack_from("<I", data, inner + 4)[0]
                                standard += [struct.unpack_from("<Q", data, inner + 24 + 16 * i)[0] + 8 for i in range(n)]
            elif kind == b"movi":
                movis.append((at, end))
            elif name == b"idx1" and index is None:
                index = np.frombuffer(data, "<u4", (end - at) // 16 * 4, at).reshape(-1, 4)
    if not movis:
        raise ValueError("no movi list")
    if standard:
        places = [p for s in standard for p in _standard_index(data, s)]
    elif index is not None and len(movis) == 1 and len(index := index[np.isin(index[:, 0], np.frombuffer(b"".join(_VIDEO), "<u4"))]):
        base = 0 if index[0, 2] >= movis[0][0] else movis[0][0]
        places = [(base + o + 8, base + o + 8 + size) for o, size in index[:, 2:].tolist()]
    else:
        places = [p for at, end in movis for p in _walked(data, at + 4, end)]
    return [data[a:b] for a, b in places], fps


#: The zigzag order of the JPEG standard, built from its rule.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _idct_matrix() -> np.ndarray:
    k, n = np.mgrid[0:8, 0:8]
    return np.where(k == 0, np.sqrt(0.125), 0.5) * np.cos((2 * n + 1) * k * np.pi / 16)


IDCT = _idct_matrix()


def _huffman(counts: bytes, symbols: bytes) -> dict:
    """(length, code) to symbol, by the standard's rule."""
    table, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            table[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def _rest(first: list[int]) -> bytes:
    """The given AC symbols, then all others (run 0-15, size 1-10) in ascending order."""
    return bytes(first + [s for s in range(256) if 1 <= (s & 15) <= 10 and s not in first])


# The default Huffman tables of the JPEG standard, which frames of an AVI may leave out.
DEFAULT_TABLES = {
    0x00: ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], bytes(range(12))),
    0x01: ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], bytes(range(12))),
    0x10: ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], _rest([
        0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0,
        0x24, 0x33, 0x62, 0x72, 0x82, 0x09, 0x0A])),
    0x11: ([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], _rest([
        0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22, 0x32, 0x81, 0x08, 0x14, 0x42, 0x91, 0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0,
        0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1])),
}


@dataclass
class JpegHeader:
    """What the segments before a scan say."""

    quant: dict
    huff: dict
    restart: int
    comps: list
    scan: dict
    width: int
    height: int
    size: int


def read_header(data: bytes) -> JpegHeader:
    """The segments of a baseline JPEG up to its scan, which begins at ``size``."""
    at, quant, restart, comps, width, height = 2, {}, 0, [], 0, 0
    huff = {k: _huffman(*t) for k, t in DEFAULT_TABLES.items()}
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                quant[body[i] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, i + 1).astype(float)
                i += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                n = sum(body[i + 1 : i + 17])
                huff[body[i]] = _huffman(body[i + 1 : i + 17], body[i + 17 : i + 17 + n])
                i += 17 + n
        elif marker == 0xC0:
            height, width = struct.unpack_from(">HH", body, 1)
            comps = [(body[6 + 3 * c], body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(body[5])]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            scan = {body[1 + 2 * c]: body[2 + 2 * c] for c in range(body[0])}
            return JpegHeader(quant, huff, restart, comps, scan, width, height, at + 2 + size)
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("not a baseline JPEG")
        at += 2 + size


def _lookup(table: dict) -> tuple[np.ndarray, np.ndarray]:
    """Length (0 where there is no code) and symbol of the code that begins each 16-bit window."""
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for (n, code), s in table.items():
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
    return length, symbol


def decode_flat(head: JpegHeader, scans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Frames x blocks of luma for scans of one component whose blocks have no AC terms, and which frames those are.

    All frames are decoded side by side, block by block, with the tables of their header.
    """
    n, blocks = len(scans), -(-head.width // 8) * -(-head.height // 8)
    raw = [s.replace(b"\xff\x00", b"\xff") for s in scans]
    wide = max(map(len, raw)) + 8
    padded = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in raw), np.uint8).reshape(n, wide)
    # Five bytes from each place on, so that any 32 bits are one shift away.
    five = np.zeros((n, wide - 4), np.uint64)
    for i in range(5):
        five |= padded[:, i : wide - 4 + i].astype(np.uint64) << np.uint64(32 - 8 * i)
    five = five.ravel()
    ident, _, _, q = head.comps[0]
    (dc_length, dc_symbol), (ac_length, ac_symbol) = (_lookup(head.huff[k]) for k in (head.scan[ident] >> 4, 0x10 | head.scan[ident] & 15))
    base, end = np.arange(n) * (wide - 4), np.array([8 * len(s) for s in raw])
    pos, last, good = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    out = np.zeros((n, blocks), np.int64)

    def bits(at: np.ndarray) -> np.ndarray:
        """The 32 bits from each frame's place on."""
        place = np.minimum(at, end)
        return (five[base + (place >> 3)] >> (np.uint64(8) - (place & 7).astype(np.uint64))) & np.uint64(0xFFFFFFFF)

    for b in range(blocks):
        window = bits(pos)
        code = (window >> np.uint64(16)).astype(np.int64)
        size = dc_symbol[code]
        good &= (dc_length[code] > 0) & (size <= 11)
        size = np.minimum(size, 11)
        value = ((window << dc_length[code].astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64) >> (32 - size)
        last += np.where(size == 0, 0, np.where(value >> np.maximum(size - 1, 0) > 0, value, value - (1 << size) + 1))
        pos += dc_length[code] + size
        code = (bits(pos) >> np.uint64(16)).astype(np.int64)
        good &= (ac_length[code] > 0) & (ac_symbol[code] == 0)
        pos += ac_length[code]
        out[:, b] = last
    good &= pos <= end
    return np.clip(np.rint(out * (head.quant[q][0] / 8) + 128), 0, 255).astype(np.uint8), good


def decode_jpeg(data: bytes) -> np.ndarray:
    """The luma plane of a baseline JPEG (any Huffman tables, sampling factors and restart intervals)."""
    head = read_header(data)
    quant, huff, restart, comps, scan, width, height, at = head.quant, head.huff, head.restart, head.comps, head.scan, head.width, head.height, head.size
    end = data.rfind(b"\xff\xd9")
    entropy = data[at : end if end >= at else len(data)]
    most_h, most_v = max(c[1] for c in comps), max(c[2] for c in comps)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    _, luma_h, luma_v, _ = comps[0]
    plane = np.zeros((down * luma_v * 8, across * luma_h * 8))
    segments, unit = [], 0
    start = 0
    for i in range(len(entropy) - 1):
        if entropy[i] == 0xFF and 0xD0 <= entropy[i + 1] <= 0xD7:
            segments.append(entropy[start:i])
            start = i + 2
    segments.append(entropy[start:])
    for piece in segments:
        piece = piece.replace(b"\xff\x00", b"\xff")
        bits, n = int.from_bytes(piece, "big"), len(piece) * 8
        pos, last = 0, dict.fromkeys((c[0] for c in comps), 0)

        def take(k: int) -> int:
            nonlocal pos
            pos += k
            if pos > n:
                raise ValueError("scan ends early")
            return (bits >> (n - pos)) & ((1 << k) - 1)

        def symbol(table: dict) -> int:
            code = 0
            for length in range(1, 17):
                code = (code << 1) | take(1)
                if (length, code) in table:
                    return table[length, code]
            raise ValueError("bad Huffman code")

        def signed(k: int) -> int:
            v = take(k) if k else 0
            return v if not k or v >> (k - 1) else v - (1 << k) + 1

        for _ in range(restart or across * down):
            if unit >= across * down:
                break
            for ident, h, v, q in comps:
                dc, ac = huff[scan[ident] >> 4], huff[0x10 | (scan[ident] & 15)]
                for b in range(h * v):
                    block = np.zeros(64)
                    last[ident] += signed(symbol(dc))
                    block[0] = last[ident]
                    k = 1
                    while k < 64:
                        rs = symbol(ac)
                        if not rs & 15 and rs != 0xF0:
                            break
                        k += rs >> 4
                        if rs & 15:
                            block[ZIGZAG[k]] = signed(rs & 15) * quant[q][k]
                        k += 1
                    block[0] *= quant[q][0]
                    if ident == comps[0][0]:
                        y, x = (unit // across * v + b // h) * 8, (unit % across * h + b % h) * 8
                        plane[y : y + 8, x : x + 8] = IDCT.T @ block.reshape(8, 8) @ IDCT
            unit += 1
    return np.clip(np.rint(plane + 128), 0, 255).astype(np.uint8)[:height, :width]


def _block_means(jpeg: bytes) -> np.ndarray:
    p = decode_jpeg(jpeg)
    p = np.pad(p, ((0, -p.shape[0] % 8), (0, -p.shape[1] % 8)), mode="edge")
    return np.rint(p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).mean(axis=(1, 3))).astype(np.uint8).ravel()


#: Frames that are decoded side by side at most.
SIDE_BY_SIDE = 8192
_READABLE = (ValueError, KeyError, IndexError, struct.error)


def decode_all(streams: list[list[bytes]]) -> list[np.ndarray | Exception]:
    """Frames x samples of each stream, or why it cannot be read: a sample is the mean luma of an 8x8 block.

    Frames of equal headers, whatever their stream, are decoded side by side while their blocks are flat, others one by one.
    """
    groups: dict[bytes, list[tuple[int, int]]] = {}
    heads: dict[bytes, JpegHeader] = {}
    out: list = [[None] * len(s) for s in streams]
    failed: dict[int, Exception] = {}
    for d, jpegs in enumerate(streams):
        for i, j in enumerate(jpegs):
            known = next((h for h in heads if j.startswith(h)), None)
            if known is None:
                try:
                    head = read_header(j)
                except _READABLE as e:
                    failed[d] = e
                    break
                known = j[: head.size]
                heads[known] = head
            groups.setdefault(known, []).append((d, i))
    for common, places in groups.items():
        head = heads[common]
        if len(head.comps) != 1 or head.restart:
            continue
        for at in range(0, len(places), SIDE_BY_SIDE):
            part = [(d, i) for d, i in places[at : at + SIDE_BY_SIDE] if d not in failed]
            scans = [j[head.size : k if (k := j.rfind(b"\xff\xd9")) >= head.size else len(j)] for j in (streams[d][i] for d, i in part)]
            if scans and head.scan.keys() >= {head.comps[0][0]} and head.comps[0][3] in head.quant:
                for (d, i), row, ok in zip(part, *decode_flat(head, scans)):
                    out[d][i] = row if ok else None
    for d, jpegs in enumerate(streams):
        try:
            if d not in failed:
                rows = [_block_means(j) if r is None else r for r, j in zip(out[d], jpegs)]
                out[d] = np.stack(rows) if rows else np.zeros((0, FRAME), np.uint8)
        except _READABLE as e:
            failed[d] = e
    return [failed.get(d, rows) for d, rows in enumerate(out)]


def decode_frames(jpegs: list[bytes]) -> np.ndarray:
    """Frames x samples of one stream."""
    found = decode_all([jpegs])[0]
    if isinstance(found, Exception):
        raise found
    return found


def find_cuts(frames: np.ndarray) -> list[int]:
    """Frames that begin a new shot: the histogram difference to the frame before stands out of the last ones."""
    n = len(frames)
    if n < 2:
        return []
    cell = np.arange(n)[:, None] * BINS + (frames >> 4)
    hist = np.bincount(cell.ravel(), minlength=n * BINS).reshape(n, BINS)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) // 2
    total = np.concatenate(([0], np.cumsum(diff)))
    at = np.arange(n - 1)
    first = np.maximum(0, at - WINDOW)
    seen = at - first
    return (1 + np.flatnonzero((diff >= FLOOR) & (diff * seen >= FACTOR * (total[at] - total[first])))).tolist()


CLIP = T.StructType(
    [T.StructField("clip", T.IntegerType()), T.StructField("start_frame", T.IntegerType()), T.StructField("end_frame", T.IntegerType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())]
)
PROBE = T.StructType(
    [T.StructField("frames", T.IntegerType()), T.StructField("fps", T.DoubleType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType())]
    + [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("clips", T.ArrayType(CLIP))]
    + [T.StructField("feature", T.StringType()), T.StructField("error", T.StringType())]
)


def probe_all(media: list[bytes | None]) -> list[dict]:
    """The fields of ``PROBE`` of each AVI; all are null for a null one."""
    none = dict.fromkeys(PROBE.fieldNames())
    parsed: list = []
    for data in media:
        try:
            parsed.append(parse_avi(data) if data is not None else ([], 0.0))
        except _READABLE as e:
            parsed.append(e)
    frames = decode_all([[] if isinstance(p, Exception) else p[0] for p in parsed])
    out = []
    for data, p, f in zip(media, parsed, frames):
        out.append(none if data is None else _fields(data, p, 0.0) if isinstance(p, Exception) else _fields(data, f, p[1]))
    return out


def _fields(data: bytes, frames: np.ndarray | Exception, fps: float) -> dict:
    out: dict = dict.fromkeys(PROBE.fieldNames()) | {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
    if isinstance(frames, Exception):
        return out | {"error": str(frames) or type(frames).__name__}
    payload, cuts = frames.tobytes(), find_cuts(frames)
    edges = [0, *cuts, len(frames)]
    clips = [
        {"clip": i, "start_frame": a, "end_frame": b, "start_s": a / fps if fps else None, "end_s": b / fps if fps else None}
        for i, (a, b) in enumerate(zip(edges, edges[1:]))
        if b > a
    ]
    feature = f"frames={len(frames)};shots={len(clips)};cuts={','.join(map(str, cuts))}"
    return out | {
        "frames": len(frames), "fps": fps, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-16:]), "clips": clips, "feature": feature,
    }


@F.pandas_udf(T.BinaryType())
def encode_avi(text: pd.Series) -> pd.Series:
    return pd.Series([bytes_to_avi(pad((t or "").encode())) for t in text])


@F.pandas_udf(PROBE)
def probe_avi(avi: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(probe_all(list(avi)), columns=PROBE.fieldNames()).astype(
        {"frames": "Int32", "media_bytes": "Int64", "payload_bytes": "Int64", "tail_crc32": "Int64"}
    )


def with_media(df: DataFrame, text: str | Column, to: str = "media") -> DataFrame:
    """Adds the AVI of a text column."""
    return df.withColumn(to, encode_avi(F.col(text) if isinstance(text, str) else text))


def clip_rows(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per shot of the AVI column: clip, start_frame, end_frame, start_s, end_s, beside the ``keep`` columns."""
    probed = df.select(*keep, probe_avi(F.col(media)).alias("_probe"))
    return probed.select(*keep, F.inline("_probe.clips"))


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    probed = read(spark, sf_dir, "documents").select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), probe_avi(encode_avi("text")).alias("m")
    )
    fields = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return probed.select("doc_id", "n_bytes", *(F.col(f"m.{c}").alias(c) for c in fields), F.size("m.clips").alias("n_clips"))
