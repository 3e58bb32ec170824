"""AVI motion-JPEG columns: write and parse RIFF files, decode their intra frames, detect shots.

Frames are baseline JPEG. The decoder takes any Huffman and quantisation tables, one to four interleaved components
with their sampling, restart intervals, and the usual tables where a frame, as AVI allows, leaves them out. It decodes
all restart intervals of a batch of frames side by side, one symbol of each at a time.

Bytes are stored losslessly in the format's own unit: a byte less 128 is a quantised coefficient, 64 of them in zigzag
order a block, and entropy coding keeps coefficients exactly. Shots are found where the luma histogram's difference to
the frame before is large against those of the shot so far.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SIDE, INTERVAL, FPS = 32, 4, 25
BLOCKS = (SIDE // 8) ** 2
_BATCH = 1 << 20

# The typical Huffman tables of ITU-T T.81, annex K (code counts by length, then symbols).
DC_LUMA = (bytes.fromhex("00010501010101010100000000000000"), bytes(range(12)))
DC_CHROMA = (bytes.fromhex("00030101010101010101010000000000"), bytes(range(12)))
AC_LUMA = (
    bytes.fromhex("0002010303020403050504040000017d"),
    bytes.fromhex(
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a43444546474849"
        "4a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5"
        "c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
    ),
)
AC_CHROMA = (
    bytes.fromhex("00020102040403040705040400010277"),
    bytes.fromhex(
        "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a"
        "535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5"
        "c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
    ),
)
TABLES = {(0, 0): DC_LUMA, (0, 1): DC_CHROMA, (1, 0): AC_LUMA, (1, 1): AC_CHROMA}


@lru_cache(maxsize=64)
def codes(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) of each symbol of a Huffman table; length 0 where it has none."""
    code, length, c, at = np.zeros(256, np.uint64), np.zeros(256, np.int64), 0, 0
    for size, n in enumerate(table[0], 1):
        for s in table[1][at : at + n]:
            code[s], length[s] = c, size
            c += 1
        c <<= 1
        at += n
    return code, length


@lru_cache(maxsize=64)
def lookup(table: tuple[bytes, bytes]) -> np.ndarray:
    """length x 256 + symbol by the next 16 bits; 0 where no code fits."""
    out = np.zeros(1 << 16, np.int32)
    code, length = codes(table)
    for s in np.flatnonzero(length).tolist():
        first, size = int(code[s]) << (16 - int(length[s])), 1 << (16 - int(length[s]))
        out[first : first + size] = int(length[s]) * 256 + s
    return out


@lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


@lru_cache(maxsize=1)
def basis() -> np.ndarray:
    """(zigzag coefficient, pixel) of the inverse cosine transform in integers, scaled by 4096, so that sums are exact."""
    k = np.arange(8)
    one = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)[:, None]
    two = np.einsum("ur,vc->uvrc", one, one).reshape(64, 64)
    return np.round(two * 4096)[zigzag()]


# --- JPEG frames -----------------------------------------------------------------------------------------


class Header(NamedTuple):
    """What precedes a frame's scan; parts lists a block's (component, DC table, AC table) for each block of an MCU."""

    size: int
    height: int
    width: int
    sampling: tuple[tuple[int, int], ...]
    quantisers: tuple[tuple[int, ...], ...]
    parts: tuple[tuple[int, tuple[bytes, bytes], tuple[bytes, bytes]], ...]
    interval: int

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = max(s[0] for s in self.sampling), max(s[1] for s in self.sampling)
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))


def header(data: bytes) -> Header:
    """Parse the segments up to the scan. Raises ValueError for anything but baseline JPEG with one interleaved scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at, tables, quantisers, frame, interval = 2, dict(TABLES), {}, None, 0
    while True:
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
            at += 1
        if len(data) < at + 4 or data[at] != 0xFF:
            raise ValueError("broken JPEG segment")
        kind, n = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                m = 128 if wide else 64
                quantisers[k] = tuple(struct.unpack(">64H", body[1 : 1 + m])) if wide else tuple(body[1 : 1 + m])
                body = body[1 + m :]
        elif kind == 0xC4:
            while body:
                m = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = (bytes(body[1:17]), bytes(body[17 : 17 + m]))
                body = body[17 + m :]
        elif kind == 0xC0:
            frame = body
        elif 0xC1 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
            raise ValueError("not a baseline frame")
        elif kind == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif kind == 0xDA:
            break
    if frame is None or frame[0] != 8:
        raise ValueError("no 8-bit frame header")
    height, width, n = struct.unpack(">HHB", frame[1:6])
    parts, sampling, used = [], [], []
    scan = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    for i in range(n):
        name, hv, q = frame[6 + 3 * i : 9 + 3 * i]
        if name not in scan:
            raise ValueError("the scan lacks a component")
        h, v = (hv >> 4, hv & 15) if n > 1 else (1, 1)
        sampling.append((h, v))
        used.append(quantisers[q])
        parts += [(i, tables[0, scan[name] >> 4], tables[1, scan[name] & 15])] * (h * v)
    if not height or not width:
        raise ValueError("an empty frame")
    return Header(at, height, width, tuple(sampling), tuple(used), tuple(parts), interval)


def decode_scans(frames: list[bytes], heads: list[Header]) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (block, zigzag place) of frames with equal ``parts``, frame after frame, MCU after MCU,
    and which frames are whole."""
    parts = heads[0].parts
    per = len(parts)
    bodies = [f[h.size : -2] if f.endswith(b"\xff\xd9") else f[h.size :] for f, h in zip(frames, heads, strict=True)]
    raw = np.frombuffer(b"".join(b + b"\xff\xd9" for b in bodies), np.uint8)
    ends = np.cumsum([len(b) + 2 for b in bodies])
    starts = ends - [len(b) + 2 for b in bodies]
    ff = np.flatnonzero(raw[:-1] == 255)
    after = raw[ff + 1]
    keep = np.ones(len(raw), bool)
    keep[ff[after == 0] + 1] = False
    keep[ff[after == 255]] = False
    rst = ff[(after & 0xF8) == 0xD0]
    keep[rst] = keep[rst + 1] = False
    place = np.concatenate([[0], np.cumsum(keep)])
    total = np.array([h.mcus[0] * h.mcus[1] for h in heads])
    each = np.array([h.interval or t for h, t in zip(heads, total.tolist(), strict=True)])
    lanes = -(-total // each)
    found = np.searchsorted(rst, ends) - np.searchsorted(rst, starts)
    good = found == lanes - 1
    if not good.any():
        return np.zeros((int(total.sum()) * per, 64), np.int32), good
    which = np.repeat(np.arange(len(frames)), np.where(good, lanes, 0))
    begin = np.sort(np.concatenate([starts[good], rst[good[np.searchsorted(ends, rst, side="right")]] + 2]))
    index = np.arange(len(which)) - np.repeat(np.cumsum(np.where(good, lanes, 0)) - np.where(good, lanes, 0), np.where(good, lanes, 0))
    first = (np.cumsum(total) - total)[which] + index * each[which]
    blocks = np.minimum(each[which], total[which] - index * each[which]) * per
    data = np.concatenate([raw[keep], np.zeros(16, np.uint8)])
    windows = np.zeros(len(data) - 8, np.uint64)
    for k in range(8):
        windows = (windows << np.uint64(8)) | data[k : k + len(windows)]
    distinct = list(dict.fromkeys(t for _, dc, ac in parts for t in (dc, ac)))
    luts = np.concatenate([lookup(t) for t in distinct])
    dc = np.array([distinct.index(p[1]) << 16 for p in parts])
    ac = np.array([distinct.index(p[2]) << 16 for p in parts])
    component = np.array([p[0] for p in parts])
    out = np.zeros(int(total.sum()) * per * 64, np.int32)
    bit, block, last = place[begin] * 8, first * per, first * per + blocks
    limit = place[ends - 2][which] * 8
    predicted = np.zeros((len(which), int(component.max()) + 1), np.int32)
    k, part, lane = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64), np.arange(len(which))
    while len(lane):
        isdc = k == 0
        v = windows[bit >> 3] << (bit & 7).astype(np.uint64)
        got = luts[np.where(isdc, dc[part], ac[part]) + (v >> np.uint64(48)).astype(np.int64)]
        length, symbol = got >> 8, got & 255
        size, run = symbol & 15, np.where(isdc, 0, symbol >> 4)
        bits = ((v << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where(bits < (1 << size) >> 1, bits - (1 << size) + 1, bits)
        value[size == 0] = 0
        bit += length + size
        if isdc.any():
            at = np.flatnonzero(isdc)
            own = component[part[at]]
            predicted[lane[at], own] += value[at].astype(np.int32)
            value[at] = predicted[lane[at], own]
        to = k + run
        bad = (length == 0) | (to > 63) | (bit > limit)
        if bad.any():
            good[which[lane[bad]]] = False
            to = np.minimum(to, 63)
        write = isdc | (size > 0)
        out[(block * 64 + to)[write]] = value[write]
        k = np.where(isdc, 1, np.where(size > 0, to + 1, np.where(symbol == 0xF0, to + 1, 64)))
        done = k >= 64
        if done.any():
            block = block + done
            k[done] = 0
            part = np.where(done, (part + 1) % per, part)
        over = bad | (block >= last)
        if over.any():
            on = ~over
            bit, block, last, k, part, lane, limit = bit[on], block[on], last[on], k[on], part[on], lane[on], limit[on]
    return out.reshape(-1, 64), good


def encode_frames(coefficients: np.ndarray) -> list[bytes]:
    """JPEG frames, without Huffman tables, of (frame, block, zigzag place) quantised coefficients of one component."""
    frames, n, _ = coefficients.shape
    c = coefficients.reshape(-1, 64).astype(np.int64)
    dc = c[:, 0].reshape(-1, INTERVAL)
    c = c.copy()
    c[:, 0] = np.diff(dc, axis=1, prepend=0).ravel()
    size = np.frexp(np.abs(c).astype(np.float64))[1].astype(np.int64)
    amplitude = np.where(c < 0, c + (1 << size) - 1, c).astype(np.uint64)
    place = np.arange(64)
    filled = np.where(c != 0, place, 0)
    filled[:, 0] = 0
    before = np.zeros_like(filled)
    before[:, 1:] = np.maximum.accumulate(filled, axis=1)[:, :-1]
    run = place - before - 1
    (dc_code, dc_length), (ac_code, ac_length) = codes(DC_LUMA), codes(AC_LUMA)
    symbol = ((run & 15) << 4) | size
    symbol[:, 0] = 0
    value, length = ac_code[symbol], ac_length[symbol]
    value[:, 0], length[:, 0] = dc_code[size[:, 0]], dc_length[size[:, 0]]
    zrl = np.where((c != 0) & (place > 0), run >> 4, 0)
    for k in range(3):
        more = zrl > k
        if more.any():
            value[more] |= ac_code[0xF0] << (length[more].astype(np.uint64))
            length[more] += ac_length[0xF0]
    value = (value << size.astype(np.uint64)) | amplitude
    length = length + size
    empty = c == 0
    empty[:, 0] = False
    length[empty] = 0
    grid_v = np.zeros((len(c), 65), np.uint64)
    grid_l = np.zeros((len(c), 65), np.int64)
    grid_v[:, :64], grid_l[:, :64] = value, length
    ends = c[:, 63] == 0
    grid_v[ends, 64], grid_l[ends, 64] = ac_code[0], ac_length[0]
    wide = INTERVAL * 65
    v = np.zeros((len(c) // INTERVAL, wide + 1), np.uint64)
    w = np.zeros((len(c) // INTERVAL, wide + 1), np.int64)
    v[:, :wide], w[:, :wide] = grid_v.reshape(-1, wide), grid_l.reshape(-1, wide)
    w[:, wide] = -w.sum(1) % 8
    v[:, wide] = (1 << w[:, wide]) - 1
    octets = w.sum(1) // 8
    begin = np.cumsum(octets) - octets
    bit = (np.cumsum(w, axis=1) - w + 8 * begin[:, None]).ravel()
    v, w = v.ravel(), w.ravel()
    some = w > 0
    v, w, bit = v[some], w[some], bit[some]
    word, room = bit >> 6, 64 - (bit & 63) - w
    words = np.zeros(int(octets.sum()) // 8 + 3, np.uint64)
    high = np.where(room >= 0, v << np.maximum(room, 0).astype(np.uint64), v >> np.maximum(-room, 0).astype(np.uint64))
    cut = np.append(0, np.flatnonzero(np.diff(word)) + 1)
    words[word[cut]] = np.add.reduceat(high, cut)
    split = np.flatnonzero(room < 0)
    words[word[split] + 1] += v[split] << (64 + room[split]).astype(np.uint64)
    data = words.byteswap().view(np.uint8)[: int(octets.sum())]
    times = 1 + (data == 255)
    stuffed = np.repeat(data, times)
    after = np.cumsum(times)
    stuffed[after[times == 2] - 1] = 0
    offset = np.append(0, after)[np.append(begin, len(data))].tolist()
    raw, per = stuffed.tobytes(), n // INTERVAL
    start, out = frame_header(SIDE, SIDE), []
    for f in range(frames):
        parts = [start]
        for i in range(per):
            a = f * per + i
            parts += [raw[offset[a] : offset[a + 1]], b"\xff" + bytes([0xD0 + i % 8]) if i < per - 1 else b"\xff\xd9"]
        out.append(b"".join(parts))
    return out


@lru_cache(maxsize=4)
def frame_header(height: int, width: int) -> bytes:
    """Segments of a frame of one component, quantised by 1, with restart intervals, up to its scan."""
    quantiser = b"\xff\xdb" + struct.pack(">HB", 67, 0) + b"\x01" * 64
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\x01\x11\x00"
    return b"\xff\xd8" + quantiser + frame + b"\xff\xdd" + struct.pack(">HH", 4, INTERVAL) + b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00\x00\x3f\x00"


def luma(coefficients: np.ndarray, head: Header) -> np.ndarray:
    """Pixels (block, 64) of the first component's blocks, in the order of MCUs."""
    own = coefficients.reshape(-1, len(head.parts), 64)[:, [i for i, p in enumerate(head.parts) if p[0] == 0]].reshape(-1, 64)
    sums = (own * np.array(head.quantisers[0])).astype(np.float64) @ basis()
    return np.clip(np.floor((sums + 2048) / 4096) + 128, 0, 255).astype(np.uint8)


# --- AVI files -------------------------------------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], n_bytes: int, side: int = SIDE, fps: int = FPS) -> bytes:
    """An AVI file of one motion-JPEG stream with an idx1 index; the stream's driver data hold ``n_bytes``."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, side, side, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    stream = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", n_bytes)))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(c)
        at += len(c)
    body = b"AVI " + _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + stream) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


class Video(NamedTuple):
    frames: list[bytes]
    fps: float
    n_bytes: int | None


def read_avi(data: bytes) -> Video:
    """Frames of the first video stream, by its indexes: OpenDML standard indexes, else idx1, else the chunks in turn.

    Raises ValueError if it isn't an AVI file or an index points outside it.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    movi, old, wide, chunks, state = 0, b"", [], [], {"fps": float(FPS), "n": None, "streams": 0, "video": None}

    def walk(at: int, end: int) -> None:
        nonlocal movi, old
        while at + 8 <= end:
            name, (n,) = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])
            body = at + 8
            if body + n > len(data):
                raise ValueError("a chunk is cut off")
            if name in (b"LIST", b"RIFF"):
                if data[body : body + 4] == b"movi":
                    movi = movi or body
                walk(body + 4, body + n)
            elif name == b"strh":
                state["streams"] += 1
                if data[body : body + 4] == b"vids" and state["video"] is None:
                    state["video"] = state["streams"] - 1
                    scale, rate = struct.unpack("<II", data[body + 20 : body + 28])
                    state["fps"] = rate / scale if scale and rate else float(FPS)
            elif name == b"strd" and n >= 8 and state["video"] == state["streams"] - 1:
                (state["n"],) = struct.unpack("<Q", data[body : body + 8])
            elif name == b"idx1":
                old = data[body : body + n]
            elif name[:2] == b"ix":
                wide.append((name, body))
            elif name[2:] in (b"dc", b"db"):
                chunks.append((name, body, n))
            at = body + n + (n & 1)

    walk(12, min(len(data), 8 + struct.unpack("<I", data[4:8])[0]))
    if len(data) > (more := 8 + struct.unpack("<I", data[4:8])[0]) and data[more : more + 4] == b"RIFF":
        walk(more, len(data))
    stream = b"%02d" % (state["video"] or 0)
    spans: list[tuple[int, int]] = []
    for name, body in wide:
        if name[2:] == stream:
            per, _, _, count = struct.unpack("<HBBI", data[body : body + 8])
            (base,) = struct.unpack("<Q", data[body + 12 : body + 20])
            for i in range(count):
                offset, n = struct.unpack("<II", data[body + 24 + 4 * per * i : body + 32 + 4 * per * i])
                spans.append((base + offset, n & 0x7FFFFFFF))
    if not spans and old:
        entries = [e for e in struct.iter_unpack("<4sIII", old[: len(old) // 16 * 16]) if e[0][:2] == stream and e[0][2:] in (b"dc", b"db")]
        base = movi if entries and data[movi + entries[0][2] : movi + entries[0][2] + 4] == entries[0][0] else 0
        spans = [(base + at + 8, n) for _, _, at, n in entries]
    if not spans:
        spans = [(body, n) for name, body, n in chunks if name[:2] == stream]
    if any(a + n > len(data) for a, n in spans):
        raise ValueError("an index points outside the file")
    return Video([data[a : a + n] for a, n in spans], state["fps"], state["n"])


# --- shots -----------------------------------------------------------------------------------------------


def shots(histograms: np.ndarray, factor: int = 2, floor: float = 0.125) -> list[tuple[int, int]]:
    """(first, last) frame of each shot.

    A shot ends where the absolute histogram difference exceeds ``factor`` times the mean of the differences within
    the shot so far, and ``floor`` of the frame's pixels.
    """
    out, start, total, count = [], 0, 0, 0
    pixels = histograms.sum(1)
    for t in range(1, len(histograms)):
        d = int(np.abs(histograms[t] - histograms[t - 1]).sum())
        if d > floor * int(pixels[t]) and (not count or d * count > factor * total) and count + (t - start) > 1:
            out.append((start, t - 1))
            start, total, count = t, 0, 0
        else:
            total, count = total + d, count + 1
    if len(histograms):
        out.append((start, len(histograms) - 1))
    return out


class Decoded(NamedTuple):
    """A file's coefficients as bytes, whether all frames were whole, and a histogram of 16 luma levels a frame."""

    payload: bytes
    whole: bool
    histograms: np.ndarray
    fps: float
    n_bytes: int | None


def decode_files(files: list[bytes | None]) -> list[Decoded | None]:
    """Decode all frames of AVI files together; None for what is null or no AVI file."""
    videos: list[Video | None] = []
    for f in files:
        try:
            videos.append(None if f is None else read_avi(f))
        except (ValueError, struct.error):
            videos.append(None)
    known: dict[bytes, Header] = {}
    groups: dict[tuple, list[tuple[int, int, bytes, Header]]] = {}
    broken: set[int] = set()
    for i, video in enumerate(videos):
        for j, frame in enumerate(video.frames if video else ()):
            head = known.get(frame[:200]) or next((h for p, h in known.items() if frame.startswith(p)), None)
            if head is None:
                try:
                    head = header(frame)
                except (ValueError, KeyError, IndexError, struct.error):
                    broken.add(i)
                    continue
                known[frame[: head.size]] = head
            groups.setdefault((head.parts, head.quantisers), []).append((i, j, frame, head))
    coefficients: dict[tuple[int, int], np.ndarray] = {}
    bins: dict[tuple[int, int], np.ndarray] = {}
    for members in groups.values():
        for a, b in slices([len(m[2]) for m in members], 2 * _BATCH):
            part = members[a:b]
            got, good = decode_scans([m[2] for m in part], [m[3] for m in part])
            pixels = luma(got, part[0][3])
            n = np.array([m[3].mcus[0] * m[3].mcus[1] for m in part])
            per, lumas = len(part[0][3].parts), sum(p[0] == 0 for p in part[0][3].parts)
            owner = np.repeat(np.arange(len(part)), n * lumas * 64)
            table = np.bincount(owner * 16 + (pixels.ravel() >> 4), minlength=16 * len(part)).reshape(-1, 16)
            at = np.append(0, np.cumsum(n * per))
            narrow = (np.clip(got, -128, 127) + 128).astype(np.uint8)
            for x, (i, j, _, _) in enumerate(part):
                if good[x]:
                    coefficients[i, j], bins[i, j] = narrow[at[x] : at[x + 1]], table[x]
                else:
                    broken.add(i)
    out: list[Decoded | None] = []
    for i, video in enumerate(videos):
        if video is None:
            out.append(None)
            continue
        own = [j for j in range(len(video.frames)) if (i, j) in coefficients]
        out.append(Decoded(b"".join(coefficients[i, j].tobytes() for j in own), i not in broken, np.array([bins[i, j] for j in own], np.int64).reshape(-1, 16), video.fps, video.n_bytes))
    return out


# --- Spark -----------------------------------------------------------------------------------------------


def padded(n: int) -> int:
    """The smallest positive multiple of 64 that is ``n`` at least."""
    return max(64, -(-n // 64) * 64)


def encode_files(payloads: list[bytes]) -> list[bytes]:
    """An AVI file of each payload; the last frame's spare blocks are empty."""
    room = BLOCKS * 64
    counts = [-(-padded(len(p)) // room) for p in payloads]
    data = np.full(sum(counts) * room, 128, np.uint8)
    at = 0
    for p, n in zip(payloads, counts, strict=True):
        data[at : at + len(p)] = np.frombuffer(p, np.uint8)
        data[at + len(p) : at + padded(len(p))] = 0
        at += n * room
    frames = encode_frames((data.astype(np.int16) - 128).reshape(-1, BLOCKS, 64))
    out, at = [], 0
    for p, n in zip(payloads, counts, strict=True):
        out.append(write_avi(frames[at : at + n], len(p)))
        at += n
    return out


def store(docs: DataFrame) -> DataFrame:
    """doc_id and media (an AVI file that holds the whole UTF-8 text) of each row of ``docs`` (doc_id, text); a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for a, b in slices([padded(len(t)) + 512 for t in texts], _BATCH):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(encode_files(texts[a:b]), pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, media binary")


_CLIP = pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64())])


def read(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """doc_id, n_bytes, payload, clips, whole and digests of each row of ``files`` (doc_id, media).

    payload is the coefficients as bytes, cut to the padded length of n_bytes where the file has it. clips are the
    shots with their times. A null media, or one that is no AVI file, gives nulls; frames that cannot be decoded are
    left out and whole is then false. Repeated rows get equal values; other columns are ignored.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "whole", "clips"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(_CLIP)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, files = batch.column(0).to_pylist(), batch.column(1)
            sizes = [len(f.as_buffer()) if f.is_valid else 0 for f in files]
            for a, b in slices([n + 256 for n in sizes], 2 * _BATCH):
                part, rows, payloads = files.slice(a, b - a).to_pylist(), [], []
                for key, f, d in zip(keys[a:b], part, decode_files(part), strict=True):
                    if d is None:
                        rows.append((key, None, None, None, None, None if f is None else len(f), None if f is None else hashlib.sha256(f).hexdigest(), None, None))
                        payloads.append(None)
                        continue
                    payload = d.payload if d.n_bytes is None else d.payload[: padded(d.n_bytes)]
                    ms = lambda t, d=d: round(t * 1000 / d.fps)
                    clips = [{"clip": k, "first_frame": s, "last_frame": e, "start_ms": ms(s), "end_ms": ms(e + 1)} for k, (s, e) in enumerate(shots(d.histograms))]
                    rows.append((key, d.n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(f), hashlib.sha256(f).hexdigest(), d.whole, clips))
                    payloads.append(payload)
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(payloads, pa.binary())] * with_payload, names + ["payload"] * with_payload)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, whole boolean, clips array<struct<clip:int,first_frame:int,last_frame:int,start_ms:bigint,end_ms:bigint>>"
    return files.select(F.col("doc_id").cast("long"), F.col("media").cast("binary")).mapInArrow(run, schema + ", payload binary" * with_payload)


def clips(files: DataFrame) -> DataFrame:
    """A row for each shot of each file: doc_id, clip, first_frame, last_frame, start_ms and end_ms."""
    return read(files, with_payload=False).select("doc_id", F.explode("clips").alias("c")).select("doc_id", "c.*")


def summary(found: DataFrame) -> DataFrame:
    """Digests of read() with its clips as text: first-last frame of each, comma-joined."""
    feature = F.array_join(F.transform("clips", lambda c: F.concat_ws("-", c["first_frame"], c["last_frame"])), ",")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "whole")
