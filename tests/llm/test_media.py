import struct

import numpy as np
import pytest

from vistalog.llm import mjpeg as M


def test_round_trip_of_bytes():
    rng = np.random.default_rng(1)
    cases = [b"", b"a" * 64, bytes(range(256)) * 9, b"\x80" * 500, b"\x80" * 63 + b"\0" + b"\x80" * 640 + b"\xff" * 64] + [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (1, 63, 64, 65, 1024, 1025, 9000)]
    for payload, d in zip(cases, M.decode_files(M.encode_files(cases)), strict=True):
        assert d.whole and d.n_bytes == len(payload)
        assert d.payload[: M.padded(len(payload))] == payload + b"\0" * (M.padded(len(payload)) - len(payload))


def test_batches_do_not_matter():
    cases = [bytes([i % 251]) * (i * 37) for i in range(30)]
    assert M.encode_files(cases) == [M.encode_files([c])[0] for c in cases]


def _frame(blocks, parts, sampling, height, width, tables, quant):
    """A plain, bit by bit encoder of an interleaved baseline frame."""
    bits, predicted = [], {}

    def put(code, n):
        bits.extend((int(code) >> (n - 1 - i)) & 1 for i in range(n))

    def amplitude(v, n):
        put(v if v > 0 else v + (1 << n) - 1, n) if n else None

    for block, (comp, t) in zip(blocks, parts * (len(blocks) // len(parts)), strict=True):
        (dc, dcn), (ac, acn) = M.codes(tables[0][t]), M.codes(tables[1][t])
        d = int(block[0]) - predicted.get(comp, 0)
        predicted[comp] = int(block[0])
        n = abs(d).bit_length()
        put(dc[n], int(dcn[n]))
        amplitude(d, n)
        run = 0
        for v in block[1:].tolist():
            if v == 0:
                run += 1
                continue
            while run > 15:
                put(ac[0xF0], int(acn[0xF0]))
                run -= 16
            n = abs(v).bit_length()
            put(ac[run * 16 + n], int(acn[run * 16 + n]))
            amplitude(v, n)
            run = 0
        if run:
            put(ac[0], int(acn[0]))
    bits += [1] * (-len(bits) % 8)
    data = np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\0")
    seg = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + b"".join(seg(0xDB, bytes([q]) + bytes(v)) for q, v in enumerate(quant))
    for cls in (0, 1):
        out += b"".join(seg(0xC4, bytes([cls * 16 + i]) + t[0] + t[1]) for i, t in enumerate(tables[cls]))
    out += seg(0xC0, struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([i + 1, h * 16 + v, min(i, 1)]) for i, (h, v) in enumerate(sampling)))
    out += seg(0xDA, bytes([len(sampling)]) + b"".join(bytes([i + 1, min(i, 1) * 17]) for i in range(len(sampling))) + b"\0\x3f\0")
    return out + data + b"\xff\xd9"


def test_colour_frames_with_own_tables():
    rng = np.random.default_rng(3)
    sampling, parts = [(2, 2), (1, 1), (1, 1)], [(0, 0)] * 4 + [(1, 1), (2, 1)]
    blocks = np.where(rng.random((2 * 3 * 6, 64)) < 0.3, rng.integers(-60, 60, (36, 64)), 0)
    quant = [list(range(1, 65)), [7] * 64]
    frame = _frame(blocks, parts, sampling, 32, 44, [[M.DC_LUMA, M.DC_CHROMA], [M.AC_LUMA, M.AC_CHROMA]], quant)
    head = M.header(frame)
    assert head.mcus == (2, 3) and head.sampling == tuple(sampling) and head.quantisers[1][0] == 7
    got, good = M.decode_scans([frame], [head])
    assert good.all() and (got == blocks).all()
    pixels = M.luma(got, head)
    k = np.arange(8)
    c = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    first = np.zeros(64)
    first[M.zigzag()] = blocks[0] * np.array(quant[0])
    want = np.clip(np.round(c.T @ first.reshape(8, 8) @ c + 128), 0, 255).ravel()
    assert np.abs(pixels[0].astype(int) - want).max() <= 1


def test_indexes_and_broken_files():
    video = M.read_avi(M.encode_files([b"x" * 5000])[0])
    assert len(video.frames) == 5 and video.fps == M.FPS and video.n_bytes == 5000
    raw = M.encode_files([b"x" * 5000])[0]
    at = raw.index(b"idx1")
    assert M.read_avi(raw[:at] + b"JUNK" + raw[at + 4 :]).frames == video.frames
    assert M.decode_files([None, b"no file", raw[:300]]) == [None, None, None]
    body = raw.index(b"\x3f\x00", raw.index(b"00dc"))
    damaged = raw[: body + 40] + b"\xff" * 60 + raw[body + 100 :]
    assert not M.decode_files([damaged])[0].whole


def test_opendml_index():
    frames = M.read_avi(M.encode_files([b"y" * 3000])[0]).frames
    raw = M.write_avi(frames, 3000)
    at = raw.index(b"idx1")
    spans, p = [], raw.index(b"movi") + 4
    for f in frames:
        spans.append((p + 8, len(f)))
        p += 8 + len(f) + (len(f) & 1)
    body = struct.pack("<HBBI4sQI", 2, 0, 1, len(spans), b"00dc", 0, 0) + b"".join(struct.pack("<II", a, n) for a, n in spans)
    out = raw[:at] + b"ix00" + struct.pack("<I", len(body)) + body
    out = out[:4] + struct.pack("<I", len(out) - 8) + out[8:]
    assert M.read_avi(out).frames == frames


def test_shots_are_cut_where_histograms_jump():
    dark, light = np.eye(16, dtype=np.int64)[0] * 1024, np.eye(16, dtype=np.int64)[15] * 1024
    noise = lambda h, k: np.roll(h, 0) + np.where(np.arange(16) == k, 8, 0)
    film = np.array([noise(dark, i % 3) for i in range(10)] + [noise(light, i % 3) for i in range(7)] + [noise(dark, i % 3) for i in range(4)])
    assert M.shots(film) == [(0, 9), (10, 16), (17, 20)]
    assert M.shots(film[:10]) == [(0, 9)] and M.shots(film[:0]) == []


def test_clip_rows(spark):
    df = spark.createDataFrame([(1, "abc" * 2000), (2, None)], "doc_id long, text string")
    rows = M.clips(M.store(df)).orderBy("doc_id", "clip").collect()
    one = [r for r in rows if r["doc_id"] == 1]
    assert one[0]["first_frame"] == 0 and one[-1]["last_frame"] == 5 and one[-1]["end_ms"] == 240
    assert all(a["end_ms"] == b["start_ms"] for a, b in zip(one, one[1:], strict=False))


def test_media_that_is_no_video(spark):
    df = spark.createDataFrame([(1, b"no"), (2, None)], "doc_id long, media binary")
    assert [(r["n_bytes"], r["media_bytes"], r["clips"]) for r in M.read(df).orderBy("doc_id").collect()] == [(None, 2, None), (None, None, None)]


@pytest.mark.parametrize("n", [0, 1, 64, 65])
def test_padding(n):
    assert M.padded(n) % 64 == 0 and M.padded(n) >= max(64, n)
