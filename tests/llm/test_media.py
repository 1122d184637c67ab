from __future__ import annotations

import hashlib
import os
import struct
import zlib

import numpy as np
import pytest

from wattloom.llm import jpeg, media


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1023, 1024, 1025, 5000, 70_001])
def test_bytes_survive_the_clip(size):
    payload = media.text_payload(os.urandom(size) + b"\xff" * (size % 3))
    (frames,) = media.encode_all([payload])
    rate, read = media.read_avi(media.write_avi(frames))
    assert rate == 25
    assert b"".join(a.tobytes() for a in media.decode_frames(read)) == payload


def test_several_clips_at_once():
    payloads = [media.text_payload(os.urandom(n)) for n in (10, 3000, 0)]
    for payload, frames in zip(payloads, media.encode_all(payloads)):
        assert b"".join(a.tobytes() for a in media.decode_frames([memoryview(f) for f in frames])) == payload


def test_a_change_of_picture_is_a_shot():
    flat = lambda v, n: bytes([v]) * (1024 * n)
    (frames,) = media.encode_all([flat(130, 6) + flat(20, 5)])
    got = media.clips(media.write_avi(frames))
    assert [(a, n) for a, n, _, _ in got] == [(0, 6), (6, 5)]
    assert got[1][2] == 240 and got[1][3] == pytest.approx(0.2)


def test_inverse_dct_is_the_definition():
    rng = np.random.default_rng(1)
    c = rng.normal(size=64).astype(np.float32)
    square = np.zeros(64)
    square[jpeg.ZIGZAG] = c
    square = square.reshape(8, 8)
    scale = np.where(np.arange(8) == 0, 2**-0.5, 1.0) / 2
    basis = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8) * np.pi / 16) * scale
    np.testing.assert_allclose((c @ jpeg.IDCT).reshape(8, 8), basis @ square @ basis.T, atol=1e-4)


def test_clips_of_a_column_and_broken_files(spark):
    (frames,) = media.encode_all([b"a" * 1024 * 4])
    good = media.write_avi(frames)
    rows = [("a", good), ("b", None), ("c", b"RIFFxxxxAVI "), ("d", good[:-200]), ("e", media.write_avi([]))]
    got = media.avi_clips(spark.createDataFrame(rows, "name string, media binary"), "name", "media").collect()
    assert {(r.id, r.clip, r.frames) for r in got} == {("a", 0, 4), ("b", None, None), ("c", None, None), ("d", None, None)}
    assert all(r.error for r in got if r.clip is None)


def test_query_columns(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in media.text_clips(docs).collect():
        payload = media.text_payload(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len(texts[r.doc_id]), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])


def codes(table):
    out, code, at = {}, 0, 0
    for n, count in enumerate(table[0], 1):
        for _ in range(count):
            out[table[1][at]] = f"{code:0{n}b}"
            code, at = code + 1, at + 1
        code <<= 1
    return out


def amplitude(v):
    n = abs(v).bit_length()
    return n, f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""


def encoded(blocks_of, width, height, factors, quantiser, interval=0, tables=True):
    """A baseline JPEG of coefficient arrays {component: (rows, columns, 64)} with the usual tables."""
    usual = jpeg.usual_tables()
    seg = lambda m, body: struct.pack(">BBH", 0xFF, m, len(body) + 2) + body
    out = b"\xff\xd8" + seg(0xFE, b"made by hand")
    out += seg(0xDB, b"\x00" + bytes(quantiser)) + (seg(0xDD, struct.pack(">H", interval)) if interval else b"")
    out += seg(0xC0, struct.pack(">BHHB", 8, height, width, len(factors)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(factors)))
    if tables:
        out += b"".join(seg(0xC4, bytes([k, *lengths, *symbols])) for k, (lengths, symbols) in usual.items())
    out += seg(0xDA, bytes([len(factors), *(x for i in range(len(factors)) for x in (i + 1, 0x11 if i else 0)), 0, 63, 0]))
    across, down = max(h for h, _ in factors), max(v for _, v in factors)
    wide, high = -(-width // (8 * across)), -(-height // (8 * down))
    if len(factors) == 1:
        wide, high, factors = -(-width // 8), -(-height // 8), [(1, 1)]
    bits, parts, before = "", [], [0] * len(factors)

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    for n in range(wide * high):
        if interval and n and n % interval == 0:
            parts.append(flush(bits) + bytes([0xFF, 0xD0 + (n // interval - 1) % 8]))
            bits, before = "", [0] * len(factors)
        for i, (h, v) in enumerate(factors):
            dc, ac = codes(usual[int(i > 0)]), codes(usual[0x10 | int(i > 0)])
            for y in range(v):
                for x in range(h):
                    block = blocks_of[i][n // wide * v + y, n % wide * h + x]
                    size, tail = amplitude(int(block[0]) - before[i])
                    before[i] = int(block[0])
                    bits += dc[size] + tail
                    run = 0
                    for c in block[1:]:
                        if not c:
                            run += 1
                            continue
                        while run > 15:
                            bits, run = bits + ac[0xF0], run - 16
                        size, tail = amplitude(int(c))
                        bits, run = bits + ac[16 * run + size] + tail, 0
                    bits += ac[0] if run else ""
    return out + b"".join(parts) + flush(bits) + b"\xff\xd9"


def coefficients(rng, rows, columns):
    c = rng.integers(-60, 61, (rows, columns, 64)) * (rng.random((rows, columns, 64)) < 0.15)
    c[..., 0] = rng.integers(-500, 500, (rows, columns))
    c[0, 0, 40:] = 0
    return c


@pytest.mark.parametrize(("factors", "interval"), [([(1, 1)], 0), ([(2, 2)], 2), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 3), ([(1, 1), (1, 1), (1, 1)], 1)])
def test_frames_with_usual_tables(factors, interval):
    rng = np.random.default_rng(2)
    width, height = 45, 37
    across, down = max(h for h, _ in factors), max(v for _, v in factors)
    wide, high = -(-width // (8 * across)), -(-height // (8 * down))
    shapes = [(high * v, wide * h) for h, v in factors] if len(factors) > 1 else [(-(-height // 8), -(-width // 8))]
    blocks_of = [coefficients(rng, *s) for s in shapes]
    quantiser = rng.integers(1, 30, 64).tolist()
    for tables in (True, False):
        frame = jpeg.decode(encoded(blocks_of, width, height, factors, quantiser, interval, tables))
        assert (frame.width, frame.height) == (width, height)
        for c, want in zip(frame.components, blocks_of):
            np.testing.assert_array_equal(c.coefficients.reshape(want.shape), want * quantiser)
    plane = frame.plane()
    assert plane.shape == (height, width) and 0 <= plane.min() and plane.max() <= 255
    own = np.clip((blocks_of[0][0, 0] * quantiser).astype(np.float32) @ jpeg.IDCT + 128, 0, 255).reshape(8, 8)
    np.testing.assert_allclose(plane[:8, :8], own, atol=1e-3)


def camera_frames(levels):
    flat = lambda v: np.concatenate([[v], np.zeros(63, int)])[None, None].repeat(4, 0).repeat(4, 1)
    return [encoded([flat(v), flat(0)[:2, :2], flat(0)[:2, :2]], 32, 32, [(2, 2), (1, 1), (1, 1)], [8] * 64) for v in levels]


@pytest.mark.parametrize("layout", ["relative", "absolute", "none", "opendml"])
def test_clips_of_a_camera_file(spark, layout):
    frames = camera_frames([20, 20, 21, 20, -90, -90, -91])
    frames[2] = b""  # shows the frame before again
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    strh = lambda kind: chunk(b"strh", kind + b"MJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, 10, 0, 7, 0, 0, 0, 0, 0, 32, 32))

    def build(index_at):
        indx = chunk(b"indx", struct.pack("<HBBI4sIII", 4, 0, 0, 1, b"01dc", 0, 0, 0) + struct.pack("<QII", index_at, 0, 7)) if layout == "opendml" else b""
        head = chunk(b"LIST", b"hdrl" + chunk(b"LIST", b"strl" + strh(b"auds")) + chunk(b"LIST", b"strl" + strh(b"vids") + indx))
        movi_at = 12 + len(head) + 8
        body, index, data = b"movi", b"", []
        for f in frames:
            body += chunk(b"00wb", b"sound")
            at = len(body) if layout != "absolute" else movi_at + len(body)
            index += struct.pack("<4sIII", b"01dc", 16, at, len(f))
            data.append((movi_at + len(body) + 8, len(f)))
            body += chunk(b"01dc", f)
        place = movi_at + len(body)
        if layout == "opendml":
            body += chunk(b"ix01", struct.pack("<HBBI4sQI", 2, 0, 1, len(frames), b"01dc", data[0][0], 0) + b"".join(struct.pack("<II", a - data[0][0], n) for a, n in data))
        tail = chunk(b"idx1", index) if layout in ("relative", "absolute") else b""
        whole = b"AVI " + head + chunk(b"LIST", body) + tail
        return b"RIFF" + struct.pack("<I", len(whole)) + whole, place

    media_bytes, place = build(0)
    if layout == "opendml":
        media_bytes, _ = build(place)
    rate, read = media.read_avi(media_bytes)
    assert rate == 10 and [bytes(f) for f in read] == [f or frames[1] for f in frames]
    rows = media.avi_clips(spark.createDataFrame([("cam", media_bytes), ("cam", media_bytes)], "id string, media binary"), "id", "media").collect()
    assert [(r.clip, r.first_frame, r.frames, r.start_ms, r.error) for r in rows] == [(0, 0, 4, 0, None), (1, 4, 3, 400, None)] * 2


def test_what_is_no_baseline_frame():
    good = camera_frames([5])[0]
    for bad in (b"", b"\xff\xd8", good[:60], good[:-12], good.replace(b"\xff\xc0", b"\xff\xc2"), good.replace(b"\xff\xdb", b"\xff\xe5")):
        with pytest.raises((media.BadMedia, struct.error, IndexError)):
            media.picture_histograms([memoryview(bad)])


def test_a_cut_after_the_first_frame():
    hist = np.eye(media.BINS)[[0, 1, 1, 1, 1]]
    assert media.shot_starts(hist)[0] == [0, 1]
    assert media.shot_starts(np.eye(media.BINS)[[0]])[0] == [0] and media.shot_starts(np.zeros((0, media.BINS)))[0] == []


def test_every_document_gives_timed_rows(spark, tiny):
    from wattloom.llm import queries

    rows = queries.clips_of_documents(spark, tiny).collect()
    trips = {str(r.doc_id): r for r in media.text_clips(spark.read.parquet(f"{tiny}/documents.parquet")).collect()}
    assert {r.id for r in rows} == set(trips) and not any(r.error for r in rows)
    for i, t in trips.items():
        own = sorted((r for r in rows if r.id == i), key=lambda r: r.clip)
        assert (len(own), sum(r.frames for r in own)) == (t.n_shots, t.n_frames)
        assert f"cut_ms={','.join(str(r.start_ms) for r in own[1:])};" in t.feature
