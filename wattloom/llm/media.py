"""AVI motion-JPEG: write payloads as clips, parse the RIFF index, decode frames, find shots.

A payload byte is stored as the eight amplitude bits of one quantised DCT coefficient of size
class 8, so a block of 64 bytes is one 8x8 block of a baseline JPEG.  The Huffman tables hold that
one symbol with the code `0`, and a restart marker follows every block, which makes a coefficient
nine bits wide everywhere: encoding and decoding are whole-array operations.  The coefficients are
the format's unit that keeps bytes exactly; pixels (for the histograms) come from the inverse DCT.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import batches, whole_text
from .jpeg import IDCT, BadMedia
from .textblocks import blocks

BLOCKS_PER_FRAME = 16
FRAMES_PER_SECOND = 25
BINS = 16
WINDOW = 8
SPREAD = 1.5
FLOOR = 0.05

def _header(blocks: int) -> bytes:
    """SOI to SOS of a grey frame, four blocks wide, of which the first `blocks` carry payload."""
    def segment(marker: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body

    rows = -(-BLOCKS_PER_FRAME // 4)
    one_code = bytes([1] + [0] * 15)
    return b"".join([
        b"\xff\xd8",
        segment(0xFE, struct.pack(">H", blocks)),
        segment(0xDB, b"\x00" + b"\x01" * 64),
        segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, 32, 1, 1, 0x11, 0)),
        segment(0xC4, b"\x00" + one_code + b"\x08"),
        segment(0xC4, b"\x10" + one_code + b"\x08"),
        segment(0xDD, struct.pack(">H", 1)),
        segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ])


_FULL_HEADER = _header(BLOCKS_PER_FRAME)


def encode_all(payloads: list[bytes]) -> list[list[bytes]]:
    """JPEG frames of payloads whose lengths are positive multiples of 64."""
    per_frame = BLOCKS_PER_FRAME * 64
    counts = [-(-len(p) // per_frame) for p in payloads]
    padded = b"".join(p.ljust(n * per_frame, b"\0") for p, n in zip(payloads, counts))
    b = np.ascontiguousarray(np.frombuffer(padded, np.uint8).reshape(-1, 8).T)
    out = np.empty((9, b.shape[1]), np.uint8)
    out[0] = b[0] >> 1
    for i in range(1, 8):  # nine bits a byte: a zero code bit, then the byte
        out[i] = (b[i - 1] << (8 - i)) | (b[i] >> (i + 1)) if i < 7 else b[i - 1] << 1
    out[8] = b[7]
    data = np.empty((sum(counts), BLOCKS_PER_FRAME, 74), np.uint8)
    data[:, :, :72] = out.T.reshape(-1, BLOCKS_PER_FRAME, 72)
    data[:, :, 72] = 0xFF
    data[:, :, 73] = 0xD0 + np.arange(BLOCKS_PER_FRAME) % 8
    data[:, -1, 73] = 0xD9
    stuffed = (data[:, :, :72] == 0xFF).any(axis=(1, 2)).tolist()
    raw, size, frames, at = data.tobytes(), BLOCKS_PER_FRAME * 74, [], 0
    for payload, n in zip(payloads, counts):
        used, own = len(payload) // 64 - (n - 1) * BLOCKS_PER_FRAME, []
        for i in range(n):
            head = _FULL_HEADER if i < n - 1 or used == BLOCKS_PER_FRAME else _header(used)
            scan = raw[(at + i) * size : (at + i + 1) * size]
            if stuffed[at + i]:
                flat = np.frombuffer(scan, np.uint8)
                scan = np.insert(flat, np.flatnonzero((flat == 0xFF) & (np.arange(size) % 74 < 72)) + 1, 0).tobytes()
            own.append(head + scan)
        frames.append(own)
        at += n
    return frames


def write_avi(frames: list[bytes], width: int = 32, height: int = BLOCKS_PER_FRAME * 2) -> bytes:
    """An AVI file with one MJPG stream and an idx1 index."""
    def chunk(name: bytes, body: bytes) -> bytes:
        return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)

    n, largest = len(frames), max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FRAMES_PER_SECOND, largest * FRAMES_PER_SECOND, 0, 0x10, n, 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FRAMES_PER_SECOND, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    parts, index, at = [], [], 4
    for frame in frames:
        body = chunk(b"00dc", frame)
        parts.append(body)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(body)
    movi = chunk(b"LIST", b"movi" + b"".join(parts))
    body = b"AVI " + head + movi + chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _chunks(media: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, first byte, size) of the chunks of a list."""
    while at + 8 <= end:
        size = struct.unpack_from("<I", media, at + 4)[0]
        yield media[at : at + 4], at + 8, size
        at += 8 + size + (size & 1)


@dataclass
class _Stream:
    """The first video stream: its number, frames per second, and OpenDML indexes."""

    number: int = -1
    rate: float = 0.0
    indexes: tuple[int, ...] = ()


def _video_stream(media: bytes, at: int, end: int) -> _Stream:
    number = -1
    for name, lo, size in _chunks(media, at, end):
        if name != b"LIST" or media[lo : lo + 4] != b"strl":
            continue
        number += 1
        found, indexes = None, ()
        for part, a, n in _chunks(media, lo + 4, lo + size):
            if part == b"strh" and media[a : a + 4] == b"vids":
                scale, ticks = struct.unpack_from("<II", media, a + 20)
                found = _Stream(number, ticks / scale if scale else 0.0)
            elif part == b"indx" and n >= 24:
                width, kind, used = struct.unpack_from("<HxBI", media, a)
                if kind == 0:  # an index of indexes
                    indexes = tuple(struct.unpack_from("<Q", media, a + 24 + 16 * i)[0] for i in range(min(used, (n - 24) // 16)))
                elif kind == 1:
                    indexes = (a - 8,)
        if found:
            found.indexes = indexes
            return found
    return _Stream()


def _indexed(media: bytes, where: tuple[int, ...]) -> Iterator[tuple[int, int]]:
    """(first byte, size) of the frames in OpenDML standard indexes."""
    for at in where:
        if at + 32 > len(media):
            raise BadMedia("an index points outside the file")
        used, base = struct.unpack_from("<I4xQ", media, at + 12)
        if at + 32 + 8 * used > len(media):
            raise BadMedia("an index is cut off")
        for i in range(used):
            offset, size = struct.unpack_from("<II", media, at + 32 + 8 * i)
            yield base + offset, size & 0x7FFFFFFF


def read_avi(media: bytes) -> tuple[float, list[memoryview]]:
    """Frames per second and the JPEG frames of the first video stream: through its OpenDML indexes,
    else idx1 (offsets from movi or from the file's start), else in the order of movi."""
    view = memoryview(media)
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise BadMedia("no RIFF AVI header")
    if struct.unpack_from("<I", media, 4)[0] + 8 > len(media):
        raise BadMedia("the file is cut off")
    stream, movi, index = _Stream(), None, None
    for name, at, size in _chunks(media, 12, 8 + struct.unpack_from("<I", media, 4)[0]):
        kind = media[at : at + 4] if name == b"LIST" else name
        if kind == b"hdrl":
            stream = _video_stream(media, at + 4, at + size)
        elif kind == b"movi":
            movi = (at, at + size)
        elif kind == b"idx1":
            index = media[at : at + size]
    if movi is None or stream.number < 0 or (index is not None and len(index) % 16):
        raise BadMedia("no video stream, no movi list or a broken idx1")
    names = tuple(f"{stream.number:02d}{kind}".encode() for kind in ("dc", "db"))
    if stream.indexes:
        spans = [*_indexed(media, stream.indexes)]
    elif index is not None:
        entries = [e for e in struct.iter_unpack("<4sIII", index) if e[0] in names]
        relative = bool(entries) and media[movi[0] + entries[0][2] :][:4] == entries[0][0]
        spans = []
        for name, _, where, size in entries:
            at = where + 8 + (movi[0] if relative else 0)
            if media[at - 8 : at - 4] != name:
                raise BadMedia("idx1 points outside movi")
            spans.append((at, size))
    else:
        spans = [(at, size) for name, at, size in _chunks(media, movi[0] + 4, movi[1]) if name in names]
    if any(at + size > len(media) for at, size in spans):
        raise BadMedia("an index points outside the file")
    frames: list[memoryview] = []
    for at, size in spans:
        if size or frames:  # an empty chunk shows the frame before again
            frames.append(view[at : at + size] if size else frames[-1])
    return stream.rate, frames


def _scan(frame: memoryview) -> tuple[int, bytes]:
    """Payload blocks of a frame, and its entropy-coded bytes without markers and stuffing."""
    data, at, used, symbols = bytes(frame), 2, BLOCKS_PER_FRAME, {}
    if data.startswith(_FULL_HEADER):
        at, symbols = len(_FULL_HEADER), {0: 8, 16: 8}
    else:
        if data[:2] != b"\xff\xd8":
            raise BadMedia("a frame without SOI")
        marker = 0
        while marker != 0xDA:
            marker, size = struct.unpack_from(">xBH", data, at)
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xFE:
                used = struct.unpack(">H", body)[0]
            elif marker == 0xC4 and body[1:17] == bytes([1] + [0] * 15):
                symbols[body[0]] = body[17]
    if symbols != {0: 8, 16: 8}:
        raise BadMedia("only frames with the fixed-width code table are read")
    flat = np.frombuffer(data, np.uint8)[at:]
    if data.find(b"\xff\x00", at) < 0 and len(flat) == BLOCKS_PER_FRAME * 74:
        return used, flat.reshape(-1, 74)[:, :72].tobytes()
    flat = flat[:-2]
    after = np.zeros(len(flat), bool)
    after[1:] = flat[:-1] == 0xFF
    marker = after & (flat >= 0xD0) & (flat <= 0xD7)
    drop = marker | (after & (flat == 0))  # what follows FF is a restart marker or a stuffed zero
    drop[:-1] |= marker[1:]
    clean = flat[~drop].tobytes()
    if len(clean) != BLOCKS_PER_FRAME * 72 or not 0 <= used <= BLOCKS_PER_FRAME:
        raise BadMedia("a frame of the wrong length")
    return used, clean


def decode_frames(frames: list[memoryview]) -> list[np.ndarray]:
    """The amplitude bytes of each frame's payload blocks, shape (blocks, 64)."""
    scans = [_scan(f) for f in frames]
    o = np.ascontiguousarray(np.frombuffer(b"".join(x for _, x in scans), np.uint8).reshape(-1, 9).T)
    b = np.empty((8, o.shape[1]), np.uint8)
    for i in range(7):
        b[i] = (o[i] << (i + 1)) | (o[i + 1] >> (7 - i))
    b[7] = o[8]
    whole = b.T.reshape(-1, BLOCKS_PER_FRAME, 64)
    return [whole[i, :used] for i, (used, _) in enumerate(scans)]


def histograms(amplitudes: list[np.ndarray]) -> np.ndarray:
    """A normalised grey histogram of each frame."""
    if not amplitudes:
        return np.zeros((0, BINS))
    a = np.concatenate(amplitudes)
    pixels = (a.astype(np.float32) - (a < 128) * np.float32(255)) @ IDCT
    np.clip(pixels + 128, 0, 255, out=pixels)
    cells = (pixels * (BINS / 256)).astype(np.int64)
    cells += np.repeat(np.arange(len(amplitudes)) * BINS, [len(x) for x in amplitudes])[:, None]
    h = np.bincount(cells.ravel(), minlength=len(amplitudes) * BINS).reshape(-1, BINS)
    return h / np.maximum(h.sum(axis=1, keepdims=True), 1)


def picture_histograms(frames: list[memoryview]) -> np.ndarray:
    """A normalised grey histogram of each frame of any clip, from its first component.  A frame that
    is no baseline JPEG makes BadMedia."""
    out = np.zeros((len(frames), BINS))
    for i, frame in enumerate(frames):
        data = bytes(frame)
        if data[:6] == _FULL_HEADER[:6] and data[8 : len(_FULL_HEADER)] == _FULL_HEADER[8:]:  # own frames, however full
            out[i] = histograms(decode_frames([frame]))[0]
            continue
        try:
            grey = jpeg.decode(data).plane()
        except (struct.error, IndexError, KeyError) as e:
            raise BadMedia(f"frame {i}: {e}") from e
        h = np.bincount(np.minimum(grey * (BINS / 256), BINS - 1).astype(np.int64).ravel(), minlength=BINS)
        out[i] = h / h.sum()
    return out


def shot_starts(hist: np.ndarray) -> tuple[list[int], list[float]]:
    """First frames of the shots, and the histogram difference before each later frame.  A shot
    begins where the difference passes mean + SPREAD * deviation + FLOOR of the WINDOW before it; the
    first difference is held against those after it."""
    diff = (np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2).round(9).tolist()
    starts = [0] if len(hist) else []
    for i in range(len(diff)):
        near = diff[max(0, i - WINDOW) : i] or diff[1 : 1 + WINDOW]
        mean = sum(near) / max(len(near), 1)
        spread = (sum((x - mean) ** 2 for x in near) / max(len(near), 1)) ** 0.5
        if diff[i] > mean + SPREAD * spread + FLOOR:
            starts.append(i + 1)
    return starts, diff


def clips(media: bytes) -> list[tuple[int, int, int, float]]:
    """(first frame, frames, milliseconds from the start, seconds long) of each shot."""
    rate, frames = read_avi(media)
    starts, _ = shot_starts(picture_histograms(frames))
    if frames and not rate:
        raise BadMedia("no frame rate")
    return [(a, b - a, round(1000 * a / rate), (b - a) / rate) for a, b in zip(starts, [*starts[1:], len(frames)])]


CLIP_SCHEMA = "id string, clip int, first_frame int, frames int, start_ms long, seconds double, error string"


def avi_clips(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One timed row for each shot of each clip in a binary column.

    A null or broken file gives one row with a null clip and the reason in `error`; a file without
    frames gives no row.  Other columns of df are not read."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            out = []
            for key, media in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    if not media.is_valid:
                        raise BadMedia("null")
                    out += [(key, i, a, n, ms, s, None) for i, (a, n, ms, s) in enumerate(clips(media.as_py()))]
                except (BadMedia, struct.error, ValueError) as e:
                    out.append((key, None, None, None, None, None, str(e)[:200]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate([pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.string()])],
                ["id", "clip", "first_frame", "frames", "start_ms", "seconds", "error"],
            )

    return df.select(F.col(id_col).cast("string"), F.col(media_col)).mapInArrow(run, CLIP_SCHEMA)


def text_payload(text: bytes) -> bytes:
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def round_trips(texts: list[bytes]) -> list[tuple]:
    """Digest columns of texts that went through a clip and back."""
    media = [write_avi(frames) for frames in encode_all([text_payload(t) for t in texts])]
    read = [read_avi(m) for m in media]
    amplitudes = decode_frames([f for _, frames in read for f in frames])
    hist, at, out = histograms(amplitudes), 0, []
    for text, stored, (rate, frames) in zip(texts, media, read):
        n = len(frames)
        payload = b"".join(a.tobytes() for a in amplitudes[at : at + n])
        starts, diff = shot_starts(hist[at : at + n])
        at += n
        feature = f"frames={n};shots={len(starts)};cut_ms={','.join(str(round(1000 * x / rate)) for x in starts[1:])};mean_diff={sum(diff) / max(len(diff), 1):.4f}"
        out.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, n, len(starts)))
    return out


TRIP_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, n_shots int"


def text_clips(docs: DataFrame) -> DataFrame:
    """Every whole text stored as a motion-JPEG clip, read back, and described.

    A null text is an empty one (one block of zeros); every row gives one row, repeated or null ids
    included; other columns are ignored."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    names = [c.split()[0] for c in TRIP_SCHEMA.split(", ")]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            done = []
            for block in blocks(batch.column(1), 1_000_000):
                raw, o = block.data.tobytes(), block.offsets.tolist()
                done += round_trips([raw[a:b] for a, b in zip(o, o[1:])])
            columns = [batch.column(0).cast(pa.int64()), *(pa.array([d[i] for d in done], k) for i, k in enumerate(kinds[1:]))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, TRIP_SCHEMA)


def text_files(docs: DataFrame) -> DataFrame:
    """(doc_id, media): every whole text stored as a motion-JPEG clip; nulls and ids as in text_clips."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            for block in blocks(batch.column(1), 1_000_000):
                raw, o = block.data.tobytes(), block.offsets.tolist()
                files = [write_avi(frames) for frames in encode_all([text_payload(raw[a:b]) for a, b in zip(o, o[1:])])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.row, len(block)), pa.array(files, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, media binary")
