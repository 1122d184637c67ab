"""Baseline JPEG: coefficients and planes of sequential Huffman-coded frames.

Any Huffman and quantisation tables, one to four components, sampling factors, restart intervals and
8-bit samples; frames without Huffman tables, as motion JPEG often has them, use the usual ones.
Entropy decoding goes symbol by symbol; the inverse transform takes all blocks of a plane at once.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the JPEG format: the zigzag order of the 64 coefficients.
ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5,
    12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51,
    58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]

# The usual Huffman tables, as how many codes there are of each length, and the symbols.
# The symbols of the AC tables are written down up to where they go on in rising order.
USUAL = {
    0x00: ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], [*range(12)]),
    0x01: ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], [*range(12)]),
    0x10: ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], [*bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282")]),
    0x11: ([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], [*bytes.fromhex("0001020311040521310612415107617113223281081442" "91a1b1c109233352f0156272d10a162434e125f1")]),
}


class BadMedia(ValueError):
    """The bytes are not media that this package reads."""


def usual_tables() -> dict[int, tuple[list[int], list[int]]]:
    every = [0x00, 0xF0, *(16 * run + size for run in range(16) for size in range(1, 11))]
    return {k: (lengths, symbols if k < 0x10 else symbols + sorted(set(every) - set(symbols))) for k, (lengths, symbols) in USUAL.items()}


def code_table(lengths: list[int], symbols: list[int]) -> tuple[list[int], list[int]]:
    """Code length and symbol for every 16 bits that begin with a code; length 0 where none does."""
    size, value, at, code = [0] * 65536, [0] * 65536, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            lo = code << (16 - n)
            if at >= len(symbols) or lo >= 65536:
                raise BadMedia("a broken Huffman table")
            size[lo : lo + (1 << (16 - n))] = [n] * (1 << (16 - n))
            value[lo : lo + (1 << (16 - n))] = [symbols[at]] * (1 << (16 - n))
            code, at = code + 1, at + 1
        code <<= 1
    return size, value


def inverse_dct() -> np.ndarray:
    """64 coefficients in zigzag order to 64 pixels, as one matrix."""
    u, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    c = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return np.kron(c, c)[ZIGZAG].astype(np.float32)


IDCT = inverse_dct()


@dataclass
class Component:
    across: int
    down: int
    quantiser: int
    dc: int = 0
    ac: int = 0
    width: int = 0
    height: int = 0
    columns: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Frame:
    """Coefficients of each component in zigzag order, dequantised, block row by block row."""

    width: int
    height: int
    components: list[Component]

    def plane(self, i: int = 0) -> np.ndarray:
        """The samples of a component, 0 to 255, at its own resolution."""
        c = self.components[i]
        blocks = np.clip(c.coefficients.astype(np.float32) @ IDCT + 128, 0, 255)
        rows = len(blocks) // c.columns
        return blocks.reshape(rows, c.columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, c.columns * 8)[: c.height, : c.width]


def _segments(scan: bytes) -> list[bytes]:
    """The entropy-coded bytes between restart markers, without stuffing, up to the next other marker."""
    out, at, lo = [], 0, 0
    while True:
        at = scan.find(b"\xff", at)
        if at < 0 or at + 1 >= len(scan):
            out.append(scan[lo:])
            break
        marker = scan[at + 1]
        if 0xD0 <= marker <= 0xD7:
            out.append(scan[lo:at])
            lo = at + 2
        elif marker not in (0, 0xFF):
            out.append(scan[lo:at])
            break
        at += 1 if marker == 0xFF else 2
    return [x.replace(b"\xff\x00", b"\xff") for x in out]


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(8), 0, 8 * len(data)

    def peek(self) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 4], "big") >> (16 - (self.at & 7))) & 0xFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        value = self.peek() >> (16 - n)
        self.at += n
        return value if value >> (n - 1) else value - (1 << n) + 1

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        code = self.peek()
        if not table[0][code] or self.at >= self.end:
            raise BadMedia("broken entropy-coded data")
        self.at += table[0][code]
        return table[1][code]


def _block(bits: _Bits, dc: tuple, ac: tuple, before: int, out: np.ndarray) -> int:
    out[0] = before + bits.take(bits.symbol(dc) & 15)
    k = 1
    while k < 64:
        s = bits.symbol(ac)
        run, size = s >> 4, s & 15
        if not size:
            if run != 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise BadMedia("too many coefficients in a block")
        out[k] = bits.take(size)
        k += 1
    return int(out[0])


def decode(data: bytes) -> Frame:
    """The frame of a baseline JPEG; BadMedia for anything else."""
    if data[:2] != b"\xff\xd8":
        raise BadMedia("a frame without SOI")
    quantisers: dict[int, np.ndarray] = {}
    tables = {k: code_table(*v) for k, v in usual_tables().items()}
    frame, order, interval, at = None, {}, 0, 2
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise BadMedia("a frame without a scan")
        marker, size = struct.unpack_from(">BH", data, at + 1)
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if len(body) != size - 2:
            raise BadMedia("a frame that is cut off")
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
                if len(values) != 64:
                    raise BadMedia("a broken quantisation table")
                quantisers[body[0] & 15], body = values.astype(np.int32), body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                lengths = [*body[1:17]]
                tables[body[0]], body = code_table(lengths, [*body[17 : 17 + sum(lengths)]]), body[17 + sum(lengths) :]
        elif marker in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or not height or not width or not n:
                raise BadMedia("only frames of 8-bit samples and known size are read")
            parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
            frame = Frame(width, height, [Component(p[1] >> 4, p[1] & 15, p[2]) for p in parts])
            order = {p[0]: c for p, c in zip(parts, frame.components)}
        elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
            raise BadMedia("only sequential Huffman-coded frames are read")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            break
    if frame is None or body[0] != len(frame.components):
        raise BadMedia("only one scan of all components is read")
    for i in range(body[0]):
        c = order[body[1 + 2 * i]]
        c.dc, c.ac = body[2 + 2 * i] >> 4, 0x10 | body[2 + 2 * i] & 15
    _scan(frame, quantisers, tables, interval, _segments(data[at:]))
    return frame


def _scan(frame: Frame, quantisers: dict, tables: dict, interval: int, segments: list[bytes]) -> None:
    across, down = (max(getattr(c, k) for c in frame.components) for k in ("across", "down"))
    if not across or not down:
        raise BadMedia("a sampling factor of 0")
    alone = len(frame.components) == 1  # then blocks follow each other by rows, whatever the factors
    wide, high = (-(-frame.width // (8 * across)), -(-frame.height // (8 * down))) if not alone else (-(-frame.width // 8), -(-frame.height // 8))
    if wide * high > 1 << 22:
        raise BadMedia("a frame of more than 2^22 units")
    for c in frame.components:
        h, v = (1, 1) if alone else (c.across, c.down)
        c.width, c.height = -(-frame.width * c.across // across), -(-frame.height * c.down // down)
        c.columns = wide * h
        c.coefficients = np.zeros((wide * h * high * v, 64), np.int32)
        if c.quantiser not in quantisers or c.dc not in tables or c.ac not in tables:
            raise BadMedia("a table is missing")
    every = interval or wide * high
    for n in range(wide * high):
        if n % every == 0:
            if n // every >= len(segments):
                raise BadMedia("a frame that is cut off")
            bits, before = _Bits(segments[n // every]), [0] * len(frame.components)
        row, column = divmod(n, wide)
        for i, c in enumerate(frame.components):
            h, v = (1, 1) if alone else (c.across, c.down)
            for y in range(v):
                for x in range(h):
                    place = (row * v + y) * c.columns + column * h + x
                    before[i] = _block(bits, tables[c.dc], tables[c.ac], before[i], c.coefficients[place])
    for c in frame.components:
        c.coefficients *= quantisers[c.quantiser]
