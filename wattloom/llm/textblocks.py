"""Vectorised byte-level text helpers that the operators run inside their Arrow batches.

A batch of texts is handled as one byte buffer plus document offsets, cut into blocks of a few
megabytes so that the working arrays stay small whatever the batch size is.  Tokens are runs of
bytes other than space and 0x09-0x0D, with A-Z lower-cased; each is named by a 64-bit hash of its
bytes.  Null texts count as empty ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2_000_000

def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

@dataclass
class Block:
    """Some consecutive documents of a batch: first row, bytes, and n+1 offsets into them."""

    row: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string or binary column; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    width = np.int64 if large else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole documents of about `limit` bytes; a longer document is a block of its own."""
    data, offsets = text_buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield Block(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


NAMED = 64


def names(data: np.ndarray) -> np.ndarray:
    """A 64-bit name of the NAMED bytes from each place, by doubling: the name of 2k bytes comes from
    those of the k bytes here and the k bytes k places on."""
    n = len(data) - NAMED + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    size = 8
    h = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    while size < NAMED:
        u = h ^ (h >> np.uint64(32))
        h = u[:-size] * np.uint64(0x9E3779B97F4A7C15) + u[size:] * np.uint64(0xC2B2AE3D27D4EB4F)
        size *= 2
    return mix64(h)


def name_ranges(name: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit names of byte ranges of NAMED and more, from the names of the pieces that cover them."""
    size = ends - starts
    h = size.astype(np.uint64)
    for i in range(-(-int(size.max(initial=0)) // NAMED)):
        h = mix64(h * np.uint64(0xA24BAED4963EE407) + name[np.minimum(starts + NAMED * i, ends - NAMED)])
    return h


LONG_TOKEN = 64
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: eight bytes at a time, each scrambled into the value so far; long
    ranges by blake2b.  No weak spots as of polynomials, whose values of some patterned texts agree."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    h = size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    rest, left, at = np.flatnonzero(size <= LONG_TOKEN), size, starts
    while len(rest):
        n = left[rest]
        h[rest] = mix64((h[rest] ^ (words[at[rest]] & _MASK[np.minimum(n, 8)])) * np.uint64(0x9E3779B97F4A7C15))
        rest = rest[n > 8]
        if len(rest):
            left, at = left - 8, at + 8
    for i in np.flatnonzero(size > LONG_TOKEN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


@dataclass
class Tokens:
    """Tokens of a block in order: byte range, document within the block, fingerprint; bounds has
    n_docs+1 token offsets."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray
    low: np.ndarray


def tokenize(block: Block) -> Tokens:
    data, offsets = block.data, block.offsets
    low = LOWER[data]
    solid = ~IS_SPACE[data]
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        full = offsets[:-1] < offsets[1:]
        a, b = offsets[:-1][full], offsets[1:][full] - 1
        first[a] = solid[a]
        last[b] = solid[b]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(block)), np.diff(bounds))
    h = token_hashes(low, starts, ends)
    return Tokens(starts, ends, doc, h, bounds, low)


def ngram_hashes(tokens: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the n-token runs of each document, and n_docs+1 offsets into them."""
    counts = np.maximum(np.diff(tokens.bounds) - n + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    first = np.arange(bounds[-1]) + np.repeat(tokens.bounds[:-1] - bounds[:-1], counts)
    h = np.zeros(len(first), np.uint64)
    for i in range(n):
        h = mix64(h * np.uint64(0x9FB21C651E98DF25) + tokens.hash[first + i])
    return h, bounds


def sum_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]], zero where empty."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


class Places:
    """Places of 64-bit keys, all different and as good as random, in their sorted table: the leading
    bits give a short range, which is walked."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length()))
        sizes = np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << int(64 - int(self.shift)))
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each h (0 where it is not there), and whether it is there."""
        b = (h >> self.shift).astype(np.int64)
        at, stop = self.first[b], self.first[b + 1]
        place, known = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        rest = np.flatnonzero(at < stop)
        while len(rest):
            here = self.keys[at[rest]] == h[rest]
            hit = rest[here]
            place[hit], known[hit] = at[hit], True
            rest = rest[~here]
            at[rest] += 1
            rest = rest[at[rest] < stop[rest]]
        return place, known
