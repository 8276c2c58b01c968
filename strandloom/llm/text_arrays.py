"""Words of many texts at once: byte positions and 64-bit hashes as flat numpy arrays.

A text's words are its runs of bytes that are not white space (0x20, 0x09 to 0x0D), which in UTF-8 are
its runs of characters `[^\\x20\\x09-\\x0D]`. A word is hashed eight bytes at a time: each eight are mixed with
a value of their place, and only then summed. Windows are put together from mixed hashes of their halves. Nothing is a
polynomial modulo 2**64: there, long strings of two letters can be written down that collide whatever the base.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: An odd number, so that its multiples differ, and seeds of two independent hashes.
STEP = U64(0x9E3779B97F4A7C15)
SEEDS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text that are worked on at once, unless one text has more.
PIECE_BYTES = 1 << 21
#: Runs of eight bytes that are hashed at once.
BLOCK_LANES = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x (a fixed permutation of 64-bit values)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each run of bytes data[start:end]; runs ascend. Another seed gives another hash."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    lanes = np.maximum((ends - starts + 7) >> 3, 1)
    upto = np.cumsum(lanes)
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        done = upto[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(upto, done + BLOCK_LANES, side="right")))
        n = lanes[i:j]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        at = np.repeat(starts[i:j], n) + 8 * place
        left = np.minimum(np.repeat(ends[i:j], n) - at, 8).astype(U64)
        lane = eights[at] & (~U64(0) >> ((U64(8) - left) * U64(8)) if (left > 0).all() else np.where(left > 0, ~U64(0) >> ((U64(8) - np.maximum(left, U64(1))) * U64(8)), U64(0)))
        sums = np.add.reduceat(mixed(lane ^ mixed(place.astype(U64) * STEP + U64(seed))), first)
        out[i:j] = mixed(sums + (ends[i:j] - starts[i:j]).astype(U64) * STEP)
        i = j
    return out


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins and the last ends; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of the texts first .. first + len(bounds) - 2 of a batch; text i has words bounds[i] to bounds[i + 1]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def texts(self) -> np.ndarray:
        """The text of each word, from 0."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self, seed: int = SEEDS[0]) -> np.ndarray:
        return run_hashes(self.data, self.starts, self.ends, seed)

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window that starts at each word, and whether it ends within the word's text."""
        n = len(hashes)
        inside = np.arange(n) + width <= np.repeat(self.bounds[1:], self.counts)
        return window_hashes(hashes, width), inside


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two runs of words in a row, from theirs."""
    return mixed(mixed(left + STEP) + right)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of hashes[i : i + width] for each i, from windows whose widths are powers of 2; the last width - 1 results are of no use."""
    out, power, at, bit = None, hashes, 0, 1
    while True:
        if width & bit:
            out = power.copy() if out is None else np.concatenate([joined(out[: len(out) - at], power[at:]), out[len(out) - at :]]) if at < len(out) else out
            at += bit
        bit <<= 1
        if bit > width:
            return out
        half = bit >> 1
        power = np.concatenate([joined(power[:-half], power[half:]), power[-half:]]) if half < len(power) else power


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each run of words [start, end), each of one word at least: as window_hashes() has it for its width."""
    out = np.zeros(len(starts), U64)
    for width in np.unique(ends - starts).tolist():
        own = np.flatnonzero(ends - starts == width)
        rows = hashes[starts[own][:, None] + np.arange(width)]
        value, at, bit = None, 0, 1
        while bit <= width:
            if width & bit:
                part = rows[:, at : at + bit]
                while part.shape[1] > 1:
                    part = joined(part[:, ::2], part[:, 1::2])
                value = part[:, 0] if value is None else joined(value, part[:, 0])
                at += bit
            bit <<= 1
        out[own] = value
    return out


def pieces(column: pa.Array | pa.ChunkedArray, lower: bool = False, piece_bytes: int = PIECE_BYTES) -> Iterator[Words]:
    """The words of a batch's texts, some texts at a time."""
    data, offsets = flat(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + piece_bytes, side="right")) - 1)
        own = offsets[i : j + 1] - offsets[i]
        part = data[offsets[i] : offsets[j]]
        if lower:
            part = LOWER[part]
        word = ~SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[own] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | edge[1 : len(part)]
        stops = word.copy()
        stops[:-1] &= ~word[1:] | edge[1 : len(part)]
        starts = np.flatnonzero(begins)
        yield Words(i, part, own, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, own))
        i = j


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
