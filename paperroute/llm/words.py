"""Words, lines and n-grams of a batch of texts as numpy arrays, hashed without a loop over rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MULTIPLIER = 0x9E3779B97F4A7C15 | 6  # odd, so that it has an inverse, and one less has a single factor 2
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


_held: list[np.ndarray] = []  # powers of the multiplier and of its inverse, for the longest slice so far


def powers(size: int) -> list[np.ndarray]:
    if not _held or len(_held[0]) < size:
        _held.clear()
        for factor in (MULTIPLIER, INVERSE):
            steps = np.full(-(-size // (1 << 16)) << 16, factor, np.uint64)
            steps[:1] = 1
            _held.append(np.multiply.accumulate(steps, out=steps))
    return _held


def forget_powers() -> None:
    """Python workers serve later stages too, which shall not find their memory taken."""
    _held.clear()


class Texts:
    """The bytes of all texts of an Arrow string column one after another, and where each begins."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        buffers = column.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
        whole = np.frombuffer(buffers[2] if buffers[2] is not None else b"", np.uint8)
        self.bytes = whole[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.rows = len(column)
        self.sizes = np.diff(self.offsets)

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many of the marked bytes each row has."""
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[self.offsets])

    def runs(self, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of the runs without a separator; rows part runs too."""
        inside = ~separator
        before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
        firsts = self.offsets[:-1][self.sizes > 0]
        before[firsts] = False
        begins = np.flatnonzero(inside & ~before)
        after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
        after[firsts[firsts > 0] - 1] = False
        return begins, np.flatnonzero(inside & ~after) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(SEPARATORS[self.bytes])

    def row_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, places, "right") - 1

    def sums(self, data: np.ndarray | None = None) -> np.ndarray:
        """Prefix sums from which the hash of any stretch of bytes follows."""
        data = self.bytes if data is None else data
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers(len(data))[0][: len(data)], out=total[1:])
        return total


def hashes(sums: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes; the same bytes have the same hash wherever they stand."""
    raw = (sums[ends] - sums[begins]) * powers(len(sums))[1][begins]
    return mixed(raw + (ends - begins).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def eights(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches that are not empty as numbers of eight bytes, the last one filled with zeros.

    Returns the numbers, where those of each stretch begin, and the place of each number in its stretch.
    """
    at_any = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    blocks = (ends - begins + 7) >> 3
    first = np.cumsum(blocks) - blocks
    nth = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    at = np.repeat(begins, blocks) + 8 * nth
    value = at_any[at]
    left = np.repeat(ends, blocks) - at
    short = np.flatnonzero(left < 8)
    value[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
    return value, first, nth


def hashes_of_eights(value: np.ndarray, first: np.ndarray, nth: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    value = mixed(value ^ mixed((nth + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    total = np.add.reduceat(value, first) if len(first) else value
    return mixed(total + sizes.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def run_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches that are not empty: every eight bytes are mixed with their place, and the results added.

    Unlike ``hashes`` no algebra relates the hashes of different stretches, so no pair of texts can be
    written down that collides whatever the constants are.
    """
    return hashes_of_eights(*eights(data, begins, ends), ends - begins)


def together(*parts: np.ndarray) -> np.ndarray:
    """One hash for a tuple of hashes, in order."""
    total = np.zeros(len(parts[0]), np.uint64)
    for x in parts:
        total = mixed(total * np.uint64(0xE7037ED1A0B428DB) + x)
    return total


def grams(texts: Texts, buckets: int, length: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the byte n-gram at every place where one begins in a row, and how many each row has."""
    data = texts.bytes.astype(np.uint32)
    n = max(0, len(data) - length + 1)
    value = np.zeros(n, np.uint32)
    for i in range(length):
        value = (value << np.uint32(8)) | data[i : i + n]
    value = (value * np.uint32(2654435761)) >> np.uint32(32 - int(buckets).bit_length() + 1)
    inside = np.ones(n, bool)
    for i in range(1, length):
        crossing = texts.offsets[1:-1] - i
        inside[crossing[(crossing >= 0) & (crossing < n)]] = False
    counts = np.maximum(texts.sizes - length + 1, 0)
    return value[inside], counts


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of so many values, one run per row; exact for whole numbers."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(counts)])])
