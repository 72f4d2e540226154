"""Vectorised text primitives over Arrow string columns.

A batch of texts is handled as one UTF-8 byte array plus document offsets, so
words, lines, windows and their fingerprints come from a few numpy passes and
no Python object is made for a word. Words are maximal runs of bytes other than
the blanks space and TAB to CR, which is the regular expression
``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_MASK = (1 << 64) - 1

#: Bytes that separate words.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of a hash is usable."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two in order; mixed at each step, so that no arithmetic of the parts carries over."""
    return mix((a ^ U64(0xA0761D6478BD642F)) * U64(0x9E3779B97F4A7C15) + b)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, with zeros behind the end."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, long: int = 256) -> np.ndarray:
    """Hashes of ranges of a byte array: eight bytes at a time for all ranges at once, XXH3 for those over ``long`` bytes."""
    size = ends - starts
    out = mix(size.astype(U64) + U64(0x9E3779B97F4A7C15 * (seed + 1) & _MASK))
    view = lanes(data)
    act = np.flatnonzero((size > 0) & (size <= long))
    at = 0
    while len(act):
        left = size[act] - at
        value = view[starts[act] + at]
        short = left < 8
        value[short] &= (U64(1) << (U64(8) * left[short].astype(U64))) - U64(1)
        out[act] = _pair(out[act], value)
        act = act[left > 8]
        at += 8
    for i in np.flatnonzero(size > long).tolist():
        out[i] = mix(np.array([xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed) ^ int(out[i])], U64))[0]
    return out


def equal_ranges(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes of two ranges of one size agree, for each pair of starts."""
    view, same, at = lanes(data), np.ones(len(a), bool), 0
    act = np.flatnonzero(size > 0)
    while len(act):
        left = size[act] - at
        odd = view[a[act] + at] ^ view[b[act] + at]
        short = left < 8
        odd[short] &= (U64(1) << (U64(8) * left[short].astype(U64))) - U64(1)
        same[act[odd != 0]] = False
        act = act[(left > 8) & (odd == 0)]
        at += 8
    return same


def window_hashes(values: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of every n values in a row, put together from windows of 1, 2, 4 ... values."""
    if len(values) < n:
        return np.zeros(0, U64)
    power, width, out, size = mix(values.astype(U64) + U64(0xD6E8FEB86659FD93 * (seed + 1) & _MASK)), 1, None, 0
    while True:
        if n & width:
            out = power if out is None else _pair(out[: len(values) - size - width + 1], power[size:])
            size += width
        if size == n:
            return out
        power = _pair(power[:-width], power[width:])
        width *= 2


def gram_codes(data: np.ndarray, n: int) -> np.ndarray:
    """Codes of every n bytes in a row, to choose places by: equal bytes have equal codes, and that is all that is needed."""
    out, step = np.zeros(max(0, len(data) - n + 1), U64), 1 << 20
    if len(out) and (not _POWERS or len(_POWERS[0]) < step + n):
        for k, base in enumerate((0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64))):
            table = np.full(step + n, base, U64)
            table[0] = 1
            _POWERS[k : k + 1] = [np.cumprod(table, dtype=U64)]
    for a in range(0, len(out), step):
        part = data[a : a + step + n - 1]
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum((part.astype(U64) + U64(1)) * _POWERS[0][: len(part)], dtype=U64, out=sums[1:])
        out[a : a + step] = mix((sums[n:] - sums[: len(sums) - n]) * _POWERS[1][: len(sums) - n])
    return out


_POWERS: list[np.ndarray] = []


class Texts:
    """A slice of a string column as bytes and offsets; nulls count as empty texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @classmethod
    def of(cls, column: pa.Array | pa.ChunkedArray) -> Texts:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
            if isinstance(column, pa.ChunkedArray):
                column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        column = column.cast(pa.large_string()).fill_null("")
        if not len(column):
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        _, at, data = column.buffers()
        offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        return cls(data, offsets - offsets[0])

    def slice(self, a: int, b: int) -> Texts:
        o = self.offsets[a : b + 1]
        return Texts(self.data[o[0] : o[-1]], o - o[0])

    def parts(self, most: int = 1 << 20) -> Iterator[tuple[int, Texts]]:
        """Runs of whole texts of about ``most`` bytes, one text at least."""
        a = 0
        while a < len(self):
            b = int(np.searchsorted(self.offsets, self.offsets[a] + most, "right")) - 1
            b = min(max(b, a + 1), len(self))
            yield a, self.slice(a, b)
            a = b

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, and the word offsets of the documents."""
        solid = ~BLANK[self.data]
        edge = np.zeros(len(solid) + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(len(solid) + 1, bool)
        before[1:] = solid
        starts = np.flatnonzero(solid & (~before[:-1] | edge[:-1]))
        after = np.zeros(len(solid), bool)
        after[:-1] = solid[1:]
        ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all lines, and the line offsets of the documents; an empty text has one line."""
        cuts = np.flatnonzero(self.data == 10)
        starts = np.concatenate([self.offsets[:-1], cuts + 1])
        docs = np.concatenate([np.arange(len(self)), np.searchsorted(self.offsets, cuts, "right") - 1])
        order = np.lexsort((starts, docs))
        starts, docs = starts[order], docs[order]
        at = np.searchsorted(docs, np.arange(len(self) + 1))
        ends = np.empty(len(starts), np.int64)
        ends[:-1] = starts[1:] - 1
        if len(self):
            ends[at[1:] - 1] = self.offsets[1:]
        return starts, ends, at

    def lowered(self) -> Texts:
        """A-Z in lower case; other letters are left alone."""
        upper = (self.data >= 65) & (self.data <= 90)
        return Texts(self.data + (upper.astype(np.uint8) << 5), self.offsets)


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each element the document that it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Marks of the positions that any of the ranges covers."""
    step = np.bincount(starts, minlength=n + 1).astype(np.int64)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(step)[:n] > 0


def per_document(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the marks by document."""
    sums = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """Marks of the window starts, of n elements in a row, that stay within one document."""
    total = int(offsets[-1])
    if total < n:
        return np.zeros(max(0, total - n + 1), bool)
    ok = np.zeros(total + 1, np.int32)
    lengths = np.diff(offsets)
    long = lengths >= n
    np.add.at(ok, offsets[:-1][long], 1)
    np.add.at(ok, (offsets[1:] - n + 1)[long], -1)
    return np.cumsum(ok)[: total - n + 1] > 0
