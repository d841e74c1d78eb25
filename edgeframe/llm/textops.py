"""Vectorised text primitives over Arrow string columns.

A *word* is a maximal run of bytes other than space and TAB, LF, VT, FF, CR
(``[^\\x20\\x09-\\x0D]+``); that set is exactly what ``bytes.split()`` splits
on.  Everything here works on a batch's UTF-8 buffer at once, so the cost per
word is a few numpy element operations and memory is a constant times the
bytes of one slice (:func:`slices`), never of a whole partition.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 19

#: Words up to this many bytes are hashed together, longer ones by blake2b; bytes in which words begin that are hashed at once.
_WHOLE, _CHUNK = 48, (1 << 16) - 48

_B_WORD = 0x9E3779B97F4A7C15
_B_WORD_INV = pow(_B_WORD, -1, 1 << 64)
_B_SEQ = 0xD6E8FEB86659FD93
_B_INV = pow(_B_SEQ, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; a bijection on 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """``base ** [0..n)`` modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length()) if n else 1024
        full = np.full(size, base, dtype=np.uint64)
        full[0] = 1
        have = np.multiply.accumulate(full)
        if size <= 1 << 20:
            _powers[base] = have
    return have[:n]


def as_arrow(column) -> pa.Array:
    """A string column as one array with 32-bit offsets; null becomes empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if array.null_count:
        array = array.fill_null("")
    return array.cast(pa.string()) if array.type != pa.string() else array


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and its offsets into them."""
    n = len(array)
    _, offsets, data = array.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch with about ``limit`` bytes of ``column`` each."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(sizes), 0))
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, n], strict=True):
        yield batch.slice(a, b - a)
    if sizes.sum() > 2 * limit:
        release()


def release() -> None:
    """Give freed memory back to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    try:
        found = ctypes.CDLL(None)
        return found if hasattr(found, "malloc_trim") else None
    except OSError:
        return None


_LIBC = _libc()


class Words:
    """The words of several texts.

    ``doc`` is the row of each word, ``start``/``end`` its bytes in ``raw``,
    ``first`` the index of each row's first word (one more entry than rows).
    """

    def __init__(self, array: pa.Array, lower: bool = False):
        raw, off = text_bytes(array)
        if lower and len(raw):
            raw = raw | ((raw - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))
        self.raw, self.off, self.rows = raw, off, len(array)
        if len(raw):
            solid = (raw != 32) & (raw - np.uint8(9) > 4)
            edge = np.zeros(len(raw) + 1, dtype=bool)
            edge[off] = True  # a text's end ends its last word
            before = np.empty(len(raw), dtype=bool)
            before[0], before[1:] = True, ~solid[:-1]
            after = np.empty(len(raw), dtype=bool)
            after[-1], after[:-1] = True, ~solid[1:]
            self.start = np.flatnonzero(solid & (before | edge[:-1]))
            self.end = np.flatnonzero(solid & (after | edge[1:])) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(self.rows), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.zeros(len(self), np.uint64)
        size = self.end - self.start
        short = np.minimum(size, _WHOLE)
        # polynomials in the bytes, each the difference of two sums since the chunk's start
        cuts = np.flatnonzero(changes(self.start // _CHUNK)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(self)], strict=False):
            base = self.start[a]
            start = self.start[a:b] - base
            end = start + short[a:b]
            n = int(end[-1])
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((self.raw[base : base + n].astype(np.uint64) + np.uint64(1)) * _power(_B_WORD_INV, n), out=total[1:])
            h = (total[end] - total[start]) * _power(_B_WORD, n)[end - 1]
            out[a:b] = mix(h + size[a:b].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        for i in np.flatnonzero(size > _WHOLE).tolist():
            piece = self.raw[self.start[i] : self.end[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little")
        return out

    def grams(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hashes of every ``width`` consecutive words inside one text.

        Returns the hash at each start (junk where it doesn't fit) and which
        starts are valid.
        """
        n = len(hashes)
        if n < width:
            return np.zeros(n, np.uint64), np.zeros(n, dtype=bool)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * _power(_B_SEQ, n), out=total[1:])
        out = np.zeros(n, np.uint64)
        m = n - width + 1
        out[:m] = mix((total[width:] - total[:m]) * _power(_B_INV, m) + np.uint64(width))
        valid = np.zeros(n, dtype=bool)
        valid[:m] = self.doc[:m] == self.doc[width - 1 :]
        return out, valid


def sequence_hashes(hashes: np.ndarray) -> np.ndarray:
    """The hash of each row of word hashes, as :meth:`Words.grams` gives it."""
    n = hashes.shape[1]
    return mix((hashes * _power(_B_SEQ, n)).sum(axis=1, dtype=np.uint64) + np.uint64(n))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """``min(values[i : i + width])`` for each i; the last ``width - 1`` are partial."""
    out, span = values.copy(), 1
    while span * 2 <= width:
        out[:-span] = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width and len(out) > width - span:
        d = width - span
        out[:-d] = np.minimum(out[:-d], out[d:])
    return out


def changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it in any column."""
    n = len(columns[0])
    out = np.ones(n, dtype=bool)
    if n:
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    values = np.sort(values)
    return values[changes(values)]


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's signed longs."""
    return values.astype(np.uint64).view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow list array out of flat longs and the length of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))
