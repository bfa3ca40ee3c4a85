"""Whole batches of texts as numpy arrays: words, their hashes and the rows they belong to.

Words are found in the UTF-8 bytes of all texts of a piece at once. A word's hash
is the sum of its bytes times powers of an odd number, modulo 2**64, mixed; it
does not depend on where the word stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once; a longer text is a piece of its own.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII white space: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters; bytes above 0x7F belong to words.
NOT_LETTER = np.zeros(256, bool)
NOT_LETTER[:128] = True
NOT_LETTER[65:91] = NOT_LETTER[97:123] = False

_tables = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n or more."""
    if len(_tables["p"]) < n:
        size = max(PIECE, n)
        for key, base in (("p", _BASE), ("q", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _tables[key] = np.multiply.accumulate(x)
        if size > 8 * PIECE:  # of one very long text: not kept
            big = _tables["p"], _tables["q"]
            _tables["p"] = _tables["q"] = np.ones(1, np.uint64)
            return big
    return _tables["p"], _tables["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs of hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ np.uint64(0xA0761D6478BD642F)))


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets of each text; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch, column: str = "text", limit: int = PIECE) -> Iterator:
    """Slices of a record batch or table of about limit bytes of text, a row at least."""
    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) if isinstance(texts, pa.Array) else pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    ends, at = np.cumsum(sizes.astype(np.int64)), 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop


@dataclass
class Words:
    """Words of a piece in their order; row is the text's number within the piece."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def per_row(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def prefix(self, n: int) -> np.ndarray:
        """Hashes of each word's first n bytes, or of all where it is shorter."""
        p, _ = _powers(n + 1)
        total = np.zeros(len(self.starts), np.uint64)
        for k in range(n):
            at = self.starts + k
            total += np.where(at < self.ends, self.data[np.minimum(at, len(self.data) - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0)) * p[k]
        return mix(total ^ np.uint64(n))


def split(texts, separators: np.ndarray = SPACE, lower: bool = True) -> Words:
    """The words of the texts: longest runs of bytes that are no separators."""
    raw, offsets = buffers(texts)
    data = LOWER[raw] if lower else raw
    inside = ~separators[data]
    n = len(data)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    if len(starts):
        p, q = _powers(n)
        value = (data.astype(np.uint64) + np.uint64(1)) * p[:n]
        value[~inside] = 0
        total = np.add.reduceat(value, starts) * q[starts]
        hashes = mix(total)
    else:
        hashes = np.zeros(0, np.uint64)
    return Words(data, offsets, starts, ends, row, hashes)


def unique_by_row(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, key) pairs, in the order of rows and, within one, of keys."""
    if not len(row):
        return row, key
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[keep], key[keep]


def texts_of(column) -> list[str]:
    """Texts as Python strings, nulls as empty ones."""
    return [x or "" for x in column.to_pylist()]
