"""Vectorised text kernels for Arrow batches: words of UTF-8 buffers and their 64-bit hashes; and which columns
such a batch carries beside new ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ONE, A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0xD6E8FEB86659FD93)
CHUNK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x + ONE
    x = (x ^ (x >> np.uint64(30))) * A
    x = (x ^ (x >> np.uint64(27))) * B
    return x ^ (x >> np.uint64(31))


LETTER = mix(np.arange(256, dtype=np.uint64))
_POWERS = [np.array([1], np.uint64)]


def powers(n: int) -> np.ndarray:
    have = _POWERS[0]
    if len(have) < n:
        size = max(n, 2 * len(have), 64)
        with np.errstate(over="ignore"):
            out = np.full(size, BASE, np.uint64)
            out[0] = 1
            _POWERS[0] = have = np.multiply.accumulate(out)
    return have


def separators(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: White space as word counts here define it.
SPACE = separators(b" \t\n\x0b\x0c\r")
#: Anything in ASCII that isn't a letter or digit.
NOT_WORD = separators(bytes(b for b in range(128) if not chr(b).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole texts of about ``limit`` bytes; null is empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    if not len(col):
        return
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """Words of a chunk: start and end in the buffer, row of each, and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray, longest: int | None = None) -> None:
        """longest: words of more bytes are cut into pieces of so many."""
        inside = ~separator[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[True], ~inside[:-1]]) if n else np.zeros(0, bool)
        after = np.concatenate([~inside[1:], [True]]) if n else np.zeros(0, bool)
        self.start = np.flatnonzero(inside & (before | edge[:n]))
        self.end = np.flatnonzero(inside & (after | edge[1:])) + 1
        if longest and int((self.end - self.start).max(initial=0)) > longest:
            parts = -(-(self.end - self.start) // longest)
            nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
            stop = np.repeat(self.end, parts)
            self.start = np.repeat(self.start, parts) + nth * longest
            self.end = np.minimum(self.start + longest, stop)
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.size = self.end - self.start
        self.first = np.cumsum(self.size) - self.size
        self.letters = LOWER[data[inside]]
        self.place = np.arange(len(self.letters)) - np.repeat(self.first, self.size)
        self.values = LETTER[self.letters] * powers(int(self.size.max(initial=1)))[self.place]

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """Hash of each word, or of its first ``prefix`` bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        values, size = self.values, self.size
        if prefix is not None:
            values, size = np.where(self.place < prefix, values, np.uint64(0)), np.minimum(size, prefix)
        return mix(np.add.reduceat(values, self.first) + size.astype(np.uint64) * ONE)


def shingles(words: Words, rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct n-word shingles of each row, sorted by row and hash.

    A row of fewer than n words has its whole word sequence as the one shingle; none without words.
    """
    h, doc = words.hashes(), words.doc
    count = np.bincount(doc, minlength=rows)
    first = np.cumsum(count) - count
    out, where = [], []
    for size in range(1, n + 1):
        if size == n:
            at = np.flatnonzero(doc[: len(h) - n + 1] == doc[n - 1 :]) if len(h) >= n else np.zeros(0, np.int64)
        else:
            at = first[count == size]
        acc = np.full(len(at), size, np.uint64)
        for j in range(size):
            acc = mix(acc * A + h[at + j])
        out.append(acc)
        where.append(doc[at] if len(at) else at)
    h, doc = np.concatenate(out), np.concatenate(where)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def beside(df: DataFrame, text_col: str, new: list[str]) -> tuple[DataFrame, int, list[str]]:
    """``df`` without columns of the new names, the place of the text in it, and the names of the columns that stay;
    a text whose own name is one of the new is carried as one column more."""
    taken = {n.lower() for n in new}
    kept = [c for c in df.columns if c.lower() not in taken]
    if text_col.lower() in taken:
        return df.select(*kept, F.col(text_col).alias("__text")), len(kept), kept
    return df.select(*kept), [c.lower() for c in kept].index(text_col.lower()), kept
