"""Word counts of a corpus and unigram log probabilities with add-k smoothing.

A text's tokens are its words, A to Z lower-cased, and one end token, kept as the null word. Counts are
taken over all training texts, per task first. To score, the most frequent words (``MOST_FREQUENT`` at most,
whole count classes by powers of two, of at most ``LONGEST`` bytes each) are broadcast to the texts; a
text keeps its other words as a list, and only those are shuffled to their counts, so no row of a
frequent word moves.

Defined cases: a null text counts as empty and has the end token alone; without training texts every token
has probability 1; very long texts are read in pieces cut at white space. Words are told apart by 64-bit
hashes within a piece and among the broadcast ones, by their bytes everywhere else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusx.llm.kernels import SPACE, Words, chunks
from corpusx.llm.ppm import PIECE, Index
from corpusx.scratch import small_batches

MOST_FREQUENT = 1 << 18
LONGEST = 64
SMOOTH = 0.1


def pieces(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As ``chunks``, but a very long text comes in pieces cut at white space, so no word is cut."""
    for lo, hi, data, at in chunks(col):
        if len(data) <= PIECE:
            yield lo, hi, data, at
            continue
        for r in range(hi - lo):
            text = data[at[r] : at[r + 1]]
            cut = 0
            while cut < len(text):
                end = cut + PIECE
                while end < len(text) and not (gap := SPACE[text[end : end + PIECE]]).any():
                    end += PIECE
                end = len(text) if end >= len(text) else end + int(gap.argmax())
                yield lo + r, lo + r + 1, text[cut:end], np.array([0, end - cut])
                cut = end


class Distinct:
    """Distinct words of a piece: number of each in each row, and the words' bytes on demand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: int) -> None:
        w = Words(data, offsets, SPACE)
        self.hashes, self.sample, which = np.unique(w.hashes().view(np.int64), return_index=True, return_inverse=True)
        pair, self.n = np.unique(w.doc * max(1, len(self.hashes)) + which, return_counts=True)
        self.row, self.word = np.divmod(pair, max(1, len(self.hashes)))
        self.words_of = np.bincount(w.doc, minlength=rows)
        ends = np.append(w.first, len(w.letters)).astype(np.int64)
        self._all = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.first), [None, pa.py_buffer(ends), pa.py_buffer(w.letters)])

    def bytes_of(self, word: np.ndarray) -> pa.Array:
        return self._all.take(pa.array(self.sample[word])).cast(pa.binary())


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): tokens of all texts; the null word is the end token."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = 0
        for b in batches:
            ends += b.num_rows
            for lo, hi, data, at in pieces(b.column(0)):
                d = Distinct(data, at, hi - lo)
                if len(d.hashes):
                    n = np.bincount(d.word, weights=d.n, minlength=len(d.hashes)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([d.bytes_of(np.arange(len(n))), pa.array(n)], ["word", "n"])
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([ends])], ["word", "n"])

    return docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int | None = None) -> DataFrame:
    """The words of ``counts`` that are broadcast."""
    most = most or MOST_FREQUENT
    short = counts.where((F.octet_length("word") <= LONGEST) & F.col("word").isNotNull())
    level = F.floor(F.log2("n")).cast("int")
    found = {r["level"]: r["count"] for r in short.groupBy(level.alias("level")).count().collect()}
    least, room = 64, most
    for at in sorted(found, reverse=True):
        if found[at] > room:
            break
        least, room = at, room - found[at]
    return short.where(level >= least)


class Frequent:
    """The broadcast words by their hash."""

    def __init__(self, words: list[bytes], n: np.ndarray) -> None:
        self.made: Index | None = None
        data = np.frombuffer(b"".join(words), np.uint8)
        h = Words(data, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64), SPACE).hashes().view(np.int64)
        self.hashes, at = np.unique(h, return_index=True)
        self.n = n[at]

    def index(self) -> Index:
        """Made once a worker."""
        self.made = self.made or Index(self.hashes)
        return self.made


def of_texts(col: pa.Array, known: Frequent, smooth: float = SMOOTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Per text: words; how many are frequent; sum of log10(count + smooth) over those; list of the other words (word, n)."""
    index, rows = known.index(), len(col)
    words, hits, logs = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows)
    row, word, n = [], [], []
    for lo, hi, data, at in pieces(col):
        d = Distinct(data, at, hi - lo)
        if not len(d.hashes):
            continue
        place = index.find(d.hashes)
        log = np.where(place >= 0, np.log10(known.n[place] + smooth) if len(known.n) else 0.0, 0.0)
        words[lo:hi] += d.words_of
        own = place[d.word] >= 0
        hits[lo:hi] += np.bincount(d.row[own], weights=d.n[own], minlength=hi - lo).astype(np.int64)
        logs[lo:hi] += np.bincount(d.row[own], weights=d.n[own] * log[d.word[own]], minlength=hi - lo)
        row.append(d.row[~own] + lo)
        word.append(d.bytes_of(d.word[~own]))
        n.append(d.n[~own])
    each = np.bincount(np.concatenate(row), minlength=rows) if row else np.zeros(rows, np.int64)
    values = pa.StructArray.from_arrays(
        [pa.concat_arrays(word) if word else pa.array([], pa.binary()), pa.array(np.concatenate(n) if n else [], pa.int64())], ["word", "n"]
    )
    return words, hits, logs, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), values)


def of_rare(rows: DataFrame, counts: DataFrame, smooth: float = SMOOTH) -> DataFrame:
    """(__row, rare_known, rare_log) for a table (__row, rare) of lists: what ``of_texts`` sums up, for the other words."""
    rare = rows.select("__row", F.explode("rare").alias("r")).select("__row", "r.word", F.col("r.n").alias("times"))
    c = F.coalesce(F.col("n"), F.lit(0))
    joined = rare.join(counts.where(F.col("word").isNotNull()), "word", "left")
    return joined.groupBy("__row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"), F.sum(F.col("times") * F.log10(c + F.lit(smooth))).alias("rare_log")
    )
