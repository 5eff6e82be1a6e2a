"""Token counts without token ids.

Every block of documents is cut into pre-tokens; the pieces of each distinct pre-token of the block
are counted once by the tokenizer library, the counts are joined to the (document, pre-token,
frequency) rows of the block and summed per document. Blocks are what a task reads at a time, so
nothing is shuffled; counts stay in a bounded memo of the worker between blocks.

Defined cases: a null text counts as empty and has 0 tokens; strings of added tokens count as those
tokens, as the library does by default; a very long text is a block of its own and is held whole; rows that repeat an id give a row
each; a table without rows gives none; only the named columns are read.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusx.llm.bpe import MEMO_LENGTH, PRETOKEN
from corpusx.scratch import small_batches

MEMO = 200_000
BLOCK_BYTES = 4 << 20
_LOADED: dict[str, PieceCounter] = {}


class PieceCounter:
    """Number of pieces of a pre-token by the tokenizers library."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = set(added)
        self.special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.pretoken = regex.compile(PRETOKEN)
        self.memo: dict[str, int] = {}

    def frequencies(self, text: str) -> Counter:
        """Pre-tokens of a text with their frequencies; added tokens stand for themselves."""
        if self.special is None or not any(a in text for a in self.added):
            return Counter(self.pretoken.findall(text))
        found: Counter = Counter()
        for part in self.special.split(text):
            found.update([part] if part in self.added else self.pretoken.findall(part))
        return found

    def pieces(self, distinct: list[str]) -> np.ndarray:
        new = [p for p in distinct if p not in self.memo]
        found: dict[str, int] = {}
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            for p, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                found[p] = len(e)
        out = np.fromiter((found[p] if p in found else self.memo[p] for p in distinct), np.int64, len(distinct))
        if len(self.memo) + len(found) > MEMO:
            self.memo.clear()
        self.memo |= {p: n for p, n in found.items() if len(p) <= MEMO_LENGTH}
        return out


def counter(path: str) -> PieceCounter:
    if path not in _LOADED:
        _LOADED[path] = PieceCounter(path)
    return _LOADED[path]


def count_block(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text of a block."""
    c = counter(path)
    number: dict[str, int] = {}
    doc, piece, freq = [], [], []
    for d, t in enumerate(texts):
        found = c.frequencies(t)
        doc.append(np.full(len(found), d))
        piece.append(np.fromiter((number.setdefault(p, len(number)) for p in found), np.int64, len(found)))
        freq.append(np.fromiter(found.values(), np.int64, len(found)))
    if not number:
        return np.zeros(len(texts), np.int64)
    each = c.pieces(list(number))
    doc, piece, freq = map(np.concatenate, (doc, piece, freq))
    return np.bincount(doc, weights=each[piece] * freq, minlength=len(texts)).astype(np.int64)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit."""
    small_batches(docs.sparkSession)
    given = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    id_type = given.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            cut = np.flatnonzero(np.diff(np.cumsum(size) // BLOCK_BYTES)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(size)], strict=True):
                n = count_block(b.column(1).slice(lo, hi - lo).to_pylist(), path)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(size[lo:hi]), pa.array(n)], [id_col, "n_bytes", "n_tokens"])

    out = given.mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
