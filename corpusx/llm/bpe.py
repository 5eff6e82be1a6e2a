"""BPE encoding and decoding.

A pre-token is encoded by backtracking: Aho-Corasick gives the longest token at every byte, and a
token may follow another only if merging the two by rank would keep the boundary between them. The
first chain of such tokens that reaches the end is exactly what applying the merges would give,
and every byte is passed a bounded number of times. Distinct pre-tokens are encoded once per
worker while a bounded memo holds them. Decoding gathers bytes through an offset table.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to the empty
text; strings of added tokens inside a text become those tokens; repeated rows give repeated
results; other columns pass through untouched, those called like a new one are replaced.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusx.llm.kernels import beside
from corpusx.scratch import small_batches

#: Fixed value: the split pattern of byte-level BPE vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens of each half of the memo: the half that fills and the one that was full before it.
MEMO = 200_000
#: Code points of a pre-token that is remembered at all, so that the memo is bounded in bytes too.
MEMO_LENGTH = 64
_LOADED: dict[str, Codec] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies, and back."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder for a byte-level ``tokenizer.json`` file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: as_bytes(s) for s, i in spec["model"]["vocab"].items() if s not in added}
        id_of = {b: i for i, b in self.bytes_of.items()}
        # rank: when a token comes to be; single bytes first, then by merge
        self.rank = {i: -1 for i, b in self.bytes_of.items() if len(b) == 1}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for n, m in enumerate(spec["model"]["merges"]):
            left, right = (id_of[as_bytes(x)] for x in (m.split(" ") if isinstance(m, str) else m))
            whole = id_of[self.bytes_of[left] + self.bytes_of[right]]
            self.merged[left, right] = n
            if whole not in self.rank:
                self.rank[whole], self.parts[whole] = n, (left, right)
        self.shorter: dict[int, int | None] = {}
        for i, b in self.bytes_of.items():
            self.shorter[i] = next((id_of[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in id_of), None)
        self.tokens = ahocorasick.Automaton()
        for b, i in id_of.items():
            self.tokens.add_word(b.decode("latin-1"), (len(b), i))
        self.tokens.make_automaton()
        self.id_of, self.fits_memo, self.memo, self.older = id_of, {}, {}, {}
        self.added = added
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pretoken = regex.compile(PRETOKEN)
        table = dict(self.bytes_of) | {i: s.encode() for s, i in added.items()}
        lengths = np.zeros(max(table) + 1, np.int64)
        for i, b in table.items():
            lengths[i] = len(b)
        self.offset = np.concatenate([[0], np.cumsum(lengths)])
        self.pool = np.frombuffer(b"".join(table.get(i, b"") for i in range(len(lengths))), np.uint8)

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave a boundary between these two tokens standing next to each other.

        Both are undone merge by merge from the latest; a merge across the boundary that would have
        come before the next one to be undone would have joined them.
        """
        found = self.fits_memo.get((left, right))
        if found is None:
            a, b, until = left, right, 1 << 60
            while True:
                across = self.merged.get((a, b))
                if across is not None and across < until:
                    found = False
                    break
                ra, rb = self.rank[a], self.rank[b]
                if ra < 0 and rb < 0:
                    found = True
                    break
                # the later merge is undone; of equal ones the right, since merges go left to right,
                # and for that reason the same merge across the boundary comes before the right one
                if ra > rb:
                    until, a = ra, self.parts[a][1]
                else:
                    until, b = rb + 1, self.parts[b][0]
            if len(self.fits_memo) < 150_000:
                self.fits_memo[left, right] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.id_of.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [0] * n
        for end, (size, i) in self.tokens.iter(piece.decode("latin-1")):
            longest[end - size + 1] = i
        size_of, shorter, fits = self.bytes_of, self.shorter, self.fits
        alive, out, at, token = bytearray(b"\x01" * (n + 1)), [], 0, longest[0]
        while True:
            end = at + len(size_of[token])
            if alive[end] and (not out or fits(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            elif shorter[token] is not None:
                token = shorter[token]
            else:  # nothing fits here: this place is not a boundary
                alive[at] = 0
                token = out.pop()
                at -= len(size_of[token])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        memo = self.memo
        for part in self.special.split(text) if self.special else [text]:
            if part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
                continue
            for p in self.pretoken.findall(part):
                ids = memo.get(p)
                if ids is None:
                    ids = self.older.get(p)
                    if ids is None:
                        ids = np.array(self.encode_piece(p.encode()), "<u4").tobytes()
                    if len(p) <= MEMO_LENGTH:
                        if len(memo) >= MEMO:  # what is asked for again comes back from the older half
                            self.older, self.memo = memo, {}
                            memo = self.memo
                        memo[p] = ids
                out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids, with U+FFFD for bytes that aren't UTF-8."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        start = self.offset[i]
        size = self.offset[i + 1] - start
        first = np.cumsum(size) - size
        where = np.repeat(start - first, size) + np.arange(int(size.sum()))
        return self.pool[where].tobytes().decode("utf-8", "replace")


def codec(path: str) -> Codec:
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
    return _LOADED[path]


def add_column(df: DataFrame, text_col: str, fields: list[tuple[str, T.DataType, pa.DataType]], fn) -> DataFrame:
    """``df`` with columns that ``fn`` makes from the values of ``text_col``, batch by batch, in place of
    columns of their names."""
    small_batches(df.sparkSession)
    df, at, names = beside(df, text_col, [n for n, _, _ in fields])
    types = [t for _, _, t in fields]
    schema = T.StructType([*df.schema.fields[: len(names)], *[T.StructField(n, t) for n, t, _ in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                s = b.slice(lo, 500)
                made = fn(s.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*s.columns[: len(names)], *[pa.array(m, t) for m, t in zip(made, types, strict=True)]], [*names, *[n for n, _, _ in fields]])

    return df.mapInArrow(run, schema)


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col``: the ids of the text, packed as little-endian unsigned 32-bit integers."""
    return add_column(df, text_col, [(ids_col, T.BinaryType(), pa.binary())], lambda texts: [[codec(path).encode(x or "") for x in texts]])


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col``: the text of packed ids (null: empty)."""
    return add_column(df, ids_col, [(out_col, T.StringType(), pa.string())], lambda ids: [[codec(path).decode(x or b"") for x in ids]])


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def bpe_both(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` with ids and decoded: encoding and decoding in one pass, so that one worker a task holds the vocabulary."""

    def both(texts: list[str | None]) -> list[list]:
        c = codec(path)
        ids = [c.encode(x or "") for x in texts]
        return [ids, [c.decode(i) for i in ids]]

    return add_column(df, text_col, [("ids", T.BinaryType(), pa.binary()), ("decoded", T.StringType(), pa.string())], both)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, number and digest of its ids, digest of what they decode to."""
    return bpe_both(docs.select("doc_id", "text"), path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
