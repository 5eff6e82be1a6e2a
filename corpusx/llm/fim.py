"""Fill-in-middle transformation by block rotation in place.

A text is cut into prefix, middle and suffix at two of its line ends. The sentinels are inserted into the
text's bytearray where the parts meet, and two neighbouring blocks change places by three reversals
(each block, then both together), so no second copy of the text is made. The output alone gives the text
back: its sentinels are found, the blocks are rotated back, the sentinels are cut out.

    psm  <P>prefix<S>suffix<M>middle       from <P>prefix | <M>middle | <S>suffix, last two exchanged
    spm  <S>suffix<P>prefix<M>middle       from <P>prefix<M>middle | <S>suffix, both exchanged

Defined cases: a null text counts as empty; an empty text, and one that holds a sentinel, stays plain, as do
those that the rate leaves out; cuts may coincide, so any part may be empty; a null id draws as the text
``null``; rows that repeat an id are cut by the same draws, each in its own text; a table without rows
gives none. Columns of the input that clash with a result are replaced; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusx.scratch import small_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes that a reversal exchanges at a time.
BLOCK = 1 << 16
NEWLINE = 10


def reverse(buf: np.ndarray, lo: int, hi: int) -> None:
    """Reverse ``buf[lo:hi]`` in place, a block from each end at a time."""
    while hi - lo > 1:
        n = min(BLOCK, (hi - lo) // 2)
        left = buf[lo : lo + n].copy()
        buf[lo : lo + n] = buf[hi - n : hi][::-1]
        buf[hi - n : hi] = left[::-1]
        lo, hi = lo + n, hi - n


def exchange(buf: bytearray, lo: int, mid: int, hi: int) -> None:
    """Let the blocks ``[lo:mid]`` and ``[mid:hi]`` change places in place."""
    view = np.frombuffer(buf, np.uint8)
    reverse(view, lo, mid)
    reverse(view, mid, hi)
    reverse(view, lo, hi)


def rearrange(buf: bytearray, a: int, b: int, form: str) -> None:
    """Turn a text with cuts at bytes ``a <= b`` into its form, in place."""
    buf[b:b] = SUFFIX
    buf[a:a] = MIDDLE
    buf[0:0] = PREFIX
    mid = a + len(PREFIX)
    suffix = b + len(PREFIX) + len(MIDDLE)
    exchange(buf, mid if form == "psm" else 0, suffix, len(buf))


def restore(buf: bytearray, form: str) -> None:
    """Turn an output back into its text, in place; plain outputs are their texts."""
    if form == "plain":
        return
    middle = buf.index(MIDDLE)  # no part holds a sentinel, and two sentinels can't overlap
    if form == "psm":
        at = buf.index(SUFFIX)
        exchange(buf, at, middle, len(buf))
        suffix = at + len(buf) - middle
        cuts = (suffix, at, 0)
    else:
        at = buf.index(PREFIX)
        exchange(buf, 0, at, len(buf))
        cuts = (len(buf) - at, middle - at, 0)
    for cut in cuts:
        del buf[cut : cut + len(PREFIX)]


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers that depend on the seed and the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def characters(data: np.ndarray) -> int:
    return int(((data & 0xC0) != 0x80).sum())


def transformed(texts: pa.Array, h: list[np.ndarray], rate: int, spm: int) -> list[pa.Array]:
    """Output, n, form, prefix_chars and middle_chars of each text."""
    outputs, ns, forms, ps, ms = [], [], [], [], []
    for i, raw in enumerate(pc.fill_null(texts, b"")):
        buf = bytearray(raw.as_buffer())
        view = np.frombuffer(buf, np.uint8)
        ends = np.flatnonzero(view == NEWLINE) + 1
        if len(buf) and (not len(ends) or ends[-1] != len(buf)):
            ends = np.append(ends, len(buf))
        n = len(ends)
        form = "plain"
        if n and h[2][i] % 100 < rate and not any(s in buf for s in (PREFIX, SUFFIX, MIDDLE)):
            form = "spm" if h[3][i] % 100 < spm else "psm"
        p = m = None
        if form != "plain":
            x, y = sorted((int(h[0][i]) % (n + 1), int(h[1][i]) % (n + 1)))
            a, b = (int(ends[c - 1]) if c else 0 for c in (x, y))
            p, m = characters(view[:a]), characters(view[a:b])
            del view  # a bytearray that is looked at can't grow
            rearrange(buf, a, b, form)
        outputs.append(buf)
        ns.append(n)
        forms.append(form)
        ps.append(p)
        ms.append(m)
    return [pa.array(outputs, pa.binary()), pa.array(ns, pa.int64()), pa.array(forms), pa.array(ps, pa.int64()), pa.array(ms, pa.int64())]


def fim_transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with output, n (lines), form, prefix_chars and middle_chars (null if plain).

    rate: percentage of texts that are transformed; spm: percentage of those that take the form spm.
    """
    small_batches(docs.sparkSession)
    new = ["output", "n", "form", "prefix_chars", "middle_chars"]
    kept = [c for c in docs.columns if c.lower() not in new]
    given = docs.select(F.struct(*kept).alias("__all"), F.col(text_col).cast("binary").alias("__text"), *[h.alias(f"__h{i}") for i, h in enumerate(draws(F.col(id_col), seed))])
    schema = given.select("__all").withColumns({"output": F.lit(b""), "n": F.lit(0).cast("long"), "form": F.lit(""), "prefix_chars": F.lit(None).cast("long"), "middle_chars": F.lit(None).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [b.column(2 + i).to_numpy(zero_copy_only=False) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *transformed(b.column(1), h, rate, spm)], schema.names)

    out = given.mapInArrow(run, schema)
    return out.select(*[F.col("__all")[c].alias(c) for c in kept], F.col("output").cast("string").alias("output"), *new[1:])


def fim_restore(docs: DataFrame, output_col: str = "output", form_col: str = "form", out_col: str = "restored") -> DataFrame:
    """``docs`` with ``out_col``, the text rebuilt from output and form alone (null where the output is null)."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != out_col.lower()]
    given = docs.select(F.struct(*kept).alias("__all"), F.col(output_col).cast("binary").alias("__output"), F.col(form_col).alias("__form"))
    schema = given.select("__all").withColumn("restored", F.lit(None).cast("binary")).schema

    def rebuilt(output: pa.Scalar, form: str | None) -> bytearray | None:
        if not output.is_valid:
            return None
        buf = bytearray(output.as_buffer())
        restore(buf, form or "plain")
        return buf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [rebuilt(o, f) for o, f in zip(b.column(1), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary())], schema.names)

    out = given.mapInArrow(run, schema)
    return out.select(*[F.col("__all")[c].alias(c) for c in kept], F.col("restored").cast("string").alias(out_col))


def op11_fim(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fim_transform(docs).select("doc_id", "output", "n", "form", "prefix_chars", "middle_chars")
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return fim_restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents
), d AS (
  SELECT doc_id, text, units, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t
), c AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                               WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         coalesce(array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], ''), '') AS prefix,
         coalesce(array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], ''), '') AS middle,
         coalesce(array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], ''), '') AS suffix FROM d
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM c
"""
