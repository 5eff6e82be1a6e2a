"""Language-model scores of documents: a PPM trie of byte contexts beside a unigram word model.

Both models count all documents that are learned from. Texts are read three times: for the trie, for the
words, and once to score them by both; the rows written then hold no text, only sums and the words that
are too rare to be broadcast. Where the trie exceeds ``ppm.MOST_EDGES`` edges, further passes over the texts
add what its other parts give.

Defined cases: those of ``ppm`` and ``unigram``; a null id takes part in learning as the empty id; rows
that repeat an id give a row each; a table without rows gives none. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusx.llm import ppm, unigram
from corpusx.scratch import Scratch


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def lm_scores(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ppm.ORDER, smooth: float = unigram.SMOOTH,
    most_edges: int | None = None, most_frequent: int | None = None, scratch: Scratch | None = None,
) -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score (log10 probability by words) and score (by the trie).

    learn: which rows the models learn from. most_edges and most_frequent bound what is broadcast; they change no result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lm")
    taught = docs.where(learn)
    top = ppm.train(taught, scratch, order, text_col)
    counts = scratch.keep(unigram.word_counts(taught, text_col), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0)).alias("e")).first()
    known = unigram.frequent(counts, most_frequent).toArrow()
    known = unigram.Frequent(known["word"].to_pylist(), known["n"].to_numpy().astype(np.int64))

    given = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    turns, first, sums = ppm.parts(top, order, most_edges), None, None
    for part in turns:
        if first is None:
            first = scratch.keep(both(given, part, known, smooth), "first")
        else:
            one = scratch.keep(ppm.pass_of(given.select("__row", "__text"), part), "pass")
            sums = one if sums is None else sums.unionByName(one)
    rare = unigram.of_rare(first, counts, smooth)
    out = first.join(rare, "__row", "left")
    if sums is not None:
        out = out.join(sums.groupBy("__row").agg(F.sum("score").alias("more")), "__row").withColumn("score", F.col("score") + F.col("more"))
    tokens = F.col("words") + 1
    each = float(np.log10(total["n"] + smooth * (total["v"] + 1)))
    return out.select(
        F.col("__id").alias(id_col), tokens.alias("n_tokens"), (F.col("known") + F.coalesce("rare_known", F.lit(0)) + int(total["e"] > 0)).alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rare_log", F.lit(0.0)) + float(np.log10(total["e"] + smooth)) - tokens * each).alias("base_score"), "score",
    )


def both(rows: DataFrame, part: ppm.Part, known: unigram.Frequent, smooth: float) -> DataFrame:
    """Rows (__row, __id, __text) without their texts, scored by the first part of the trie and by the frequent words."""
    shared = rows.sparkSession.sparkContext.broadcast((part, known))
    schema = rows.select("__row", "__id").withColumns({"words": F.lit(0).cast("long"), "known": F.lit(0).cast("long"), "logs": F.lit(0.0), "score": F.lit(0.0)})
    schema = schema.withColumn("rare", F.lit(None).cast("array<struct<word:binary,n:bigint>>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, frequent = shared.value
        for b in batches:
            words, hits, logs, rare = unigram.of_texts(b.column(2), frequent, smooth)
            arrays = [b.column(0), b.column(1), pa.array(words), pa.array(hits), pa.array(logs), pa.array(trie.of_texts(b.column(2))), rare]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return rows.mapInArrow(run, schema)


def op12_lm_scores(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = lm_scores(docs, ~held_out(F.col("doc_id")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
