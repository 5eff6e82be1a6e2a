"""BM25 of the terms that are asked for, in full or as an exact top k, where the documents lie.

The top k of a query needs few postings of its common words: its words are taken by their greatest impact, and once what is left can't
lift a new document into the top k, the postings of the remaining words are looked up for the documents that are still in question, and
not added up whole. A task does so for its own documents (``batched.py``); only the bounds of words and queries and the best
documents of each task are shuffled, and no posting but those of ids that repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusx.functions.text import tokenize
from corpusx.operators.batched import CELLS, SLACK, Block, added_up, blocks, by_word, least_ids, pieces
from corpusx.scratch import Scratch


def query_terms(queries: DataFrame, most_terms: int = 28) -> DataFrame:
    """(query_id, term): the first distinct words of more than two characters."""
    terms = F.slice(F.array_distinct(F.filter(tokenize(F.col("text")), lambda x: F.length(x) > 2)), 1, most_terms)
    return queries.select("query_id", F.explode(terms).alias("term"))


def bm25_scores(queries: DataFrame, docs: DataFrame, most_terms: int = 28, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, doc_id, score) of every document that holds a word of a query (query_id, text), scored where the document lies."""
    scratch = scratch or Scratch(docs.sparkSession, "bm25")
    asked = scratch.keep(query_terms(queries, most_terms), "asked")
    return reduce(DataFrame.unionByName, [x.scores() for x in blocks(queries, asked, docs, scratch, by_id=True)])


def greatest(block: Block) -> np.ndarray:
    """The greatest weight of each word of a block."""
    weigh, words = block.weigh, len(block.df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros(words)
        for b in batches:
            _, term, weight = weigh(b)
            np.maximum.at(most, term, weight)
        at = np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(most[at])], names=["term", "most"])

    most = np.zeros(words)
    for r in block.counts.mapInArrow(run, "term int, most double").groupBy("term").agg(F.max("most").alias("most")).collect():
        most[r["term"]] = r["most"]
    return most


def kth(block: Block, pairs: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query by the words of ``pairs`` alone, 0 where fewer documents have one."""
    weigh, size, (starts, wants) = block.weigh, block.size, by_word(pairs, len(block.df))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros((k, size))
        for b in batches:
            for part in pieces(b, size):
                both = np.concatenate([top, added_up(*weigh(part), starts, wants, part.num_rows, size)])
                top = np.partition(both, len(both) - k, axis=0)[-k:]
        place, nth = np.nonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(nth, pa.int32()), pa.array(top[place, nth])], names=["nth", "score"])

    place = F.row_number().over(Window.partitionBy("nth").orderBy(F.desc("score")))
    floor = np.zeros(size)
    for r in block.counts.mapInArrow(run, "nth int, score double").withColumn("place", place).where(F.col("place") == k).collect():
        floor[r["nth"]] = r["score"]
    return floor


def top_of(block: Block, k: int, scratch: Scratch) -> DataFrame:
    """The rows of ``bm25_top`` for a block of queries."""
    weigh, size, words = block.weigh, block.size, len(block.df)
    most = greatest(block)
    pairs = block.pairs[block.df[block.pairs[:, 0]] > 0]
    pairs = pairs[np.lexsort((pairs[:, 0], -most[pairs[:, 0]], pairs[:, 1]))]
    term, query = pairs[:, 0], pairs[:, 1]
    first = np.searchsorted(query, np.arange(size))

    def before(x: np.ndarray) -> np.ndarray:
        """Sum of the words that come before each word of its query."""
        run = np.cumsum(x) - x
        return run - run[first[query]]

    # a first floor: the k-th best by the words of most impact, enough of them to meet some documents
    floor = kth(block, pairs[before(block.df[term]) < 4 * k], k)
    # a document without any essential word can't reach the floor
    essential = np.bincount(query, most[term], size)[query] - before(most[term]) >= floor[query] - SLACK
    hope = np.bincount(query[~essential], most[term[~essential]], size)
    whole, postings = (np.bincount(query[x], block.df[term[x]], size).astype(np.int64) for x in (essential, slice(None)))
    starts, wants = by_word(pairs[essential], words)
    least = np.maximum(floor, kth(block, pairs[essential], k)) - SLACK
    others, from_ = term[~essential], np.searchsorted(query[~essential], np.arange(size + 1))
    step = max(1, CELLS // max(1, np.diff(from_).max(initial=0)))

    def looked_up(row: np.ndarray, term: np.ndarray, weight: np.ndarray, cells: np.ndarray, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the other words of the queries ``asking`` add to the rows ``cells``, and how many of them occur."""
        more, found, held = np.zeros(len(cells)), np.zeros(len(cells), np.int64), row.astype(np.int64) * words + term
        for at in range(0, len(cells) if len(held) else 0, step):
            mine, of = cells[at : at + step], asking[at : at + step]
            times = from_[of + 1] - from_[of]
            cell = np.repeat(np.arange(len(of)), times)
            key = mine[cell] * words + others[np.repeat(from_[of] - np.cumsum(times) + times, times) + np.arange(times.sum())]
            place = np.minimum(np.searchsorted(held, key), len(held) - 1)
            hit = held[place] == key
            more[at : at + step] = np.bincount(cell[hit], weight[place[hit]], len(of))
            found[at : at + step] = np.bincount(cell[hit], minlength=len(of))
        return more, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, looked = np.zeros((k, size)), np.zeros(size, np.int64)
        for b in batches:
            for part in pieces(b, size):
                made = weigh(part)
                table = added_up(*made, starts, wants, part.num_rows, size)
                row, nth = np.nonzero((table > 0) & (table + hope >= least))
                more, found = looked_up(*made, row, nth)
                score = table[row, nth] + more
                looked += np.bincount(nth, found, size).astype(np.int64)
                table[:] = 0
                table[row, nth] = score
                both = np.concatenate([top, table])
                top = np.partition(both, len(both) - k, axis=0)[-k:]
                kept = score >= top.min(axis=0)[nth] - SLACK
                row, nth, score = row[kept], nth[kept], score[kept]
                kept = least_ids(part.column(0).take(pa.array(row)), score, nth, k)
                ids = part.column(0).take(pa.array(row[kept]))
                yield pa.RecordBatch.from_arrays([pa.array(nth[kept], pa.int32()), ids, pa.array(score[kept]), pa.nulls(len(kept), pa.int64())], names=names)
        if not looked.any():
            return
        at = np.flatnonzero(looked)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.nulls(len(at), b.column(0).type), pa.nulls(len(at), pa.float64()), pa.array(looked[at])], names=names)

    names = ["nth", "doc_id", "score", "looked"]
    fields = f"nth int, doc_id {block.counts.schema['doc_id'].dataType.simpleString()}, score double, looked long"
    found = scratch.keep(block.counts.mapInArrow(run, fields), "found")
    looked = found.where("looked is not null").groupBy("nth").agg(F.sum("looked").alias("looked"))
    spent = scratch.spark.createDataFrame(list(zip(range(size), whole.tolist(), postings.tolist())), "nth int, whole long, postings long").join(F.broadcast(looked), "nth", "left")
    order = Window.partitionBy("nth").orderBy(F.desc("score"), "doc_id")
    top = found.where("score is not null").select("nth", "doc_id", F.round("score", 4).alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(F.broadcast(spent), "nth").join(F.broadcast(block.names), "nth").select("query_id", "doc_id", "rank", "score", (F.col("whole") + F.coalesce("looked", F.lit(0))).alias("joined"), "postings")


def bm25_top(queries: DataFrame, docs: DataFrame, k: int = 10, most_terms: int = 28, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, doc_id, rank, score, joined, postings): the k best documents of each query by score rounded to four places, then id.

    joined: postings that were added up for this query (whole ones of its essential words, single ones of the others); postings: all that its words have.
    The same documents as cutting ``bm25_scores`` gives. A query none of whose words occurs has no row.
    """
    scratch = scratch or Scratch(docs.sparkSession, "bm25")
    asked = scratch.keep(query_terms(queries, most_terms), "asked")
    return reduce(DataFrame.unionByName, [top_of(x, k, scratch) for x in blocks(queries, asked, docs, scratch, by_id=True)])
