"""A guard on streams of text deltas: the first forbidden n-gram of each stream, as soon as its last
word is complete.

The state of a stream is its last words, the part of a word that may go on, deltas that came too early, and whether it is closed. A small
index of forbidden n-grams is broadcast as 64-bit hashes, which tell its n-grams apart; a large one is never held by a worker: the n-grams that a
micro-batch completes are joined to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusx.functions.spans import folded
from corpusx.functions.text import WORD

#: n-grams of an index that is broadcast (8 bytes each to every worker); a larger one is joined batch by batch.
MOST_GRAMS = 5_000_000
STATE = "tail string, words array<string>, before long, closed boolean, next long, early array<struct<seq:long,delta:string>>"
FRESH = ("", [], 0, False, 0, [])
#: The seed of word hashes, and the odd factor by which a hash of words grows.
SEED, ODD = 42, 0x9E3779B97F4A7C15
#: Words of a text that are looked at together, and words whose hashes a worker remembers.
BLOCK, MOST_WORDS = 50_000, 200_000


class WordHashes(dict):
    """64-bit hashes of words, remembered until there are ``MOST_WORDS``."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode(), SEED)
        return h


def gram_hashes(words: list[str], n: int, known: WordHashes) -> np.ndarray:
    """64-bit hash of every run of n words, in order."""
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n if len(out) else 0):
        out = out * np.uint64(ODD) + h[j : j + len(out)]
    return out


def index_hashes(grams: DataFrame) -> np.ndarray:
    """Sorted hashes of n-grams (gram), made where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            found = [gram_hashes(words := g.split(" "), len(words), known) for g in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))], ["h"])

    made = grams.where("gram is not null").select("gram").mapInArrow(run, "h long").toArrow()["h"].to_numpy()
    return np.sort(made.astype(np.int64).view(np.uint64))


def completed(deltas: DataFrame, n: int, hashes, ordered: bool, idle: int | None) -> DataFrame:
    """(stream_id, word_pos, gram) of n-grams as streams complete them: all of them, or, with the broadcast ``hashes``, the
    first whose hash is among them, after which a stream is closed."""
    word, open_end, remembered = regex.compile(WORD), regex.compile(r"(?r)[\p{L}\p{N}_’'-]*"), WordHashes()
    kind = deltas.schema["stream_id"].dataType.simpleString()

    def matches(words: list[str]) -> list[int]:
        """Where the n-grams begin that are wanted: every one, or the first that is known."""
        if hashes is None:
            return list(range(len(words) - n + 1))
        if not len(hashes.value) or len(words) < n:
            return []
        h = gram_hashes(words, n, remembered)
        at = np.minimum(np.searchsorted(hashes.value, h), len(hashes.value) - 1)
        return np.flatnonzero(hashes.value[at] == h)[:1].tolist()

    def in_turn(early: list, new: list, due: int, flush: bool) -> tuple[list[str], list, int]:
        """Deltas whose turn it is, those that wait for an earlier one, and the next number."""
        rows = sorted([*early, *new], key=lambda r: r[0])
        if not ordered or flush:
            return [d for _, d in rows], [], due
        ready, wait = [], []
        for seq, delta in rows:
            if seq == due:
                ready.append(delta)
                due += 1
            elif seq > due:
                wait.append((seq, delta))
        return ready, wait, due

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, words, before, closed, due, early = state.get if state.exists else FRESH
        new = [] if state.hasTimedOut else [(int(s), d or "") for b in batches for s, d in zip(b["seq"].tolist(), b["delta"].tolist(), strict=True)]
        ready, early, due = in_turn([(r[0], r[1]) for r in early], new, due, state.hasTimedOut)
        found, words, text = [], list(words), "" if closed else tail + "".join(ready)
        # marks and letters at the end may still belong to a word
        at = open_end.match(text).start()
        complete = (m[0] for m in word.finditer(text, 0, at))
        while not closed and (more := list(islice(complete, BLOCK))):
            words += folded(" ".join(more)).split(" ")
            before += len(more)
            for i in matches(words):
                found.append((before - len(words) + i, " ".join(words[i : i + n])))
                closed = hashes is not None
            words = words[-(n - 1) :] if n > 1 else []
        if found:
            yield pd.DataFrame({"stream_id": [key[0]] * len(found), "word_pos": [p for p, _ in found], "gram": [g for _, g in found]})
        if state.hasTimedOut:
            state.remove()
            return
        state.update(("", [], before, True, due, []) if closed else (text[at:], words, before, False, due, early))
        if idle is not None:
            state.setTimeoutDuration(idle)

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return deltas.groupBy("stream_id").applyInPandasWithState(run, f"stream_id {kind}, word_pos long, gram string", STATE, "append", timeout)


def ngram_guard(deltas: DataFrame, index: DataFrame, n: int = 12, ordered: bool = False, idle: int | None = None) -> DataFrame:
    """Stream (stream_id, seq, delta) to (stream_id, word_pos, gram): the first n-gram of ``index`` (gram) that a
    stream completes, once; what follows in that stream is ignored. An index over ``MOST_GRAMS`` is for ``guard_into``.

    A word is complete when something that can't belong to it follows, in the same delta or a later one. Deltas of a micro-batch
    are taken in order of ``seq``; with ``ordered`` they are numbered from 0 without gaps, one that comes before its turn, in whatever
    micro-batch, waits in the state, and one that comes again is ignored. idle: milliseconds without deltas after which a stream's state goes;
    deltas that still wait then are read as they are. Without it, state stays for ever. It is for queries that go on: a drain with the trigger
    availableNow would not end before the last time-out.
    """
    grams = index.select("gram").distinct()
    if (size := grams.count()) > MOST_GRAMS:
        raise ValueError(f"the index has {size} n-grams, more than {MOST_GRAMS}: use guard_into")
    shared = deltas.sparkSession.sparkContext.broadcast(index_hashes(grams))
    return completed(deltas, n, shared, ordered, idle)


def guard_into(deltas: DataFrame, index: DataFrame, path: str, checkpoint: str, n: int = 12, ordered: bool = False, idle: int | None = None) -> None:
    """Drain ``deltas`` into a table at ``path`` as ``ngram_guard`` does, with an index of any size: the n-grams that a micro-batch completes are
    joined to it, and of a stream that isn't in the table yet the first match is added. A batch that is run again adds nothing twice."""
    grams = index.select("gram").distinct()
    found = completed(deltas, n, None, ordered, idle)
    schema = found.schema

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        first = batch.join(grams, "gram").groupBy("stream_id").agg(F.min(F.struct("word_pos", "gram")).alias("m")).select("stream_id", "m.*")
        if there:
            done = spark.read.schema(schema).parquet(path).select(F.col("stream_id").alias("k"))
            first = first.join(done, F.col("stream_id").eqNullSafe(F.col("k")), "left_anti")
        first.write.mode("append").parquet(path)

    found.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def deltas_of(docs: DataFrame, id_col: str, text_col: str, size: int = 400) -> DataFrame:
    """(stream_id, seq, delta): texts cut into runs of ``size`` characters, and a line end behind the last."""
    text = F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n"))
    # cut from left to right: a substring would be looked for from the beginning of the text, once a delta
    runs = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return docs.select(F.col(id_col).alias("stream_id"), F.posexplode(runs).alias("seq", "delta"))
