"""Spans worth keeping from texts that failed as a whole, and spans derived again after a change of rules.

Windows and prefixes are found and compared with sources in the row of their text (``functions.spans``); from then on rows are
offsets with hashes, and only spans that pass their gate are compared with each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusx.functions.spans import causal_windows, complete_prefix, spans_of
from corpusx.functions.text import tokenize
from corpusx.operators.overlap import found_grams, shingles, sized
from corpusx.scratch import Scratch


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def gate(text: Column, rules: Sequence[tuple[str, bool]]) -> Column:
    """Whether a text matches each pattern that it should and none that it shouldn't."""
    ok = F.lit(True)
    for pattern, wanted in rules:
        ok = ok & (text.rlike(pattern) if wanted else ~text.rlike(pattern))
    return ok


def new_spans(
    docs: DataFrame, sources: DataFrame, known: DataFrame, rules: Sequence[tuple[str, bool]], least: int = 12, most: int = 90, paragraphs: int = 3,
    n: int = 12, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None,
) -> DataFrame:
    """(id, start, stop, words, hash) of the spans of ``mine_spans``: everything is judged beside the text, so offsets and hashes alone are shuffled.

    A span lies between two characters of no word, so it can share a run of words with the sources only where its text does: the runs that a text
    shares are found once per text and looked for in its spans.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mining")
    runs = found_grams(docs, shingles(sources.select(F.lit(0).alias("k"), "text"), "k", "text", n).select("gram"), id_col, text_col, n).where(F.size("hits") > 0)
    runs = runs.groupBy(F.col("id").alias("of")).agg(F.array_distinct(F.flatten(F.collect_list(F.transform("hits", lambda x: F.concat(F.lit(" "), x["gram"], F.lit(" ")))))).alias("grams"))
    runs = sized(scratch.keep(runs, "runs"))
    fields = "start int, stop int, words int, text string"
    found = spans_of(docs, id_col, text_col, fields, lambda t: ((a, b, w, t[a:b]) for a, b, w in causal_windows(t, least, most, paragraphs)))
    found = found.where(gate(F.col("text"), rules)).join(runs, F.col("id").eqNullSafe(F.col("of")), "left")
    # the words are bound by an outer lambda, so they are made once and not for every run
    said = F.concat(F.lit(" "), F.array_join(tokenize(F.col("text")), " "), F.lit(" "))
    taken = F.transform(F.array(said), lambda s: F.exists("grams", lambda g: s.contains(g)))[0]
    passed = found.where(F.when(F.col("grams").isNull(), True).otherwise(~taken)).select(F.unhex(digest(F.col("text"))).alias("hash"), "id", "start", "stop", "words")
    first = passed.groupBy("hash").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "start", "stop", "words")).alias("s"))
    first = first.join(known.select(F.unhex("hash").alias("hash")).distinct(), "hash", "left_anti")
    return first.select("s.id", "s.start", "s.stop", "s.words", F.lower(F.hex("hash")).alias("hash"))


def mine_spans(
    docs: DataFrame, sources: DataFrame, known: DataFrame, rules: Sequence[tuple[str, bool]], least: int = 12, most: int = 90, paragraphs: int = 3,
    n: int = 12, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None,
) -> DataFrame:
    """(id, start, stop, words, hash, text) of the new spans of texts.

    A span begins with a line and ends with a sentence or a line (``causal_windows``), has ``least`` to ``most``
    words, passes ``rules`` (pattern, wanted), shares no run of ``n`` words with ``sources`` (text), and its hash is not in
    ``known`` (hash). Of equal spans the one with the least id, then the least start, stays. Null texts and texts without
    such a span give no row; rows that repeat an id are mined one by one; empty sources or hashes exclude nothing.
    """
    found = new_spans(docs, sources, known, rules, least, most, paragraphs, n, id_col, text_col, scratch)
    cut = found.join(docs.select(F.col(id_col).alias("of"), F.col(text_col).alias("whole")), F.col("id").eqNullSafe(F.col("of")))
    cut = cut.select("id", "start", "stop", "words", "hash", F.substring("whole", F.col("start") + 1, F.col("stop") - F.col("start")).alias("text"))
    # of rows that repeat an id, those that hold the span
    return cut.where(digest(F.col("text")) == F.col("hash")).dropDuplicates(["hash"])


def reextract_failed(
    log: DataFrame, raws: DataFrame, version: str, least: int, most: int, rules: Sequence[tuple[str, bool]] = (), aborted: str = "aborted",
    key: str = "id", order: str = "version_no",
) -> DataFrame:
    """(id, error, segment, start, stop, words, segment_hash, eligible, extraction_version, from_hash): updates to append to a log.

    log: (id, version_no, segment, finish, raw_hash, text_hash), of which the row with the highest version_no holds; raws: (id, raw).
    Rows whose segment is null or empty are derived again as the longest complete prefix of their raw text, except streams that were
    aborted. A raw text that is gone, or whose hash is another, gives an error and no segment; one without such a prefix gives no row.
    ``eligible`` tells whether the segment passes ``rules``. Appending the updates and running again gives the errors alone.
    """
    state = log.groupBy(key).agg(F.max_by(F.struct("segment", "finish", "raw_hash", "text_hash"), order).alias("s")).select(key, "s.*")
    failed = state.where((F.coalesce(F.length("segment"), F.lit(0)) == 0) & ~F.col("finish").eqNullSafe(F.lit(aborted))).select(F.col(key).alias("k"), "raw_hash", "text_hash")
    # hashes are compared where the raw text lies; only failed rows carry their text on
    stored = raws.select(F.col(key).alias("id"), F.col("raw"), F.lit(True).alias("stored"))
    joined = failed.join(stored, F.col("k") == F.col("id"), "left")
    same = digest(F.coalesce("raw", F.lit(""))).eqNullSafe(F.col("raw_hash"))
    error = F.when(F.col("stored").isNull(), "raw text is gone").when(~same, "raw hash changed")
    judged = joined.select(F.col("k").alias("id"), "raw", "text_hash", error.alias("error"))
    packed = judged.where("error is null").select(F.struct("id", "text_hash").alias("row"), "raw")
    fields = "start int, stop int, words int, segment string"
    made = spans_of(packed, "row", "raw", fields, lambda t: ((*p, t[p[0] : p[1]]) for p in [complete_prefix(t, least, most)] if p))
    made = made.select(
        "id.id", F.lit(None).cast("string").alias("error"), "segment", "start", "stop", "words", digest(F.col("segment")).alias("segment_hash"), gate(F.col("segment"), rules).alias("eligible"),
        F.lit(version).alias("extraction_version"), F.col("id.text_hash").alias("from_hash"),
    )
    bad = judged.where("error is not null").select("id", "error", F.lit(version).alias("extraction_version"), F.col("text_hash").alias("from_hash"))
    return made.unionByName(bad, allowMissingColumns=True)
