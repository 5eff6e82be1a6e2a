"""Overlap, decontamination and repetition on word n-grams.

Documents are compared with a set of n-grams by hash first: the hashes of a document's windows are
looked up where the document lies (the n-grams' hashes are broadcast while they are few), and only
what is found is shuffled, and then compared word by word. Repetition inside one document is
found in its row, by a fold over its sorted window hashes, without any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from corpusx.functions.text import ngrams, tokenize, window_hashes, word_hashes
from corpusx.scratch import Scratch, small_batches

#: Rows that are broadcast (n-grams, or documents with a hit); beyond that both sides are shuffled.
MOST_BROADCAST = 1_000_000
#: Classes of a list that meet all of its classes in one place.
PIECE = 2_000
#: Fixed value: the odd factor by which the number of a run of words grows.
ODD = np.uint64(0x9E3779B97F4A7C15)


def sized(small: DataFrame) -> DataFrame:
    """A table with the hint that its size asks for."""
    return F.broadcast(small) if small.count() <= MOST_BROADCAST else small


def window_places(words: DataFrame, n: int, wanted: DataFrame | None = None) -> DataFrame:
    """(id, pos, h): a 64-bit number of every run of n words of (id, w), w the hashes of its words, made for all rows of an Arrow batch at once;
    with ``wanted`` (h) only those that are among them, looked up where the row lies, or all if there are too many to send."""
    small_batches(words.sparkSession)
    known = None if wanted is None else wanted.distinct().limit(MOST_BROADCAST + 1).toArrow()["h"].to_numpy()
    shared = None if known is None or len(known) > MOST_BROADCAST else words.sparkSession.sparkContext.broadcast(np.sort(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, ends = b.column(1), b.column(1).offsets.to_numpy().astype(np.int64)
            ends -= ends[0]
            h = w.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            made = np.zeros(max(0, len(h) - n + 1), np.uint64)
            for j in range(n if len(made) else 0):
                made = made * ODD + h[j : j + len(made)]
            row = np.repeat(np.arange(b.num_rows), np.diff(ends))[: len(made)]
            at = np.flatnonzero(np.arange(len(made)) + n <= ends[row + 1])
            made = made.view(np.int64)[at]
            if shared is not None:
                near = np.minimum(np.searchsorted(shared.value, made), len(shared.value) - 1) if len(shared.value) else None
                hit = np.flatnonzero(shared.value[near] == made) if near is not None else []
                at, made = at[hit], made[hit]
            row = row[at]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array((at - ends[row]).astype(np.int32)), pa.array(made)], ["id", "pos", "h"])

    words = words.select(F.col(words.columns[0]).alias("id"), "w")
    return words.mapInArrow(run, f"id {words.schema[0].dataType.simpleString()}, pos int, h long")


def found_grams(docs: DataFrame, grams: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, toks, hits): documents with the places (pos, gram) at which they hold one of ``grams`` (gram).

    Places are found by hash and written; then documents with a hit are read again beside their places, which are broadcast while they
    are few, so their texts don't move. Rows that repeat an id are each compared with the places of all of them; a null id is an id.
    """
    t = docs.select(F.col(id_col).alias("id"), word_hashes(tokenize(F.col(text_col))).alias("w"))
    scratch = Scratch(docs.sparkSession, "overlap")
    words = grams.select("gram").distinct().select("gram", word_hashes(F.split("gram", " ")).alias("w"))
    wanted = scratch.keep(window_places(words, n).where("pos = 0").withColumnRenamed("id", "gram"), "grams")
    found = window_places(t, n, wanted.select("h"))
    places = found.join(sized(wanted.select("h", "gram")), "h").groupBy("id").agg(F.collect_set(F.struct("pos", "gram")).alias("hits"))
    places = sized(scratch.keep(places.withColumnRenamed("id", "of"), "places"))
    said = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(places, F.col("id").eqNullSafe(F.col("of"))).select("id", tokenize(F.col("text")).alias("toks"), "hits")
    same = F.filter("hits", lambda x: F.array_join(F.slice("toks", x["pos"] + 1, n), " ") == x["gram"])
    return said.select("id", "toks", same.alias("hits"))


def shingles(docs: DataFrame, id_col: str, text_col: str, n: int, distinct: bool = True) -> DataFrame:
    """(id, gram, pos): word n-grams with the first position (distinct) or every position."""
    t = docs.select(F.col(id_col).alias("id"), tokenize(F.col(text_col)).alias("toks"))
    rows = t.select("id", F.posexplode(ngrams(F.col("toks"), n)).alias("pos", "gram"))
    return rows.groupBy("id", "gram").agg(F.min("pos").alias("pos")) if distinct else rows


def shingle_index(sources: DataFrame, id_col: str, text_col: str, n: int = 12, whitelist: DataFrame | None = None) -> DataFrame:
    """(gram, sources): distinct shingles with the sorted ids that hold them, less whitelisted ones."""
    g = shingles(sources, id_col, text_col, n)
    if whitelist is not None:
        g = g.join(whitelist.select("gram").distinct(), "gram", "left_anti")
    return g.groupBy("gram").agg(F.array_sort(F.collect_set("id")).alias("sources"))


def exact_overlap(docs: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 12) -> DataFrame:
    """(id, gram, pos, sources): every index shingle in a document at its first position."""
    places = found_grams(docs, index, id_col, text_col, n).select("id", F.explode("hits").alias("x")).select("id", "x.*")
    return places.groupBy("id", "gram").agg(F.min("pos").alias("pos")).join(index, "gram").select("id", "gram", "pos", "sources")


def containment(docs: DataFrame, sources: DataFrame, ids: tuple[str, str], n: int = 8, threshold: float = 0.1) -> DataFrame:
    """(id, source_id, shared, ratio, flagged): shared distinct n-grams over the document's own."""
    s = shingles(sources, ids[1], "text", n).select(F.col("id").alias("source_id"), "gram")
    found = found_grams(docs, s, ids[0], "text", n).withColumn("w", word_hashes(F.col("toks")))
    own = F.size(F.array_distinct(window_hashes(F.col("w"), n))).cast("long")
    held = found.select("id", own.alias("own"), F.explode(F.array_distinct(F.transform("hits", lambda x: x["gram"]))).alias("gram"))
    pairs = held.join(s, "gram").groupBy("id", "source_id", "own").agg(F.count("*").alias("shared"))
    ratio = F.col("shared") / F.col("own")
    return pairs.select("id", "source_id", "shared", F.round(ratio, 6).alias("ratio"), (ratio > threshold).alias("flagged"))


def prior_overlap(docs: DataFrame, id_col: str = "item_id", n: int = 16, scratch: Scratch | None = None) -> DataFrame:
    """(id, prior_id, shared): distinct n-grams, told apart by 64-bit hashes, shared with earlier candidates by id order.

    Each n-gram is shuffled once, to find those of several documents. n-grams that the same documents hold are one list with a weight, documents
    of the same lists are one class: only classes meet on lists, and their members' pairs are written out at the end. Rows of one id are one candidate.
    """
    scratch = scratch or Scratch(docs.sparkSession, "prior")
    t = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), word_hashes(tokenize(F.col("text"))).alias("w"))
    g = t.select("id", F.explode(F.array_distinct(window_hashes(F.col("w"), n))).alias("h")).repartition("h")
    of, turn = Window.partitionBy("h"), Window.partitionBy("h").orderBy("id")
    g = g.withColumn("again", F.lag("id").over(turn)).where("again is null or again <> id")
    # wrapping sums tell sets of ids apart whatever the order of their rows
    g = g.select("h", "id", F.count("*").over(of).alias("n")).where("n > 1")
    shared = scratch.keep(g.select("h", "id", "n", F.min("id").over(of).alias("least"), mark("id", of).alias("held")), "shared")
    lists = shared.where("id = least").groupBy("n", "least", "held").agg(F.min("h").alias("h"), F.count("*").alias("weight"))
    lists = scratch.keep(lists.select("h", "weight"), "lists")
    held = scratch.keep(shared.select("h", "id").join(sized(lists), "h").select(F.col("h").alias("list"), "id", "weight"), "held")
    scratch.drop(shared)
    sets = held.groupBy("id").agg(F.count("*").alias("n"), F.sum("weight").alias("total"), mark("list").alias("held"))
    members = scratch.keep(sets.select("id", "total", F.min("id").over(Window.partitionBy("n", "total", "held")).alias("cls")), "members")
    of_cls = scratch.keep(held.join(members.where("id = cls").select("id"), "id").select("list", F.col("id").alias("cls"), "weight"), "classes")
    # a list of very many classes is dealt out in pieces that each meet all of its classes
    large = sized(scratch.keep(of_cls.groupBy("list").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("cuts")).where("cuts > 1"), "large"))
    dealt = of_cls.join(large, "list", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    a = dealt.select("list", F.pmod(F.xxhash64("cls"), "cuts").cast("int").alias("piece"), F.col("cls").alias("a"), "weight")
    b = dealt.select("list", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("piece"), F.col("cls").alias("b"))
    met = scratch.keep(a.join(b, ["list", "piece"]).where("b < a").groupBy("a", "b").agg(F.sum("weight").alias("shared")), "met")
    # of two classes either may hold the earlier member, of one class all members share all
    one = members.groupBy("cls").agg(F.count("*").alias("n"), F.max("total").alias("shared")).where("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"), "shared")
    pairs = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared")).unionByName(one)
    m = sized(members.select("id", "cls"))
    out = pairs.join(m.withColumnRenamed("cls", "a"), "a").join(m.select(F.col("id").alias("prior_id"), F.col("cls").alias("b")), "b")
    return out.where("prior_id < id").select("id", "prior_id", "shared")


def mark(column: str, over: WindowSpec | None = None) -> Column:
    """128 bits of a set of values, whatever their order: two sums of halves of 64-bit hashes."""
    halves = [F.sum(F.xxhash64(F.lit(salt), column).bitwiseAND(F.lit(0xFFFFFFFF))) for salt in (1, 2, 3, 4)]
    return F.struct(*[(h.over(over) if over is not None else h).alias(f"s{i}") for i, h in enumerate(halves)])


def verdict(matches: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: number of matched shingles and sources, first position, hard_fail."""
    m = matches.select("id", "pos", F.explode("sources").alias("source")).groupBy("id").agg(
        F.countDistinct("pos").alias("matched"), F.countDistinct("source").alias("n_sources"), F.min("pos").alias("first_pos"))
    return docs.select(F.col(id_col)).join(m, F.col(id_col) == F.col("id"), "left").select(
        id_col, F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"), "first_pos", F.col("matched").isNotNull().alias("hard_fail"))


def worklist(flagged: DataFrame, done: DataFrame) -> DataFrame:
    """Flagged (id, source_id) pairs that aren't adjudicated yet."""
    return flagged.where("flagged").select("id", "source_id").distinct().join(done, ["id", "source_id"], "left_anti")


def longest_common_span(docs: DataFrame, sources: DataFrame, ids: tuple[str, str], seed: int = 8) -> DataFrame:
    """(id, source_id, words): longest run of words in common, found from shared seed n-grams that
    lie next to each other on a diagonal."""
    s = shingles(sources, ids[1], "text", seed, False).select(F.col("id").alias("source_id"), F.col("pos").alias("at"), "gram")
    hits = found_grams(docs, s, ids[0], "text", seed).select("id", F.explode("hits").alias("x")).select("id", "x.*").join(s, "gram")
    diagonal = hits.select("id", "source_id", "pos", (F.col("pos") - F.col("at")).alias("diag")).distinct()
    order = Window.partitionBy("id", "source_id", "diag").orderBy("pos")
    runs = diagonal.withColumn("island", F.col("pos") - F.row_number().over(order))
    return runs.groupBy("id", "source_id", "diag", "island").agg(F.count("*").alias("n")).groupBy("id", "source_id").agg((F.max("n") + seed - 1).alias("words"))


def sorted_windows(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """``docs`` with id, toks and places: window hashes with positions (from 1), sorted; none below n words."""
    t = docs.withColumns({"id": F.col(id_col), "toks": tokenize(F.col(text_col))})
    t = t.withColumn("w", word_hashes(F.col("toks"))).withColumn("h", window_hashes(F.col("w"), n))
    return t.withColumn("places", F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("p")))))


def repeat_count(n: int, apart: int) -> Column:
    """Of sorted windows: those found again at least ``apart`` words after their first place, word by word."""
    none = F.struct(F.lit(None).cast("long").alias("h"), F.lit(0).alias("first"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, x: Column) -> Column:
        again = (x["p"] - a["first"] >= apart) & (F.slice("toks", x["p"], n) == F.slice("toks", a["first"], n))
        return F.when(a["h"] == x["h"], F.struct(a["h"].alias("h"), a["first"].alias("first"), (a["n"] + again.cast("long")).alias("n"))).otherwise(F.struct(x["h"].alias("h"), x["p"].alias("first"), a["n"].alias("n")))

    return F.aggregate("places", none, step, lambda a: a["n"])


def repeats(docs: DataFrame, id_col: str = "doc_id", n: int = 50, apart: int = 50, text_col: str = "text") -> DataFrame:
    """(id, n_repeats): windows of n words found again at least ``apart`` words after their first place."""
    return sorted_windows(docs.select(id_col, text_col), id_col, text_col, n).where(F.size("toks") >= n).select("id", repeat_count(n, apart).alias("n_repeats"))


def self_repetition(docs: DataFrame, id_col: str = "doc_id", n: int = 50, apart: int = 50, least_words: int = 20, text_col: str = "text", gap: str = r"\n\s*\n") -> DataFrame:
    """(id, n_repeats, repeated_paragraphs, hard_fail): repeated windows, and paragraphs of ``least_words`` or more (cut at ``gap``,
    a blank line; equal after tokenizing) beyond their first occurrence; either fails the document. Every document has a row."""
    t = sorted_windows(docs.select(id_col, text_col), id_col, text_col, n)
    text = F.replace(F.col(text_col), F.lit("\r\n"), F.lit("\n"))
    paras = F.transform(F.filter(F.split(text, gap, -1), lambda p: F.length(p) >= 2 * least_words - 1), lambda p: tokenize(p))
    t = t.withColumn("paras", F.when(text.rlike(gap), paras).otherwise(F.array().cast("array<array<string>>")))
    t = t.withColumn("long", F.filter("paras", lambda p: F.size(p) >= least_words))
    again = (F.size("long") - F.size(F.array_distinct("long"))).cast("long")
    t = t.select("id", repeat_count(n, apart).alias("n_repeats"), F.coalesce(again, F.lit(0).cast("long")).alias("repeated_paragraphs"))
    return t.withColumn("hard_fail", (F.col("n_repeats") > 0) | (F.col("repeated_paragraphs") > 0))


def max_repetition(docs: DataFrame, id_col: str = "doc_id", n: int = 4, loop: int = 5, text_col: str = "text") -> DataFrame:
    """(id, top, is_loop): highest count of any n-gram of a document."""
    none = F.struct(F.lit(None).cast("long").alias("h"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("top"))

    def step(a: Column, x: Column) -> Column:
        now = F.when(a["h"] == x["h"], a["n"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(x["h"].alias("h"), now.alias("n"), F.greatest(a["top"], now).alias("top"))

    top = F.aggregate("places", none, step, lambda a: a["top"])
    return sorted_windows(docs.select(id_col, text_col), id_col, text_col, n).where(F.size("toks") >= n).select("id", top.alias("top")).withColumn("is_loop", F.col("top") >= loop)
