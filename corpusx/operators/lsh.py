"""MinHash signatures and a banded index of them.

Texts with the same set of n-grams are one class and enter the index once, so copies share no bucket with each other;
a bucket of very many classes is dealt out in pieces that meet every class of the other side, so no task holds it whole. Candidates are
verified by the Jaccard similarity of their sets of n-gram hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusx.functions.text import tokenize, window_hashes, word_hashes
from corpusx.scratch import Scratch

SIZE = 32
MOST = (1 << 31) - 1
#: Multiplier and offset of each salted permutation of 31-bit hashes.
SALTS = [(2 * s * s + 7 * s + 1, 31 * s + 17) for s in range(SIZE)]
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Rows of a bucket that stay together.
PIECE = 10_000
#: Hashes of one side that every task gets, to leave out what shares none of them (8 bytes each).
MOST_LOOKED_UP = 2_000_000


def signature(hashes: Column, size: int = SIZE) -> Column:
    """Salted minima of an array of hashes below 2^31; all of them the largest value for an empty array."""

    def least(a: int, b: int) -> Column:
        return F.coalesce(F.array_min(F.transform(hashes, lambda x: F.pmod(x * a + b, F.lit(MOST)))), F.lit(MOST).cast("long"))

    return F.array(*[least(a, b) for a, b in SALTS[:size]])


def gram_sets(texts: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, grams): the distinct hashes below 2^31 of a text's n-grams, sorted; none for a text of fewer than n words."""
    t = texts.select(F.col(id_col).alias("id"), word_hashes(tokenize(F.col(text_col))).alias("w"))
    h = F.transform(window_hashes(F.col("w"), n), lambda x: F.pmod(x, F.lit(MOST)))
    return t.select("id", F.array_sort(F.array_distinct(h)).alias("grams"))


def band_keys(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """(cls, key) for every band of the signatures of (cls, grams): a number made of the band and its minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            grams = b.column(1)
            first = grams.offsets.to_numpy()[:-1] - grams.offsets[0].as_py()
            values = grams.flatten().to_numpy(zero_copy_only=False)
            keys = np.empty((b.num_rows, bands), np.uint64)
            for i in range(bands):
                key = np.full(b.num_rows, i + 1, np.uint64)
                for a, c in SALTS[i * rows : (i + 1) * rows]:
                    key = key * ODD + np.minimum.reduceat((values * a + c) % MOST, first).astype(np.uint64)
                    key ^= key >> np.uint64(29)
                keys[:, i] = key
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), bands))), pa.array(keys.reshape(-1).view(np.int64))], ["cls", "key"])

    return sets.select("cls", "grams").mapInArrow(run, "cls long, key long")


def holding(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of (id, grams) the rows with a hash of ``wanted`` (h), looked up where they lie; all rows if there are too many to send."""
    known = wanted.limit(MOST_LOOKED_UP + 1).toArrow()["h"].to_numpy()
    if len(known) > MOST_LOOKED_UP:
        return sets
    shared = sets.sparkSession.sparkContext.broadcast(np.sort(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = b.column(1)
            values = grams.flatten().to_numpy(zero_copy_only=False)
            if not len(values) or not len(shared.value):
                continue
            at = np.minimum(np.searchsorted(shared.value, values), len(shared.value) - 1)
            offsets = grams.offsets.to_numpy()
            found = np.concatenate([[0], np.cumsum(shared.value[at] == values)])[offsets - offsets[0]]
            yield b.filter(pa.array(found[1:] > found[:-1]))

    return sets.mapInArrow(run, sets.schema)


def minhash_join(a: DataFrame, b: DataFrame, ids: tuple[str, str], least: float = 0.4, n: int = 5, bands: int = 16, rows: int = 2, text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(id, other_id, similarity): pairs of texts of ``a`` and ``b`` whose sets of n-grams have a Jaccard similarity of ``least`` or more.

    A pair is found if its signatures agree in one of ``bands`` bands of ``rows`` values, with similarity s by chance
    1 - (1 - s^rows)^bands: with the defaults 0.94 at 0.4, 0.99 at 0.5. What is found is exact. Null texts and texts of fewer than n words have no
    pairs; rows that repeat an id give their pairs each; every member of a class of equal sets gets its pairs.
    """
    if bands * rows > SIZE:
        raise ValueError(f"bands * rows must be at most {SIZE}")
    scratch = scratch or Scratch(a.sparkSession, "lsh")
    sides, wanted = [], None
    for name, side, id_col in (("b", b, ids[1]), ("a", a, ids[0])):
        sets = gram_sets(side, id_col, text_col, n)
        if wanted is not None:  # a text of the one side without any n-gram of the other has no similarity: it goes before anything is written
            sets = holding(sets, wanted)
        members = scratch.keep(sets, f"{name}-members").where(F.size("grams") > 0)  # where it is read: pushed into the making it would double it
        reps = scratch.keep(members.select("grams").distinct().withColumn("cls", F.monotonically_increasing_id()), f"{name}-classes")
        sides.append((members, reps, scratch.keep(band_keys(reps, bands, rows), f"{name}-keys")))
        wanted = reps.select(F.explode("grams").alias("h")).distinct()
    sides.reverse()
    (ma, ra, ka), (mb, rb, kb) = sides
    # a large bucket of the one side is cut into pieces; the other side's members of it are repeated for each
    large = ka.groupBy("key").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("cuts")).where("cuts > 1")
    large = scratch.keep(large, "large")
    ka2 = ka.join(large, "key", "left").select("cls", "key", F.pmod("cls", F.coalesce("cuts", F.lit(1))).alias("piece"))
    kb2 = kb.join(large, "key", "left").select(F.col("cls").alias("other"), "key", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("cuts", F.lit(1)).cast("long") - 1)).alias("piece"))
    met = scratch.keep(ka2.join(kb2, ["key", "piece"]).select("cls", "other").distinct(), "met")
    both = met.join(ra, "cls").join(rb.select(F.col("cls").alias("other"), F.col("grams").alias("grams_b")), "other")
    common = F.size(F.array_intersect("grams", "grams_b"))
    both = both.withColumn("similarity", common / (F.size("grams") + F.size("grams_b") - common)).where(F.col("similarity") >= least)
    pairs = scratch.keep(both.select("grams", "grams_b", "similarity"), "pairs")
    out = ma.join(pairs, "grams").select("id", "grams_b", "similarity")
    return out.join(mb.select(F.col("id").alias("other_id"), F.col("grams").alias("grams_b")), "grams_b").select("id", "other_id", F.round("similarity", 6).alias("similarity"))
