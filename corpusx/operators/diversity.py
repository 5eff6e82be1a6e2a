"""How alike the items of a group are, and how new an item is against all before it.

Pairs are made inside groups that are small by their nature (the turns of a conversation); novelty
against a whole table goes by an inverted index of n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusx.functions.text import jaccard, ngrams, tokenize, window_hashes, word_hashes

SIZES = (1, 3, 4, 5)


def item_sets(items: DataFrame, group: str, item: str, text: str, head: int = 120) -> DataFrame:
    """(grp, id, toks, g1, g3, g4, g5, opening): distinct n-grams of each item, and trigrams of its first words."""
    t = items.select(F.col(group).alias("grp"), F.col(item).alias("id"), tokenize(F.col(text)).alias("toks"))
    return t.select("grp", "id", "toks", *[F.array_distinct(ngrams(F.col("toks"), n)).alias(f"g{n}") for n in SIZES], F.array_distinct(ngrams(F.slice("toks", 1, head), 3)).alias("opening"))


def ngram_pairs(sets: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(grp, id_a, id_b, j1, j3, j4, j5, opening, proxy) of the pairs of a group, and columns ``keep`` of both as x_a, x_b;
    two empty sets are equal, the proxy is the mean of j3 and j5."""
    held = [*[f"g{n}" for n in SIZES], "opening", *keep]
    a = sets.select("grp", F.col("id").alias("id_a"), *[F.col(c).alias(f"{c}_a") for c in held])
    b = sets.select("grp", F.col("id").alias("id_b"), *[F.col(c).alias(f"{c}_b") for c in held])
    p = a.join(b, "grp").where("id_a < id_b")
    both = lambda c: jaccard(F.col(f"{c}_a"), F.col(f"{c}_b"))
    p = p.select("grp", "id_a", "id_b", *[both(f"g{n}").alias(f"j{n}") for n in SIZES], both("opening").alias("opening"), *[f"{c}_{s}" for c in keep for s in "ab"])
    return p.withColumn("proxy", (F.col("j3") + F.col("j5")) / 2)


def diversity_summary(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(grp, id, mean_similarity, contribution): mean proxy of an item's pairs and 1 less that; 0 and 1 for an item alone."""
    both = pairs.select("grp", F.explode(F.array("id_a", "id_b")).alias("id"), "proxy").groupBy("grp", "id").agg(F.avg("proxy").alias("m"))
    j = sets.select("grp", "id").join(both, ["grp", "id"], "left")
    m = F.coalesce("m", F.lit(0.0))
    return j.select("grp", "id", F.round(m, 6).alias("mean_similarity"), F.round(1 - m, 6).alias("contribution"))


def group_distance(pairs: DataFrame, call: str) -> DataFrame:
    """(grp, n_pairs, within, across): mean 1 - j1 of pairs of the same ``call`` and of different ones (null if none)."""
    same = F.col(f"{call}_a").eqNullSafe(F.col(f"{call}_b"))
    return pairs.groupBy("grp").agg(F.count("*").alias("n_pairs"), F.round(F.avg(F.when(same, 1 - F.col("j1"))), 6).alias("within"), F.round(F.avg(F.when(~same, 1 - F.col("j1"))), 6).alias("across"))


def max_group_similarity(sets: DataFrame, pairs: DataFrame, least: float = 0.85) -> DataFrame:
    """(grp, items, unique_texts, top, useful): greatest j4 of a group (0 without pairs), number of distinct token
    sequences, and whether the group is diverse enough to be of use."""
    n = sets.groupBy("grp").agg(F.count("*").alias("items"), F.countDistinct(F.concat_ws(" ", "toks")).alias("unique_texts"))
    top = pairs.groupBy("grp").agg(F.max("j4").alias("j"))
    j = F.coalesce("j", F.lit(0.0))
    return n.join(top, "grp", "left").select("grp", "items", "unique_texts", F.round(j, 6).alias("top"), (j < least).alias("useful"))


def novelty_vs_prior(items: DataFrame, item: str, text: str, n: int = 3) -> DataFrame:
    """(id, novelty): 1 less the greatest Jaccard similarity of distinct n-grams with any item of smaller id in the
    whole table; 1 for an item without n-grams or without any in common. n-grams are told apart by 64-bit hashes."""
    t = items.select(F.col(item).alias("id"), word_hashes(tokenize(F.col(text))).alias("w"))
    t = t.select("id", F.array_distinct(window_hashes(F.col("w"), n)).alias("h")).withColumn("size", F.size("h"))
    g = t.select("id", "size", F.explode("h").alias("h"))
    p = g.join(g.select(F.col("id").alias("prior"), F.col("size").alias("n_prior"), "h"), "h").where("prior < id")
    j = p.groupBy("id", "size", "prior", "n_prior").agg(F.count("*").alias("c")).select("id", (F.col("c") / (F.col("size") + F.col("n_prior") - F.col("c"))).alias("j"))
    best = j.groupBy("id").agg(F.max("j").alias("j"))
    return t.select("id").join(best, "id", "left").select("id", F.round(1 - F.coalesce("j", F.lit(0.0)), 6).alias("novelty"))


def pairwise_points(judgments: DataFrame) -> DataFrame:
    """(id, points, duels, disagreements) from judgments (a, b, winner; null a tie): a win counts 1, a tie half for
    both; a disagreement is a pair whose judgments, in either order, name different winners."""
    j = judgments.select("a", "b", "winner")
    sides = j.select(F.explode(F.array("a", "b")).alias("id"), "winner")
    won = F.when(F.col("winner").isNull(), 0.5).when(F.col("winner") == F.col("id"), 1.0).otherwise(0.0)
    points = sides.groupBy("id").agg(F.sum(won).alias("points"), F.count("*").alias("duels"))
    pair = j.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min(F.struct(F.col("winner").isNull(), "winner")).alias("lo"), F.max(F.struct(F.col("winner").isNull(), "winner")).alias("hi"))
    torn = pair.where(F.col("lo") != F.col("hi")).select(F.explode(F.array("x", "y")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    return points.join(torn, "id", "left").select("id", "points", "duels", F.coalesce("d", F.lit(0).cast("long")).alias("disagreements"))


def numbered(rows: DataFrame, group: str, draw: str, tie: str, pieces: int = 256) -> DataFrame:
    """``rows`` with ``place``, the place from 1 on within the group by ``draw`` (uniform in 0 to 1), then ``tie``.

    A group is cut into ``pieces`` equal ranges of the draw: rows are numbered within a piece, after those of the pieces
    before, which are counted. So a large group is sorted in many tasks. A null draw comes first, a null group is a group.
    """
    cut = rows.withColumn("__piece", F.when(F.col(draw).isNull(), -1).otherwise(F.least(F.floor(F.col(draw) * pieces), F.lit(pieces - 1)).cast("int")))
    counts = cut.groupBy(F.col(group).alias("__group"), F.col("__piece").alias("__at")).agg(F.count("*").alias("__n"))
    upto = Window.partitionBy("__group").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__group", "__at", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(group, "__piece").orderBy(draw, tie))
    j = cut.withColumn("__inside", inside).join(before, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__piece") == F.col("__at")))
    return j.withColumn("place", (F.col("__before") + F.col("__inside")).cast("int")).drop("__piece", "__inside", "__group", "__at", "__before")
