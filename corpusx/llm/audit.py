"""How filters interact: what each removes after every other choice and order of filters.

Documents are reduced to cells, counts by part and by mask (one bit for each filter that a document
fails), so the audit itself doesn't depend on the number of documents. A recursive query then extends
prefixes of filters, from the empty one, by each filter that is not in them; it joins the masks, carries
the bits applied so far, and each level of the recursion is a step of every order that begins with the
prefix. With n filters it makes fewer than 3 * n! * 2^n rows, whatever the number of parts; Spark bounds
a recursive query at 1,000,000 rows, so up to six filters can be audited.

Defined cases: a null text counts as empty; a null part is the part of the empty string; a null id equals no
label and is neither smaller nor larger than another id; repeated ids are counted row by row, and a copy
under the same id is no copy of a smaller one; a document with several labels counts as good or toxic if one
of them says so; a table without rows gives none. Very long texts are handled in their row. Only the
named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusx.scratch import Scratch

WORD_GAP = r"[\x20\x09-\x0D]+"
#: Groups of equal texts (some 60 bytes each) that are broadcast; beyond that both sides are shuffled.
MOST_BROADCAST = 200_000
MOST_FILTERS = 6


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text decides by itself."""
    words = F.array_remove(F.split(text, WORD_GAP), "")
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 10,
        "D": text.rlike(r"[#$%&*|]"),
    }


def copies_of_smaller(rows: DataFrame, key: str, id_col: str, scratch: Scratch) -> DataFrame:
    """``rows`` (a written table) with ``copy``: some row with the same key has a smaller id."""
    groups = rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"), F.min(id_col).alias("__least")).where("__n > 1").drop("__n")
    groups = scratch.keep(groups, "groups")
    side = F.broadcast(groups) if groups.count() <= MOST_BROADCAST else groups.hint("shuffle_hash")
    joined = rows.join(side, F.col(key) == F.col("__key"), "left")
    return joined.withColumn("copy", F.coalesce(F.col(id_col) > F.col("__least"), F.lit(False))).drop("__key", "__least")


def cells(judged: DataFrame, part: Column, failures: dict[str, Column], **counts: Column) -> DataFrame:
    """(part, mask, n, and a count of rows for each condition in ``counts``); bit i of the mask is the i-th failure."""
    bits = [F.when(F.coalesce(c, F.lit(False)), 1 << i).otherwise(0) for i, c in enumerate(failures.values())]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    named = {name: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0) for name, c in counts.items()}
    flat = judged.select(F.coalesce(part, F.lit("")).alias("part"), mask.alias("mask"), *[c.alias(n) for n, c in named.items()])
    return flat.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.sum(n).cast("long").alias(n) for n in named])


STEPS = """
WITH RECURSIVE steps (prefix, step, filter, bit, before, mask) AS (
  SELECT CAST('' AS STRING), 0, CAST('' AS STRING), 0, 0, mask FROM {masks}
  UNION ALL
  SELECT concat(s.prefix, f.filter), s.step + 1, f.filter, f.bit, s.before | s.bit, s.mask
  FROM steps s LATERAL VIEW explode(filter(%s, f -> (s.before | s.bit) & f.bit = 0)) unused AS f
)
SELECT prefix, step, filter, mask, bit, mask & bit <> 0 AS fails, mask & before <> 0 AS gone FROM steps WHERE step > 0
"""


def interactions(found: DataFrame, filters: str, scratch: Scratch) -> DataFrame:
    """Per part, order of all filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    found: cells (part, mask, n, good, toxic), with bit i for the i-th letter of ``filters``.
    """
    if not filters.isalpha() or len(filters) > MOST_FILTERS or len(set(filters)) != len(filters):
        raise ValueError(f"filters must be 1 to {MOST_FILTERS} different letters")
    spark = found.sparkSession
    found = scratch.keep(found, "cells")
    letters = ", ".join(f"named_struct('filter', '{f}', 'bit', {1 << i})" for i, f in enumerate(filters))
    steps = scratch.keep(spark.sql(STEPS % f"array({letters})", masks=found.select("mask").distinct()), "steps")

    removed = F.col("fails") & ~F.col("gone")
    total = lambda name, when: F.sum(F.when(when, F.col(name)).otherwise(0)).alias
    metrics = steps.join(found, "mask").groupBy("part", "prefix", "step", "filter").agg(
        total("n", ~F.col("fails") & ~F.col("gone"))("kept"), total("n", removed)("removed"), total("n", F.col("fails") & F.col("gone"))("redundant"),
        total("n", F.col("mask") == F.col("bit"))("unique_fails"), total("good", removed)("good_lost"), total("toxic", removed)("toxic_lost"),
    )
    metrics = scratch.keep(metrics, "metrics")
    # an order has a prefix of every length, and a prefix begins as many orders as its rest has orders
    orders = steps.where(F.col("step") == len(filters)).select(F.col("prefix").alias("filter_order")).distinct()
    turns = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    turns = turns.withColumn("prefix", F.substring("filter_order", F.lit(1), F.col("step")))
    begins = turns.groupBy("prefix").agg(F.count("*").alias("orders"))
    shapley = metrics.join(begins, "prefix").groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    return turns.join(metrics.drop("step"), "prefix").join(shapley, ["part", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def filter_audit(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The five filters of documents (id, text, lang) against labels (doc_id, quality, toxic): under 100 words (A), few
    distinct words (B), many capitals (C), marks (D), copies of a text with a smaller id (E)."""
    scratch = scratch or Scratch(docs.sparkSession, "audit")
    text = docs.select("doc_id", F.col("lang").alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    fails = text_failures(F.col("text"))
    judged = scratch.keep(text.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), *[c.alias(f) for f, c in fails.items()]), "judged")
    flags = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("is_good"), F.max(F.col("toxic") == 1).alias("is_toxic"))
    rows = copies_of_smaller(judged, "digest", "doc_id", scratch).join(flags, "doc_id", "left")
    found = cells(rows, F.col("part"), {f: F.col(f) for f in fails} | {"E": F.col("copy")}, good=F.col("is_good"), toxic=F.col("is_toxic"))
    return interactions(found, "ABCDE", scratch)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents
), lab AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN lab USING (doc_id)
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)
), s AS (
  SELECT '' AS prefix, 0 AS step, 0 AS bit, 0 AS before
  UNION ALL
  SELECT prefix || letter, step + 1, letters.bit, before | s.bit FROM s, letters WHERE (before | s.bit) & letters.bit = 0
), m AS (
  SELECT part, prefix, any_value(bit) AS bit, sum(CASE WHEN mask & (before | bit) = 0 THEN 1 ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN 1 ELSE 0 END) AS removed, sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN 1 ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN 1 ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 AND good THEN 1 ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 AND toxic THEN 1 ELSE 0 END) AS toxic_lost
  FROM s, f WHERE step > 0 GROUP BY part, prefix
), o AS (
  SELECT m.*, s.prefix AS filter_order, length(m.prefix) AS step FROM s JOIN m ON starts_with(s.prefix, m.prefix) WHERE s.step = 5
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM o
"""
