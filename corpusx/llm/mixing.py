"""Mixing sources to target weights, with DataFrame functions only.

Words are counted once per document and summed per source; a water-filling over the sources gives
each a target and so a repetition rate; a document is emitted ``floor(rate)`` times plus once more
when a draw seeded by its id falls below the fraction of the rate.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a
source without words has target 0 and its documents are taken 0 times; rows that repeat a doc_id
share that id's draw; a null doc_id draws as the text ``null``. Only the named columns are read,
so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusx.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size): one pass over the texts."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))


def source_rates(sized: DataFrame, weights: Sequence[int] = (3, 1, 2), share_percent: int = 150, cap: int = 2) -> DataFrame:
    """(source, source_size, target, rate) for a table (source, size).

    Sources in code point order, null last, take ``weights`` in turn and share ``share_percent`` of
    all words; a target stops at ``cap`` times its source's words and the excess goes to the others
    by weight. The windows run over one row per source, not over documents.
    """
    everything = Window.partitionBy()
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (turn + 1).cast("int"))
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", weight)
    # Sources sorted by how soon they reach the cap: with the first i of them capped, the level is
    # what is left of the budget over the weights that are left.
    by_cap = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * share_percent - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * (100 * cap)
    level = left / (F.sum("w").over(rest) * 100.0)
    per = per.withColumns({"place": F.row_number().over(by_cap), "level": level})
    fits = F.col("level") * F.col("w") <= F.col("source_size") * float(cap)
    first = F.min(F.when(fits, F.struct("place", "level"))).over(everything)
    per = per.withColumn("common", first["level"])
    target = F.least(F.col("source_size") * float(cap), F.col("common") * F.col("w"))
    return per.select(
        "source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate")
    )


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed and the id alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def copies(rate: Column, doc_id: Column, seed: int = 1) -> Column:
    whole = F.floor(rate)
    return whole + (draw(doc_id, seed) < rate - whole).cast("long")


def mix_plan(docs: DataFrame, seed: int = 1, scratch: Scratch | None = None, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(per document: doc_id, source, size, source_size, target, copies, taken; per source: rates).

    Both sides of the join are tables of known size, so Spark broadcasts the rates while they are
    small and otherwise sorts and splits a hot source.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    sized = scratch.keep(sizes(docs, **columns), "sizes")
    rates = scratch.keep(source_rates(sized), "rates")
    r = rates.withColumnRenamed("source", "rate_source")
    n = copies(F.col("rate"), F.col("doc_id"), seed)
    per_doc = sized.join(r, F.col("source").eqNullSafe(F.col("rate_source"))).withColumn("copies", n)
    per_doc = per_doc.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    return per_doc, rates


def emit_mixture(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; the columns stay the same."""
    _, rates = mix_plan(docs, seed, id_col=id_col, text_col=text_col, source_col=source_col)
    r = rates.select(F.struct("source", "rate").alias("__mix"))
    joined = docs.join(r, docs[source_col].eqNullSafe(F.col("__mix.source")))
    n = copies(F.col("__mix.rate"), docs[id_col], seed).cast("int")
    repeated = joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), n)))
    return repeated.select(*[docs[c] for c in docs.columns])


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    per_doc, _ = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return per_doc.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM sized GROUP BY source
), placed AS (
  SELECT *, row_number() OVER o AS place,
         CAST(sum(source_size) OVER () * 150
              - coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 200 AS DOUBLE)
         / (CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) * 100.0) AS level
  FROM per WINDOW o AS (ORDER BY source_size / w, source IS NULL, source)
), leveled AS (
  SELECT *, (SELECT arg_min(level, place) FROM placed WHERE level * w <= source_size * 2.0) AS common FROM placed
), rated AS (
  SELECT source, source_size, least(source_size * 2.0, common * w) AS target FROM leveled
), drawn AS (
  SELECT d.doc_id, d.size, r.source_size, r.target,
         CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5('1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0 AS u
  FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
       size * (CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM drawn
"""
