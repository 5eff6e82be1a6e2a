"""The corpus pipeline: five stages from raw documents to digests of encoded ones.

Each stage works on everything that its predecessor kept and returns the columns of documents; the
last returns what encoding gives. Defined cases: a repeated doc_id is judged text by text in exact
deduplication, of rows that agree in id, normalised text and length one stays, so that every
normalised text stays once; the near-duplicate stage keeps of each
component one text, that with the least id (a null id last); an empty input gives empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusx.llm import bpe, dedup, jaccard, mixing, toxicity
from corpusx.scratch import Scratch

#: Rows of ids that are broadcast; beyond that both sides are shuffled.
MOST_BROADCAST = 1_000_000
REJECT = 0.7


def without(docs: DataFrame, dropped: DataFrame, keys: dict) -> DataFrame:
    """``docs`` less the rows whose keys (column name in ``dropped``: expression on docs) are listed."""
    small = F.broadcast(dropped) if dropped.count() <= MOST_BROADCAST else dropped
    on = None
    for name, expr in keys.items():
        same = expr.eqNullSafe(small[name])
        on = same if on is None else on & same
    return docs.join(small, on, "left_anti")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = toxicity.learned_rows(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model, out_col="__toxic").where(F.col("__toxic") < REJECT).drop("__toxic")


def one_each(docs: DataFrame, twice: DataFrame, keys: dict) -> DataFrame:
    """``docs`` with one row for each of the keys (as for ``without``) listed in ``twice``."""
    if twice.isEmpty():
        return docs
    small = F.broadcast(twice) if twice.count() <= MOST_BROADCAST else twice
    keyed = docs.withColumns(keys)
    on = None
    for name in keys:
        same = keyed[name].eqNullSafe(small[name])
        on = same if on is None else on & same
    again = keyed.join(small, on, "left_semi").dropDuplicates(list(keys))
    return keyed.join(small, on, "left_anti").unionByName(again).drop(*keys)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "copies")
    rows = scratch.keep(dedup.judged(docs, scratch=scratch), "groups")
    scratch.drop_all_but(rows)
    named = [F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")]
    # a shorter copy may share its id with the row that stays: rows are told apart by their length too
    gone = scratch.keep(rows.where(~F.col("kept")).select(*named, F.col("code_points").alias("__n")).distinct(), "gone")
    twice = scratch.keep(rows.where("kept").groupBy(*named).count().where("count > 1").drop("count"), "twice")
    scratch.drop(rows)
    keys = {"__id": F.col("doc_id"), "__sha": F.sha2(dedup.normalised(F.col("text")).cast("binary"), 256)}
    kept = without(docs, gone, keys | {"__n": F.coalesce(F.length("text"), F.lit(0))})
    return one_each(kept, twice, keys)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "near")
    rows = scratch.keep(jaccard.judged(docs, words=5, percent=80, scratch=scratch), "judged")
    named = [F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")]
    gone = scratch.keep(rows.where(~F.col("kept")).select(*named).distinct(), "gone")
    twice = scratch.keep(rows.where("kept and n_shingles > 0").groupBy(*named).count().where("count > 1").drop("count"), "twice")
    scratch.drop_all_but(gone, twice)
    keys = {"__id": F.col("doc_id"), "__digest": jaccard.digest("text")}
    return one_each(without(docs, gone, keys), twice, keys)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit_mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Toxicity is a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
