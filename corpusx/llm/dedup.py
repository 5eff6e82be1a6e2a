"""Exact deduplication by distributed MSD radix partitioning.

A normalised text is read as its length followed by its bytes. Round by round, groups that still
hold several documents are split by the next digit, a run of successive bytes whose width grows
eightfold, until a group is a single document or its documents have ended; documents of an ended
group have been equal in every byte, so no digest decides equality. Digits are counted before they
are shuffled (copies of one text cost a row per task), only members of unsettled groups carry their
text on, and while the groups of a round are few they are broadcast, so that no text is shuffled at
all and the members of a large group stay on the tasks that read them.

Defined cases: a null text counts as empty; white space that the normalisation deletes doesn't
count; of equal texts the row with the most code points stays, then the smallest doc_id (a null id
last, of rows that agree in both each says kept); a table without rows gives none. Only the named
columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusx.scratch import Scratch

#: The characters that normalisation deletes.
BLANK = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
FIRST, GROWTH, WIDEST = 64, 8, 1 << 21
#: Groups, and bytes of their digits, that are broadcast to the rows; beyond either both sides are shuffled and
#: sorted, which spills, and adaptive execution splits what is skewed. Changes the plan alone.
MOST_BROADCAST = 200_000
MOST_BYTES = 32 << 20


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in BLANK:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def split(members: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Join to each row the number of its group by ``keys``, null if it stands alone."""
    groups = members.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1")
    groups = scratch.keep(groups.select(*[F.col(k).alias(f"__{k}") for k in keys], F.monotonically_increasing_id().alias("__next")), f"{name}-groups")
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return members.join(sized(groups, F.octet_length("__digit")), on, "left").drop(*[f"__{k}" for k in keys])


def sized(groups: DataFrame, wide: Column | None = None) -> DataFrame:
    """A written table of groups with the hint that its size asks for: no text moves while it is small.

    wide: bytes of the one column of a group that has no bound."""
    rows, size = groups.agg(F.count("*"), F.coalesce(F.sum(F.lit(0) if wide is None else wide), F.lit(0))).first()
    return F.broadcast(groups) if rows <= MOST_BROADCAST and size <= MOST_BYTES else groups.hint("merge")


def equal_text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, code_points, sha, round, group): rows with equal texts share round and group; group
    is null for a text that no other row has."""
    scratch = scratch or Scratch(docs.sparkSession, "dedup")
    plain = normalised(F.col(text_col)).cast("binary")
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).alias("code_points"), plain.alias("rest"))
    read = read.withColumns({"size": F.octet_length("rest"), "digit": F.substring("rest", 1, FIRST)})
    grouped = split(read, ["size", "digit"], scratch, "0")
    kept = grouped.select(
        "doc_id", "code_points", F.unhex(F.sha2("rest", 256)).alias("sha"), "size",
        F.col("__next").alias("group"), F.when(F.col("__next").isNotNull(), F.col("rest")).alias("rest"),
    )
    state = scratch.keep(kept, "0")
    done, read_to, width, turn = [], FIRST, FIRST * GROWTH, 0
    columns = ["doc_id", "code_points", "sha", F.lit(0).alias("round"), "group"]
    while True:
        columns[3] = F.lit(turn).alias("round")
        ended = F.col("group").isNull() | (F.col("size") <= read_to)
        done.append(state.where(ended).select(*columns))
        open_ = state.where(~ended)
        if open_.isEmpty():
            break
        turn += 1
        digit = open_.select("doc_id", "code_points", "sha", "size", "group", F.substring("rest", read_to + 1, width).alias("digit"), "rest")
        grouped = split(digit, ["group", "digit"], scratch, str(turn))
        kept = grouped.select("doc_id", "code_points", "sha", "size", F.col("__next").alias("group"), F.when(F.col("__next").isNotNull(), F.col("rest")).alias("rest"))
        state = scratch.keep(kept, str(turn))
        read_to, width = read_to + width, min(width * GROWTH, WIDEST)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text), code_points."""
    scratch = scratch or Scratch(docs.sparkSession, "dedup")
    rows = equal_text_groups(docs, id_col, text_col, scratch)
    order = F.struct((-F.col("code_points")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"))
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    alone = rows.where("group is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha, "code_points")
    many = rows.where("group is not null")
    best = many.groupBy("round", "group").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    best = scratch.keep(best.select(F.col("round").alias("r"), F.col("group").alias("g"), "best", "group_size"), "best")
    joined = many.join(sized(best), (F.col("round") == F.col("r")) & (F.col("group") == F.col("g")))
    kept = (order == F.col("best")) | (F.col("doc_id").eqNullSafe(F.col("best.i")) & (-F.col("code_points") == F.col("best.c")))
    return alone.unionByName(joined.select("doc_id", F.col("best.i").alias("keep_id"), "group_size", kept.alias("kept"), sha, "code_points"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    return judged(docs, id_col, text_col, scratch).drop("code_points")


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS code_points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY plain ORDER BY code_points DESC, doc_id NULLS LAST) AS keep_id,
         max(code_points) OVER (PARTITION BY plain) AS most, count(*) OVER (PARTITION BY plain) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND code_points = most AS kept, sha256(plain) AS text_sha256 FROM g
"""
