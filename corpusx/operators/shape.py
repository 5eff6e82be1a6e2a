"""Projections, segmentation and gates over documents. Everything is a column expression or a
generator; window functions run within one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusx.functions.text import tokenize


def paragraphs(docs: DataFrame, id_col: str = "doc_id", sep: str = "\n") -> DataFrame:
    """(id, idx, para, start, end) of non-empty paragraphs with exact offsets."""
    parts = docs.select(F.col(id_col), F.posexplode(F.split(F.coalesce("text", F.lit("")), sep, -1)).alias("idx", "para"))
    w = Window.partitionBy(id_col).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("para") + len(sep)).over(w), F.lit(0))
    return parts.withColumn("start", start).withColumn("end", F.col("start") + F.length("para")).where(F.trim("para") != "")


def strip_between(text: Column, begin: str, end: str) -> Column:
    """The body between two markers, either of which may be missing."""
    a = F.instr(text, begin)
    body = F.when(a > 0, F.substring(text, a + len(begin), F.length(text))).otherwise(text)
    b = F.instr(body, end)
    return F.trim(F.when(b > 0, F.substring(body, F.lit(1), b - 1)).otherwise(body))


def cut_at(text: Column, markers: list[str]) -> Column:
    """Text before the earliest of the markers."""
    at = F.array_min(F.filter(F.array(*[F.instr(text, m) for m in markers]), lambda p: p > 0))
    return F.when(at.isNull(), text).otherwise(F.substring(text, F.lit(1), at - 1))


def take_paragraphs(docs: DataFrame, budget: int, id_col: str = "doc_id") -> DataFrame:
    """(id, kept, words): first paragraphs while their words fit the budget."""
    p = paragraphs(docs, id_col).withColumn("n", F.size(tokenize(F.col("para"))))
    run = F.sum("n").over(Window.partitionBy(id_col).orderBy("idx"))
    return p.withColumn("run", run).where(F.col("run") <= budget).groupBy(id_col).agg(F.count("*").alias("kept"), F.max("run").alias("words"))


def word_bands(docs: DataFrame, low: int, high: int, slack: int = 200, id_col: str = "doc_id") -> DataFrame:
    """(id, words, passed, diagnostic): inside the band, or slightly or materially outside."""
    n = F.size(tokenize(F.col("text")))
    side = F.when(n < low - slack, "materially short").when(n < low, "slightly short").when(n > high + slack, "materially long").when(n > high, "slightly long").otherwise("ok")
    return docs.select(id_col, n.alias("words"), n.between(low, high).alias("passed"), side.alias("diagnostic"))


def rule_counts(docs: DataFrame, rules: list[tuple[str, str, int, int]], id_col: str = "doc_id") -> DataFrame:
    """(id, gate, n, passed): matches of each rule (name, pattern, floor, ceiling); one pass per text."""
    each = F.array(*[F.struct(F.lit(g).alias("gate"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(p)).cast("long").alias("n"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for g, p, lo, hi in rules])
    return docs.select(id_col, F.explode(each).alias("r")).select(id_col, "r.gate", "r.n", F.col("r.n").between(F.col("r.lo"), F.col("r.hi")).alias("passed"))


def gate_matrix(counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, eligible, failed): whether all gates pass, and the sorted names of those that don't."""
    failed = F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("gate"))))
    return counts.groupBy(id_col).agg(F.bool_and("passed").alias("eligible"), F.array_join(failed, ",").alias("failed"))


def latest(log: DataFrame, key: str, status: str, done: str, order: list[str], of_completed: bool) -> DataFrame:
    """Last completed record per key (of_completed), or the last record if it is completed."""
    rows = log.where(F.col(status) == done) if of_completed else log
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where((F.col("__n") == 1) & (F.col(status) == done)).drop("__n")
