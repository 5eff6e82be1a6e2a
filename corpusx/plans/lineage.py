"""Queries on promoted segments, reports on bundles, inherited rows, profiles and rubrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusx.operators import lineage as L
from corpusx.plans.tables import register, table

Q: dict = {}

WORDS = "len(regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+'))"


@register(Q, f"""SELECT segment, CASE WHEN lang = 'de' THEN 'raw hash' WHEN source IS NULL OR n <> given THEN 'word count' WHEN n < 5 OR n > 60 THEN 'word band' END AS error FROM (
  SELECT doc_id AS segment, lang, source, {WORDS.format("coalesce(substr(text, 1, 200), '')")} AS n, {WORDS.format("coalesce(substr(text, 1, 200), '')")} + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS given FROM documents)""")
def promoted_segments(spark, sf):
    """The first 200 characters of each document as its promoted segment; the manifest is wrong where lang is de or 9 divides the id."""
    d = table(spark, sf, "documents")
    segment = L.trimmed(F.substring("text", 1, 200))
    stored = d.select(F.col("doc_id").alias("segment"), segment.alias("selected"), F.col("text").alias("raw"))
    claimed = F.when(F.col("lang") == "de", F.reverse("text")).otherwise(F.col("text"))
    words = F.when(F.col("source").isNotNull(), L.word_total(segment) + (F.col("doc_id") % 9 == 0).cast("int"))
    manifest = d.select(F.col("doc_id").alias("segment"), L.text_digest(segment).alias("selected_sha"), L.text_digest(claimed).alias("raw_sha"), words.alias("words"))
    return L.promoted_segments(manifest, stored, 5, 60)


REPORTED = """(SELECT doc_id, item, text, CASE WHEN doc_id % 7 = 0 THEN upper(substr(text, item * 40 + 1, 20)) ELSE substr(text, item * 40 + 1, 20) END AS evidence
  FROM documents, (SELECT unnest([0, 1, 2]) AS item) WHERE item < 2 OR doc_id % 5 <> 0)"""


@register(Q, f"""WITH r AS {REPORTED} SELECT d.doc_id AS bundle, CAST(CASE WHEN d.doc_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS uncovered, 0::BIGINT AS unbundled, x.inexact, x.unrealized,
  d.doc_id % 5 <> 0 AND x.inexact = 0 AND x.unrealized = 0 AS passed FROM documents d JOIN (
  SELECT doc_id, CAST(sum(CASE WHEN evidence <> '' AND strpos(text, evidence) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS inexact, CAST(sum(CASE WHEN item = 0 AND evidence NOT LIKE '%e%' THEN 1 ELSE 0 END) AS BIGINT) AS unrealized FROM r GROUP BY doc_id) x ON x.doc_id = d.doc_id""")
def realization_check(spark, sf):
    """Three items of each document; reports quote 20 characters for each, in capitals where 7 divides the id, and leave one out where 5 does."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("bundle"), "text")
    items = d.select("bundle", "text", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("item"))
    said = F.substring("text", F.col("item") * 40 + 1, F.lit(20))
    said = F.when(F.col("bundle") % 7 == 0, F.upper(said)).otherwise(said)
    reports = items.where("item < 2 or bundle % 5 <> 0").select("bundle", "item", F.when(said.contains("e"), "realized").otherwise("absent").alias("status"), said.alias("evidence"))
    return L.realization_check(items.select("bundle", "item", (F.col("item") == 0).alias("required")), reports, d)


@register(Q, """SELECT doc_id AS id, 'next' AS campaign, CASE WHEN length(text) = n_chars THEN sha256(text) END AS source_hash, sha256(split_part(text, '. ', 1)) AS child_hash, length(split_part(text, '. ', 1)) AS child_chars
  FROM documents WHERE length(text) = n_chars AND doc_id IN (SELECT doc_id FROM labels WHERE quality >= 0.5)""")
def inherit_verified(spark, sf):
    """Documents of good quality whose recorded length still holds, with their first sentence as an exact prefix."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.when(F.length("text") == F.col("n_chars"), L.text_digest(F.col("text"))).alias("text_hash"))
    audited = table(spark, sf, "labels").where("quality >= 0.5").select(F.col("doc_id").alias("id"))
    return L.inherit_verified(d, audited, "next", 1, ". ").select("id", "campaign", "source_hash", "child_hash", F.length("child").alias("child_chars"))


@register(Q, """WITH p AS (SELECT c_custkey, c_mktsegment AS seg, c_nationkey AS n, n_regionkey AS r, c_acctbal < 0 AS debt, c_custkey % 5 = 0 AS two, c_custkey % 11 = 0 AS need, c_custkey % 2 = 0 AS bar FROM customer JOIN nation ON n_nationkey = c_nationkey),
  v AS (SELECT *, list_filter([CASE WHEN need AND seg <> 'MACHINERY' THEN 'missing:s.MACHINERY' END, CASE WHEN bar AND n = 3 THEN 'prohibited:n.3' END, CASE WHEN seg = 'AUTOMOBILE' AND two THEN 'excludes:s.AUTOMOBILE' END,
    CASE WHEN debt THEN 'redundant:n.' || n END, CASE WHEN n > 20 THEN 'rank:n.' || n END, CASE WHEN two AND seg <> 'BUILDING' THEN 'many:s' END], lambda x: x IS NOT NULL) AS bad FROM p)
  SELECT c_custkey AS profile, array_to_string(list_sort(bad), ',') AS violations, CASE WHEN len(bad) = 0 THEN array_to_string(list_sort(list_distinct(['n.' || n, 's.' || seg] || CASE WHEN two THEN ['s.BUILDING'] ELSE [] END)), ',') END AS resolved FROM v""")
def resolve_profiles(spark, sf):
    """Customers as profiles: nation, market segment (a fifth have a second one) and, in debt, the nation's region too."""
    empty = F.array().cast("array<string>")
    c = table(spark, sf, "customer").join(table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), F.col("n_nationkey") == F.col("c_nationkey"))
    dot = lambda k, x: F.concat(F.lit(k), F.col(x).cast("string"))
    some = lambda cond, x: F.when(cond, F.array(x)).otherwise(empty)
    selected = F.concat(F.array(dot("n.", "n_nationkey"), dot("s.", "c_mktsegment")), some(F.col("c_acctbal") < 0, dot("r.", "n_regionkey")), some(F.col("c_custkey") % 5 == 0, F.lit("s.BUILDING")))
    profiles = c.select(F.col("c_custkey").alias("profile"), selected.alias("selected"), some(F.col("c_custkey") % 11 == 0, F.lit("s.MACHINERY")).alias("required"), some(F.col("c_custkey") % 2 == 0, F.lit("n.3")).alias("prohibited"), F.lit(20).alias("ceiling"))
    n = table(spark, sf, "nation").select(dot("n.", "n_nationkey").alias("node"), F.lit("n").alias("namespace"), F.col("n_nationkey").cast("int").alias("rank"), empty.alias("excludes"), F.array(dot("r.", "n_regionkey")).alias("above"))
    r = table(spark, sf, "region").select(dot("r.", "r_regionkey").alias("node"), F.lit("r").alias("namespace"), F.lit(0).alias("rank"), empty.alias("excludes"), empty.alias("above"))
    s = table(spark, sf, "customer").select("c_mktsegment").distinct().select(dot("s.", "c_mktsegment").alias("node"), F.lit("s").alias("namespace"), F.lit(0).alias("rank"), some(F.col("c_mktsegment") == "AUTOMOBILE", F.lit("s.BUILDING")).alias("excludes"), empty.alias("above"))
    got = L.resolve_profiles(profiles, n.unionByName(r).unionByName(s), {"n": (1, None), "s": (1, 1), "r": (0, 1)})
    return got.select("profile", F.array_join("violations", ",").alias("violations"), F.array_join("resolved", ",").alias("resolved"))


@register(Q, """WITH r AS (SELECT l_orderkey AS profile, 'priority' AS kind, l_returnflag AS item, sum(l_quantity)::DOUBLE AS weight FROM lineitem GROUP BY ALL UNION ALL SELECT l_orderkey, 'defect', 'late', sum(l_discount)::DOUBLE FROM lineitem WHERE l_tax > 0.05 GROUP BY ALL)
  SELECT profile, kind, item, round(weight, 4) AS weight FROM r UNION ALL SELECT profile, x[1], x[2], 0.0 FROM (SELECT profile, unnest([['diagnostic', 'on time'], ['defect', 'late']]) AS x FROM (SELECT DISTINCT profile FROM r)) n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.profile = n.profile AND r.kind = n.x[1] AND r.item = n.x[2])""")
def rubric_overlay(spark, sf):
    """Orders as profiles: return flags weigh by quantity, lines of high tax by discount; a diagnostic and a defect are laid over."""
    li = table(spark, sf, "lineitem")
    modes = li.groupBy(F.col("l_orderkey").alias("profile"), F.col("l_returnflag").alias("item")).agg(F.sum("l_quantity").alias("weight")).withColumn("kind", F.lit("priority"))
    late = li.where("l_tax > 0.05").groupBy(F.col("l_orderkey").alias("profile")).agg(F.sum("l_discount").alias("weight")).select("profile", F.lit("late").alias("item"), "weight", F.lit("defect").alias("kind"))
    return L.rubric_overlay(modes.unionByName(late), ("on time",), ("late",)).withColumn("weight", F.round("weight", 4))
