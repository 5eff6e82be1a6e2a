"""Queries on payloads, seals, packets and layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusx.operators import records as R
from corpusx.plans.tables import register, table

Q: dict = {}


@register(Q, "SELECT event_id AS id, array_to_string(list_sort(list_filter(json_keys(props), lambda k: k NOT IN ('score', 'evidence', 'defects'))), ',') AS unknown, array_to_string(list_sort(list_filter(json_keys(props), lambda k: k IN ('k', 'rewrite'))), ',') AS forbidden, len(list_filter(json_keys(props), lambda k: k NOT IN ('score', 'evidence', 'defects') OR k IN ('k', 'rewrite'))) = 0 AS passed FROM events")
def critic_only_check(spark, sf):
    """Keys of the events' properties against those that a critic may use."""
    return R.critic_only_check(table(spark, sf, "events"), "event_id", "props", ("score", "evidence", "defects"), ("k", "rewrite"))


SEALED = "(SELECT source AS part, count(*) AS n, md5(CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(31), coalesce('=' || doc_id, '-'), coalesce('=' || text, '-'))), 1, 12) AS HUGEINT)) AS VARCHAR)) AS seal FROM {} GROUP BY source)"


@register(Q, f"""SELECT coalesce(a.part, b.part) AS part, CASE WHEN b.seal IS NULL THEN 'missing' WHEN a.seal IS NULL THEN 'new' WHEN a.seal = b.seal AND a.n = b.n THEN 'intact' ELSE 'changed' END AS status
  FROM {SEALED.format('documents')} a FULL JOIN {SEALED.format('(SELECT * FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1))')} b ON a.part IS NOT DISTINCT FROM b.part""")
def seal_verify(spark, sf):
    """Sources of the corpus sealed whole, verified after the toxic documents have gone."""
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    now = d.join(table(spark, sf, "labels").where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_anti")
    return R.seal_verify(R.seal_of(d, "source", "doc_id", "text"), R.seal_of(now, "source", "doc_id", "text"))


@register(Q, "SELECT conv_id AS id, CAST(turn AS INTEGER) AS place, CASE WHEN turn % 2 = 0 THEN 'action' ELSE 'consequence' END AS kind, md5(text) AS digest FROM conversations WHERE length(text) > 0")
def occurrence_ledger(spark, sf):
    """Turns of a conversation in twos: what is asked is the action, the answer its consequence."""
    t = table(spark, sf, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 2).alias("nth"))
    atoms = t.agg(F.max(F.when(F.col("turn") % 2 == 0, F.col("text"))).alias("action"), F.max(F.when(F.col("turn") % 2 == 1, F.col("text"))).alias("consequence"))
    packets = atoms.select("conv_id", "nth", F.array(F.struct("action", "consequence")).alias("atoms"))
    made = R.occurrence_ledger(packets.withColumn("key", F.struct("conv_id", "nth")), "key", "atoms")
    return made.select(F.col("id.conv_id").alias("id"), (F.col("id.nth") * 2 + F.col("place")).cast("int").alias("place"), "kind", F.md5("text").alias("digest"))


@register(Q, """SELECT 'c' || c_custkey AS profile, 3 AS depth, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE n_name END AS contract, r_name AS origin, concat_ws(',', r_name, n_name, c_mktsegment) AS coordinates
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def merge_layers(spark, sf):
    """Customers extend their nation, nations their region; a customer in debt inherits its contract."""
    none = F.lit("")
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("profile"), F.lit(None).cast("string").alias("extends"), F.lit("").alias("contract"), F.col("r_name").alias("origin"), F.array("r_name").alias("coordinates"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("profile"), F.concat(F.lit("r"), "n_regionkey").alias("extends"), F.col("n_name").alias("contract"), none.alias("origin"), F.array("n_name").alias("coordinates"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("profile"), F.concat(F.lit("n"), "c_nationkey").alias("extends"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise("").alias("contract"), none.alias("origin"), F.array("c_mktsegment").alias("coordinates"))
    layers = r.unionByName(n).unionByName(c).withColumn("version", F.lit("1"))
    merged = R.merge_layers(layers, ("contract", "origin"), ("coordinates",)).where("profile like 'c%'")
    return merged.withColumn("coordinates", F.array_join("coordinates", ","))
