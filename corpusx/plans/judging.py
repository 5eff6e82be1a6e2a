"""Judgment, ranking, sampling and assignment queries. Votes come from orders and line items:
a customer is a candidate, a line a judgment, quantity and discount its scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusx.functions.text import sql_uniform, uniform
from corpusx.operators import diversity as D
from corpusx.plans.tables import register, table

Q: dict = {}

VOTES = "(SELECT l_suppkey AS supp, l_partkey AS part, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY ALL)"


def votes(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("supp"), F.col("l_partkey").alias("part")).agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))


JUDGED = """(SELECT x.l_suppkey AS a, y.l_suppkey AS b, x.l_quantity AS qa, y.l_quantity AS qb, x.l_extendedprice AS pa, y.l_extendedprice AS pb
  FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 WHERE x.l_suppkey <> y.l_suppkey)"""
JUDGMENTS = f"""(SELECT a, b, CASE WHEN qa > qb THEN a WHEN qb > qa THEN b END AS winner FROM {JUDGED} UNION ALL SELECT b, a, CASE WHEN pa > pb THEN a WHEN pb > pa THEN b END FROM {JUDGED})"""


@register(Q, f"""WITH j AS {JUDGMENTS}, s AS (SELECT a AS id, winner FROM j UNION ALL SELECT b, winner FROM j),
  t AS (SELECT least(a, b) AS x, greatest(a, b) AS y FROM j GROUP BY ALL HAVING count(DISTINCT coalesce(winner, -1)) > 1), d AS (SELECT id, count(*) AS d FROM (SELECT x AS id FROM t UNION ALL SELECT y FROM t) GROUP BY id)
  SELECT s.id AS supp, sum(CASE WHEN winner IS NULL THEN 0.5 WHEN winner = s.id THEN 1.0 ELSE 0.0 END)::DOUBLE AS points, count(*) AS duels, coalesce(any_value(d.d), 0) AS disagreements FROM s LEFT JOIN d ON d.id = s.id GROUP BY s.id""")
def pairwise_points(spark, sf):
    """Suppliers of neighbouring lines of an order are compared twice: by quantity, and the other way round by price."""
    li = table(spark, sf, "lineitem")
    cols = ("l_suppkey", "l_quantity", "l_extendedprice")
    x = li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), *[F.col(c).alias(f"x_{c}") for c in cols])
    j = x.join(li.select("l_orderkey", "l_linenumber", *cols), ["l_orderkey", "l_linenumber"]).where("x_l_suppkey <> l_suppkey")
    side = lambda c: F.when(F.col(f"x_{c}") > F.col(c), F.col("x_l_suppkey")).when(F.col(f"x_{c}") < F.col(c), F.col("l_suppkey"))
    first = j.select(F.col("x_l_suppkey").alias("a"), F.col("l_suppkey").alias("b"), side("l_quantity").alias("winner"))
    second = j.select(F.col("l_suppkey").alias("a"), F.col("x_l_suppkey").alias("b"), side("l_extendedprice").alias("winner"))
    return D.pairwise_points(first.unionByName(second)).withColumnRenamed("id", "supp")


@register(Q, """SELECT c_mktsegment, c_custkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal > 0 DESC, total DESC, c_custkey) AS rank FROM (
  SELECT c_custkey, c_mktsegment, c_acctbal, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)) WHERE rank <= 5""")
def rank_pipeline(spark, sf):
    """Eligible first, then score, then id; five best of each group (a top-k report)."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"))
    c = table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("total", F.round(F.coalesce("t", F.lit(0.0)), 2))
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc(F.col("c_acctbal") > 0), F.desc("total"), "c_custkey")
    return c.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("c_mktsegment", "c_custkey", "rank")


@register(Q, """SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_size >= a.p_size AND b.p_retailprice >= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice > a.p_retailprice))""")
def pareto_frontier(spark, sf):
    """Parts of a brand that no other beats in size and price: sort by one, running maximum of the other."""
    p = table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.max("p_retailprice").alias("best"))
    above = F.max("best").over(Window.partitionBy("p_brand").orderBy(F.desc("p_size")).rowsBetween(Window.unboundedPreceding, -1))
    front = p.withColumn("above", above).where("above is null or best > above").select(F.col("p_brand").alias("b"), F.col("p_size").alias("s"), "best")
    j = table(spark, sf, "part").join(front, (F.col("p_brand") == F.col("b")) & (F.col("p_size") == F.col("s")) & (F.col("p_retailprice") == F.col("best")))
    return j.select("p_partkey")


@register(Q, """SELECT event_type, median(v) AS median_score, min(v) AS worst, count(*) AS cells FROM (SELECT event_type, user_id % 10 AS cell, round(median(value), 6) AS v FROM events GROUP BY ALL) GROUP BY event_type""")
def min_median_promotion(spark, sf):
    cells = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 10).alias("cell")).agg(F.round(F.median("value"), 6).alias("v"))
    return cells.groupBy("event_type").agg(F.median("v").alias("median_score"), F.min("v").alias("worst"), F.count("*").alias("cells"))


@register(Q, """SELECT source, median(quality) AS med, round(avg(quality), 6) AS pass_rate, bool_or(toxic = 1) AS any_reject, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def scope_aggregate(spark, sf):
    j = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    return j.groupBy("source").agg(F.median("quality").alias("med"), F.round(F.avg("quality"), 6).alias("pass_rate"), F.bool_or(F.col("toxic") == 1).alias("any_reject"), F.count("*").alias("n"))


@register(Q, """SELECT source, pass_rate, promotable, CAST(row_number() OVER (ORDER BY promotable DESC, pass_rate DESC, source) AS INTEGER) AS place FROM (
  SELECT source, round(avg(quality), 6) AS pass_rate, avg(quality) >= 0.75 AND count(*) >= 10 AS promotable FROM documents JOIN labels USING (doc_id) GROUP BY source)""")
def round_decision(spark, sf):
    j = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    arms = j.groupBy("source").agg(F.round(F.avg("quality"), 6).alias("pass_rate"), ((F.avg("quality") >= 0.75) & (F.count("*") >= 10)).alias("promotable"))
    return arms.withColumn("place", F.row_number().over(Window.orderBy(F.desc("promotable"), F.desc("pass_rate"), "source")))


@register(Q, """SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS sources, count(*) AS n, element_at_mid AS upper_median FROM lineitem JOIN (
  SELECT l_partkey, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS element_at_mid FROM lineitem GROUP BY l_partkey) USING (l_partkey) GROUP BY l_partkey, element_at_mid""")
def recipe_traces(spark, sf):
    """Upper medians and source sets per part. Quantities are counted before they are put in order, so a part of
    many lines is as many rows as it has quantities."""
    li = table(spark, sf, "lineitem")
    counts = li.groupBy("l_partkey", "l_quantity").agg(F.count("*").alias("c"))
    w = Window.partitionBy("l_partkey").orderBy("l_quantity")
    total = F.sum("c").over(Window.partitionBy("l_partkey"))
    mid = counts.withColumns({"upto": F.sum("c").over(w), "n": total}).where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy("l_partkey").agg(F.min("l_quantity").alias("upper_median"), F.max("n").alias("n"))
    s = li.groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set("l_suppkey")), ",").alias("sources"))
    return mid.join(s, "l_partkey").select("l_partkey", "sources", "n", "upper_median")


@register(Q, """SELECT o_custkey, accepted, n FROM (SELECT o_custkey, count(*) AS n, bool_and(ok) AS accepted FROM (
  SELECT o_custkey, o_totalprice >= coalesce(lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 0) AS ok FROM orders) GROUP BY o_custkey)""")
def revision_acceptance(spark, sf):
    prev = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    o = table(spark, sf, "orders").withColumn("ok", F.col("o_totalprice") >= F.coalesce(prev, F.lit(0.0)))
    return o.groupBy("o_custkey").agg(F.bool_and("ok").alias("accepted"), F.count("*").alias("n"))


# ---------------------------------------------------------------- sampling and assignment

KEY = f"-ln({sql_uniform(5, 'p_partkey')}) / p_size"


@register(Q, f"SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY {KEY}, p_partkey) AS n FROM part WHERE p_size > 0) WHERE n <= 5")
def weighted_sample_wor(spark, sf):
    """Five parts of a brand without replacement, by size: exponential keys by hash."""
    p = table(spark, sf, "part").where("p_size > 0").withColumn("key", -F.log(uniform(5, F.col("p_partkey"))) / F.col("p_size"))
    return p.withColumn("n", F.row_number().over(Window.partitionBy("p_brand").orderBy("key", "p_partkey"))).where("n <= 5").select("p_brand", "p_partkey")


@register(Q, f"""SELECT p_brand, p_partkey, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY best DESC, key DESC, p_partkey) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1 AS best, p_retailprice / 50.0 - ln(-ln({sql_uniform(6, 'p_partkey')})) AS key FROM part)) WHERE n <= 4""")
def boltzmann_select(spark, sf):
    """The best part of a brand always, others by softmax of price: Gumbel keys by hash."""
    best = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")) == 1
    p = table(spark, sf, "part").withColumns({"best": best, "key": F.col("p_retailprice") / 50.0 - F.log(-F.log(uniform(6, F.col("p_partkey"))))})
    w = Window.partitionBy("p_brand").orderBy(F.desc("best"), F.desc("key"), "p_partkey")
    return p.withColumn("place", F.row_number().over(w)).where("place <= 4").select("p_brand", "p_partkey", "place")


@register(Q, f"SELECT doc_id, source, CASE WHEN n = c THEN 'holdout' WHEN n = c - 1 AND c > 3 THEN 'calibration' ELSE 'profiling' END AS part FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {sql_uniform(9, 'doc_id')}, doc_id) AS n, count(*) OVER (PARTITION BY source) AS c FROM documents)")
def partition_plan(spark, sf):
    """Of each source the document with the last draw is held out, of four or more the one before calibrates. The
    two last draws come from aggregates that combine before the shuffle, so a large source isn't one task."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.struct(uniform(9, F.col("doc_id")).alias("u"), F.col("doc_id").alias("i")).alias("k"))
    key = F.coalesce("source", F.lit("\x00"))
    last = d.groupBy(key.alias("s")).agg(F.max("k").alias("last"), F.count("*").alias("c"))
    before = d.join(F.broadcast(last), key == F.col("s")).where(F.col("k") < F.col("last")).groupBy(F.col("s").alias("t")).agg(F.max("k").alias("second"))
    ends = last.join(before, F.col("s") == F.col("t"), "left")
    part = F.when(F.col("k") == F.col("last"), "holdout").when((F.col("c") > 3) & (F.col("k") == F.col("second")), "calibration").otherwise("profiling")
    return d.join(ends, key == F.col("s")).select("doc_id", "source", part.alias("part"))


@register(Q, "SELECT r_name, mode, seed, count(*) OVER () AS arms FROM region, (SELECT DISTINCT l_returnflag AS mode FROM lineitem), (SELECT unnest([1, 2, 3]) AS seed)")
def experiment_grid(spark, sf):
    """Arms as a product of factor tables, each of a few rows."""
    modes = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("mode")).distinct()
    g = table(spark, sf, "region").select("r_name").join(F.broadcast(modes)).withColumn("seed", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    return g.select("r_name", "mode", "seed", F.count("*").over(Window.partitionBy()).alias("arms"))


@register(Q, f"SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY {sql_uniform(3, 'p_partkey')}, p_partkey) AS INTEGER) AS label FROM part")
def blind_assignment(spark, sf):
    """Labels in the order of a hashed draw."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand").withColumn("draw", uniform(3, F.col("p_partkey")))
    return D.numbered(p, "p_brand", "draw", "p_partkey").select("p_partkey", "p_brand", F.col("place").alias("label"))


@register(Q, "SELECT a.n_regionkey AS cell, a.n_nationkey AS first, b.n_nationkey AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def pair_schedule(spark, sf):
    """Every pair of a cell of bounded size in both orders."""
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("cell"), F.col("n_nationkey").alias("first"))
    return n.join(n.withColumnRenamed("first", "second"), "cell").where("first <> second")
