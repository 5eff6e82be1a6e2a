"""Judgment checks, promotion and selection queries. A line item is a judgment of a part (candidate)
by a supplier (reviewer): quantity, discount and tax are its axes, the return flag its verdict."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusx.plans.tables import register, table

Q: dict = {}


@register(Q, """SELECT l_orderkey, l_linenumber, axis, raw, round(raw / hi * weight, 6) AS weighted, raw NOT BETWEEN 0 AND hi AS out_of_range
  FROM lineitem, LATERAL (SELECT unnest(['quantity', 'discount', 'tax']) AS axis, unnest([l_quantity, l_discount, l_tax]) AS raw, unnest([50.0, 0.1, 0.08]) AS hi, unnest([60.0, 25.0, 15.0]) AS weight)""")
def score_judgment(spark, sf):
    """Each axis of a judgment, range-checked and weighted by the rubric."""
    rubric = [("quantity", "l_quantity", 50.0, 60.0), ("discount", "l_discount", 0.1, 25.0), ("tax", "l_tax", 0.08, 15.0)]
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(c).cast("double").alias("raw"), F.lit(hi).alias("hi"), F.lit(w).alias("weight")) for a, c, hi, w in rubric])
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.inline(axes))
    return rows.select("l_orderkey", "l_linenumber", "axis", "raw", F.round(F.col("raw") / F.col("hi") * F.col("weight"), 6).alias("weighted"), (~F.col("raw").between(0, F.col("hi"))).alias("out_of_range"))


@register(Q, """SELECT l_partkey, round(avg(l_quantity), 6) AS mean, max(l_quantity) - min(l_quantity) AS disagreement, bool_or(l_returnflag = 'R') AS any_reject,
  avg(l_quantity) >= 20 AND NOT bool_or(l_returnflag = 'R') AS admitted FROM lineitem GROUP BY l_partkey""")
def two_pass_quality(spark, sf):
    """Mean over blind passes, their disagreement, and the cut with any hard reject."""
    reject, mean = F.bool_or(F.col("l_returnflag") == "R"), F.avg("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.round(mean, 6).alias("mean"), (F.max("l_quantity") - F.min("l_quantity")).alias("disagreement"), reject.alias("any_reject"), ((mean >= 20) & ~reject).alias("admitted"))


@register(Q, """SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus NOT IN ('O', 'F') THEN 'unknown verdict' WHEN l_discount NOT BETWEEN 0 AND 1 THEN 'confidence' WHEN p_partkey IS NULL THEN 'unknown candidate'
  WHEN s_suppkey IS NULL THEN 'unknown reviewer' ELSE 'ok' END AS verdict FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def pairwise_validate(spark, sf):
    """Each judgment's first defect in a fixed order; ids are resolved by joins."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey"), F.col("p_partkey") == F.col("l_partkey"), "left")
    j = j.join(table(spark, sf, "supplier").select("s_suppkey"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    v = F.when(~F.col("l_linestatus").isin("O", "F"), "unknown verdict").when(~F.col("l_discount").between(0, 1), "confidence")
    v = v.when(F.col("p_partkey").isNull(), "unknown candidate").when(F.col("s_suppkey").isNull(), "unknown reviewer").otherwise("ok")
    return j.select("l_orderkey", "l_linenumber", v.alias("verdict"))


CARDS = """(SELECT doc_id, coalesce(n_chars > 0, false) AS gated, quality, toxic, list_sort(list_distinct(list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN lang IS NULL THEN 'no language' END,
  CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'weak' END], lambda x: x IS NOT NULL))) AS defects FROM documents LEFT JOIN labels USING (doc_id))"""


def cards(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(lab, "doc_id", "left")
    named = [(F.col("n_chars") < 200, "short"), (F.col("lang").isNull(), "no language"), (F.col("toxic") == 1, "toxic"), (F.col("quality") == 0, "weak")]
    return d.withColumns({"gated": F.coalesce(F.col("n_chars") > 0, F.lit(False)), "defects": F.array_sort(F.array_compact(F.array(*[F.when(c, n) for c, n in named])))})


@register(Q, f"SELECT doc_id, gated AND coalesce(quality, 0) = 1 AS eligible, array_to_string(defects, ',') AS defects FROM {CARDS}")
def merge_scorecards(spark, sf):
    """Gates from the deterministic card, scores from the judged one, the sorted union of defects."""
    return cards(spark, sf).select("doc_id", (F.col("gated") & (F.coalesce("quality", F.lit(0)) == 1)).alias("eligible"), F.array_join("defects", ",").alias("defects"))


@register(Q, f"SELECT doc_id, array_to_string(list_filter(['no language', 'toxic'], lambda x: list_contains(defects, x)), ',') AS reasons, len(list_filter(['no language', 'toxic'], lambda x: list_contains(defects, x))) > 0 AND coalesce(quality, 0) = 1 AS contradiction FROM {CARDS}")
def forced_reject(spark, sf):
    """Reasons on the hard list, and whether the judgment passed the document all the same."""
    hard = F.array_intersect(F.array(F.lit("no language"), F.lit("toxic")), F.col("defects"))
    return cards(spark, sf).select("doc_id", F.array_join(hard, ",").alias("reasons"), ((F.size(hard) > 0) & (F.coalesce("quality", F.lit(0)) == 1)).alias("contradiction"))


@register(Q, f"SELECT defect, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (SELECT doc_id, unnest(defects) AS defect FROM {CARDS}) GROUP BY defect")
def defect_rules(spark, sf):
    return cards(spark, sf).select("doc_id", F.explode("defects").alias("defect")).groupBy("defect").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@register(Q, f"""SELECT source, doc_id, n_defects, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_defects DESC, doc_id) AS place
  FROM (SELECT source, doc_id, len(c.defects) AS n_defects FROM {CARDS} c JOIN documents USING (doc_id)) WHERE n_defects > 0) WHERE place <= 5""")
def defect_shortlist(spark, sf):
    """Five documents of a source with the most defects (a top-k report)."""
    c = cards(spark, sf).select("source", "doc_id", F.size("defects").cast("long").alias("n_defects")).where("n_defects > 0")
    return c.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_defects"), "doc_id"))).where("place <= 5")


@register(Q, """SELECT doc_id, round(least(n_chars / 500.0, 4.0) * 1.5 + least(words / 100.0, 5.0) - CASE WHEN lang IS NULL THEN 2.0 ELSE 0.0 END, 4) AS signal, n_chars >= 200 AND lang IS NOT NULL AS eligible
  FROM (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[a-z]+')) AS DOUBLE) AS words FROM documents)""")
def stage_quality_signal(spark, sf):
    """Capped weighted counters less penalties."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[a-z]+")).cast("double")
    s = F.least(F.col("n_chars") / 500.0, F.lit(4.0)) * 1.5 + F.least(words / 100.0, F.lit(5.0)) - F.when(F.col("lang").isNull(), 2.0).otherwise(0.0)
    return table(spark, sf, "documents").select("doc_id", F.round(s, 4).alias("signal"), ((F.col("n_chars") >= 200) & F.col("lang").isNotNull()).alias("eligible"))


@register(Q, """SELECT p_brand, p_partkey, CAST(seed AS INTEGER) AS seed FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN place <= 3 THEN place ELSE 4 END, p_size DESC, p_partkey) AS seed
  FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part)) WHERE seed <= 4""")
def bracket_seed(spark, sf):
    """The three best of a group and, of the rest, the one of most diversity (here: size)."""
    p = table(spark, sf, "part").withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")))
    w = Window.partitionBy("p_brand").orderBy(F.least("place", F.lit(4)), F.desc("p_size"), "p_partkey")
    return p.withColumn("seed", F.row_number().over(w)).where("seed <= 4").select("p_brand", "p_partkey", "seed")


BOUTS = f"(SELECT a.p_brand, a.p_partkey AS a, b.p_partkey AS b, ap.p_retailprice AS pa, bp.p_retailprice AS pb FROM ({Q['bracket_seed'][1]}) a JOIN ({Q['bracket_seed'][1]}) b ON a.p_brand = b.p_brand AND (a.seed, b.seed) IN ((1, 4), (2, 3)) JOIN part ap ON ap.p_partkey = a.p_partkey JOIN part bp ON bp.p_partkey = b.p_partkey)"
ON_PART = "(SELECT l_partkey AS k, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS pts FROM lineitem GROUP BY l_partkey)"


@register(Q, f"""SELECT p_brand, a, b, CASE WHEN qa <> qb THEN CASE WHEN qa > qb THEN a ELSE b END WHEN pa <> pb THEN CASE WHEN pa > pb THEN a ELSE b END ELSE greatest(a, b) END AS winner,
  CASE WHEN qa <> qb THEN 'points' WHEN pa <> pb THEN 'score' ELSE 'id' END AS decided_by FROM (SELECT t.*, coalesce(x.pts, 0) AS qa, coalesce(y.pts, 0) AS qb FROM {BOUTS} t LEFT JOIN {ON_PART} x ON x.k = a LEFT JOIN {ON_PART} y ON y.k = b)""")
def bracket_resolve(spark, sf):
    """Winner of each seeded bout by points, then score, then the larger id."""
    price = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_retailprice")
    points = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.sum((F.col("l_linestatus") == "O").cast("long")).alias("pts"))
    s = bracket_seed(spark, sf).join(price.join(points, "k", "left"), F.col("p_partkey") == F.col("k")).select("p_brand", "p_partkey", "seed", F.col("p_retailprice").alias("p"), F.coalesce("pts", F.lit(0)).alias("q"))
    b = s.select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("b"), F.col("seed").alias("t"), F.col("p").alias("pb"), F.col("q").alias("qb"))
    m = s.join(b, (F.col("p_brand") == F.col("g")) & (F.col("seed") < F.col("t")) & (F.col("seed") + F.col("t") == 5)).withColumnRenamed("p_partkey", "a")
    by = F.when(F.col("q") != F.col("qb"), "points").when(F.col("p") != F.col("pb"), "score").otherwise("id")
    won = F.when(F.col("q") != F.col("qb"), F.col("q") > F.col("qb")).when(F.col("p") != F.col("pb"), F.col("p") > F.col("pb")).otherwise(F.col("a") > F.col("b"))
    return m.select("p_brand", "a", "b", F.when(won, F.col("a")).otherwise(F.col("b")).alias("winner"), by.alias("decided_by"))


@register(Q, """SELECT l_partkey, count(DISTINCT l_suppkey) FILTER (WHERE l_tax > 0) AS independent, count(DISTINCT l_suppkey) FILTER (WHERE l_tax > 0) >= 2 AS enough FROM lineitem GROUP BY l_partkey""")
def review_independence(spark, sf):
    """Reviewers of a candidate with a blind exposure (here: taxed), and whether two are there."""
    n = F.countDistinct(F.when(F.col("l_tax") > 0, F.col("l_suppkey")))
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(n.alias("independent"), (n >= 2).alias("enough"))


@register(Q, """SELECT l_suppkey, l_partkey, admissions, CASE WHEN n > 1 THEN 'repeated' WHEN bad > 0 THEN 'out of range' ELSE 'admitted' END AS verdict FROM (
  SELECT l_suppkey, l_partkey, count(*) AS n, count(*) FILTER (WHERE l_quantity NOT BETWEEN 1 AND 50) AS bad, count(*) AS admissions FROM lineitem GROUP BY ALL)""")
def admit_reviews(spark, sf):
    """One submission per reviewer and candidate, in range."""
    g = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("admissions"), F.count_if(~F.col("l_quantity").between(1, 50)).alias("bad"))
    v = F.when(F.col("admissions") > 1, "repeated").when(F.col("bad") > 0, "out of range").otherwise("admitted")
    return g.select("l_suppkey", "l_partkey", "admissions", v.alias("verdict"))


@register(Q, """SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS candidates, round(avg(CASE l_linestatus WHEN 'O' THEN 1.0 ELSE 0.0 END), 6) AS win_rate, median(l_quantity) AS med,
  count(*) FILTER (WHERE l_discount > 0.08) AS rejected FROM lineitem GROUP BY l_returnflag""")
def trace_arms(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.countDistinct("l_partkey").alias("candidates"), F.round(F.avg((F.col("l_linestatus") == "O").cast("double")), 6).alias("win_rate"),
        F.median("l_quantity").alias("med"), F.count_if(F.col("l_discount") > 0.08).alias("rejected"))


MEETS = """(SELECT least(l_suppkey, o_custkey) AS lo, greatest(l_suppkey, o_custkey) AS hi, bool_or(l_suppkey < o_custkey) AND bool_or(l_suppkey > o_custkey) AS both_orders,
  sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS up, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey <> o_custkey GROUP BY ALL)"""


@register(Q, f"SELECT lo, round(avg(CASE WHEN NOT both_orders THEN 0.5 WHEN up = n THEN 1.0 WHEN up = 0 THEN 0.0 ELSE 0.5 END), 6) AS win_rate, count(*) AS pairs FROM {MEETS} GROUP BY lo")
def reversed_pair_winrate(spark, sf):
    """A pair counts as won only if seen in both orders and judged alike; else it is a tie."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_suppkey <> o_custkey")
    m = j.groupBy(F.least("l_suppkey", "o_custkey").alias("lo"), F.greatest("l_suppkey", "o_custkey").alias("hi")).agg(
        (F.bool_or(F.col("l_suppkey") < F.col("o_custkey")) & F.bool_or(F.col("l_suppkey") > F.col("o_custkey"))).alias("both"), F.count_if(F.col("l_linestatus") == "O").alias("up"), F.count("*").alias("n"))
    v = F.when(~F.col("both"), 0.5).when(F.col("up") == F.col("n"), 1.0).when(F.col("up") == 0, 0.0).otherwise(0.5)
    return m.groupBy("lo").agg(F.round(F.avg(v), 6).alias("win_rate"), F.count("*").alias("pairs"))


@register(Q, """SELECT p_brand, p_partkey, CAST(place AS INTEGER) AS place FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY m DESC, p_partkey) AS place FROM part
  JOIN (SELECT l_partkey, round(avg(l_quantity), 6) AS m FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey WHERE m >= 25) WHERE place <= 3""")
def admit_top(spark, sf):
    """Three best of a group above the least mean (a top-k report)."""
    m = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.round(F.avg("l_quantity"), 6).alias("m")).where("m >= 25")
    j = table(spark, sf, "part").select("p_partkey", "p_brand").join(m, F.col("l_partkey") == F.col("p_partkey"))
    return j.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("m"), "p_partkey"))).where("place <= 3").select("p_brand", "p_partkey", "place")


AXES = "(SELECT p_partkey, p_type, p_brand, p_size, p_retailprice, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS n FROM part)"


@register(Q, f"SELECT p_brand, p_partkey, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n = 1 DESC, p_size DESC, p_retailprice DESC, p_partkey) AS place FROM {AXES}) WHERE place <= 8")
def axis_cover_topk(spark, sf):
    """The best of each axis (type) first, then the rest by strength, to a limit per group."""
    order = [F.desc("p_size"), F.desc("p_retailprice"), "p_partkey"]
    p = table(spark, sf, "part").withColumn("n", F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy(*order)))
    w = Window.partitionBy("p_brand").orderBy(F.desc(F.col("n") == 1), *order)
    return p.withColumn("place", F.row_number().over(w)).where("place <= 8").select("p_brand", "p_partkey", "place")


@register(Q, "SELECT doc_id, scope, sha256(t) AS text_hash FROM (SELECT doc_id, unnest(['whole', 'opening', 'continuation']) AS scope, unnest([coalesce(text, ''), substr(coalesce(text, ''), 1, 200), substr(coalesce(text, ''), 201)]) AS t FROM documents)")
def scope_texts(spark, sf):
    t = F.coalesce("text", F.lit(""))
    each = F.array(F.struct(F.lit("whole").alias("scope"), t.alias("t")), F.struct(F.lit("opening").alias("scope"), F.substring(t, 1, 200).alias("t")), F.struct(F.lit("continuation").alias("scope"), F.expr("substring(coalesce(text, ''), 201)").alias("t")))
    return table(spark, sf, "documents").select("doc_id", F.inline(each)).select("doc_id", "scope", F.sha2("t", 256).alias("text_hash"))
