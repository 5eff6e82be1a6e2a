"""Segmentation, gates, signatures and seals beyond the first set: each an expression over one text or
a join on a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusx.functions.text import ngrams, sql_ngrams, sql_tokens, tokenize, windows
from corpusx.operators.lsh import minhash_join as join_by_signatures
from corpusx.operators.lsh import signature
from corpusx.plans.overlap_queries import CONTAINED, PAIRS, contained, diversity_pairs
from corpusx.plans.tables import register, table
from corpusx.sources.records import merge_corpus as merge

Q: dict = {}
TOKS = sql_tokens()


@register(Q, """SELECT coalesce(o_custkey, c_custkey) AS c_custkey, CASE WHEN o_custkey IS NULL THEN 'kept' WHEN c_custkey IS NULL THEN 'inserted' WHEN c_acctbal = best THEN 'identical' ELSE 'conflict' END AS verdict
  FROM customer FULL JOIN (SELECT o_custkey, max(o_totalprice) AS best FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def merge_corpus(spark, sf):
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return merge(table(spark, sf, "customer"), new, "c_custkey", ["c_acctbal"])


def chunk_scenes(docs: DataFrame, least: int = 300, most: int = 950, carry: int = 220) -> DataFrame:
    """(doc_id, idx, words, paras): paragraphs (of three words or more) packed greedily.

    A chunk closes when it holds ``least`` words and the next paragraph would pass ``most``; its last
    paragraph opens the next chunk too if it has fewer than ``carry`` words. One fold per document.
    """
    sizes = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda p: F.size(tokenize(p)))
    kind = "struct<done: array<struct<words: int, paras: int>>, words: int, paras: int, last: int>"
    start = F.from_json(F.lit('{"done": [], "words": 0, "paras": 0, "last": 0}'), kind)

    def step(acc, n):
        full = (acc["words"] >= least) & (acc["words"] + n > most)
        kept = F.when(acc["last"] < carry, acc["last"]).otherwise(0)
        closed = F.concat(acc["done"], F.array(F.struct(acc["words"].alias("words"), acc["paras"].alias("paras"))))
        return F.struct(
            F.when(full, closed).otherwise(acc["done"]).alias("done"), F.when(full, kept + n).otherwise(acc["words"] + n).cast("int").alias("words"),
            F.when(full, (kept > 0).cast("int") + 1).otherwise(acc["paras"] + 1).cast("int").alias("paras"), n.cast("int").alias("last")).cast(kind)

    def finish(acc):
        return F.when(acc["paras"] > 0, F.concat(acc["done"], F.array(F.struct(acc["words"].alias("words"), acc["paras"].alias("paras"))))).otherwise(acc["done"])

    packed = F.aggregate(F.filter(sizes, lambda n: n >= 3), start, step, finish)
    return docs.select("doc_id", F.posexplode(packed).alias("idx", "c")).select("doc_id", "idx", "c.words", "c.paras")


register(Q, name="chunk_scenes")(lambda spark, sf: chunk_scenes(table(spark, sf, "documents")))


@register(Q, """SELECT doc_id, a > 0 AND b > 0 AS all_found, CASE WHEN a > 0 AND b > 0 THEN round((a + b - 1) / length(text), 6) END AS fraction FROM (
  SELECT *, CASE WHEN a > 0 THEN strpos(substr(text, a + 1), '.') ELSE 0 END AS b FROM (SELECT doc_id, text, strpos(text, ',') AS a FROM documents WHERE text IS NOT NULL))""")
def ordered_pattern_gate(spark, sf):
    """Marks found each after the end of the one before (comma, then full stop), and where the last lies."""
    d = table(spark, sf, "documents").where("text is not null").withColumn("a", F.instr("text", ","))
    d = d.withColumn("b", F.expr("if(a > 0, locate('.', text, a + 1), 0)"))
    found = (F.col("a") > 0) & (F.col("b") > 0)
    return d.select("doc_id", found.alias("all_found"), F.when(found, F.round((F.col("b") - 1) / F.length("text"), 6)).alias("fraction"))


@register(Q, f"SELECT doc_id, term, count(*) AS hits FROM (SELECT doc_id, unnest({TOKS}) AS term FROM documents) JOIN (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\\p{{Lu}}][\\p{{L}}]{{2,}}'))) AS term FROM benchmark) USING (term) GROUP BY ALL")
def identity_leak_scan(spark, sf):
    """Words of a text that are on a list of identities, here all capitalised words of the passages: a join on the word."""
    named = F.regexp_extract_all("text", F.lit(r"[\p{Lu}][\p{L}]{2,}"), F.lit(0))
    names = table(spark, sf, "benchmark").select(F.explode(named).alias("name")).select(F.lower("name").alias("term")).distinct()
    words = table(spark, sf, "documents").select("doc_id", F.explode(tokenize(F.col("text"))).alias("term"))
    return words.join(names, "term").groupBy("doc_id", "term").agg(F.count("*").alias("hits"))


@register(Q, f"""SELECT doc_id, round(a, 6) AS head_rate, round(b, 6) AS tail_rate, abs(a - b) >= 5 AND CASE WHEN least(a, b) = 0 THEN greatest(a, b) > 0 ELSE greatest(a, b) / least(a, b) >= 2 END AS discontinuous FROM (
  SELECT doc_id, 1000.0 * len(list_filter(h, lambda x: x IN ('the', 'and', 'of'))) / len(h) AS a, 1000.0 * len(list_filter(t, lambda x: x IN ('the', 'and', 'of'))) / len(t) AS b FROM (
    SELECT doc_id, w[1:len(w) // 2] AS h, w[len(w) // 2 + 1:] AS t FROM (SELECT doc_id, {TOKS} AS w FROM documents) WHERE len(w) >= 2))""")
def style_discontinuity(spark, sf):
    """Rates per 1,000 words of a family in the halves of a text: apart by 5 and by a factor of 2."""
    d = table(spark, sf, "documents").select("doc_id", tokenize(F.col("text")).alias("w")).where(F.size("w") >= 2)
    half = F.floor(F.size("w") / 2).cast("int")
    parts = d.select("doc_id", F.slice("w", F.lit(1), half).alias("h"), F.slice("w", half + 1, F.size("w")).alias("t"))
    rate = lambda c: 1000.0 * F.size(F.filter(c, lambda x: x.isin("the", "and", "of"))) / F.size(c)
    r = parts.select("doc_id", rate("h").alias("a"), rate("t").alias("b"))
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    return r.select("doc_id", F.round("a", 6).alias("head_rate"), F.round("b", 6).alias("tail_rate"), ((hi - lo >= 5) & F.when(lo == 0, hi > 0).otherwise(hi / lo >= 2)).alias("discontinuous"))


@register(Q, f"""SELECT item_id, array_to_string(list_transform(range(0, 32), lambda s: coalesce(list_min(list_transform(h, lambda x: (x * (2 * s * s + 7 * s + 1) + 31 * s + 17) % 2147483647)), 2147483647)), ',') AS signature FROM (
  SELECT item_id, list_transform({sql_ngrams('toks', 5)}, lambda g: CAST('0x' || substr(md5(g), 1, 8) AS BIGINT)) AS h FROM (SELECT item_id, {TOKS} AS toks FROM benchmark))""")
def minhash_signature(spark, sf):
    """32 salted minima over hashes of 5-grams; a text without 5-grams has the largest values."""
    h = F.transform(ngrams(F.col("toks"), 5), lambda g: F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long"))
    d = table(spark, sf, "benchmark").select("item_id", tokenize(F.col("text")).alias("toks")).select("item_id", h.alias("h"))
    return d.select("item_id", F.array_join(signature(F.col("h")), ",").alias("signature"))


@register(Q)
def minhash_join(spark, sf):
    """The likeliest window of 50 words of each document for each benchmark passage that it resembles: bands of signatures, verified."""
    d = table(spark, sf, "documents").select("doc_id", tokenize(F.col("text")).alias("toks")).select("doc_id", F.explode(windows(F.col("toks"), 50, 25, 8)).alias("w"))
    pairs = join_by_signatures(d.select("doc_id", F.array_join("w.toks", " ").alias("text")), table(spark, sf, "benchmark"), ("doc_id", "item_id"))
    return pairs.groupBy(F.col("id").alias("doc_id"), F.col("other_id").alias("item_id")).agg(F.max("similarity").alias("similarity"))


@register(Q, f"""SELECT c.id, count(*) AS flags, count(*) FILTER (WHERE l.doc_id IS NULL) AS unresolved, bool_or(coalesce(toxic, 0) = 1) AS hard_fail FROM {CONTAINED} c LEFT JOIN labels l ON l.doc_id = c.id WHERE flagged GROUP BY c.id""")
def adjudicated_overlap(spark, sf):
    """Flags of a document, how many nobody has adjudicated, and whether one was judged a failure."""
    lab = table(spark, sf, "labels").select("doc_id", "toxic")
    j = contained(spark, sf).where("flagged").join(lab, F.col("doc_id") == F.col("id"), "left")
    return j.groupBy("id").agg(F.count("*").alias("flags"), F.count_if(F.col("doc_id").isNull()).alias("unresolved"), F.bool_or(F.coalesce("toxic", F.lit(0)) == 1).alias("hard_fail"))


@register(Q, f"""SELECT grp, round(near, 6) AS near_fraction, round(mean, 6) AS mean_similarity, near >= 0.4 OR mean >= 0.62 AS converged FROM (SELECT grp, avg(CASE WHEN j3 >= 0.76 THEN 1.0 ELSE 0.0 END) AS near, avg(j3) AS mean FROM {PAIRS} GROUP BY grp)""")
def batch_convergence(spark, sf):
    g = diversity_pairs(spark, sf).groupBy("grp").agg(F.avg((F.col("j3") >= 0.76).cast("double")).alias("near"), F.avg("j3").alias("mean"))
    return g.select("grp", F.round("near", 6).alias("near_fraction"), F.round("mean", 6).alias("mean_similarity"), ((F.col("near") >= 0.4) | (F.col("mean") >= 0.62)).alias("converged"))


@register(Q, """SELECT a.l_orderkey, a.l_linenumber, CAST((a.l_quantity <> b.l_quantity)::INT + (a.l_discount <> b.l_discount)::INT + (a.l_tax <> b.l_tax)::INT AS INTEGER) AS changed FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1""")
def one_axis_mutation(spark, sf):
    """How many declared axes a child (line) changes against its parent (the line before)."""
    cols = ["l_quantity", "l_discount", "l_tax"]
    c = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *cols)
    p = c.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") + 1).alias("n"), *[F.col(x).alias(f"p_{x}") for x in cols])
    j = c.join(p, (F.col("l_orderkey") == F.col("k")) & (F.col("l_linenumber") == F.col("n")))
    return j.select("l_orderkey", "l_linenumber", sum(((F.col(x) != F.col(f"p_{x}")).cast("int") for x in cols), F.lit(0)).alias("changed"))


@register(Q, """SELECT conv_id, bool_and(starts_with(whole, head)) AS preserved, sha256(max(head)) AS prefix_hash FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS whole, arg_min(text, turn) AS head FROM conversations GROUP BY conv_id) GROUP BY conv_id""")
def prefix_preserved(spark, sf):
    """Whether a merged conversation starts with its first turn."""
    g = table(spark, sf, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    whole = F.array_join(F.transform("t", lambda x: x["text"]), "\n")
    return g.select("conv_id", F.startswith(whole, F.col("t")[0]["text"]).alias("preserved"), F.sha2(F.col("t")[0]["text"], 256).alias("prefix_hash"))


SAID = sql_tokens("q").replace("lambda x:", "lambda y:").replace("lower(x)", "lower(y)")


@register(Q, f"""SELECT item_id, doc_id, CAST(len(qs) AS INTEGER) AS sentences, CAST(len(list_filter(qs, lambda q: strpos(text, q) > 0)) AS INTEGER) AS verbatim,
  CAST(len(list_filter(qs, lambda q: strpos(text, q) > 0 OR (len({SAID}) >= 4 AND strpos(said, ' ' || array_to_string({SAID}, ' ') || ' ') > 0))) AS INTEGER) AS supported FROM (
  SELECT b.item_id, d.doc_id, d.text, ' ' || array_to_string({sql_tokens("d.text")}, ' ') || ' ' AS said, list_filter(string_split_regex(b.text, '[.!?]+\\s*'), lambda q: length(q) > 0) AS qs
  FROM benchmark b JOIN (SELECT DISTINCT id, source_id FROM {CONTAINED}) c ON c.source_id = b.item_id JOIN documents d ON d.doc_id = c.id)""")
def quote_support(spark, sf):
    """Of all sentences of a passage: how many stand verbatim in a document that shares its 8-grams, and how many do
    so verbatim or, if they have four words or more, in normalised words."""
    c = contained(spark, sf).select("id", "source_id").distinct()
    b = table(spark, sf, "benchmark").select("item_id", F.filter(F.split("text", r"[.!?]+\s*", -1), lambda q: F.length(q) > 0).alias("qs"))
    d = table(spark, sf, "documents").select("doc_id", "text", F.concat(F.lit(" "), F.array_join(tokenize(F.col("text")), " "), F.lit(" ")).alias("said"))
    j = c.join(b, F.col("source_id") == F.col("item_id")).join(d, F.col("doc_id") == F.col("id"))
    j = j.select("item_id", "doc_id", F.transform("qs", lambda q: F.struct(F.contains("text", q).alias("v"), tokenize(q).alias("t"))).alias("x"), "said")
    near = lambda x: (F.size(x["t"]) >= 4) & F.contains(F.col("said"), F.concat(F.lit(" "), F.array_join(x["t"], " "), F.lit(" ")))
    return j.select("item_id", "doc_id", F.size("x").alias("sentences"), F.size(F.filter("x", lambda x: x["v"])).alias("verbatim"), F.size(F.filter("x", lambda x: x["v"] | near(x))).alias("supported"))


@register(Q, """SELECT source, lang, count(*) AS n, md5(CAST(sum(CAST('0x' || substr(md5(concat_ws(':', doc_id, coalesce(text, ''))), 1, 12) AS BIGINT)) AS VARCHAR)) AS seal FROM documents GROUP BY source, lang""")
def seal_set(spark, sf):
    """Order-free seal of a set: a sum of row hashes, so that partial sums combine before the shuffle."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))), 1, 12), 16, 10).cast("decimal(20,0)")
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.md5(F.sum(h).cast("string").cast("binary")).alias("seal"))
