"""Overlap and diversity queries: documents against benchmark passages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusx.functions.text import sql_ngrams, sql_tokens
from corpusx.operators import diversity as D
from corpusx.operators import overlap as O
from corpusx.plans.tables import register, table

Q: dict = {}


def grams(name: str, key: str, n: int, distinct: bool = True) -> str:
    """SQL text: (id, gram, pos) of a table."""
    return f"""(SELECT id, gram, {'min(pos)' if distinct else 'pos'} AS pos FROM (
      SELECT id, unnest(g) AS gram, unnest(range(0, len(g))) AS pos FROM (
        SELECT {key} AS id, {sql_ngrams('toks', n)} AS g FROM (SELECT {key}, {sql_tokens()} AS toks FROM {name}) WHERE len(toks) >= {n}))
      {'GROUP BY id, gram' if distinct else ''})"""


INDEX = f"(SELECT gram, list_sort(list(DISTINCT id)) AS sources FROM {grams('benchmark', 'item_id', 12)} GROUP BY gram)"
MATCHES = f"(SELECT d.id, d.gram, d.pos, i.sources FROM {grams('documents', 'doc_id', 12)} d JOIN {INDEX} i USING (gram))"
CONTAINED = f"""(SELECT id, source_id, shared, round(shared / own, 6) AS ratio, shared / own > 0.1 AS flagged FROM (
  SELECT d.id, s.id AS source_id, count(*) AS shared FROM {grams('documents', 'doc_id', 8)} d JOIN {grams('benchmark', 'item_id', 8)} s USING (gram) GROUP BY ALL)
  JOIN (SELECT id, count(*) AS own FROM {grams('documents', 'doc_id', 8)} GROUP BY id) USING (id))"""


def matches(spark, sf):
    return O.exact_overlap(table(spark, sf, "documents"), O.shingle_index(table(spark, sf, "benchmark"), "item_id", "text"))


def contained(spark, sf):
    return O.containment(table(spark, sf, "documents"), table(spark, sf, "benchmark"), ("doc_id", "item_id"))


@register(Q, f"SELECT gram, array_to_string(sources, ',') AS sources FROM {INDEX}")
def shingle_index(spark, sf):
    return O.shingle_index(table(spark, sf, "benchmark"), "item_id", "text").select("gram", F.array_join("sources", ",").alias("sources"))


@register(Q, f"SELECT id, gram, pos, array_to_string(sources, ',') AS sources FROM {MATCHES}")
def exact_overlap(spark, sf):
    return matches(spark, sf).select("id", "gram", F.col("pos").cast("long").alias("pos"), F.array_join("sources", ",").alias("sources"))


@register(Q, f"SELECT id, source_id, shared, ratio, flagged FROM {CONTAINED}")
def containment(spark, sf):
    return contained(spark, sf)


@register(Q, f"""SELECT d.doc_id, coalesce(matched, 0) AS matched, coalesce(n_sources, 0) AS n_sources, first_pos, m.id IS NOT NULL AS hard_fail FROM documents d LEFT JOIN (
  SELECT id, count(DISTINCT pos) AS matched, count(DISTINCT source) AS n_sources, min(pos) AS first_pos FROM (SELECT id, pos, unnest(sources) AS source FROM {MATCHES}) GROUP BY id) m ON m.id = d.doc_id""")
def overlap_verdict(spark, sf):
    v = O.verdict(matches(spark, sf), table(spark, sf, "documents"))
    return v.withColumn("first_pos", F.col("first_pos").cast("long"))


@register(Q, f"SELECT DISTINCT id, source_id FROM {CONTAINED} c WHERE flagged AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.id)")
def overlap_worklist(spark, sf):
    """Flagged pairs of documents that nobody has labelled."""
    flagged = contained(spark, sf).where("flagged").select("id", "source_id").distinct()
    return flagged.join(table(spark, sf, "labels").select(F.col("doc_id").alias("id")).distinct(), "id", "left_anti")


@register(Q, f"SELECT a.id, b.id AS prior_id, count(*) AS shared FROM {grams('documents', 'doc_id', 16)} a JOIN {grams('documents', 'doc_id', 16)} b ON a.gram = b.gram AND b.id < a.id GROUP BY ALL")
def prior_overlap(spark, sf):
    return O.prior_overlap(table(spark, sf, "documents"), "doc_id")


@register(Q, f"""SELECT id, source_id, max(n) + 7 AS words FROM (SELECT id, source_id, diag, island, count(*) AS n FROM (
  SELECT *, pos - row_number() OVER (PARTITION BY id, source_id, diag ORDER BY pos) AS island FROM (
    SELECT DISTINCT d.id, s.id AS source_id, d.pos, d.pos - s.pos AS diag FROM {grams('documents', 'doc_id', 8, False)} d JOIN {grams('benchmark', 'item_id', 8, False)} s USING (gram)))
  GROUP BY ALL) GROUP BY ALL""")
def longest_common_span(spark, sf):
    return O.longest_common_span(table(spark, sf, "documents"), table(spark, sf, "benchmark"), ("doc_id", "item_id"))


def repeat_sql(n: int, apart: int) -> str:
    g = grams("documents", "doc_id", n, False)
    return f"SELECT id, CAST(sum(CASE WHEN pos - first >= {apart} THEN 1 ELSE 0 END) AS BIGINT) AS n_repeats FROM (SELECT *, min(pos) OVER (PARTITION BY id, gram) AS first FROM {g}) GROUP BY id"


LONG_PARAGRAPHS = f"""(SELECT doc_id, array_to_string({sql_tokens('p')}, ' ') AS said FROM (SELECT doc_id, unnest(string_split_regex(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '\\n\\s*\\n')) AS p FROM documents) WHERE len({sql_tokens('p')}) >= 20)"""


@register(Q, f"""SELECT d.doc_id AS id, coalesce(n_repeats, 0) AS n_repeats, coalesce(again, 0) AS repeated_paragraphs, coalesce(n_repeats, 0) > 0 OR coalesce(again, 0) > 0 AS hard_fail
  FROM documents d LEFT JOIN ({repeat_sql(50, 50)}) r ON r.id = d.doc_id LEFT JOIN (SELECT doc_id, count(*) - count(DISTINCT said) AS again FROM {LONG_PARAGRAPHS} GROUP BY doc_id) p ON p.doc_id = d.doc_id""")
def self_repetition(spark, sf):
    return O.self_repetition(table(spark, sf, "documents"))


@register(Q, repeat_sql(16, 33))
def phrase_replay(spark, sf):
    return O.repeats(table(spark, sf, "documents"), n=16, apart=33)


@register(Q, f"SELECT id, max(n) AS top, max(n) >= 5 AS is_loop FROM (SELECT id, gram, count(*) AS n FROM {grams('documents', 'doc_id', 4, False)} GROUP BY ALL) GROUP BY id")
def max_ngram_repetition(spark, sf):
    return O.max_repetition(table(spark, sf, "documents"))


@register(Q, """SELECT user_id, event_type, event_id FROM (
  SELECT *, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS first FROM events) WHERE event_id <> first""")
def duplicate_views(spark, sf):
    """Later claims of a (user, type) that an earlier event already holds."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf, "events").withColumn("first", F.first("event_id").over(w)).where("event_id <> first").select("user_id", "event_type", "event_id")


def sql_jaccard(a: str, b: str, empty: str = "1.0") -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN {empty} ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


def sql_set(toks: str, n: int) -> str:
    return f"CASE WHEN len({toks}) >= {n} THEN list_distinct({sql_ngrams(toks, n)}) ELSE [] END"


ITEMS = f"(SELECT conv_id AS grp, turn AS id, role, toks, {', '.join(f'{sql_set("toks", n)} AS g{n}' for n in D.SIZES)}, {sql_set('head', 3)} AS opening FROM (SELECT *, toks[1:120] AS head FROM (SELECT conv_id, turn, role, {sql_tokens()} AS toks FROM conversations)))"
PAIRS = f"(SELECT *, (j3 + j5) / 2 AS proxy FROM (SELECT a.grp, a.id AS id_a, b.id AS id_b, a.role AS role_a, b.role AS role_b, {', '.join(f'{sql_jaccard(f"a.g{n}", f"b.g{n}")} AS j{n}' for n in D.SIZES)}, {sql_jaccard('a.opening', 'b.opening')} AS opening FROM {ITEMS} a JOIN {ITEMS} b ON a.grp = b.grp AND a.id < b.id))"


def item_sets(spark, sf):
    """The turns of a conversation are a group of items."""
    t = table(spark, sf, "conversations")
    return D.item_sets(t, "conv_id", "turn", "text"), t.select(F.col("conv_id").alias("grp"), F.col("turn").alias("id"), "role")


def diversity_pairs(spark, sf):
    sets, roles = item_sets(spark, sf)
    return D.ngram_pairs(sets.join(roles, ["grp", "id"]), ("role",))


@register(Q, f"SELECT grp, id_a, id_b, round(j1, 6) AS j1, round(j3, 6) AS j3, round(j5, 6) AS j5, round(opening, 6) AS opening, round(proxy, 6) AS self_bleu_proxy FROM {PAIRS}")
def ngram_diversity_pairs(spark, sf):
    return diversity_pairs(spark, sf).select("grp", "id_a", "id_b", *[F.round(c, 6).alias(c) for c in ("j1", "j3", "j5", "opening")], F.round("proxy", 6).alias("self_bleu_proxy"))


@register(Q, f"""SELECT i.grp, i.id, round(coalesce(m, 0.0), 6) AS mean_similarity, round(1 - coalesce(m, 0.0), 6) AS contribution FROM {ITEMS} i LEFT JOIN (
  SELECT grp, id, avg(proxy) AS m FROM (SELECT grp, id_a AS id, proxy FROM {PAIRS} UNION ALL SELECT grp, id_b, proxy FROM {PAIRS}) GROUP BY ALL) p ON p.grp = i.grp AND p.id = i.id""")
def diversity_summary(spark, sf):
    return D.diversity_summary(item_sets(spark, sf)[0], diversity_pairs(spark, sf))


@register(Q, f"SELECT grp, count(*) AS n_pairs, round(avg(CASE WHEN role_a IS NOT DISTINCT FROM role_b THEN 1 - j1 END), 6) AS within, round(avg(CASE WHEN role_a IS DISTINCT FROM role_b THEN 1 - j1 END), 6) AS across FROM {PAIRS} GROUP BY grp")
def group_distance(spark, sf):
    """Turns of the same role and of different ones."""
    return D.group_distance(diversity_pairs(spark, sf), "role")


GRAMS3 = grams("benchmark", "item_id", 3)


@register(Q, f"""SELECT item_id, round(1 - coalesce(max(c / (a.n + b.n - c)), 0.0), 6) AS novelty FROM benchmark LEFT JOIN (
  SELECT a.id, b.id AS prior, count(*) AS c FROM {GRAMS3} a JOIN {GRAMS3} b ON a.gram = b.gram AND b.id < a.id GROUP BY ALL) p ON p.id = item_id
  LEFT JOIN (SELECT id, count(*) AS n FROM {GRAMS3} GROUP BY id) a ON a.id = p.id LEFT JOIN (SELECT id, count(*) AS n FROM {GRAMS3} GROUP BY id) b ON b.id = p.prior GROUP BY item_id""")
def novelty_vs_prior(spark, sf):
    return D.novelty_vs_prior(table(spark, sf, "benchmark"), "item_id", "text").withColumnRenamed("id", "item_id")


@register(Q, f"""SELECT i.grp, items, unique_texts, round(coalesce(j, 0.0), 6) AS top, coalesce(j, 0.0) < 0.85 AS useful FROM (
  SELECT grp, count(*) AS items, count(DISTINCT array_to_string(toks, ' ')) AS unique_texts FROM {ITEMS} GROUP BY grp) i LEFT JOIN (SELECT grp, max(j4) AS j FROM {PAIRS} GROUP BY grp) p ON p.grp = i.grp""")
def max_group_similarity(spark, sf):
    return D.max_group_similarity(item_sets(spark, sf)[0], diversity_pairs(spark, sf))


@register(Q, """WITH c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
 v AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
 SELECT vec_id, round(CASE WHEN sum(v.x * v.x) = 0 OR sum(c.x * c.x) = 0 THEN 0 ELSE sum(CAST(v.x AS DOUBLE) * c.x) / (sqrt(sum(CAST(v.x AS DOUBLE) * v.x)) * sqrt(sum(c.x * c.x))) END, 4) AS cosine FROM v JOIN c USING (label, i) GROUP BY vec_id""")
def cosine_geometry(spark, sf):
    """Cosine of each vector with the mean of its label."""
    v = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    c = v.groupBy("label", "i").agg(F.avg("x").alias("m"))
    s = v.join(c, ["label", "i"]).groupBy("vec_id").agg(F.sum(F.col("x") * F.col("m")).alias("d"), F.sqrt(F.sum(F.col("x") ** 2)).alias("a"), F.sqrt(F.sum(F.col("m") ** 2)).alias("b"))
    return s.select("vec_id", F.round(F.when((F.col("a") == 0) | (F.col("b") == 0), 0.0).otherwise(F.col("d") / (F.col("a") * F.col("b"))), 4).alias("cosine"))
