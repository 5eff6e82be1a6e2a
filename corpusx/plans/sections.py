"""Queries on chapters, excerpts, quotes and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusx.functions.lexicons import LEXICON
from corpusx.functions.text import sql_tokens
from corpusx.operators import sections as S
from corpusx.plans.tables import register, table

Q: dict = {}
HEADING = r"[^\n]{1,60}"


@register(Q, f"""WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
  c AS (SELECT *, sum(CASE WHEN length(line) BETWEEN 1 AND 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS ch FROM l),
  b AS (SELECT doc_id, ch, string_agg(line, chr(10) ORDER BY i) AS block FROM c WHERE ch > 0 GROUP BY ALL),
  k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ch) - 1 AS idx, len({sql_tokens('block')}) AS words, md5(block) AS digest FROM b WHERE len({sql_tokens('block')}) >= 100)
  SELECT doc_id, CAST(idx AS INTEGER) AS idx, words, digest FROM k UNION ALL
  SELECT doc_id, 0, len({sql_tokens()}), md5(coalesce(text, '')) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = d.doc_id)""")
def split_chapters(spark, sf):
    """Short lines are the headings; chapters of 100 words or more."""
    c = S.split_chapters(table(spark, sf, "documents"), "doc_id", "text", HEADING, 100)
    return c.select(F.col("id").alias("doc_id"), "idx", F.col("words").cast("long").alias("words"), F.md5("text").alias("digest"))


TERMS, ENDS = ("the", "and", "der", "que", "une", "les"), ("turn", "leave", "that", "on", "en")
LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@register(Q, f"""WITH p AS (SELECT doc_id, list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(trim(x)) > 0), lambda x: {sql_tokens('x').replace("lambda x:", "lambda y:").replace("lower(x)", "lower(y)")}) AS ps FROM documents),
  s AS (SELECT doc_id, ps, unnest(range(len(ps))) AS first FROM p), r AS (SELECT doc_id, ps, first, unnest(range(first, len(ps))) AS last FROM s),
  w AS (SELECT doc_id, first, last, flatten(ps[first + 1:last + 1]) AS said, ps[last + 1] AS tail FROM r),
  g AS (SELECT *, len(said) AS words FROM w WHERE len(said) BETWEEN 60 AND 200),
  f AS (SELECT doc_id, first, last, words, round(0.60 * len(list_intersect({LIST(TERMS)}, said)) / {len(TERMS)} + 0.25 * len(list_intersect({LIST(ENDS)}, tail)) / {len(ENDS)} + 0.15 * (1 - abs(words - 130) / 200), 6) AS score FROM g)
  SELECT doc_id, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, CAST(words AS INTEGER) AS words, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first, last) AS n FROM f) WHERE n = 1""")
def best_excerpt(spark, sf):
    return S.best_excerpt(table(spark, sf, "documents"), "doc_id", "text", TERMS, ENDS, 60, 200).withColumnRenamed("id", "doc_id")


#: A cue between characters of no word, spelt out: ``\b`` knows other letters in Java (by version) than in RE2, which ends a word before "ü".
CUE = r"(?:^|[^\p{L}\p{N}_])(?:which meant|meaning|in other words|the point was|understood|realized|en|the|la)(?:[^\p{L}\p{N}_]|$)"


def content(x: str) -> str:
    """SQL text: distinct words of four characters or more, less two stop words."""
    return "list_distinct(list_filter(" + sql_tokens(x).replace("lambda x:", "lambda y:").replace("lower(x)", "lower(y)") + ", lambda w: length(w) >= 4 AND w NOT IN ('that', 'with')))"


@register(Q, f"""SELECT doc_id AS id, n_quotes, n_glossed, CASE WHEN n_quotes > 0 THEN round(100 * n_glossed / n_quotes, 4) ELSE 0.0 END AS per_100, CAST(coalesce(n_shared, 0) AS BIGINT) AS n_shared FROM (
  SELECT doc_id, len(after) AS n_quotes, len(g) AS n_glossed, list_sum(list_transform(g, lambda p: len(list_intersect({content('p[1]')}, {content('p[2]')})))) AS n_shared FROM (
    SELECT doc_id, after, list_filter(list_transform(range(1, len(after) + 1), lambda i: [said[i], substr(after[i], 1, 320)]), lambda p: regexp_matches(p[2], '(?i){CUE}')) AS g FROM (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '["“]([^"”]*)["”]', 1) AS said, string_split_regex(coalesce(text, ''), '["“]([^"”]*)["”]')[2:] AS after FROM documents)))""")
def gloss_after_quote(spark, sf):
    return S.gloss_after_quote(table(spark, sf, "documents"), "doc_id", "text", f"(?iu){CUE}", stop=("that", "with"))


def sql_features(docs: str = "documents") -> str:
    """(doc_id, words, features): the same features in DuckDB's dialect."""
    esc = lambda p: p.replace("'", "''")
    dense = [(n, p) for k, n, p in LEXICON if k == "density"]
    senses = [p for k, _, p in LEXICON if k == "sense"]
    count = lambda x: f"len({sql_tokens(x)})"
    inner = lambda x: sql_tokens(x).replace("lambda x:", "lambda y:").replace("lower(x)", "lower(y)")
    return f"""(SELECT doc_id, words, round(least(quoted / greatest(words, 1), 1.0), 6) AS dialogue_ratio, {', '.join(f'round(n_{n} / greatest(words, 1), 6) AS {n}' for n, _ in dense)}, channels,
      round(CASE WHEN len(sizes) = 0 THEN 0 ELSE list_avg(sizes) END, 6) AS sentence_mean, round(CASE WHEN len(sizes) = 0 THEN 0 ELSE sqrt(greatest(list_avg(list_transform(sizes, lambda v: v * v)) - list_avg(sizes) * list_avg(sizes), 0)) END, 6) AS sentence_deviation FROM (
      SELECT doc_id, {count("coalesce(text, '')")} AS words, coalesce(list_sum(list_transform(regexp_extract_all(coalesce(text, ''), '["“]([^"”]*)["”]', 1), lambda x: len({inner('x')}))), 0) AS quoted,
        list_filter(list_transform(string_split_regex(coalesce(text, ''), '{esc(S.SENTENCE_END)}'), lambda x: len({inner('x')})), lambda v: v > 0) AS sizes,
        {', '.join(f"len(regexp_extract_all(coalesce(text, ''), '{esc(p)}')) AS n_{n}" for n, p in dense)}, CAST({' + '.join(f"CAST(regexp_matches(coalesce(text, ''), '{esc(p)}') AS INT)" for p in senses)} AS INT) AS channels FROM {docs}))"""


@register(Q, f"SELECT doc_id, CAST(words AS BIGINT) AS words, dialogue_ratio, agency, conflict, interiority, channels, sentence_mean, sentence_deviation FROM {sql_features()}")
def scene_features(spark, sf):
    f = S.scene_features(table(spark, sf, "documents"), "doc_id", "text", LEXICON).withColumnRenamed("id", "doc_id")
    return f.select("doc_id", F.col("words").cast("long").alias("words"), "dialogue_ratio", "agency", "conflict", "interiority", "channels", "sentence_mean", "sentence_deviation")


LINES = "(SELECT doc_id, source, i, l[i] AS line FROM (SELECT doc_id, source, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)) WHERE regexp_matches(l[i], '^[A-Za-z]'))"


@register(Q, f"""SELECT doc_id AS id, CAST(i AS INTEGER) AS number, coalesce(source, 'Unknown') AS work, CASE WHEN source LIKE '%web%' THEN 'holdout' ELSE 'profiling' END AS part, md5(regexp_replace(rtrim(line, ' '), '^ +', '')) AS digest,
  CAST(4 - count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS n_missing FROM {LINES} WHERE i <= 4""")
def numbered_sections(spark, sf):
    """Lines of a document that begin with a letter as numbered examples that quote them, by source as the attributed work."""
    d = table(spark, sf, "documents")
    made = F.transform(F.split("text", "\n"), lambda x, i: F.when(x.rlike("^[A-Za-z]"), F.concat(F.lit("**Example "), (i + 1).cast("string"), F.lit(": quoted**\n> "), x, F.lit("\n"), F.coalesce(F.concat(F.lit("Excerpt from *"), "source", F.lit("*\n")), F.lit("")))).otherwise(""))
    t = d.select("doc_id", F.array_join(made, "").alias("text"))
    got = S.numbered_sections(t, "doc_id", "text", r"\*\*Example (\d+): ([^*\n]*)\*\*", r"Excerpt from \*([^*]+)\*", (("web", "holdout"),), (1, 2, 3, 4))
    return got.select("id", "number", "work", "part", F.md5("text").alias("digest"), F.size("missing").alias("n_missing"))


@register(Q, f"""SELECT concat_ws('.', doc_id, 7, n) AS id, CAST(n AS INTEGER) AS number, md5(rtrim(line, ' ')) AS premise, md5(rtrim('so ' || line, ' ')) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM {LINES}) WHERE i % 3 <> 0""")
def split_proposals(spark, sf):
    """The lines of a document as the premises of proposals; every third has no turn and is dropped."""
    d = table(spark, sf, "documents")
    made = F.transform(F.split("text", "\n"), lambda x, i: F.when(x.rlike("^[A-Za-z]"), F.concat(F.lit("Proposal\nPremise: "), x, F.when((i + 1) % 3 == 0, "\n").otherwise(F.concat(F.lit("\nTurn: so "), x, F.lit("\n"))))).otherwise(""))
    t = d.select("doc_id", F.lit(7).alias("seed"), F.array_join(made, "").alias("text"))
    got = S.split_proposals(t, ("doc_id", "seed"), "text", "Proposal\\n", ("Premise", "Turn"), ("Premise", "Turn"))
    return got.select("id", "number", F.md5(F.col("fields")["Premise"]).alias("premise"), F.md5(F.col("fields")["Turn"]).alias("turn"))
