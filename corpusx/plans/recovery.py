"""Queries that mine spans from texts and derive failed ones again."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusx.functions.spans import complete_prefix, spans_of
from corpusx.functions.text import WORD, sql_ngrams, sql_tokens
from corpusx.operators import mining as M
from corpusx.plans.tables import register, table

Q: dict = {}


def n_words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '" + WORD.replace("'", "''") + "'))"


BEFORE = "OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
#: Sentences with offsets, running words and number of their line; fresh ones begin a line.
UNITS = f"""(SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS run, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS line FROM (
  SELECT *, CASE WHEN coalesce(max(CASE WHEN right(u, 1) = chr(10) THEN i END) {BEFORE}, 0) >= coalesce(max(CASE WHEN held THEN i END) {BEFORE}, 0) THEN 1 ELSE 0 END AS fresh FROM (
    SELECT doc_id, text, i, u, {n_words('u')} AS n, trim(u, ' ' || chr(10)) <> '' AS held, sum(length(u)) OVER (PARTITION BY doc_id ORDER BY i) - length(u) AS a,
           sum(length(u)) OVER (PARTITION BY doc_id ORDER BY i) - CASE WHEN right(u, 1) IN (' ', chr(10)) THEN 1 ELSE 0 END AS b FROM (
      SELECT doc_id, text, unnest(us) AS u, unnest(range(1, len(us) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, '[^\\n]*?(?:[.!?]["”’]?(?:[ \\n]|$)|\\n|$)') AS us FROM documents WHERE text IS NOT NULL)) WHERE u <> '')) WHERE held)"""
SPANS = f"""(SELECT doc_id AS id, start, stop, words, substr(text, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)) AS text FROM (
  SELECT s.doc_id, s.text, s.a AS start, e.b AS stop, e.run - s.run + s.n AS words FROM {UNITS} s JOIN {UNITS} e ON e.doc_id = s.doc_id AND e.i >= s.i AND e.line < s.line + 3 WHERE s.fresh = 1) WHERE words BETWEEN 12 AND 90)"""
RULES = [("[,;]", True), ("[0-9#$%&*]", False)]


@register(Q, f"""WITH g AS (SELECT DISTINCT unnest({sql_ngrams('toks', 8)}) AS gram FROM (SELECT {sql_tokens()} AS toks FROM benchmark)),
  p AS (SELECT *, sha256(text) AS hash FROM {SPANS} WHERE regexp_matches(text, '[,;]') AND NOT regexp_matches(text, '[0-9#$%&*]')),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY id, start) AS nth FROM p) WHERE nth = 1 AND hash NOT IN (SELECT sha256(text) FROM conversations WHERE text IS NOT NULL)),
  t AS (SELECT DISTINCT hash FROM (SELECT hash, unnest({sql_ngrams('toks', 8)}) AS gram FROM (SELECT hash, {sql_tokens()} AS toks FROM f)) JOIN g USING (gram))
  SELECT id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, CAST(words AS INTEGER) AS words, hash FROM f WHERE hash NOT IN (SELECT hash FROM t)""")
def mine_spans(spark, sf):
    """Spans of 12 to 90 words over up to three lines, with a comma or semicolon and no digits or marks, new and free of 8 words of a benchmark passage."""
    known = table(spark, sf, "conversations").where("text is not null").select(M.digest(F.col("text")).alias("hash"))
    return M.new_spans(table(spark, sf, "documents"), table(spark, sf, "benchmark"), known, RULES, n=8)


def prefix(source: str, least: int, most: int) -> str:
    """SQL text: (doc_id, stop, words), the longest prefix of whole lines that ends a sentence, closes its quotation marks and is followed by an opening."""
    body = "ltrim(text, ' ' || chr(10))"
    return f"""(SELECT doc_id, max(stop) AS stop, max(run) AS words FROM (
  SELECT doc_id, lead_in + b AS stop, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS run, substr(body, 1, CAST(b AS BIGINT)) AS whole, substr(body, CAST(b + 1 AS BIGINT)) AS rest FROM (
    SELECT doc_id, body, lead_in, i, {n_words('l')} AS n, sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS b FROM (
      SELECT doc_id, body, lead_in, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, length(text) - length({body}) AS lead_in, {body} AS body, string_split({body}, chr(10)) AS ls FROM {source}))))
  WHERE run BETWEEN {least} AND {most} AND regexp_matches(whole, '[.!?]["”’'']?\\s*$') AND (rest = '' OR regexp_matches(rest, '^\\n[^\\S\\n]*\\n') OR regexp_matches(ltrim(rest, ' ' || chr(10)), '^["“‘''A-Z]'))
    AND (length(whole) - length(replace(whole, '"', ''))) % 2 = 0 AND length(replace(whole, '“', '')) = length(replace(whole, '”', '')) GROUP BY doc_id)"""


@register(Q, f"SELECT doc_id, CAST(stop AS INTEGER) AS prefix_end, CAST(words AS INTEGER) AS words FROM {prefix('documents', 50, 400)}")
def prefix_in_band(spark, sf):
    """Longest prefix of whole paragraphs with 50 to 400 words that ends a sentence and closes its quotation marks."""
    found = spans_of(table(spark, sf, "documents"), "doc_id", "text", "start int, stop int, words int", lambda t: [p for p in [complete_prefix(t, 50, 400)] if p])
    return found.select(F.col("id").alias("doc_id"), F.col("stop").alias("prefix_end"), "words")


LOG = """(SELECT doc_id, 1 AS version_no, CASE WHEN doc_id % 3 = 0 THEN 'kept' END AS segment, CASE WHEN doc_id % 7 = 0 THEN 'aborted' ELSE 'stop' END AS finish,
  CASE WHEN doc_id % 11 = 0 THEN sha256('other') ELSE sha256(coalesce(text, '')) END AS raw_hash, sha256('p' || doc_id) AS text_hash FROM documents
  UNION ALL SELECT doc_id, 2, 'done', 'stop', sha256(coalesce(text, '')), sha256('q') FROM documents WHERE doc_id % 5 = 0)"""


@register(Q, f"""WITH s AS (SELECT doc_id, arg_max(coalesce(segment, ''), version_no) AS segment, arg_max(finish, version_no) AS finish, arg_max(raw_hash, version_no) AS raw_hash, arg_max(text_hash, version_no) AS text_hash FROM {LOG} GROUP BY doc_id),
  j AS (SELECT s.doc_id, r.text, text_hash, CASE WHEN r.doc_id IS NULL THEN 'raw text is gone' WHEN sha256(coalesce(r.text, '')) <> raw_hash THEN 'raw hash changed' END AS error FROM s LEFT JOIN (SELECT * FROM documents WHERE doc_id % 13 <> 0) r USING (doc_id) WHERE segment = '' AND finish <> 'aborted'),
  ok AS (SELECT doc_id, coalesce(text, '') AS text, text_hash FROM j WHERE error IS NULL)
  SELECT doc_id AS id, CAST(NULL AS VARCHAR) AS error, CAST(length(text) - length(ltrim(text, ' ' || chr(10))) AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, CAST(words AS INTEGER) AS words, sha256(seg) AS segment_hash, regexp_matches(seg, ',') AS eligible, 'v2' AS extraction_version, text_hash AS from_hash
  FROM (SELECT *, substr(text, 1 + length(text) - length(ltrim(text, ' ' || chr(10))), CAST(stop AS BIGINT) - (length(text) - length(ltrim(text, ' ' || chr(10))))) AS seg FROM ok JOIN {prefix('ok', 50, 400)} USING (doc_id))
  UNION ALL SELECT doc_id, error, NULL, NULL, NULL, NULL, NULL, 'v2', text_hash FROM j WHERE error IS NOT NULL""")
def reextract_failed(spark, sf):
    """Documents as raw texts of a log in which two thirds have no segment: some were aborted, some were repaired since, some raw texts are gone or changed."""
    d = table(spark, sf, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    sha = lambda c: M.digest(c)
    first = d.select("doc_id", F.lit(1).alias("version_no"), F.when(F.col("doc_id") % 3 == 0, "kept").alias("segment"), F.when(F.col("doc_id") % 7 == 0, "aborted").otherwise("stop").alias("finish"),
                     F.when(F.col("doc_id") % 11 == 0, sha(F.lit("other"))).otherwise(sha(F.col("t"))).alias("raw_hash"), sha(F.concat(F.lit("p"), F.col("doc_id").cast("string"))).alias("text_hash"))
    then = d.where("doc_id % 5 = 0").select("doc_id", F.lit(2).alias("version_no"), F.lit("done").alias("segment"), F.lit("stop").alias("finish"), sha(F.col("t")).alias("raw_hash"), sha(F.lit("q")).alias("text_hash"))
    log = first.unionByName(then).withColumnRenamed("doc_id", "id")
    raws = d.where("doc_id % 13 <> 0").select(F.col("doc_id").alias("id"), F.col("text").alias("raw"))
    return M.reextract_failed(log, raws, "v2", 50, 400, [(",", True)]).drop("segment")
