"""Quotes of web pages with the names before them, voices, and families of cadence in documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusx.functions.text import sql_tokens
from corpusx.operators import voices as V
from corpusx.plans.tables import register, table

Q: dict = {}
TOKS = sql_tokens()

BEFORE, AFTER = r"([a-z]+)=$", r"^>([A-Z][a-z]+)"
QUOTED = """(SELECT page_id, CAST(i - 1 AS INTEGER) AS nth, CAST(stop - length(q) AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, q[2:-2] AS quoted,
    coalesce(nullif(regexp_extract(substr(html, CAST(greatest(stop - length(q) - 140, 0) + 1 AS BIGINT), CAST(least(140, stop - length(q)) AS BIGINT)), '([a-z]+)=$', 1), ''), nullif(regexp_extract(substr(html, CAST(stop + 1 AS BIGINT), 100), '^>([A-Z][a-z]+)', 1), '')) AS speaker FROM (
  SELECT page_id, html, i, q, sum(length(g) + length(q)) OVER (PARTITION BY page_id ORDER BY i) AS stop FROM (
    SELECT page_id, html, unnest(qs) AS q, unnest(gs[1:len(qs)]) AS g, unnest(range(1, len(qs) + 1)) AS i FROM (
      SELECT page_id, html, regexp_extract_all(html, '"[^"\\n]{2,}"') AS qs, string_split_regex(html, '"[^"\\n]{2,}"') AS gs FROM pages WHERE html IS NOT NULL))))"""


@register(Q, f"SELECT page_id AS id, nth, start, stop, quoted, speaker FROM {QUOTED}")
def extract_quotes(spark, sf):
    """Quoted values of web pages with offsets and the name of their attribute, else the capital word after them."""
    return V.attributed_quotes(table(spark, sf, "pages"), BEFORE, AFTER, "page_id", "html")


def alike(rows: str, group: str, voice: str, text: str) -> str:
    """SQL text of ``voice_similarity``."""
    counted = f"(SELECT grp, voice, tok, count(*) AS n FROM (SELECT {group} AS grp, {voice} AS voice, unnest({sql_tokens(text)}) AS tok FROM {rows} WHERE {voice} IS NOT NULL) GROUP BY ALL)"
    return f"""(WITH t AS {counted}, s AS (SELECT grp, voice, sqrt(sum(n * n)) AS norm, count(*) AS size FROM t GROUP BY ALL),
      p AS (SELECT a.grp, a.voice AS voice_a, b.voice AS voice_b, sum(a.n * b.n) AS dot, count(*) AS common FROM t a JOIN t b ON a.grp = b.grp AND a.tok = b.tok AND a.voice < b.voice GROUP BY ALL)
      SELECT p.grp, voice_a, voice_b, round(dot / (x.norm * y.norm), 6) AS cosine, round(common / (x.size + y.size - common), 6) AS vocabulary FROM p JOIN s x ON x.grp = p.grp AND x.voice = voice_a JOIN s y ON y.grp = p.grp AND y.voice = voice_b)"""


@register(Q, f"SELECT grp AS conv_id, voice_a AS role_a, voice_b AS role_b, cosine, vocabulary FROM {alike('conversations', 'conv_id', 'role', 'text')}")
def speaker_similarity(spark, sf):
    """How alike the roles of a conversation speak."""
    said = table(spark, sf, "conversations").select(F.col("conv_id").alias("grp"), F.col("role").alias("voice"), "text")
    return V.voice_similarity(said).toDF("conv_id", "role_a", "role_b", "cosine", "vocabulary")


@register(Q, f"SELECT grp AS page_id, voice_a, voice_b, cosine, vocabulary FROM {alike(QUOTED, 'page_id', 'speaker', 'quoted')}")
def quoted_voice_similarity(spark, sf):
    """How alike the attributed quotes of a page are, name by name."""
    q = V.attributed_quotes(table(spark, sf, "pages"), BEFORE, AFTER, "page_id", "html")
    return V.voice_similarity(q.select(F.col("id").alias("grp"), F.col("speaker").alias("voice"), F.col("quoted").alias("text"))).withColumnRenamed("grp", "page_id")


FAMILIES = {"list": [r"[a-z]+, [a-z]+, [a-z]+", r"[a-z]+, [a-z]+"], "short": [r"[.!?] [A-Z][a-z]{0,4}[.!?]", r"[A-Z][a-z]{0,6}[.!?]"], "open": [r"[A-Z][a-z]+ [a-z]+,"]}


def hits(family: str, nth: int) -> str:
    p = FAMILIES[family][nth]
    return f"""(SELECT doc_id, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM (SELECT doc_id, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS gs FROM documents WHERE text IS NOT NULL)))"""


def swept(family: str) -> str:
    first = f"SELECT doc_id, m, b FROM {hits(family, 0)}"
    if len(FAMILIES[family]) == 1:
        return f"({first})"
    return f"({first} UNION ALL SELECT doc_id, m, b FROM {hits(family, 1)} y WHERE NOT EXISTS (SELECT 1 FROM {hits(family, 0)} x WHERE x.doc_id = y.doc_id AND x.b - length(x.m) < y.b AND y.b - length(y.m) < x.b))"


@register(Q, " UNION ALL ".join(f"""SELECT d.doc_id AS id, '{f}' AS family, count(b) AS hits, round(1000.0 * count(b) / greatest(1, any_value(n)), 6) AS rate, coalesce(array_to_string(list(m ORDER BY b)[1:8], '|'), '') AS evidence
  FROM (SELECT doc_id, len({TOKS}) AS n FROM documents) d LEFT JOIN (SELECT * FROM {swept(f)} WHERE b IS NOT NULL) h ON h.doc_id = d.doc_id GROUP BY d.doc_id""" for f in FAMILIES))
def cadence_families(spark, sf):
    """Families of two patterns and of one; hits that overlap within a family count once."""
    return V.cadence_families(table(spark, sf, "documents"), FAMILIES).withColumn("evidence", F.array_join("evidence", "|"))
