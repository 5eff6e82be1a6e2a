"""Conversations as calls, artifacts and stored items; web pages as decks of cards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusx.operators import authorship as A
from corpusx.operators.mining import digest
from corpusx.plans.tables import register, table

Q: dict = {}

NAME = "conv_id || '.' || turn"
RULE = "CASE turn % 4 WHEN 0 THEN 'whole' WHEN 1 THEN 'first_line' WHEN 2 THEN 'stripped' ELSE 'unheard of' END"
STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"


@register(Q, f"""WITH calls AS (SELECT {NAME} AS call, CASE WHEN conv_id % 9 = 2 AND turn = 0 THEN 'started' ELSE 'completed' END AS status, CASE WHEN conv_id % 13 = 5 THEN NULL ELSE role END AS model, sha256(coalesce(role, '')) AS prompt_hash, turn AS seed, coalesce(text, '') AS response FROM conversations
    UNION ALL SELECT {NAME}, 'completed', role, sha256('again'), turn, coalesce(text, '') FROM conversations WHERE conv_id % 7 = 3 AND turn = 1),
  c AS (SELECT call, count(*) AS n, min(CASE WHEN model IS NULL THEN 0 ELSE 1 END) AS named, any_value(response) AS response, any_value(sha256(call || '|' || coalesce(model, '') || '|' || prompt_hash || '|' || seed || '|' || sha256(response))) AS call_hash FROM calls WHERE status = 'completed' GROUP BY call),
  a AS (SELECT {NAME} AS artifact, conv_id, turn, {RULE} AS rule, CASE WHEN conv_id % 2 = 0 THEN 'model_generation' ELSE 'transcription' END AS kind, CASE WHEN turn < 3 THEN 'research' ELSE 'record' END AS scope,
    CASE WHEN turn = 0 THEN '' WHEN conv_id % 11 = 6 THEN conv_id || '.' || (turn - 1) || ',nobody' ELSE conv_id || '.' || (turn - 1) END AS parents, (turn = 0 OR conv_id % 11 <> 6) AS whole,
    CASE turn % 4 WHEN 1 THEN split_part(coalesce(text, ''), chr(10), 1) WHEN 2 THEN {STRIP.format("coalesce(text, '')")} ELSE coalesce(text, '') END || CASE WHEN conv_id % 5 = 4 THEN '!' ELSE '' END AS text FROM conversations),
  j AS (SELECT a.*, sha256(text) AS text_hash, call_hash, CASE WHEN c.call IS NULL THEN 'unbound' WHEN n > 1 THEN 'ambiguous' WHEN named = 0 THEN 'no identity' WHEN rule = 'unheard of' THEN 'unknown rule'
      WHEN text <> CASE turn % 4 WHEN 1 THEN split_part(response, chr(10), 1) WHEN 2 THEN {STRIP.format("response")} ELSE response END THEN 'other text' WHEN NOT whole THEN 'missing parent' END AS error FROM a LEFT JOIN c ON c.call = a.artifact)
  SELECT artifact, error, text_hash, CASE WHEN error IS NULL THEN sha256(artifact || '|' || kind || '|' || scope || '|' || text_hash || '|' || call_hash || '|' || parents) END AS record_hash, error IS NULL AND kind = 'model_generation' AND scope = 'research' AS eligible FROM j""")
def build_authorship(spark, sf):
    """Turns as artifacts of calls of the same name; some calls never ended, ended twice or name no model, some texts and parents are wrong."""
    c = table(spark, sf, "conversations").withColumn("name", F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    said = F.coalesce("text", F.lit(""))
    call = lambda rows, status, model, prompt: rows.select(F.col("name").alias("call"), status.alias("status"), model.alias("model"), digest(prompt).alias("prompt_hash"), F.col("turn").alias("seed"), F.col("text").alias("response"))
    calls = call(c, F.when((F.col("conv_id") % 9 == 2) & (F.col("turn") == 0), "started").otherwise("completed"), F.when(F.col("conv_id") % 13 != 5, F.col("role")), F.coalesce("role", F.lit("")))
    calls = calls.unionByName(call(c.where("conv_id % 7 = 3 and turn = 1"), F.lit("completed"), F.col("role"), F.lit("again")))
    turn = F.col("turn") % 4
    rule = F.when(turn == 0, "whole").when(turn == 1, "first_line").when(turn == 2, "stripped").otherwise("unheard of")
    text = F.when(turn == 1, A.RULES["first_line"](said)).when(turn == 2, A.RULES["stripped"](said)).otherwise(said)
    before = F.concat_ws(".", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    parents = F.when(F.col("turn") == 0, F.array().cast("array<string>")).when(F.col("conv_id") % 11 == 6, F.array(before, F.lit("nobody"))).otherwise(F.array(before))
    artifacts = c.select(
        F.col("name").alias("artifact"), F.col("name").alias("call"), F.concat(text, F.when(F.col("conv_id") % 5 == 4, "!").otherwise("")).alias("text"), F.when(F.col("conv_id") % 2 == 0, "model_generation").otherwise("transcription").alias("kind"),
        F.when(F.col("turn") < 3, "research").otherwise("record").alias("scope"), parents.alias("parents"), rule.alias("rule"),
    )
    return A.build_authorship(artifacts, calls).select("artifact", "error", "text_hash", "record_hash", "eligible")


@register(Q, """WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS segment, string_agg(coalesce(text, ''), chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn) AS whole FROM conversations WHERE NOT (conv_id % 17 = 4 AND turn = 0)),
  s AS (SELECT *, whole || CASE WHEN conv_id % 10 = 3 AND turn = 1 THEN ' more' ELSE '' END AS text FROM t),
  e AS (SELECT *, CASE WHEN conv_id % 6 = 1 AND turn = 2 THEN 'text hash' WHEN conv_id % 17 = 4 AND turn = 1 THEN 'missing parent' WHEN conv_id % 10 = 3 AND turn = 1 THEN 'lineage' WHEN conv_id % 10 = 3 AND turn = 2 THEN 'lineage'
      WHEN segment LIKE '%;%' OR NOT regexp_matches(segment, '[a-z]') THEN 'gate' END AS error FROM s)
  SELECT conv_id || '.' || turn AS item, turn AS generation, coalesce(error, CASE WHEN count(error) OVER (PARTITION BY conv_id ORDER BY turn) > 0 THEN 'parent rejected' END) AS error, sha256(text) AS text_hash, 'next' AS campaign FROM e""")
def replay_import(spark, sf):
    """Every turn with all turns before it as an item whose parent is the turn before; some hashes, texts and parents are wrong."""
    c = table(spark, sf, "conversations").where("not (conv_id % 17 = 4 and turn = 0)").withColumn("segment", F.coalesce("text", F.lit("")))
    so_far = F.array_join(F.collect_list("segment").over(Window.partitionBy("conv_id").orderBy("turn")), "\n\n")
    text = F.concat(so_far, F.when((F.col("conv_id") % 10 == 3) & (F.col("turn") == 1), " more").otherwise(""))
    c = c.withColumn("whole", text)
    name = lambda turn: F.concat_ws(".", F.col("conv_id").cast("string"), turn.cast("string"))
    parents = F.when(F.col("turn") > 0, F.array(name(F.col("turn") - 1)))
    items = c.select(name(F.col("turn")).alias("item"), F.col("turn").alias("generation"), parents.alias("parents"), "segment", F.col("whole").alias("text"),
                     F.when((F.col("conv_id") % 6 == 1) & (F.col("turn") == 2), digest(F.lit("x"))).otherwise(digest(F.col("whole"))).alias("text_hash"))
    return A.replay_import(items, "next", [("[a-z]", True), (";", False)])


@register(Q, """WITH b AS (SELECT page_id, unnest(bs) AS block, unnest(range(1, len(bs) + 1)) AS i FROM (SELECT page_id, list_filter(list_transform(regexp_split_to_array(coalesce(html, ''), '[<>]'), lambda x: trim(x)), lambda x: x <> '') AS bs FROM pages)),
  n AS (SELECT *, lead(block) OVER (PARTITION BY page_id ORDER BY i) AS value, sum(CASE WHEN regexp_full_match(block, 'head|nav|article|ul|h[1-6]') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS card FROM b),
  v AS (SELECT *, lead(card) OVER (PARTITION BY page_id ORDER BY i) AS next_card FROM n WHERE card > 0),
  c AS (SELECT page_id AS id, CAST(card - 1 AS INTEGER) AS nth, arg_min(block, i) AS heading, arg_max(value, i) FILTER (block = 'title' AND next_card = card) AS title, arg_max(value, i) FILTER (block = 'p' AND next_card = card) AS p,
      arg_max(value, i) FILTER (block = 'li' AND next_card = card) AS li, arg_max(value, i) FILTER (block = 'b' AND next_card = card) AS b FROM v GROUP BY page_id, card)
  SELECT *, coalesce(title, p) AS mechanism, CASE WHEN title IS NULL AND p IS NULL THEN 'no title or p' END AS error FROM c""")
def extract_cards(spark, sf):
    """Pages cut at their tags: sections from one heading tag to the next, with what stands after title, p, li and b."""
    return A.extract_cards(table(spark, sf, "pages"), "head|nav|article|ul|h[1-6]", ["title", "p", "li", "b"], ["title", "p"], "[<>]", "page_id", "html")
