"""Scans, text shaping, gates and style diagnostics over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusx.functions import text as X
from corpusx.functions.text import sql_ngrams, sql_tokens, tokenize
from corpusx.operators import shape as S
from corpusx.operators import style as Y
from corpusx.plans.tables import register, table
from corpusx.scratch import Scratch

Q: dict = {}
TOKS = sql_tokens()

# ---------------------------------------------------------------- records


@register(Q, "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'purchase') WHERE n = 1")
def latest_record(spark, sf):
    return S.latest(table(spark, sf, "events"), "user_id", "event_type", "purchase", ["ts", "event_id"], True).select("user_id", "event_id", "value")


@register(Q, "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type = 'purchase'")
def latest_record_if_completed(spark, sf):
    return S.latest(table(spark, sf, "events"), "user_id", "event_type", "purchase", ["ts", "event_id"], False).select("user_id", "event_id", "value")


@register(Q, """SELECT user_id, max(CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END) = 0 AS unfinished,
  arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type IN ('purchase', 'error')) AS terminal FROM events GROUP BY user_id""")
def terminal_record(spark, sf):
    ends = F.col("event_type").isin("purchase", "error")
    return table(spark, sf, "events").groupBy("user_id").agg(
        (F.max(ends.cast("int")) == 0).alias("unfinished"), F.max_by(F.when(ends, F.col("event_type")), F.when(ends, F.struct("ts", "event_id"))).alias("terminal"))


@register(Q, """SELECT o_custkey AS id, count(*) AS n, CASE WHEN c_custkey IS NOT NULL THEN 'present' WHEN count(*) > 1 THEN 'repeated' ELSE 'new' END AS verdict
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey, c_custkey""")
def append_unique(spark, sf):
    """Verdict on appending a batch (orders' customers) to a table (customer) by id."""
    batch = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    have = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    v = F.when(F.col("k").isNotNull(), "present").when(F.col("n") > 1, "repeated").otherwise("new")
    return batch.join(have, F.col("id") == F.col("k"), "left").select("id", "n", v.alias("verdict"))


def digest_sum(digest):
    """Sums of four runs of 15 hex digits of a SHA-256, joined and hashed: any order gives the same, and
    partial sums combine before the shuffle, so no group is held in one row."""
    part = lambda i: F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return F.sha2(F.concat_ws(":", *[part(i) for i in range(4)]), 256)


def sql_digest_sum(digest: str) -> str:
    return "sha256(concat_ws(':', " + ", ".join(f"CAST(sum(CAST('0x' || substr({digest}, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4)) + "))"


ENTRY = "sha256(concat_ws('=', CAST(doc_id AS VARCHAR), sha256(coalesce(text, ''))))"


@register(Q, f"SELECT source, {sql_digest_sum(ENTRY)} AS fingerprint, count(*) AS n FROM documents GROUP BY source")
def fingerprint_set(spark, sf):
    """One order-independent hash per source over (id, text hash)."""
    entry = F.sha2(F.concat_ws("=", F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256)), 256)
    d = table(spark, sf, "documents").select("source", entry.alias("h"))
    return d.groupBy("source").agg(digest_sum("h").alias("fingerprint"), F.count("*").alias("n"))


@register(Q, "SELECT p_partkey, sha256(concat_ws('|', 'p_brand=' || p_brand, 'p_name=' || p_name, 'p_size=' || CAST(p_size AS VARCHAR))) AS record_hash FROM part")
def record_hash(spark, sf):
    names = ("p_brand", "p_name", "p_size")
    return table(spark, sf, "part").select("p_partkey", F.sha2(F.concat_ws("|", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in names]), 256).alias("record_hash"))


@register(Q, f"SELECT source, lang, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes, {sql_digest_sum('sha256(text)')} AS manifest_hash FROM documents GROUP BY ALL")
def compile_artifact_manifest(spark, sf):
    d = table(spark, sf, "documents").select("source", "lang", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("h"))
    return d.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), digest_sum("h").alias("manifest_hash"))


# ---------------------------------------------------------------- text shaping


@register(Q, f"SELECT doc_id, len(t) AS n_words, sha256(array_to_string(t, ' ')) AS words_hash FROM (SELECT doc_id, {TOKS} AS t FROM documents)")
def tokenize_words(spark, sf):
    t = tokenize(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_words"), F.sha2(F.array_join("t", " "), 256).alias("words_hash"))


@register(Q, f"SELECT doc_id, n AS n_words, CAST(greatest(1, ceil(n * CAST(1.36 AS DOUBLE))) AS BIGINT) AS n_tokens FROM (SELECT doc_id, len({TOKS}) AS n FROM documents)")
def word_count_and_token_estimate(spark, sf):
    n = F.size(tokenize(F.col("text"))).cast("long")
    return table(spark, sf, "documents").select("doc_id", n.alias("n_words"), X.token_estimate(n).alias("n_tokens"))


@register(Q, f"SELECT gram, count(*) AS n, count(DISTINCT id) AS docs FROM (SELECT item_id AS id, unnest({sql_ngrams('toks', 3)}) AS gram FROM (SELECT item_id, {TOKS} AS toks FROM benchmark) WHERE len(toks) >= 3) GROUP BY gram")
def ngrams(spark, sf):
    g = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.explode(X.ngrams(tokenize(F.col("text")), 3)).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("n"), F.countDistinct("id").alias("docs"))


@register(Q, """SELECT page_id, trim(CASE WHEN strpos(b, '</body>') > 0 THEN substr(b, 1, strpos(b, '</body>') - 1) ELSE b END, ' ') AS body FROM (
  SELECT page_id, CASE WHEN strpos(html, '<body>') > 0 THEN substr(html, strpos(html, '<body>') + 6) ELSE html END AS b FROM pages)""")
def strip_boilerplate(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.strip_between(F.col("html"), "<body>", "</body>").alias("body"))


@register(Q, "SELECT page_id, unnest(range(0, len(m))) AS pos, unnest(m) AS block FROM (SELECT page_id, regexp_extract_all(html, '<p>([^<]+)</p>', 1) AS m FROM pages)")
def extract_marked_blocks(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<p>([^<]+)</p>"), F.lit(1))).alias("pos", "block")).withColumn("pos", F.col("pos").cast("long"))


@register(Q, "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\n\\t\\r]+', ' ', 'g'), ' ') AS plain FROM pages")
def clean_markup(spark, sf):
    t = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[ \\n\\t\\r]+", " ")
    return table(spark, sf, "pages").select("page_id", F.trim(t).alias("plain"))


PARAS = """(SELECT doc_id, idx, para, start, start + length(para) AS stop FROM (
  SELECT *, coalesce(sum(length(para) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (
    SELECT doc_id, unnest(range(0, len(p))) AS idx, unnest(p) AS para FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents))) WHERE trim(para, ' ') <> '')"""


@register(Q, f"SELECT doc_id, idx, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, sha256(para) AS hash FROM {PARAS}")
def paragraph_spans(spark, sf):
    p = S.paragraphs(table(spark, sf, "documents"))
    return p.select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"), F.sha2("para", 256).alias("hash"))


@register(Q, f"SELECT doc_id, count(*) AS kept, CAST(max(run) AS BIGINT) AS words FROM (SELECT doc_id, sum(n) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM (SELECT doc_id, idx, len({sql_tokens('para')}) AS n FROM {PARAS})) WHERE run <= 300 GROUP BY doc_id")
def truncate_paragraphs(spark, sf):
    return S.take_paragraphs(table(spark, sf, "documents"), 300).withColumn("words", F.col("words").cast("long"))


WINDOWS = f"""SELECT doc_id, s AS start, len(t[s + 1:s + 200]) AS n FROM (SELECT doc_id, t, unnest(range(0, greatest(0, CAST(ceil((len(t) - 200) / 100) AS BIGINT) * 100) + 1, 100)) AS s FROM (
  SELECT doc_id, {TOKS} AS t FROM documents)) WHERE len(t[s + 1:s + 200]) >= 8"""


@register(Q, WINDOWS)
def sliding_windows(spark, sf):
    w = table(spark, sf, "documents").select("doc_id", tokenize(F.col("text")).alias("toks")).select("doc_id", F.explode(X.windows(F.col("toks"), 200, 100, 8)).alias("w"))
    return w.select("doc_id", F.col("w.start").cast("long").alias("start"), F.size("w.toks").cast("long").alias("n"))


@register(Q, f"SELECT doc_id, s // 2500 AS idx, len(t[s + 1:s + 2500]) AS words, sha256(array_to_string(t[s + 1:s + 2500], ' ')) AS hash FROM (SELECT doc_id, t, unnest(range(0, len(t), 2500)) AS s FROM (SELECT doc_id, {TOKS} AS t FROM documents))")
def segment_or_window(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", tokenize(F.col("text")).alias("t")).where(F.size("t") > 0)
    s = t.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("t") - 1, F.lit(2500)), lambda i: F.struct(i.alias("s"), F.slice("t", i + 1, 2500).alias("w")))).alias("x"))
    return s.select("doc_id", F.floor(F.col("x.s") / 2500).alias("idx"), F.size("x.w").cast("long").alias("words"), F.sha2(F.array_join("x.w", " "), 256).alias("hash"))


@register(Q, f"SELECT doc_id, s // 10 AS bank_id, array_to_string(t[s + 1:s + 10], ' ') AS excerpt FROM (SELECT doc_id, t, unnest(range(0, least(len(t), 480), 10)) AS s FROM (SELECT doc_id, {TOKS} AS t FROM documents)) WHERE len(t[s + 1:s + 10]) >= 5")
def evidence_bank(spark, sf):
    """Numbered ten-word excerpts, at most 48 a document (the bank's size is the feature)."""
    t = table(spark, sf, "documents").select("doc_id", tokenize(F.col("text")).alias("t")).where(F.size("t") > 0)
    at = F.sequence(F.lit(0), F.least(F.size("t"), F.lit(480)) - 1, F.lit(10))
    s = t.select("doc_id", F.explode(F.transform(at, lambda i: F.struct(i.alias("s"), F.slice("t", i + 1, 10).alias("w")))).alias("x")).where(F.size("x.w") >= 5)
    return s.select("doc_id", F.floor(F.col("x.s") / 10).alias("bank_id"), F.array_join("x.w", " ").alias("excerpt"))


@register(Q, "SELECT doc_id, CASE WHEN p = 0 THEN length(text) ELSE p - 1 END AS kept, CASE WHEN p > 0 THEN sha256(substr(text, p)) END AS removed_hash FROM (SELECT doc_id, text, coalesce(list_min(list_filter([strpos(text, 'Licensed'), strpos(text, 'All rights')], lambda x: x > 0)), 0) AS p FROM documents)")
def cut_at_marker(spark, sf):
    kept = S.cut_at(F.col("text"), ["Licensed", "All rights"])
    d = table(spark, sf, "documents").select("doc_id", "text", kept.alias("k"))
    return d.select("doc_id", F.length("k").cast("long").alias("kept"), F.when(F.length("k") < F.length("text"), F.sha2(F.substring("text", F.length("k") + 1, F.length("text")), 256)).alias("removed_hash"))


@register(Q, "SELECT doc_id, regexp_replace(substr(text, greatest(1, strpos(text, '@') - 70), 140), '[ \\n\\t\\r]+', ' ', 'g') AS evidence FROM documents WHERE strpos(text, '@') > 0")
def evidence_window(spark, sf):
    at = F.instr("text", "@")
    return table(spark, sf, "documents").where(at > 0).select("doc_id", F.regexp_replace(F.substring("text", F.greatest(F.lit(1), at - 70), F.lit(140)), "[ \\n\\t\\r]+", " ").alias("evidence"))


@register(Q, "SELECT conv_id, turn, trim(regexp_replace(text, '<\\|[a-z_]+\\|>', '', 'g'), ' ') AS prose FROM conversations")
def clean_transport_tokens(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace("text", r"<\|[a-z_]+\|>", "")).alias("prose"))


@register(Q, "SELECT conv_id, turn, sha256(CASE role WHEN 'user' THEN trim(text, ' ') WHEN 'system' THEN text ELSE role || ': ' || text END) AS derived_hash FROM conversations")
def derive_text(spark, sf):
    d = F.when(F.col("role") == "user", F.trim("text")).when(F.col("role") == "system", F.col("text")).otherwise(F.concat("role", F.lit(": "), "text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(d, 256).alias("derived_hash"))


# ---------------------------------------------------------------- gates and diagnostics


@register(Q, f"SELECT doc_id, n AS words, n BETWEEN 300 AND 950 AS passed, CASE WHEN n < 100 THEN 'materially short' WHEN n < 300 THEN 'slightly short' WHEN n > 1150 THEN 'materially long' WHEN n > 950 THEN 'slightly long' ELSE 'ok' END AS diagnostic FROM (SELECT doc_id, len({TOKS}) AS n FROM documents)")
def word_band_gate(spark, sf):
    return S.word_bands(table(spark, sf, "documents"), 300, 950).withColumn("words", F.col("words").cast("long"))


#: Rules of the gate queries: name, pattern, floor, ceiling.
RULES = [("sentences", r"[.!?]", 3, 100000), ("license", r"Licensed|All rights", 0, 0), ("address", r"@", 0, 0), ("pipes", r"\|", 0, 20)]
COUNTS = "(" + " UNION ALL ".join(f"SELECT doc_id, '{g}' AS gate, len(regexp_extract_all(coalesce(text, ''), '{p}')) AS n, len(regexp_extract_all(coalesce(text, ''), '{p}')) BETWEEN {lo} AND {hi} AS passed FROM documents" for g, p, lo, hi in RULES) + ")"


@register(Q, f"SELECT doc_id, gate, n, passed FROM {COUNTS}")
def pattern_count_gate(spark, sf):
    return S.rule_counts(table(spark, sf, "documents"), RULES)


@register(Q, f"SELECT doc_id, bool_and(passed) AS eligible, coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (WHERE NOT passed), '') AS failed FROM {COUNTS} GROUP BY doc_id")
def gate_matrix(spark, sf):
    return S.gate_matrix(S.rule_counts(table(spark, sf, "documents"), RULES))


@register(Q, f"SELECT gate, count(*) AS n, count(*) FILTER (WHERE NOT passed) AS failures FROM {COUNTS} GROUP BY gate")
def campaign_summary(spark, sf):
    return S.rule_counts(table(spark, sf, "documents"), RULES).groupBy("gate").agg(F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("failures"))


@register(Q, "SELECT doc_id, regexp_matches(text, '[.!?]$') AS terminal, (length(text) - length(replace(text, '\"', ''))) % 2 = 0 AS balanced, regexp_matches(right(text, 4500), 'Licensed') AS licensed_end FROM documents")
def endpoint_predicate(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", t.rlike(r"[.!?]\z").alias("terminal"), ((F.length(t) - F.length(F.replace(t, F.lit('"'), F.lit("")))) % 2 == 0).alias("balanced"), F.right(t, F.lit(4500)).contains("Licensed").alias("licensed_end"))


@register(Q, "SELECT page_id, array_to_string(list_filter(['<script', '<nav', '<footer', 'cookie'], lambda m: strpos(html, m) > 0), ',') AS markers FROM pages")
def leak_markers(spark, sf):
    marks = ["<script", "<nav", "<footer", "cookie"]
    return table(spark, sf, "pages").select("page_id", F.array_join(F.array_compact(F.array(*[F.when(F.col("html").contains(m), F.lit(m)) for m in marks])), ",").alias("markers"))


FAMILIES = {"function": ["the", "of", "and", "der", "die", "que", "la"], "insult": ["idiot", "stupid", "loser"]}


def sql_family(words: list[str]) -> str:
    return f"len(list_filter(t, lambda x: x IN ({', '.join(repr(w) for w in words)})))"


@register(Q, " UNION ALL ".join(f"SELECT doc_id, '{f}' AS family, {sql_family(ws)} AS hits, round(CASE WHEN len(t) = 0 THEN 0 ELSE {sql_family(ws)} / len(t) END, 6) AS density FROM (SELECT doc_id, {TOKS} AS t FROM documents)" for f, ws in FAMILIES.items()))
def lexicon_density(spark, sf):
    """Lexicon rows as data; each text is tokenized once."""
    t = table(spark, sf, "documents").select("doc_id", tokenize(F.col("text")).alias("t"))
    hit = lambda ws: F.size(F.filter("t", lambda x: x.isin(*ws)))
    each = F.array(*[F.struct(F.lit(f).alias("family"), hit(ws).cast("long").alias("hits")) for f, ws in FAMILIES.items()])
    rows = t.select("doc_id", F.size("t").alias("n"), F.explode(each).alias("r"))
    return rows.select("doc_id", "r.family", "r.hits", F.round(F.when(F.col("n") == 0, 0.0).otherwise(F.col("r.hits") / F.col("n")), 6).alias("density"))


STYLE = f"""SELECT doc_id, len(t) AS words, len(s) AS sentences, round(len(t) / greatest(1, len(s)), 6) AS mean_sentence,
  round(1000.0 * len(regexp_extract_all(coalesce(text, ''), ',')) / greatest(1, len(t)), 6) AS commas FROM (SELECT doc_id, text, {TOKS} AS t, regexp_extract_all(coalesce(text, ''), '[^.!?]+[.!?]') AS s FROM documents)"""


def style(spark, sf, *more):
    """(doc_id, words, sentences, mean_sentence, commas, *more), counted in one pass over each text.

    A run of characters before a sentence end counts once, wherever it begins: its last character is enough, and the pattern of the whole run would be
    tried from every character of a text without an end. Words are counted, not made.
    """
    t = F.coalesce("text", F.lit(""))
    d = table(spark, sf, "documents").select("doc_id", *more, F.regexp_count(t, F.lit(X.WORD_RUN)).cast("long").alias("words"), F.regexp_count(t, F.lit("[^.!?][.!?]")).cast("long").alias("sentences"), F.regexp_count(t, F.lit(",")).alias("c"))
    return d.select("doc_id", "words", "sentences", F.round(F.col("words") / F.greatest(F.lit(1), "sentences"), 6).alias("mean_sentence"), F.round(1000.0 * F.col("c") / F.greatest(F.lit(1), "words"), 6).alias("commas"), *more)


@register(Q, STYLE)
def surface_style(spark, sf):
    return style(spark, sf)


def sql_sizes(pieces: str) -> str:
    words = X.WORD.replace("'", "''")
    return f"list_filter(list_transform({pieces}, lambda x: len(regexp_extract_all(x, '{words}'))), lambda x: x > 0)"


def sql_pattern(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: All metrics of ``operators/style.py``.
METRICS = f"""SELECT doc_id, words, len(s) AS sentences, round(coalesce(list_avg(s), 0), 4) AS mean_sentence, round(CASE WHEN len(s) = 0 THEN 0 ELSE sqrt(greatest(list_avg(list_transform(s, lambda x: x * x)) - list_avg(s) * list_avg(s), 0)) END, 4) AS sentence_deviation,
  round(coalesce(list_avg(p), 0), 4) AS mean_paragraph, round(spoken / n, 6) AS dialogue_ratio, {', '.join(f'round(1000.0 * n_{m} / n, 4) AS {m}' for m, _ in Y.MARKS)}, list_transform([{', '.join(map(repr, Y.FUNCTION_WORDS))}], lambda w: round(len(list_filter(t, lambda x: x = w)) / n, 6)) AS function_words FROM (
  SELECT *, len(t) AS words, greatest(1, len(t)) AS n FROM (SELECT doc_id, {TOKS} AS t, {sql_sizes(f"string_split_regex(coalesce(text, ''), {sql_pattern(Y.SENTENCE_GAP)})")} AS s, {sql_sizes(f"string_split_regex(coalesce(text, ''), {sql_pattern(Y.PARAGRAPH_GAP)})")} AS p,
    coalesce(list_sum({sql_sizes(f"regexp_extract_all(coalesce(text, ''), {sql_pattern(Y.SPEECH)}, 1)")}), 0) AS spoken, {', '.join(f"len(regexp_extract_all(coalesce(text, ''), '{p}')) AS n_{m}" for m, p in Y.MARKS)} FROM documents))"""


@register(Q, METRICS)
def style_metrics(spark, sf):
    """All surface metrics; ``surface_style`` keeps the four of its SQL."""
    return Y.style_metrics(table(spark, sf, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


@register(Q, f"SELECT lang, count(*) AS n, round(avg(mean_sentence), 4) AS mean, round(stddev_pop(mean_sentence), 4) AS spread, round(median(words), 4) AS median_words FROM ({STYLE}) JOIN documents USING (doc_id) GROUP BY lang")
def batch_style_rollup(spark, sf):
    s = surface_style(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return s.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("mean_sentence"), 4).alias("mean"), F.round(F.stddev_pop("mean_sentence"), 4).alias("spread"), F.round(F.median("words"), 4).alias("median_words"))


@register(Q, f"""WITH s AS ({STYLE}), m AS (SELECT avg(mean_sentence) AS mu, stddev_pop(mean_sentence) AS sd FROM s)
  SELECT doc_id, round(abs(mean_sentence - mu) / sd, 4) AS distance, abs(mean_sentence - mu) <= sd AS within FROM s, m""")
def distribution_distance(spark, sf):
    s = surface_style(spark, sf)
    m = s.agg(F.avg("mean_sentence").alias("mu"), F.stddev_pop("mean_sentence").alias("sd"))
    gap = F.abs(F.col("mean_sentence") - F.col("mu"))
    return s.join(F.broadcast(m)).select("doc_id", F.round(gap / F.col("sd"), 4).alias("distance"), (gap <= F.col("sd")).alias("within"))


#: Declared tolerances; of other metrics the standard deviation is the tolerance.
TOLERANCES = {"dialogue_ratio": 0.05, "semicolons": 2.0}


@register(Q, f"""WITH m AS ({METRICS}), x AS ({' UNION ALL '.join(f"SELECT doc_id, '{n}' AS metric, CAST({n} AS DOUBLE) AS observed FROM m" for n in Y.NUMBERS)}),
  p AS (SELECT metric, round(avg(observed), 6) AS target, CASE metric {' '.join(f"WHEN '{n}' THEN CAST({v} AS DOUBLE)" for n, v in TOLERANCES.items())} ELSE round(stddev_pop(observed), 6) END AS tolerance FROM x GROUP BY metric)
  SELECT doc_id, metric, observed, target, tolerance, round(abs(observed - target) / greatest(tolerance, 1e-9), 4) AS distance, abs(observed - target) / greatest(tolerance, 1e-9) <= 1 AS within FROM x JOIN p USING (metric)""")
def distribution_diagnostics(spark, sf):
    """Every metric of each document against the distribution of all; ``distribution_distance`` keeps the one of its SQL."""
    m = Scratch(spark, "style").keep(style_metrics(spark, sf), "metrics")
    of = m.agg(*[f(F.col(n).cast("double")).alias(f"{n}_{s}") for n in Y.NUMBERS for f, s in ((F.avg, "mean"), (F.stddev_pop, "spread"))])
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.round(f"{n}_mean", 6).alias("mean"), F.lit(TOLERANCES.get(n)).cast("double").alias("tolerance"), F.round(f"{n}_spread", 6).alias("stddev")) for n in Y.NUMBERS])
    profile = of.select(F.explode(rows).alias("r")).select("r.*")
    return Y.distribution_diagnostics(m, profile, "doc_id").withColumnRenamed("id", "doc_id")


@register(Q, "SELECT doc_id, CASE WHEN p > 0 THEN round(p / length(text), 6) END AS fraction, p > 0 AND p / length(text) BETWEEN 0.2 AND 0.8 AS inside FROM (SELECT doc_id, text, strpos(text, ',') AS p FROM documents)")
def position_fraction(spark, sf):
    p = F.instr("text", ",")
    share = p / F.length("text")
    return table(spark, sf, "documents").select("doc_id", F.when(p > 0, F.round(share, 6)).alias("fraction"), ((p > 0) & share.between(0.2, 0.8)).alias("inside"))


@register(Q, "SELECT doc_id, round(0.4 * CASE WHEN regexp_matches(text, '^[A-Z]') THEN 1 ELSE 0 END + 0.6 * CASE WHEN regexp_matches(text, '[.!?]$') THEN 1 ELSE 0 END, 6) AS quality FROM documents")
def boundary_quality(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.round(0.4 * t.rlike("^[A-Z]").cast("int") + 0.6 * t.rlike(r"[.!?]\z").cast("int"), 6).alias("quality"))


@register(Q, "SELECT doc_id, round(((CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(text, '@') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(text, ',') THEN 1 ELSE 0 END)) / 3.0, 6) AS score FROM documents")
def function_score(spark, sf):
    marks = ["[0-9]", "@", ","]
    total = sum((F.col("text").rlike(m).cast("int") for m in marks), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", F.round(total / 3.0, 6).alias("score"))


@register(Q, f"SELECT conv_id, count(*) AS n_pairs, CAST(sum(len(list_intersect(list_distinct({sql_ngrams('t', 4)}), list_distinct({sql_ngrams('p', 4)})))) AS BIGINT) AS shared FROM (SELECT conv_id, {TOKS} AS t, lag({TOKS}) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE p IS NOT NULL GROUP BY conv_id")
def control_phrase_overlap(spark, sf):
    """4-grams that a turn shares with the turn before."""
    from pyspark.sql import Window

    # words are a column of their own: inside the n-grams' lambda they would be made anew for each
    c = table(spark, sf, "conversations").select("conv_id", "turn", X.word_hashes(tokenize(F.col("text"))).alias("w"))
    c = c.select("conv_id", "turn", F.array_distinct(X.window_hashes(F.col("w"), 4)).alias("g"))
    c = c.withColumn("p", F.lag("g").over(Window.partitionBy("conv_id").orderBy("turn"))).where("p is not null")
    return c.groupBy("conv_id").agg(F.count("*").alias("n_pairs"), F.sum(F.size(F.array_intersect("g", "p")).cast("long")).alias("shared"))


@register(Q, "SELECT event_type, count(*) AS n, round(sum(coalesce(value, 0)), 2) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def telemetry_rollup(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 2).alias("total"), F.countDistinct("user_id").alias("users"))


@register(Q, """WITH g AS (SELECT lang, source, d.doc_id, coalesce(quality, 0) AS q, coalesce(toxic, 0) AS x FROM documents d LEFT JOIN labels USING (doc_id))
  SELECT source, count(*) AS samples, CAST(sum(CASE WHEN x = 0 THEN 1 ELSE 0 END) AS BIGINT) AS eligible, round(avg(45 * q - 15 * x), 6) AS mean_score, max(45 * q - 15 * x) AS best FROM g GROUP BY source""")
def arm_screen(spark, sf):
    g = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    score = 45 * F.coalesce("quality", F.lit(0)) - 15 * F.coalesce("toxic", F.lit(0))
    return g.groupBy("source").agg(F.count("*").alias("samples"), F.count_if(F.coalesce("toxic", F.lit(0)) == 0).alias("eligible"), F.round(F.avg(score), 6).alias("mean_score"), F.max(score).alias("best"))
