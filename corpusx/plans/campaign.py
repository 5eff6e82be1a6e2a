"""Payloads, stage gates, budgets, feedback, packets and lineage. As in the other modules the rules run
on the given tables: events are calls and notes, line items are artifacts of the orders they cite."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusx.functions.text import sql_tokens, sql_uniform, tokenize, uniform
from corpusx.operators import shape as S
from corpusx.plans.provenance_queries import PARENTS, closure, parents
from corpusx.plans.shaping import COUNTS, RULES
from corpusx.operators import records as P
from corpusx.plans.tables import register, table
from corpusx.scratch import Scratch

Q: dict = {}
TOKS = sql_tokens()


def named(*rules):
    """Names of the rules (condition, name) that hold, joined; a null condition doesn't hold."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, n) for c, n in rules])), ",")


def sql_named(*rules) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in rules) + "], lambda x: x IS NOT NULL), ',')"


# ---------------------------------------------------------------- payloads

PAYLOAD = r"""(SELECT *, TRY_CAST(regexp_extract(payload, '"k": *(-?[0-9]+)', 1) AS INTEGER) AS k FROM (SELECT *, regexp_extract(coalesce(props, ''), '(?s)\{.*\}') AS payload FROM events))"""


def payloads(spark, sf):
    e = table(spark, sf, "events").withColumn("payload", F.regexp_extract(F.coalesce("props", F.lit("")), r"(?s)\{.*\}", 0))
    return e.withColumn("k", F.get_json_object("payload", "$.k").try_cast("int"))


@register(Q, f"SELECT event_id, k, CASE WHEN payload = '' THEN 'no object' WHEN k IS NULL THEN 'no number' ELSE 'ok' END AS verdict FROM {PAYLOAD}")
def extract_json_payload(spark, sf):
    """From the first brace to the last, to a typed column; what doesn't parse keeps its reason."""
    v = F.when(F.col("payload") == "", "no object").when(F.col("k").isNull(), "no number").otherwise("ok")
    return payloads(spark, sf).select("event_id", "k", v.alias("verdict"))


@register(Q, f"SELECT user_id || '-' || event_id AS item, round(k / 100.0, 6) AS p, coalesce(k > 0 AND k < 10, false) AS valid FROM {PAYLOAD}")
def parse_distribution(spark, sf):
    """Percentages of a call's items; each must lie strictly between 0 and 0.10."""
    ok = F.coalesce((F.col("k") > 0) & (F.col("k") < 10), F.lit(False))
    return payloads(spark, sf).select(F.concat_ws("-", F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("item"), F.round(F.col("k") / 100.0, 6).alias("p"), ok.alias("valid"))


NOTE = (("user_id IS NULL", "author"), ("event_type NOT IN ('view', 'click', 'purchase', 'error')", "status"), ("coalesce(props, '') IN ('', '{}')", "evidence"), ("n > 1", "repeated"))


@register(Q, f"SELECT DISTINCT event_id, sha256(concat_ws('|', event_id, user_id, event_type, props)) AS note_hash, {sql_named(*NOTE)} AS errors FROM (SELECT *, count(*) OVER (PARTITION BY event_id) AS n FROM events)")
def journal_check(spark, sf):
    """Notes with their hash and defects: unknown status, no evidence, an id given twice."""
    n = table(spark, sf, "events").withColumn("n", F.count("*").over(Window.partitionBy("event_id")))
    digest = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type", "props"), 256)
    return n.select("event_id", digest.alias("note_hash"), named(*[(F.expr(c), name) for c, name in NOTE]).alias("errors")).distinct()


# ---------------------------------------------------------------- gates and diagnostics

#: Rules by stage: stage, name, pattern, floor, ceiling.
STAGES = [("english", "sentences", "[.!?]", 3, 100000), ("english", "address", "@", 0, 0), ("other", "commas", ",", 1, 100000), ("other", "pipes", r"\|", 0, 20)]
STAGE = "CASE WHEN lang = 'en' THEN 'english' ELSE 'other' END"
STAGED = " UNION ALL ".join(f"SELECT doc_id, '{g}' AS gate, len(regexp_extract_all(coalesce(text, ''), '{p}')) BETWEEN {lo} AND {hi} AS passed FROM documents WHERE {STAGE} = '{s}'" for s, g, p, lo, hi in STAGES)


@register(Q, f"SELECT doc_id, bool_and(passed) AS eligible, coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (WHERE NOT passed), '') AS failed FROM ({STAGED}) GROUP BY doc_id")
def stage_gate_matrix(spark, sf):
    """Each document under the rules of its own stage, row by row: a failed gate is counted in place."""
    text = F.coalesce("text", F.lit(""))
    bad = [(F.expr(STAGE) == s) & ~F.regexp_count(text, F.lit(p)).between(lo, hi) for s, _, p, lo, hi in STAGES]
    failed = F.array_sort(F.array_compact(F.array(*[F.when(c, r[1]) for c, r in zip(bad, STAGES, strict=True)])))
    return table(spark, sf, "documents").select("doc_id", failed.alias("f")).select("doc_id", (F.size("f") == 0).alias("eligible"), F.array_join("f", ",").alias("failed"))


@register(Q, f"SELECT doc_id, gate, n, passed, 2 AS version FROM {COUNTS} c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.doc_id AND l.quality = 1)")
def revalidate_stale(spark, sf):
    """Gates recomputed for documents whose stored verdict isn't current, under the next version."""
    current = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    stale = table(spark, sf, "documents").select("doc_id", "text").join(current, "doc_id", "left_anti")
    return S.rule_counts(stale, RULES).withColumn("version", F.lit(2))


@register(Q, """SELECT doc_id, p.observed, p.observed IS NOT NULL AND p.observed = d.expected AS passed FROM (SELECT doc_id, CASE WHEN text <> '' THEN sha256(text) END AS observed FROM documents) p
  LEFT JOIN (SELECT source, lang, arg_min(sha256(text), doc_id) AS expected FROM documents WHERE text <> '' GROUP BY source, lang) d ON d.source = (SELECT source FROM documents x WHERE x.doc_id = p.doc_id) AND d.lang = (SELECT lang FROM documents x WHERE x.doc_id = p.doc_id)""")
def provenance_gate(spark, sf):
    """Whether a text is the one registered for its source and language: the hash of the first document of both."""
    d = table(spark, sf, "documents")
    registered = d.where("text <> ''").groupBy("source", "lang").agg(F.min_by(F.sha2("text", 256), "doc_id").alias("expected"))
    return P.provenance_gate(d, registered, "doc_id", "text", ["source", "lang"])


PREVENTED = r"(?:no|not|never)(?:[^A-Za-z0-9]+[A-Za-z0-9]+){0,9}[^A-Za-z0-9]+password"


@register(Q, f"""SELECT doc_id, {sql_named(("n NOT BETWEEN 120 AND 850", "length"), ("NOT regexp_matches(t, '[.!?]')", "requirement"), (f"regexp_matches(regexp_replace(t, '{PREVENTED}', '', 'g'), 'password')", "forbidden"))} AS errors
  FROM (SELECT doc_id, coalesce(text, '') AS t, len({TOKS}) AS n FROM documents)""")
def program_validity(spark, sf):
    """Length, a required pattern, and a forbidden event unless a prevention cue comes shortly before."""
    t = F.coalesce("text", F.lit(""))
    n = F.size(tokenize(F.col("text")))
    rules = [(~n.between(120, 850), "length"), (~t.rlike("[.!?]"), "requirement"), (F.regexp_replace(t, PREVENTED, "").contains("password"), "forbidden")]
    return table(spark, sf, "documents").select("doc_id", named(*rules).alias("errors"))


FACETS = [("n_chars > 6000", "long"), ("n_chars < 500", "short"), ("regexp_like(text, '[0-9]')", "numeric"), ("text LIKE '%@%'", "contact")]


@register(Q, "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {c.replace('regexp_like', 'regexp_matches')} THEN '{n}' END" for c, n in FACETS) + ", lang, source], lambda x: x IS NOT NULL))), ',') AS facets FROM documents")
def infer_facets(spark, sf):
    """Facets of a text's features, with those its source hands down, sorted."""
    own = [F.when(F.expr(c), n) for c, n in FACETS]
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*own, F.col("lang"), F.col("source"))))), ",").alias("facets"))


SIGNALS = [("quoted", "(?s)\".*\""), ("contact", "@"), ("after_contact", "(?s)@.*[0-9]"), ("closed", "[.!?]$")]


@register(Q, f"SELECT doc_id, {', '.join(f'{n}' for n, _ in SIGNALS)}, round(({' + '.join(f'CAST({n} AS INTEGER)' for n, _ in SIGNALS)}) / {len(SIGNALS)}.0, 6) AS coverage FROM (SELECT doc_id, " + ", ".join(f"regexp_matches(coalesce(text, ''), '{p}') AS {n}" for n, p in SIGNALS) + " FROM documents)")
def signal_bundle(spark, sf):
    """Named diagnostics by presence, co-occurrence and order, and the share that holds."""
    t = F.coalesce("text", F.lit(""))
    d = table(spark, sf, "documents").select("doc_id", *[t.rlike(p.replace("$", r"\z")).alias(n) for n, p in SIGNALS])
    return d.withColumn("coverage", F.round(sum((F.col(n).cast("int") for n, _ in SIGNALS), F.lit(0)) / float(len(SIGNALS)), 6))


# ---------------------------------------------------------------- budgets, diversity, guards


@register(Q, """SELECT o_custkey, r.used AS used, r.n AS picked FROM (SELECT o_custkey, list_reduce(list({'used': cents, 'n': CAST(1 AS BIGINT)} ORDER BY cents DESC, o_orderkey),
  lambda a, x: CASE WHEN a.used + x.used <= 50000000 THEN {'used': a.used + x.used, 'n': a.n + 1} ELSE a END) AS r
  FROM (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) GROUP BY o_custkey)""")
def budget_fill(spark, sf):
    """Greedy fill of a customer's budget, the largest first; what doesn't fit is passed over unless it
    comes first. Rows arrive sorted and only the running sum is held, so a group has no memory bound."""
    limit = 50_000_000
    o = table(spark, sf, "orders").select("o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), "o_orderkey")
    dealt = o.repartition("o_custkey").sortWithinPartitions("o_custkey", F.desc("cents"), "o_orderkey")
    schema = pa.schema([(n, pa.int64()) for n in ("o_custkey", "used", "picked")])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, used, picked, started = None, 0, 0, False
        for b in batches:
            done = []
            for k, cents in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not started or k != key:
                    if started:
                        done.append((key, used, picked))
                    key, used, picked, started = k, cents, 1, True
                elif used + cents <= limit:
                    used, picked = used + cents, picked + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], pa.int64()) for i in range(3)], schema=schema)
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (key, used, picked)], schema=schema)

    return dealt.mapInArrow(fill, "o_custkey long, used long, picked long")


SIGNS = "(SELECT DISTINCT s_nationkey AS bundle, p_brand, l_returnflag FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey)"


@register(Q, f"""WITH s AS {SIGNS}, c AS (SELECT bundle, count(*) AS n FROM s GROUP BY bundle)
  SELECT a.bundle AS bundle_a, b.bundle AS bundle_b, round(1 - count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 6) AS distance
  FROM s a JOIN s b ON a.p_brand = b.p_brand AND a.l_returnflag = b.l_returnflag AND a.bundle < b.bundle JOIN c x ON x.bundle = a.bundle JOIN c y ON y.bundle = b.bundle GROUP BY ALL""")
def bundle_distance(spark, sf):
    """Distance of nations by their distinct (brand, flag) signatures; both are of bounded number."""
    j = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag").distinct()
    j = j.join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    j = j.join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    s = Scratch(spark, "bundles").keep(j.select(F.col("s_nationkey").alias("bundle"), "p_brand", "l_returnflag").distinct())
    n = s.groupBy("bundle").agg(F.count("*").alias("n"))
    a, b = s.withColumnRenamed("bundle", "bundle_a"), s.withColumnRenamed("bundle", "bundle_b")
    p = a.join(b, ["p_brand", "l_returnflag"]).where("bundle_a < bundle_b").groupBy("bundle_a", "bundle_b").agg(F.count("*").alias("common"))
    p = p.join(n.toDF("bundle_a", "x"), "bundle_a").join(n.toDF("bundle_b", "y"), "bundle_b")
    return p.select("bundle_a", "bundle_b", F.round(1 - F.col("common") / (F.col("x") + F.col("y") - F.col("common")), 6).alias("distance"))


@register(Q, """SELECT event_id, md5(props) <> h AS stale FROM events JOIN (SELECT user_id, md5(arg_max(props, (ts, event_id))) AS h FROM events WHERE event_type = 'purchase' GROUP BY user_id) USING (user_id) WHERE event_type = 'view'""")
def stale_retrieval_guard(spark, sf):
    """Views that don't carry the hash of the user's current (latest purchase) state."""
    e = table(spark, sf, "events")
    now = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.md5(F.max_by("props", F.struct("ts", "event_id"))).alias("h"))
    return e.where("event_type = 'view'").join(now, "user_id").select("event_id", (F.md5("props") != F.col("h")).alias("stale"))


# ---------------------------------------------------------------- judgments, samples, packets

DECISION = (("o_orderkey IS NULL", "unknown"), ("n IS NULL", "undecided"), ("ranks < n", "repeated rank"), ("top <> ranks OR low <> 1", "gap"))


@register(Q, f"SELECT coalesce(o_orderkey, k) AS id, coalesce(n, 0) AS n, {sql_named(*DECISION)} AS errors FROM orders FULL JOIN (SELECT l_orderkey AS k, count(*) AS n, count(DISTINCT l_linenumber) AS ranks, max(l_linenumber) AS top, min(l_linenumber) AS low FROM lineitem GROUP BY l_orderkey) ON k = o_orderkey")
def adjudicate(spark, sf):
    """Decisions (line items) cover the pool (orders), and the ranks of each run from 1 without a gap."""
    d = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("ranks"), F.max("l_linenumber").alias("top"), F.min("l_linenumber").alias("low"))
    j = table(spark, sf, "orders").select("o_orderkey").join(d, F.col("k") == F.col("o_orderkey"), "full")
    return j.select(F.coalesce("o_orderkey", "k").alias("id"), F.coalesce("n", F.lit(0)).alias("n"), named(*[(F.expr(c), name) for c, name in DECISION]).alias("errors"))


@register(Q, """WITH v AS (SELECT user_id, event_type AS label, max(value) AS m FROM events GROUP BY ALL), med AS (SELECT label, median(m) AS med, count(*) AS reviewers FROM v GROUP BY label),
  duel AS (SELECT a.label AS x, b.label AS y, sum(sign(a.m - b.m)) AS margin FROM v a JOIN v b ON a.user_id = b.user_id AND a.label <> b.label GROUP BY ALL),
  won AS (SELECT label, med, reviewers, count(*) FILTER (WHERE margin > 0) AS wins FROM med LEFT JOIN duel ON x = label GROUP BY ALL)
  SELECT label, med, reviewers, wins, row_number() OVER (ORDER BY wins = (SELECT count(*) - 1 FROM med) DESC, med DESC, label) = 1 AS winner FROM won""")
def human_feedback(spark, sf):
    """Medians, duels and the Condorcet winner, else the best median; labels are event types (few)."""
    v = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("label")).agg(F.max("value").alias("m"))
    med = v.groupBy("label").agg(F.median("m").alias("med"), F.count("*").alias("reviewers"))
    other = v.select("user_id", F.col("label").alias("y"), F.col("m").alias("r"))
    duel = v.join(other, "user_id").where("label <> y").groupBy("label", "y").agg(F.sum(F.signum(F.col("m") - F.col("r"))).alias("margin"))
    wins = duel.groupBy("label").agg(F.count_if(F.col("margin") > 0).alias("w"))
    won = med.join(wins, "label", "left").withColumn("wins", F.coalesce("w", F.lit(0))).withColumn("labels", F.count("*").over(Window.partitionBy()))
    best = F.row_number().over(Window.orderBy(F.desc(F.col("wins") == F.col("labels") - 1), F.desc("med"), "label")) == 1
    return won.select("label", "med", "reviewers", "wins", best.alias("winner"))


DRAW = f"-ln({sql_uniform(7, 'p_partkey')}) / p_size"


@register(Q, f"SELECT p_brand, p_partkey, p_size >= 45 AS required FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size >= 45 ORDER BY {DRAW}, p_partkey) AS n FROM part WHERE p_size > 0) WHERE p_size >= 45 OR n <= 3")
def stratified_bundle(spark, sf):
    """All required parts of a brand and three optional ones drawn by weight."""
    p = table(spark, sf, "part").where("p_size > 0")
    need = p.where("p_size >= 45").select("p_brand", "p_partkey", F.lit(True).alias("required"))
    rest = p.where("p_size < 45").withColumn("key", -F.log(uniform(7, F.col("p_partkey"))) / F.col("p_size"))
    drawn = rest.withColumn("n", F.row_number().over(Window.partitionBy("p_brand").orderBy("key", "p_partkey"))).where("n <= 3")
    return need.unionByName(drawn.select("p_brand", "p_partkey", F.lit(False).alias("required")))


PACKETS = {"1-2": (1, 2), "1-3": (1, 3), "2-3": (2, 3), "1-2-3": (1, 2, 3)}
FINAL = "(SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank, count(*) OVER (PARTITION BY p_brand) AS c FROM part)"


@register(Q, " UNION ALL ".join(f"SELECT p_brand, '{n}' AS packet, CAST({i + 1} AS INTEGER) AS place, p_partkey FROM {FINAL} WHERE c >= 3 AND rank = {r}" for n, rs in PACKETS.items() for i, r in enumerate(rs)))
def pairwise_packets(spark, sf):
    """Three packets of two and one of three from the three finalists of each brand."""
    w = Window.partitionBy("p_brand")
    f = table(spark, sf, "part").withColumn("rank", F.row_number().over(w.orderBy(F.desc("p_retailprice"), "p_partkey"))).where("rank <= 3")
    f = f.withColumn("c", F.count("*").over(w)).where("c = 3")
    rows = F.array(*[F.struct(F.lit(n).alias("packet"), F.lit(i + 1).alias("place"), F.lit(r).alias("of")) for n, rs in PACKETS.items() for i, r in enumerate(rs)])
    return f.select("p_brand", "p_partkey", "rank", F.inline(rows)).where("rank = of").select("p_brand", "packet", "place", "p_partkey")


@register(Q, """SELECT p_brand, count(*) AS n, sha256(string_agg(sha256(p_name), '' ORDER BY rank)) AS set_hash FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 5 GROUP BY p_brand""")
def freeze_selection(spark, sf):
    """A hash per brand over the ordered entry hashes of its five picks."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    p = table(spark, sf, "part").withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    held = F.array_sort(F.collect_list(F.struct("rank", F.sha2("p_name", 256).alias("h"))))
    return p.groupBy("p_brand").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(held, lambda x: x["h"]), ""), 256).alias("set_hash"))


@register(Q, """SELECT d.source, d.doc_id, sha256(text) AS text_hash, length(text) = n_chars AS agrees FROM documents d JOIN (SELECT source, max((quality - toxic, -doc_id)) AS best, -max((quality - toxic, -doc_id))[2] AS pick
  FROM documents JOIN labels USING (doc_id) GROUP BY source) w ON w.pick = d.doc_id""")
def resolve_winner(spark, sf):
    """The winning label of each source, revealed to its text, whose recorded extent must agree."""
    d = table(spark, sf, "documents")
    j = d.select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    pick = j.groupBy("source").agg(F.max(F.struct((F.col("quality") - F.col("toxic")).alias("s"), (-F.col("doc_id")).alias("neg"))).alias("best")).select((-F.col("best.neg")).alias("pick"))
    return d.join(pick, F.col("doc_id") == F.col("pick")).select("source", "doc_id", F.sha2("text", 256).alias("text_hash"), (F.length("text") == F.col("n_chars")).alias("agrees"))


# ---------------------------------------------------------------- lineage

ARTIFACT = (("o_orderkey IS NULL", "unresolved call"), ("l_shipdate < o_orderdate", "before its call"), ("p_partkey IS NULL", "missing parent"), ("l_returnflag = 'R' AND l_linestatus = 'O'", "eligibility"))


@register(Q, f"SELECT l_orderkey, l_linenumber, {sql_named(*ARTIFACT)} AS errors FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey")
def authorship_check(spark, sf):
    """Every artifact against its call, parents and eligibility; the failed rules in order."""
    j = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_returnflag", "l_linestatus")
    j = j.join(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    j = j.join(table(spark, sf, "part").select("p_partkey"), F.col("p_partkey") == F.col("l_partkey"), "left")
    return j.select("l_orderkey", "l_linenumber", named(*[(F.expr(c), n) for c, n in ARTIFACT]).alias("errors"))


LADDER = "CASE WHEN top <> n THEN 'invalid_reconstruction' WHEN returned THEN 'historical_unbound' WHEN unfinished THEN 'strict_no_replay' ELSE 'strict_verified' END"


@register(Q, f"SELECT status, count(*) AS n FROM (SELECT {LADDER} AS status FROM (SELECT l_orderkey, max(l_linenumber) AS top, count(*) AS n, bool_or(l_returnflag = 'R') AS returned, bool_or(l_linestatus = 'O') AS unfinished FROM lineitem GROUP BY l_orderkey)) GROUP BY status")
def assembly_audit(spark, sf):
    """How many assemblies stand on each rung of the ladder."""
    a = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("top"), F.count("*").alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.bool_or(F.col("l_linestatus") == "O").alias("unfinished"))
    return a.groupBy(F.expr(LADDER).alias("status")).agg(F.count("*").alias("n"))


@register(Q, f"""WITH picks AS (SELECT DISTINCT l_suppkey AS supp, 'part:' || l_partkey AS node FROM lineitem), e AS {PARENTS},
  up AS (SELECT src, dst FROM e UNION SELECT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src)
  SELECT supp, count(DISTINCT node) AS nodes FROM (SELECT supp, node FROM picks UNION SELECT supp, dst FROM picks JOIN up ON src = node) GROUP BY supp""")
def requires_closure(spark, sf):
    """What a supplier's parts require, directly and through others, themselves included."""
    picks = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supp"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("node")).distinct()
    up = closure(parents(spark, sf), Scratch(spark, "requires")).select(F.col("src").alias("node"), "dst")
    wanted = picks.join(up, "node").select("supp", F.col("dst").alias("node"))
    return picks.unionByName(wanted).groupBy("supp").agg(F.countDistinct("node").alias("nodes"))
