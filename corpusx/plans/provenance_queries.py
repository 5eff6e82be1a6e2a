"""Integrity, split, lineage and graph queries, and streams."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusx.plans.tables import register, table
from corpusx.scratch import Scratch
from corpusx.streaming.latest import keep_latest, read_latest

Q: dict = {}


@register(Q, "SELECT lang, count(*) AS n, count(*) FILTER (WHERE length(text) <> n_chars) AS mismatched, count(*) FILTER (WHERE text IS NULL) AS absent FROM documents GROUP BY lang")
def corpus_validation(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.length("text") != F.col("n_chars")).alias("mismatched"), F.count_if(F.col("text").isNull()).alias("absent"))


@register(Q, """SELECT 'lineitem.order' AS link, count(*) AS rows, count(*) FILTER (WHERE o_orderkey IS NULL) AS dangling FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT 'orders.customer', count(*), count(*) FILTER (WHERE c_custkey IS NULL) FROM orders LEFT JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT 'labels.document', count(*), count(*) FILTER (WHERE d.doc_id IS NULL) FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id""")
def reference_integrity(spark, sf):
    def link(name, child, key, parent, target):
        p = table(spark, sf, parent).select(F.col(target).alias("__t")).distinct()
        j = table(spark, sf, child).join(p, F.col(key) == F.col("__t"), "left")
        return j.agg(F.lit(name).alias("link"), F.count("*").alias("rows"), F.count_if(F.col("__t").isNull()).alias("dangling"))

    return link("lineitem.order", "lineitem", "l_orderkey", "orders", "o_orderkey").unionByName(link("orders.customer", "orders", "o_custkey", "customer", "c_custkey")).unionByName(link("labels.document", "labels", "doc_id", "documents", "doc_id"))


@register(Q, "SELECT source, count(DISTINCT lang) AS langs, count(DISTINCT lang) > 1 AS confounded FROM documents GROUP BY source")
def confounding_check(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.countDistinct("lang").alias("langs"), (F.countDistinct("lang") > 1).alias("confounded"))


@register(Q, """SELECT h AS text_hash, count(DISTINCT split) AS splits, count(*) AS n FROM (SELECT sha256(text) AS h, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'dev' ELSE 'train' END AS split FROM documents) GROUP BY h HAVING count(DISTINCT split) > 1""")
def seal_split(spark, sf):
    """Texts that leak across the splits of ids."""
    split = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "dev").otherwise("train")
    d = table(spark, sf, "documents").select(F.sha2("text", 256).alias("text_hash"), split.alias("split"))
    return d.groupBy("text_hash").agg(F.countDistinct("split").alias("splits"), F.count("*").alias("n")).where("splits > 1")


@register(Q, "SELECT user_id, event_type, count(DISTINCT md5(props)) AS requests FROM events GROUP BY ALL HAVING count(DISTINCT md5(props)) > 1")
def request_drift(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.countDistinct(F.md5("props")).alias("requests")).where("requests > 1")


@register(Q, "SELECT doc_id, (lang IS NULL) = (source IS NULL) AS complete FROM documents")
def lineage_required(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.col("lang").isNull() == F.col("source").isNull()).alias("complete"))


@register(Q, """SELECT page_id, CASE WHEN url LIKE '%.example%' THEN 'example' ELSE 'other' END AS category, len(list_filter(['script', 'nav', 'footer', 'table'], lambda m: strpos(html, '<' || m) > 0)) AS reasons FROM pages""")
def path_content_audit(spark, sf):
    hits = sum((F.col("html").contains(f"<{m}").cast("int") for m in ("script", "nav", "footer", "table")), F.lit(0))
    return table(spark, sf, "pages").select("page_id", F.when(F.col("url").like("%.example%"), "example").otherwise("other").alias("category"), hits.cast("long").alias("reasons"))


@register(Q, "SELECT user_id, event_id, props FROM (SELECT *, lag(md5(props)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before = md5(props)")
def replay_witness(spark, sf):
    from pyspark.sql import Window

    before = F.lag(F.md5("props")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").withColumn("before", before).where(F.col("before") == F.md5("props")).select("user_id", "event_id", "props")


@register(Q, "SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS assembly_hash, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def assembly_reconstruct(spark, sf):
    spans = F.array_sort(F.collect_list(F.struct("turn", "text")))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(spans.alias("s"), F.sum(F.length("text").cast("long")).alias("chars"))
    return c.select("conv_id", F.sha2(F.array_join(F.transform("s", lambda x: x["text"]), "\n"), 256).alias("assembly_hash"), "chars")


# ---------------------------------------------------------------- graphs


def parents(spark, sf) -> DataFrame:
    """(src, dst): part -> brand -> type, as text nodes."""
    p = table(spark, sf, "part")
    return p.select(F.concat(F.lit("part:"), "p_partkey").alias("src"), F.col("p_brand").alias("dst")).unionByName(
        p.select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst"))).distinct()


def closure(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(src, dst, depth): all that is reachable, by joining the last layer until nothing is new; a cycle ends as well, as its
    pairs are known after one turn. Every layer is written."""
    known = scratch.keep(edges.withColumn("depth", F.lit(1)), "layer")
    layers, last = [known], known
    for depth in count(2):
        seen = layers[0]
        for x in layers[1:]:
            seen = seen.unionByName(x)
        step = last.select("src", F.col("dst").alias("via")).join(edges.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
        last = scratch.keep(step.join(seen, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)), "layer")
        if last.isEmpty():
            return seen
        layers.append(last)


PARENTS = "(SELECT DISTINCT 'part:' || p_partkey AS src, p_brand AS dst FROM part UNION SELECT DISTINCT p_brand, p_type FROM part)"


@register(Q, f"SELECT src, dst, min(depth) AS depth FROM (SELECT src, dst, 1 AS depth FROM {PARENTS} UNION ALL SELECT a.src, b.dst, 2 FROM {PARENTS} a JOIN {PARENTS} b ON a.dst = b.src) GROUP BY ALL")
def ancestors(spark, sf):
    return closure(parents(spark, sf), Scratch(spark, "closure"))


@register(Q, f"SELECT dst AS node, count(*) AS n FROM {PARENTS} e WHERE NOT EXISTS (SELECT 1 FROM {PARENTS} f WHERE f.src = e.dst) GROUP BY dst")
def graph_integrity(spark, sf):
    """Nodes that edges point to and that have no edge of their own (roots or unknown)."""
    e = parents(spark, sf)
    return e.join(e.select(F.col("src").alias("s")).distinct(), F.col("dst") == F.col("s"), "left_anti").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- streams


@register(Q, "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def stream_latest(spark, sf):
    """The latest event of each user, drained from the events table as a stream."""
    s = Scratch(spark, "stream")
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    keep_latest(events, f"{s.root}/latest", f"{s.root}/checkpoint", "user_id", ["ts", "event_id"], ["event_type"])
    kept = events.select("user_id", "ts", "event_id", "event_type").schema
    return read_latest(spark, f"{s.root}/latest", kept).select("user_id", "event_id", "event_type")
