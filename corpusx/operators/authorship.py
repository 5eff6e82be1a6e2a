"""Records of who made what: artifacts bound to the calls that made them, and stored items imported again.

Texts are compared by digests taken where they lie. A call's response is derived by every rule before anything is
joined, so a join moves ids and digests; only the parents of an item, whose texts its own is made of, are joined whole.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusx.operators.mining import digest, gate
from corpusx.scratch import Scratch

#: How an artifact's text may be derived from the response of its call.
RULES: Mapping[str, Callable[[Column], Column]] = {
    "whole": lambda r: r,
    "stripped": lambda r: F.btrim(r, F.lit(" \t\r\n")),
    "first_line": lambda r: F.substring_index(r, "\n", 1),
    "after_marker": lambda r: F.btrim(F.regexp_extract(r, r"(?s)^.*?\n---\n(.*)$", 1), F.lit(" \t\r\n")),
}


def build_authorship(artifacts: DataFrame, calls: DataFrame, rules: Mapping[str, Callable[[Column], Column]] = RULES, eligible: tuple[str, str] = ("model_generation", "research")) -> DataFrame:
    """(artifact, call, error, text_hash, response_hash, call_hash, record_hash, eligible): one record per artifact.

    artifacts: (artifact, call, text, kind, scope, parents, rule), parents an array of artifacts; calls: (call, status, model, prompt_hash,
    seed, response), several rows a call. ``error`` is the first that holds: ``unbound`` (no completed row of the call), ``ambiguous`` (more
    than one), ``no identity`` (the completed row names no model), ``unknown rule``, ``other text`` (the rule gives another text), ``missing parent``.
    ``eligible``: kind and scope that admit a record without error. A null text or response is empty, null parents are none;
    repeated artifacts get a record each; a parent counts as present if any artifact has its id.
    """
    response = F.coalesce("response", F.lit(""))
    derived = F.create_map(*[x for name, rule in rules.items() for x in (F.lit(name), digest(rule(response)))])
    identity = F.concat_ws("|", F.col("call").cast("string"), F.coalesce("model", F.lit("")), F.coalesce("prompt_hash", F.lit("")), F.coalesce(F.col("seed").cast("string"), F.lit("")), digest(response))
    rows = calls.where("status = 'completed'").select("call", F.struct(F.col("model").isNotNull().alias("named"), digest(response).alias("response"), digest(identity).alias("call_hash"), F.map_entries(derived).alias("derived")).alias("c"))
    bound = rows.groupBy("call").agg(F.count("*").alias("n"), F.min("c").alias("c")).select(F.col("call").alias("k"), "n", "c.*")

    a = artifacts.select("artifact", "call", digest(F.coalesce("text", F.lit(""))).alias("text_hash"), "kind", "scope", F.coalesce("parents", F.array().cast("array<string>")).alias("parents"), "rule", F.monotonically_increasing_id().alias("row"))
    ids = artifacts.select(F.col("artifact").cast("string").alias("parent")).distinct().withColumn("there", F.lit(1))
    absent = a.select("row", F.explode("parents").alias("parent")).join(ids, "parent", "left").where("there is null").select(F.col("row").alias("r")).distinct().withColumn("absent", F.lit(True))
    j = a.join(bound, F.col("call") == F.col("k"), "left").join(absent, F.col("row") == F.col("r"), "left")
    made = F.element_at(F.map_from_entries("derived"), F.col("rule"))
    error = (
        F.when(F.col("k").isNull(), "unbound").when(F.col("n") > 1, "ambiguous").when(~F.col("named"), "no identity").when(made.isNull(), "unknown rule")
        .when(made != F.col("text_hash"), "other text").when(F.col("absent"), "missing parent")
    )
    record = digest(F.concat_ws("|", F.col("artifact").cast("string"), F.coalesce("kind", F.lit("")), F.coalesce("scope", F.lit("")), "text_hash", "call_hash", F.array_join("parents", ",")))
    admitted = error.isNull() & F.col("kind").eqNullSafe(F.lit(eligible[0])) & F.col("scope").eqNullSafe(F.lit(eligible[1]))
    return j.select("artifact", "call", error.alias("error"), "text_hash", F.col("response").alias("response_hash"), "call_hash", F.when(error.isNull(), record).alias("record_hash"), admitted.alias("eligible"))


def replay_import(items: DataFrame, campaign: str, rules: Sequence[tuple[str, bool]] = (), sep: str = "\n\n", scratch: Scratch | None = None) -> DataFrame:
    """(item, generation, error, text_hash, campaign): which stored items of another campaign hold under the rules of this one.

    items: (item, generation, parents, segment, text, text_hash). An item's text has to be its parents' texts in order and its own segment, joined
    by ``sep``. ``error`` is the first that holds: ``text hash`` (the stored text has another digest), ``missing parent``, ``generation`` (a parent
    isn't from an earlier one), ``lineage`` (the text isn't what its parents and segment make), ``gate`` (the segment fails ``rules``), ``parent rejected``
    (at any distance). Rejections go down generation by generation, as ids alone. Null texts and segments are empty, null
    parents none; items are known by their id, of which there has to be one row.
    """
    scratch = scratch or Scratch(items.sparkSession, "replay")
    i = items.select("item", "generation", F.coalesce("parents", F.array().cast("array<string>")).alias("parents"), F.coalesce("segment", F.lit("")).alias("segment"), F.coalesce("text", F.lit("")).alias("text"), F.col("text_hash").alias("claimed"))
    edges = i.select("item", F.col("generation").alias("g"), F.posexplode("parents").alias("pos", "parent"))
    up = i.select(F.col("item").alias("p"), F.col("generation").alias("pg"), F.col("text").alias("ptext"))
    met = edges.join(up, F.col("parent") == F.col("p"), "left").groupBy("item").agg(
        F.bool_or(F.col("p").isNull()).alias("missing"), F.bool_or(F.coalesce(F.col("pg") >= F.col("g"), F.lit(False))).alias("late"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ptext"))), lambda x: x["ptext"]), sep).alias("before"),
    ).withColumnRenamed("item", "k")
    j = i.join(met, F.col("item") == F.col("k"), "left")
    whole = F.when(F.col("k").isNull(), F.col("segment")).otherwise(F.concat("before", F.lit(sep), "segment"))
    error = (
        F.when(~digest(F.col("text")).eqNullSafe(F.col("claimed")), "text hash").when(F.col("missing"), "missing parent").when(F.col("late"), "generation")
        .when(whole != F.col("text"), "lineage").when(~gate(F.col("segment"), rules), "gate")
    )
    local = scratch.keep(j.select("item", "generation", "parents", digest(F.col("text")).alias("text_hash"), error.alias("error")), "local")
    links = local.where("error is null").select("item", F.explode("parents").alias("parent"))
    newly, fallen = local.where("error is not null").select("item"), None
    while True:  # once per generation that a rejection reaches
        below = links.join(newly.select(F.col("item").alias("parent")), "parent", "left_semi").select("item").distinct()
        if fallen is not None:
            below = below.join(fallen, "item", "left_anti")
        below = scratch.keep(below, "below")
        if below.isEmpty():
            break
        fallen = below if fallen is None else scratch.keep(fallen.unionByName(below), "fallen")
        newly = below
    out = local if fallen is None else local.join(fallen.select(F.col("item").alias("k"), F.lit("parent rejected").alias("fell")), F.col("item") == F.col("k"), "left")
    final = F.col("error") if fallen is None else F.coalesce("error", "fell")
    return out.select("item", "generation", final.alias("error"), "text_hash", F.lit(campaign).alias("campaign"))


def extract_cards(docs: DataFrame, heading: str, labels: Sequence[str], mechanism: Sequence[str], cut: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, nth, heading, a column per label, mechanism, error): cards of a text's blocks, in its row.

    A text is cut into blocks at the pattern ``cut``; blocks of white space alone don't count. A block that matches ``heading`` as a whole opens a card,
    which goes to the next one. The value of a label is the block after it (of a repeated label the last), null where the label isn't there.
    ``mechanism`` is the first of these labels that has a value; a card without one has an ``error``. A text without headings has no card.
    """
    blocks = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), cut, -1), lambda b: F.trim(b) != "")
    t = docs.select(F.col(id_col).alias("id"), F.transform(blocks, lambda b: F.trim(b)).alias("blocks"))
    at = F.filter(F.transform("blocks", lambda b, i: F.when(b.rlike(f"^(?:{heading})$"), i)), lambda i: i.isNotNull())
    t = t.withColumn("at", at).where(F.size("at") > 0)
    bodies = F.transform("at", lambda p, k: F.slice("blocks", p + 1, F.coalesce(F.get("at", k + 1), F.size("blocks")) - p))
    cards = t.select("id", F.posexplode(bodies).alias("nth", "body")).withColumn("back", F.slice(F.reverse("body"), 2, F.greatest(F.size("body") - 2, F.lit(0))))

    def value(label: str) -> Column:
        place = F.array_position("back", label).cast("int")  # from the end, the last block left out
        return F.when(place > 0, F.get("body", F.size("body") - place))

    found = cards.select("id", "nth", F.get("body", F.lit(0)).alias("heading"), *[value(x).alias(x) for x in labels])
    first = F.coalesce(*[F.col(x) for x in mechanism])
    return found.select("*", first.alias("mechanism"), F.when(first.isNull(), F.concat(F.lit("no "), F.lit(" or ".join(mechanism)))).alias("error"))
