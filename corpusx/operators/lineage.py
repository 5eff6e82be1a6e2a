"""Checks of artifacts against what they were made from: promoted segments, reports on bundles,
inherited rows, and profiles against a graph of coordinates. Rows are compared by joins on their ids
and by digests in the row; nothing is gathered but the coordinates of one profile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def word_total(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0))


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def trimmed(text: Column) -> Column:
    """A text without white space at its end; null is empty."""
    return F.rtrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))


def promoted_segments(manifest: DataFrame, stored: DataFrame, least: int, most: int) -> DataFrame:
    """(segment, error): error is null for a segment that may be promoted, else the first check that fails.

    manifest: (segment, selected_sha, raw_sha, words); stored: (segment, selected, raw). In order: no stored
    text, other hash of the selection, other hash of its raw parent, other number of words, outside
    ``least`` to ``most`` words, no prefix of the raw text. White space at the end of a selection doesn't count;
    a null text is empty.
    """
    s = stored.select(F.col("segment").alias("s"), trimmed(F.col("selected")).alias("selected"), F.coalesce("raw", F.lit("")).alias("raw"))
    j = manifest.join(s, F.col("segment") == F.col("s"), "left")
    n = word_total(F.col("selected"))
    error = (
        F.when(F.col("s").isNull(), "not stored")
        .when(~text_digest(F.col("selected")).eqNullSafe(F.col("selected_sha")), "selected hash")
        .when(~text_digest(F.col("raw")).eqNullSafe(F.col("raw_sha")), "raw hash")
        .when(~n.eqNullSafe(F.col("words")), "word count")
        .when((n < least) | (n > most), "word band")
        .when(~F.col("raw").startswith(F.col("selected")), "not a prefix")
    )
    return j.select("segment", error.alias("error"))


def realization_check(bundled: DataFrame, reports: DataFrame, texts: DataFrame) -> DataFrame:
    """(bundle, uncovered, unbundled, inexact, unrealized, passed): counts of items that a report leaves out, that it
    adds, whose evidence isn't in the text word for word, and that were required but not realized.

    bundled: (bundle, item, required); reports: (bundle, item, status, evidence); texts: (bundle, text). Empty
    evidence claims nothing; a bundle without text has no exact evidence.
    """
    b = bundled.select("bundle", "item", F.col("required").alias("must"), F.lit(1).alias("in_bundle"))
    r = reports.join(texts.select("bundle", "text"), "bundle", "left")
    exact = F.coalesce(F.length("evidence") == 0, F.lit(True)) | F.coalesce(F.contains("text", "evidence"), F.lit(False))
    r = r.select("bundle", "item", "status", (~exact).cast("int").alias("bad"), F.lit(1).alias("in_report"))
    j = b.join(r, ["bundle", "item"], "full_outer")
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    t = j.groupBy("bundle").agg(
        count(F.col("in_report").isNull()).alias("uncovered"), count(F.col("in_bundle").isNull()).alias("unbundled"), count(F.col("bad") == 1).alias("inexact"),
        count(F.coalesce("must", F.lit(False)) & ~F.col("status").eqNullSafe(F.lit("realized"))).alias("unrealized"),
    )
    return t.withColumn("passed", F.expr("uncovered + unbundled + inexact + unrealized = 0"))


def inherit_verified(source: DataFrame, audited: DataFrame, campaign: str, paragraphs: int, sep: str = "\n") -> DataFrame:
    """(id, campaign, source_hash, child, child_hash) of the rows (id, text, text_hash) that an audit (id) has passed
    and whose text still has its hash. child: the first ``paragraphs`` paragraphs, an exact prefix of the text."""
    rows = source.where(text_digest(F.col("text")).eqNullSafe(F.col("text_hash"))).join(audited.select("id"), "id", "left_semi")
    child = F.substring_index(F.coalesce("text", F.lit("")), sep, paragraphs)
    return rows.select("id", F.lit(campaign).alias("campaign"), F.col("text_hash").alias("source_hash"), child.alias("child"), text_digest(child).alias("child_hash"))


def resolve_profiles(profiles: DataFrame, nodes: DataFrame, limits: Mapping[str, tuple[int, int | None]]) -> DataFrame:
    """(profile, violations, resolved) of every profile: ``violations`` is a sorted array of rule:coordinate, and
    ``resolved`` the sorted coordinates where there is none, else null.

    profiles: (profile, selected, required, prohibited, ceiling), arrays of coordinates and a rank; nodes: (node, namespace, rank,
    excludes, above), each with what it excludes and with all its ancestors. limits: least and most coordinates of a
    namespace. Rules: unknown, missing, prohibited, excludes, redundant (an ancestor is selected too), rank, few, many.
    Null arrays are empty, a null ceiling is none. A profile's id is unique; its coordinates meet in its row.
    """
    none = F.array().cast("array<string>")
    p = profiles.select("profile", "ceiling", *[F.array_distinct(F.coalesce(c, none)).alias(c) for c in ("selected", "required", "prohibited")])
    known = nodes.select(F.col("node").alias("at"), F.struct("node", "namespace", "rank", F.coalesce("excludes", none).alias("excludes"), F.coalesce("above", none).alias("above")).alias("known"))
    each = p.select("profile", F.explode("selected").alias("at")).join(known, "at")
    p = p.join(each.groupBy("profile").agg(F.collect_list("known").alias("known")), "profile", "left")
    have = lambda f: F.coalesce(F.transform(F.filter("known", f), lambda x: x["node"]), none)
    found = [
        _named("unknown", F.array_except("selected", have(lambda x: F.lit(True)))),
        _named("missing", F.array_except("required", "selected")),
        _named("prohibited", F.array_intersect("selected", "prohibited")),
        _named("excludes", have(lambda x: F.arrays_overlap(x["excludes"], F.col("selected")))),
        _named("redundant", have(lambda x: F.arrays_overlap(x["above"], F.col("selected")))),
        _named("rank", have(lambda x: F.coalesce(x["rank"] > F.col("ceiling"), F.lit(False)))),
    ]
    for space, (least, most) in limits.items():
        n = F.size(have(_within(space)))
        found.append(F.when(n < least, F.array(F.lit(f"few:{space}"))).otherwise(none))
        if most is not None:
            found.append(F.when(n > most, F.array(F.lit(f"many:{space}"))).otherwise(none))
    t = p.select("profile", "selected", F.array_sort(F.concat(*found)).alias("violations"))
    return t.select("profile", "violations", F.when(F.size("violations") == 0, F.array_sort("selected")).alias("resolved"))


def _within(space: str):
    return lambda x: x["namespace"] == space


def _named(rule: str, coordinates: Column) -> Column:
    return F.transform(coordinates, lambda x: F.concat(F.lit(f"{rule}:"), x))


def rubric_overlay(rubrics: DataFrame, diagnostics: Sequence[str], defects: Sequence[str]) -> DataFrame:
    """(profile, kind, item, weight): the rubric rows of each profile, with diagnostics and defects added at weight zero.
    What a rubric has already isn't added again, so its weights and their sum stay as they are."""
    added = [("diagnostic", x) for x in diagnostics] + [("defect", x) for x in defects]
    rows = rubrics.select("profile", "kind", "item", F.col("weight").cast("double").alias("weight"))
    if not added:
        return rows
    new = F.array_distinct(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(x).alias("item")) for k, x in added]))
    had = rows.groupBy("profile").agg(F.collect_set(F.when(F.struct("kind", "item").isin(*[F.struct(F.lit(k).alias("kind"), F.lit(x).alias("item")) for k, x in added]), F.struct("kind", "item"))).alias("had"))
    extra = had.select("profile", F.explode(F.array_except(new, "had")).alias("x"), F.lit(0.0).alias("weight"))
    return rows.unionByName(extra.select("profile", "x.kind", "x.item", "weight"))
