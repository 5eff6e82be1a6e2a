"""Checks on payloads, seals and packets, and inheritance of layered profiles, on named columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusx.scratch import Scratch


def critic_only_check(payloads: DataFrame, id_col: str, payload_col: str, permitted: Sequence[str], forbidden: Sequence[str]) -> DataFrame:
    """(id, unknown, forbidden, passed): keys of a JSON object that a critic may not use at all, and keys that would
    replace the criticised text. A payload that is no object fails with neither."""
    keys = F.json_object_keys(F.col(payload_col))
    names = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    t = payloads.select(F.col(id_col).alias("id"), keys.alias("keys"))
    none = F.array().cast("array<string>")
    unknown, bad = F.coalesce(F.array_except("keys", names(permitted)), none), F.coalesce(F.array_intersect("keys", names(forbidden)), none)
    return t.select("id", F.array_join(F.array_sort(unknown), ",").alias("unknown"), F.array_join(F.array_sort(bad), ",").alias("forbidden"), (F.col("keys").isNotNull() & (F.size(unknown) == 0) & (F.size(bad) == 0)).alias("passed"))


def row_digest(*cols: str) -> Column:
    """A number of 48 bits that stands for the values of a row in a seal; null and empty are told apart."""
    said = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in cols])
    return F.conv(F.substring(F.md5(said), 1, 12), 16, 10).cast("decimal(20,0)")


def seal_of(rows: DataFrame, part: str, *cols: str) -> DataFrame:
    """(part, n, seal) of each part of a table: the same in any order; partial sums combine before the shuffle."""
    return rows.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("n"), F.md5(F.sum(row_digest(*cols)).cast("string").cast("binary")).alias("seal"))


def seal_verify(sealed: DataFrame, now: DataFrame) -> DataFrame:
    """(part, status) from two tables (part, n, seal): intact, changed, missing (sealed only) or new."""
    b = now.select(F.col("part").alias("p"), F.col("n").alias("n_now"), F.col("seal").alias("seal_now"))
    j = sealed.join(b, F.col("part").eqNullSafe(F.col("p")), "full_outer")
    status = F.when(F.col("seal_now").isNull(), "missing").when(F.col("seal").isNull(), "new").when((F.col("seal") == F.col("seal_now")) & (F.col("n") == F.col("n_now")), "intact").otherwise("changed")
    return j.select(F.coalesce("part", "p").alias("part"), status.alias("status"))


def occurrence_ledger(packets: DataFrame, id_col: str, atoms_col: str) -> DataFrame:
    """(id, place, kind, text): the atoms (action, consequence) of a packet in order, each its action and then its
    consequence; empty sides give no row but keep their place."""
    sides = F.flatten(F.transform(atoms_col, lambda a: F.array(F.struct(F.lit("action").alias("kind"), a["action"].alias("text")), F.struct(F.lit("consequence").alias("kind"), a["consequence"].alias("text")))))
    t = packets.select(F.col(id_col).alias("id"), F.posexplode(sides).alias("place", "x")).select("id", "place", "x.*")
    return t.where(F.length("text") > 0)


def merge_layers(layers: DataFrame, scalars: Sequence[str], lists: Sequence[str], scratch: Scratch | None = None) -> DataFrame:
    """(profile, depth, scalars, lists) of every profile of a table (profile, extends, scalars, lists, version): a scalar is the
    non-empty value nearest to the profile in its chain of bases, a list the union in order from the last base on.

    A chain that comes back to one of its layers, a base that isn't in the table, or layers of different versions are errors. Chains may be
    of any length: each round adds one layer to those that go on and is written.
    """
    scratch = scratch or Scratch(layers.sparkSession, "layers")
    own = F.struct("version", *scalars, *lists)
    base = layers.select(F.col("profile").alias("b"), F.col("extends").alias("up"), own.alias("layer"))
    state = scratch.keep(layers.select("profile", "extends", F.array("profile").alias("path"), F.array(own).alias("chain")), "chains")
    done = state.where("extends is null")
    while not (state := state.where("extends is not null")).isEmpty():
        joined = state.join(base, F.col("extends") == F.col("b"), "left")
        checked = (
            F.when(F.col("b").isNull(), F.raise_error(F.concat(F.lit("unknown base "), F.col("extends").cast("string"))))
            .when(F.array_contains("path", F.col("b")), F.raise_error(F.concat(F.lit("a cycle at "), F.col("b").cast("string"))))
            .otherwise(F.concat("chain", F.array("layer")))
        )
        state = scratch.keep(joined.select("profile", F.col("up").alias("extends"), F.concat("path", F.array("b")).alias("path"), checked.alias("chain")), "chains")
        done = done.unionByName(state.where("extends is null"))
    versions = F.size(F.array_distinct(F.transform("chain", lambda x: x["version"])))
    chain = F.when(versions > 1, F.raise_error(F.lit("layers of different versions"))).otherwise(F.col("chain"))
    nearest = lambda c: F.coalesce(F.get(F.filter("chain", lambda x: F.length(F.trim(x[c])) > 0), F.lit(0))[c], F.lit(""))
    union = lambda c: F.array_distinct(F.flatten(F.transform(F.reverse("chain"), lambda x: F.coalesce(x[c], F.array().cast("array<string>")))))
    return done.withColumn("chain", chain).select("profile", F.size("chain").alias("depth"), *[nearest(c).alias(c) for c in scalars], *[union(c).alias(c) for c in lists])


def provenance_gate(docs: DataFrame, registered: DataFrame, id_col: str, text_col: str, keys: Sequence[str]) -> DataFrame:
    """(id, observed, passed): the hash of a text, null if it is empty, and whether it equals the one that is ``registered`` (keys, expected) for its
    keys. A text that nothing is registered for, a null key and an empty text fail; of several registered hashes one has to match."""
    seen = F.when(F.length(text_col) > 0, F.sha2(F.col(text_col).cast("binary"), 256))
    r = registered.groupBy(*keys).agg(F.collect_set("expected").alias("__expected"))
    j = docs.select(F.col(id_col), *keys, seen.alias("observed")).join(r, list(keys), "left")
    return j.select(id_col, "observed", F.coalesce(F.array_contains("__expected", F.col("observed")), F.lit(False)).alias("passed"))
