"""Personal data by candidate gradient boosting, with DataFrame functions only.

High-recall generators propose overlapping spans of four kinds; features of format and context turn
each into a small tuple; boosted regression trees are grown on the counts of distinct tuples and
come back as SQL expressions; a threshold per kind, calibrated on documents that didn't train,
selects what is redacted. Every feature has few values, so that a kind has at most ``MOST_TUPLES``
tuples however large the corpus is, and all of them count.

There are no labels for spans. Spans that pass the strict base rules teach as positives. Reliable
negatives are candidates that can't be what they look like: numbers of the right length that fail
the checksum, addresses with parts over 255, too few or too many digits, names at hosts without a
domain, and what a word before it calls a version, an order or the like. All other candidates (spelt-out ``(at)`` and ``[dot]``, 00 for +, numbers grouped by dots) are
unlabelled: they don't teach, and the trees decide about them. What defines a base match or a
reliable negative (the checksum, parts over 255, those words, the + and the @) is no feature, so the trees have to
learn the format and the surroundings. Base spans always stay; an unlabelled candidate that reaches
the threshold and overlaps no base span of its kind is added; of added spans that overlap, the
first stays, of those that start together the longest.

Defined cases: a null text counts as empty and has no spans; offsets are code points, end exclusive;
rows that repeat give repeated results; a corpus without candidates, or with one class only, yields
no model and no added spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusx.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
#: The base expressions, written so that a failed start isn't tried again inside the same run of
#: characters; matches are the same.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators of candidates; spans of one kind may overlap.
WIDE = {
    "email": [r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)*+"],
    "ip": [r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){3,5}", r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"],
    "card": [r"(?<![0-9])[0-9]{3,19}(?:[\x20.-][0-9]{2,7}){0,5}", r"(?<![0-9])[0-9]{14,19}(?![0-9])"],
    "phone": [r"(?:\+|\b00|\()?(?<![0-9])[0-9]{1,4}[\x20().0-9/-]{5,20}[0-9]"],
}
#: Cheap tests without which no pattern of the kind can match.
MAYBE = {
    "email": lambda t: t.contains("@") | t.contains("(at)") | t.contains("[at]"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20.-]?[0-9]){11}"),
    "phone": lambda t: t.rlike(r"[0-9][\x20().0-9/-]{5}"),
}
#: Words before a span that speak for personal data, and for other numbers.
CUES = r"(?i)(?:mail|call|tel|phone|mobile|fax|contact|card|visa|account|pay|ip|host|server|address|reach)[^A-Za-z]{0,4}$"
OTHER = r"(?i)(?:version|ver|v|no|nr|order|invoice|item|part|serial|page|section|build|id|isbn)[^A-Za-z]{0,3}$"
TREES, DEPTH, RATE, PRECISION, WIDTH = 24, 3, 0.3, 0.98, 128
#: Distinct feature tuples of a kind: the product of the numbers of values in ``features``, both labels, both folds.
MOST_TUPLES = 5 * 8 * 5 * 8 * 2 * 4 * 4


def prefix_sums(lengths: Column, width: int = 128) -> Column:
    """Running sums of an array, in work that grows with its length: sums within pieces of
    ``width``, then the pieces' offsets."""
    grow = lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0).cast("bigint")) + x))
    none = F.array().cast("array<bigint>")
    pieces = F.transform(F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(width)), lambda o: F.slice(lengths, o + 1, width))
    inner = F.transform(pieces, lambda c: F.aggregate(c, none, grow))
    return F.when(F.size(lengths) == 0, none).otherwise(
        F.flatten(
            F.zip_with(
                inner,
                F.slice(F.aggregate(inner, F.array(F.lit(0).cast("bigint")), lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + F.element_at(c, -1)))), 1, F.size(pieces)),
                lambda c, b: F.transform(c, lambda x: x + b),
            )
        )
    )


def find(df: DataFrame, text: str, patterns: dict[str, tuple[Column, str]]) -> DataFrame:
    """``df`` with an array of (start, end, hit, before, after) for each (guard, pattern)."""
    for name, (guard, pattern) in patterns.items():
        empty = F.array().cast("array<string>")
        df = df.withColumns({
            f"__hits_{name}": F.when(guard, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(empty),
        }).withColumns({f"__gaps_{name}": F.when(F.size(f"__hits_{name}") > 0, F.split(F.col(text), pattern, -1)).otherwise(empty)})
    for name in patterns:
        hits, gaps = F.col(f"__hits_{name}"), F.col(f"__gaps_{name}")
        df = df.withColumn(f"__steps_{name}", F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: (F.length(g) + F.length(h)).cast("bigint")))
    for name in patterns:
        df = df.withColumn(f"__ends_{name}", F.when(F.size(f"__hits_{name}") > 0, prefix_sums(F.col(f"__steps_{name}"))).otherwise(F.array().cast("array<bigint>")))
    made = {}
    for name in patterns:
        hits, gaps = F.col(f"__hits_{name}"), F.col(f"__gaps_{name}")
        sides = F.zip_with(F.slice(gaps, 1, F.size(hits)), F.slice(gaps, 2, F.size(hits)), lambda b, a: F.struct(F.right(b, F.lit(16)).alias("before"), F.left(a, F.lit(1)).alias("after")))
        placed = F.zip_with(hits, F.col(f"__ends_{name}"), lambda h, e: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("hit")))
        made[name] = F.zip_with(placed, sides, lambda p, s: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["hit"].alias("hit"), s["before"].alias("before"), s["after"].alias("after")))
    df = df.withColumns(made)
    return df.drop(*[f"__{k}_{n}" for n in patterns for k in ("hits", "gaps", "steps", "ends")])


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of x pass the check: every second one from the right counts double."""
    d = F.split(F.reverse(digits(x)), "")
    worth = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(worth, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


VALID = {
    "email": lambda h: F.lit(True),
    "ip": lambda h: F.forall(F.split(h, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255)),
    "card": lambda h: F.length(digits(h)).between(14, 19) & luhn(h),
    "phone": lambda h: F.length(digits(h)).between(10, 15),
}


def steps(x: Column, *edges: int) -> Column:
    """How many of the edges x reaches."""
    out = F.lit(0)
    for e in edges:
        out = out + (x >= e).cast("int")
    return out


def features(kind: str, c: Column) -> dict[str, Column]:
    """Small integers of format and context; the same names for all kinds."""
    hit, groups = c["hit"], F.filter(F.split(c["hit"], "[^0-9A-Za-z]+"), lambda g: F.length(g) > 0)
    flag = lambda x: x.cast("int")
    return {
        "groups": steps(F.size(groups), 2, 3, 4, 6),
        "longest": steps(F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), 2, 3, 4, 5, 7, 10, 14),
        "last": steps(F.length(F.coalesce(F.try_element_at(groups, F.lit(-1)), F.lit(""))), 2, 3, 4, 5),
        "separators": flag(hit.contains(" ")) + 2 * flag(hit.contains("-")) + 4 * flag(hit.contains("(") & ~hit.rlike(r"\(at\)|\(dot\)")),
        "cue": flag(c["before"].rlike(CUES)),
        "glued": flag(c["before"].rlike(r"[A-Za-z0-9=_#/\"'-]$")) + 2 * flag(c["after"].rlike(r"[A-Za-z0-9_@/\"'-]")),
    }


NAMES = ("groups", "longest", "last", "separators", "cue", "glued")


def impossible(kind: str, c: Column) -> Column:
    """Candidates that can't be personal data of the kind by their form, or that are said to be another number."""
    hit, n = c["hit"], F.length(digits(c["hit"]))
    parts = F.split(hit, r"\.")
    by_form = {
        "email": ~hit.rlike(r"\.|\(dot\)|\[dot\]"),
        "ip": (F.size(parts) != 4) | F.exists(parts, lambda p: (F.length(p) > 3) | (p.cast("int") > 255)),
        "card": ~n.between(12, 19) | ~luhn(hit),
        "phone": ~n.between(7, 15) | hit.rlike(r"^[0-9]+(?:\.[0-9]+){3,}$"),
    }
    return by_form[kind] | c["before"].rlike(OTHER)


def annotate(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, base arrays per kind, candidate arrays per kind with features and the base's verdict)."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    t = F.col("__t")
    df = df.withColumns({f"__m_{k}": MAYBE[k](t) for k in KINDS})
    df = find(df, "__t", {f"base_{k}": (F.col(f"__m_{k}"), BASE[k]) for k in KINDS} | {f"wide_{k}_{i}": (F.col(f"__m_{k}"), p) for k in KINDS for i, p in enumerate(WIDE[k])})
    df = df.withColumns({f"wide_{k}": F.array_distinct(F.concat(*[f"wide_{k}_{i}" for i in range(len(WIDE[k]))])) for k in KINDS})
    df = df.withColumns({f"base_{k}": passed(k) for k in KINDS})
    df = df.withColumns({f"pieces_{k}": pieces(F.col(f"base_{k}")) for k in KINDS})
    return df.withColumns({f"wide_{k}": described(k) for k in KINDS}).select("doc_id", *[f"base_{k}" for k in KINDS], *[f"wide_{k}" for k in KINDS])


def passed(kind: str) -> Column:
    """Matches of a base expression that are valid."""
    return F.transform(F.filter(f"base_{kind}", lambda s: VALID[kind](s["hit"])), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def pieces(spans: Column) -> Column:
    """An array cut into pieces of ``WIDTH``, in order."""
    none = F.filter(F.array(spans), lambda p: F.lit(False))
    return F.when(F.size(spans) == 0, none).otherwise(F.transform(F.sequence(F.lit(0), F.size(spans) - 1, F.lit(WIDTH)), lambda o: F.slice(spans, o + 1, WIDTH)))


def described(kind: str) -> Column:
    """Candidates with their label (1 a base span, 0 impossible, else null), whether they touch a base span
    of the kind, and their features. A base span is looked for among pieces of ``WIDTH`` base spans, then in one."""
    # the last base span that starts before the candidate's end: base spans don't overlap and are in order
    last_before = lambda end: F.try_element_at(F.filter(F.try_element_at(F.filter(f"pieces_{kind}", lambda p: p[0]["start"] < end), F.lit(-1)), lambda b: b["start"] < end), F.lit(-1))
    spans = F.transform(f"wide_{kind}", lambda c: F.struct(c.alias("c"), last_before(c["end"]).alias("b")))
    label = lambda x: F.when((x["b"]["start"] == x["c"]["start"]) & (x["b"]["end"] == x["c"]["end"]), 1).when(F.coalesce(x["b"]["end"] > x["c"]["start"], F.lit(False)), None).when(impossible(kind, x["c"]), 0)
    taken = lambda x: F.coalesce(x["b"]["end"] > x["c"]["start"], F.lit(False))
    return F.transform(spans, lambda x: F.struct(x["c"]["start"].alias("start"), x["c"]["end"].alias("end"), label(x).alias("label"), taken(x).alias("taken"), *[v.alias(n) for n, v in features(kind, x["c"]).items()]))


# ---------------------------------------------------------------- boosting on counts


def grow(rows: list, residual: list[float], weight: list[float], hessian: list[float], depth: int):
    """A regression tree on (feature tuple) rows by exact splits; leaves are Newton steps."""
    total_g, total_h = sum(r * w for r, w in zip(residual, weight)), sum(h * w for h, w in zip(hessian, weight))
    leaf = max(-4.0, min(4.0, total_g / (total_h + 1.0)))
    if depth == 0 or len(rows) < 2:
        return leaf
    best = (1e-6, None)
    parent = total_g * total_g / (total_h + 1.0)
    for f in range(len(rows[0])):
        sums: dict[int, list[float]] = {}
        for x, r, w, h in zip(rows, residual, weight, hessian):
            s = sums.setdefault(x[f], [0.0, 0.0])
            s[0] += r * w
            s[1] += h * w
        g = h = 0.0
        for v in sorted(sums)[:-1]:
            g, h = g + sums[v][0], h + sums[v][1]
            gain = g * g / (h + 1.0) + (total_g - g) ** 2 / (total_h - h + 1.0) - parent
            if gain > best[0]:
                best = (gain, (f, v))
    if best[1] is None:
        return leaf
    f, v = best[1]
    sides = [[i for i, x in enumerate(rows) if (x[f] <= v) == low] for low in (True, False)]
    pick = lambda a, s: [a[i] for i in s]
    return (f, v, *[grow(pick(rows, s), pick(residual, s), pick(weight, s), pick(hessian, s), depth - 1) for s in sides])


def leaf_of(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(counts: list[tuple[tuple[int, ...], int, int, int]]) -> tuple[list, float]:
    """(trees, threshold) from (features, label, held-out flag, count) rows of one kind."""
    train = [(x, y, n) for x, y, held, n in counts if not held]
    if not train or len({y for _, y, _ in train}) < 2:
        return [], math.inf
    rows, labels, weight = [x for x, _, _ in train], [y for _, y, _ in train], [float(n) for _, _, n in train]
    score = [0.0] * len(rows)
    trees = []
    for _ in range(TREES):
        p = [1 / (1 + math.exp(-s)) for s in score]
        tree = grow(rows, [y - q for y, q in zip(labels, p)], weight, [q * (1 - q) for q in p], DEPTH)
        trees.append(tree)
        score = [s + RATE * leaf_of(tree, x) for s, x in zip(score, rows)]
    held = sorted(((sum(RATE * leaf_of(t, x) for t in trees), y, n) for x, y, h, n in counts if h), reverse=True)
    # lowest score down to which held-out candidates are as often positive as wanted
    threshold, right, seen = math.inf, 0, 0
    for s, y, n in held:
        right, seen = right + y * n, seen + n
        if right >= PRECISION * seen:
            threshold = s
    return trees, threshold


def tree_column(tree, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, v, low, high = tree
    return F.when(c[NAMES[f]] <= v, tree_column(low, c)).otherwise(tree_column(high, c))


def train(annotated: DataFrame) -> dict[str, tuple[list, float]]:
    """Trees and threshold per kind. The driver receives the counts of all distinct labelled feature
    tuples, at most ``MOST_TUPLES`` rows a kind."""
    tagged = lambda kind: F.transform(F.filter(f"wide_{kind}", lambda c: c["label"].isNotNull()), lambda c: F.struct(F.lit(kind).alias("kind"), c["label"].alias("label"), *[c[n].alias(n) for n in NAMES]))
    every = [tagged(k) for k in KINDS]
    rows = annotated.select((F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0).cast("int").alias("held"), F.explode(F.concat(*every)).alias("c"))
    found = rows.groupBy("c.kind", "c.label", "held", *[f"c.{n}" for n in NAMES]).agg(F.count("*").alias("n")).orderBy("kind", "label", "held", *NAMES).collect()
    return {k: boost([(tuple(r[n] for n in NAMES), r["label"], r["held"], r["n"]) for r in found if r["kind"] == k]) for k in KINDS}


def selected(kind: str, trees: list, threshold: float) -> Column:
    """Unlabelled candidates that touch no base span and reach the threshold, without those that start inside one before."""

    def score(c: Column) -> Column:
        total = F.lit(0.0)
        for t in trees:
            total = total + tree_column(t, c) * RATE
        return total

    found = F.filter(f"wide_{kind}", lambda c: ~c["taken"] & c["label"].isNull() & (score(c) >= threshold))
    order = F.array_sort(F.transform(found, lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("last"))))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    # in order of start, the longer first: a span stays if it starts after the end of all before it
    return F.aggregate(order, none, lambda kept, c: F.when(F.coalesce(F.try_element_at(kept, F.lit(-1))["end"] > c["start"], F.lit(False)), kept).otherwise(F.concat(kept, F.array(F.struct(c["start"].alias("start"), (-c["last"]).alias("end"))))))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Per row: doc_id, ``base`` and ``spans``, arrays of (start, kind number, end) in order."""
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    annotated = scratch.keep(annotate(docs, id_col, text_col), "candidates")
    model = train(annotated)
    numbered = lambda spans, n: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end")))
    base, more = [numbered(f"base_{k}", n) for n, k in enumerate(KINDS)], []
    for n, k in enumerate(KINDS):
        trees, threshold = model[k]
        if trees and threshold < math.inf:
            more.append(numbered(selected(k, trees, threshold), n))
    return annotated.select("doc_id", F.array_sort(F.concat(*base)).alias("base"), F.array_sort(F.concat(*base, *more)).alias("spans"))


def joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of_kind = lambda n: lambda s: s["kind"] == n
    counts = [F.size(F.filter("base", of_kind(n))).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
