"""Secret scans over a document-partitioned trigram index.

From the syntax tree of each rule's regular expression a Boolean query over trigrams is derived
that any match must satisfy. Each block of documents is inverted in one reading of its bytes into
postings (trigram -> rows of the block) of the trigrams that the queries name; a rule's candidates are the intersections and unions of
postings that its query asks for, and only candidates are verified with the expression itself. A
rule without mandatory trigrams scans every row. The index is sharded by document, so nothing is
shuffled and a lost task rebuilds only its own block.

Defined cases: a null text counts as empty and has no spans; offsets are code points, end
exclusive; a rule's matches are leftmost and don't overlap, and those that fail its size condition
are dropped without another try; rows that repeat give repeated results; a very long text is verified whole, each expression passing it
once; a table without rows gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _parser as syntax

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusx.llm.kernels import LOWER, chunks
from corpusx.scratch import small_batches

TRUE: tuple = ("all",)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    @property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The base rules, in the order in which spans that start together are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
#: Further public credential formats.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}"),
)

# ---------------------------------------------------------------- trigram queries


def both(a: tuple, b: tuple) -> tuple:
    parts = [x for q in (a, b) if q != TRUE for x in (q[1:] if q[0] == "and" else [q])]
    parts = list(dict.fromkeys(parts))
    return TRUE if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def either(qs: list[tuple]) -> tuple:
    qs = list(dict.fromkeys(qs))
    return TRUE if TRUE in qs or not qs else qs[0] if len(qs) == 1 else ("or", *qs)


def of_strings(strings: set[str]) -> tuple:
    """Any of these strings occurs: all trigrams of one of them do."""
    found = []
    for s in sorted(strings):
        q = TRUE
        for i in range(len(s) - 2):
            q = both(q, ("tri", s[i : i + 3]))
        found.append(q)
    return either(found)


def cross(a: set[str] | None, b: set[str] | None, most: int = 64) -> set[str] | None:
    if a is None or b is None or len(a) * len(b) > most:
        return None
    return {x + y for x in a for y in b}


def walk(items, most: int = 16) -> tuple[set[str] | None, tuple]:
    """(all strings that the sequence can be, if few, else None; the query that any match meets)."""
    query, exact, run = TRUE, {""}, {""}
    for op, arg in items:
        strings, q = one(op, arg, most)
        exact = cross(exact, strings)
        joined = cross(run, strings)
        if joined is None:
            query = both(query, of_strings(run))
            run = strings if strings is not None else {""}
        else:
            run = joined
        query = both(query, q)
    return exact, both(query, of_strings(run))


def one(op, arg, most: int) -> tuple[set[str] | None, tuple]:
    name = str(op)
    if name == "LITERAL":
        return {chr(arg)}, TRUE
    if name == "IN":
        chars: set[str] | None = set()
        for kind, v in arg:
            if str(kind) == "LITERAL":
                chars.add(chr(v))
            elif str(kind) == "RANGE" and v[1] - v[0] < most:
                chars.update(map(chr, range(v[0], v[1] + 1)))
            else:
                return None, TRUE
        return (chars if len(chars) <= most else None), TRUE
    if name == "SUBPATTERN":
        return walk(arg[3], most)
    if name == "BRANCH":
        found = [walk(b, most) for b in arg[1]]
        exact = None if any(e is None for e, _ in found) else set().union(*(e for e, _ in found))
        return exact, either([q for _, q in found])
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, body = arg
        exact, q = walk(body, most)
        if (low, high) == (0, 1):
            return (None if exact is None else exact | {""}), TRUE
        if low == high == 1:
            return exact, q
        return None, (q if low else TRUE)
    return None, TRUE


def trigram_query(pattern: str, any_case: bool = False) -> tuple:
    """A Boolean query over lower-case trigrams that every text with a match satisfies."""
    _, q = walk(syntax.parse(pattern))

    def lower(x: tuple) -> tuple:
        return ("tri", x[1].lower()) if x[0] == "tri" else x if x == TRUE else (x[0], *dict.fromkeys(lower(y) for y in x[1:]))

    return lower(q)


def trigrams(q: tuple) -> set[str]:
    return {q[1]} if q[0] == "tri" else set().union(*(trigrams(x) for x in q[1:])) if q != TRUE else set()


class Postings:
    """The inverted index of a block: for each wanted trigram the sorted rows that hold it, in either case.

    Every text is read once: a number is formed of each three successive bytes, a table of all 2^24
    numbers says which trigram of the rules it is, and the (trigram, row) pairs that are left are
    sorted into postings.
    """

    def __init__(self, wanted: list[str]) -> None:
        self.wanted = {t: i for i, t in enumerate(wanted)}
        self.number = np.zeros(1 << 24, np.int16)
        for t, i in self.wanted.items():
            x, y, z = t.encode("ascii")
            self.number[x << 16 | y << 8 | z] = i + 1

    def build(self, texts: pa.Array) -> dict[str, np.ndarray]:
        pairs = [np.zeros(0, np.int64)]
        n = len(texts)
        for lo, _, data, offsets in chunks(texts):
            low = LOWER[data].astype(np.int32)
            found = self.number[low[:-2] << 16 | low[1:-1] << 8 | low[2:]] if len(low) > 2 else np.zeros(0, np.int16)
            at = np.flatnonzero(found)
            row = np.searchsorted(offsets, at, "right") - 1
            whole = at + 2 < offsets[row + 1]  # not across two texts
            pairs.append(np.unique((found[at[whole]].astype(np.int64) - 1) * n + lo + row[whole]))
        every = np.concatenate(pairs)
        every.sort()
        cut = np.searchsorted(every, np.arange(len(self.wanted) + 1) * n)
        return {t: every[cut[i] : cut[i + 1]] - i * n for t, i in self.wanted.items()}


def candidates(q: tuple, index: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Rows that satisfy a query, by intersecting and uniting postings."""
    if q == TRUE:
        return np.arange(n)
    if q[0] == "tri":
        return index[q[1]]
    out = None
    for x in sorted((candidates(x, index, n) for x in q[1:]), key=len):
        out = x if out is None else np.intersect1d(out, x, True) if q[0] == "and" else np.union1d(out, x)
    return out


def verify(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``spans``, an array of (kind, start, end) by start, then by the rules' order."""
    small_batches(docs.sparkSession)
    given = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    id_type = given.schema[0].dataType.simpleString()
    queries = [trigram_query(r.pattern, r.any_case) for r in rules]
    wanted = sorted(set().union(*map(trigrams, queries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, inverted = [r.regex for r in rules], Postings(wanted)
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                texts = b.column(1)
                index = inverted.build(texts)
                found: list[list] = [[] for _ in range(b.num_rows)]
                for k, (rule, q) in enumerate(zip(rules, queries, strict=True)):
                    for i in candidates(q, index, b.num_rows).tolist():
                        found[i] += [(s, k, e) for s, e in verify(rule, compiled[k], texts[i].as_py())]
                out = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(x)] for x in found]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], [id_col, "spans"])

    return given.mapInArrow(run, f"`{id_col}` {id_type}, spans array<struct<kind:string,start:long,end:long>>")


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    of_kind = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter("spans", of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def brute_force(text: str | None) -> tuple[list[tuple[str, int, int]], str]:
    """Base spans and their digest without an index, for tests."""
    found = sorted((s, k, e) for k, r in enumerate(BASE) for s, e in verify(r, r.regex, text or ""))
    spans = [(BASE[k].kind, s, e) for s, k, e in found]
    return spans, hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in spans).encode()).hexdigest()
