"""Text functions shared by all operators: one tokenizer with profiles, n-grams, windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word pattern shared by Java's and RE2's dialects, and the sentence end.
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_’'-]*[\p{L}\p{N}_])?"
#: As many matches as ``WORD`` in Java's dialect, without going back: it ends behind the marks that may follow a word.
WORD_RUN = r"[\p{L}\p{N}_][\p{L}\p{N}_’'-]*+"
PROFILES = {"words": WORD, "letters3": r"[a-z]{3,}", "keyword": r"[a-z][a-z'-]*", "space": r"[^\s]+"}


def tokenize(text: Column, profile: str = "words") -> Column:
    """Normalised words of a text; null gives an empty array."""
    t = F.coalesce(text, F.lit(""))
    if profile in ("letters3", "keyword"):
        return F.regexp_extract_all(F.lower(t), F.lit(PROFILES[profile]), F.lit(0))
    found = F.regexp_extract_all(t, F.lit(PROFILES[profile]), F.lit(0))
    if profile == "space":
        return found
    # words hold no space, so all of them are folded as one string
    folded = F.replace(F.replace(F.lower(F.array_join(found, " ")), F.lit("ß"), F.lit("ss")), F.lit("’"), F.lit("'"))
    return F.array_remove(F.split(folded, " ", -1), "")


def ngrams(tokens: Column, n: int) -> Column:
    """Positional n-grams, joined by a space; empty if there are fewer than n words."""
    if n <= 0:
        raise ValueError(f"n-grams need n >= 1, got {n}")
    at = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    return F.when(F.size(tokens) >= n, F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def window_hashes(words: Column, n: int) -> Column:
    """64-bit hash of every run of n words of an array, in order; empty if there are fewer than n.

    ``words`` must be a column of its own that holds the hash of each word (``word_hashes``), so that
    it isn't computed anew for every window.
    """
    at = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.xxhash64(F.slice(words, i, n)))).otherwise(F.array().cast("array<bigint>"))


def word_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.xxhash64(x))


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Jaccard similarity of two arrays as sets; ``empty`` if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def windows(tokens: Column, width: int, step: int, least: int) -> Column:
    """Structs (start, toks) of word windows; the last is the first that reaches the end."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - width) / step).cast("int") * step), F.lit(step))
    made = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(tokens, s + 1, width).alias("toks")))
    return F.filter(made, lambda w: F.size(w["toks"]) >= least)


def token_estimate(words: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(words * 1.36)).cast("long")


def uniform(seed: int, *key: Column) -> Column:
    """A number in (0, 1) by hash of seed and key, the same on every engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0


# ---- the same in DuckDB's dialect, for the SQL equivalents


def sql_tokens(text: str = "text") -> str:
    p = WORD.replace("'", "''")
    return f"list_transform(regexp_extract_all(coalesce({text}, ''), '{p}'), lambda x: replace(replace(lower(x), 'ß', 'ss'), '’', ''''))"


def sql_ngrams(tokens: str, n: int) -> str:
    return f"list_transform(range(1, len({tokens}) - {n - 2}), lambda i: array_to_string({tokens}[i:i+{n - 1}], ' '))"


def sql_uniform(seed: int, *key: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(key)})), 1, 8) AS BIGINT) + 0.5) / 4294967296.0"
