"""What is said and how: quotes with their speakers, families of cadence, likeness of voices.

Spans are found in the row of their text (``functions.spans``), so texts aren't shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusx.functions.spans import WORDS, spans_of, without_overlap
from corpusx.functions.text import tokenize

#: Fixed value: quotes of two characters or more within a line.
QUOTES = r'“([^”\n]{2,})”|"([^"\n]{2,})"'


def attributed_quotes(
    docs: DataFrame, before: str, after: str, id_col: str = "doc_id", text_col: str = "text", quote: str = QUOTES, reach: tuple[int, int] = (140, 100),
) -> DataFrame:
    """(id, nth, start, stop, quoted, speaker): quotes with offsets (of the marks) and who says them.

    The speaker is the first group of ``before`` in the ``reach[0]`` characters before the quote, else of ``after`` in the
    ``reach[1]`` characters after it; null if neither is found. Both should be anchored to the quote. A null text has no quotes.
    """
    marks, ahead, behind = regex.compile(quote), regex.compile(before), regex.compile(after)

    def find(text: str) -> Iterator[tuple]:
        for nth, m in enumerate(marks.finditer(text)):
            cue = ahead.search(text[max(0, m.start() - reach[0]) : m.start()]) or behind.search(text[m.end() : m.end() + reach[1]])
            said = next((g for g in m.groups() if g is not None), m.group())
            yield nth, m.start(), m.end(), said, cue.group(1) if cue else None

    return spans_of(docs, id_col, text_col, "nth int, start int, stop int, quoted string, speaker string", find)


def cadence_families(docs: DataFrame, families: Mapping[str, Sequence[str]], most: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, family, hits, rate, evidence): hits of the patterns of each family, per thousand words, and the first ``most`` of them.

    Of hits of one family that overlap, that of the pattern named first counts, the others don't; those of different families
    may overlap. Every text has a row for each family; a null text is empty.
    """
    compiled = {f: [regex.compile(p) for p in patterns] for f, patterns in families.items()}

    def find(text: str) -> Iterator[tuple]:
        words = max(1, sum(1 for _ in WORDS.finditer(text)))
        for family, patterns in compiled.items():
            kept = without_overlap([[m.span() for m in p.finditer(text)] for p in patterns])
            yield family, len(kept), round(1000.0 * len(kept) / words, 6), [text[a:b] for a, b in kept[:most]]

    return spans_of(docs, id_col, text_col, "family string, hits bigint, rate double, evidence array<string>", find)


def voice_similarity(said: DataFrame) -> DataFrame:
    """(grp, voice_a, voice_b, cosine, vocabulary): likeness of every two voices of a group by the words of their texts.

    said: (grp, voice, text); rows without a voice are left out. cosine is of word counts, vocabulary the Jaccard similarity of the
    words; a voice without words is like nobody. Voices of a group meet on the words that they share.
    """
    t = said.where("voice is not null").select("grp", "voice", F.explode(tokenize(F.col("text"))).alias("tok")).groupBy("grp", "voice", "tok").agg(F.count("*").alias("n"))
    norm = t.groupBy("grp", "voice").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"), F.count("*").alias("size"))
    a = t.select("grp", "tok", F.col("voice").alias("voice_a"), F.col("n").alias("x"))
    b = t.select("grp", "tok", F.col("voice").alias("voice_b"), F.col("n").alias("y"))
    p = a.join(b, ["grp", "tok"]).where("voice_a < voice_b").groupBy("grp", "voice_a", "voice_b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.count("*").alias("common"))
    for side in ("a", "b"):
        p = p.join(norm.toDF("grp", f"voice_{side}", f"n{side}", f"c{side}"), ["grp", f"voice_{side}"])
    return p.select("grp", "voice_a", "voice_b", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6).alias("cosine"), F.round(F.col("common") / (F.col("ca") + F.col("cb") - F.col("common")), 6).alias("vocabulary"))
