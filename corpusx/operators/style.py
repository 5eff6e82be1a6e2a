"""Style of texts: all surface metrics of a text in one pass, and how far each lies from a declared distribution.

Defined cases: a null text is an empty one, whose metrics are 0; a single sentence deviates by 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusx.functions.text import WORD_RUN, tokenize

#: A sentence ends with one of the marks, quotes that follow it and white space; a paragraph with a blank line; speech stands between quotation marks.
SENTENCE_GAP, PARAGRAPH_GAP, SPEECH = "[.!?][\"”’']*[ \\t\\n\\r\\f]+", "\\n[ \\t\\n\\r\\f]*\\n", "[“\"]([^”\"]+)[”\"]"
#: Metrics (name, marks) of marks in a thousand words.
MARKS = (("semicolons", "[;]"), ("dashes", "[—–]"), ("questions", "[?]"), ("exclamations", "[!]"))
FUNCTION_WORDS = ("a", "an", "and", "as", "at", "but", "by", "for", "from", "if", "in", "it", "of", "on", "or", "that", "the", "to", "was", "with")


def sizes(pieces: Column) -> Column:
    """Words of each piece that has any; they are counted, not made."""
    return F.filter(F.transform(pieces, lambda x: F.regexp_count(x, F.lit(WORD_RUN))), lambda n: n > 0)


def total(numbers: Column, of=lambda x: x) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + of(x.cast("long")))


def style_metrics(docs: DataFrame, id_col: str, text_col: str, function_words: Sequence[str] = FUNCTION_WORDS) -> DataFrame:
    """(id, words, sentences, mean_sentence, sentence_deviation, mean_paragraph, dialogue_ratio, semicolons, dashes, questions, exclamations, function_words):
    words of sentences and paragraphs, the part of the words in speech, marks in a thousand words, and the part of the words that each function word has."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    t = docs.select(
        F.col(id_col).alias("id"), F.regexp_count(text, F.lit(WORD_RUN)).cast("long").alias("words"), sizes(F.split(text, SENTENCE_GAP, -1)).alias("s"), sizes(F.split(text, PARAGRAPH_GAP, -1)).alias("p"),
        total(sizes(F.regexp_extract_all(text, F.lit(SPEECH), F.lit(1)))).alias("spoken"), *[F.regexp_count(text, F.lit(p)).alias(n) for n, p in MARKS],
        F.filter(tokenize(F.col(text_col)), lambda w: w.isin(*function_words)).alias("held"),
    )
    n, k = F.greatest(F.lit(1), "words"), F.greatest(F.lit(1), F.size("s"))
    t = t.select("id", "words", n.alias("n"), F.size("s").cast("long").alias("sentences"), (total(F.col("s")) / k).alias("mean"), (total(F.col("s"), lambda x: x * x) / k).alias("square"), (total(F.col("p")) / F.greatest(F.lit(1), F.size("p"))).alias("paragraph"), "spoken", *[m for m, _ in MARKS], "held")
    deviation = F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    rates = F.transform(F.array(*map(F.lit, function_words)), lambda w: F.round(F.size(F.filter("held", lambda x: x == w)) / F.col("n"), 6))
    return t.select(
        "id", "words", "sentences", F.round("mean", 4).alias("mean_sentence"), F.round(deviation, 4).alias("sentence_deviation"), F.round("paragraph", 4).alias("mean_paragraph"),
        F.round(F.col("spoken") / F.col("n"), 6).alias("dialogue_ratio"), *[F.round(1000.0 * F.col(m) / F.col("n"), 4).alias(m) for m, _ in MARKS], rates.alias("function_words"),
    )


#: Metrics that are single numbers.
NUMBERS = ("words", "sentences", "mean_sentence", "sentence_deviation", "mean_paragraph", "dialogue_ratio", *(m for m, _ in MARKS))


def distribution_diagnostics(metrics: DataFrame, profile: DataFrame, id_col: str, names: Sequence[str] = NUMBERS) -> DataFrame:
    """(id, metric, observed, target, tolerance, distance, within): every metric that has a mean and a tolerance in the profile (metric, mean, tolerance, stddev), how many
    tolerances it is from the mean, and whether that is one at most. Without a tolerance the standard deviation is it; neither is taken to be under 1e-9."""
    each = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("observed")) for n in names])
    rows = metrics.select(F.col(id_col).alias("id"), F.explode(each).alias("x")).select("id", "x.*")
    p = profile.select("metric", F.col("mean").cast("double").alias("target"), F.coalesce("tolerance", "stddev").cast("double").alias("tolerance")).where("target is not null and tolerance is not null")
    gap = F.abs(F.col("observed") - F.col("target")) / F.greatest("tolerance", F.lit(1e-9))
    return rows.join(F.broadcast(p), "metric").where("observed is not null").select("id", "metric", "observed", "target", "tolerance", F.round(gap, 4).alias("distance"), (gap <= 1).alias("within"))
