"""Spans of a text by offsets, for use in Arrow batches: what a regular expression can find but a column
expression can't number in linear time."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from corpusx.functions.text import WORD
from corpusx.scratch import small_batches

WORDS = regex.compile(WORD)
#: A sentence up to its end and the space after it, or what is left of a line.
UNIT = regex.compile(r"[^\n]*?(?:[.!?][\"”’]?(?:[ \n]|\Z)|\n|\Z)")


def folded(word: str) -> str:
    """A word as ``tokenize`` gives it."""
    return word.lower().replace("ß", "ss").replace("’", "'")


def spans_of(docs: DataFrame, id_col: str, text_col: str, fields: str, find: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """(id, *fields): a row for every tuple that ``find`` gives for the text of a row; null is empty.

    fields: schema of the tuples. Texts stay where they are read; a batch of rows is bounded by its bytes.
    """
    small_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"id {given.schema[0].dataType.simpleString()}, {fields}"
    types = StructType.fromDDL(fields)
    arrow = [to_arrow_type(f.dataType) for f in types.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(1)):
                for row in find(t.as_py()):
                    at.append(i)
                    rows.append(row)
                if len(rows) >= 50_000:
                    yield batch(b, at, rows)
                    at, rows = [], []
            yield batch(b, at, rows)

    def batch(b: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(arrow)
        values = [pa.array(list(c), t) for c, t in zip(columns, arrow, strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *values], ["id", *types.names])

    return given.mapInArrow(run, schema)


def causal_windows(text: str, least: int, most: int, paragraphs: int) -> Iterator[tuple[int, int, int]]:
    """(start, stop, words) of every run that begins with a line, ends with a sentence or a line and spans up to
    ``paragraphs`` lines that aren't blank, with ``least`` to ``most`` words. A start is followed until its words
    exceed ``most``, so the work grows with the text."""
    ends, words, starts, line, run, fresh = [], [], [], 0, 0, True
    lines = []  # number of the line that isn't blank, for each unit
    for m in UNIT.finditer(text):
        a, b = m.span()
        if a == b:
            continue
        unit = text[a:b]
        if unit.strip():
            if fresh:
                line += 1
                starts.append((a, len(ends), run))
                fresh = False
            run += sum(1 for _ in WORDS.finditer(unit))
            ends.append(b - 1 if unit[-1] in " \n" else b)
            words.append(run)
            lines.append(line)
        if unit[-1] == "\n":
            fresh = True
    for nth, (start, unit, before) in enumerate(starts):
        for i in range(unit, len(ends)):
            n = words[i] - before
            if n > most or lines[i] > nth + paragraphs:
                break
            if n >= least:
                yield start, ends[i], n


CLOSED = regex.compile(r"[.!?][\"”’']?\s*$")
OPENS = regex.compile(r"[\"“‘']|[A-Z]")


def complete_prefix(text: str, least: int, most: int) -> tuple[int, int, int] | None:
    """(start, stop, words) of the longest prefix of whole paragraphs with ``least`` to ``most`` words that ends a
    sentence and closes its quotation marks. A paragraph ends at a blank line, at the end, or at a line end between
    the end of a sentence and a capital or quotation mark. None if there is none."""
    start = len(text) - len(text.lstrip())
    found, words, at = None, 0, start
    ends = [m.start() for m in regex.finditer(r"\n", text[start:])] + [len(text) - start]
    for end in ends:
        piece = text[at : start + end]
        words += sum(1 for _ in WORDS.finditer(piece))
        at = start + end
        if words > most:
            break
        if words < least:
            continue
        said = text[start:at].rstrip() if not piece.strip() else piece.rstrip()
        rest = text[at:].lstrip(" \t\r\n")[:1] if at < len(text) else ""
        blank = regex.match(r"\n[^\S\n]*\n", text[at : at + 200]) is not None
        if not (at == len(text) or blank or OPENS.match(rest)) or not CLOSED.search(said):
            continue
        whole = text[start:at]
        if whole.count('"') % 2 == 0 and whole.count("“") == whole.count("”"):
            found = (start, start + len(whole.rstrip()), words)
    return found


def without_overlap(found: Sequence[Sequence[tuple[int, int]]]) -> list[tuple[int, int]]:
    """Spans of several patterns, those of earlier patterns first, less those that overlap one kept before; sorted.
    The spans of one pattern are sorted and don't overlap each other."""
    kept: list[tuple[int, int]] = []
    for spans in found:
        stops = [b for _, b in kept]
        new = []
        for a, b in spans:
            i = bisect_right(stops, a)  # the first kept span that ends after a
            if i == len(kept) or kept[i][0] >= b:
                new.append((a, b))
        kept = sorted(kept + new)
    return kept
