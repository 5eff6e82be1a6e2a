"""Toxicity by a factorization machine over hashed terms.

Terms are words and the first 4 to 6 bytes of longer words, as 64-bit hashes; a document's features
are which of the model's terms it holds. The machine adds, to a weight per term, the inner product
of two terms' factors for every pair that occurs together, so that a pair can mean more than its
parts. Terms are chosen by document frequency and association with the label, and the machine is
fitted, on a bounded sample of labelled rows (``max_rows``, taken by a hash of the id); scoring
reads every document whole and broadcasts the model, whose size ``max_terms`` bounds.

Defined cases: a null or empty text has no terms and scores the intercept; a document without label
is scored and not learned from; a doc_id with several labels counts as toxic if one says so; without
labels of both classes, or terms that enough rows share, every score is the share of toxic rows (0 without
rows); rows that repeat give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusx.llm.kernels import NOT_WORD, Words, beside, chunks
from corpusx.scratch import small_batches

PREFIXES = (4, 5, 6)
SEEDS = tuple(np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0))


@dataclass
class Model:
    """terms: sorted 64-bit hashes; weight per term; factors per term."""

    terms: np.ndarray
    bias: float
    weight: np.ndarray
    factors: np.ndarray

    def __post_init__(self) -> None:
        #: which low 20 bits occur among the terms: most words are turned away by one look-up
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def score(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """Probabilities for (row, term number) pairs without repeats."""
        linear = np.bincount(row, weights=self.weight[term], minlength=rows)
        pairs = np.zeros(rows)
        for k in range(self.factors.shape[1]):
            v = self.factors[term, k]
            pairs += np.bincount(row, weights=v, minlength=rows) ** 2 - np.bincount(row, weights=v * v, minlength=rows)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pairs / 2, -30, 30)))


def hashed_terms(words: Words) -> list[np.ndarray]:
    """A hash per word for the whole word, and for each prefix of words that are longer."""
    out = [words.hashes()]
    for size, seed in zip(PREFIXES, SEEDS, strict=True):
        out.append(np.where(words.size > size, words.hashes(size) ^ seed, np.uint64(0)))
    return out


def term_sets(col: pa.Array, keep=None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row, hash) of the distinct terms of each text, chunk by chunk."""
    for lo, hi, data, offsets in chunks(col):
        w = Words(data, offsets, NOT_WORD)
        doc, h = [], []
        for x in hashed_terms(w):
            at = np.flatnonzero(x if keep is None else keep(x))
            doc.append(w.doc[at])
            h.append(x[at])
        doc, h = np.concatenate(doc), np.concatenate(h)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        yield lo, hi - lo, doc[new], h[new]


def sample_terms(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(toxic, terms) of at most ``max_rows`` labelled rows, the ones whose id hashes lowest."""
    y = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null and doc_id is not null")
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # at most max_rows small rows, so the documents need no shuffle
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, n, doc, h in term_sets(b.column(1)):
                cut = np.searchsorted(doc, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), pa.array([h[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["toxic", "terms"])

    return rows.mapInArrow(run, "toxic int, terms binary")


def choose_terms(bags: DataFrame, max_terms: int, least: int) -> DataFrame:
    """(term, df, pos): the terms most associated with the label among those in ``least`` rows or more.

    Counted per task before the shuffle, so that one frequent term costs a row per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            bag = [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
            if not sum(map(len, bag)):
                continue
            term, at = np.unique(np.concatenate(bag), return_inverse=True)
            df = np.bincount(at)
            pos = np.bincount(at, weights=np.repeat(y, [len(x) for x in bag]))
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(df), pa.array(pos.astype(np.int64))], ["term", "df", "pos"])

    counts = bags.mapInArrow(run, "term long, df long, pos long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("pos").alias("pos")).where(F.col("df") >= least)
    totals = bags.agg(F.count("*").alias("rows"), F.sum("toxic").alias("toxic_rows"))
    share = F.col("toxic_rows") / F.col("rows")
    lift = F.abs(F.col("pos") - F.col("df") * share) / F.sqrt(F.col("df") * share * (1 - share) + 1.0)
    return counts.join(F.broadcast(totals)).select("term", "df", "pos", lift.alias("lift")).orderBy(F.desc("lift"), "term").limit(max_terms)


def fit(bags: list[np.ndarray], toxic: np.ndarray, terms: np.ndarray, factors: int = 4, epochs: int = 60, l2: float = 2e-3) -> Model:
    """Full-batch Adam on the logistic loss, both classes weighing alike."""
    rng = np.random.default_rng(7)
    terms = np.sort(terms)
    at = [np.searchsorted(terms, b[np.isin(b, terms)]) for b in bags]
    row = np.repeat(np.arange(len(at)), [len(x) for x in at])
    term = np.concatenate(at) if at else np.zeros(0, np.int64)
    y, n, m = toxic.astype(float), len(bags), len(terms)
    model = Model(terms, 0.0, np.zeros(m), rng.normal(0, 0.02, (m, factors)))
    if not n or not m or y.min() == y.max():
        p = float(y.mean()) if n else 0.0
        return Model(np.zeros(0, np.uint64), float(np.log((p + 1e-9) / (1 - p + 1e-9))), np.zeros(0), np.zeros((0, factors)))
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    moments = [[np.zeros(1), np.zeros(1)], [np.zeros(m)] * 2, [np.zeros((m, factors))] * 2]
    for step in range(1, epochs + 1):
        g = (model.score(row, term, n) - y) * each
        sums = np.stack([np.bincount(row, weights=model.factors[term, k], minlength=n) for k in range(factors)], 1)
        gw = np.bincount(term, weights=g[row], minlength=m)
        gv = np.stack([np.bincount(term, weights=g[row] * (sums[row, k] - model.factors[term, k]), minlength=m) for k in range(factors)], 1)
        for i, (name, grad) in enumerate((("bias", np.array([g.sum()])), ("weight", gw + l2 / m * model.weight), ("factors", gv + l2 / m * model.factors))):
            moments[i] = [0.9 * moments[i][0] + 0.1 * grad, 0.99 * moments[i][1] + 0.01 * grad**2]
            delta = 0.1 * (moments[i][0] / (1 - 0.9**step)) / (np.sqrt(moments[i][1] / (1 - 0.99**step)) + 1e-8)
            setattr(model, name, float(model.bias - delta[0]) if name == "bias" else getattr(model, name) - delta)
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, max_terms: int = 4096, least: int = 4, scratch=None) -> Model:
    """Fit on at most ``max_rows`` labelled rows; the driver gets the chosen terms of those rows only."""
    from corpusx.scratch import Scratch

    bags = (scratch or Scratch(docs.sparkSession, "toxicity")).keep(sample_terms(docs, labels, max_rows), "terms")
    chosen = np.array([r["term"] for r in choose_terms(bags, max_terms, least).select("term").collect()], np.int64).view(np.uint64)
    wanted = np.sort(chosen)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [(x := np.frombuffer(t, np.uint64))[np.isin(x, wanted)].tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary())], ["toxic", "terms"])

    rows = bags.mapInArrow(cut, "toxic int, terms binary").toArrow().sort_by([("toxic", "ascending"), ("terms", "ascending")])
    return fit([np.frombuffer(x, np.uint64) for x in rows["terms"].to_pylist()], rows["toxic"].to_numpy(), wanted)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col``, the probability that the text is toxic, in place of a column of that name."""
    small_batches(docs.sparkSession)
    docs, at, names = beside(docs, text_col, [out_col])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    mask = np.uint64((1 << 20) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        keep = lambda x: m.seen[(x & mask).astype(np.int64)]
        for b in batches:
            out = np.zeros(b.num_rows)
            for lo, n, doc, h in term_sets(b.column(at), keep):
                if len(m.terms):
                    term = np.minimum(np.searchsorted(m.terms, h), len(m.terms) - 1)
                    known = m.terms[term] == h
                    doc, term = doc[known], term[known]
                else:
                    doc, term = doc[:0], np.zeros(0, np.int64)
                out[lo : lo + n] = m.score(doc, term, n)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(out)], [*names, out_col])

    return docs.mapInArrow(run, docs.select(*names, F.lit(0.0).alias(out_col)).schema)


def part(doc_id, of: int):
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of


def learned_rows(labels: DataFrame) -> DataFrame:
    return labels.where(part(F.col("doc_id"), 3) != 1)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, learned_rows(labels))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (part(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
