"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a
word is the sum, over all ways to cut it into pieces, of the product of their probabilities, which
a forward pass gives in time proportional to its length; a text's log-likelihood adds up its words
and all languages are equally likely beforehand. Piece probabilities are fitted by expectation
maximisation (forward-backward) on word counts of a bounded sample, about ``rows_per_lang``
documents of each language taken by a hash of the id; every text is then scored whole, distinct
words of a chunk once, words of any length over all their segmentations. Of the vocabulary those
pieces count that can stand in a word: letters and other bytes beyond ASCII, after a space or not.
The model holds a number per piece and language, about 0.35 MB a language.

Defined cases: a null text and a text without any letter give ``und`` with score 0; a null language
isn't learned; without any learned language everything is ``und``; of equally likely languages the
first by name is predicted; the fit (only) cuts words of more than ``TAUGHT`` bytes; columns named
lang_pred and score are replaced; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusx.llm.kernels import LETTER, ONE, Words, beside, chunks, mix, powers, separators
from corpusx.scratch import Scratch, small_batches

#: Anything in ASCII that isn't a letter.
NOT_LETTER = separators(bytes(b for b in range(128) if not chr(b).isalpha()))
IN_WORD = re.compile(rb"\x20|\x20?[a-z\x80-\xff]+")
#: Bytes of a word that teach at once: longer ones are fitted on in pieces, and scored whole.
TAUGHT = 32
#: Words up to so many bytes are batched by their exact length, longer ones by powers of two; positions of a long
#: word that are handled at once, and bytes of a batch. None changes the result.
EXACT, BLOCK, BATCH = 48, 4096, 640_000
#: Languages whose sampling shares are broadcast; beyond that texts and shares are shuffled.
MOST_LANGS = 10_000
KNOWN_WORDS = 250_000
_WORKER: dict[str, Scorer] = {}


def read_pieces(path: str) -> list[bytes]:
    """Pieces of a public vocabulary file of ranks that can stand in a word, lower-cased in ASCII, without repeats."""
    with open(path, "rb") as f:
        found = {base64.b64decode(line.split()[0]).lower() for line in f if line.strip()} | {bytes([b]) for b in range(256)}
    return sorted(x for x in found if IN_WORD.fullmatch(x))


def piece_hash(p: bytes) -> np.uint64:
    b = np.frombuffer(p, np.uint8)
    with np.errstate(over="ignore"):
        return mix(np.array([(LETTER[b] * powers(len(b))[np.arange(len(b))]).sum(dtype=np.uint64)]) + np.uint64(len(b)) * ONE)[0]


@dataclass
class Pieces:
    """Sorted piece hashes with a table that turns most other strings away."""

    hashes: np.ndarray
    longest: int
    seen: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash; len(hashes) if there is none."""
        out = np.full(h.shape, len(self.hashes), np.int32)
        at = np.flatnonzero(self.seen[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        x = h.reshape(-1)[at]
        i = np.minimum(np.searchsorted(self.hashes, x), len(self.hashes) - 1)
        out.reshape(-1)[at] = np.where(self.hashes[i] == x, i, len(self.hashes))
        return out

    def lattice(self, letters: np.ndarray) -> list[np.ndarray]:
        """For words of one length (rows of bytes): by piece length, the piece number at each start."""
        n, size = letters.shape
        value = LETTER[letters]
        out = []
        acc = np.zeros((n, size), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(min(size, self.longest)):
                acc = acc[:, : size - k] + value[:, k:] * powers(k + 1)[k]
                out.append(self.numbers(mix(acc + np.uint64(k + 1) * ONE)))
        return out


def forward(lattice: list[np.ndarray], probability: np.ndarray) -> np.ndarray:
    """(words, positions, languages): probability of everything up to a position.

    probability: (pieces + 1, languages), the last row 0.
    """
    n, size = lattice[0].shape
    a = np.zeros((n, size + 1, probability.shape[1]))
    a[:, 0] = 1
    for end in range(1, size + 1):
        for k in range(min(end, len(lattice))):
            a[:, end] += a[:, end - k - 1] * probability[lattice[k][:, end - k - 1]]
    return a


def log_probability(pieces: Pieces, letters: np.ndarray, size: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """(words, languages): log of the sum over all segmentations of rows of bytes, of which the first ``size`` count.

    The forward pass goes on block by block from the last ``longest`` positions, scaled to avoid underflow.
    """
    n, width = letters.shape
    reach = pieces.longest
    carry = np.ones((n, 1, probability.shape[1]))
    scale, out = np.zeros((n, probability.shape[1])), np.zeros((n, probability.shape[1]))
    ends = set(size.tolist())
    for start in range(0, width, BLOCK):
        stop, base = min(width, start + BLOCK), max(0, start - reach)
        lattice = pieces.lattice(letters[:, base:stop])
        a = np.zeros((n, stop - base + 1, probability.shape[1]))
        a[:, : start - base + 1] = carry
        for end in range(start + 1, stop + 1):
            i = end - base
            for k in range(min(i, len(lattice))):
                a[:, i] += a[:, i - k - 1] * probability[lattice[k][:, i - k - 1]]
            if end % 16 == 0:
                live = a[:, max(0, i + 1 - reach) : i + 1]
                peak = live.max(1)
                peak[peak == 0] = 1
                live /= peak[:, None]
                scale += np.log(peak)
            if end in ends:
                hit = size == end
                out[hit] = np.log(np.maximum(a[hit, i], 1e-300)) + scale[hit]
        carry = a[:, max(0, stop - reach) - base :].copy()
    return out


def expected(lattice: list[np.ndarray], p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece over words that occur ``weight`` times, one language."""
    n, size = lattice[0].shape
    p = p.reshape(-1, 1)
    a = forward(lattice, p)[:, :, 0]
    b = np.zeros((n, size + 1))
    b[:, size] = 1
    flat = p[:, 0]
    for start in range(size - 1, -1, -1):
        for k in range(min(size - start, len(lattice))):
            b[:, start] += flat[lattice[k][:, start]] * b[:, start + k + 1]
    out = np.zeros(len(p))
    scale = weight / np.maximum(a[:, size], 1e-300)
    for start in range(size):
        for k in range(min(size - start, len(lattice))):
            use = a[:, start] * flat[lattice[k][:, start]] * b[:, start + k + 1] * scale
            out += np.bincount(lattice[k][:, start], weights=use, minlength=len(out))
    return out


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of words, their bytes, their sizes) in batches of similar length, zeros behind the shorter ones."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    width = np.where(size <= EXACT, size, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    for s in np.unique(width).tolist():
        i = np.flatnonzero(width == s)
        for at in np.array_split(i, -(-len(i) // max(1, BATCH // s))):
            yield at, np.frombuffer(b"".join(words[j].ljust(s, b"\0") for j in at), np.uint8).reshape(len(at), s), size[at]


@dataclass
class Model:
    uid: str
    langs: list[str]
    pieces: np.ndarray
    longest: int
    probability: np.ndarray


class Scorer:
    """Log-probabilities of words under a model, kept for the first words that a worker meets."""

    def __init__(self, model: Model) -> None:
        self.model, self.pieces = model, Pieces(model.pieces, model.longest)
        self.known, self.scores = np.zeros(0, np.uint64), np.zeros((0, len(model.langs)), np.float32)

    def of_words(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.model.langs)), np.float32)
        for at, letters, size in by_length(words):
            out[at] = log_probability(self.pieces, letters, size, self.model.probability)
        return out

    def of_texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages): log-likelihoods of a chunk."""
        w = Words(data, offsets, NOT_LETTER)
        rows = len(offsets) - 1
        if not len(w.start):
            return np.zeros((rows, len(self.model.langs)))
        distinct, sample, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
        score = np.zeros((len(distinct), len(self.model.langs)), np.float32)
        at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        old = self.known[at] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        score[old] = self.scores[at[old]]
        new = np.flatnonzero(~old)
        letters = w.letters.tobytes()
        first, size = w.first[sample[new]], w.size[sample[new]]
        score[new] = self.of_words([b" " + letters[i : i + n] for i, n in zip(first.tolist(), size.tolist(), strict=True)])
        if len(self.known) < KNOWN_WORDS:
            every, s = np.concatenate([self.known, distinct[new]]), np.concatenate([self.scores, score[new]])
            order = np.argsort(every)
            self.known, self.scores = every[order], s[order]
        return np.stack([np.bincount(w.doc, weights=score[which, k], minlength=rows) for k in range(len(self.model.langs))], 1)


def sample_rows(docs: DataFrame, rows_per_lang: int, scratch: Scratch) -> DataFrame:
    """(lang, text) of about so many rows a language, by a hash of the id. Languages are counted without
    their texts, and texts aren't shuffled while the languages are few enough to be broadcast."""
    known = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    share = known.groupBy("lang").agg((F.lit(float(rows_per_lang)) / F.count("*")).alias("share")).withColumnRenamed("lang", "of_lang")
    share = scratch.keep(share, "shares")
    if share.count() <= MOST_LANGS:
        share = F.broadcast(share)
    drawn = (F.crc32(F.concat(F.lit("lang:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) / 4294967296.0) < F.col("share")
    return known.join(share, F.col("lang") == F.col("of_lang")).where(drawn).select("lang", "text")


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n), counted per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), dtype=object)
            for lo, hi, data, offsets in chunks(b.column(1)):
                w = Words(data, offsets, NOT_LETTER, TAUGHT)
                names, code = np.unique(langs[lo:hi], return_inverse=True)
                if not len(w.start):
                    continue
                key = mix(w.hashes() + code[w.doc].astype(np.uint64))
                _, at, n = np.unique(key, return_index=True, return_counts=True)
                letters = w.letters.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[code[w.doc[at]]], pa.string()), pa.array([letters[i : i + s] for i, s in zip(w.first[at].tolist(), w.size[at].tolist(), strict=True)], pa.binary()), pa.array(n)],
                    ["lang", "word", "n"],
                )

    return rows.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, vocabulary: str, rows_per_lang: int = 1500, rounds: int = 2, smooth: float = 0.05, scratch=None) -> Model:
    """Piece probabilities per language. The driver gets at most one number per piece and language."""
    scratch = scratch or Scratch(docs.sparkSession, "langid")
    words = scratch.keep(word_counts(sample_rows(docs, rows_per_lang, scratch)), "words")
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    pieces = read_pieces(vocabulary)
    hashes, longest = np.sort(np.array([piece_hash(p) for p in pieces], np.uint64)), max(map(len, pieces))
    prob = np.full((len(hashes) + 1, len(langs)), 1 / len(hashes))
    prob[-1] = 0
    for _ in range(rounds if langs else 0):
        shared = docs.sparkSession.sparkContext.broadcast(Model("", langs, hashes, longest, prob))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            pieces = Pieces(m.pieces, m.longest)
            total = np.zeros_like(m.probability)
            for b in batches:
                lang, n = b.column(0).to_pylist(), b.column(2).to_numpy(zero_copy_only=False).astype(float)
                every = [b" " + x for x in b.column(1).to_pylist()]
                for k, name in enumerate(m.langs):
                    own = np.array([i for i, x in enumerate(lang) if x == name], np.int64)
                    for at, letters, _ in by_length([every[i] for i in own]):
                        total[:, k] += expected(pieces.lattice(letters), m.probability[:, k], n[own[at]])
            piece, k = np.nonzero(total[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(k), pa.array(total[piece, k])], ["piece", "lang", "uses"])

        uses = words.mapInArrow(run, "piece long, lang long, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toArrow()
        count = np.zeros((len(hashes), len(langs)))
        count[uses["piece"].to_numpy(), uses["lang"].to_numpy()] = np.round(uses["uses"].to_numpy(), 6)
        prob = np.vstack([(count + smooth) / (count.sum(0) + smooth * len(hashes)), np.zeros(len(langs))])
    scratch.drop_all_but()
    return Model(str(hash((len(langs), prob.tobytes()))), langs, hashes, longest, prob)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, the probability of that language given the text."""
    small_batches(docs.sparkSession)
    docs, at, names = beside(docs, text_col, ["lang_pred", "score"])
    text_col = docs.columns[at]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lettered = docs.withColumn("__lettered", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if m.uid not in _WORKER:
            _WORKER.clear()
            _WORKER[m.uid] = Scorer(m)
        scorer = _WORKER[m.uid]
        for b in batches:
            best, score = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            if m.langs:
                for lo, hi, data, offsets in chunks(b.column(at)):
                    ll = scorer.of_texts(data, offsets)
                    best[lo:hi] = ll.argmax(1)
                    score[lo:hi] = 1 / np.exp(ll - ll.max(1, keepdims=True)).sum(1)
            ok = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False) & bool(m.langs)
            pred = [m.langs[i] if o else "und" for i, o in zip(best.tolist(), ok.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(pred), pa.array(np.where(ok, score, 0.0))], [*names, "lang_pred", "score"])

    return lettered.mapInArrow(run, docs.select(*names, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)


def part(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


def op6_langid(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(part(F.col("doc_id")) != 2), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (part(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")
