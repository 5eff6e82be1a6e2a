"""Language-model scores by prediction by partial matching (PPM) over byte contexts.

A text is read as its UTF-8 bytes and one end symbol. The trie of the training texts holds, for every
context of ``order`` preceding symbols (a start symbol stands before the text), how often each symbol
followed. A symbol that its longest known context has not seen costs the context's escape (as many
escapes as distinct symbols, method C) and is looked for in the next shorter context, where the
symbols already seen in the longer one are excluded; below order 0 all symbols left are alike. The
negative log10 probabilities of a text's symbols add up to its code length.

The trie is a table (gram, n) of its deepest edges: a gram packs ``order`` context symbols and the
symbol that follows into nine bits each, the latest lowest, so shorter contexts are suffixes that a
mask cuts out. It is counted over all training texts, per task first. Scoring broadcasts it in parts
of at most ``MOST_EDGES`` edges; a part is a set of contexts by their last two symbols, which holds
everything that those contexts escape to down to order 2, and goes with the edges of order 1, of which
there are 258 * 257 at most. With more parts than one the texts are read once a part, and each
pass adds the symbols of its part.

Defined cases: a null text counts as empty and has the end symbol alone; without training texts all 257
symbols are equally likely; very long texts are read in pieces; rows that repeat an id are scored
each by its own text; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusx.llm.kernels import chunks, mix
from corpusx.scratch import Scratch, small_batches

BITS, END, START, SYMBOLS = 9, 256, 257, 257
ORDER = 5
#: Positions that are sorted at a time, and distinct grams that a task holds before it hands them on.
SORTED, HELD = 1 << 20, 1 << 21
MOST_EDGES = 4_000_000
#: Bytes of a very long text that are read at a time.
PIECE = 1 << 20


def mask(symbols: int) -> int:
    return (1 << (BITS * symbols)) - 1


def runs(col: pa.Array, order: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, symbols, first place of each row) for runs of whole texts or a piece of a
    long one. Every row begins with ``order`` symbols of context."""
    for lo, hi, data, at in chunks(col):
        if len(data) <= PIECE:
            rows, gap = hi - lo, order + 1
            s = np.full(len(data) + rows * gap, START, np.int64)
            first = at[:-1] + np.arange(rows) * gap
            s[np.arange(len(data)) + np.repeat(np.arange(rows) * gap + order, np.diff(at))] = data
            s[at[1:] + np.arange(rows) * gap + order] = END
            yield lo, hi, s, first
            continue
        # a run of so many bytes is one long text, perhaps after short ones
        for r in range(hi - lo):
            text = data[at[r] : at[r + 1]]
            before = np.full(order, START, np.int64)
            for cut in range(0, max(1, len(text)), PIECE):
                piece = text[cut : cut + PIECE].astype(np.int64)
                last = cut + PIECE >= len(text)
                s = np.concatenate([before, piece, [END] if last else []]).astype(np.int64)
                yield lo + r, lo + r + 1, s, np.zeros(1, np.int64)
                before = s[len(s) - order :]


def grams(s: np.ndarray, order: int) -> np.ndarray:
    """The gram at every place of ``s`` that has ``order`` symbols before it."""
    out = s[order:].copy()
    for j in range(1, order + 1):
        out |= s[order - j : len(s) - j] << (BITS * j)
    return out


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(key)).astype(np.int64)


def count_grams(docs: DataFrame, order: int = ORDER, text_col: str = "text") -> DataFrame:
    """(gram, n): the deepest edges of the trie of all texts, counted per task first."""
    if not 2 <= order <= 6:
        raise ValueError("order must be 2 to 6")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, held = [], 0, []

        def fold() -> None:
            key, n = np.unique(np.concatenate(waiting), return_counts=True)
            held.append((key, n))
            waiting.clear()
            if sum(len(k) for k, _ in held) > HELD:
                held[:] = [merged(held)]

        def out() -> pa.RecordBatch:
            key, n = merged(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["gram", "n"])

        for b in batches:
            for _, _, s, _ in runs(b.column(0), order):
                g = grams(s, order)
                waiting.append(g[(g & mask(1)) != START])
                size += len(g)
                if size >= SORTED:
                    fold()
                    size = 0
                    if len(held[0][0]) > HELD // 2:
                        yield out()
        if waiting:
            fold()
        yield out()

    return docs.select(text_col).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Index:
    """Places of 64-bit keys in an open-addressing table; ``find`` gives -1 for a key that isn't there."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.place = np.full(1 << bits, -1, np.int32)
        self.keys = np.full(1 << bits, -1, np.int64)
        left = np.arange(len(keys))
        slot = self.slots(keys)
        while len(left):
            free = self.place[slot] < 0
            self.place[slot[free]] = left[free]  # of keys that meet in a slot the last stays
            self.keys[slot[free]] = keys[left[free]]
            lost = self.place[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.last

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slots(keys)
        out = np.where(self.keys[slot] == keys, self.place[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self.place[slot] >= 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.last
            hit = self.keys[slot] == keys[open_]
            out[open_[hit]] = self.place[slot[hit]]
            more = ~hit & (self.place[slot] >= 0)
            open_, slot = open_[more], slot[more]
        return out


class Trie:
    """A part of the trie, ready to look up: per order its edges and contexts.

    Of each context it knows how many symbols followed (``total``) and how many distinct ones
    (``kinds``), and what is left of both in the next shorter context once its own symbols are
    excluded there (``total_left``, ``kinds_left``).
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray, pair: np.ndarray, pair_n: np.ndarray, order: int) -> None:
        """gram, n: edges of ``order``; pair, pair_n: all edges of order 1."""
        self.order = order
        edges = {order: (gram, n), 1: (pair, pair_n)}
        for k in [*range(order - 1, 1, -1), 0]:
            above, above_n = edges[k + 1]
            edges[k] = merged([(above & mask(k + 1), above_n)])
        self.edges, self.count, self.contexts, self.left = {}, {}, {}, {}
        for k in range(order + 1):
            key, many = edges[k]
            by = np.argsort(key >> BITS, kind="stable")
            ctx, first, kinds = np.unique(key[by] >> BITS, return_index=True, return_counts=True)
            total = np.add.reduceat(many[by], first) if len(ctx) else np.zeros(0, np.int64)
            self.edges[k], self.count[k], self.contexts[k] = Index(key), many.astype(float), Index(ctx)
            rest = np.zeros((2, len(ctx)))
            if k and len(ctx):
                shorter = self.count[k - 1][self.edges[k - 1].find(key[by] & mask(k))]
                up = self.contexts[k - 1].find(ctx & mask(k - 1))
                rest = np.stack([self.left[k - 1][0][up] - np.add.reduceat(shorter, first), self.left[k - 1][1][up] - kinds])
            self.left[k] = (total.astype(float), kinds.astype(float), *rest)
        key, many = edges[order]
        at = self.contexts[order].find(key >> BITS)
        total, kinds = self.left[order][:2]
        self.direct = np.log10(many / (total[at] + kinds[at])) if len(key) else np.zeros(0)
        del self.count[order]  # what it would be asked for is in ``direct``

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each gram after its others."""
        at = self.edges[self.order].find(gram)
        seen = at >= 0
        if not len(self.direct):
            out = np.zeros(len(gram))
        else:
            out = np.where(seen, self.direct[at], 0.0)
        open_ = np.flatnonzero(~seen)
        total, kinds = np.zeros(len(open_)), np.full(len(open_), -1.0)  # kinds -1: no longer context is known
        for k in range(self.order, -1, -1):
            g = gram[open_]
            ctx = self.contexts[k].find((g >> BITS) & mask(k))
            known, fresh = ctx >= 0, kinds < 0
            own = self.left[k]
            total = np.where(fresh & known, own[0][ctx] if len(own[0]) else 0, total)
            kinds = np.where(fresh & known, own[1][ctx] if len(own[1]) else -1, kinds)
            den = total + kinds
            edge = self.edges[k].find(g & mask(k + 1))
            hit, spent = edge >= 0, (edge < 0) & known & (den > 0)
            if hit.any():  # below the deepest order only
                out[open_[hit]] += np.log10(self.count[k][edge[hit]] / den[hit])
            out[open_[spent]] += np.log10(kinds[spent] / den[spent])
            if len(own[2]):
                total, kinds = np.where(known, own[2][ctx], 0.0), np.where(known, own[3][ctx], -1.0)
            open_, total, kinds = open_[~hit], total[~hit], kinds[~hit]
        out[open_] -= np.log10(SYMBOLS - (self.left[0][1][0] if len(self.left[0][1]) else 0))
        return out


class Part:
    """What a pass broadcasts: edges of the part, all edges of order 1, and which contexts it answers for."""

    def __init__(self, order: int, arrays: tuple, contexts: np.ndarray | None) -> None:
        self.order, self.arrays, self.contexts = order, arrays, contexts
        self.made: Trie | None = None

    def trie(self) -> Trie:
        """The part's trie, made once a worker, which then drops the edges that it was made from."""
        if self.made is None:
            self.made, self.arrays = Trie(*self.arrays, self.order), None
        return self.made

    def of_texts(self, col: pa.Array) -> np.ndarray:
        """Sum of log10 probabilities of each text, over the symbols that are this part's."""
        trie, out = self.trie(), np.zeros(len(col))
        for lo, hi, s, first in runs(col, self.order):
            g = grams(s, self.order)
            own = (g & mask(1)) != START
            if self.contexts is not None:
                two = (g >> BITS) & mask(2)
                at = np.minimum(np.searchsorted(self.contexts, two), len(self.contexts) - 1)
                own &= self.contexts[at] == two
            each = np.zeros(len(g))
            each[own] = trie.log10(g[own])
            out[lo:hi] += np.add.reduceat(each, first)
        return out


def parts(top: DataFrame, order: int = ORDER, most_edges: int | None = None) -> Iterator[Part]:
    """Parts of the trie whose deepest edges are ``top``, a written table (gram, n). The driver holds one
    part at a time, and one number for each of the 258 * 258 pairs of symbols at most."""
    most = most_edges or MOST_EDGES
    two = F.col("gram").bitwiseAND(F.lit(mask(2)))
    pair = top.groupBy(two.alias("pair")).agg(F.sum("n").alias("n")).toArrow()
    pair_n = (pair["pair"].to_numpy().astype(np.int64), pair["n"].to_numpy().astype(np.int64))
    context = F.shiftright("gram", BITS).bitwiseAND(F.lit(mask(2)))
    per = top.groupBy(context.alias("c")).count().toArrow()
    c, size = per["c"].to_numpy().astype(np.int64), per["count"].to_numpy().astype(np.int64)
    c, size = c[np.argsort(c)], size[np.argsort(c)]
    if size.sum() <= most:
        found = top.toArrow()
        yield Part(order, (found["gram"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(np.int64), *pair_n), None)
        return
    # contexts that no training text has go with the first part
    turn, filled, used = np.zeros(len(c), np.int64), 0, 0
    for i, s in enumerate(size.tolist()):
        if used and used + s > most:
            filled, used = filled + 1, 0
        turn[i], used = filled, used + s
    every = np.arange(mask(2) + 1)
    rest = np.setdiff1d(every, c)
    for p in range(filled + 1):
        own = c[turn == p]
        found = top.where(context.between(int(own[0]), int(own[-1]))).toArrow()
        arrays = (found["gram"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(np.int64), *pair_n)
        yield Part(order, arrays, np.union1d(own, rest) if p == 0 else own)


def train(docs: DataFrame, scratch: Scratch, order: int = ORDER, text_col: str = "text") -> DataFrame:
    """The written table of the trie's deepest edges."""
    return scratch.keep(count_grams(docs, order, text_col), "trie")


def code_lengths(docs: DataFrame, top: DataFrame, scratch: Scratch, order: int = ORDER, text_col: str = "text", out_col: str = "score", most_edges: int | None = None) -> DataFrame:
    """``docs`` with ``out_col``, the log10 probability of each text under the trie (a column of that name is replaced)."""
    names = [c for c in docs.columns if c.lower() != out_col.lower()]
    read = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(text_col).alias("__text"), F.struct(*names).alias("__all") if names else F.lit(None).alias("__all"))
    rows = scratch.keep(read, "texts")
    sums = None
    for part in parts(top, order, most_edges):
        one = scratch.keep(pass_of(rows.select("__row", "__text"), part), "pass")
        sums = one if sums is None else sums.unionByName(one)
    sums = sums.groupBy("__row").agg(F.sum("score").alias("__score"))
    return rows.join(sums, "__row").select(*[F.col("__all")[c].alias(c) for c in names], F.col("__score").alias(out_col))


def pass_of(rows: DataFrame, part: Part) -> DataFrame:
    """(__row, score) of rows (__row, __text) for one part."""
    shared = rows.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.of_texts(b.column(1)))], ["__row", "score"])

    return rows.mapInArrow(run, "__row long, score double")
