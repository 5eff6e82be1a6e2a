"""Exact top-k by inner product with sequential access to sorted lists only.

Every partition of vectors is searched where it lies, batch by batch; the queries come to it in
groups of bounded size by broadcast, one pass a group, so vectors are never shuffled. Of a batch
each component has its vectors sorted, from above and from below; the lists are read step by step to
the same depth, and of each component a query looks at the list that its own component's sign makes
best. An entry that has been read raises its vector's lower bound (until then the component counts at the worst value of its list); the upper
bound takes what is unread at the value that its list was last read at. A query stops as soon as no
vector it hasn't met can reach its k-th best lower bound (or the k-th best score of the batches
before) and few of those it has met still can; the scores of these are then resolved, and the k best
go on as the bound for the next batch. A list that is read to its end leaves nothing open.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part, nor do
rows without id; shorter vectors count as zero in the components they lack; rows with the query's
own id are not its candidates; rows that repeat a query's id are queries of their own; fewer than
k candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusx.scratch import Scratch

#: Queries that are broadcast at once, queries that read together, vectors whose lists are sorted together.
QUERIES, TILE, VECTORS = 4096, 512, 8192
#: Share of a list that a step reads; one in so many vectors of a batch may be left to be resolved.
STEP, FEW = 1 / 16, 16


def quantized(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * component) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(v.isNotNull() & finite & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v")
    )


class Lists:
    """The sorted lists of a batch of vectors: entries (vectors) of each component, largest value first."""

    def __init__(self, v: np.ndarray) -> None:
        self.v = v
        order = np.argsort(-v, axis=0, kind="stable")
        self.order, self.value = order.T.copy(), np.take_along_axis(v, order, 0).T.copy()

    def search(self, q: np.ndarray, skip: list[np.ndarray], k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(query, vectors, scores, entries read) for each row of ``q``: every vector but those it skips
        that may be among its k best with at least its score ``floor``.

        Lists l and l + D are component l from above and from below; a query reads one of the two.
        """
        n, d = self.v.shape
        peak = float(np.abs(q).max(initial=0)) * float(np.abs(self.v).max(initial=0)) * d
        kind = np.float32 if peak < 2**22 else np.float64  # whole numbers are exact in it
        weight = np.hstack([np.maximum(q, 0), np.minimum(q, 0)]).astype(kind)
        order = np.vstack([self.order, self.order[:, ::-1]])
        value = np.vstack([self.value, self.value[:, ::-1]]).astype(kind)
        lists = np.arange(2 * d)[:, None]
        worst = value[:, -1]
        base = weight @ worst
        gain, unread = np.zeros((2 * d, n), kind), np.ones((2 * d, n), kind)  # what entries read so far add; which are to come
        active, used = np.arange(len(q)), np.count_nonzero(q, axis=1)
        step, few, k = max(1, round(n * STEP)), max(8 * k, n // FEW), min(k, n)
        read = turn = 0
        while len(active):
            turn, upto = turn + 1, min(n, read + step)
            at = order[:, read:upto]
            gain[lists, at] = value[:, read:upto] - worst[:, None]
            unread[lists, at] = 0
            read = upto
            gap = value[:, read - 1] - worst  # what an unread entry can add at most, before its weight
            most = base + weight @ gap  # no vector that a query hasn't met scores more
            ready = np.flatnonzero((most < floor) | (turn % 2 == 0) | (read == n))
            if not len(ready):
                continue
            w = weight[ready]
            bound = w @ gain + base[ready, None]  # lower bounds, a row a query
            for c, i in enumerate(ready.tolist()):
                bound[c, skip[active[i]]] = -np.inf
            need = np.maximum(floor[ready], np.partition(bound, n - k, axis=1)[:, n - k])
            ripe = np.flatnonzero((most[ready] < need) | (read == n))
            open_ = bound[ripe] + (w[ripe] * gap) @ unread >= need[ripe, None]
            stay = np.ones(len(active), bool)
            for c, i in enumerate(ready[ripe].tolist()):
                met = np.flatnonzero(open_[c])
                if len(met) <= few or read == n:
                    stay[i] = False
                    whole = int(active[i])
                    yield whole, met, self.v[met] @ q[whole], read * int(used[whole])
            active, weight, base, floor = active[stay], weight[stay], base[stay], floor[stay]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, ties to the smaller id."""
    at = np.lexsort((ids, -scores))[:k]
    return ids[at], scores[at]


def search_partition(batches: Iterator[tuple[np.ndarray, np.ndarray]], asked: np.ndarray, q: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Per query the (ids, scores) of its k best of all batches of (ids, vectors), and entries read."""
    top = [(np.zeros(0, np.int64), np.zeros(0, q.dtype))] * len(q)
    entries = np.zeros(len(q), np.int64)
    for ids, v in batches:
        lists = Lists(v)
        by_id = np.argsort(ids, kind="stable")
        lo, hi = np.searchsorted(ids[by_id], asked, "left"), np.searchsorted(ids[by_id], asked, "right")
        own = [by_id[a:b] for a, b in zip(lo, hi, strict=True)]
        for first in range(0, len(q), TILE):
            part = slice(first, first + TILE)
            floor = np.array([float(s[-1]) if len(s) == k else -np.inf for _, s in top[part]])
            for i, at, score, n in lists.search(q[part], own[part], k, floor):
                i += first
                if len(own[i]):
                    at, score = at[keep := ~np.isin(at, own[i])], score[keep]
                top[i] = best(np.concatenate([top[i][0], ids[at]]), np.concatenate([top[i][1], score]), k)
                entries[i] += n
    return top, entries


def dense(v: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width; floats while every score is exact in them, else Python integers."""
    out = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    peak = float(np.abs(out).max(initial=0)) ** 2 * width
    return out.astype(np.float64) if peak < 2**52 else out.astype(object)


def exact(v: np.ndarray, ids: np.ndarray, asked: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """As search_partition for one batch of integers that floats can't hold: every score."""
    out = []
    for i in range(len(q)):
        other = np.flatnonzero(ids != asked[i])
        score = v[other].astype(object) @ q[i].astype(object)
        at = sorted(range(len(other)), key=lambda j: (-score[j], ids[other[j]]))[:k]
        out.append((ids[other[at]], score[at]))
    return out


def one_pass(vectors: DataFrame, asked: pa.Table, width: int, k: int) -> DataFrame:
    """(place, query_id, vec_id, score, entries): the k best of each partition for a group of queries."""
    shared = vectors.sparkSession.sparkContext.broadcast(asked)
    names = ["place", "query_id", "vec_id", "score", "entries"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, asked_id = (shared.value.column(c).to_numpy() for c in ("place", "vec_id"))
        q = dense(shared.value.column("v").combine_chunks(), width)
        large: list[tuple[np.ndarray, np.ndarray]] = []

        def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for b in batches:
                for lo in range(0, b.num_rows, VECTORS):
                    s = b.slice(lo, VECTORS)
                    ids, v = s.column(0).to_numpy(), dense(s.column(1), width)
                    if v.dtype == object or q.dtype == object:
                        large.append((ids, v))
                    else:
                        yield ids, v

        top, entries = search_partition(blocks(), asked_id, q, k)
        for ids, v in large:
            top = [best(np.concatenate([a[0], b[0]]), np.concatenate([a[1].astype(object), b[1]]), k) for a, b in zip(top, exact(v, ids, asked_id, q, k), strict=True)]
            entries += v.size
        n = np.array([len(ids) for ids, _ in top], np.int64)
        count = np.zeros(int(n.sum()), np.int64)  # told once for each query
        count[(np.cumsum(n) - n)[n > 0]] = entries[n > 0]
        flat = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, n)) for x in (place, asked_id)] + [pa.array(flat(ids for ids, _ in top)), pa.array(flat(s for _, s in top)), pa.array(count)], names)

    return vectors.select("vec_id", "v").mapInArrow(run, "place long, query_id long, vec_id long, score long, entries long")


def top_k(df: DataFrame, query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, scale: int = 64, scratch: Scratch | None = None, entries: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``df`` that the condition ``query`` (on vec_id) picks.

    entries: also the number of list entries that were read for the query.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "topk")
    rows = scratch.keep(quantized(df, id_col, vec_col, scale), "vectors")
    asked, width = rows.agg(F.count_if(query), F.max(F.size("v"))).first()
    width = max(1, width or 0)
    zero = F.lit(0).cast("long")
    vectors = rows.select("vec_id", F.concat("v", F.array_repeat(zero, F.lit(width) - F.size("v"))).alias("v"))
    groups = max(1, -(-asked // QUERIES))
    queries = vectors.where(query).withColumn("place", F.monotonically_increasing_id())
    queries = scratch.keep(queries.withColumn("group", F.pmod(F.xxhash64("place"), F.lit(groups))), "queries")
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "vec_id"))
    found = []
    for g in range(groups):  # about QUERIES rows each come to the driver and are broadcast
        table = queries.where(F.col("group") == g).select("place", "vec_id", "v").toArrow()
        ranked = one_pass(vectors, table, width, k).withColumns({"rank": rank} | ({"entries": F.sum("entries").over(Window.partitionBy("place"))} if entries else {}))
        ranked = ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *["entries"] * entries)
        found.append(ranked if groups == 1 else scratch.keep(ranked, f"pass-{g}"))
    return reduce(DataFrame.unionByName, found)


def op1_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""
