"""N-gram Jaccard join by universe partitioning.

Sets of distinct word shingles stand in size bands. If two sets of a band are similar enough, their
symmetric difference is at most some H, so when hashing deals the tokens out to H + 1 segments, the
two agree in one segment at least: agreeing segment subsets are the index keys. A segment without
tokens is a key that many sets share; its duty is moved to another segment, for which the set is
also indexed with each token left out (its one-deletion neighbourhood), so that a difference of one
is noticed there and counts for two. How many segments keep neighbourhoods is set per band by the
cost of their rows against the cost of the pairs they avoid.

Sets are identified by a digest of their tokens, so copies are indexed once. Keys that two sets or
more share form buckets; within a bucket a parity sketch bounds the difference of each pair from
below and turns away most pairs that can't be links, never one that is. What is left is verified on
the sets themselves. The first pass verifies a spanning forest of each bucket; the second all pairs
whose ends are still apart, inside the bucket, so no link is lost and no bucket returns more rows
than it has members.

Defined cases: a text without words (null, empty) has the empty set and is linked with nothing; a
text of fewer than n words has its whole word sequence as one shingle; documents with equal sets
are linked; a row is known by its doc_id and the digest of its text, so rows that repeat an id or have
none are judged text by text; a component is named by its least doc_id, null if no row of it has one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusx.llm.components import components
from corpusx.llm.kernels import ONE, SPACE, Words, chunks, mix, shingles
from corpusx.scratch import Scratch, partitions

#: Members of a bucket that are compared at once; larger buckets are dealt out by pairs of parts.
PART = 2048
#: Bounds of a worker's memory: sets it remembers as indexed, keys it holds before it passes them on,
#: keys it sorts at once. None changes the result.
MOST_SEEN, MOST_HELD, MOST_SORTED = 100_000, 500_000, 200_000


class Bands:
    """Size bands for a threshold of ``percent``: band k holds sizes edge[k] up to edge[k + 1]."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.edge = [1]
        self.spare: dict[int, int] = {}

    def upto(self, size: int) -> None:
        while self.edge[-1] <= size * 200 // self.percent + 2:
            self.edge.append(self.edge[-1] * 100 // self.percent + 1)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self.upto(int(sizes.max(initial=1)))
        return np.searchsorted(self.edge, sizes, "right") - 1

    def segments(self, band: int) -> int:
        """H + 1 for the largest pair whose larger set is in the band."""
        return (100 - self.percent) * 2 * (self.edge[band + 1] - 1) // (100 + self.percent) + 1

    def allot(self, sets: dict[int, int]) -> None:
        """Choose per band how many segments keep neighbourhoods, given about how many sets it has.

        A set whose empty segments outnumber its usable spares shares keys with every other such set,
        so the spares grow with the number of empty segments to be expected in the band.
        """
        for band, n in sets.items():
            self.upto(int(self.edge[-1] if band + 1 >= len(self.edge) else self.edge[band + 1]))
            m = self.segments(band)
            t = max(self.edge[band], 1) / m
            empty = math.exp(-t)
            mean, usable = m * empty, 1 - empty * (1 + t)
            met = m * empty**2  # empty segments that two sets have in common
            best, short, counted = None, 1.0, 0
            for spare in range(m + 1):
                while counted <= spare * usable:  # chance of more empty segments than usable spares
                    short -= math.exp(counted * math.log(mean) - mean - math.lgamma(counted + 1)) if mean else float(counted == 0)
                    counted += 1
                cost = n * spare * t + 0.05 * (n * max(short, 0.0)) ** 2 / 2 * met
                if best is None or cost < best[0]:
                    best = (cost, spare)
                if short * n < 1e-3:
                    break
            self.spare[band] = best[1]


def per_set(h: np.ndarray, doc: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, identity, first token) of each row's set."""
    size = np.bincount(doc, minlength=rows)
    first = np.cumsum(size) - size
    ident = np.zeros(rows, np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        ident[full] = mix(np.add.reduceat(mix(h), first[full]) + size[full].astype(np.uint64) * ONE)
    return size, ident, first


def index_keys(h: np.ndarray, band: int, bands: Bands) -> tuple[np.ndarray, bytes]:
    """Keys of one set in a band, and its parity sketch there (half a byte per segment)."""
    m = bands.segments(band)
    seg = ((h >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
    bit = np.left_shift(1, ((h >> np.uint64(8)) & np.uint64(3)).astype(np.int64) + 4 * (seg & 1)).astype(np.uint8)
    worth = mix(h ^ np.uint64(band))
    order = np.argsort(seg, kind="stable")
    s = seg[order]
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    content = np.zeros(m, np.uint64)
    content[s[at]] = np.add.reduceat(worth[order], at)
    sketch = np.zeros((m + 1) // 2, np.uint8)  # four parities a segment
    pair = s >> 1
    cut = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    sketch[pair[cut]] = np.bitwise_xor.reduceat(bit[order], cut)
    held = np.bincount(seg, minlength=m)
    place = mix(np.arange(m, dtype=np.uint64) + np.uint64(band << 32))
    spare = bands.spare.get(band, 0)
    empty = int((held == 0).sum())
    keys = [mix(content[held > 0] ^ place[held > 0])]
    if empty > int((held[:spare] >= 2).sum()):  # too few spares: empty segments stay keys
        keys.append(mix(place[held == 0]))
    if spare:
        near = (seg < spare) & (held[seg] >= 2)
        keys.append(mix((content[seg[near]] - worth[near]) ^ place[seg[near]]))
    return np.unique(np.concatenate(keys)), sketch.tobytes()


def roles(size: int, bands: Bands, band: int) -> list[int]:
    """Bands in which a set takes part: its own, and the next if a larger partner can be there."""
    return [band, band + 1] if 100 * size >= bands.percent * bands.edge[band + 1] else [band]


def digest(text: str) -> Column:
    """What tells the texts of one doc_id apart."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def index_rows(docs: DataFrame, bands: Bands, words: int, parts: int) -> DataFrame:
    """Two kinds of rows, dealt by ``part``: packed keys of a task's sets, and a row per document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["part", "keys", "doc_id", "digest", "size", "set", "own", "next"]

    def pack(held: list[tuple[int, int, np.ndarray]], tail: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        keys = np.concatenate([k for _, _, k in held])
        entry = np.repeat(np.arange(len(held)), [len(k) for _, _, k in held])
        ident, role = np.array([i for i, _, _ in held], np.uint64), np.array([r for _, r, _ in held], np.uint32)
        part = (keys % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, entry, low = part[order], entry[order], (keys[order] >> np.uint64(32)).astype("<u4")
        cut = np.searchsorted(part, np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(cut)).tolist():
            own = entry[cut[p] : cut[p + 1]]
            at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            count = np.diff(np.append(at, len(own))).astype(np.uint32)
            sizes = np.array([len(at), len(own)], "<u4")
            blob = sizes.tobytes() + ident[own[at]].astype("<u8").tobytes() + (role[own[at]] << np.uint32(24) | count).astype("<u4").tobytes() + low[cut[p] : cut[p + 1]].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([blob], pa.binary()), *[pa.nulls(1, t) for t in tail]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[pa.DataType] = []
        seen: set[int] = set()
        held: list[tuple[int, int, np.ndarray]] = []
        n_keys = 0
        for b in batches:
            tail = [b.column(0).type, pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            for lo, hi, data, offsets in chunks(b.column(1)):
                h, doc = shingles(Words(data, offsets, SPACE), hi - lo, words)
                size, ident, first = per_set(h, doc, hi - lo)
                band = bands.of(size)
                sketches: list[list[bytes | None]] = [[], []]
                for i in range(hi - lo):
                    made: list[bytes | None] = [None, None]
                    if size[i] and int(ident[i]) not in seen:
                        if len(seen) < MOST_SEEN:
                            seen.add(int(ident[i]))
                        own = h[first[i] : first[i] + size[i]]
                        for role, k in enumerate(roles(int(size[i]), bands, int(band[i]))):
                            keys, made[role] = index_keys(own, k, bands)
                            held.append((int(ident[i]), role, keys))
                            n_keys += len(keys)
                    sketches[0].append(made[0])
                    sketches[1].append(made[1])
                if n_keys > MOST_HELD:
                    yield from pack(held, tail)
                    held, n_keys = [], 0
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array((ident % np.uint64(parts)).astype(np.int32)), pa.nulls(n, pa.binary()), b.column(0).slice(lo, n), b.column(2).slice(lo, n), pa.array(size.astype(np.int32)),
                     pa.array(ident.view(np.int64), mask=size == 0), pa.array(sketches[0], pa.binary()), pa.array(sketches[1], pa.binary())], names)
        yield from pack(held, tail)

    return docs.select("doc_id", "text", digest("text").alias("digest")).mapInArrow(run, f"part int, keys binary, doc_id {id_type}, digest binary, size int, set long, own binary, next binary")


def unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, set, role) of packed keys; a blob holds two counts, the sets, their roles and key counts, the keys."""
    key, ident, role = [], [], []
    while blobs:
        blob = blobs.pop()
        sets, n = np.frombuffer(blob, "<u4", 2).tolist()
        tally = np.frombuffer(blob, "<u4", sets, 8 + 8 * sets)
        count = (tally & 0xFFFFFF).astype(np.int64)
        key.append(np.frombuffer(blob, "<u4", n, 8 + 12 * sets))
        ident.append(np.repeat(np.frombuffer(blob, "<u8", sets, 8), count))
        role.append(np.repeat((tally >> 24).astype(np.int8), count))
    return np.concatenate(key), np.concatenate(ident), np.concatenate(role)


def shared_keys(indexed: DataFrame) -> DataFrame:
    """Of rows dealt by ``part``: members of buckets of two sets or more, and the document rows."""
    schema = indexed.drop("part", "keys").schema
    names = ["bucket", "sub", "role", *schema.names]

    def settle(part: int, key: np.ndarray, ident: np.ndarray, role: np.ndarray, types) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((role, ident, key))
        key, ident, role = key[order], ident[order], role[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (ident[1:] != ident[:-1]) | (role[1:] != role[:-1])
        key, ident, role = key[new], ident[new], role[new]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        home = np.add.reduceat((role == 0).astype(np.int64), start)
        live = (size > 1) & (home > 0)  # two visitors are compared in their own band
        keep = np.repeat(live, size)
        at = np.arange(len(key)) - np.repeat(start, size)
        deal = np.repeat(-(-size // PART), size)
        rows = np.flatnonzero(keep)
        sub = np.zeros(len(rows), np.int64)
        if (deal[rows] > 1).any():  # a large bucket: each pair of its parts becomes a bucket
            out_rows, out_sub = [rows[deal[rows] == 1]], [np.zeros(int((deal[rows] == 1).sum()), np.int64)]
            for j in np.unique(deal[rows][deal[rows] > 1]).tolist():
                r = rows[deal[rows] == j]
                own = at[r] // PART
                for other in range(j):
                    pair = np.minimum(own, other) * j + np.maximum(own, other) + 1
                    out_rows.append(r)
                    out_sub.append(pair)
            rows, sub = np.concatenate(out_rows), np.concatenate(out_sub)
        n = len(rows)
        if n:
            bucket = (np.uint64(part) << np.uint64(32)) + key[rows].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(sub), pa.array(role[rows].astype(np.int32)), pa.nulls(n, types[0]), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.array(ident[rows].view(np.int64)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        types = None
        for b in batches:
            types = [b.column(2).type]
            packed = np.flatnonzero(pc.is_valid(b.column(1)).to_numpy(zero_copy_only=False))
            for i in packed.tolist():
                blobs.setdefault(b.column(0)[i].as_py(), []).append(b.column(1)[i].as_py())
            info = b.filter(pc.is_null(b.column(1)))
            if info.num_rows:
                n = info.num_rows
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), *info.columns[2:]], names)
        for part in sorted(blobs):
            key, ident, role = unpack(blobs.pop(part))
            slices = np.uint32(len(key) // MOST_SORTED + 1)
            share = key % slices
            for k in range(int(slices)):  # a key's members all lie in one slice
                at = np.flatnonzero(share == k)
                if len(at):
                    yield from settle(part, key[at], ident[at], role[at], types)

    made = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return indexed.mapInArrow(run, f"bucket long, sub long, role int, {made}")


BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def open_pairs(sketch: np.ndarray, size: np.ndarray, role: np.ndarray, group: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, bound) of pairs of a bucket that may be links and aren't in the same group."""
    out = [], [], []
    for i in range(len(size) - 1):
        j = np.arange(i + 1, len(size))
        small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        j = j[((role[i] == 0) | (role[j] == 0)) & (group[j] != group[i]) & (100 * small >= percent * large)]
        if not len(j):
            continue
        apart = BITS[sketch[i] ^ sketch[j]].sum(1, dtype=np.int64)
        ok = apart * (100 + percent) <= (100 - percent) * (size[i] + size[j])
        out[0].append(np.full(int(ok.sum()), i))
        out[1].append(j[ok])
        out[2].append(apart[ok])
    if not out[0]:
        return (np.zeros(0, np.int64),) * 3
    return tuple(map(np.concatenate, out))


def close_twos(sketches: pa.Array, at: np.ndarray, size: np.ndarray, role: np.ndarray, group: np.ndarray, percent: int) -> np.ndarray:
    """Which buckets of two members, rows at and at + 1, are pairs that may be links (as open_pairs)."""
    if not len(at):
        return np.zeros(0, bool)
    offset = np.frombuffer(sketches.buffers()[1], np.int32)[sketches.offset : sketches.offset + len(sketches) + 1].astype(np.int64)
    data = np.frombuffer(sketches.buffers()[2], np.uint8)
    length = np.diff(offset)
    x, y = size[at], size[at + 1]
    ok = (length[at] == length[at + 1]) & ((role[at] == 0) | (role[at + 1] == 0)) & (group[at] != group[at + 1]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
    for m in np.unique(length[at[ok]]).tolist():
        r = np.flatnonzero(ok & (length[at] == m))
        for part in np.array_split(r, -(-len(r) * m // 500_000) or 1):
            span = np.arange(m)
            apart = BITS[data[offset[at[part]][:, None] + span] ^ data[offset[at[part] + 1][:, None] + span]].sum(1, dtype=np.int64)
            ok[part] = apart * (100 + percent) <= (100 - percent) * (x[part] + y[part])
    return ok


def forest(i: np.ndarray, j: np.ndarray, bound: np.ndarray, n: int) -> np.ndarray:
    """Pairs that span what all pairs connect, the closest first."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for e in np.argsort(bound, kind="stable").tolist():
        a, b = find(int(i[e])), find(int(j[e]))
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(e)
    return np.array(kept, np.int64)


def linked(of_a: np.ndarray, of_b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(of_a, of_b, assume_unique=True))
    return 100 * common >= percent * (len(of_a) + len(of_b) - common)


def join_groups(i: np.ndarray, j: np.ndarray, bound: np.ndarray, group: np.ndarray, tokens: list[bytes], percent: int) -> np.ndarray:
    """Pairs of a bucket that are links and join two groups that no pair before them has joined."""
    root = {g: g for g in group.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for e in np.argsort(bound, kind="stable").tolist():
        a, b = find(int(group[i[e]])), find(int(group[j[e]]))
        if a != b and linked(np.frombuffer(tokens[i[e]], np.uint64), np.frombuffer(tokens[j[e]], np.uint64), percent):
            root[max(a, b)] = min(a, b)
            kept.append(e)
    return np.array(kept, np.int64)


def bucket_pairs(members: DataFrame, sets: DataFrame, percent: int, count: int, tokens: DataFrame | None = None, mark: bool = False) -> DataFrame:
    """Pairs (a, b) to verify from members (bucket, sub, role, set, group) and the sets' sketches.

    Without ``tokens``: a forest of each bucket, yet to be verified, and a row with ``bucket`` and
    ``sub`` for each bucket that has more pairs than its forest. With ``tokens`` (set, tokens): the
    links that join the groups of each bucket, verified here, so that a bucket gives fewer rows than
    it has members. With ``mark``: the members (set as a, role as b, bucket, sub) that have a pair in
    another group at all, so that tokens are fetched for these alone.
    """
    spanning = tokens is None and not mark
    s = sets.select(F.col("set").alias("s"), "size", "own", "next")
    sketch = F.when(F.col("role") == 0, F.col("own")).otherwise(F.col("next"))
    sketched = members.join(s, F.col("set") == F.col("s")).select("bucket", "sub", "role", "set", "group", "size", sketch.alias("sketch"))
    if tokens is not None:
        sketched = sketched.join(tokens.select(F.col("set").alias("t"), "tokens"), F.col("set") == F.col("t")).drop("t")
    dealt = sketched.repartition(count, "bucket", "sub").sortWithinPartitions("bucket", "sub", "set", "role")
    schema = pa.schema([(n, pa.int64()) for n in ("a", "b", "bucket", "sub")])

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, sub = (t.column(c).to_numpy() for c in ("bucket", "sub"))
        cut = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (sub[1:] != sub[:-1]), [True]]))
        ident, size, role, group = (t.column(c).to_numpy() for c in ("set", "size", "role", "group"))
        sketches = t.column("sketch").combine_chunks()
        found, where, more = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)], []
        twos = cut[:-1][(np.diff(cut) == 2) & spanning]
        i = twos[close_twos(sketches, twos, size.astype(np.int64), role, group, percent)]
        found.append(np.stack([np.minimum(ident[i], ident[i + 1]), np.maximum(ident[i], ident[i + 1])], 1)[ident[i] != ident[i + 1]])
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if hi - lo < 2 + spanning or (group[lo:hi] == group[lo]).all():
                continue
            raw = sketches.slice(lo, hi - lo).to_pylist()
            length = np.fromiter(map(len, raw), np.int64, hi - lo)
            for m in np.unique(length).tolist():  # sketches of another length are of another band: a chance meeting
                at = np.flatnonzero(length == m)
                own = lo + at
                sketch = np.frombuffer(b"".join(raw[x] for x in at.tolist()), np.uint8).reshape(len(at), m)
                i, j, bound = open_pairs(sketch, size[own].astype(np.int64), role[own], group[own], percent)
                if spanning and len(i):
                    e = forest(i, j, bound, len(at))
                    if len(e) < len(i):
                        more.append((int(bucket[lo]), int(sub[lo])))
                    i, j = i[e], j[e]
                elif mark:
                    at = own[np.unique(np.concatenate([i, j]))]
                    found.append(np.stack([ident[at], role[at].astype(np.int64)], 1))
                    where.append(np.stack([bucket[at], sub[at]], 1))
                    continue
                elif len(i):
                    held = t.column("tokens").slice(lo, hi - lo).to_pylist()
                    e = join_groups(i, j, bound, group[own], [held[x] for x in at.tolist()], percent)
                    i, j = i[e], j[e]
                x, y = ident[own][i], ident[own][j]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y])
        if mark:
            rows = np.concatenate([np.concatenate(found), np.concatenate(where)], 1)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(4)], schema=schema)
            return
        both = np.unique(np.concatenate(found), axis=0)
        extra = np.array(sorted(set(more)), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([both[:, k], np.zeros(len(extra), np.int64)]), mask=np.arange(len(both) + len(extra)) >= len(both)) for k in (0, 1)
        ] + [
            pa.array(np.concatenate([np.zeros(len(both), np.int64), extra[:, k]]), mask=np.arange(len(both) + len(extra)) < len(both)) for k in (0, 1)
        ], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:  # whole buckets at a time: the last one may go on in the next batch
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if not t.num_rows:
                continue
            bucket, sub = t.column("bucket").to_numpy(), t.column("sub").to_numpy()
            last = int(np.flatnonzero((bucket == bucket[-1]) & (sub == sub[-1]))[0])
            rest = t.slice(last)
            yield from pairs(t.slice(0, last))
        if rest is not None:
            yield from pairs(rest)

    return dealt.mapInArrow(run, "a long, b long, bucket long, sub long").distinct()


def token_sets(docs: DataFrame, words: int) -> DataFrame:
    """(set, tokens): the sorted shingle hashes of each text, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in chunks(b.column(0)):
                h, doc = shingles(Words(data, offsets, SPACE), hi - lo, words)
                size, ident, first = per_set(h, doc, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(ident.view(np.int64)), pa.array([h[f : f + s].tobytes() for f, s in zip(first.tolist(), size.tolist(), strict=True)], pa.binary())], ["set", "tokens"])

    return docs.select("text").mapInArrow(run, "set long, tokens binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose sets are similar enough."""
    left = sets.select(F.col("set").alias("set_a"), F.col("tokens").alias("of_a"))
    right = sets.select(F.col("set").alias("set_b"), F.col("tokens").alias("of_b"))
    both = pairs.join(left, F.col("a") == F.col("set_a")).join(right, F.col("b") == F.col("set_b")).select("a", "b", "of_a", "of_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                ok.append(linked(x, y, percent))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


#: Rows of (id, set) that are broadcast to fetch texts; beyond that both sides are shuffled.
MOST_BROADCAST = 1_000_000


def judged(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Per row: doc_id, digest, n_shingles, component_id (least doc_id reachable by links), kept.

    Of a component the text with the least doc_id is kept (a null one last, of several the least
    digest); rows that agree in id and text with it each say kept.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bands = Bands(percent)
    # about how many sets each band has, for the choice of neighbourhoods alone: words are taken as 6 bytes
    guess = F.floor(F.log2(F.greatest(F.octet_length("text") / 6, F.lit(1)))).cast("int")
    for r in docs.where("text is not null").groupBy(guess.alias("g")).count().collect():
        bands.upto(2 ** (r["g"] + 1))
        inside = [k for k, e in enumerate(bands.edge[:-1]) if 2 ** r["g"] <= e < 2 ** (r["g"] + 1)] or [int(bands.of(np.array([2 ** r["g"]]))[0])]
        bands.allot({k: r["count"] // len(inside) + 1 for k in inside})
    count = partitions(spark)
    stage = scratch.keep(shared_keys(index_rows(docs, bands, words, count).repartitionById(count, F.col("part"))), "index", batch=1000)
    members = stage.where("bucket is not null").select("bucket", "sub", "role", "set")
    info = stage.where("bucket is null").select("doc_id", "digest", "size", "set", "own", "next")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("digest").alias("d"))
    sets = info.where("set is not null").groupBy("set").agg(F.min(order).alias("rep"), F.first("size").alias("size"), F.max("own").alias("own"), F.max("next").alias("next"))
    first = scratch.keep(bucket_pairs(members.withColumn("group", F.col("set")), sets, percent, count), "pairs")
    pairs, active = first.where("a is not null").select("a", "b"), first.where("a is null").select(F.col("bucket").alias("k"), F.col("sub").alias("l"))
    # every set with a pair stands in a forest, so these sets are all that is ever verified
    needed = pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct()
    needed = scratch.keep(sets.join(needed, F.col("set") == F.col("n"), "left_semi").select(F.col("rep.i").alias("rep"), F.col("rep.d").alias("rep_digest")), "needed")
    asked = F.broadcast(needed) if needed.count() <= MOST_BROADCAST else needed
    tokens = token_sets(docs.join(asked, F.col("doc_id").eqNullSafe(F.col("rep")) & (digest("text") == F.col("rep_digest")), "left_semi").select("text"), words)
    tokens = scratch.keep(tokens.dropDuplicates(["set"]), "tokens", batch=1000)
    links = scratch.keep(verified(pairs, tokens, percent), "links", batch=500)
    roots = scratch.keep(components(links, scratch), "roots")
    r = roots.withColumnRenamed("node", "n")
    again = members.join(active, (F.col("bucket") == F.col("k")) & (F.col("sub") == F.col("l"))).join(r, F.col("set") == F.col("n"), "left")
    again = scratch.keep(again.select("bucket", "sub", "role", "set", F.coalesce("root", "set").alias("group")), "again")
    apart = again.groupBy("bucket", "sub").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select(F.col("bucket").alias("k"), F.col("sub").alias("l"))
    again = again.join(apart, (F.col("bucket") == F.col("k")) & (F.col("sub") == F.col("l")), "left_semi")
    marked = scratch.keep(bucket_pairs(again, sets, percent, count, mark=True), "marked").select(*[F.col(c).alias(f"m_{c}") for c in ("a", "b", "bucket", "sub")])
    same = (F.col("bucket") == F.col("m_bucket")) & (F.col("sub") == F.col("m_sub")) & (F.col("set") == F.col("m_a")) & (F.col("role") == F.col("m_b"))
    again = again.join(marked, same, "left_semi")
    more = scratch.keep(bucket_pairs(again, sets, percent, count, tokens).where("a is not null").select("a", "b"), "more", batch=500)
    if not more.isEmpty():
        roots = scratch.keep(components(links.unionByName(more), scratch), "roots")
    scratch.drop_all_but(stage, roots)
    by_set = info.join(roots.withColumnRenamed("node", "n"), F.col("set") == F.col("n"), "left").select("doc_id", "digest", F.col("size").alias("n_shingles"), F.coalesce("root", "set").alias("root"))
    least = by_set.where("root is not null").groupBy("root").agg(F.min(order).alias("least")).withColumnRenamed("root", "q")
    joined = by_set.join(least, F.col("root") == F.col("q"), "left")
    kept = F.col("q").isNull() | (F.col("doc_id").eqNullSafe(F.col("least.i")) & (F.col("digest") == F.col("least.d")))
    return joined.select("doc_id", "digest", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("least.i", "doc_id").alias("component_id"), kept.alias("kept"))


def similar_documents(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id reachable by links)."""
    return judged(docs, words, percent, id_col, text_col, scratch).select("doc_id", "n_shingles", "component_id")


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90)
