"""Streams: the latest record per key by changes, the guard over many batches."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from corpusx.streaming import guard as guard_module
from corpusx.streaming.guard import guard_into, ngram_guard
from corpusx.streaming.latest import keep_latest, read_latest

SCHEMA = "k long, at int, status string, v string"


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def test_latest_rewrites_only_buckets_of_changed_keys(spark, tmp_path):
    log, out, state = (str(tmp_path / x) for x in ("log", "out", "state"))
    done = "status = 'completed'"
    kept = spark.createDataFrame([], SCHEMA).select("k", "at", "v").schema
    drain = lambda: keep_latest(spark.readStream.schema(spark.read.parquet(log).schema).parquet(log), out, state, "k", ["at"], ["v"], done, 16)
    assert read_latest(spark, out, kept).count() == 0
    write(spark, [(k, t, "completed", f"{k}.{t}") for k in range(40) for t in (1, 2)] + [(None, 1, "completed", "none"), (99, 9, "started", "x")], log)
    drain()
    want = {k: f"{k}.2" for k in range(40)} | {None: "none"}
    assert {r["k"]: r["v"] for r in read_latest(spark, out, kept).collect()} == want
    before = files(out)
    write(spark, [(3, 5, "completed", "3.5"), (3, 4, "completed", "3.4"), (7, 1, "completed", "old"), (7, 9, "failed", "7.9"), (100, 1, "completed", "new")], log)
    drain()
    want |= {3: "3.5", 100: "new"}
    rows = read_latest(spark, out, kept).collect()
    assert len(rows) == len(want) and {r["k"]: r["v"] for r in rows} == want
    after = files(out)
    bucket = spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(k).cast("long")), F.lit(16)).alias(str(k)) for k in (3, 7, 100)]).first()
    touched = {f"bucket={b}" for b in bucket}
    gone = {f.split("/")[-2] for f in before if f not in after}
    assert gone and gone <= touched and all(after[f] == t for f, t in before.items() if f.split("/")[-2] not in touched)
    drain()
    assert files(out) == after


TEXTS = {1: "one two three four five six", 2: "nothing of the kind here", 3: "x one two thr ee four", 4: "zero two three four five one two three four", 5: ""}
INDEX = ["two three four five", "one two three four", "kind here never ends"]


def drained(spark, tmp_path, parts, guard):
    """What the guard finds when deltas arrive in the given micro-batches."""
    log = str(tmp_path / "deltas")
    index = spark.createDataFrame([(g,) for g in INDEX], "gram string")
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "stream_id long, seq int, delta string").coalesce(1).write.mode("append").parquet(log)
        stream = spark.readStream.schema("stream_id long, seq int, delta string").parquet(log)
        guard(stream, index)
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "found")).select("stream_id", "word_pos", "gram").collect())


WANT = [(1, 0, "one two three four"), (4, 1, "two three four five")]


def test_guard_takes_deltas_in_turn_over_micro_batches(spark, tmp_path):
    rows = [(i, n, t) for i, text in TEXTS.items() for n, t in enumerate([(text + "\n")[k : k + 4] for k in range(0, len(text) + 1, 4)])]
    odd, even = [r for r in rows if r[1] % 2], [r for r in rows if not r[1] % 2]

    def guard(stream, index):
        q = ngram_guard(stream, index, 4, ordered=True).writeStream.format("parquet").option("path", str(tmp_path / "found"))
        q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    assert drained(spark, tmp_path, [odd, even, even], guard) == WANT  # the even ones come late, and then again


def test_guard_with_an_index_of_any_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(guard_module, "MOST_GRAMS", 1)
    rows = [(i, n, t) for i, text in TEXTS.items() for n, t in enumerate([(text + "\n")[k : k + 5] for k in range(0, len(text) + 1, 5)])]
    with pytest.raises(ValueError, match="guard_into"):
        ngram_guard(spark.createDataFrame(rows, "stream_id long, seq int, delta string"), spark.createDataFrame([(g,) for g in INDEX], "gram string"), 4)
    into = lambda stream, index: guard_into(stream, index, str(tmp_path / "found"), str(tmp_path / "state"), 4)
    assert drained(spark, tmp_path, [rows[: len(rows) // 2], rows[len(rows) // 2 :], [(1, 9, "one two three four ")]], into) == WANT


def test_guard_reads_long_deltas_in_linear_time(spark, tmp_path):
    rows = [(1, 0, "some word " * 200_000 + "one two three four "), (2, 0, "a" * 200_000)]

    def guard(stream, index):
        q = ngram_guard(stream, index, 4).writeStream.format("parquet").option("path", str(tmp_path / "found"))
        q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    began = time.time()
    assert drained(spark, tmp_path, [rows], guard) == [(1, 400_000, "one two three four")]
    assert time.time() - began < 60


def test_a_long_text_is_cut_and_read_once(spark, tmp_path, monkeypatch):
    """Deltas looked for from the beginning of the text, once each, took minutes; blocks of words join where they meet."""
    rows = spark.createDataFrame([(1, "é word\n" * 1_200_000 + "two three four five"), (2, None)], "id long, text string")
    cut = guard_module.deltas_of(rows, "id", "text", 400)
    began = time.time()
    assert cut.groupBy("stream_id").agg(F.count("*").alias("n"), F.sum(F.length("delta")).alias("c"), F.max("seq").alias("last")).orderBy("stream_id").collect() == [(1, 21001, 8_400_020, 21000), (2, 1, 1, 0)]
    assert time.time() - began < 30
    monkeypatch.setattr(guard_module, "BLOCK", 3)
    log = str(tmp_path / "cut")
    guard_module.deltas_of(spark.createDataFrame(list(TEXTS.items()), "id long, text string"), "id", "text", 5).write.parquet(log)
    found = ngram_guard(spark.readStream.schema("stream_id long, seq int, delta string").parquet(log), spark.createDataFrame([*[(g,) for g in INDEX], (None,)], "gram string"), 4)
    found.writeStream.format("memory").queryName("cut_in_blocks").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("cut_in_blocks").collect()} == {(1, 0, "one two three four"), (4, 1, "two three four five")}
