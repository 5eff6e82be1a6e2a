"""Bounds on what is broadcast, on long texts, and columns whose names clash with results."""

import time
from collections import Counter

import duckdb
import public_tokenizers
from pyspark.sql import functions as F

from corpusx.llm import bpe, components, dedup, langid, secrets, toxicity
from corpusx.scratch import Scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_large_copies_take_the_shuffled_path(spark, monkeypatch):
    rows = [(i, ("x" * (700 + i // 3) + "y" * 5000) if i < 30 else f"text {i // 2}") for i in range(60)] + [(None, "text 20"), (60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, dedup.exact_dedup(docs).collect()))
    monkeypatch.setattr(dedup, "MOST_BYTES", 100)
    plan = dedup.exact_dedup(docs)
    assert sorted(map(str, plan.collect())) == want


def test_exact_dedup_equals_its_sql_on_repeated_ids(spark):
    rows = [(1, "abc"), (1, "a  bc"), (1, "abc"), (2, "abc "), (None, "a b c"), (3, None), (4, " "), (4, " ")]
    got = dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", rows)
    want = c.sql(dedup.ORACLE)
    assert Counter(tuple(r[n] for n in want.columns) for r in got.collect()) == Counter(want.fetchall())


def test_long_runs_of_a_token_start_are_read_once():
    rule = next(r for r in secrets.MORE if r.kind == "jwt")
    began = time.time()
    assert secrets.verify(rule, rule.regex, "eyJ" * 350_000) == []
    assert time.time() - began < 1
    token = "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12
    assert secrets.verify(rule, rule.regex, f"k={token};") == [(2, 2 + len(token))]


def test_text_columns_named_like_results(spark):
    given = spark.createDataFrame([(1, "der die das", 5), (2, None, 6)], "doc_id long, ids string, Decoded int")
    assert [r["ids"] for r in bpe.bpe_encode(given, PATH, text_col="ids").orderBy("doc_id").collect()] == [bpe.codec(PATH).encode("der die das"), b""]
    encoded = bpe.bpe_encode(given.withColumnRenamed("ids", "text"), PATH)
    back = bpe.bpe_decode(encoded, PATH, out_col="ids")
    assert sorted(back.columns) == ["Decoded", "doc_id", "ids", "text"] and [r["ids"] for r in back.orderBy("doc_id").collect()] == ["der die das", ""]
    assert bpe.bpe_decode(encoded, PATH).columns == ["doc_id", "text", "ids", "decoded"]
    empty = given.select("doc_id", F.lit(0).alias("toxic")).where("false")
    model = toxicity.train(given.select("doc_id", F.col("ids").alias("text")), empty)
    assert toxicity.score(given.select("doc_id", F.col("ids").alias("score")), model, text_col="score").columns == ["doc_id", "score"]
    said = spark.createDataFrame([(i, "der die das" if i % 2 else "the of and", "de" if i % 2 else "en") for i in range(20)], "doc_id long, text string, lang string")
    model = langid.train(said, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    found = langid.predict(said.select("doc_id", F.col("text").alias("lang_pred"), F.lit("x").alias("SCORE")), model, text_col="lang_pred").collect()
    assert {(r["doc_id"] % 2, r["lang_pred"]) for r in found} == {(0, "en"), (1, "de")}


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, 7), (9, 3), (3, 9), (3, 5), (50, 5)] + [(200, x) for x in range(201, 230)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "t")).collect()}
    want = {i: 100 for i in range(100, 141)} | {x: 3 for x in (3, 5, 9, 50)} | {x: 200 for x in range(200, 230)}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_the_encoders_memo_is_bounded_and_changes_nothing(monkeypatch):
    whole = bpe.Codec(PATH)
    monkeypatch.setattr(bpe, "MEMO", 4)
    small = bpe.Codec(PATH)
    texts = [f"word{i % 7} the été {i % 3}!! " * 2 for i in range(40)]
    assert [small.encode(t) for t in texts] == [whole.encode(t) for t in texts]
    assert len(small.memo) <= 4 and len(small.older) <= 4
