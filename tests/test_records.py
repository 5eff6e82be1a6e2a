"""Layers, seals, payloads and packets on given cases."""

import pytest

from corpusx.operators import records as R

LAYERS = "profile string, extends string, version string, genre string, tags array<string>"


def test_merge_layers(spark):
    rows = [("base", None, "1", "noir", ["a", "b"]), ("mid", "base", "1", " ", ["b", "c"]), ("leaf", "mid", "1", None, None), ("own", "mid", "1", "comedy", ["a", "d"])]
    got = {r["profile"]: (r["depth"], r["genre"], r["tags"]) for r in R.merge_layers(spark.createDataFrame(rows, LAYERS), ("genre",), ("tags",)).collect()}
    assert got == {"base": (1, "noir", ["a", "b"]), "mid": (2, "noir", ["a", "b", "c"]), "leaf": (3, "noir", ["a", "b", "c"]), "own": (3, "comedy", ["a", "b", "c", "d"])}
    with pytest.raises(Exception, match="cycle"):
        R.merge_layers(spark.createDataFrame([("a", "b", "1", "", []), ("b", "a", "1", "", [])], LAYERS), ("genre",), ("tags",)).collect()
    deep = spark.createDataFrame([("0", None, "1", "noir", ["t0"]), *[(str(i), str(i - 1), "1", None, [f"t{i}"]) for i in range(1, 25)]], LAYERS)
    assert next((r["depth"], r["genre"], len(r["tags"])) for r in R.merge_layers(deep, ("genre",), ("tags",)).collect() if r["profile"] == "24") == (25, "noir", 25)
    for bad, said in ([("a", "nowhere", "1", "", [])], "unknown base"), ([("a", None, "1", "", []), ("b", "a", "2", "", [])], "versions"):
        with pytest.raises(Exception, match=said):
            R.merge_layers(spark.createDataFrame(bad, LAYERS), ("genre",), ("tags",)).collect()


def test_seals_notice_every_change(spark):
    rows = [("p", 1, "x"), ("p", 2, None), ("q", 3, "z"), ("r", 4, "w")]
    seal = lambda rs: R.seal_of(spark.createDataFrame(rs, "part string, i int, text string"), "part", "i", "text")
    got = lambda rs: {r["part"]: r["status"] for r in R.seal_verify(seal(rows), seal(rs)).collect()}
    assert set(got(rows[::-1]).values()) == {"intact"}
    assert got([("p", 1, "x"), ("p", 2, ""), ("q", 3, "z"), ("s", 5, "n")]) == {"p": "changed", "q": "intact", "r": "missing", "s": "new"}


def test_payloads_and_packets(spark):
    d = spark.createDataFrame([(1, '{"score": 1}'), (2, '{"rewrite": "x", "other": 2}'), (3, "[1]"), (4, None)], "i int, p string")
    got = {r["id"]: (r["unknown"], r["forbidden"], r["passed"]) for r in R.critic_only_check(d, "i", "p", ["score"], ["rewrite"]).collect()}
    assert got == {1: ("", "", True), 2: ("other,rewrite", "rewrite", False), 3: ("", "", False), 4: ("", "", False)}
    p = spark.createDataFrame([(1, [("did", "so"), ("then", None)])], "i int, atoms array<struct<action:string,consequence:string>>")
    assert [tuple(r) for r in R.occurrence_ledger(p, "i", "atoms").orderBy("place").collect()] == [(1, 0, "action", "did"), (1, 1, "consequence", "so"), (1, 2, "action", "then")]
