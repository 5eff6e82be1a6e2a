"""Promotion, reports, inheritance, profiles and rubrics on given cases."""

import hashlib

from corpusx.operators import lineage as L

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def test_promoted_segments(spark):
    stored = [("ok", "one two \n", "one two three"), ("edited", "one 2", "one two"), ("raw", "one two", "one two, later"), ("words", "one two", "one two"), ("band", "one", "one"), ("cut", "two", "one two"), ("none", None, None)]
    claims = [("ok", sha("one two"), sha("one two three"), 2), ("edited", sha("one two"), sha("one two"), 2), ("raw", sha("one two"), sha("one two"), 2), ("words", sha("one two"), sha("one two"), 3),
              ("band", sha("one"), sha("one"), 1), ("cut", sha("two"), sha("one two"), 1), ("gone", sha(""), sha(""), 0), ("none", sha(""), sha(""), 0)]
    m = spark.createDataFrame(claims, "segment string, selected_sha string, raw_sha string, words int")
    s = spark.createDataFrame(stored, "segment string, selected string, raw string")
    got = {r["segment"]: r["error"] for r in L.promoted_segments(m, s, 2, 9).collect()}
    assert got == {"ok": None, "edited": "selected hash", "raw": "raw hash", "words": "word count", "band": "word band", "cut": "word band", "gone": "not stored", "none": "word band"}
    assert {r["segment"]: r["error"] for r in L.promoted_segments(m, s, 0, 9).collect()}["cut"] == "not a prefix"
    assert L.promoted_segments(m.limit(0), s.limit(0), 0, 9).collect() == []


def test_realization_check(spark):
    items = [(1, "a", True), (1, "b", False), (2, "a", True), (3, "a", False), (4, "a", None)]
    reports = [(1, "a", "realized", "she left"), (1, "b", "absent", ""), (2, "a", "absent", "never said"), (2, "z", "realized", None), (4, "a", None, "x")]
    b = spark.createDataFrame(items, "bundle int, item string, required boolean")
    r = spark.createDataFrame(reports, "bundle int, item string, status string, evidence string")
    t = spark.createDataFrame([(1, "Then she left."), (2, "Nothing.")], "bundle int, text string")
    got = {x["bundle"]: tuple(x)[1:] for x in L.realization_check(b, r, t).collect()}
    assert got == {1: (0, 0, 0, 0, True), 2: (0, 1, 1, 1, False), 3: (1, 0, 0, 0, False), 4: (0, 0, 1, 0, False)}


def test_inherit_verified(spark):
    rows = [(1, "one\ntwo\nthree", sha("one\ntwo\nthree")), (2, "changed", sha("before")), (3, "unaudited", sha("unaudited")), (4, None, sha("")), (5, "no hash", None)]
    d = spark.createDataFrame(rows, "id int, text string, text_hash string")
    a = spark.createDataFrame([(i,) for i in (1, 2, 4, 5, 1)], "id int")
    got = {r["id"]: (r["campaign"], r["child"], r["child_hash"]) for r in L.inherit_verified(d, a, "c2", 2).collect()}
    assert got == {1: ("c2", "one\ntwo", sha("one\ntwo")), 4: ("c2", "", sha(""))}


def test_resolve_profiles(spark):
    nodes = [("noir", "genre", 0, ["farce"], ["fiction"]), ("farce", "genre", 0, [], ["fiction"]), ("fiction", "genre", 0, None, None), ("hot", "heat", 3, [], []), ("cool", "heat", 1, [], [])]
    n = spark.createDataFrame(nodes, "node string, namespace string, rank int, excludes array<string>, above array<string>")
    profiles = [("good", ["noir", "cool", "cool"], ["noir"], ["hot"], 2), ("bad", ["noir", "farce", "fiction", "hot", "odd"], ["cool"], ["hot"], 2), ("none", None, None, None, None)]
    p = spark.createDataFrame(profiles, "profile string, selected array<string>, required array<string>, prohibited array<string>, ceiling int")
    got = {r["profile"]: (r["violations"], r["resolved"]) for r in L.resolve_profiles(p, n, {"genre": (1, 2), "heat": (0, None)}).collect()}
    bad = ["excludes:noir", "many:genre", "missing:cool", "prohibited:hot", "rank:hot", "redundant:farce", "redundant:noir", "unknown:odd"]
    assert got == {"good": ([], ["cool", "noir"]), "bad": (bad, None), "none": (["few:genre"], None)}


def test_rubric_overlay(spark):
    r = spark.createDataFrame([("p", "defect", "late", 0.5), ("p", "priority", "x", 0.5), ("q", "priority", "x", 1.0)], "profile string, kind string, item string, weight double")
    got = sorted(tuple(x) for x in L.rubric_overlay(r, ["why"], ["late", "late"]).collect())
    assert got == [("p", "defect", "late", 0.5), ("p", "diagnostic", "why", 0.0), ("p", "priority", "x", 0.5), ("q", "defect", "late", 0.0), ("q", "diagnostic", "why", 0.0), ("q", "priority", "x", 1.0)]
    assert L.rubric_overlay(r, [], []).count() == 3
