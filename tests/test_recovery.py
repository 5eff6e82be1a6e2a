"""Mined spans, authorship, replays, cards, retrieval, signatures, quotes and cadence: odd cases and brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusx.functions.spans import causal_windows, complete_prefix, without_overlap
from corpusx.operators import authorship, lsh, mining, ordinal, ranking, voices
from corpusx.scratch import Scratch

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_causal_windows_against_all_pairs():
    text = "One two. Three four!\n\nFive six seven? Eight.\nnine ten\n  \nEleven twelve thirteen. Fourteen\n"
    ends = [m.end() - (m.group()[-1] in " \n") for m in re.finditer(r"[^\n]*?(?:[.!?](?: |\n|\Z)|\n|\Z)", text) if m.group().strip()]
    lines = [(m.start(), m.end()) for m in re.finditer(r"[^\n]+", text) if m.group().strip()]
    want = set()
    for i, (a, _) in enumerate(lines):
        for e in ends:
            reach = [j for j, (x, y) in enumerate(lines) if x < e <= y]
            if e > a and reach and reach[0] < i + 2 and 3 <= (n := len(re.findall(r"\w+", text[a:e]))) <= 7:
                want.add((a, e, n))
    assert set(causal_windows(text, 3, 7, 2)) == want and want
    assert list(causal_windows("", 1, 9, 3)) == [] == list(causal_windows("\n \n", 1, 9, 3))
    assert len(list(causal_windows("word. " * 5000, 1, 90, 3))) == 90  # one line has one start


def test_complete_prefix_needs_an_end_and_closed_quotes():
    assert complete_prefix('One two three.\n\n"Four five\n\nsix." Seven.\n\nEight', 1, 20) == (0, 40, 7)
    assert complete_prefix("  One two.\nthree four.\nFive.", 1, 4) == (2, 22, 4)
    assert complete_prefix("One two.\nthree four", 1, 9) is None  # the next line goes on in small letters
    assert complete_prefix("One “two.\n\nthree” four.", 1, 9) == (0, 23, 4) and complete_prefix("", 0, 9) is None
    assert complete_prefix("One two three.", 4, 9) is None and complete_prefix("One two three.", 1, 2) is None


def test_mine_spans(spark):
    docs = spark.createDataFrame([(1, "Alpha beta, gamma delta. More words here."), (2, "Alpha beta, gamma delta.\nzeta eta theta iota kappa"), (3, None), (4, ""), (None, "Known, already seen. x"), (5, "zeta eta theta, iota kappa.")], "doc_id long, text string")
    sources = spark.createDataFrame([("zeta eta theta iota",), (None,)], "text string")
    known = spark.createDataFrame([(sha("Known, already seen."),)], "hash string")
    got = mining.mine_spans(docs, sources, known, [(",", True), ("9", False)], least=3, most=6, n=4).collect()
    assert [(r["id"], r["start"], r["stop"], r["text"], r["hash"]) for r in got if r["id"] == 1] == [(1, 0, 24, "Alpha beta, gamma delta.", sha("Alpha beta, gamma delta."))]
    assert {r["text"] for r in got} == {"Alpha beta, gamma delta.", "Known, already seen. x"}
    everything = mining.mine_spans(docs, sources.where("false"), known.where("false"), [], least=3, most=6, n=4)
    assert "zeta eta theta, iota kappa." in {r["text"] for r in everything.collect()}


def test_reextract_twice_changes_nothing(spark):
    raw = {1: "Whole sentence here. And more.\n\nTail", 2: "no end", 3: "Other words here.", 4: "Four words are here.", 5: "Five words are in here.", 6: None}
    log = spark.createDataFrame([(i, 1, None if i != 4 else "kept", "aborted" if i == 3 else "stop", sha(t or ""), f"t{i}") for i, t in raw.items()] + [(5, 2, "later", "stop", sha(raw[5]), "t"), (7, 1, "", "stop", "h", "t7"), (8, 1, "", None, "wrong", "t8")],
                                "id long, version_no int, segment string, finish string, raw_hash string, text_hash string")
    raws = spark.createDataFrame([*raw.items(), (8, "Changed since.")], "id long, raw string")
    got = mining.reextract_failed(log, raws, "v9", 3, 9, [("more", True)]).collect()
    assert {(r["id"], r["error"], r["segment"], r["eligible"]) for r in got} == {(1, None, "Whole sentence here. And more.", True), (7, "raw text is gone", None, None), (8, "raw hash changed", None, None)}
    done = spark.createDataFrame([(r["id"], 99, r["segment"], "stop", sha(raw[r["id"]]), r["segment_hash"]) for r in got if not r["error"]], log.schema)
    assert {r["id"] for r in mining.reextract_failed(log.unionByName(done), raws, "v9", 3, 9).collect()} == {7, 8}


def test_authorship_tells_every_error(spark):
    calls = spark.createDataFrame([("a", "completed", "m", "p", 1, "Text one\nmore"), ("b", "started", "m", "p", 1, "x"), ("c", "completed", "m", "p", 1, "x"), ("c", "completed", "m", "p", 2, "x"), ("d", "completed", None, "p", 1, "x"), ("e", "completed", "m", None, None, None)],
                                  "call string, status string, model string, prompt_hash string, seed int, response string")
    rows = [("1", "a", "Text one", "model_generation", "research", [], "first_line"), ("2", "b", "x", "model_generation", "research", None, "whole"), ("3", "c", "x", None, None, [], "whole"), ("4", "d", "x", "k", "s", [], "whole"),
            ("5", "a", "Text", "model_generation", "research", [], "first_line"), ("6", "a", "Text one", "model_generation", "record", ["1", "2"], "first_line"), ("7", "a", "Text one", "model_generation", "research", ["1", "nobody"], "first_line"),
            ("8", "e", None, "model_generation", "research", None, "stripped"), ("9", "a", "Text one", "k", "s", [], "magic"), ("10", None, "x", "k", "s", [], "whole"), ("1", "a", "Text one", "model_generation", "research", [], "first_line")]
    artifacts = spark.createDataFrame(rows, "artifact string, call string, text string, kind string, scope string, parents array<string>, rule string")
    got = authorship.build_authorship(artifacts, calls).collect()
    assert {(r["artifact"], r["error"], r["eligible"]) for r in got} == {("1", None, True), ("2", "unbound", False), ("3", "ambiguous", False), ("4", "no identity", False), ("5", "other text", False), ("6", None, False), ("7", "missing parent", False), ("8", None, True), ("9", "unknown rule", False), ("10", "unbound", False)}
    assert len(got) == len(rows) and all((r["record_hash"] is None) == (r["error"] is not None) for r in got)
    assert authorship.build_authorship(artifacts.where("false"), calls).count() == 0


def test_replay_rejects_down_the_generations(spark):
    t = {"a": "A", "b": "B", "c": "A\n\nB\n\nc", "d": "A\n\nB\n\nc\n\nd", "e": "A\n\nB\n\nc\n\nd\n\ne", "f": "A\n\nf", "g": "wrong", "h": "wrong\n\nh", "i": "A\n\ni", "j": "no"}
    parents = {"c": ["a", "b"], "d": ["c"], "e": ["d"], "f": ["a"], "g": ["a"], "h": ["g"], "i": ["a", "gone"], "j": ["j"]}
    generation = {"a": 0, "b": 0, "c": 1, "d": 2, "e": 3, "f": 1, "g": 1, "h": 2, "i": 1, "j": 1}
    rows = [(k, generation[k], parents.get(k), k if k not in "ab" else k.upper(), v, sha(v) if k != "f" else "x") for k, v in t.items()]
    items = spark.createDataFrame(rows, "item string, generation int, parents array<string>, segment string, text string, text_hash string")
    got = {r["item"]: r["error"] for r in authorship.replay_import(items, "n", [("d", False)]).collect()}
    assert got == {"a": None, "b": None, "c": None, "d": "gate", "e": "parent rejected", "f": "text hash", "g": "lineage", "h": "parent rejected", "i": "missing parent", "j": "generation"}
    assert {r["error"] for r in authorship.replay_import(items.where("item in ('a', 'b', 'c')"), "n").collect()} == {None}


def test_cards(spark):
    deck = "preface|CARD 1|Role|lead|Evidence|seen|Role|second|Dynamic|CARD 2|Dynamic|pull|x|CARD 3|Role|r|CARD 4"
    docs = spark.createDataFrame([(1, deck), (2, "no card"), (3, None), (4, "CARD 9||  |Evidence| e |")], "doc_id long, text string")
    got = authorship.extract_cards(docs, r"CARD \d+", ["Role", "Evidence", "Dynamic"], ["Evidence", "Dynamic"], r"\|")
    assert sorted(tuple(r) for r in got.select("id", "nth", "heading", "Role", "Evidence", "Dynamic", "mechanism", "error").collect()) == [
        (1, 0, "CARD 1", "second", "seen", None, "seen", None), (1, 1, "CARD 2", None, None, "pull", "pull", None), (1, 2, "CARD 3", "r", None, None, None, "no Evidence or Dynamic"), (1, 3, "CARD 4", None, None, None, None, "no Evidence or Dynamic"),
        (4, 0, "CARD 9", None, "e", None, "e", None)]


def test_ordinal_retrieval_in_blocks(spark, monkeypatch):
    passages = ordinal.passage_features(spark.createDataFrame([(i, "ask and go. " * (i % 3), "card go" if i % 2 else None, i % 4, f"m{i % 2}") for i in range(30)] + [(99, None, None, None, None)], "passage long, text string, card string, ordinal int, mode string"), 18, 8, "ask", cues={"ask": "ask"})
    passages = passages.withColumn("card_acts", F.col("card_terms"))
    cells = spark.createDataFrame([(c, c % 4, "m1", ["go", "ask"], ["go"]) for c in range(9)], "cell long, ordinal int, mode string, wanted array<string>, acts array<string>")
    bands = spark.createDataFrame([(0, 0, 0, None), (1, 1, 2, ["m0"]), (2, 1, 3, None)], "ordinal int, lo int, hi int, barred array<string>")
    once = sorted(map(tuple, ordinal.ordinal_retrieval(cells, passages, bands, 4).collect()))
    level = {r["passage"]: (r["ordinal"], r["mode"]) for r in passages.collect()}
    assert {c for c, *_ in once} == {0, 1, 2, 4, 5, 6, 8} and all(r <= 4 for _, _, r, _ in once)  # ordinal 3 has no band
    assert all(level[p][0] == 0 for c, p, _, _ in once if c % 4 == 0) and all(level[p][0] in (1, 2) and level[p][1] == "m1" for c, p, _, _ in once if c % 4 == 1)
    monkeypatch.setattr(ordinal, "BLOCK", 2)
    assert sorted(map(tuple, ordinal.ordinal_retrieval(cells, passages, bands, 4).collect())) == once
    plan = ordinal.ordinal_retrieval(cells, passages, bands, 4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    profiles = spark.createDataFrame([("s", ["go"], 0, 0, 3, None, 2), ("t", ["go"], None, 1, 2, ["ask"], 1)], "stage string, stage_terms array<string>, reach int, shift int, top int, cues array<string>, quota int")
    tasks = spark.createDataFrame([(1, "s", 1, ["x"], ["go"]), (2, "t", 1, ["x"], ["go"]), (3, "u", 1, [], [])], "task long, stage string, ordinal int, brief array<string>, movement array<string>")
    got = ordinal.stage_retrieval(tasks, passages, profiles, (0, 1, 2, 3)).collect()
    assert sorted((r["task"], r["rank"]) for r in got) == [(1, 1), (1, 2), (2, 1)] and all(level[r["passage"]][0] <= 1 for r in got if r["task"] == 1)


def test_bm25_top_equals_the_full_scores_and_joins_less(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(["the"] * rng.randrange(1, 9) + rng.choices(words, [1 / (i + 1) for i in range(400)], k=rng.randrange(5, 60))) for _ in range(600)]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(q, "the " + " ".join(rng.choices(words, k=4))) for q in range(30)] + [(50, None), (51, "zz of"), (52, "the the")], "query_id long, text string")
    got = ranking.bm25_top(queries, docs, 7).collect()
    full = ranking.bm25_scores(queries, docs).withColumn("score", F.round("score", 4)).collect()
    want = set()
    for q in {r["query_id"] for r in full}:
        best = sorted((-r["score"], r["doc_id"]) for r in full if r["query_id"] == q)[:7]
        want |= {(q, d, i, -s) for i, (s, d) in enumerate(best, 1)}
    assert {(r["query_id"], r["doc_id"], r["rank"], r["score"]) for r in got} == want
    spent = {r["query_id"]: (r["joined"], r["postings"]) for r in got if r["query_id"] < 50}
    assert sum(a for a, _ in spent.values()) < 0.6 * sum(b for _, b in spent.values())


def jaccard(a, b, n=5):
    grams = lambda t: {tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x and y else 0


def test_minhash_join_recall(spark, monkeypatch):
    rng = random.Random(3)
    base = [" ".join(f"t{rng.randrange(3000)}" for _ in range(60)) for _ in range(60)]
    near = [" ".join(w if rng.random() > 0.01 * (i % 12) else "x" for w in t.split()) for i, t in enumerate(base * 4)]
    a = spark.createDataFrame([*enumerate(near + ["short text", None, base[0], base[0]])], "id long, text string")
    b = spark.createDataFrame([*enumerate([*base, "", "short text"])], "item long, text string")
    truth = {(i, j): s for i, x in enumerate(near + ["short text", "", base[0], base[0]]) for j, y in enumerate(base) if (s := jaccard(x, y)) >= 0.4}
    got = {(r["id"], r["other_id"]): r["similarity"] for r in lsh.minhash_join(a, b, ("id", "item")).collect()}
    assert set(got) <= set(truth) and all(got[k] == pytest.approx(truth[k], abs=1e-6) for k in got)
    assert len(got) >= 0.9 * len(truth) and (242, 0) in got and (243, 0) in got
    monkeypatch.setattr(lsh, "PIECE", 1)  # every bucket of two classes or more is cut
    assert {(r["id"], r["other_id"]) for r in lsh.minhash_join(a, b, ("id", "item")).collect()} == set(got)


def test_quotes_voices_and_cadence(spark):
    docs = spark.createDataFrame([(1, 'Ann said, "come here now". Then “why not go” asked Bob. "unclaimed words"\n"a"'), (2, None), (3, 'x "pen')], "doc_id long, text string")
    verbs = "said|asked"
    q = voices.attributed_quotes(docs, rf"([A-Z][a-z]+) (?:{verbs})[, ]*$", rf"^ (?:{verbs}) ([A-Z][a-z]+)")
    got = q.collect()
    assert [(r["nth"], r["quoted"], r["speaker"]) for r in got] == [(0, "come here now", "Ann"), (1, "why not go", "Bob"), (2, "unclaimed words", None)]
    text = docs.first()["text"]
    assert all(text[r["start"] + 1 : r["stop"] - 1] == r["quoted"] for r in got)
    said = q.select(F.lit(1).alias("grp"), F.col("speaker").alias("voice"), F.col("quoted").alias("text")).unionByName(spark.createDataFrame([(1, "Ann", "why go")], "grp int, voice string, text string"))
    pair = voices.voice_similarity(said).collect()
    assert [(r["voice_a"], r["voice_b"], r["vocabulary"]) for r in pair] == [("Ann", "Bob", round(2 / 6, 6))]
    assert without_overlap([[(0, 4), (10, 12)], [(3, 6), (6, 8), (11, 20)], [(7, 9), (8, 9), (20, 22)]]) == [(0, 4), (6, 8), (8, 9), (10, 12), (20, 22)]
    c = voices.cadence_families(docs, {"f": ["come here", "here now"], "g": ["here now", "o"]}, 2).collect()
    assert {(r["id"], r["family"]): (r["hits"], r["evidence"]) for r in c if r["id"] == 1} == {(1, "f"): (1, ["come here"]), (1, "g"): (6, ["o", "here now"])}
    assert all(r["hits"] == 0 and r["evidence"] == [] for r in c if r["id"] != 1) and len(c) == 6


def test_ordinal_scores_are_made_in_arrays(spark, monkeypatch):
    rng = random.Random(6)
    pick = lambda n: rng.sample(["go", "ask", "run", "sea", "old", "red"], rng.randrange(n))
    rows = [(i, rng.choice([0, 1, 2, 3, None]), rng.choice(["m0", "m1", None]), pick(5), pick(3), pick(3), rng.random(), rng.random(), 1.0, rng.random()) for i in range(40)]
    rows += [(i + 100, *r[1:]) for i, r in enumerate(rows[:10] * 3)]  # copies: ties go to the least id
    fields = "passage long, ordinal int, mode string, terms array<string>, card_terms array<string>, card_acts array<string>, dialogue double, agency double, humor double, boundary double"
    cells = [(c, c % 4, rng.choice(["m0", "m1", "m7", None]), pick(6), pick(3)) for c in range(12)] + [(50, 1, None, None, None)]
    bands = {0: (0, 0, []), 1: (1, 2, ["m0"]), 2: (1, 3, [])}
    given = spark.createDataFrame(cells, "cell long, ordinal int, mode string, wanted array<string>, acts array<string>")
    b = spark.createDataFrame([(o, lo, hi, x or None) for o, (lo, hi, x) in bands.items()], "ordinal int, lo int, hi int, barred array<string>")
    monkeypatch.setattr(ordinal, "CELLS", 40)
    found = ordinal.ordinal_retrieval(given, spark.createDataFrame(rows, fields), b, 3)
    got = {(r["cell"], r["rank"]): (r["passage"], r["score"]) for r in found.collect()}
    share = lambda a, held: len(set(a or ()) & set(held)) / max(1, len(a or ()))
    want = {}
    for c, o, mode, wanted, acts in cells:
        if o not in bands:
            continue
        lo, hi, barred = bands[o]
        scored = [(-round(0.10 * share(wanted, t) + 0.20 * share(wanted, k) + 0.18 * (1 if m == mode else 0.35) + 0.18 / (1 + abs(o - level)) + 0.09 * d + 0.10 * a + 0.05 * share(acts, x) + 0.04 * h + 0.06 * e, 6), p)
                  for p, level, m, t, k, x, d, a, h, e in rows if level is not None and lo <= level <= hi and m not in barred]
        want |= {(c, n): (p, pytest.approx(-s, abs=2e-6)) for n, (s, p) in enumerate(sorted(scored)[:3], 1)}
    assert got == want and want
    assert "array_intersect" not in found._jdf.queryExecution().optimizedPlan().toString()  # no pair is a row of a join
    assert ordinal.ordinal_retrieval(given.where("cell > 99"), spark.createDataFrame(rows, fields), b, 3).isEmpty()


def test_minhash_join_writes_only_what_may_resemble(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    said = lambda k: " ".join(f"{k}{rng.randrange(3000)}" for _ in range(30))
    base = [said("t") for _ in range(20)]
    a = spark.createDataFrame([*enumerate([said("o") for _ in range(500)] + base + [None, "", "short"])], "id long, text string")
    b = spark.createDataFrame([*enumerate([*base, None])], "item long, text string")
    found = {}
    for most in (2_000_000, 3):
        monkeypatch.setattr(lsh, "MOST_LOOKED_UP", most)
        scratch = Scratch(spark, f"few{most}")
        found[most] = {tuple(r) for r in lsh.minhash_join(a, b, ("id", "item"), scratch=scratch).collect()}
        assert [t.count() for t in scratch._kept if t._scratch_path.endswith("a-members")] == [20 if most > 3 else 523]
    assert found[3] == found[2_000_000] == {(500 + i, i, 1.0) for i in range(20)}
    assert lsh.minhash_join(a, b.where("false"), ("id", "item")).collect() == []
