"""Queries on odd rows give what their SQL gives."""

import duckdb

import __spark_entry__ as entry


def both(spark, folder, query, **tables):
    """Sorted rows of a query and of its SQL over tables (rows, schema)."""
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    found = entry.queries()[query](spark, str(folder))
    want = con.execute(entry.oracle_sql()[query]).fetchall()
    return sorted(map(tuple, found.collect())), sorted(want)


def test_a_cue_ends_where_a_word_ends(spark, tmp_path):
    texts = ['"a" enü', '"a" üen', '"a" En.', '"a" x\nla\n', '"a" la_', '"a" the9', '"a" éla "b" the', '"a" underſtood', None]
    got, want = both(spark, tmp_path, "gloss_after_quote", documents=([*enumerate(texts)], "doc_id long, text string"))
    assert got == want and [r[2] for r in got] == [0, 0, 1, 1, 0, 0, 1, 1, 0]


def test_scores_are_not_shuffled(spark, tmp_path):
    """hybrid_score and bm25 with copies of equal score, texts without words, an empty query and several blocks."""
    from corpusx.operators import batched

    docs = [(i, f"word{i % 7} drum {'echo ' * (i % 5)}{'x ' * (300 * (i % 3))}" if i % 11 else None, "en" if i % 2 else None) for i in range(90)]
    passages = [(1, "word1 echo drum"), (2, "word2 word3 echo"), (3, "zz of"), (4, None)]
    tables = {"documents": ([(i, t, g, len(t or "")) for i, t, g in docs], "doc_id long, text string, lang string, n_chars long"), "benchmark": (passages, "item_id long, text string")}
    before, batched.BLOCK = batched.BLOCK, 2
    try:
        for query in ("hybrid_score", "bm25"):
            folder = tmp_path / query
            got, want = both(spark, folder, query, **tables)
            assert got == want and got
        plan = entry.queries()["bm25"](spark, str(folder))._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(query_id" not in plan and "hashpartitioning(doc_id" not in plan
    finally:
        batched.BLOCK = before


def test_prior_overlap_of_copies_and_repeated_ids(spark, tmp_path, monkeypatch):
    """Copies, rows of one id, a null id, and lists that are dealt out in pieces."""
    from corpusx.operators import overlap

    passage, other = " ".join(f"p{i}" for i in range(40)), " ".join(f"q{i}" for i in range(20))
    texts = [passage, passage, f"x {passage} y", other, f"{passage} {other}", " ".join(f"p{i}" for i in range(5, 30)), passage, None, "short"]
    docs = [*enumerate(texts), (3, passage), (4, passage), (None, passage), (9, other), (9, other)]
    for piece in (2_000, 1):
        monkeypatch.setattr(overlap, "PIECE", piece)
        got, want = both(spark, tmp_path / str(piece), "prior_overlap", documents=(docs, "doc_id long, text string"))
        assert got == want and len(got) > 20


def test_mined_spans_leave_their_text_where_it_lies(spark, tmp_path):
    """Copies, spans beside a passage and across it, known spans; only offsets and hashes are shuffled."""
    import re

    passage = "one, two three four five six seven eight nine ten eleven twelve thirteen."
    fresh = "aa, bb cc dd ee ff gg hh ii jj kk ll mm."
    texts = [passage, f"{fresh} {passage}", f"{fresh}\n{passage}\n{fresh}", fresh, f"x {fresh}", "one, two three four five six seven a b c d e f.", None, "", "known, a b c d e f g h i j k l m.", "’one’, two b c d e f g h i j k l m."]
    tables = {"documents": ([*enumerate(texts)], "doc_id long, text string"), "benchmark": ([(1, passage), (2, None)], "item_id long, text string"), "conversations": ([(1, texts[8]), (2, None)], "conv_id long, text string")}
    got, want = both(spark, tmp_path, "mine_spans", **tables)
    assert got == want and len(got) == 4
    plan = entry.queries()["mine_spans"](spark, str(tmp_path))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", plan)
    assert moved and not any("text" in m for m in moved)


def test_style_of_long_texts_without_an_end(spark, tmp_path):
    """Counted in one pass: tried from each of its characters, the long text took minutes."""
    import time

    texts = ["a word " * 40_000, None, "", "...", "a.b!!c?", "x’-- y_-'z- -q 'n' ß’ 日本-語. -", "Two ends.. Here!? and, more", "\n.\n", "é-é é’s. 12-3, _a_ -", "😀. a"]
    rows = [(i, t, "en" if i % 2 else "de") for i, t in enumerate(texts)]
    began = time.time()
    for query in ("surface_style", "distribution_distance", "batch_style_rollup"):
        got, want = both(spark, tmp_path / query, query, documents=(rows, "doc_id long, text string, lang string"))
        assert got == want and got
    assert time.time() - began < 40


def test_all_metrics_of_style(spark, tmp_path):
    texts = ['He said “never again, no” and left. The old sea! "Why?" Was it loud; the voice—or not?\n\nA second part.”’ It ends', None, "", "...", "one", "a a. b; c –\n \nthe the the", '"open and no end. x', "é-é é’s. 12-3, _a_ -\n\n\n'AS' the"]
    got, want = both(spark, tmp_path, "style_metrics", documents=([*enumerate(texts)], "doc_id long, text string"))
    assert got == want
    assert got[0][1:7] == (23, 6, 3.8333, 2.3393, 11.5, 0.173913)  # sentences of 7, 3, 1, 7, 3 and 2 words, 4 of them in speech
    assert [r[1] for r in got[1:5]] == [0, 0, 0, 1] and got[5][-1][0] == round(2 / 7, 6)


def test_every_metric_has_a_distance(spark, tmp_path):
    """A declared tolerance goes before the deviation, a metric without either has no row, and equal texts deviate by nothing."""
    from corpusx.operators import style

    texts = ["One two. Three four five!", "A b; c d e f. “G h i” j?", None, "x"]
    got, want = both(spark, tmp_path / "a", "distribution_diagnostics", documents=([*enumerate(texts)], "doc_id long, text string"))
    assert got == want and {r[1] for r in got} == set(style.NUMBERS) and len(got) == 4 * len(style.NUMBERS)
    got, want = both(spark, tmp_path / "b", "distribution_diagnostics", documents=([(1, "one two."), (2, "one two.")], "doc_id long, text string"))
    assert got == want and all(r[5] == 0 and r[6] for r in got)
    m = spark.createDataFrame([(1, 3.0, 8.0, 5.0)], "i int, a double, b double, c double")
    p = spark.createDataFrame([("a", 2.0, 0.5, 9.0), ("b", 5.0, None, 3.0), ("c", 1.0, None, None), ("d", 1.0, 1.0, 1.0)], "metric string, mean double, tolerance double, stddev double")
    assert sorted(map(tuple, style.distribution_diagnostics(m, p, "i", ("a", "b", "c")).collect())) == [(1, "a", 3.0, 2.0, 0.5, 2.0, False), (1, "b", 8.0, 5.0, 3.0, 1.0, True)]


def test_retrieval_by_rough_scores(spark, tmp_path, monkeypatch):
    """With copies, nulls, and terms that few briefs want."""
    import random

    from corpusx.operators import ordinal

    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice("the de und la of sea ship wind old is".split()) if rng.random() < 0.5 else f"w{rng.randrange(400)}" for _ in range(n))
    texts = [words(rng.choice([20, 150, 400, 900])) + rng.choice([".", "!", "", "?\nthe end"]) for _ in range(300)]
    docs = [(i, t, rng.choice(["src1", "src3", "src7", None])) for i, t in enumerate([*texts, *texts[:40], None, ""])]
    turns = [(c, 0, None if c == 7 else words(rng.choice([4, 30, 90]))) for c in range(200)]
    tables = {"documents": (docs, "doc_id long, text string, source string"), "conversations": (turns, "conv_id long, turn int, text string")}
    for frequent in (96, 3):
        monkeypatch.setattr(ordinal, "FREQUENT", frequent)
        for query in ("ordinal_retrieval", "stage_retrieval"):
            got, want = both(spark, tmp_path / f"{frequent}-{query}", query, **tables)
            assert got == want and len(got) > 300


def test_few_cells_are_scored_exactly(monkeypatch):
    """A task gives what scoring every cell gives, in pieces of any size, and scores few of them."""
    import random

    import numpy as np
    import pyarrow as pa

    from corpusx.operators import ordinal as R

    rng = random.Random(3)
    terms = lambda n: sorted({f"w{min(rng.randrange(300), rng.randrange(300))}" for _ in range(n)})
    rows = [{"ordinal": rng.choice([0, 1]), "mode": rng.choice(["a", "b", None]), "wanted": terms(20), "acts": terms(3), "lo": 1, "hi": rng.choice([1, 2]), "barred": rng.choice([[], ["b"]])} for _ in range(60)]
    count, texts = 3_000, [terms(rng.choice([20, 90])) for _ in range(3_000)]
    columns = {"passage": rng.sample(range(9_000), count), "ordinal": [rng.choice([0, 1, 2, 3, None]) for _ in range(count)], "mode": [rng.choice(["a", "b", "c", None]) for _ in range(count)], "terms": texts, "card_terms": [t[:6] for t in texts]}
    columns |= {n: [rng.random() for _ in range(count)] for n in ("dialogue", "agency", "humor", "boundary")} | {"card_acts": [t[:2] for t in texts]}
    part, scored, total = pa.RecordBatch.from_pydict(columns), [], R.OrdinalScores.total
    scores = R.OrdinalScores(rows, R.ORDINAL)
    row, nth = (x.ravel() for x in np.indices((count, len(rows))))
    every = total(scores, part, {n: m.exact(m.held(part, *c), row, nth) for n, (m, c) in scores.shares.items()}, row, nth).reshape(count, -1)
    ids, level, mode = (np.array(columns[c]) for c in ("passage", "ordinal", "mode"))
    want = set()
    for n, r in enumerate(rows):
        open_ = [i for i in range(count) if level[i] is not None and r["lo"] <= level[i] <= r["hi"] and mode[i] not in r["barred"]]
        want |= {(n, int(ids[i])) for i in sorted(open_, key=lambda i: (-every[i, n], ids[i]))[:5]}
    monkeypatch.setattr(R.OrdinalScores, "total", lambda self, part, share, row, nth: scored.append(len(row)) or total(self, part, share, row, nth))
    for cells in (1 << 20, 1 << 12):
        monkeypatch.setattr(R, "CELLS", cells)
        scored.clear()
        got = [(n, i, s) for b in R.picked(iter([part.slice(0, 1_000), part.slice(1_000)]), scores, len(rows), 5) for n, i, s in zip(*b.to_pydict().values(), strict=True)]
        best = {(n, i) for k in range(len(rows)) for n, i, _ in sorted((g for g in got if g[0] == k), key=lambda g: (-g[2], g[1]))[:5]}
        assert best == want and sum(scored) < 0.05 * every.size


def test_phrases_of_long_turns(spark, tmp_path):
    """The words of a turn are made once: made for each of its n-grams, this took minutes."""
    import time

    long = " ".join(f"w{i % 9_000}" for i in range(12_000))
    turns = [(1, 1, long), (1, 2, f"x {long}"), (1, 3, None), (1, 4, "a b c d e a b c d"), (1, 5, "A b c d’ e"), (2, 1, "alone"), (3, 1, ""), (3, 2, "a b c")]
    began = time.time()
    got, want = both(spark, tmp_path, "control_phrase_overlap", conversations=(turns, "conv_id long, turn int, text string"))
    assert got == want and len(got) == 2 and time.time() - began < 30


def test_the_top_k_shuffles_no_postings(spark, tmp_path, monkeypatch):
    """Copies of equal score, rows of one id, null ids, a passage given twice, words of all documents, several blocks and pieces; a task gives k documents a query."""
    from pyspark.sql import DataFrame

    from corpusx.operators import batched, ranking
    from corpusx.scratch import Scratch

    text = lambda i: f"the word{i % 7} drum {'echo ' * (i % 5)}{'pad ' * (40 * (i % 3))}{f'rare{i // 9} ' * (i % 4)}"
    docs = [(i, text(i) if i % 11 else None) for i in range(150)] + [(500 + i, text(3)) for i in range(60)] + [(3, text(4)), (4, None), (4, text(4)), (None, "word1 drum"), (None, "rare2")]
    passages = [(1, "the word1 echo drum rare2"), (2, "the word2 word3 echo"), (3, "zz of"), (4, None), (5, "rare1 rare7 the drum"), (5, "rare1 rare7 the drum"), (6, "word3"), (7, "the drum the")]
    tables = {"documents": (docs, "doc_id long, text string"), "benchmark": (passages, "item_id long, text string")}
    written, keep = {}, Scratch.keep

    def kept(self, df: DataFrame, name: str = "t", batch: int | None = None) -> DataFrame:
        written[name] = keep(self, df, name, batch)
        return written[name]

    monkeypatch.setattr(Scratch, "keep", kept)
    for block, cells in ((2_000, 1 << 20), (2, 1 << 20), (2_000, 64)):
        monkeypatch.setattr(batched, "BLOCK", block)
        monkeypatch.setattr(batched, "CELLS", cells)
        monkeypatch.setattr(ranking, "CELLS", cells)
        folder = tmp_path / f"{block}-{cells}"
        got, want = both(spark, folder, "bm25_top", **tables)
        assert got == want and len(got) == 50
        if block == 2_000 and cells > 64:
            assert max(t.count() for t in written.values()) <= len(docs)  # no row for each posting
            assert written["found"].where("score is not null").groupBy("nth").count().agg({"count": "max"}).first()[0] < 40  # of 210 with the words
    plan = entry.queries()["bm25_top"](spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and "hashpartitioning(doc_id" not in plan and "hashpartitioning(term" not in plan
