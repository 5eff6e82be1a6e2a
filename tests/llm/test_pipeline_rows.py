"""Rows without an id and rows with a repeated one in the stages of the pipeline."""

import re

import corpus_pipeline
from corpusx.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_dedup_keeps_every_text_once(spark):
    rows = [
        (None, "a b c"), (None, "abc"), (None, "a bc"), (3, "abc"), (None, "other"), (None, "other"), (None, None), (None, " "), (4, ""),
        (7, "x y z"), (7, "xyz"), (7, "x  y  z"), (7, "else"), (8, "xy z"), (9, "p q"), (9, "p\tq"), (9, "pq"), (9, "alone"),
    ]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_copies(spark, table(spark, rows), "").collect()]
    assert sorted(plain(t) for _, t in got) == sorted({plain(t) for _, t in rows})
    longest = {}
    for i, t in rows:
        longest[plain(t)] = max(longest.get(plain(t), 0), len(t or ""))
    assert all(len(t or "") == longest[plain(t)] for _, t in got) and set(got) <= set(rows)


def story(n, *changes):
    words = [f"w{n}x{k}" for k in range(60)]
    for k in changes:
        words[k] = f"n{n}y{k}"
    return " ".join(words)


def test_near_dedup_judges_rows_by_text(spark):
    rows = [
        (1, story(1)), (None, story(1).upper()), (None, story(2)), (None, story(3)),  # (a) clean rows without id stay
        (5, story(4)), (6, story(4, 0)), (6, story(5)),  # (b) of a repeated id only the near copy goes
        (None, story(6)), (None, story(6, 0)), (7, story(7)), (7, story(7).upper()), (None, None), (None, " "),
    ]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, table(spark, rows), "").collect()]
    one_of = [{(7, story(7)), (7, story(7).upper())}, {(None, story(6)), (None, story(6, 0))}]
    assert all(len(set(got) & s) == 1 for s in one_of) and len(got) == len(set(got))
    assert set(got) - one_of[0] - one_of[1] == {(1, story(1)), (None, story(2)), (None, story(3)), (5, story(4)), (6, story(5)), (None, None), (None, " ")}
    twice = corpus_pipeline.drop_near_copies(spark, table(spark, [*rows[:3], rows[0], rows[2], rows[-1], rows[-1]]), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in twice) == sorted([(1, story(1)), (0, story(2)), (0, " "), (0, " ")])


def test_jaccard_links_through_rows_without_id(spark):
    # 3-shingles: each change in the middle costs three of 58 tokens, so 1 and 2 are linked only through the row between them
    rows = [(1, story(8, 10)), (None, story(8)), (2, story(8, 40)), (None, story(9)), (None, story(9, 30)), (3, story(10))]
    for percent, ids in ((90, {1: 1, 2: 1, 3: 3}), (96, {1: 1, 2: 2, 3: 3})):
        got = jaccard.similar_documents(table(spark, rows), 3, percent).collect()
        assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"]} == ids
    assert jaccard.judged(table(spark, rows), 3, 90).where("kept").count() == 3
