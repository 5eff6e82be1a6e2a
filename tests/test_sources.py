import hashlib

import pytest

from corpusx.plans import evidence
from corpusx.sources import records as R


def test_json_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\n{"id": 2, "t": null}\n')
    rows = R.scan_json_records(spark, str(tmp_path), "id long, t string").orderBy("id").collect()
    assert [(r.id, r.t) for r in rows] == [(1, "x"), (2, None)] and rows[0]._file.endswith("a.jsonl")
    (tmp_path / "b.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):  # noqa: B017
        R.scan_json_records(spark, str(tmp_path), "id long, t string").collect()
    assert [r._corrupt_record for r in R.scan_json_records(spark, str(tmp_path), "id long, t string", strict=False).collect() if r._corrupt_record] == ["{broken"]


def test_text_corpus(spark, tmp_path):
    (tmp_path / "w.txt").write_text("Grüße\n\nzwei")
    h = hashlib.sha256("Grüße\n\nzwei".encode()).hexdigest()
    make = lambda *rows: spark.createDataFrame(list(rows), "work_id string, path string, text_hash string, partition string")
    assert R.scan_text_corpus(spark, make(("w", "w.txt", h, "holdout")), str(tmp_path)).first().text == "Grüße\n\nzwei"
    for bad in (("w", "w.txt", "0", "holdout"), ("w", "none.txt", h, "holdout"), ("w", "w.txt", h, "other")):
        with pytest.raises(Exception):  # noqa: B017
            R.scan_text_corpus(spark, make(bad), str(tmp_path)).collect()


def test_export_and_verify(spark, tmp_path):
    root = str(tmp_path / "out")
    with pytest.raises(ValueError):
        R.export_manifest(spark, {"a": spark.range(3)}, ["b"], root)
    m = R.export_manifest(spark, {"a": spark.range(3).coalesce(1), "b": spark.range(2).coalesce(1)}, ["a", "b"], root)
    rows = m.collect()
    fixed = spark.createDataFrame(rows, m.schema)
    assert {r.finding for r in R.verify_manifest(fixed, R.file_hashes(spark, root)).collect()} == {"ok"}
    wrong = spark.createDataFrame([r.asDict() | {"sha256": "0"} for r in rows[:1]], m.schema)
    assert sorted(r.finding for r in R.verify_manifest(wrong, m).collect()) == ["hash differs", "undeclared"]
    assert sorted(r.finding for r in R.verify_manifest(fixed.union(fixed.limit(1)), m.limit(0)).collect()) == ["absent", "absent"]


def test_merge(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "id long, text string")
    got = R.merge_corpus(make((1, "a"), (2, None), (3, "c")), make((2, None), (3, "d"), (4, "e")), "id", ["text"])
    assert {r.id: r.verdict for r in got.collect()} == {1: "kept", 2: "identical", 3: "conflict", 4: "inserted"}


def test_chunk_scenes(spark):
    para = lambda n: " ".join(["word"] * n)
    text = "\n".join([para(200), "a b", para(150), para(100), para(700)])
    got = evidence.chunk_scenes(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).collect()
    # 200 + 150 + 100 closes before 700 words; its last paragraph of 100 opens the next chunk
    assert [(r.doc_id, r.idx, r.words, r.paras) for r in got] == [(1, 0, 450, 3), (1, 1, 800, 2)]
