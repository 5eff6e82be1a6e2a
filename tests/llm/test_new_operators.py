"""Fill-in-middle, language-model scores and the filter audit against brute force, with every odd case."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusx.llm import audit, fim, lmscore, ppm, unigram
from corpusx.scratch import Scratch

LONG = "long line of words\n" * 60_000 + "end"
TEXTS = [
    None, "", " ", "\n", "\n\n", "one", "one\n", "one\ntwo", "one\ntwo\n", "a\n\nb\nc\n\n", "é😀\nÜber\n日本", "has <P> inside\nx", "has <S>\nx", "<M>", "<P\n>\n<S\nM>\n", ">\n<\n<S\n", "A B\tc\x0bd",
    "abracadabra abracadabra", "THE the The", "the the the", LONG, "x" * 50_000, "one\ntwo", "5 # 3 % of & it", "CAPITALS ONLY HERE",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, form string, output string, `copy` int, word string, n long"


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, ["en", "de", None][i % 3], "s", 0, 0.5, "f", "o", 1, "w", 9) for i, t in enumerate(TEXTS)]
    return [*out, out[7], (None, "one\ntwo", "en", "s", 0, 0.1, "f", "o", 2, "w", 9), (7, "another text", "en", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def expected_fim(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("seed,rate,spm", [(7, 100, 50), (3, 60, 0), (4, 100, 100)])
def test_fim_equals_brute_force_and_restores(docs, rows, seed, rate, spm):
    got = fim.fim_restore(fim.fim_transform(docs, seed, rate, spm)).collect()
    assert len(got) == len(rows)
    want = Counter(repr((r[0], *expected_fim(r[0], r[1], seed, rate, spm), r[1] or "")) for r in rows)
    assert Counter(repr((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"])) for r in got) == want
    assert {r["source"] for r in got} == {"s", None}


def test_fim_clashing_and_empty(docs, empty):
    swapped = docs.select("doc_id", F.col("text").alias("output"), F.lit(3).alias("Form"), F.lit(1).alias("restored"))
    made = fim.fim_transform(swapped, text_col="output")
    assert sorted(made.columns) == ["doc_id", "form", "middle_chars", "n", "output", "prefix_chars", "restored"]
    back = fim.fim_restore(made, out_col="output").select("doc_id", "output").collect()
    assert Counter((r[0], r[1]) for r in back) == Counter((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
    assert fim.fim_restore(fim.fim_transform(empty)).count() == 0


def test_rotation_exchanges_blocks_of_any_size(monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 3)
    for n in range(9):
        for lo, mid, hi in itertools.combinations_with_replacement(range(n + 1), 3):
            buf = bytearray(range(n))
            fim.exchange(buf, lo, mid, hi)
            want = list(range(n))
            assert list(buf) == want[:lo] + want[mid:hi] + want[lo:mid] + want[hi:]


class Plain:
    """PPM by the book: dictionaries of counts, sets of excluded symbols."""

    def __init__(self, texts, order):
        self.order, self.counts = order, defaultdict(Counter)
        for t in texts:
            s = self.symbols(t)
            for i in range(order, len(s)):
                for k in range(order + 1):
                    self.counts[tuple(s[i - k : i])][s[i]] += 1

    def symbols(self, t):
        return [257] * self.order + list((t or "").encode()) + [256]

    def log10(self, t):
        s, out = self.symbols(t), 0.0
        for i in range(self.order, len(s)):
            excluded = set()
            for k in range(self.order, -1, -1):
                seen = self.counts.get(tuple(s[i - k : i]))
                left = {x: n for x, n in (seen or {}).items() if x not in excluded}
                if not left:
                    continue
                den = sum(left.values()) + len(left)
                if s[i] in left:
                    out += math.log10(left[s[i]] / den)
                    break
                out += math.log10(len(left) / den)
                excluded |= set(left)
            else:
                out -= math.log10(257 - len(excluded))
        return out


SAMPLE = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "", None, "thé😀 cat", "zzzz", "the cat sat on the mat"]


@pytest.mark.parametrize("order,most", [(2, 4_000_000), (3, 4_000_000), (3, 20), (4, 1)])
def test_ppm_equals_brute_force(spark, order, most):
    given = spark.createDataFrame([(t, i % 3) for i, t in enumerate(SAMPLE)], "text string, score int")
    plain = Plain(SAMPLE[:6], order)
    scratch = Scratch(spark, "t")
    top = ppm.train(given.limit(6), scratch, order)
    got = ppm.code_lengths(given, top, scratch, order, most_edges=most)
    assert got.columns == ["text", "score"] and got.count() == len(SAMPLE)
    for r in got.collect():
        assert r["score"] == pytest.approx(plain.log10(r["text"]), abs=1e-9)
    assert (len(list(ppm.parts(top, order, most))) > 1) == (most < 1000)


def test_ppm_reads_long_texts_in_pieces(monkeypatch):
    texts = ["ab" * 40, "x", "", "long " * 50, "tail"]
    monkeypatch.setattr(ppm, "PIECE", 16)
    monkeypatch.setattr(ppm, "chunks", lambda col: ppm_chunks(col, 20))
    from corpusx.llm.kernels import chunks as ppm_chunks

    cut = np.concatenate([g[(g & 511) != 257] for _, _, s, _ in ppm.runs(pa.array(texts), 3) for g in [ppm.grams(s, 3)]])
    want = []
    for t in texts:
        s = [257] * 3 + list(t.encode()) + [256]
        want += [sum(s[i - j] << (9 * j) for j in range(4)) for i in range(3, len(s))]
    assert cut.tolist() == want


def test_untrained_ppm_is_uniform(spark):
    given = spark.createDataFrame([("abc",), (None,)], "text string")
    scratch = Scratch(spark, "t")
    got = ppm.code_lengths(given, ppm.train(given.where("false"), scratch), scratch).collect()
    assert {r["text"]: round(r["score"], 9) for r in got} == {"abc": round(-4 * math.log10(257), 9), None: round(-math.log10(257), 9)}


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None]


@pytest.mark.parametrize("most", [1 << 18, 3])
def test_lm_scores_equal_brute_force(docs, rows, most):
    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 1000)
    left = [r for r in rows if len(r[1] or "") < 1000]
    learned = [r[1] for r in left if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 != 0]
    c = Counter(w for t in learned for w in tokens(t))
    total, kinds = sum(c.values()), len(c)
    plain = Plain(learned, 3)
    got = lmscore.lm_scores(short, ~lmscore.held_out(F.col("doc_id")), order=3, most_frequent=most, most_edges=50).collect()
    want = []
    for r in left:
        t = tokens(r[1])
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t)
        want.append((-1 if r[0] is None else r[0], len(t), sum(w in c for w in t), total, round(base, 6), round(plain.log10(r[1]), 6)))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == sorted(want)


def test_lm_scores_of_empty_tables_and_long_texts(docs, empty):
    assert lmscore.lm_scores(empty, F.lit(True)).count() == 0
    got = lmscore.lm_scores(docs, F.lit(False)).collect()  # nothing to learn from
    assert all(r["train_tokens"] == 0 == r["n_known"] and r["base_score"] == pytest.approx(0, abs=1e-9) for r in got)
    assert max(r["n_tokens"] for r in got) == 240_002


def test_words_of_long_texts_are_never_cut(monkeypatch):
    monkeypatch.setattr(unigram, "PIECE", 8)
    texts = ["aaaa bb cccccccccccccccccccc d  ee", "x", "averyverylongwordofmanyletters", "  "]
    monkeypatch.setattr(unigram, "chunks", lambda col: small(col, 10))
    from corpusx.llm.kernels import chunks as small

    known = unigram.Frequent([b"bb", b"x"], np.array([5, 7]))
    words, hits, logs, rare = unigram.of_texts(pa.array(texts), known)
    assert words.tolist() == [5, 1, 1, 0] and hits.tolist() == [1, 1, 0, 0] and logs[1] == pytest.approx(math.log10(7.1))
    assert sorted(r["word"] for r in rare.to_pylist()[0]) == [b"aaaa", b"c" * 20, b"d", b"ee"]


def audit_brute(rows, labels):
    text = lambda r: r[1] or ""
    cells = defaultdict(list)
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text(r))
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text(r))) > 10 * len(text(r)), "D": bool(re.search(r"[#$%&*|]", text(r))),
            "E": r[0] is not None and any(o[0] is not None and o[0] < r[0] and text(o) == text(r) for o in rows),
        }
        own = [x for x in labels if r[0] is not None and x[0] == r[0]]
        cells[r[2] or ""].append((fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, shapley = [], Counter()
    for part, items in cells.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = items
            for step, f in enumerate(order, 1):
                removed = [x for x in left if x[0][f]]
                gone = [x for x in items if any(x[0][g] for g in order[: step - 1])]
                left = [x for x in left if not x[0][f]]
                unique = sum(x[0][f] and sum(x[0].values()) == 1 for x in items)
                out.append((part, order, step, len(left), len(removed), sum(x[0][f] for x in gone), unique, sum(x[1] for x in removed), sum(x[2] for x in removed)))
                shapley[part, f] += len(removed)
    return sorted((*x, shapley[x[0], x[1][x[2] - 1]]) for x in out)


def test_filter_audit_equals_brute_force(spark, docs, rows, monkeypatch):
    labels = [(1, 1, 0), (7, 1, None), (7, 0, 1), (22, None, 1), (None, 1, 1), (23, 1, 1), (24, 1, 1), (999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = audit_brute(rows, labels)
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r[n] for n in names) for r in audit.filter_audit(docs, table).collect()) == want
    monkeypatch.setattr(audit, "MOST_BROADCAST", 0)
    assert sorted(tuple(r[n] for n in names) for r in audit.filter_audit(docs, table.where("false")).collect()) == audit_brute(rows, [])


def test_filter_audit_of_other_filters(spark, empty):
    table = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(empty, table).count() == 0
    given = spark.createDataFrame([("p", 5), ("p", 5), ("q", 0)], "part string, m int")
    found = audit.cells(given, F.col("part"), {"X": F.col("m") % 2 == 1, "Y": F.col("m") > 4}, good=F.lit(True), toxic=F.lit(None).cast("boolean"))
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["good_lost"], r["shapley"]) for r in audit.interactions(found, "XY", Scratch(spark, "t")).collect()}
    assert len(got) == 8 and got["p", "XY", 1] == (0, 2, 0, 2, 2) and got["p", "XY", 2] == (0, 0, 2, 0, 2) and got["q", "YX", 2] == (1, 0, 0, 0, 0)
    with pytest.raises(ValueError):
        audit.interactions(found, "ABCDEFG", Scratch(spark, "t"))
