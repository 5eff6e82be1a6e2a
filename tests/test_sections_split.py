"""Numbered sections and proposals on given texts, numbering against one window."""

from corpusx.operators import sections as S


def test_numbered_sections(spark):
    text = "intro\n**Example 1: Rain**\nnote\n> *wet*\n> day\nExcerpt from *The Drums*\nExcerpt from *Later*\n**Example 2: Sun**\nno quote here\n**Example 77: Odd**\n> x"
    d = spark.createDataFrame([(1, text), (2, "nothing"), (3, ""), (4, None)], "doc int, body string")
    got = [tuple(r) for r in S.numbered_sections(d, "doc", "body", r"\*\*Example\s+(\d+): ([^*\n]*)\*\*", r"Excerpt from \*([^*]+)\*", (("drums", "calibration"),), (1, 2, 3)).collect()]
    assert got == [(1, 1, "Rain", "The Drums", "calibration", 2, "*wet*\nday", [3]), (1, 2, "Sun", "Unknown", "profiling", 3, "no quote here", [3])]


def test_split_proposals(spark):
    headed = "chat\nProposal A\nPremise: one\nmore\nTurn: two\nProposal B\nPremise: lonely\nProposal C\nTurn: last\nPremise: x"
    blank = "Premise: p\nTurn: t\n\nnoise\n\nTurn: t2\nPremise: p2"
    d = spark.createDataFrame([("c", 1, headed), ("d", 2, blank), ("e", 3, ""), ("f", 4, None)], "cell string, seed int, raw string")
    got = {r["id"]: r["fields"] for r in S.split_proposals(d, ("cell", "seed"), "raw", "Proposal", ("Premise", "Turn"), ("Premise", "Turn")).collect()}
    assert got == {"c.1.1": {"Premise": "one\nmore", "Turn": "two"}, "c.1.3": {"Premise": "x", "Turn": "last"}, "d.2.1": {"Premise": "p", "Turn": "t"}, "d.2.3": {"Premise": "p2", "Turn": "t2"}}


def test_numbered_equals_one_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from corpusx.operators import diversity as D

    d = spark.range(3000).select("id", F.when(F.col("id") % 5 < 3, "hot").when(F.col("id") % 5 == 3, "b").alias("g"), F.when(F.col("id") % 50 != 0, F.round(F.rand(4), 2)).alias("u"))
    want = d.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("u", "id")))
    assert sorted(map(repr, D.numbered(d, "g", "u", "id", 7).collect())) == sorted(map(repr, want.collect()))
