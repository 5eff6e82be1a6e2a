"""Registered queries against their SQL equivalents in DuckDB, and text functions on literals."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusx.functions import text as X
from corpusx.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: round(float(v), 4) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted(repr([show(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), want.columns)


def test_text_functions(spark):
    d = spark.createDataFrame([("It’s a Straße, don't!",), ("",), (None,)], "text string")
    assert [r[0] for r in d.select(X.tokenize(F.col("text"))).collect()] == [["it's", "a", "strasse", "don't"], [], []]
    assert [r[0] for r in d.select(X.ngrams(X.tokenize(F.col("text")), 3)).collect()][1:] == [[], []]
    with pytest.raises(ValueError):
        X.ngrams(F.col("text"), 0)
