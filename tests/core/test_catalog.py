"""Every query with SQL is held against DuckDB over the smallest tables."""

import duckdb
import pytest

from pyspark.sql import functions as F

from lectern import catalog
from lectern.operators import records, text

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events", "conversations", "labels", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = [sorted(map(repr, map(tuple, x))) for x in (got.collect(), want.select(*got.columns).fetchall())]
    assert rows[0] == rows[1] and rows[0]


def test_planted_defects_are_repaired(spark):
    """The views that plant defects change, and normalization leaves only typeable characters."""
    raw = text._dirty(spark, SF).cache()
    assert raw.filter(F.col("text").rlike("[^ -~]")).count() > 100
    out = text.normalized(raw)
    assert out.filter(F.col("text").rlike("[^ -~]")).count() == 0 and out.agg(F.sum("dropped")).first()[0] > 0


def test_folds(spark):
    row = spark.createDataFrame([(" \u2014\u00a0\u00c6on\u2026 caf\u00e9\u200b \ufb01n\u2020 \u0416",)], "text string")
    assert text.normalized(row).first() == ("- AEon... cafe fin", 1)


def test_folds_by_full_decomposition(spark):
    """As the standard library decomposes, over every character of the basic plane that does."""
    import unicodedata

    chars = [chr(c) for c in range(0x80, 0xFFFF) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFD", chr(c)) != chr(c)] + ["Kelvin \u212a", "\u212b", "\u0915\u093c", "x\u20d0", "\uac01\uac00"]
    rows = spark.createDataFrame(list(enumerate(chars)), "i int, text string")
    got = {r.i: (r.text, r.dropped) for r in text.normalized(rows).collect()}
    for i, c in enumerate(chars):
        plain = "".join(text.LETTERS.get(x, x) for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M")
        for a, b in [*zip(text.SINGLE_QUOTES + text.DASHES, "'" * 4 + "-" * 4, strict=True), *((x, " ") for x in text.SPACES)]:
            plain = plain.replace(a, b)
        typed = "".join(x for x in plain if " " <= x <= "~")
        assert got[i] == (" ".join(typed.split()), len(plain) - len(typed)), (c, hex(ord(c[0])))


def test_record_rules(spark):
    n = spark.createDataFrame([(250, 30000, 0, 0)], "chars int, ms int, correct int, total int")
    assert n.select(records.wpm(F.col("chars"), F.col("ms")), records.accuracy(F.col("correct"), F.col("total"))).first() == (100.0, 100.0)
    a = spark.createDataFrame([(1, 5, 10, 3, 2.0), (2, 9, 1, 1, 1.0)], "k int, updated_at int, position int, chars int, best double")
    b = spark.createDataFrame([(1, 5, 20, 7, 1.0), (3, 1, 1, 1, 1.0)], a.schema)
    assert sorted(map(tuple, records.merge_progress(a, b, "k").collect())) == [(1, 5, 10, 7, 2.0), (2, 9, 1, 1, 1.0), (3, 1, 1, 1, 1.0)]
