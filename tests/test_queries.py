"""Every registered query has a stable schema, and its oracle the same columns."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in queries.ORACLES:
        assert got
        return
    want = duck.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    places = [want.columns.index(c) for c in columns]
    left = sorted((tuple(plain(r[c]) for c in columns) for r in got), key=repr)
    assert left == sorted((tuple(plain(r[i]) for i in places) for r in want.fetchall()), key=repr)


def test_every_bar_is_flattened(spark, monkeypatch):
    seen, flatten = [], queries.flatten
    monkeypatch.setattr(queries, "flatten", lambda raw: seen.append((raw, flatten(raw))) or seen[-1][1])
    result = queries.bars_json_flatten(spark, SF)
    (pages, rows), = seen
    bars = queries.bars(spark, SF)
    keys = lambda df, time: {(r[0].upper(), str(r[1])[:10]) for r in df.select("symbol", time).collect()}
    assert keys(rows, "timestamp") == keys(bars, "timestamp") and rows.count() == bars.count() == result.count() > 0
    assert pages.count() == len({(s, t[:7]) for s, t in keys(bars, "timestamp")})
