"""The SQL of the registered queries gives their rows, on odd texts and on ones whose contexts name unseen data."""

import duckdb
import pytest

import __spark_entry__ as entry

from .common import TEXTS, documents, prose

_seeds = [f"please write to   user{i:03d}@mail.example.com\ttoday, or call\n+1 (269) 555-{3296 + i} tonight" for i in range(30)]
_seeds += ["please write to\nuser777@mail_example today", "or call 269 555 0199 tonight, 12 monkeys", "9 9\t9\n9 9", "to x@y today", None, ""]
_seeds += [f"mixed 10.0.0.{i} or" for i in range(12)] + [f"mixed m{i}@example.org or" for i in range(8)] + ["mixed 99 or", "mixed ab@cd or", "1.2.3.256 0001.2.3.4 300.1.1.1.1"]
_passage = "".join(chr(33 + i * i % 90) for i in range(400))
_long = [f"{prose(30, 40)} {_passage}", f"é{_passage[:230]}😀 {prose(30, 41)}", _passage[:199], _passage[60:300] * 3, prose(5000, 42), prose(5000, 42) + " end"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("texts")
    documents(spark, [*TEXTS, *_seeds, *_long]).write.parquet(str(path / "documents.parquet"))
    return str(path)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & {n for n in entry.queries() if n.startswith("op")}))
def test_rows(spark, folder, name):
    got = entry.queries()[name](spark, folder)
    columns = sorted(got.columns)
    rows = got.collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=repr) == sorted((tuple(r[i] for i in places) for r in want.fetchall()), key=repr)
    if name == "op6_pii":  # some spans are discovered ones
        assert any(r["spans"].count(":") // 2 > r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in rows)
