"""The registry, and queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"q16_walk"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(rows):
    def value(x):
        return "~" if x is None or x != x else f"{float(x):.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(value(x) for x in row) for row in rows)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("q")))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    expected = con.sql(entry.oracle_sql()[name])
    columns = sorted(expected.columns)
    got = entry.queries()[name](spark, DATA)
    assert sorted(got.columns) == columns
    assert plain(got.select(*columns).collect()) == plain(expected.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_streaming_inbox(spark, tmp_path):
    from tests.test_images import flat_catalogue

    from platterlake.streaming.inbox import arriving_entries

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ssd").write_bytes(flat_catalogue(files=[(b"A", ord("$"), 0, 3, 2)]).ljust(102400, b"\0"))
    query = arriving_entries(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r["path"] for r in spark.table("arrived").collect()] == ["$.A"]
