"""Every opN query on the smallest tables: against its SQL, or for what holds of any result."""

from __future__ import annotations

import os

import pytest

from platterlake.llm import queries
from tests.test_entry import DATA, TABLES, plain

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    expected = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(expected.columns)
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == columns
    assert plain(got.select(*columns).collect()) == plain(expected.select(*[f'"{c}"' for c in columns]).fetchall())


def test_quality_of_held_out_documents(spark):
    """Better than always saying the more frequent label, on documents that nothing was learned from."""
    got = queries.op1_quality_classifier(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = got.where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    right = sum(r["predicted"] == r["quality"] for r in held) / len(held)
    most = max(sum(r["quality"] == k for r in held) for k in (0, 1)) / len(held)
    assert got.count() == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count() and right > most


def test_model_scores_held_out_documents_better_than_the_base(spark):
    got = queries.op7_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert sum(r["score"] > r["base_score"] for r in got) > 0.95 * len(got)
