"""Each registered query against its SQL."""

from __future__ import annotations

import duckdb
import pytest

from redsieve.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf_dir, db, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = db.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = sorted(str(tuple(r[names.index(c)] for c in columns)) for r in want.fetchall())
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == rows


def test_spatial_joins_are_no_nested_loops(spark, sf_dir):
    for name in ("region_strategy", "occluded_words", "finding_filter", "term_sweep_marks"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_findings_of_all_documents_are_reviewed(spark, sf_dir):
    got = QUERIES["finding_review"](spark, sf_dir)
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in QUERIES["page_sizes"](spark, sf_dir).collect()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id", "text"]
