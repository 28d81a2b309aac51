"""Every query of the catalogue against its SQL in DuckDB, on the smallest test tables."""

import datetime
import os
import re
from pathlib import Path

import pytest

from docloom.plans import catalogue

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in ("events", "documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want and got


def test_every_query_but_the_git_source_has_sql():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"gitlog_source"}


def test_nothing_outside_imports_the_training_operators():
    for f in (ROOT / "docloom").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"docloom\.llm|corpus_pipeline", f.read_text()), f


def test_git_source(spark):
    assert catalogue.gitlog_source(spark, SF).columns == ["repo", "oid", "parent_oid", "commit_ts", "walk_ordinal"]


def test_filters_reach_the_scan(spark):
    plan = catalogue.sentence_split(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan
    plan = catalogue.hybrid_summary(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
