"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import math
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from trackloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cells(rows):
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    expected = duck.sql(ORACLE_SQL[name])
    assert names == sorted(expected.columns)
    columns = ", ".join(f'"{c}"' for c in names)
    assert cells(got.select(*names).collect()) == cells(duck.sql(f"SELECT {columns} FROM ({ORACLE_SQL[name]}) q").fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(5).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_are_read_without_a_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split()[-2:] == [str(len(__spark_entry__.queries())), str(len(__spark_entry__.oracle_sql()))]


def test_plan_is_pruned_and_shuffles_once(spark):
    plan = QUERIES["reconstruct_points"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_shipdate" not in plan
    assert plan.count("Exchange hashpartitioning") <= 2


def test_literal_rows_are_broadcast_without_a_job(spark):
    from trackloom.operators.sizes import few, most_rows
    from trackloom.plans import fixtures

    rig = fixtures.cameras(spark)
    assert most_rows(rig) == 3 and most_rows(rig.where("cam > 1").select("cam")) == 2 and most_rows(rig.agg({"cam": "max"})) == 1
    many = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert most_rows(many) is None
    jobs = spark.sparkContext.statusTracker()
    before = set(jobs.getJobIdsForGroup(None))
    few(rig)
    assert set(jobs.getJobIdsForGroup(None)) == before
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(few(rig)) and hinted(few(many, 100_000)) and not hinted(few(many, 100))
