"""Every registered query of the library against its SQL on another engine."""

import os

import duckdb
import pytest

from aerolake import plans


@pytest.fixture(scope="module")
def connection(sf_dir):
    found = duckdb.connect()
    for file in os.listdir(sf_dir):
        found.execute(f"create view {file.split('.')[0]} as select * from '{sf_dir}/{file}'")
    return found


def _plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf_dir, connection, name):
    df = plans.QUERIES[name](spark, sf_dir)
    found = connection.execute(plans.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert _plain(map(tuple, df.collect()), df.columns) == _plain(found.fetchall(), names)
    assert df.columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_grid_join_has_no_nested_loop(spark, sf_dir):
    for name in ("navaid_nearest", "airport_min_runway", "fix_nearest"):
        plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_airports_have_procedures_of_every_kind(spark, sf_dir):
    assert {r.type for r in plans.QUERIES["procedure_by_airport"](spark, sf_dir).collect()} == {"SID", "STAR", "IAP"}
