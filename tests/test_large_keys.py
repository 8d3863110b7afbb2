"""Queries whose identifiers come from keys, on keys larger than those of the small tables."""

import os

import duckdb
import pytest

from aerolake import plans

from .test_queries import _plain

#: What is added to the keys of a small table, once or more: it is there with its own keys and with larger ones.
SHIFTS = {
    "customer": [{"c_custkey": 99_900}],
    "supplier": [{"s_suppkey": 1_000}],
    "part": [{"p_partkey": 10_000}, {"p_partkey": 999_900}],
    "orders": [{"o_orderkey": 46_656, "o_custkey": 0}, {"o_orderkey": 466_560, "o_custkey": 99_900}],
    "lineitem": [{"l_orderkey": 466_560, "l_partkey": 999_900}],
}
NAMES = ["airport_by_id", "fix_by_identifier", "route_distance", "airway_build", "procedure_build", "procedure_legs", "procedure_by_runway", "procedure_by_type", "procedure_by_approach_type"]


@pytest.fixture(scope="module")
def large(sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("large"))
    found = duckdb.connect()
    for file in os.listdir(sf_dir):
        table, moved = file.split(".")[0], ""
        for shifts in SHIFTS.get(table, ()):
            moved += f" union all select * replace ({', '.join(f'{k} + {by} as {k}' for k, by in shifts.items())}) from '{sf_dir}/{file}'"
        found.execute(f"copy (select * from '{sf_dir}/{file}' {moved}) to '{folder}/{file}' (format parquet)")
        found.execute(f"create view {table} as select * from '{folder}/{file}'")
    return folder, found


@pytest.mark.parametrize("name", NAMES)
def test_large_keys(spark, large, name):
    folder, connection = large
    df = plans.QUERIES[name](spark, folder)
    found = connection.execute(plans.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert _plain(map(tuple, df.collect()), df.columns) == _plain(found.fetchall(), names)
