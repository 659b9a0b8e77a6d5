"""The registered queries: names, coverage by SQL, and a sample run against it."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from repostrata.queries import registry
from tools.check import TABLES, rows

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["a10_project_summary", "a12_activity_tree", "w4_carry_forward", "j17_risk_diff", "a27_contributions", "m10_package_lock", "c11_pdn_findings_with_comments"]


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql()) <= set(entry.queries())
    assert len(registry.queries()) > 200


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_sample(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    df = entry.queries()[name](spark, FOLDER)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cursor.fetchall())
