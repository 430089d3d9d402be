"""Driver contract and a DuckDB cross-check of quick queries at sf0.001."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as E
from gleaner.fixtures import TABLES

QUICK = ["src_1", "jn_8", "str_3", "flt_8", "win_1", "agg_1", "job_3", "str_4", "job_5", "nrm_2", "nrm_6",
         "nrm_10", "nrm_11", "nrm_20", "str_26", "agg_4", "job_2", "stm_1", "stm_2"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["source_id", "company", "status", "jobs_found", "jobs_added", "jobs_filtered",
                          "jobs_skipped", "error"]


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join("<null>" if r[i] is None else str(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_oracle(spark, sf_small, duck, name):
    sdf = E.queries()[name](spark, sf_small)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [c[0] for c in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert _digest(sdf.columns, srows) == _digest(dcols, drows)
    canon = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN",
             "timestamp": "TIMESTAMP", "double": "DOUBLE"}
    dtypes = {c[0]: str(c[1]).upper() for c in cur.description}
    for f in sdf.schema.fields:
        assert canon.get(f.dataType.simpleString(), f.dataType.simpleString()).upper() == dtypes[f.name], f.name
