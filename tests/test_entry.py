import importlib.util
import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from sluice import queries as own

SF = "/root/testdata/sf0.001"


def test_names_and_sql():
    found, sql = entry.queries(), entry.oracle_sql()
    assert set(own.QUERIES) <= set(found) and set(sql) <= set(found)
    assert entry._has_llm() == bool(importlib.util.find_spec("sluice.llm") and importlib.util.find_spec("corpus_pipeline"))


def test_other_queries_work_where_a_library_is_missing():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); print(e._has_llm(), len(q), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.abspath(entry.__file__)), capture_output=True, text=True, check=True).stdout.split()
    assert said == ["False", str(len(own.QUERIES)), str(len(own.ORACLES))]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_queries_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("events", "customer", "orders"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in own.ORACLES.items():
        got, want = own.QUERIES[name](spark, SF).toPandas(), con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns), name
        columns = sorted(got.columns)
        rows = lambda f, columns=columns: sorted(map(tuple, f[columns].astype(str).replace({"<NA>": "None", "nan": "None"}).to_numpy().tolist()))
        assert rows(got) == rows(want), name


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_entry_has_rows(spark):
    assert entry.entry(spark).columns == ["campaign_id", "evaluated", "matched"] and entry.entry(spark).count() > 0
