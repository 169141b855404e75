"""Driver contract: entry() smoke run and every oracle query against DuckDB on sf0.001."""
import importlib.util
import os

import pytest

from oracle_check import compare, duckdb_connection

from casebook.plans.catalog import ORACLE

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs(spark):
    mod = _entry_module()
    df = mod.entry(spark)
    assert df.columns == ["patient_id", "text", "label"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    mod = _entry_module()
    assert set(mod.oracle_sql()) <= set(mod.queries())


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF)


NAMES = sorted(ORACLE)          # the library's own; the optional subpackage tests its own


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, SF, con)
    assert r["match"], r
