"""Developer check: run a registered Spark query and its DuckDB oracle, compare results."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from casebook.sources.tables import TABLES


_SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                  "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
                  "timestamp": "TIMESTAMP WITH TIME ZONE", "float": "FLOAT"}


def duckdb_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark: SparkSession, name: str, sf_dir: str, con=None) -> dict:
    from casebook.plans.catalog import ORACLE, QUERIES
    sdf = QUERIES[name](spark, sf_dir)
    spark_pd = pd.DataFrame([tuple(r) for r in sdf.collect()], columns=sdf.columns, dtype=object)
    out = {"name": name, "spark_rows": len(spark_pd), "spark_cols": sorted(sdf.columns)}
    if name not in ORACLE:
        out["oracle"] = None
        return out
    con = con or duckdb_connection(sf_dir)
    cur = con.execute(ORACLE[name])
    ocols = [d[0] for d in cur.description]
    ora = pd.DataFrame(cur.fetchall(), columns=ocols, dtype=object)
    out.update(oracle_rows=len(ora), oracle_cols=sorted(ora.columns))
    spark_types = {f.name: _SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in sdf.schema.fields}
    duck_types = {d[0]: str(d[1]) for d in cur.description}
    bad_types = {c: (spark_types.get(c), duck_types.get(c)) for c in duck_types
                 if spark_types.get(c) != duck_types.get(c)}
    if bad_types:
        out["type_mismatch"] = bad_types
    if sorted(ora.columns) != sorted(sdf.columns):
        out["match"] = False
        return out
    a, b = _rows(spark_pd), _rows(ora)
    out["match"] = a == b
    if not out["match"]:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        out["first_diffs"] = diff
    return out
