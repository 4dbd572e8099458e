"""Every registered query against its DuckDB oracle on the smallest tables."""

import datetime as dt
import decimal
import math
import os

import duckdb
import pytest

from tests.conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events".split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


from __spark_entry__ import LLM_QUERIES, oracle_sql, queries  # noqa: E402

ORACLE = oracle_sql()
CHEAP = [k for k in ORACLE if k not in LLM_QUERIES]


SPARK_TO_DUCK = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


@pytest.mark.parametrize("name", CHEAP)
def test_query_matches_oracle(spark, duck, name):
    df = queries()[name](spark, SF_SMALL)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    want = _rows(cols, cur.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert got == want
    rel = duck.sql(ORACLE[name])
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    for f in df.schema.fields:
        spark_type = f.dataType.simpleString()
        assert SPARK_TO_DUCK.get(spark_type, spark_type) == duck_types[f.name], (f.name, spark_type)


def test_entry_smoke(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.count() > 0 and "avg_max_temp" in df.columns


def test_every_query_has_oracle_or_is_learned():
    learned = {
        "rain_classifier", "temp_forecast", "precip_forecast",
        "model_quality", "isolation_scores", "anomaly_counts", "additive_forecast", "additive_rain_forecast",
        "forecast_stats", "forecast_vs_real", "forecast_table",
    }
    own = {n for n in queries() if n not in LLM_QUERIES}
    assert own - set(ORACLE) == learned
    assert os.path.exists(os.path.join(SF_SMALL, "lineitem.parquet"))
