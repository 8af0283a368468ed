"""Registry shape, and a cross-section of queries against their SQL twins."""

import datetime as dt
import math
import os
import re

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()
COUNTS = {"s": 21, "g": 15, "r": 18, "n": 8, "a": 11, "o": 18, "d": 12, "m": 10, "f": 15, "v": 15, "l": 8, "y": 4}
SAMPLE = [
    "s01_grid_cells", "s15_survey_errors", "g04_horn_gradients", "g09_rasterize", "g10_distance", "r07_monthly_median", "n01_percentile_minmax",
    "a02_eigen_weights", "o07_sensitivity", "o12_class_summary", "d07_events", "m02_standardized", "f07_benchmark", "v06_operational_test", "l01_training_table", "y04_detrended_anomaly",
]


def test_every_operator_has_a_query():
    names = set(entry.queries())
    missing = [f"{k}{i:02d}" for k, n in COUNTS.items() for i in range(1, n + 1) if not any(q.startswith(f"{k}{i:02d}_") for q in names)]
    assert missing == []
    assert set(entry.oracle_sql()) <= names


def test_oracles_read_whole_tables():
    for name, text in entry.oracle_sql().items():
        assert not re.search(r"\b(limit|sample|tablesample)\b", text, re.I), name


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (dt.date, dt.datetime)):
        return str(value)[:10]
    return float(value) if type(value).__name__ == "Decimal" else value


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    order = sorted(columns)
    expected = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in cursor.fetchall()), key=repr)
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == order
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a == pytest.approx(b, abs=2e-6) if all(isinstance(x, (int, float)) for x in a + b) else a == b


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_entry_returns_classes(spark):
    assert entry.entry(spark).count() > 0
