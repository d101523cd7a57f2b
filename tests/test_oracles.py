"""Every query with SQL gives the rows of its SQL."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def connected(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return connected(SF)


@pytest.fixture(scope="module")
def larger():
    return connected(LARGER)


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return None if math.isnan(value) else round(float(value), 6) + 0.0
    return list(map(plain, value)) if isinstance(value, (list, tuple)) else value


def compared(spark, con, folder, key):
    df = QUERIES[key](spark, folder)
    expected = con.execute(ORACLES[key])
    names = [c[0] for c in expected.description]
    assert sorted(df.columns) == sorted(names)
    rows = sorted(str(plain(tuple(r))) for r in df.select(*names).collect())
    assert rows == sorted(str(plain(r)) for r in expected.fetchall())
    return rows


@pytest.mark.parametrize("key", sorted(k for k in ORACLES if not k.startswith("op")))
def test_query_equals_its_sql(spark, duck, key):
    assert compared(spark, duck, SF, key) or key in {"merge_conflicts"}


@pytest.mark.parametrize("key", ["round_metrics", "eval_metrics", "config_columns", "angle_degrees", "report_manifest", "write_rater_annotations", "convert_legacy", "sector_mask", "mmode_scale", "uid_passthrough"])
def test_at_ten_times_the_size(spark, larger, key):
    """Rounding, and the queries whose values vary most."""
    assert compared(spark, larger, LARGER, key)
