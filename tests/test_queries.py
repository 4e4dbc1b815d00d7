"""Every query that has SQL, against DuckDB on the smallest tables that fill the grid."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from cubeloom.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value.isoformat()[:19] if hasattr(value, "isoformat") else value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())


@pytest.mark.parametrize("name", ["i08_spi", "p02_weekly_vegetation", "p03_soil_type", "p08_land_cover", "p09_topography", "p12_boundaries", "g13_training_periods"])
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert set(ORACLES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["pixel_id", "time", "ZSI"]


@pytest.mark.parametrize("name", ["i01_z_score", "w07_runs", "i07_rainfall_anomaly", "e14_surrounding"])
def test_partitions_make_no_difference(spark, name):
    found = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = QUERIES[name](spark, SF)
        found.append(rows(df.columns, df.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]
