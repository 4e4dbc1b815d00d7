"""How queries are registered: a function of (spark, sf_dir), and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, as sums depend on the order of rows; as decimals of nine places, so that halves of the last place go one way. No negative zeros."""
    six = lambda c: F.coalesce(F.round(F.col(c).try_cast("decimal(38,9)"), 6).cast("double"), F.col(c)) + F.lit(0.0)
    return df.select(*[six(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register a query; ``doubles`` names the columns that the SQL's result has to round as rounded() does."""

    def keep(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(function(spark, sf_dir))
        if sql is not None:
            replaced = ", ".join(f"coalesce(round(TRY_CAST({c} AS DECIMAL(38, 9)), 6)::DOUBLE, {c}) + 0.0 AS {c}" for c in doubles.split())
            ORACLES[name] = f"SELECT * REPLACE ({replaced}) FROM ({sql})" if doubles else sql
        return function

    return keep


#: The cubes in SQL: shipments by cell and month, made dense, with the rolled sum of three months.
CUBE = """
    cube AS (
        SELECT CAST(p // 5 AS INTEGER) AS lat_idx, CAST(p % 5 AS INTEGER) AS lon_idx, CAST(p AS INTEGER) AS pixel_id, time, precip, price, vci
        FROM (SELECT l_suppkey % 25 AS p, last_day(l_shipdate) AS time, sum(l_quantity) AS precip, avg(l_extendedprice) AS price,
                     1000 * avg(l_discount) AS vci FROM lineitem GROUP BY 1, 2)),
    dense AS (
        SELECT c.*, t.time, k.precip, k.price, k.vci
        FROM (SELECT DISTINCT lat_idx, lon_idx, pixel_id FROM cube) c CROSS JOIN (SELECT DISTINCT time FROM cube) t
        LEFT JOIN cube k ON k.pixel_id = c.pixel_id AND k.time = t.time),
    roll AS (
        SELECT *, CASE WHEN count(precip) OVER w = 3 THEN sum(precip) OVER w END AS x
        FROM dense WINDOW w AS (PARTITION BY pixel_id ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
    cs AS (SELECT * FROM roll WHERE time IN (SELECT time FROM roll WHERE x IS NOT NULL))"""


def cube_sql(select: str, more: str = "") -> str:
    """A query over the cubes; ``more`` holds further named parts."""
    return f"WITH {CUBE}{', ' + more if more else ''} {select}"
