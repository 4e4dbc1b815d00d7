"""Queries on tables larger than the ones checked with SQL: nothing is lost as the input grows."""

from collections import defaultdict
from datetime import date, timedelta

from pyspark.sql import functions as F

from cubeloom.functions import calendar as cal
from cubeloom.plans.queries import QUERIES


def test_every_vector_has_a_week(spark, tmp_path):
    n = 1100  # 520 names were all there were
    same = F.array_repeat(F.col("id").cast("float"), 64)
    spark.range(n).select(F.col("id").alias("vec_id"), same.alias("embedding"), F.lit(0).alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    months = defaultdict(list)
    for v in range(n):
        start = date(1990 + v % 10 + 10 * (v // 520), 1, 1)
        monday = start + timedelta((7 - start.weekday()) % 7 + 7 * (v // 10 % 52))
        months[monday.year, monday.month].append(v)
    found = QUERIES["p02_weekly_vegetation"](spark, str(tmp_path)).collect()
    means = defaultdict(set)
    for r in found:
        if r.VHI is not None:  # months without a week are filled in
            means[r.time.year, r.time.month].add(round(r.VHI, 6))
    assert means == {k: {round(sum(v) / len(v), 6)} for k, v in months.items()}


def test_weeks_of_late_years(spark):
    name = spark.createDataFrame([("VHP.G04.C07.NC.P10000035.VH.nc",)], "a string")
    first = name.select(F.year(cal.time_of_file(F.col("a"), "week")).alias("y"), F.month(cal.time_of_file(F.col("a"), "week")).alias("m")).first()
    assert (first.y, first.m) == (10000, 8)


def test_layers_merge_when_limits_leave_a_cell_nothing(spark, tmp_path):
    lines = [(25, 900.0, 0.05, 7.0), (1, 60000.0, 0.05, 7.0), (2, 900.0, 0.07, 7.0), (3, 60000.0, 0.07, 7.0), (None, 900.0, 0.05, 7.0)]  # cells 1 to 3 fail by one limit, the other, and both
    rows = spark.createDataFrame(lines, "l_suppkey bigint, l_extendedprice double, l_discount double, l_quantity double")
    rows.withColumn("l_shipdate", F.lit("1998-03-05").cast("timestamp")).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["a03_merge_layers"](spark, str(tmp_path))
    assert found.columns == ["pixel_id", "time", "precip", "vci"]
    assert [tuple(r) for r in found.collect()] == [(0, date(1998, 3, 31), 7.0, 50.0)]


def test_evaporation_keeps_every_latitude(spark, tmp_path):
    rows = (0, 29, 30, 99, 6000)  # row k of users lies at latitude 9 - k; the box ended at -20
    events = [(15 * k + lon, 1.0 * k) for k in rows for lon in range(15)]
    spark.createDataFrame(events, "user_id bigint, value double").withColumn("ts", F.lit("2024-01-05 10:00:00").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    found = {(r.lat_idx, r.lon_idx, r.time, r.E) for r in QUERIES["p06_evaporation"](spark, str(tmp_path)).collect()}
    assert found == {(9 - k, lon, date(2024, 1, 31), 1.0 * k) for k in rows for lon in range(2, 11)}
