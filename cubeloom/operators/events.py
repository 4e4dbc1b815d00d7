"""Threshold events: where a value is beyond a threshold of its series and calendar group, and for how long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import group_key, season
from ..sources.cubes import PIXEL
from .masks import null_mask
from .windows import runs


def thresholds(df: DataFrame, value: str, method: str = "q90", high: bool = True, amount: float = 1.0, period: str = "month", keys=PIXEL, time: str = "time") -> DataFrame:
    """``threshold`` by series and group: q{percent} quantile, ``std`` (mean +- amount deviations) or ``abs`` (the amount)."""
    grouped = df.groupBy(*keys, group_key(F.col(time), period).alias("group_key"))
    if method == "std":
        side = 1 if high else -1
        return grouped.agg((F.avg(value) + side * amount * F.stddev_pop(value)).alias("threshold"))
    if method == "abs":
        return grouped.agg(F.lit(float(amount)).alias("threshold"))
    if method.startswith("q"):
        return grouped.agg(F.percentile(value, F.lit(float(method[1:]) / 100)).alias("threshold"))
    raise ValueError(f"unknown method {method}")


def detect(df: DataFrame, value: str, method: str = "q90", high: bool = True, amount: float = 1.0, period: str = "month", keys=PIXEL, time: str = "time") -> DataFrame:
    """``event``: strictly above (or below) the threshold; a missing value is no event."""
    g = Window.partitionBy(*keys, group_key(F.col(time), period))
    if method == "std":
        limit = F.avg(value).over(g) + (1 if high else -1) * amount * F.stddev_pop(value).over(g)
    elif method == "abs":
        limit = F.lit(float(amount))
    else:
        limit = F.percentile(value, F.lit(float(method[1:]) / 100)).over(g)
    beyond = F.col(value) > limit if high else F.col(value) < limit
    return df.withColumn("threshold", limit).withColumn("event", F.coalesce(beyond, F.lit(False)))


def event_runs(df: DataFrame, value: str, flag: str = "event", keys=PIXEL, time: str = "time") -> DataFrame:
    """Run lengths of events; null for series without a value at their first time."""
    found = runs(df, flag, keys, time)
    first = F.min_by(F.isnull(value), time).over(Window.partitionBy(*keys))
    return found.withColumn("_mask", first).withColumns({c: F.when(~F.col("_mask"), F.col(c)) for c in ("run_length", "run_position")}).drop("_mask")


def longest(df: DataFrame, value: str, flag: str = "event", keys=PIXEL, time: str = "time") -> DataFrame:
    return event_runs(df, value, flag, keys, time).groupBy(*keys).agg(F.max("run_length").alias("longest_run"))


def events_by_time(df: DataFrame, flag: str = "event", time: str = "time") -> DataFrame:
    return df.groupBy(time).agg(F.count_if(F.col(flag)).alias("n_events"))


def run_statistics(df: DataFrame, value: str, flag: str = "event", keys=PIXEL, time: str = "time") -> DataFrame:
    """The longest run and the 90 % quantile of run lengths of each series, of the times where a run starts."""
    found = event_runs(df, value, flag, keys, time).withColumn("_run", F.when(F.col("run_length") > 0, F.col("run_length")))
    return found.groupBy(*keys).agg(F.max("_run").alias("max_run"), F.percentile("_run", F.lit(0.9)).alias("q90_run"))


def seasonal_runs(df: DataFrame, value: str, flag: str = "event", keys=PIXEL, time: str = "time") -> DataFrame:
    """The mean length of the runs that start in each season."""
    found = event_runs(df, value, flag, keys, time).filter("run_length > 0")
    return found.groupBy(season(F.col(time)).alias("season")).agg(F.avg("run_length").alias("mean_run"))


__all__ = ["detect", "event_runs", "events_by_time", "longest", "null_mask", "run_statistics", "seasonal_runs", "thresholds"]
