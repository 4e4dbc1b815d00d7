"""Window operators over dense cubes or station tables: rolling sums and means, ranks, lags, runs.

``keys`` name the series (a cell or a station). Windows are partitioned by the series or by series and calendar group, so that
all of an index's windows share one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import group_key, month_index
from ..functions.numeric import ratio
from ..sources.cubes import PIXEL
from .order import places


def _rolling(df: DataFrame, value: str, window: int, keys, time: str, how) -> Column:
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(1 - window, 0)
    return F.when(F.count(value).over(w) == window, how(value).over(w))


def drop_empty_times(df: DataFrame, value: str, time: str = "time") -> DataFrame:
    """Times at which the value is null everywhere go; the table of times is as small as the calendar."""
    some = df.groupBy(time).agg(F.count(value).alias("_n")).filter("_n > 0").select(time)
    return df.join(F.broadcast(some), time, "left_semi")


def rolling_sum(df: DataFrame, value: str, window: int = 3, out: str | None = None, keys=PIXEL, time: str = "time", trim: bool = True) -> DataFrame:
    """Trailing sum of ``window`` rows, null unless all have a value; with ``trim``, times without any result go."""
    out = out or f"{value}_cumsum"
    df = df.withColumn(out, _rolling(df, value, window, keys, time, F.sum))
    return drop_empty_times(df, out, time) if trim else df


def rolling_mean(df: DataFrame, value: str, window: int = 3, out: str | None = None, keys=PIXEL, time: str = "time", trim: bool = True) -> DataFrame:
    """Trailing mean of ``window`` rows, null unless all have a value."""
    out = out or f"{value}_mean"
    df = df.withColumn(out, _rolling(df, value, window, keys, time, F.avg))
    return drop_empty_times(df, out, time) if trim else df


def rolling_spatial_median(df: DataFrame, value: str, window: int = 3, time: str = "time") -> DataFrame:
    """Trailing median along lat, then along lon, of ``window`` cells."""
    for along, across, name in (("lat_idx", "lon_idx", "_m"), ("lon_idx", "lat_idx", f"{value}_median")):
        w = Window.partitionBy(across, time).orderBy(along).rowsBetween(1 - window, 0)
        source = value if name == "_m" else "_m"
        df = df.withColumn(name, F.when(F.count(source).over(w) == window, F.percentile(source, F.lit(0.5)).over(w)))
    return df.drop("_m")


def lag_features(df: DataFrame, values: list[str], lags=(1, 2, 3), keys=PIXEL, time: str = "time") -> DataFrame:
    """``{value}_t{k}``: the value k rows before in the same series."""
    w = Window.partitionBy(*keys).orderBy(time)
    return df.withColumns({f"{v}_t{k}": F.lag(v, k).over(w) for v in values for k in lags})


def average_rank(value: str, by: list, count_nulls: bool = True) -> tuple[Column, Column]:
    """Rank from 1 within a group, ties averaged, null for null; and the size of the group, rows without a value included."""
    ordered = Window.partitionBy(*by, F.isnull(value)).orderBy(value)
    ties = Window.partitionBy(*by, F.isnull(value), value)
    rank = F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2
    size = F.count(F.lit(1) if count_nulls else value).over(Window.partitionBy(*by))
    return F.when(F.col(value).isNotNull(), rank), size


def month_groups(keys=PIXEL, time: str = "time", period: str = "month") -> list:
    return [*keys, group_key(F.col(time), period)]


def apply_by_group(df: DataFrame, function, schema: str, period: str = "month", keys=PIXEL, time: str = "time") -> DataFrame:
    """A user's pandas function on each series and calendar group; a group has a row for each year."""
    return df.withColumn("group_key", group_key(F.col(time), period)).groupBy(*keys, "group_key").applyInPandas(function, schema)


def runs(df: DataFrame, flag: str, keys=PIXEL, time: str = "time") -> DataFrame:
    """Runs of true values: ``run_length`` stands at the run's first row (0 elsewhere), ``run_position`` counts inside it."""
    series = Window.partitionBy(*keys).orderBy(time)
    on = F.coalesce(F.col(flag), F.lit(False))
    df = df.withColumn("_on", on).withColumn("_n", F.row_number().over(series))
    df = df.withColumn("_run", F.col("_n") - F.row_number().over(Window.partitionBy(*keys, "_on").orderBy(time)))
    run = Window.partitionBy(*keys, "_on", "_run")
    at = F.row_number().over(run.orderBy(time))
    return df.withColumns(
        {
            "run_length": F.when(F.col("_on") & (at == 1), F.count(F.lit(1)).over(run)).otherwise(0).cast("int"),
            "run_position": F.when(F.col("_on"), at).otherwise(0).cast("int"),
        }
    ).drop("_on", "_n", "_run")


def longest_run(df: DataFrame, flag: str, keys=PIXEL, time: str = "time") -> DataFrame:
    return runs(df, flag, keys, time).groupBy(*keys).agg(F.max("run_length").alias("longest_run"))


def annual_cumulative(df: DataFrame, value: str, keys=PIXEL, time: str = "time") -> DataFrame:
    """Sum since the start of the year, its mean over all years for the month, and the sum in percent of that."""
    year = Window.partitionBy(*keys, F.year(time)).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("cumulative", F.sum(value).over(year))
    normal = F.avg("cumulative").over(Window.partitionBy(*keys, F.month(time)))
    return df.withColumn("normal", normal).withColumn("percent", 100 * ratio(F.col("cumulative"), F.col("normal")))


def previous_year(df: DataFrame, value: str, out: str = "prev_year", keys=PIXEL, time: str = "time", partition: tuple[str, ...] = ()) -> DataFrame:
    """The value twelve months before, in the same split if ``partition`` names one; 0 where there is no such row."""
    before = df.select(*keys, *partition, (month_index(F.col(time)) + 12).alias("_m"), F.col(value).alias("_v"), F.lit(True).alias("_there"))
    found = df.withColumn("_m", month_index(F.col(time))).join(before, [*keys, *partition, "_m"], "left")
    return found.withColumn(out, F.when(F.col("_there"), F.col("_v")).otherwise(F.lit(0.0))).drop("_m", "_v", "_there")


def empirical_cdf(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(n - 1) / (N - 1) of each value that isn't null, in its group; ties follow each other."""
    rows = places(df.filter(F.col(value).isNotNull()), value, by, [])
    return rows.withColumn("cdf", ratio(F.col("_place") - 1, F.col("_all") - 1)).drop("_place", "_all")


def terciles(df: DataFrame, value: str, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """``tercile`` low, med or high by rank; of sizes that don't divide by three, the first thirds are the larger."""
    found = places(df, value, by or [], order or [])
    low = F.floor((F.col("_all") + 2) / 3)
    upto = low + F.floor((F.col("_all") + 1) / 3)
    name = F.when(F.col("_place") <= low, "low").when(F.col("_place") <= upto, "med").otherwise("high")
    return found.withColumn("tercile", name).drop("_place", "_all")


def seasonal_windows(df: DataFrame, truth: str, preds: str, by: list[str], time: str = "time", starts=range(1, 11), length: int = 3) -> DataFrame:
    """Squared correlation of truth and prediction by group, each averaged by year over months [i, i + length)."""
    rows = df.withColumn("start_month", F.explode(F.array(*map(F.lit, starts))))
    inside = (F.month(time) >= F.col("start_month")) & (F.month(time) < F.col("start_month") + length)
    means = rows.filter(inside).groupBy(*by, "start_month", F.year(time).alias("year")).agg(F.avg(truth).alias("t"), F.avg(preds).alias("p"))
    error, total = F.sum((F.col("t") - F.col("p")) ** 2), F.sum(F.col("t") * F.col("t")) - F.sum("t") * F.sum("t") / F.count("*")
    return means.filter("t is not null and p is not null").groupBy(*by, "start_month").agg(
        F.count("*").alias("n"), (1 - F.try_divide(error, total)).alias("r2"), F.pow(F.corr("t", "p"), 2).alias("corr2")
    )
