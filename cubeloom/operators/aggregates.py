"""Climatologies, resampling and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import bucket, days_in_month, dekad_end, dekad_start, group_key, months_ahead, season
from ..functions.numeric import ratio
from ..sources.cubes import PIXEL
from .order import average_ranks, percentiles, percentiles_of_counts, places_from_both_ends, same_group, stored, value_counts


def resample(df: DataFrame, rule: str, values: list[str], keys=PIXEL, time: str = "time", how=F.avg, fill: bool = True) -> DataFrame:
    """Means by period, labelled as bucket() says; with ``fill``, periods without rows between the first and the last are null."""
    found = df.groupBy(*keys, bucket(F.col(time), rule).alias(time)).agg(*[how(v).alias(v) for v in values])
    if not fill:
        return found
    ends = found.agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    days = ends.select(F.explode(F.sequence("_a", "_b")).alias("_d")).select(bucket(F.col("_d"), rule).alias(time)).distinct()
    grid = found.select(*keys).distinct().join(F.broadcast(days))  # the calendar of the periods
    return grid.join(found, [*keys, time], "left")


def upsample_nearest(df: DataFrame, values: list[str], keys=PIXEL, time: str = "time") -> DataFrame:
    """A row for each day between a series' first and last time, with the values of the nearest time (of two, the earlier)."""
    w = Window.partitionBy(*keys).orderBy(time)
    df = df.withColumns({"_next": F.lead(time).over(w), "_row": F.struct(*values)}).withColumn("_then", F.lead("_row").over(w))
    days = df.withColumn("_day", F.explode(F.when(F.col("_next").isNull(), F.array(time)).otherwise(F.sequence(F.col(time), F.date_sub("_next", 1)))))
    first = (F.datediff("_day", time) <= F.datediff("_next", "_day")) | F.col("_next").isNull()
    row = F.when(first, F.col("_row")).otherwise(F.col("_then"))
    return days.select(*keys, F.col("_day").alias(time), row.alias("_r")).select(*keys, time, "_r.*")


def dekads_between(df: DataFrame, start: str, end: str) -> DataFrame:
    """The end of every dekad from that in which one date column lies to that of another, a row each."""
    days = df.select(F.explode(F.sequence(dekad_start(F.col(start)), dekad_end(F.col(end)))).alias("_d"))
    return days.filter(F.col("_d") == dekad_end(F.col("_d"))).select(F.col("_d").alias("dekad")).distinct()


def group_into_dekads(df: DataFrame, keys=PIXEL, time: str = "time", by_start: bool = False) -> DataFrame:
    """The sorted times of each series in each dekad, as often as they occur; dekads are named by their last day, or their first."""
    label = dekad_start if by_start else dekad_end
    return df.groupBy(*keys, label(F.col(time)).alias("dekad")).agg(F.sort_array(F.collect_list(time)).alias("times"))


def climatology(df: DataFrame, value: str, period: str = "month", keys=PIXEL, time: str = "time") -> DataFrame:
    """Mean and standard deviation by series and calendar group."""
    grouped = df.groupBy(*keys, group_key(F.col(time), period).alias(period))
    return grouped.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def climatology_quantile(df: DataFrame, value: str, q: float, period: str = "month", keys=PIXEL, time: str = "time") -> DataFrame:
    """The exact quantile (linear between values) by series and calendar group; a group holds a value for each year."""
    return df.groupBy(*keys, group_key(F.col(time), period).alias(period)).agg(F.percentile(value, F.lit(q)).alias("quantile"))


def spatial_mean(df: DataFrame, value: str, time: str = "time") -> DataFrame:
    return df.groupBy(time).agg(F.avg(value).alias(f"spatial_mean_{value}"))


def temporal_mean(df: DataFrame, value: str, keys=PIXEL) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(f"{value}_pixel_mean"))


def mode_over_time(df: DataFrame, value: str, keys=PIXEL) -> DataFrame:
    """The commonest value of each series; of several, the least. Counted first, so a series is a row for each value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).count()
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("count"), F.col(value))).alias("mode"))


def norm_table(df: DataFrame, values: list[str]) -> DataFrame:
    """``variable, mean, std`` over all rows; one-hot variables have 0 and 1."""
    moments = F.explode(F.array(*[_moment(v) for v in values])).alias("m")
    return df.agg(*[F.avg(v).alias(f"{v}__m") for v in values], *[F.stddev_pop(v).alias(f"{v}__s") for v in values]).select(moments).select("m.*")


def _moment(v: str) -> Column:
    hot = v.endswith("_one_hot")
    mean, std = (F.lit(0.0), F.lit(1.0)) if hot else (F.col(f"{v}__m"), F.col(f"{v}__s"))
    return F.struct(F.lit(v).alias("variable"), mean.alias("mean"), std.alias("std"))


def static_means(df: DataFrame, values: list[str], test_years: list[int], keys=PIXEL, time: str = "time") -> DataFrame:
    """``{v}_pixel_mean`` and ``{v}_global_mean`` over the years before the first test year."""
    used = df.filter(F.year(time) < min(test_years))
    cells = used.groupBy(*keys).agg(*[F.avg(v).alias(f"{v}_pixel_mean") for v in values])
    return cells.join(F.broadcast(used.agg(*[F.avg(v).alias(f"{v}_global_mean") for v in values])))  # one row


def ensemble(df: DataFrame, value: str, by: list[str], member: str = "number", members: int | None = None) -> DataFrame:
    """Mean and standard deviation over the members of a forecast, or those numbered below ``members``."""
    if members is not None:
        df = df.filter(F.col(member) < members)
    return df.groupBy(*by).agg(F.avg(value).alias(f"{value}_mean"), F.stddev_pop(value).alias(f"{value}_std"))


def steps_ahead(df: DataFrame, value: str, by: list[str], horizon: str = "horizon_days", steps=(1, 2, 3)) -> DataFrame:
    """``{value}_{n}``: the mean value of the horizons that are n months ahead."""
    rows = df.withColumn("_n", months_ahead(F.col(horizon))).filter(F.col("_n").isNotNull())
    found = rows.groupBy(*by).pivot("_n", list(steps)).agg(F.avg(value))
    return found.withColumnsRenamed({str(n): f"{value}_{n}" for n in steps})


def weighted_seasonal_mean(df: DataFrame, value: str, calendar: str = "standard", keys=PIXEL, time: str = "time") -> DataFrame:
    """Seasonal means of monthly values weighted by the days of the months that have one."""
    days = F.when(F.col(value).isNotNull(), days_in_month(F.col(time), calendar))
    grouped = df.groupBy(*keys, season(F.col(time)).alias("season"))
    return grouped.agg(ratio(F.sum(F.col(value) * days), F.sum(days)).alias("weighted_mean"))


def seasonality_std(df: DataFrame, value: str, time: str = "time") -> DataFrame:
    """Over the years, mean and deviation of the spatial mean of each month."""
    means = spatial_mean(df, value, time).withColumn("month", F.month(time))
    return means.groupBy("month").agg(F.avg(f"spatial_mean_{value}").alias("mean"), F.stddev_pop(f"spatial_mean_{value}").alias("std"))


def double_year(df: DataFrame, month: str = "month") -> DataFrame:
    """The months 1 to 12, and again as 13 to 24."""
    return df.unionByName(df.withColumn(month, F.col(month) + 12))


def bin_means(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Means of y in equal-width, right-closed bins of x (the first holds the least value too)."""
    ends = df.agg(F.min(x).alias("_a"), F.max(x).alias("_b"))
    found = df.join(F.broadcast(ends)).filter(F.col(x).isNotNull())  # one row
    width = (F.col("_b") - F.col("_a")) / bins
    number = F.greatest(F.least(F.ceil(ratio(F.col(x) - F.col("_a"), width)), F.lit(bins)), F.lit(1)).cast("int")
    return found.groupBy(number.alias("bin")).agg(F.avg(y).alias("mean"), F.count("*").alias("n"))


def in_bin(df: DataFrame, x: str, low: float, high: float) -> DataFrame:
    """``inside``: strictly between the two edges."""
    return df.withColumn("inside", F.coalesce((F.col(x) > low) & (F.col(x) < high), F.lit(False)))


def histogram(df: DataFrame, value: str, width: float = 1.0) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / width) * width).cast("double").alias("bin")).count().withColumnRenamed("count", "n")


def share_below(df: DataFrame, value: str, threshold: float, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(value) < threshold).cast("double")).alias("share"))


def yearly_counts_below(df: DataFrame, value: str, threshold: float, time: str = "time") -> DataFrame:
    return df.groupBy(F.year(time).alias("year")).agg(F.count_if(F.col(value) < threshold).alias("n_below"))


def colour_range(df: DataFrame, value: str, low: float = 0.05, high: float = 0.95, exact: bool = True) -> DataFrame:
    """Two percentiles of all values, exact or by a sketch."""
    if exact:
        return percentiles(df, value, {"vmin": low, "vmax": high})
    return df.agg(F.percentile_approx(value, F.lit(low)).alias("vmin"), F.percentile_approx(value, F.lit(high)).alias("vmax"))


def correlation(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson's r, its square, and the linear fit of y on x, on rows with both."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*by).agg(
        F.corr(x, y).alias("r"), F.pow(F.corr(x, y), 2).alias("r2"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n")
    )


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson's r of average ranks, on rows with both; null where a variable has one value only.

    Equal pairs are counted first. Ranks are found for counted values by ranges, so no task holds a group; as the mean rank is (n + 1) / 2, one sum
    over the counted pairs is left.
    """
    pairs = stored(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_n")))
    met = pairs
    for v, name in (("_x", "_rx"), ("_y", "_ry")):
        counts = stored(pairs.groupBy(*by, v).agg(F.sum("_n").alias("_n")))
        ranks = average_ranks(counts, v, by, name)
        met = same_group(met, ranks.select(*by, v, (F.col(name) - (F.col("_all") + 1) / 2).alias(name)), [*by, v])
    total = lambda a, b: F.sum(F.col("_n") * F.col(a) * F.col(b))
    return met.groupBy(*by).agg(ratio(total("_rx", "_ry"), F.sqrt(total("_rx", "_rx")) * F.sqrt(total("_ry", "_ry"))).alias("rho"))


def correlation_matrix(df: DataFrame, values: list[str]) -> DataFrame:
    """``a, b, r`` for each two variables, from one aggregate."""
    pairs = [(a, b) for k, a in enumerate(values) for b in values[k:]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("r")) for a, b in pairs]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def autocorrelation(df: DataFrame, value: str, lags=(1, 2, 3), keys=PIXEL, time: str = "time") -> DataFrame:
    """Autocorrelation by lag with one mean and variance for the whole series."""
    series, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(time)
    rows = df.filter(F.col(value).isNotNull()).withColumn("_d", F.col(value) - F.avg(value).over(series))
    rows = rows.withColumns({f"_l{k}": F.col("_d") * F.lag("_d", k).over(w) for k in lags})
    found = rows.groupBy(*keys).agg(*[ratio(F.sum(f"_l{k}"), F.sum(F.col("_d") * F.col("_d"))).alias(str(k)) for k in lags])
    return found.unpivot([*keys], [str(k) for k in lags], "lag", "acf").withColumn("lag", F.col("lag").cast("int"))


def group_difference(df: DataFrame, rank_by: str, values: list[str], n: int, keys: list[str]) -> DataFrame:
    """Means of each variable in the n rows with the most and the least of ``rank_by``, and their difference in deviations."""
    order = [F.col(rank_by), *map(F.col, keys)]
    rows = df.filter(F.col(rank_by).isNotNull())
    top = rows.orderBy(F.col(rank_by).desc(), *map(F.col, keys)).limit(n).withColumn("_g", F.lit("top"))
    both = top.unionByName(rows.orderBy(*order).limit(n).withColumn("_g", F.lit("bottom")))
    long = both.unpivot(["_g"], values, "variable", "v").groupBy("variable").pivot("_g", ["top", "bottom"]).agg(F.avg("v"))
    stds = rows.select(*values).unpivot([], values, "variable", "v").groupBy("variable").agg(F.stddev_pop("v").alias("std"))
    return long.join(stds, "variable").withColumn("difference", ratio(F.col("top") - F.col("bottom"), F.col("std")))


def yearly_medians(df: DataFrame, value: str, keys=PIXEL, time: str = "time") -> DataFrame:
    """Years by the median over cells of the median over each cell's year."""
    cells = df.groupBy(*keys, F.year(time).alias("year")).agg(F.percentile(value, F.lit(0.5)).alias("m"))
    return cells.select("year").distinct().join(percentiles(cells, "m", {"median": 0.5}, ["year"]), "year", "left")


def coarsen(df: DataFrame, value: str, n: int, time: str = "time") -> DataFrame:
    """Median of blocks of n x n cells; blocks that the grid doesn't fill go."""
    ends = df.agg(F.max("lat_idx").alias("_h"), F.max("lon_idx").alias("_w"))
    block = lambda c: F.floor(F.col(c) / n).cast("int")
    inside = (block("lat_idx") < F.floor((F.col("_h") + 1) / n)) & (block("lon_idx") < F.floor((F.col("_w") + 1) / n))
    found = df.join(F.broadcast(ends)).filter(inside)  # one row
    return found.groupBy(block("lat_idx").alias("lat_idx"), block("lon_idx").alias("lon_idx"), time).agg(F.percentile(value, F.lit(0.5)).alias(value))


def normalised_cycle(df: DataFrame, value: str, keys=PIXEL, time: str = "time") -> DataFrame:
    """The seasonal cycle, and each month's percentage of its cell's annual total, averaged over cells."""
    cells = df.groupBy(*keys, F.month(time).alias("month")).agg(F.avg(value).alias("m"))
    cells = cells.withColumn("p", 100 * ratio(F.col("m"), F.sum("m").over(Window.partitionBy(*keys))))
    return cells.groupBy("month").agg(F.avg("m").alias("cycle"), F.avg("p").alias("percent"))


def summary(df: DataFrame, values: list[str]) -> DataFrame:
    """``variable, min, max, mean, median``, nulls where a variable has no value.

    One scan counts the values of all variables (as doubles); the rest works on the counts.
    """
    long = df.select(*[F.col(v).cast("double").alias(v) for v in values]).unpivot([], values, "variable", "_v")
    counts = value_counts(long, "_v", ["variable"])
    found = counts.groupBy("variable").agg(F.min("_v").alias("min"), F.max("_v").alias("max"), ratio(F.sum(F.col("_v") * F.col("_n")), F.sum("_n")).alias("mean"))
    medians = percentiles_of_counts(counts, "_v", {"median": 0.5}, ["variable"])
    names = df.sparkSession.createDataFrame([(v,) for v in values], "variable string")
    return names.join(found, "variable", "left").join(medians, "variable", "left")


def binned_pairs(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Counts in equal-width bins of both variables, with the r of all pairs."""
    ends = df.agg(F.min(x).alias("_a"), F.max(x).alias("_b"), F.min(y).alias("_c"), F.max(y).alias("_d"), F.corr(x, y).alias("r"))
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).join(F.broadcast(ends))  # one row
    place = lambda v, a, b: F.least(F.floor(bins * ratio(F.col(v) - F.col(a), F.col(b) - F.col(a))), F.lit(bins - 1)).cast("int")
    return rows.groupBy(place(x, "_a", "_b").alias("bin_x"), place(y, "_c", "_d").alias("bin_y")).agg(F.count("*").alias("n"), F.first("r").alias("r"))


def top_n(df: DataFrame, value: str, n: int = 10, largest: bool = True, by: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """The n rows with the most (or least) of a value, over all or in each group; nulls are none."""
    rows = df.filter(F.col(value).isNotNull())
    order = [F.col(value).desc() if largest else F.col(value).asc(), *map(F.col, ties or [])]
    if not by:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def flag_extremes(df: DataFrame, value: str, sizes=(5, 10), by: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """``top_{n}`` and ``bottom_{n}``: whether the row is among the n with the most or the least."""
    found = places_from_both_ends(df, value, by or [], ties or [])
    return found.withColumns({f"{side}_{n}": F.col(at) <= n for side, at in (("top", "_most"), ("bottom", "_least")) for n in sizes}).drop("_most", "_least")


def concat(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def compare_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Every key of the two tables with ``place``: left, right or both."""
    one = a.select(*keys).distinct().withColumn("_l", F.lit(True))
    two = b.select(*keys).distinct().withColumn("_r", F.lit(True))
    place = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left").otherwise("right")
    return one.join(two, keys, "full").select(*keys, place.alias("place"))
