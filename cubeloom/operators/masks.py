"""Filters, masks and projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import ratio
from ..sources.cubes import PIXEL
from .order import percentiles


def bounding_box(df: DataFrame, lat: tuple[float, float], lon: tuple[float, float], lat_col: str = "lat", lon_col: str = "lon", check: bool = False) -> DataFrame:
    """Rows inside the box, its edges included; with ``check``, an empty result is an error."""
    found = df.filter(F.col(lat_col).between(*sorted(lat)) & F.col(lon_col).between(*sorted(lon)))
    if check and found.isEmpty():
        raise ValueError("no cell lies inside the box")
    return found


def rotate_longitude(df: DataFrame, lon: str = "lon") -> DataFrame:
    """0..360 becomes -180..180, and ``lon_idx`` the place in that order."""
    turned = df.withColumn(lon, F.when(F.col(lon) >= 180, F.col(lon) - 360).otherwise(F.col(lon)))
    places = turned.select(lon).distinct().agg(F.sort_array(F.collect_list(lon)).alias("_lons"))
    turned = turned.join(F.broadcast(places))  # one row
    return turned.withColumn("lon_idx", (F.array_position("_lons", F.col(lon)) - 1).cast("int")).drop("_lons")


def time_slice(df: DataFrame, start=None, end=None, months: list[int] | None = None, years: list[int] | None = None, time: str = "time") -> DataFrame:
    tests = []
    if start is not None:
        tests.append(F.col(time) >= F.lit(start).cast("date"))
    if end is not None:
        tests.append(F.col(time) <= F.lit(end).cast("date"))
    if months is not None:
        tests.append(F.month(time).isin(months))
    if years is not None:
        tests.append(F.year(time).isin(years))
    return df.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def match_times(df: DataFrame, other: DataFrame, time: str = "time") -> DataFrame:
    """Rows whose time the other cube has too."""
    return df.join(other.select(time).distinct(), time, "left_semi")


def null_mask(df: DataFrame, value: str, keys=PIXEL, time: str = "time") -> DataFrame:
    """``mask``: true for series that have no value at their first time."""
    return df.groupBy(*keys).agg(F.min_by(F.isnull(value), time).alias("mask"))


def apply_mask(df: DataFrame, mask: DataFrame, values: list[str], keys=PIXEL) -> DataFrame:
    """Values of masked series become null."""
    found = df.join(mask.select(*keys, F.col("mask").alias("_mask")), [*keys], "left")
    return found.withColumns({v: F.when(~F.coalesce("_mask", F.lit(False)), F.col(v)) for v in values}).drop("_mask")


def union_masks(df: DataFrame, values: list[str], keys=PIXEL, time: str = "time") -> DataFrame:
    """``mask``: true where any of the values is null."""
    return df.select(*keys, time, reduce(lambda a, b: a | b, [F.isnull(v) for v in values]).alias("mask"))


def membership_mask(df: DataFrame, column: str, members: list, out: str = "mask") -> DataFrame:
    """True where the column isn't one of the members; null isn't."""
    return df.withColumn(out, ~F.coalesce(F.col(column).isin(members), F.lit(False)))


def keep_members(df: DataFrame, column: str, members: list, values: list[str]) -> DataFrame:
    """Values become null where the column isn't one of the members."""
    return df.withColumns({v: F.when(F.col(column).isin(members), F.col(v)) for v in values})


def scale_flags(df: DataFrame, value: str, flags=(251, 252, 255), factor: float = 0.0048, offset: float = -0.2, out: str | None = None) -> DataFrame:
    """Digital numbers as quantities; flags become null."""
    return df.withColumn(out or value, F.when(~F.col(value).isin(*flags), F.col(value) * factor + offset))


def one_hot(df: DataFrame, column: str, legend: dict[int, str]) -> DataFrame:
    """``{label}_one_hot`` of class codes; code 0 is no class."""
    code = F.col(column)
    return df.withColumns({f"{label}_one_hot": F.when((code == n) & (code > 0), 1).otherwise(0) for n, label in sorted(legend.items())})


def remap(df: DataFrame, column: str, mapping: dict, out: str | None = None, keep: bool = True) -> DataFrame:
    """Values by a dictionary; those that it lacks stay as they are, or become null."""
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(pairs, F.col(column))
    return df.withColumn(out or column, F.coalesce(found, F.col(column)) if keep else found)


def nearest_pixel(df: DataFrame, lat: float, lon: float, lat_col: str = "lat", lon_col: str = "lon") -> DataFrame:
    """All rows of the cell whose coordinates are nearest, each axis for itself; of equal distances, the smaller coordinate."""
    at = lambda c, x: F.min_by(F.col(c), F.struct(F.abs(F.col(c) - x), F.col(c)))
    place = df.agg(at(lat_col, lat).alias("_lat"), at(lon_col, lon).alias("_lon"))
    return df.join(F.broadcast(place), (F.col(lat_col) == F.col("_lat")) & (F.col(lon_col) == F.col("_lon")), "left_semi")  # one row


def drop_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def trim_outliers(df: DataFrame, value: str, sigmas: float | None = 10, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows within ``sigmas`` standard deviations of the mean, and between two percentiles."""
    found = df.join(F.broadcast(df.agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))))  # one row
    shares = {n: q for n, q in (("_low", low), ("_high", high)) if q is not None}
    if shares:
        found = found.join(F.broadcast(percentiles(df, value, shares)))  # one row
    if sigmas is not None:
        found = found.filter(F.abs(F.col(value) - F.col("_mean")) <= sigmas * F.col("_std"))
    if low is not None:
        found = found.filter(F.col(value) >= F.col("_low"))
    if high is not None:
        found = found.filter(F.col(value) <= F.col("_high"))
    return found.select(*df.columns)


def keep_variables(df: DataFrame, ignore: list[str], keys=PIXEL, time: str = "time") -> DataFrame:
    """Columns whose names hold none of the ignored names."""
    return df.select(*[c for c in df.columns if c in (*keys, time) or not any(i in c for i in ignore)])


def static_variables(df: DataFrame, keys=PIXEL, time: str = "time") -> list[str]:
    """Variables that have one value for each cell at all times."""
    names = [c for c in df.columns if c not in (*keys, time)]
    counts = df.groupBy(*keys).agg(*[F.countDistinct(v).alias(v) for v in names]).agg(*[F.max(v).alias(v) for v in names]).first()
    return [v for v in names if (counts[v] or 0) <= 1]


def target_change(df: DataFrame, value: str, keys=PIXEL, time: str = "time") -> DataFrame:
    """``change``: the value less the one before."""
    w = Window.partitionBy(*keys).orderBy(time)
    return df.withColumn("change", F.col(value) - F.lag(value).over(w))


def undo_change(df: DataFrame, change: str, previous: str, out: str = "preds") -> DataFrame:
    return df.withColumn(out, F.col(previous) + F.col(change))


def standardise(df: DataFrame, norm: DataFrame, values: list[str], out: str = "{}_norm") -> DataFrame:
    """(x - mean) / std by the table ``variable, mean, std``; a name takes the entry that is its longest ending."""
    entry = F.map_from_entries(F.collect_list(F.struct("variable", F.struct("mean", "std"))))
    names = {r.variable for r in norm.select("variable").collect()}  # one for each variable
    found = df.join(F.broadcast(norm.agg(entry.alias("_norm"))))  # one row
    exprs = {}
    for v in values:
        fitting = max((n for n in names if v.endswith(n)), key=len)
        m = F.element_at("_norm", F.lit(fitting))
        exprs[out.format(v)] = ratio(F.col(v) - m["mean"], m["std"])
    return found.withColumns(exprs).drop("_norm")


def unstandardise(df: DataFrame, norm: DataFrame, variable: str, value: str, out: str) -> DataFrame:
    one = norm.filter(F.col("variable") == variable).select(F.col("mean").alias("_mean"), F.col("std").alias("_std"))
    return df.join(F.broadcast(one)).withColumn(out, F.col(value) * F.col("_std") + F.col("_mean")).drop("_mean", "_std")


def log_standardise(df: DataFrame, value: str, out: str) -> DataFrame:
    """Standardised log(x + 1e-4)."""
    log = F.log(F.col(value) + 1e-4)
    moments = df.agg(F.avg(log).alias("_mean"), F.stddev_pop(log).alias("_std"))
    return df.join(F.broadcast(moments)).withColumn(out, ratio(log - F.col("_mean"), F.col("_std"))).drop("_mean", "_std")


def errors(df: DataFrame, truth: str, preds: str) -> DataFrame:
    e = F.col(preds) - F.col(truth)
    return df.withColumns(
        {"error": e, "squared_error": e * e, "absolute_error": F.abs(e), "root_error": F.sqrt(e * e), "bias_percent": 100 * (ratio(F.col(preds), F.col(truth)) - 1)}
    )


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """The value held between two bounds; null stays null."""
    held = value
    if low is not None:
        held = F.greatest(held, F.lit(low))
    if high is not None:
        held = F.least(held, F.lit(high))
    return F.when(value.isNotNull(), held)
