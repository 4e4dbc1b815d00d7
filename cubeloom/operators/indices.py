"""Drought indices over dense cubes.

Every index takes (df, variable, time_period, rolling_window) and adds its column. All sums roll over the series; all groups
are a series and a calendar period, so one exchange by the series serves both.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import bucket, group_key, quarter_end, season
from ..functions.numeric import cube_root, digitize, ratio
from ..sources.cubes import PIXEL
from .windows import average_rank, drop_empty_times, rolling_mean, rolling_sum


def _group(keys, time: str, period: str):
    return Window.partitionBy(*keys, group_key(F.col(time), period))


def z_score(df: DataFrame, variable: str, period: str = "month", window: int = 3, keys=PIXEL, time: str = "time") -> DataFrame:
    """``ZSI``: distance of the rolled sum from the group's median, in standard deviations."""
    df, x, g = rolling_sum(df, variable, window, keys=keys, time=time), f"{variable}_cumsum", _group(keys, time, period)
    return df.withColumn("ZSI", _zsi(x, g))


def _zsi(x: str, g) -> Column:
    return ratio(F.col(x) - F.median(x).over(g), F.stddev_pop(x).over(g))


def percent_normal(df: DataFrame, variable: str, period: str = "month", window: int = 3, keys=PIXEL, time: str = "time") -> DataFrame:
    """``PNI``: the rolled sum in percent of the group's mean."""
    df, x, g = rolling_sum(df, variable, window, keys=keys, time=time), f"{variable}_cumsum", _group(keys, time, period)
    return drop_empty_times(df.withColumn("PNI", _pni(x, g)), "PNI", time)


def _pni(x: str, g) -> Column:
    return 100 * ratio(F.col(x), F.avg(x).over(g))


def drought_severity(df: DataFrame, variable: str, period: str = "month", window: int = 3, keys=PIXEL, time: str = "time") -> DataFrame:
    """``DSI``: the group's ranks spread over -4 to 4."""
    df, x = rolling_sum(df, variable, window, keys=keys, time=time), f"{variable}_cumsum"
    rank, n = average_rank(x, [*keys, group_key(F.col(time), period)])
    return df.withColumn("DSI", 8 * (ratio(rank - 1, n - 1) - 0.5))


def china_z(df: DataFrame, variable: str, period: str = "month", window: int = 3, modified: bool = False, keys=PIXEL, time: str = "time") -> DataFrame:
    """``CZI``, or ``MCZI`` around the median; the skew is taken for each value by itself."""
    df, x, g = rolling_sum(df, variable, window, keys=keys, time=time), f"{variable}_cumsum", _group(keys, time, period)
    return df.withColumn("MCZI" if modified else "CZI", _czi(x, g, modified))


def _czi(x: str, g, modified: bool) -> Column:
    z = ratio(F.col(x) - (F.median(x) if modified else F.avg(x)).over(g), F.stddev_pop(x).over(g))
    skew = z * z * z / F.count(F.lit(1)).over(g)
    return ratio(F.lit(6.0), skew) * cube_root(skew / 2 * z + 1) - ratio(F.lit(6.0), skew) + skew / 6


def decile(df: DataFrame, variable: str, period: str = "month", window: int = 3, on: str = "cumsum", keys=PIXEL, time: str = "time") -> DataFrame:
    """``rank_norm``, the rank on 0 to 100, and ``quintile``, the class 0 to 5 of the rolled sum (or of rank_norm)."""
    df, x = rolling_sum(df, variable, window, keys=keys, time=time), f"{variable}_cumsum"
    rank, n = average_rank(x, [*keys, group_key(F.col(time), period)])
    df = df.withColumn("rank_norm", 100 * ratio(rank - 1, n - 1))
    return df.withColumn("quintile", digitize(F.col(x if on == "cumsum" else "rank_norm"), [0, 20, 40, 60, 80]))


def rainfall_anomaly(df: DataFrame, variable: str, window: int = 3, order: str = "time", extremes: int = 10, keys=PIXEL, time: str = "time") -> DataFrame:
    """``RAI``: the anomaly against the mean of ten "highest" or ten "lowest" sums of the series' month.

    With ``order="time"``, highest are the ten latest and lowest the ten before the very oldest; with ``"value"``, what the
    words say.
    """
    df, x = rolling_sum(df, variable, window, keys=keys, time=time), f"{variable}_cumsum"
    return _rai(df, x, order, extremes, keys, time)


def _rai(df: DataFrame, x: str, order: str, extremes: int, keys, time: str) -> DataFrame:
    g = _group(keys, time, "month")
    by = F.col(time).desc() if order == "time" else F.col(x).desc_nulls_last()
    at, n = F.row_number().over(g.orderBy(by)), F.count(F.lit(1)).over(g)
    df = df.withColumns({"_at": at, "_n": n, "_avg": F.avg(x).over(g)})
    if order == "time":
        low = (F.col("_at") >= F.col("_n") - extremes) & (F.col("_at") < F.col("_n"))
    else:
        n_values = F.count(x).over(g)
        df = df.withColumn("_n", n_values)
        low = (F.col("_at") > F.col("_n") - extremes) & (F.col("_at") <= F.col("_n"))
    df = df.withColumns({"_top": F.avg(F.when(F.col("_at") <= extremes, F.col(x))).over(g), "_low": F.avg(F.when(low, F.col(x))).over(g)})
    a = F.col(x) - F.col("_avg")
    rai = F.when(a >= 0, 3 * ratio(a, F.col("_top") - F.col("_avg"))).otherwise(-3 * ratio(a, F.col("_low") - F.col("_avg")))
    return df.withColumn("RAI", rai).drop("_at", "_n", "_avg", "_top", "_low")


def condition_index(df: DataFrame, variable: str, period: str = "month", window: int = 3, out: str | None = None, keys=PIXEL, time: str = "time") -> DataFrame:
    """The value's place between the group's least and greatest, 0 to 100, then its rolling mean."""
    g, out = _group(keys, time, period), out or f"{variable}_ci"
    low, high = F.min(variable).over(g), F.max(variable).over(g)
    df = df.withColumn("_ci", 100 * ratio(F.col(variable) - low, high - low))
    return rolling_mean(df, "_ci", window, out, keys, time).drop("_ci")


def moving_average(df: DataFrame, variable: str, window: int = 3, keys=PIXEL, time: str = "time") -> DataFrame:
    """``{variable}_{window}month_moving_average``."""
    return rolling_mean(df, variable, window, f"{variable}_{window}month_moving_average", keys, time)


def vegetation_deficit(df: DataFrame, variable: str, window: int = 3, keys=PIXEL, time: str = "time") -> DataFrame:
    """``VDI``: class 1 (extreme deficit) to 5 of the rolling mean."""
    df = rolling_mean(df, variable, window, "_vdi", keys, time)
    return df.withColumn("VDI", digitize(F.col("_vdi"), [0, 10, 20, 35, 50])).drop("_vdi")


def all_indices(df: DataFrame, variable: str, period: str = "month", window: int = 3, keys=PIXEL, time: str = "time") -> DataFrame:
    """Eight indices of one variable from one rolled sum; the first two times and the last go."""
    x = f"{variable}_cumsum"
    df = rolling_sum(df.select(*keys, time, variable), variable, window, keys=keys, time=time)
    df = _rai(df, x, "time", 10, keys, time)
    g = _group(keys, time, period)
    rank, n = average_rank(x, [*keys, group_key(F.col(time), period)])
    df = df.withColumns(
        {"ZSI": _zsi(x, g), "PNI": _pni(x, g), "CZI": _czi(x, g, False), "MCZI": _czi(x, g, True), "DSI": 8 * (ratio(rank - 1, n - 1) - 0.5), "rank_norm": 100 * ratio(rank - 1, n - 1), "quintile": digitize(F.col(x), [0, 20, 40, 60, 80])}
    )
    df = spi(df, variable, window, keys=keys, time=time)
    # two times at the start and one at the end: of the calendar, which is small
    times = df.select(time).distinct().agg(F.sort_array(F.collect_list(time)).alias("_t"))
    inside = times.select(F.explode(F.slice("_t", F.lit(3), F.greatest(F.size("_t") - 3, F.lit(0)))).alias(time))
    return df.join(F.broadcast(inside), time, "left_semi").drop(x)


def seasonal_anomaly(df: DataFrame, variable: str, by_pixel: bool = True, keys=PIXEL, time: str = "time") -> DataFrame:
    """Quarter means less their means over the years; a quarter's season is that of its last month. One series, or by cell."""
    keys = list(keys) if by_pixel else []
    quarters = df.groupBy(*keys, quarter_end(F.col(time)).alias(time)).agg(F.avg(variable).alias(variable))
    quarters = quarters.withColumn("season", season(F.col(time)))
    normal = F.avg(variable).over(Window.partitionBy(*keys, "season"))
    return quarters.withColumn("climatology", normal).withColumn("anomaly", F.col(variable) - F.col("climatology"))


def calendar_anomaly(df: DataFrame, variable: str, period: str = "month", keys=PIXEL, time: str = "time") -> DataFrame:
    return df.withColumn("anomaly", F.col(variable) - F.avg(variable).over(_group(keys, time, period)))


# The standardised precipitation index

#: The index is held within this many deviations.
LIMIT = 3.09


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of positive values, by Stirling's series; small values are moved up by ten first."""
    up = x + 10
    below = reduce(lambda a, b: a * b, [x + k for k in range(10)])

    def series(z: Column) -> Column:
        # fixed values: B(2k) / (2k (2k - 1)), from the Bernoulli numbers
        tail = reduce(lambda a, b: a / (z * z) + b, [F.lit(c) for c in (1 / 156, -691 / 360360, 1 / 1188, -1 / 1680, 1 / 1260, -1 / 360, 1 / 12)])
        return (z - 0.5) * F.log(z) - z + math.log(2 * math.pi) / 2 + tail / z

    return F.when(x < 10, series(up) - F.log(below)).otherwise(series(x))


def gamma_cdf(shape: Column, x: Column) -> Column:
    """Regularised lower incomplete gamma function as a column expression, by its series, whose terms are all positive.

    The terms fall once their number passes x - shape; it takes some ten roots of the larger of the two more to bring them below what a double holds. With shapes
    beyond some 1e8 the steps are limited; normal_deviate() is for these.
    """
    steps = F.sequence(F.lit(1), F.least(F.lit(200_000), 60 + F.greatest(x - shape, F.lit(0.0)) + 12 * F.sqrt(F.greatest(x, shape))).cast("int"))
    start = F.struct((1 / shape).alias("term"), (1 / shape).alias("total"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * x / (shape + k)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    front = F.exp(shape * F.log(x) - x - log_gamma(shape))
    total = F.aggregate(steps, start, add, lambda acc: acc["total"])
    far = (x > shape) & (x > shape + 40 * F.sqrt(shape) + 60)  # beyond all that a double tells from 1
    return F.when(x <= 0, 0.0).when(far, 1.0).otherwise(F.least(front * total, F.lit(1.0)))


#: From this shape on the gamma distribution is close enough to the normal for normal_deviate().
LARGE_SHAPE = 10_000.0


def normal_deviate(shape: Column, x: Column) -> Column:
    """The normal quantile of a gamma distribution's share below x, for large shapes, by the saddlepoint (to some shape ** -1.5)."""
    d = x / shape - 1
    # 2 (d - ln(1 + d)) / d ** 2, by its series
    square = reduce(lambda a, b: b - d * a, [F.lit(2.0 / k) for k in range(12, 1, -1)])
    r = d * F.sqrt(square * shape)
    return r + F.when(F.abs(d) < 1e-8, 1 / (3 * F.sqrt(shape))).otherwise(-F.log(square) / (2 * r))


# fixed values: the rational approximations of Wichura's AS 241 (PPND16), highest powers first
_CENTRE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
_TAIL = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0),
)


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution as a column expression, for shares from 1e-10 to 1 - 1e-10 (others count as these)."""
    p = F.least(F.greatest(p, F.lit(1e-10)), F.lit(1 - 1e-10))
    q = p - 0.5
    power = lambda c, r: reduce(lambda a, b: a * r + b, [F.lit(v) for v in c])
    near = F.lit(0.180625) - q * q
    centre = q * power(_CENTRE[0], near) / power(_CENTRE[1], near)
    far = F.sqrt(-F.log(F.least(p, 1 - p))) - 1.6
    tail = power(_TAIL[0], far) / power(_TAIL[1], far)
    return F.when(F.abs(q) <= 0.425, centre).when(q < 0, -tail).otherwise(tail)


def spi(
    df: DataFrame, variable: str, scale: int = 3, distribution: str = "gamma", first_year: int | None = None, last_year: int | None = None,
    keys=PIXEL, time: str = "time", out: str = "SPI",
) -> DataFrame:
    """``SPI``: the rolled sum's probability under a distribution fitted by series and calendar month, as a normal quantile.

    Fitted on the calibration years, by default all. Gamma: Thom's estimate of the positive sums, with the share of zeros as the
    probability of none. Pearson III: by mean, deviation and skew. The first ``scale - 1`` times are null; the quantile is
    held within +-3.09. Fit and distribution functions are column expressions, so the rows stay in the JVM.
    """
    x = F.col("_x")
    df = rolling_sum(df, variable, scale, "_x", keys, time, trim=False)
    used = F.lit(True)
    if first_year is not None:
        used = used & (F.year(time) >= first_year)
    if last_year is not None:
        used = used & (F.year(time) <= last_year)
    g = _group(keys, time, "month")
    fit = F.when(used, x)
    if distribution == "gamma":
        positive = F.when(used & (x > 0), x)
        zero = ratio(F.sum(F.when(used & (x <= 0), 1).otherwise(0)).over(g), F.count(fit).over(g))
        mean = F.avg(positive).over(g)
        a = F.log(mean) - F.avg(F.log(positive)).over(g)
        shape = ratio(1 + F.sqrt(1 + 4 * a / 3), 4 * a)
        df = df.withColumns({"_p0": F.coalesce(zero, F.lit(0.0)), "_shape": shape, "_scale": ratio(mean, shape), "_loc": F.lit(0.0)})
    elif distribution == "pearson":
        mean, std, skew = F.avg(fit).over(g), F.stddev_pop(fit).over(g), F.skewness(fit).over(g)
        df = df.withColumns({"_mean": mean, "_std": std, "_skew": skew})
        shape = ratio(F.lit(4.0), F.col("_skew") * F.col("_skew"))
        size = F.col("_std") * F.col("_skew") / 2
        df = df.withColumns({"_p0": F.lit(0.0), "_shape": shape, "_scale": size, "_loc": F.col("_mean") - shape * size}).drop("_mean", "_std", "_skew")
    else:
        raise ValueError(f"unknown distribution {distribution}")

    shape, size, loc, zero = F.col("_shape"), F.col("_scale"), F.col("_loc"), F.col("_p0")
    at = F.greatest((x - loc) / size, F.lit(0.0))
    cdf = gamma_cdf(shape, at)
    cdf = F.when(size < 0, 1 - cdf).otherwise(cdf)
    share = zero + (1 - zero) * F.when((x <= 0) & (loc == 0), 0.0).otherwise(cdf)
    fitted = x.isNotNull() & shape.isNotNull() & (shape > 0) & (size != 0)
    large = fitted & (shape > LARGE_SHAPE) & (zero == 0)
    found = df.withColumns({"_share": F.when(fitted & ~large, share), "_direct": F.when(large, F.signum(size) * normal_deviate(shape, at))})
    quantile = F.coalesce("_direct", F.when(F.col("_share").isNotNull(), normal_quantile(F.col("_share"))))
    bounded = F.when(quantile.isNotNull(), F.least(F.greatest(quantile, F.lit(-LIMIT)), F.lit(LIMIT)))
    return found.withColumn(out, bounded).drop("_x", "_p0", "_shape", "_scale", "_loc", "_share", "_direct")


def district_features(df: DataFrame, regions: DataFrame, vci: str, rain: str, region: str = "region_id", keys=("pixel_id",), time: str = "time") -> DataFrame:
    """Means by district of condition indices (1 and 3 months), rainfall (1 and 3 months) and SPI (1 and 3), with lags 1 to 3.

    All windows are of a series, or of a series and its calendar months, so that they share one exchange by the series; times without a
    value of an index have null means instead of being dropped one index after the other.
    """
    df = df.select(*keys, time, vci, rain).repartition(*keys)
    g = _group(keys, time, "month")
    scaled = lambda v: 100 * ratio(F.col(v) - F.min(v).over(g), F.max(v).over(g) - F.min(v).over(g))
    df = df.withColumns({"_vci": scaled(vci), "_rci": scaled(rain)})
    for n in (1, 3):
        for name, source in (("VCI", "_vci"), ("RCI", "_rci"), ("RFE", rain)):
            df = rolling_mean(df, source, n, f"{name}{n}M", keys, time, trim=False)
        df = spi(df, rain, n, keys=keys, time=time, out=f"SPI{n}")
    names = ["VCI1M", "VCI3M", "RCI1M", "RCI3M", "RFE1M", "RFE3M", "SPI1", "SPI3"]
    means = df.join(regions, [*keys]).groupBy(region, time).agg(*[F.avg(v).alias(v) for v in names])
    w = Window.partitionBy(region).orderBy(time)
    return means.withColumns({f"{v}_t{k}": F.lag(v, k).over(w) for v in names for k in (1, 2, 3)})


def resampled(df: DataFrame, rule: str, values: list[str], keys=PIXEL, time: str = "time") -> DataFrame:
    """Means by period, without the empty periods in between; see aggregates.resample for those."""
    return df.groupBy(*keys, bucket(F.col(time), rule).alias(time)).agg(*[F.avg(v).alias(v) for v in values])
