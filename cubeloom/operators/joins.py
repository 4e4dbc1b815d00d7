"""Joins between cubes, climatologies, regions and neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import group_key
from ..functions.numeric import ratio
from ..sources.cubes import PIXEL


def inner_align(a: DataFrame, b: DataFrame, keys=PIXEL, time: str = "time") -> DataFrame:
    return a.join(b, [*keys, time], "inner")


def outer_merge(a: DataFrame, b: DataFrame, values: list[str], keys=PIXEL, time: str = "time", check: bool = False) -> DataFrame:
    """All cells and times of either cube, with the value that is there; with ``check``, two different values are an error."""
    other = b.select(*keys, time, *[F.col(v).alias(f"_{v}") for v in values])
    both = a.select(*keys, time, *values).join(other, [*keys, time], "full")
    if check:
        clash = reduce(lambda x, y: x | y, [F.coalesce(F.col(v) != F.col(f"_{v}"), F.lit(False)) for v in values])
        if not both.filter(clash).isEmpty():
            raise ValueError("the cubes disagree")
    return both.select(*keys, time, *[F.coalesce(v, f"_{v}").alias(v) for v in values])


def align_climatology(df: DataFrame, climate: DataFrame, period: str = "month", keys=PIXEL, time: str = "time") -> DataFrame:
    """A climatology's row for each row of the cube."""
    return df.withColumn(period, group_key(F.col(time), period)).join(climate, [*keys, period], "left")


def with_spatial_mean(df: DataFrame, values: list[str], time: str = "time") -> DataFrame:
    """``spatial_mean_{v}`` on every row; one row for each time is computed and joined back."""
    means = df.groupBy(time).agg(*[F.avg(v).alias(f"spatial_mean_{v}") for v in values])
    return df.join(means, time)


def region_means(df: DataFrame, cells: DataFrame, lookup: DataFrame, values: list[str], keys=("pixel_id",), time: str = "time") -> DataFrame:
    """Means by region and time; regions without cells have null rows."""
    means = df.join(cells.select(*keys, "region_id"), [*keys]).groupBy("region_id", time).agg(*[F.avg(v).alias(v) for v in values])
    times = df.select(time).distinct()
    grid = lookup.select("region_id", "region_name").join(F.broadcast(times))  # regions times the calendar
    return grid.join(means, ["region_id", time], "left")


def join_geometry(df: DataFrame, shapes: DataFrame, name: str = "region_name", shape_name: str = "name") -> DataFrame:
    """Attributes of the shape of the same name, spaces around names aside; names without a shape go."""
    right = shapes.withColumn("_name", F.trim(shape_name)).drop(shape_name)
    return df.join(right, F.trim(name) == F.col("_name")).drop("_name")


def nearest_time(df: DataFrame, other: DataFrame, values: list[str], keys=PIXEL, time: str = "time") -> DataFrame:
    """The values of the other table's nearest time (of two, the earlier) on every row, by one sort of both."""
    one = df.select(*keys, time, F.lit(None).alias("_v"), F.lit(1).alias("_side"), F.struct(*[c for c in df.columns]).alias("_row"))
    two = other.select(*keys, time, F.struct(F.col(time).alias("_t"), *values).alias("_v"), F.lit(0).alias("_side"), F.lit(None).alias("_row"))
    w = Window.partitionBy(*keys).orderBy(time, "_side")
    before = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    found = one.unionByName(two, allowMissingColumns=True).withColumns({"_b": before, "_a": after}).filter("_side = 1")
    use = F.col("_a").isNull() | (F.datediff(time, "_b._t") <= F.datediff("_a._t", time))
    nearest = F.when(F.col("_b").isNotNull() & use, F.col("_b")).otherwise(F.col("_a"))
    return found.select("_row.*", nearest.alias("_n")).select(*df.columns, *[F.col(f"_n.{v}").alias(v if v not in df.columns else f"nearest_{v}") for v in values])


def surrounding(df: DataFrame, value: str, reach: int = 1, time: str = "time", complete: bool = True) -> DataFrame:
    """``lat_{i}_lon_{j}_{value}``: the value i cells back along lat and j along lon. With ``complete``, cells that lack one go.

    Each row goes to the cells beside it along lon; what has gathered there is read by windows along lat. A cell has one row for each time: of several,
    the least by its columns in order stays, and their largest value is what neighbours see.
    """
    reaches = range(-reach, reach + 1)
    shifts = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if (i, j) != (0, 0)]
    moved = F.explode(F.array(*map(F.lit, reaches))).alias("_j")
    row = F.struct(*df.columns)
    sent = df.select("lat_idx", "lon_idx", F.col(time).alias("_t"), F.col(value).alias("_v"), row.alias("_row"), moved)
    sent = sent.withColumns({"lon_idx": F.col("lon_idx") + F.col("_j"), "_row": F.when(F.col("_j") == 0, F.col("_row"))})
    beside = [F.max(F.when(F.col("_j") == j, F.col("_v"))).alias(f"_{j}") for j in reaches]
    found = sent.groupBy("lon_idx", "_t", "lat_idx").agg(F.min("_row").alias("_row"), *beside)
    along = Window.partitionBy("lon_idx", "_t").orderBy("lat_idx")
    names = {(i, j): f"lat_{i}_lon_{j}_{value}" for i, j in shifts}
    found = found.select("_row", *[F.max(f"_{j}").over(along.rangeBetween(-i, -i)).alias(n) for (i, j), n in names.items()])
    found = found.filter("_row is not null").select("_row.*", *names.values())
    return found.dropna(subset=list(names.values())) if complete else found


def crosstab(a: DataFrame, b: DataFrame, label_a: str, label_b: str, keys=PIXEL) -> DataFrame:
    """Cells by two labels: ``n``, and ``percent`` of the first label's cells."""
    both = a.select(*keys, label_a).join(b.select(*keys, label_b), [*keys])
    counts = both.groupBy(label_a, label_b).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100 * ratio(F.col("n"), F.sum("n").over(Window.partitionBy(label_a))))


def full_product(scores: DataFrame, dimensions: list[str], values: list[str]) -> DataFrame:
    """A row for each combination of the dimensions' values, null where there is no score; the dimensions are names, so few."""
    grid = None
    for d in dimensions:
        names = scores.select(d).distinct()
        grid = names if grid is None else grid.join(F.broadcast(names))
    return grid.join(scores.select(*dimensions, *values), dimensions, "left")
