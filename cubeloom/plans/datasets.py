"""Preparation jobs: the decoded table of a product in, a monthly cube on the reference grid out.

Each job is a composition of operators in the order its product asks for. Raw tables have ``lat``, ``lon`` (or ``latitude``,
``longitude``) and integer places; target grids are pairs of axis tables (see spatial.axes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import time_of_file, valid_time
from ..operators import aggregates as agg
from ..operators import masks, spatial
from ..operators.indices import condition_index
from ..sources import cubes

PIXEL = cubes.PIXEL


def _regrid(df: DataFrame, target, values: list[str], method: str = "nearest", time: str = "time") -> DataFrame:
    if target is not None:
        return spatial.regrid(df, target, values, method, time)
    return df.select(*PIXEL, time, *values, "lat", "lon")


def _boxed(df: DataFrame, box) -> DataFrame:
    return masks.bounding_box(df, box[0], box[1]) if box else df


def _monthly(df: DataFrame, values: list[str], rule: str | None) -> DataFrame:
    return agg.resample(df, rule, values) if rule else df.select(*PIXEL, "time", *values)


def gridded(raw: DataFrame, values: list[str], box=None, target=None, rule: str | None = "M", drop: tuple[str, ...] = (), rotate: bool = False, years: list[int] | None = None) -> DataFrame:
    """Rainfall, evaporation and reanalysis: names, longitudes, box, years, grid, period means; in that order."""
    df = cubes.standard_names(raw, drop)
    df = masks.rotate_longitude(df) if rotate else df
    df = _boxed(df, box)
    df = masks.time_slice(df, years=years) if years else df
    return _monthly(_regrid(df.withColumn("time", F.to_date("time")), target, values), values, rule)


def weekly_vegetation(files: DataFrame, variable: str, lat: tuple[float, float], lon: tuple[float, float], box=None, target=None, rule: str = "M") -> DataFrame:
    """Weekly grids (``file_name`` and an array of arrays, top row first): week from the name, cells from places."""
    rows = files.select(time_of_file(F.col("file_name"), "week").alias("time"), F.col(variable))
    df = cubes.rows_to_pixels(rows, variable, lat, lon, flip=True).withColumnRenamed("value", variable)
    return _monthly(_regrid(_boxed(df, box), target, [variable]), [variable], rule)


def reanalysis_soil(raw: DataFrame, box=None, target=None, legend: dict[int, str] | None = None) -> DataFrame:
    """The static soil type: the commonest class of each cell, one-hot."""
    df = _regrid(_boxed(cubes.standard_names(raw), box), target, ["soil_type"])
    mode = agg.mode_over_time(df, "soil_type").withColumnRenamed("mode", "soil_type")
    return masks.one_hot(mode, "soil_type", legend or {k: f"soil_{k}" for k in range(1, 8)})


def with_static(monthly: DataFrame, static: DataFrame) -> DataFrame:
    """A monthly cube with what is fixed for its cells; cells without it keep their months."""
    return monthly.join(static, [*PIXEL], "left")


def land_cover(raw: DataFrame, legend: dict[int, str], box=None, target=None) -> DataFrame:
    """Annual class maps (year in ``file_name``): the modal class of each cell, one-hot by the legend."""
    df = cubes.standard_names(_boxed(raw, box)).withColumn("time", time_of_file(F.col("file_name"), "year"))
    df = _regrid(df, target, ["lccs_class"])
    mode = agg.mode_over_time(df, "lccs_class").withColumnRenamed("mode", "lccs_class")
    return masks.one_hot(mode, "lccs_class", legend)


def topography(raw: DataFrame, target) -> DataFrame:
    """Heights on the reference grid, bilinear."""
    df = cubes.standard_names(raw, ("crs",)).withColumn("time", F.lit("2000-01-31").cast("date"))
    return spatial.regrid(df.withColumnRenamed("Band1", "topography"), target, ["topography"], "bilinear").drop("time")


def vegetation_index(raw: DataFrame, box=None, target=None, downsample_first: bool = False, base: int = 0) -> DataFrame:
    """Digital numbers by dekad (``file_name``): quantities, condition index and its three-step mean, then monthly means."""
    df = raw.withColumn("time", time_of_file(F.col("file_name"), "dekad", base))
    df = masks.scale_flags(_regrid(_boxed(df, box), target, ["boku_ndvi"]), "boku_ndvi")
    if downsample_first:
        df = agg.resample(df, "M", ["boku_ndvi"])
    df = condition_index(df.select(*PIXEL, "time", "boku_ndvi"), "boku_ndvi", "month", 1, "VCI")
    df = condition_index(df, "VCI", "month", 3, "VCI3M")
    return df if downsample_first else agg.resample(df, "M", ["boku_ndvi", "VCI", "VCI3M"])


def seasonal_forecast(raw: DataFrame, variable: str, box=None, target=None, members: int = 25) -> DataFrame:
    """Ensemble forecasts (``init_date, horizon_days, number``): ``{v}_mean_k`` and ``{v}_std_k`` k months ahead, by month."""
    df = _boxed(cubes.standard_names(raw), box)
    if target is not None:
        df = spatial.regrid(df.withColumn("_run", F.struct("init_date", "horizon_days", "number")), target, [variable], time="_run").select(*PIXEL, "lat", "lon", "_run.*", variable)
    df = df.filter(F.col("number") < members).withColumn("time", valid_time(F.col("init_date"), F.col("horizon_days")))
    runs = agg.ensemble(df, variable, [*PIXEL, "init_date", "horizon_days"]).withColumn("time", F.last_day("init_date"))
    mean = agg.steps_ahead(runs, f"{variable}_mean", [*PIXEL, "time"])
    std = agg.steps_ahead(runs, f"{variable}_std", [*PIXEL, "time"])
    return mean.join(std, [*PIXEL, "time"])


def boundaries(cells: DataFrame, levels: dict[int, DataFrame], half_cell=(0.0, 0.0)) -> DataFrame:
    """``level, lat_idx, lon_idx, region_id, region_name`` of the polygons of several levels."""
    found = None
    for level, polygons in sorted(levels.items()):
        names = polygons.select("poly_id", F.col("name").alias("region_name"))
        part = spatial.rasterise(cells, polygons, half_cell).join(F.broadcast(names), "poly_id", "left")  # polygons of one level
        part = part.select(F.lit(level).alias("level"), *PIXEL, F.col("poly_id").alias("region_id"), "region_name")
        found = part if found is None else found.unionByName(part)
    return found


def district_mask(regions: DataFrame, names: list[str]) -> DataFrame:
    """``mask``: true for cells outside the named districts."""
    return masks.membership_mask(regions, "region_name", names)
