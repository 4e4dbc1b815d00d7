"""Reading, writing and shaping of cubes.

A cube has integer grid keys (never joined on coordinates), a date, and one column for each variable; null
means missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import not_nan

PIXEL = ("lat_idx", "lon_idx")


def read_layers(spark: SparkSession, paths: list[str], time: str = "time") -> DataFrame:
    """Layers of one variable set as one cube; columns that some layer lacks are null there. NaN becomes null."""
    parts = [spark.read.parquet(p) for p in paths]
    cube = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return cube.select(*[not_nan(F.col(c)).alias(c) if t in ("float", "double") else F.col(c) for c, t in cube.dtypes])


def read_preprocessed(spark: SparkSession, folder: str, suffix: str = "_preprocessed") -> dict[str, DataFrame]:
    """The layers in the folders whose names end in ``suffix``, by the rest of their names; others are ignored."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    entries = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)
    names = sorted(e.getPath().getName() for e in entries if e.isDirectory())
    return {n.removesuffix(suffix): spark.read.parquet(f"{folder}/{n}") for n in names if n.endswith(suffix)}


def grid_mismatch(a: DataFrame, b: DataFrame, keys=PIXEL) -> DataFrame:
    """Cells that only one of two cubes has, with ``side`` 1 or 2; none if the grids are equal."""
    one, two = a.select(*keys).distinct(), b.select(*keys).distinct()
    return one.join(two, [*keys], "left_anti").withColumn("side", F.lit(1)).unionByName(
        two.join(one, [*keys], "left_anti").withColumn("side", F.lit(2))
    )


def merge_layers(layers: list[DataFrame], keys=PIXEL, time: str = "time", check_grid: bool = True) -> DataFrame:
    """Layers side by side, where all have a row. With ``check_grid``, grids that differ are an error."""
    if check_grid:
        for other in layers[1:]:
            if not grid_mismatch(layers[0], other, keys).isEmpty():
                raise ValueError("the layers have different grids")
    return reduce(lambda a, b: a.join(b, [*keys, time], "inner"), layers)


def write_examples(examples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Examples in folders by split and target month, so that reading some months reads only those."""
    examples.write.mode(mode).partitionBy("split", "target_month").parquet(path)


def read_examples(spark: SparkSession, path: str, split: str | None = None, months: list | None = None) -> DataFrame:
    found = spark.read.parquet(path)
    if split is not None:
        found = found.filter(F.col("split") == split)
    return found.filter(F.col("target_month").isin(months)) if months is not None else found


def first_by_time(cube: DataFrame, order: Column | str, keys=PIXEL, time: str = "time") -> DataFrame:
    """One row for each cell and time: the first by ``order``."""
    w = Window.partitionBy(*keys, time).orderBy(order)
    return cube.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def predictions(tables: dict[str, DataFrame], value: str = "preds") -> DataFrame:
    """Predictions of several models as one table with a ``model`` column."""
    parts = [df.select("*", F.lit(m).alias("model")).withColumnRenamed(value, "preds") for m, df in sorted(tables.items())]
    return reduce(lambda a, b: a.unionByName(b), parts)


def densify(cube: DataFrame, keys=PIXEL, time: str = "time") -> DataFrame:
    """A row for each cell and time that occur anywhere; new rows are null in all variables.

    Cells and times are small next to their product, so the times of the cube (one list) go to every cell.
    """
    times = cube.select(time).distinct().agg(F.sort_array(F.collect_list(time)).alias("_times"))
    cells = cube.select(*keys).distinct().join(F.broadcast(times))
    full = cells.select(*keys, F.explode("_times").alias(time))
    return full.join(cube, [*keys, time], "left")


def rows_to_pixels(
    rows: DataFrame, values: str, lat: tuple[float, float], lon: tuple[float, float], flip: bool = False
) -> DataFrame:
    """A grid of numbers (``values``: array of arrays) in each row, as a row for each cell.

    Coordinates are spread evenly from the first to the last of ``lat`` and ``lon``; ``flip`` turns the grid upside down.
    """
    height, width = F.size(values), F.size(F.element_at(values, 1))
    others = [c for c in rows.columns if c != values]
    lines = rows.select(*others, height.alias("_h"), width.alias("_w"), F.posexplode(values).alias("_i", "_line"))
    cells = lines.select(*others, "_h", "_w", "_i", F.posexplode("_line").alias("lon_idx", "value"))
    at = (F.col("_h") - 1 - F.col("_i")) if flip else F.col("_i")
    step = lambda ends, i, n: F.lit(ends[0]) + i * F.try_divide(F.lit(float(ends[1] - ends[0])), n - 1)
    return cells.select(
        *others, at.cast("int").alias("lat_idx"), "lon_idx", step(lat, at, F.col("_h")).alias("lat"),
        step(lon, F.col("lon_idx"), F.col("_w")).alias("lon"), "value",
    )


def standard_names(df: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """``latitude`` and ``longitude`` become ``lat`` and ``lon``, the column with "time" in its name ``time``; helpers go."""
    names = {"latitude": "lat", "longitude": "lon"} | {c: "time" for c in df.columns if "time" in c and c not in drop}
    return df.drop(*drop).withColumnsRenamed(names)


def to_long(cube: DataFrame, variables: list[str], keys=PIXEL, time: str = "time") -> DataFrame:
    """``variable, value`` rows."""
    return cube.unpivot([*keys, time], [F.col(v).cast("double").alias(v) for v in variables], "variable", "value")


def to_cube(long: DataFrame, variables: list[str], keys=PIXEL, time: str = "time") -> DataFrame:
    """Back from ``variable, value`` rows; the variables are given, so the data are read once."""
    return long.groupBy(*keys, time).pivot("variable", variables).agg(F.first("value"))


def region_lookup(attrs: DataFrame, keys: str = "keys", values: str = "values") -> DataFrame:
    """``region_id, region_name`` from two comma-joined strings."""
    pairs = F.explode(F.arrays_zip(F.split(keys, ",").alias("k"), F.split(values, ",").alias("v")))
    return attrs.select(pairs.alias("p")).select(
        F.trim("p.k").cast("int").alias("region_id"), F.trim("p.v").alias("region_name")
    )


def missing_periods(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Expected periods for which nothing is there yet."""
    return expected.join(present.select(*keys).distinct(), keys, "left_anti")


def save_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Indices and scores as Parquet, or as CSV with a header."""
    df.write.mode("overwrite").option("header", True).format(form).save(path)


# Cubes over the driver's tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube_ship(spark: SparkSession, sf_dir: str, cells: int = 25, width: int = 5) -> DataFrame:
    """Monthly cube of shipments: the supplier gives the cell."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % cells).cast("int").alias("pixel_id"), F.last_day("l_shipdate").alias("time"),
        "l_quantity", "l_extendedprice", "l_discount",
    )
    cube = rows.groupBy("pixel_id", "time").agg(
        F.sum("l_quantity").alias("precip"), F.avg("l_extendedprice").alias("price"), (F.avg("l_discount") * 1000).alias("vci")
    )
    return cube.select(
        F.floor(F.col("pixel_id") / width).cast("int").alias("lat_idx"), (F.col("pixel_id") % width).cast("int").alias("lon_idx"),
        "pixel_id", "time", "precip", "price", "vci",
    )


def dense_ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cube_ship() with a row for each cell and month."""
    return densify(cube_ship(spark, sf_dir), ("lat_idx", "lon_idx", "pixel_id"))


def cube_events(spark: SparkSession, sf_dir: str, width: int = 15) -> DataFrame:
    """Daily cube of events: the user gives the cell."""
    rows = table(spark, sf_dir, "events").select(
        F.floor(F.col("user_id") / width).cast("int").alias("lat_idx"), (F.col("user_id") % width).cast("int").alias("lon_idx"),
        F.to_date("ts").alias("time"), "event_type", "value",
    )
    return rows.groupBy("lat_idx", "lon_idx", "time", "event_type").agg(F.avg("value").alias("value"))


def ship_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of cube_ship() and its region."""
    cells = cube_ship(spark, sf_dir).select("pixel_id").distinct().withColumn("region_id", (F.col("pixel_id") % 5).cast("int"))
    names = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region_name"))
    return cells.join(names, "region_id")


def land_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pixel_id, year, code``: one row for each shipment, coded 1 to 6 by its flags."""
    flag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 25).cast("int").alias("pixel_id"), F.year("l_shipdate").alias("year"),
        (flag + 3 * (F.col("l_linestatus") == "O").cast("int")).cast("int").alias("code"),
    )


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``init_date, horizon_days, number, pixel_id, value``: orders start a forecast, their lines are its members."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("init_date"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        "init_date", (28 + F.col("l_partkey") % 65).cast("int").alias("horizon_days"), F.col("l_linenumber").cast("int").alias("number"),
        (F.col("l_suppkey") % 25).cast("int").alias("pixel_id"), F.col("l_quantity").alias("value"),
    )
