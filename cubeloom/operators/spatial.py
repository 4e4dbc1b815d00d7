"""Rasterising polygons and regridding.

Regridding is separable: for each axis a table says which source places make up a target place, and with what weight;
a cell's weight is the product. Axis tables are as long as an axis, so they are broadcast; the cube itself is shuffled
once, for the sums. Outside the source's hull targets are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import ratio


def reference_grid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two axes of a cube: ``lat_idx, lat`` and ``lon_idx, lon``."""
    return df.select("lat_idx", "lat").distinct(), df.select("lon_idx", "lon").distinct()


def polygon_edges(polygons: DataFrame) -> DataFrame:
    """The edges of rings (``ring``: array of x, y), the last point joined to the first."""
    n = F.size("ring")
    points = polygons.filter(n > 2).select("poly_id", "ring", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    here, there = F.get("ring", F.col("k")), F.get("ring", (F.col("k") + 1) % n)
    return points.select("poly_id", here["x"].alias("x1"), here["y"].alias("y1"), there["x"].alias("x2"), there["y"].alias("y2"))


def rasterise(cells: DataFrame, polygons: DataFrame, half_cell: tuple[float, float] = (0.0, 0.0), origin: str = "corner") -> DataFrame:
    """``poly_id`` of the last polygon that holds each cell, else null, by the even-odd rule.

    Cells have ``lat`` and ``lon``. With ``origin="corner"`` the point that is tested lies half a cell beyond the stored coordinate,
    with ``"center"`` on it. Rows of the grid and edges meet first, for the places where an edge crosses a row; the cells of a row
    are then held against the crossings of each polygon in it.
    """
    shift = half_cell if origin == "corner" else (0.0, 0.0)
    points = cells.select("lat_idx", "lon_idx", (F.col("lat") + shift[0]).alias("y"), (F.col("lon") + shift[1]).alias("x"))
    rows = points.select("y").distinct()
    edges = polygon_edges(polygons).filter("y1 != y2")
    # edges meet the rows that they span by bands as high as the grid divides into rows, on average
    height = rows.agg(F.min("y").alias("bottom"), ratio(F.max("y") - F.min("y"), F.count("*") - 1).alias("band"))
    height = height.select("bottom", F.coalesce(F.nullif("band", F.lit(0.0)), F.lit(1.0)).alias("band"))
    band = lambda y: F.floor((y - F.col("bottom")) / F.col("band"))
    ends = rows.agg(F.min("y").alias("low"), F.max("y").alias("high"))
    edges = edges.join(F.broadcast(height)).join(F.broadcast(ends))  # one row each
    low, high = F.greatest(F.least("y1", "y2"), F.col("low")), F.least(F.greatest("y1", "y2"), F.col("high"))
    edges = edges.filter(low <= high).withColumn("band_no", F.explode(F.sequence(band(low), band(high))))
    rows = rows.join(F.broadcast(height)).select("y", band(F.col("y")).alias("band_no"))
    met = rows.join(edges.drop("bottom", "band", "low", "high"), "band_no").filter((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y")))
    crossing = (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    crossings = met.groupBy("y", "poly_id").agg(F.sort_array(F.collect_list(crossing)).alias("at"))
    inside = points.join(crossings, "y").filter((F.col("x") >= F.element_at("at", 1)) & (F.col("x") < F.element_at("at", -1)))
    inside = inside.filter(F.size(F.filter("at", lambda c: c > F.col("x"))) % 2 == 1)
    owner = inside.groupBy("lat_idx", "lon_idx").agg(F.max("poly_id").alias("poly_id"))
    return cells.join(owner, ["lat_idx", "lon_idx"], "left")


#: Places that a cell is interpolated from by distance.
NEIGHBOURS = 4


def _nearest_places(source: DataFrame, target: DataFrame, idx: str, at: str, n: int) -> DataFrame:
    """``t`` and ``places``: for each target place, the n nearest source places ``far, s`` of one axis, nearest first, of equal ones the lower index."""
    along = Window.partitionBy().orderBy(at)  # over one row for each place of an axis
    place = F.struct(F.col(at).alias("y"), F.col(idx).alias("s"))
    known = source.select(F.col(at).alias("_x"), F.lit(0).alias("_is_target"), F.lit(None).cast("int").alias("t"),
                          F.collect_list(place).over(along.rowsBetween(1 - n, 0)).alias("_b"), F.collect_list(place).over(along.rowsBetween(0, n - 1)).alias("_a"))
    none = F.lit(None).cast(known.schema["_b"].dataType)
    both = known.unionByName(target.select(F.col(at).alias("_x"), F.lit(1).alias("_is_target"), F.col(idx).cast("int").alias("t"), none.alias("_b"), none.alias("_a")))
    w = Window.partitionBy().orderBy("_x", "_is_target")
    before = F.last("_b", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_a", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = both.select("t", "_x", F.array_distinct(F.concat(F.coalesce(before, F.array()), F.coalesce(after, F.array()))).alias("_near")).filter("t is not null")
    near = near.withColumn("_near", F.array_sort(F.transform("_near", lambda p: F.struct(F.abs(p["y"] - F.col("_x")).alias("far"), p["s"].alias("s")))))
    return near.select("t", F.slice("_near", 1, n).alias("places"))


def distance_weights(source: tuple[DataFrame, DataFrame], target: tuple[DataFrame, DataFrame], n: int = NEIGHBOURS) -> DataFrame:
    """``_i, _j`` (target cell), ``lat_idx, lon_idx`` (source cell) and ``_w``: the n nearest source cells of each target cell by inverse distance.

    The n nearest cells of a rectilinear grid lie in the n nearest rows and columns, so a row for each target cell has all that it takes: the product of
    two lists, sorted, of which the first n stay. Of equally far cells that with the lower row, then column, is nearer; a
    cell that is met exactly stands alone.
    """
    lat = _nearest_places(source[0], target[0], "lat_idx", "lat", n).toDF("_i", "_rows")
    lon = _nearest_places(source[1], target[1], "lon_idx", "lon", n).toDF("_j", "_columns")
    cells = F.flatten(F.transform("_rows", lambda r: F.transform("_columns", lambda c: F.struct((r["far"] ** 2 + c["far"] ** 2).alias("d"), r["s"].alias("lat_idx"), c["s"].alias("lon_idx")))))
    found = lat.crossJoin(lon).withColumn("_cells", F.slice(F.array_sort(cells), 1, n))  # a row for each target cell, the grid itself
    found = found.select("_i", "_j", F.get("_cells", F.lit(0))["d"].alias("_least"), F.explode("_cells").alias("c"))
    w = F.when(F.col("_least") > 0, ratio(F.lit(1.0), F.sqrt("c.d"))).otherwise((F.col("c.d") == 0).cast("double"))
    return found.select("_i", "_j", "c.lat_idx", "c.lon_idx", w.alias("_w"))


def _axis(source: DataFrame, target: DataFrame, idx: str, at: str, method: str) -> DataFrame:
    """``t``, target place; ``s``, source place; ``w``, weight."""
    if method in ("nearest", "bilinear"):
        # both axes in one order, so that each target place sees the source places before and after it
        w = Window.partitionBy().orderBy("_x", "_is_target")  # over one row for each place of an axis
        place = F.struct(F.col(at).alias("y"), F.col(idx).alias("s"))
        along = Window.partitionBy().orderBy(at)
        known = source.select(F.col(at).alias("_x"), place.alias("_p"), F.lag(place).over(along).alias("_b"), F.lead(place).over(along).alias("_a"))
        both = known.select("_x", F.lit(0).alias("_is_target"), F.lit(None).cast("int").alias("t"), F.struct("_p", "_b", "_a").alias("_s"))
        both = both.unionByName(target.select(F.col(at).alias("_x"), F.lit(1).alias("_is_target"), F.col(idx).cast("int").alias("t"), F.lit(None).cast(both.schema["_s"].dataType).alias("_s")))
        before = F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        after = F.first("_s", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        found = both.select("t", "_x", before.alias("_u"), after.alias("_v")).filter("t is not null")
        if method == "bilinear":
            exact = F.col("_u._p.y") == F.col("_x")
            share = (F.col("_x") - F.col("_u._p.y")) / (F.col("_v._p.y") - F.col("_u._p.y"))
            one = F.struct(F.col("_u._p.s").alias("s"), F.when(exact, 1.0).otherwise(1 - share).alias("w"))
            two = F.struct(F.col("_v._p.s").alias("s"), F.when(exact, 0.0).otherwise(share).alias("w"))
            inside = found.filter(exact | (F.col("_u").isNotNull() & F.col("_v").isNotNull()))
            return inside.select("t", F.explode(F.array(one, two)).alias("p")).select("t", "p.s", "p.w").filter("w > 0")
        near = F.filter(F.array("_u._p", "_u._b", "_v._p", "_v._a"), lambda p: p.isNotNull())
        near = F.array_min(F.transform(near, lambda p: F.struct(F.abs(p["y"] - F.col("_x")).alias("far"), p["s"].alias("s"))))
        return found.select("t", near["s"].alias("s"), F.lit(1.0).alias("w"))
    if method == "conservative":
        size = (lambda a: F.sin(F.radians(a))) if at == "lat" else (lambda a: a)  # area between parallels
        edges = {}
        for table, name, n, x in ((source, "source", "s", "_y"), (target, "target", "t", "_x")):
            w = Window.partitionBy().orderBy(at)  # over one row for each place of an axis
            before, after = F.lag(at).over(w), F.lead(at).over(w)
            left = F.coalesce((F.col(at) + before) / 2, F.col(at) - (after - F.col(at)) / 2)
            right = F.coalesce((F.col(at) + after) / 2, F.col(at) + (F.col(at) - before) / 2)
            edges[name] = table.select(F.col(idx).alias(n), left.alias(f"{x}l"), right.alias(f"{x}r"))
        both = edges["target"].join(F.broadcast(edges["source"]), (F.col("_yl") < F.col("_xr")) & (F.col("_yr") > F.col("_xl")))
        low, high = F.greatest("_xl", "_yl"), F.least("_xr", "_yr")
        return both.select("t", "s", (size(high) - size(low)).alias("w"))
    raise ValueError(f"unknown method {method}")


def regrid_weights(source: tuple[DataFrame, DataFrame], target: tuple[DataFrame, DataFrame], method: str) -> tuple[DataFrame, DataFrame]:
    """Axis tables from source to target axes, to be made once and used for every layer."""
    return _axis(source[0], target[0], "lat_idx", "lat", method), _axis(source[1], target[1], "lon_idx", "lon", method)


def regrid(df: DataFrame, target: tuple[DataFrame, DataFrame], values: list[str], method: str = "nearest", time: str = "time") -> DataFrame:
    """A cube on another grid.

    Methods: ``nearest``; ``bilinear`` (null if one of the four is null or absent); ``conservative`` (mean by overlapping area, of cells
    that have a value); ``distance`` (the four nearest cells, whatever the spacing of the axes, by inverse distance in degrees; of these, those that
    have a value); ``largest_area`` (the class with the most overlap; of equal
    ones the least); ``nearest_to_target`` (mean of the source cells whose nearest target it is).
    """
    source = reference_grid(df)
    if method == "nearest_to_target":
        back = regrid_weights(target, source, "nearest")
        found = df.join(F.broadcast(back[0].select(F.col("t").alias("lat_idx"), F.col("s").alias("_i"))), "lat_idx")
        found = found.join(F.broadcast(back[1].select(F.col("t").alias("lon_idx"), F.col("s").alias("_j"))), "lon_idx")
        found = found.groupBy(F.col("_i").alias("lat_idx"), F.col("_j").alias("lon_idx"), time).agg(*[F.avg(v).alias(v) for v in values])
        return _with_coordinates(found, target)
    if method == "distance":
        met = df.select("lat_idx", "lon_idx", time, *values).join(distance_weights(source, target), ["lat_idx", "lon_idx"])
        w = F.col("_w")
        found = met.groupBy(F.col("_i").alias("lat_idx"), F.col("_j").alias("lon_idx"), time)
        return _with_coordinates(found.agg(*[ratio(F.sum(F.col(v) * w), F.sum(F.when(F.col(v).isNotNull(), w))).alias(v) for v in values]), target)
    kind = {"largest_area": "conservative"}.get(method, method)
    lat, lon = regrid_weights(source, target, kind)
    lat = lat.select(F.col("s").alias("lat_idx"), F.col("t").alias("_i"), F.col("w").alias("_wi"))
    lon = lon.select(F.col("s").alias("lon_idx"), F.col("t").alias("_j"), F.col("w").alias("_wj"))
    rows = df.select("lat_idx", "lon_idx", time, *values).join(F.broadcast(lat), "lat_idx").join(F.broadcast(lon), "lon_idx")
    weight = F.col("_wi") * F.col("_wj")
    cell = [F.col("_i").alias("lat_idx"), F.col("_j").alias("lon_idx"), time]
    if method == "largest_area":
        (value,) = values
        areas = rows.filter(F.col(value).isNotNull()).groupBy("_i", "_j", time, value).agg(F.sum(weight).alias("_w"))
        found = areas.groupBy(*cell).agg(F.max_by(value, F.struct(F.round("_w", 12), -F.col(value))).alias(value))
    elif method == "nearest":
        found = rows.select(*cell, *values)
    elif method == "bilinear":
        found = rows.groupBy(*cell).agg(*[F.when((F.count(v) == F.count("*")) & (F.sum(weight) > 1 - 1e-9), F.sum(F.col(v) * weight)).alias(v) for v in values])
        hull = df.agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"))
        found = _with_coordinates(found, target).join(F.broadcast(hull))  # one row
        return found.filter("lat between a and b and lon between c and d").drop("a", "b", "c", "d")
    else:
        found = rows.groupBy(*cell).agg(*[ratio(F.sum(F.col(v) * weight), F.sum(F.when(F.col(v).isNotNull(), weight))).alias(v) for v in values])
    return _with_coordinates(found, target)


def _with_coordinates(found: DataFrame, target: tuple[DataFrame, DataFrame]) -> DataFrame:
    return found.join(F.broadcast(target[0]), "lat_idx").join(F.broadcast(target[1]), "lon_idx")


def axes(spark, lat: list[float], lon: list[float]) -> tuple[DataFrame, DataFrame]:
    """A target grid from two lists of coordinates."""
    one = spark.createDataFrame([(k, float(x)) for k, x in enumerate(lat)], "lat_idx int, lat double")
    return one, spark.createDataFrame([(k, float(x)) for k, x in enumerate(lon)], "lon_idx int, lon double")
