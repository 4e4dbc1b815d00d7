"""Queries of aggregates (d), joins (e), windows (w), top-k and set operations (k), indices (i) and events (v)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import events, indices, joins, spatial, windows
from ..sources import cubes
from .queries_cube import DAYS, KEY, daily, located
from .registry import cube_sql, query

MONTH = "PARTITION BY pixel_id, month(time)"
#: Average ranks of the rolled sum in the month's group, and the size of the group.
RANKED = f"""ranked AS (SELECT *, CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY pixel_id, month(time), x IS NULL ORDER BY x)
    + (count(*) OVER (PARTITION BY pixel_id, month(time), x) - 1) / 2.0 END AS rk, count(*) OVER ({MONTH}) AS n FROM cs)"""


def dense(spark, sf):
    return cubes.dense_ship(spark, sf)


# aggregates


@query("d01_climatology", cube_sql("SELECT pixel_id, CAST(month(time) AS INTEGER) AS month, avg(precip) AS mean, stddev_pop(precip) AS std FROM dense GROUP BY 1, 2"), "mean std")
def d01(spark, sf):
    return agg.climatology(dense(spark, sf), "precip", keys=KEY)


@query("d02_quantile", cube_sql("SELECT pixel_id, CAST(month(time) AS INTEGER) AS month, quantile_cont(precip, 0.9) AS quantile FROM dense GROUP BY 1, 2"), "quantile")
def d02(spark, sf):
    return agg.climatology_quantile(dense(spark, sf), "precip", 0.9, keys=KEY)


@query("d03_spatial_mean", cube_sql("SELECT time, avg(precip) AS spatial_mean_precip FROM dense GROUP BY 1"), "spatial_mean_precip")
def d03(spark, sf):
    return agg.spatial_mean(dense(spark, sf), "precip")


@query("d03_temporal_mean", cube_sql("SELECT pixel_id, avg(vci) AS vci_pixel_mean FROM dense GROUP BY 1"), "vci_pixel_mean")
def d03_time(spark, sf):
    return agg.temporal_mean(dense(spark, sf), "vci", KEY)


COVER = "cover AS (SELECT CAST(l_suppkey % 25 AS INTEGER) AS pixel_id, year(l_shipdate) AS year, CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END + 3 * CAST(l_linestatus = 'O' AS INTEGER) AS INTEGER) AS code FROM lineitem)"


@query("d04_mode", f"WITH {COVER}, n AS (SELECT pixel_id, year, code, count(*) AS n FROM cover GROUP BY ALL) SELECT pixel_id, CAST(year AS INTEGER) AS year, code AS mode FROM (SELECT *, row_number() OVER (PARTITION BY pixel_id, year ORDER BY n DESC, code) AS k FROM n) WHERE k = 1")
def d04(spark, sf):
    return agg.mode_over_time(cubes.land_cover(spark, sf), "code", ("pixel_id", "year"))


@query("d05_norm_table", cube_sql("SELECT 'precip' AS variable, avg(precip) AS mean, stddev_pop(precip) AS std FROM dense UNION ALL SELECT 'vci', avg(vci), stddev_pop(vci) FROM dense UNION ALL SELECT 'a_one_hot', 0, 1"), "mean std")
def d05(spark, sf):
    return agg.norm_table(dense(spark, sf).withColumn("a_one_hot", F.lit(1)), ["precip", "vci", "a_one_hot"])


@query("d06_static_means", cube_sql("SELECT pixel_id, avg(precip) AS precip_pixel_mean, avg(vci) AS vci_pixel_mean, any_value(gp) AS precip_global_mean, any_value(gv) AS vci_global_mean FROM dense, (SELECT avg(precip) gp, avg(vci) gv FROM dense WHERE year(time) < 2000) WHERE year(time) < 2000 GROUP BY 1"), "precip_pixel_mean vci_pixel_mean precip_global_mean vci_global_mean")
def d06(spark, sf):
    return agg.static_means(dense(spark, sf), ["precip", "vci"], [2000, 2001], KEY)


FORECAST = """forecast AS (SELECT CAST(o_orderdate AS DATE) AS init_date, CAST(28 + l_partkey % 65 AS INTEGER) AS horizon_days, l_linenumber AS number, CAST(l_suppkey % 25 AS INTEGER) AS pixel_id, l_quantity AS value
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query("d07_ensemble", f"WITH {FORECAST} SELECT pixel_id, last_day(init_date) AS time, avg(value) AS value_mean, stddev_pop(value) AS value_std FROM forecast WHERE number < 5 GROUP BY 1, 2", "value_mean value_std")
def d07(spark, sf):
    rows = cubes.forecasts(spark, sf).withColumn("time", F.last_day("init_date"))
    return agg.ensemble(rows, "value", ["pixel_id", "time"], members=5)


@query("d08_steps_ahead", f"""WITH {FORECAST} SELECT pixel_id, last_day(init_date) AS time, avg(value) FILTER (horizon_days BETWEEN 28 AND 31) AS value_1, avg(value) FILTER (horizon_days BETWEEN 59 AND 62) AS value_2,
    avg(value) FILTER (horizon_days BETWEEN 89 AND 92) AS value_3 FROM forecast WHERE horizon_days BETWEEN 28 AND 31 OR horizon_days BETWEEN 59 AND 62 OR horizon_days BETWEEN 89 AND 92 GROUP BY 1, 2""", "value_1 value_2 value_3")
def d08(spark, sf):
    rows = cubes.forecasts(spark, sf).withColumn("time", F.last_day("init_date"))
    return agg.steps_ahead(rows, "value", ["pixel_id", "time"])


SEASON = "CASE WHEN month(time) IN (12, 1, 2) THEN 'DJF' WHEN month(time) < 6 THEN 'MAM' WHEN month(time) < 9 THEN 'JJA' ELSE 'SON' END"


@query("d09_weighted_season", cube_sql(f"SELECT pixel_id, {SEASON} AS season, sum(precip * day(time)) / sum(CASE WHEN precip IS NOT NULL THEN day(time) END) AS weighted_mean FROM dense GROUP BY 1, 2"), "weighted_mean")
def d09(spark, sf):
    return agg.weighted_seasonal_mean(dense(spark, sf), "precip", keys=KEY)


@query("d10_seasonality", cube_sql("SELECT CAST(m + a AS INTEGER) AS month, avg(v) AS mean, stddev_pop(v) AS std FROM (SELECT time, month(time) AS m, avg(precip) AS v FROM dense GROUP BY 1), (VALUES (0), (12)) r(a) GROUP BY 1"), "mean std")
def d10(spark, sf):
    return agg.double_year(agg.seasonality_std(dense(spark, sf), "precip"))


@query("d11_bin_means", cube_sql("SELECT CAST(greatest(least(ceil((price - a) / ((b - a) / 8)), 8), 1) AS INTEGER) AS bin, avg(precip) AS mean, count(*) AS n FROM dense, (SELECT min(price) a, max(price) b FROM dense) WHERE price IS NOT NULL GROUP BY 1"), "mean")
def d11(spark, sf):
    return agg.bin_means(dense(spark, sf), "price", "precip", 8)


@query("d11_in_bin", cube_sql("SELECT pixel_id, time, coalesce(vci > 45 AND vci < 50, false) AS inside FROM dense"))
def d11_bin(spark, sf):
    return agg.in_bin(dense(spark, sf), "vci", 45.0, 50.0).select("pixel_id", "time", "inside")


@query("d12_histogram", cube_sql("SELECT CAST(floor(precip / 50) * 50 AS DOUBLE) AS bin, count(*) AS n FROM dense WHERE precip IS NOT NULL GROUP BY 1"), "bin")
def d12(spark, sf):
    return agg.histogram(dense(spark, sf), "precip", 50.0)


@query("d12_share_below", cube_sql("SELECT pixel_id, avg(CAST(vci < 48 AS DOUBLE)) AS share FROM dense GROUP BY 1"), "share")
def d12_share(spark, sf):
    return agg.share_below(dense(spark, sf), "vci", 48.0, ["pixel_id"])


@query("d13_yearly_below", cube_sql("SELECT CAST(year(time) AS INTEGER) AS year, count(*) FILTER (vci < 48) AS n_below FROM dense GROUP BY 1"))
def d13(spark, sf):
    return agg.yearly_counts_below(dense(spark, sf), "vci", 48.0)


@query("d14_colour_range", cube_sql("SELECT quantile_cont(precip, 0.05) AS vmin, quantile_cont(precip, 0.95) AS vmax FROM dense"), "vmin vmax")
def d14(spark, sf):
    return agg.colour_range(dense(spark, sf), "precip")


@query("d15_correlation", cube_sql("SELECT pixel_id, corr(precip, vci) AS r, corr(precip, vci) ** 2 AS r2, regr_slope(vci, precip) AS slope, regr_intercept(vci, precip) AS intercept, count(*) AS n FROM dense WHERE precip IS NOT NULL AND vci IS NOT NULL GROUP BY 1"), "r r2 slope intercept")
def d15(spark, sf):
    return agg.correlation(dense(spark, sf), "precip", "vci", ["pixel_id"])


@query("d15_spearman", cube_sql("SELECT pixel_id, corr(a, b) AS rho FROM r GROUP BY 1", """r AS (SELECT pixel_id,
    rank() OVER (PARTITION BY pixel_id ORDER BY precip) + (count(*) OVER (PARTITION BY pixel_id, precip) - 1) / 2.0 AS a,
    rank() OVER (PARTITION BY pixel_id ORDER BY price) + (count(*) OVER (PARTITION BY pixel_id, price) - 1) / 2.0 AS b FROM cube)"""), "rho")
def d15_rank(spark, sf):
    return agg.spearman(dense(spark, sf), "precip", "price", ["pixel_id"])


@query("d15_matrix", cube_sql("SELECT * FROM (SELECT 'precip' AS a, 'precip' AS b, corr(precip, precip) AS r FROM cube UNION ALL SELECT 'precip', 'price', corr(precip, price) FROM cube UNION ALL SELECT 'precip', 'vci', corr(precip, vci) FROM cube UNION ALL SELECT 'price', 'price', corr(price, price) FROM cube UNION ALL SELECT 'price', 'vci', corr(price, vci) FROM cube UNION ALL SELECT 'vci', 'vci', corr(vci, vci) FROM cube)"), "r")
def d15_matrix(spark, sf):
    return agg.correlation_matrix(cubes.cube_ship(spark, sf), ["precip", "price", "vci"])


@query("d16_autocorrelation", cube_sql("SELECT pixel_id, CAST(lag AS INTEGER) AS lag, sum(d * p) / sum(d * d) AS acf FROM (SELECT pixel_id, k AS lag, d, lag(d, k) OVER (PARTITION BY pixel_id, k ORDER BY time) AS p FROM (SELECT pixel_id, time, precip - avg(precip) OVER (PARTITION BY pixel_id) AS d FROM cube), (VALUES (1), (2), (12)) v(k)) GROUP BY 1, 2"), "acf")
def d16(spark, sf):
    return agg.autocorrelation(dense(spark, sf), "precip", (1, 2, 12), KEY)


@query("d17_fit_by_year", cube_sql("SELECT CAST(year(time) AS INTEGER) AS year, regr_slope(price, precip) AS slope, regr_intercept(price, precip) AS intercept FROM cube GROUP BY 1"), "slope intercept")
def d17(spark, sf):
    rows = cubes.cube_ship(spark, sf).withColumn("year", F.year("time"))
    return agg.correlation(rows, "precip", "price", ["year"]).select("year", "slope", "intercept")


@query("d18_group_difference", cube_sql("""
    SELECT v.variable, any_value(t) AS top, any_value(b) AS bottom, any_value(s) AS std, any_value((t - b) / nullif(s, 0)) AS difference FROM (
        SELECT 'price' AS variable, (SELECT avg(price) FROM hi) AS t, (SELECT avg(price) FROM lo) AS b, (SELECT stddev_pop(price) FROM cube) AS s
        UNION ALL SELECT 'vci', (SELECT avg(vci) FROM hi), (SELECT avg(vci) FROM lo), (SELECT stddev_pop(vci) FROM cube)) v GROUP BY 1""",
    "hi AS (SELECT * FROM cube ORDER BY precip DESC, pixel_id, time LIMIT 50), lo AS (SELECT * FROM cube ORDER BY precip, pixel_id, time LIMIT 50)"), "top bottom std difference")
def d18(spark, sf):
    return agg.group_difference(cubes.cube_ship(spark, sf), "precip", ["price", "vci"], 50, ["pixel_id", "time"])


@query("d19_yearly_medians", cube_sql("SELECT CAST(year AS INTEGER) AS year, median(m) AS median FROM (SELECT pixel_id, year(time) AS year, median(vci) AS m FROM dense GROUP BY 1, 2) GROUP BY 1"), "median")
def d19(spark, sf):
    return agg.yearly_medians(dense(spark, sf), "vci", KEY)


@query("d20_coarsen", cube_sql("SELECT CAST(lat_idx // 2 AS INTEGER) AS lat_idx, CAST(lon_idx // 2 AS INTEGER) AS lon_idx, time, median(precip) AS precip FROM dense WHERE lat_idx < 4 AND lon_idx < 4 GROUP BY 1, 2, 3"), "precip")
def d20(spark, sf):
    return agg.coarsen(dense(spark, sf), "precip", 2)


@query("d21_normalised_cycle", cube_sql("SELECT CAST(month AS INTEGER) AS month, avg(m) AS cycle, avg(100 * m / nullif(t, 0)) AS percent FROM (SELECT *, sum(m) OVER (PARTITION BY pixel_id) AS t FROM (SELECT pixel_id, month(time) AS month, avg(precip) AS m FROM dense GROUP BY 1, 2)) GROUP BY 1"), "cycle percent")
def d21(spark, sf):
    return agg.normalised_cycle(dense(spark, sf), "precip", KEY)


@query("d22_summary", cube_sql("SELECT 'precip' AS variable, min(precip) AS min, max(precip) AS max, avg(precip) AS mean, median(precip) AS median FROM cube UNION ALL SELECT 'vci', min(vci), max(vci), avg(vci), median(vci) FROM cube"), "min max mean median")
def d22(spark, sf):
    return agg.summary(cubes.cube_ship(spark, sf), ["precip", "vci"])


@query("d22_binned_pairs", cube_sql("SELECT CAST(least(floor(6 * (precip - a) / (b - a)), 5) AS INTEGER) AS bin_x, CAST(least(floor(6 * (vci - c) / (d - c)), 5) AS INTEGER) AS bin_y, count(*) AS n, any_value(r) AS r FROM cube, (SELECT min(precip) a, max(precip) b, min(vci) c, max(vci) d, corr(precip, vci) r FROM cube) GROUP BY 1, 2"), "r")
def d22_pairs(spark, sf):
    return agg.binned_pairs(cubes.cube_ship(spark, sf), "precip", "vci", 6)


# joins


@query("e01_inner_align", cube_sql("SELECT a.pixel_id, a.time, a.precip, b.price FROM cube a JOIN cube b USING (pixel_id, time) WHERE a.vci > 50 AND b.precip > 500"), "precip price")
def e01(spark, sf):
    cube = cubes.cube_ship(spark, sf)
    return joins.inner_align(cube.filter("vci > 50").select("pixel_id", "time", "precip"), cube.filter("precip > 500").select("pixel_id", "time", "price"), KEY)


@query("e02_outer_merge", cube_sql("SELECT pixel_id, time, vci FROM cube WHERE vci > 51 OR vci < 48"), "vci")
def e02(spark, sf):
    cube = cubes.cube_ship(spark, sf)
    return joins.outer_merge(cube.filter("vci > 51"), cube.filter("vci < 48 or vci > 53"), ["vci"], KEY, check=True)


@query("e03_align_climatology", cube_sql(f"SELECT pixel_id, time, precip, avg(precip) OVER ({MONTH}) AS mean, stddev_pop(precip) OVER ({MONTH}) AS std FROM dense"), "precip mean std")
def e03(spark, sf):
    rows = dense(spark, sf).select("pixel_id", "time", "precip")
    return joins.align_climatology(rows, agg.climatology(rows, "precip", keys=KEY), keys=KEY).drop("month")


@query("e04_spatial_mean_feature", cube_sql("SELECT pixel_id, time, precip, avg(precip) OVER (PARTITION BY time) AS spatial_mean_precip FROM dense"), "precip spatial_mean_precip")
def e04(spark, sf):
    return joins.with_spatial_mean(dense(spark, sf).select("pixel_id", "time", "precip"), ["precip"])


@query("e05_region_means", cube_sql("SELECT r_regionkey AS region_id, t.time, r_name AS region_name, m.precip FROM region CROSS JOIN (SELECT DISTINCT time FROM dense) t LEFT JOIN (SELECT pixel_id % 5 AS k, time, avg(precip) AS precip FROM dense WHERE pixel_id % 5 != 4 GROUP BY 1, 2) m ON m.k = r_regionkey AND m.time = t.time"), "precip")
def e05(spark, sf):
    cells = cubes.ship_regions(spark, sf).filter("region_id != 4")
    lookup = cubes.table(spark, sf, "region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region_name"))
    return joins.region_means(dense(spark, sf), cells, lookup, ["precip"])


@query("e06_join_geometry", "SELECT n_nationkey, r_name AS region_name, r_regionkey AS shape FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 3")
def e06(spark, sf):
    region = cubes.table(spark, sf, "region")
    names = cubes.table(spark, sf, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region_name"))
    shapes = region.filter("r_regionkey < 3").select(F.concat(F.lit("  "), "r_name", F.lit(" ")).alias("name"), F.col("r_regionkey").alias("shape"))
    return joins.join_geometry(names, shapes)


#: Inline polygons over the 5 x 5 grid; the second overlaps the first, the last is empty.
POLYGONS = [(1, "west", [(-1.0, -1.0), (2.2, -1.0), (2.2, 3.4), (-1.0, 3.4)]), (2, "wedge", [(1.1, 0.2), (4.9, 2.6), (1.3, 4.8)]), (3, "nothing", [])]


def polygons(spark):
    return spark.createDataFrame(POLYGONS, "poly_id int, name string, ring array<struct<x:double,y:double>>")


EDGES = ", ".join(
    f"({i}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for i, _, ring in POLYGONS for a, b in zip(ring, ring[1:] + ring[:1], strict=True)
)


@query("e07_rasterise", f"""
    WITH c AS (SELECT DISTINCT CAST((l_suppkey % 25) // 5 AS INTEGER) AS lat_idx, CAST(l_suppkey % 5 AS INTEGER) AS lon_idx FROM lineitem),
    p AS (SELECT *, lat_idx + 0.5 AS y, lon_idx + 0.5 AS x FROM c), e AS (SELECT * FROM (VALUES {EDGES}) v(id, x1, y1, x2, y2)),
    i AS (SELECT lat_idx, lon_idx, id FROM p, e WHERE (y1 > y) != (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)
    SELECT lat_idx, lon_idx, CAST(max(id) AS INTEGER) AS poly_id FROM c LEFT JOIN i USING (lat_idx, lon_idx) GROUP BY 1, 2""")
def e07(spark, sf):
    cells = cubes.cube_ship(spark, sf).select("lat_idx", "lon_idx", F.col("lat_idx").cast("double").alias("lat"), F.col("lon_idx").cast("double").alias("lon")).distinct()
    return spatial.rasterise(cells, polygons(spark), (0.5, 0.5)).select("lat_idx", "lon_idx", "poly_id")


@query("e08_nearest_time", f"""
    WITH {DAYS}, b AS (SELECT pixel_id, time, v AS w FROM days WHERE day(time) % 7 = 3)
    SELECT pixel_id, time, v, w FROM (SELECT d.pixel_id, d.time, d.v, b.w, row_number() OVER (PARTITION BY d.pixel_id, d.time ORDER BY abs(d.time - b.time), b.time) AS k FROM days d LEFT JOIN b ON b.pixel_id = d.pixel_id) WHERE k = 1""", "v w")
def e08(spark, sf):
    rows = daily(spark, sf)
    other = rows.filter("day(time) % 7 = 3").withColumnRenamed("v", "w")
    return joins.nearest_time(rows, other, ["w"], KEY)


def coordinates(cube):
    return cube.withColumns({"lat": F.col("lat_idx") * 1.0, "lon": F.col("lon_idx") * 1.0})


#: A target grid inside, on and outside the hull of the source.
LAT, LON = [0.25, 1.0, 2.6, 4.4], [-0.4, 0.5, 1.75, 3.0]
_TARGET = "ta AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {x})" for k, x in enumerate(LAT)) + ") v(i, y)), tb AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {x})" for k, x in enumerate(LON)) + ") v(j, x))"
_OUT = "CAST(i AS INTEGER) AS lat_idx, CAST(j AS INTEGER) AS lon_idx, time, y AS lat, x AS lon"


def _regrid(name: str, method: str, sql: str, value: str = "precip"):
    @query(name, cube_sql(sql, _TARGET), f"{value} lat lon")
    def run(spark, sf):
        cube = coordinates(dense(spark, sf)).withColumn("code", (F.col("precip") % 3).cast("double"))
        return spatial.regrid(cube, spatial.axes(spark, LAT, LON), [value], method).select("lat_idx", "lon_idx", "time", "lat", "lon", value)


_regrid("e09_regrid_nearest", "nearest", f"SELECT {_OUT}, precip FROM ta, tb, dense WHERE lat_idx = (SELECT k FROM range(5) r(k) ORDER BY abs(k - y), k LIMIT 1) AND lon_idx = (SELECT k FROM range(5) r(k) ORDER BY abs(k - x), k LIMIT 1)")
_regrid("e10_regrid_bilinear", "bilinear", f"""
    SELECT {_OUT}, CASE WHEN count(precip) = count(*) THEN sum(precip * greatest(0, 1 - abs(lat_idx - y)) * greatest(0, 1 - abs(lon_idx - x))) END AS precip
    FROM ta, tb, dense WHERE y BETWEEN 0 AND 4 AND x BETWEEN 0 AND 4 AND abs(lat_idx - y) < 1 AND abs(lon_idx - x) < 1 GROUP BY ALL""")
_AREA = """wa AS (SELECT i, lat, sin(radians(least(yb, lat + 0.5))) - sin(radians(greatest(ya, lat - 0.5))) AS w FROM (
        SELECT i, CASE i WHEN 0 THEN -0.125 WHEN 1 THEN 0.625 WHEN 2 THEN 1.8 ELSE 3.5 END AS ya, CASE i WHEN 0 THEN 0.625 WHEN 1 THEN 1.8 WHEN 2 THEN 3.5 ELSE 5.3 END AS yb FROM ta), range(5) r(lat) WHERE lat - 0.5 < yb AND lat + 0.5 > ya),
    wb AS (SELECT j, lon, least(xb, lon + 0.5) - greatest(xa, lon - 0.5) AS w FROM (
        SELECT j, CASE j WHEN 0 THEN -0.85 WHEN 1 THEN 0.05 WHEN 2 THEN 1.125 ELSE 2.375 END AS xa, CASE j WHEN 0 THEN 0.05 WHEN 1 THEN 1.125 WHEN 2 THEN 2.375 ELSE 3.625 END AS xb FROM tb), range(5) r(lon) WHERE lon - 0.5 < xb AND lon + 0.5 > xa)"""
_FROM = "dense JOIN wa ON wa.lat = lat_idx JOIN wb ON wb.lon = lon_idx JOIN ta USING (i) JOIN tb USING (j)"


def _conservative(name: str, method: str, sql: str, value: str):
    @query(name, cube_sql(sql, _TARGET + ", " + _AREA), f"{value} lat lon")
    def run(spark, sf):
        cube = coordinates(dense(spark, sf)).withColumn("code", (F.col("precip") % 3).cast("double"))
        return spatial.regrid(cube, spatial.axes(spark, LAT, LON), [value], method).select("lat_idx", "lon_idx", "time", "lat", "lon", value)


_conservative("e11_regrid_conservative", "conservative", f"SELECT {_OUT}, sum(precip * wa.w * wb.w) / sum(CASE WHEN precip IS NOT NULL THEN wa.w * wb.w END) AS precip FROM {_FROM} GROUP BY ALL", "precip")
_conservative("e12_regrid_largest_area", "largest_area", f"""SELECT lat_idx, lon_idx, time, lat, lon, code FROM (SELECT *, row_number() OVER (PARTITION BY lat_idx, lon_idx, time ORDER BY a DESC, code) AS k FROM (
    SELECT {_OUT}, precip % 3 AS code, round(sum(wa.w * wb.w), 12) AS a FROM {_FROM} WHERE precip IS NOT NULL GROUP BY ALL)) WHERE k = 1""", "code")
def _by_distance(lat: str) -> str:
    """The four nearest of all 25 source cells, whose latitudes are ``lat``."""
    return f"""SELECT {_OUT}, CASE WHEN min(d) = 0 THEN max(CASE WHEN d = 0 THEN precip END) ELSE sum(precip / nullif(d, 0)) / sum(CASE WHEN precip IS NOT NULL THEN 1 / nullif(d, 0) END) END AS precip
        FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY d, a, b) AS n FROM (SELECT i, j, y, x, r.a, s.b, sqrt(({lat} - y) ** 2 + (s.b - x) ** 2) AS d FROM ta, tb, range(5) r(a), range(5) s(b)))
        JOIN dense ON lat_idx = a AND lon_idx = b WHERE n <= 4 GROUP BY i, j, y, x, time"""


_regrid("e12_regrid_distance", "distance", _by_distance("r.a"))


@query("e12_regrid_distance_uneven", cube_sql(_by_distance("10 * r.a"), _TARGET), "precip lat lon")
def e12_uneven(spark, sf):
    """Rows ten times as far apart as columns: the four nearest lie in one or two rows."""
    cube = coordinates(dense(spark, sf)).withColumn("lat", F.col("lat_idx") * 10.0)
    return spatial.regrid(cube, spatial.axes(spark, LAT, LON), ["precip"], "distance").select("lat_idx", "lon_idx", "time", "lat", "lon", "precip")


_regrid("e12_regrid_to_target", "nearest_to_target", f"""
    SELECT {_OUT}, avg(precip) AS precip FROM dense,
        (SELECT * FROM (SELECT k, i, y, row_number() OVER (PARTITION BY k ORDER BY abs(k - y), i) AS n FROM ta, range(5) r(k)) WHERE n = 1) a,
        (SELECT * FROM (SELECT k, j, x, row_number() OVER (PARTITION BY k ORDER BY abs(k - x), j) AS n FROM tb, range(5) r(k)) WHERE n = 1) b
    WHERE lat_idx = a.k AND lon_idx = b.k GROUP BY ALL""")


@query("e13_reference_grid", cube_sql("SELECT DISTINCT lat_idx AS idx, lat_idx * 10.0 - 20 AS coordinate, 'lat' AS axis FROM cube UNION ALL SELECT DISTINCT lon_idx, lon_idx * 72.0, 'lon' FROM cube"), "coordinate")
def e13(spark, sf):
    lat, lon = spatial.reference_grid(located(cubes.cube_ship(spark, sf)))
    lat = lat.select(F.col("lat_idx").alias("idx"), F.col("lat").alias("coordinate"), F.lit("lat").alias("axis"))
    return lat.unionByName(lon.select(F.col("lon_idx").alias("idx"), F.col("lon").alias("coordinate"), F.lit("lon").alias("axis")))


_SHIFTS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]


@query("e14_surrounding", cube_sql(
    "SELECT c.pixel_id, c.time, " + ", ".join(f"n{k}.precip AS \"lat_{i}_lon_{j}_precip\"" for k, (i, j) in enumerate(_SHIFTS)) + " FROM dense c "
    + " ".join(f"JOIN dense n{k} ON n{k}.time = c.time AND n{k}.lat_idx = c.lat_idx - {i} AND n{k}.lon_idx = c.lon_idx - {j} AND n{k}.precip IS NOT NULL".replace("- -", "+ ") for k, (i, j) in enumerate(_SHIFTS))),
    " ".join(f'"lat_{i}_lon_{j}_precip"' for i, j in _SHIFTS))
def e14(spark, sf):
    return joins.surrounding(dense(spark, sf), "precip").drop("lat_idx", "lon_idx", "precip", "price", "vci")


@query("e15_crosstab", f"""WITH {COVER}, a AS (SELECT pixel_id, year, min(code) AS lo, max(code) AS hi FROM cover WHERE pixel_id % 3 != year % 3 GROUP BY 1, 2), b AS (SELECT pixel_id, year, CAST(count(*) % 4 AS INTEGER) AS k FROM cover GROUP BY 1, 2)
    SELECT lo, k, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY lo) AS percent FROM a JOIN b USING (pixel_id, year) GROUP BY 1, 2""", "percent")
def e15(spark, sf):
    cover = cubes.land_cover(spark, sf)
    a = cover.filter("pixel_id % 3 != year % 3").groupBy("pixel_id", "year").agg(F.min("code").alias("lo"))
    b = cover.groupBy("pixel_id", "year").agg((F.count("*") % 4).cast("int").alias("k"))
    return joins.crosstab(a, b, "lo", "k", ("pixel_id", "year"))


@query("e16_full_product", "WITH s AS (SELECT o_orderstatus, o_orderpriority, sum(o_totalprice) AS total FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority LIKE '%LOW') GROUP BY 1, 2) SELECT a.o_orderstatus, b.o_orderpriority, total FROM (SELECT DISTINCT o_orderstatus FROM s) a CROSS JOIN (SELECT DISTINCT o_orderpriority FROM s) b LEFT JOIN s USING (o_orderstatus, o_orderpriority)", "total")
def e16(spark, sf):
    rows = cubes.table(spark, sf, "orders").filter("not (o_orderstatus = 'P' and o_orderpriority like '%LOW')")
    scores = rows.groupBy("o_orderstatus", "o_orderpriority").agg(F.sum("o_totalprice").alias("total"))
    return joins.full_product(scores, ["o_orderstatus", "o_orderpriority"], ["total"])


# windows


@query("w01_rolling_sum", cube_sql("SELECT pixel_id, time, x AS precip_cumsum FROM cs"), "precip_cumsum")
def w01(spark, sf):
    return windows.rolling_sum(dense(spark, sf), "precip", keys=KEY).select("pixel_id", "time", "precip_cumsum")


@query("w02_rolling_mean", cube_sql("SELECT pixel_id, time, x / 3 AS precip_mean FROM cs"), "precip_mean")
def w02(spark, sf):
    return windows.rolling_mean(dense(spark, sf), "precip", keys=KEY).select("pixel_id", "time", "precip_mean")


@query("w03_rolling_median", cube_sql("SELECT pixel_id, time, CASE WHEN count(m) OVER v = 3 THEN median(m) OVER v END AS precip_median FROM (SELECT *, CASE WHEN count(precip) OVER w = 3 THEN median(precip) OVER w END AS m FROM dense WINDOW w AS (PARTITION BY lon_idx, time ORDER BY lat_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WINDOW v AS (PARTITION BY lat_idx, time ORDER BY lon_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"), "precip_median")
def w03(spark, sf):
    return windows.rolling_spatial_median(dense(spark, sf), "precip").select("pixel_id", "time", "precip_median")


@query("w04_lags", cube_sql("SELECT pixel_id, time, lag(precip, 1) OVER w AS precip_t1, lag(precip, 2) OVER w AS precip_t2, lag(precip, 3) OVER w AS precip_t3 FROM dense WINDOW w AS (PARTITION BY pixel_id ORDER BY time)"), "precip_t1 precip_t2 precip_t3")
def w04(spark, sf):
    return windows.lag_features(dense(spark, sf), ["precip"], keys=KEY).select("pixel_id", "time", "precip_t1", "precip_t2", "precip_t3")


@query("w05_average_rank", cube_sql("SELECT pixel_id, time, rk AS rank, n FROM ranked", RANKED), "rank")
def w05(spark, sf):
    rows = windows.rolling_sum(dense(spark, sf), "precip", keys=KEY)
    rank, n = windows.average_rank("precip_cumsum", windows.month_groups(KEY))
    return rows.select("pixel_id", "time", rank.alias("rank"), n.alias("n"))


@query("w06_apply_by_group", cube_sql(f"SELECT pixel_id, time, precip - max(precip) OVER ({MONTH}) AS below_peak FROM dense"), "below_peak")
def w06(spark, sf):
    def below_peak(group):
        return group.assign(below_peak=group.precip - group.precip.max())[["pixel_id", "time", "below_peak"]]

    rows = dense(spark, sf).select("pixel_id", "time", "precip")
    found = windows.apply_by_group(rows, below_peak, "pixel_id int, time date, below_peak double", keys=KEY)
    return found.withColumn("below_peak", F.when(~F.isnan("below_peak"), F.col("below_peak")))


RUNS = """flagged AS (SELECT *, coalesce(vci > 49, false) AS flag FROM dense),
    islands AS (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY time) - row_number() OVER (PARTITION BY pixel_id, flag ORDER BY time) AS island FROM flagged),
    runs AS (SELECT *, CASE WHEN flag THEN row_number() OVER (PARTITION BY pixel_id, flag, island ORDER BY time) ELSE 0 END AS pos, count(*) OVER (PARTITION BY pixel_id, flag, island) AS size FROM islands)"""


@query("w07_runs", cube_sql("SELECT pixel_id, time, CAST(CASE WHEN pos = 1 THEN size ELSE 0 END AS INTEGER) AS run_length, CAST(pos AS INTEGER) AS run_position FROM runs", RUNS))
def w07(spark, sf):
    rows = dense(spark, sf).withColumn("flag", F.col("vci") > 49)
    return windows.runs(rows, "flag", KEY).select("pixel_id", "time", "run_length", "run_position")


@query("w08_longest_run", cube_sql("SELECT pixel_id, CAST(max(CASE WHEN pos = 1 THEN size ELSE 0 END) AS INTEGER) AS longest_run FROM runs GROUP BY 1", RUNS))
def w08(spark, sf):
    return windows.longest_run(dense(spark, sf).withColumn("flag", F.col("vci") > 49), "flag", KEY)


@query("w09_annual_cumulative", cube_sql("SELECT pixel_id, time, c AS cumulative, n AS normal, 100 * c / nullif(n, 0) AS percent FROM (SELECT *, avg(c) OVER (PARTITION BY pixel_id, month(time)) AS n FROM (SELECT *, sum(precip) OVER (PARTITION BY pixel_id, year(time) ORDER BY time) AS c FROM dense))"), "cumulative normal percent")
def w09(spark, sf):
    return windows.annual_cumulative(dense(spark, sf), "precip", KEY).select("pixel_id", "time", "cumulative", "normal", "percent")


@query("w10_rolling_24", cube_sql("SELECT time, avg(v) OVER w AS v_mean FROM (SELECT time, avg(precip) AS v FROM dense GROUP BY 1) WINDOW w AS (ORDER BY time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) QUALIFY count(v) OVER w = 24"), "v_mean")
def w10(spark, sf):
    series = agg.spatial_mean(dense(spark, sf), "precip").select("time", F.col("spatial_mean_precip").alias("v"), F.lit(0).alias("station"))
    return windows.rolling_mean(series, "v", 24, keys=("station",)).select("time", "v_mean")


@query("w11_previous_year", cube_sql("SELECT a.pixel_id, a.time, CASE WHEN b.pixel_id IS NULL THEN 0 ELSE b.precip END AS prev_year FROM dense a LEFT JOIN dense b ON b.pixel_id = a.pixel_id AND year(b.time) = year(a.time) - 1 AND month(b.time) = month(a.time)"), "prev_year")
def w11(spark, sf):
    return windows.previous_year(dense(spark, sf), "precip", keys=KEY).select("pixel_id", "time", "prev_year")


@query("w12_empirical_cdf", cube_sql("SELECT pixel_id, precip, (row_number() OVER (PARTITION BY pixel_id ORDER BY precip) - 1) / nullif(count(*) OVER (PARTITION BY pixel_id) - 1, 0) AS cdf FROM cube"), "precip cdf")
def w12(spark, sf):
    return windows.empirical_cdf(dense(spark, sf), "precip", ["pixel_id"]).select("pixel_id", "precip", "cdf")


@query("w13_terciles", cube_sql("SELECT year, m AS median, CASE ntile(3) OVER (ORDER BY m, year) WHEN 1 THEN 'low' WHEN 2 THEN 'med' ELSE 'high' END AS tercile FROM (SELECT CAST(year AS INTEGER) AS year, median(m) AS m FROM (SELECT pixel_id, year(time) AS year, median(vci) AS m FROM dense GROUP BY 1, 2) GROUP BY 1)"), "median")
def w13(spark, sf):
    return windows.terciles(agg.yearly_medians(dense(spark, sf), "vci", KEY), "median", order=["year"])


@query("w14_seasonal_windows", cube_sql("""
    SELECT pixel_id, CAST(s AS INTEGER) AS start_month, count(*) AS n, 1 - sum((t - p) ** 2) / nullif(sum(t * t) - sum(t) * sum(t) / count(*), 0) AS r2, corr(t, p) ** 2 AS corr2 FROM (
        SELECT pixel_id, s, year(time) AS y, avg(precip) AS t, avg(x / 3) AS p FROM roll, range(1, 11) r(s) WHERE month(time) >= s AND month(time) < s + 3 GROUP BY 1, 2, 3) WHERE t IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2"""), "r2 corr2")
def w14(spark, sf):
    rows = windows.rolling_mean(dense(spark, sf), "precip", out="preds", keys=KEY, trim=False)
    return windows.seasonal_windows(rows, "precip", "preds", ["pixel_id"])


# top-k and sets


@query("k01_sorted_metric", cube_sql("SELECT pixel_id, avg(precip) AS precip_pixel_mean FROM dense GROUP BY 1 ORDER BY 2"), "precip_pixel_mean")
def k01(spark, sf):
    return agg.temporal_mean(dense(spark, sf), "precip", KEY).orderBy("precip_pixel_mean")


@query("k02_top_n", cube_sql("SELECT pixel_id, time, precip, k FROM (SELECT pixel_id, time, precip, 'top' AS k, row_number() OVER (ORDER BY precip DESC, pixel_id, time) AS n FROM cube UNION ALL SELECT pixel_id, time, precip, 'bottom', row_number() OVER (PARTITION BY pixel_id ORDER BY precip, time) FROM cube) WHERE (k = 'top' AND n <= 20) OR (k = 'bottom' AND n <= 3)"), "precip")
def k02(spark, sf):
    rows = dense(spark, sf).select("pixel_id", "time", "precip")
    top = agg.top_n(rows, "precip", 20, ties=["pixel_id", "time"]).withColumn("k", F.lit("top"))
    return top.unionByName(agg.top_n(rows, "precip", 3, False, ["pixel_id"], ["time"]).withColumn("k", F.lit("bottom")))


@query("k03_flag_extremes", cube_sql("SELECT pixel_id, year, v, row_number() OVER (PARTITION BY pixel_id ORDER BY v DESC, year) <= 2 AS top_2, row_number() OVER (PARTITION BY pixel_id ORDER BY v, year) <= 2 AS bottom_2 FROM (SELECT pixel_id, CAST(year(time) AS INTEGER) AS year, sum(precip) AS v FROM dense GROUP BY 1, 2)"), "v")
def k03(spark, sf):
    years = dense(spark, sf).groupBy("pixel_id", F.year("time").alias("year")).agg(F.sum("precip").alias("v"))
    return agg.flag_extremes(years, "v", (2,), ["pixel_id"], ["year"])


@query("k04_concat", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT s_name FROM supplier")
def k04(spark, sf):
    names = [("nation", "n_name"), ("region", "r_name"), ("supplier", "s_name")]
    return agg.concat([cubes.table(spark, sf, t).select(F.col(c).alias("name")) for t, c in names])


@query("k05_compare_keys", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS place FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 3 != 0) b ON a.k = b.k")
def k05(spark, sf):
    a = cubes.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return agg.compare_keys(a, cubes.table(spark, sf, "customer").filter("c_custkey % 3 != 0").select(F.col("c_custkey").alias("k")), ["k"])


# indices


@query("i01_z_score", cube_sql(f"SELECT pixel_id, time, (x - median(x) OVER m) / nullif(stddev_pop(x) OVER m, 0) AS ZSI FROM cs WINDOW m AS ({MONTH})"), "ZSI")
def i01(spark, sf):
    return indices.z_score(dense(spark, sf), "precip", keys=KEY).select("pixel_id", "time", "ZSI")


@query("i02_percent_normal", cube_sql(f"SELECT pixel_id, time, 100 * x / nullif(avg(x) OVER ({MONTH}), 0) AS PNI FROM cs"), "PNI")
def i02(spark, sf):
    return indices.percent_normal(dense(spark, sf), "precip", keys=KEY).select("pixel_id", "time", "PNI")


@query("i03_drought_severity", cube_sql("SELECT pixel_id, time, 8 * ((rk - 1) / nullif(n - 1, 0) - 0.5) AS DSI FROM ranked", RANKED), "DSI")
def i03(spark, sf):
    return indices.drought_severity(dense(spark, sf), "precip", keys=KEY).select("pixel_id", "time", "DSI")


def _czi_sql(name: str, centre: str) -> str:
    return cube_sql(
        f"SELECT pixel_id, time, 6 / nullif(c, 0) * sign(c / 2 * z + 1) * abs(c / 2 * z + 1) ** (1.0 / 3.0) - 6 / nullif(c, 0) + c / 6 AS {name} FROM (SELECT *, z * z * z / n AS c FROM z)",
        f"z AS (SELECT *, (x - {centre}(x) OVER m) / nullif(stddev_pop(x) OVER m, 0) AS z, count(*) OVER m AS n FROM cs WINDOW m AS ({MONTH}))",
    )


@query("i04_china_z", _czi_sql("CZI", "avg"), "CZI")
def i04(spark, sf):
    return indices.china_z(dense(spark, sf), "precip", keys=KEY).select("pixel_id", "time", "CZI")


@query("i05_modified_china_z", _czi_sql("MCZI", "median"), "MCZI")
def i05(spark, sf):
    return indices.china_z(dense(spark, sf), "precip", modified=True, keys=KEY).select("pixel_id", "time", "MCZI")


def _digitize(v: str, edges) -> str:
    return f"CASE WHEN {v} IS NOT NULL THEN CAST(" + " + ".join(f"CAST({v} >= {e} AS INTEGER)" for e in edges) + " AS INTEGER) END"


@query("i06_decile", cube_sql(f"SELECT pixel_id, time, rn AS rank_norm, {_digitize('x', (0, 20, 40, 60, 80))} AS quintile, {_digitize('rn', (0, 20, 40, 60, 80))} AS by_rank FROM (SELECT *, 100 * (rk - 1) / nullif(n - 1, 0) AS rn FROM ranked)", RANKED), "rank_norm")
def i06(spark, sf):
    rows = dense(spark, sf)
    by_rank = indices.decile(rows, "precip", on="rank_norm", keys=KEY).select("pixel_id", "time", F.col("quintile").alias("by_rank"))
    return indices.decile(rows, "precip", keys=KEY).select("pixel_id", "time", "rank_norm", "quintile").join(by_rank, ["pixel_id", "time"])


@query("i07_rainfall_anomaly", cube_sql("""
    SELECT pixel_id, time, CASE WHEN x IS NULL THEN NULL WHEN x - a >= 0 THEN 3 * (x - a) / nullif(hi - a, 0) ELSE -3 * (x - a) / nullif(lo - a, 0) END AS RAI FROM (
        SELECT *, avg(CASE WHEN k <= 3 THEN x END) OVER m AS hi, avg(CASE WHEN k >= n - 3 AND k < n THEN x END) OVER m AS lo FROM r WINDOW m AS (PARTITION BY pixel_id, month(time)))""",
    f"r AS (SELECT *, avg(x) OVER ({MONTH}) AS a, count(*) OVER ({MONTH}) AS n, row_number() OVER ({MONTH} ORDER BY time DESC) AS k FROM cs)"), "RAI")
def i07(spark, sf):
    return indices.rainfall_anomaly(dense(spark, sf), "precip", extremes=3, keys=KEY).select("pixel_id", "time", "RAI")


@query("i07_rainfall_anomaly_by_value", cube_sql("""
    SELECT pixel_id, time, CASE WHEN x IS NULL THEN NULL WHEN x - a >= 0 THEN 3 * (x - a) / nullif(hi - a, 0) ELSE -3 * (x - a) / nullif(lo - a, 0) END AS RAI FROM (
        SELECT *, avg(CASE WHEN k <= 3 THEN x END) OVER m AS hi, avg(CASE WHEN k > n - 3 AND k <= n THEN x END) OVER m AS lo FROM r WINDOW m AS (PARTITION BY pixel_id, month(time)))""",
    f"r AS (SELECT *, avg(x) OVER ({MONTH}) AS a, count(x) OVER ({MONTH}) AS n, row_number() OVER ({MONTH} ORDER BY x DESC NULLS LAST) AS k FROM cs)"), "RAI")
def i07_value(spark, sf):
    return indices.rainfall_anomaly(dense(spark, sf), "precip", order="value", extremes=3, keys=KEY).select("pixel_id", "time", "RAI")


@query("i09_condition_index", cube_sql("""SELECT pixel_id, time, vci_ci FROM (SELECT *, CASE WHEN count(c) OVER w = 3 THEN avg(c) OVER w END AS vci_ci FROM c WINDOW w AS (PARTITION BY pixel_id ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
    WHERE time IN (SELECT time FROM (SELECT time, count(c) OVER w AS k FROM c WINDOW w AS (PARTITION BY pixel_id ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE k = 3)""",
    f"c AS (SELECT *, 100 * (vci - min(vci) OVER m) / nullif(max(vci) OVER m - min(vci) OVER m, 0) AS c FROM dense WINDOW m AS ({MONTH}))"), "vci_ci")
def i09(spark, sf):
    return indices.condition_index(dense(spark, sf), "vci", keys=KEY).select("pixel_id", "time", "vci_ci")


@query("i10_moving_average", cube_sql("SELECT pixel_id, time, x / 3 AS precip_3month_moving_average FROM cs"), "precip_3month_moving_average")
def i10(spark, sf):
    return indices.moving_average(dense(spark, sf), "precip", keys=KEY).select("pixel_id", "time", "precip_3month_moving_average")


@query("i11_vegetation_deficit", cube_sql(f"SELECT pixel_id, time, {_digitize('v', (0, 10, 20, 35, 50))} AS VDI FROM (SELECT *, CASE WHEN count(vci) OVER w = 3 THEN avg(vci) OVER w END AS v FROM dense WINDOW w AS (PARTITION BY pixel_id ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE time IN (SELECT time FROM cs)"))
def i11(spark, sf):
    return indices.vegetation_deficit(dense(spark, sf), "vci", keys=KEY).select("pixel_id", "time", "VDI")


@query("i12_all_indices", cube_sql(f"""
    SELECT pixel_id, time, (x - median(x) OVER m) / nullif(stddev_pop(x) OVER m, 0) AS ZSI, 100 * x / nullif(avg(x) OVER m, 0) AS PNI, 8 * ((rk - 1) / nullif(n - 1, 0) - 0.5) AS DSI,
           100 * (rk - 1) / nullif(n - 1, 0) AS rank_norm, {_digitize('x', (0, 20, 40, 60, 80))} AS quintile
    FROM ranked WINDOW m AS ({MONTH}) QUALIFY time IN (SELECT time FROM (SELECT time, row_number() OVER (ORDER BY time) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT time FROM cs)) WHERE k > 2 AND k < n)""", RANKED), "ZSI PNI DSI rank_norm")
def i12(spark, sf):
    return indices.all_indices(dense(spark, sf), "precip", keys=KEY).select("pixel_id", "time", "ZSI", "PNI", "DSI", "rank_norm", "quintile")


QUARTERS = """quarters AS (SELECT pixel_id, last_day(make_date(year(time), quarter(time) * 3, 1)) AS time, avg(precip) AS precip FROM dense GROUP BY 1, 2),
    named AS (SELECT *, CASE quarter(time) WHEN 1 THEN 'MAM' WHEN 2 THEN 'JJA' WHEN 3 THEN 'SON' ELSE 'DJF' END AS season FROM quarters)"""


@query("i14_seasonal_anomaly", cube_sql("SELECT pixel_id, time, precip, season, avg(precip) OVER s AS climatology, precip - avg(precip) OVER s AS anomaly FROM named WINDOW s AS (PARTITION BY pixel_id, season)", QUARTERS), "precip climatology anomaly")
def i14(spark, sf):
    return indices.seasonal_anomaly(dense(spark, sf), "precip", keys=KEY)


@query("i14_seasonal_anomaly_series", cube_sql("SELECT time, precip, season, avg(precip) OVER s AS climatology, precip - avg(precip) OVER s AS anomaly FROM (SELECT last_day(make_date(year(time), quarter(time) * 3, 1)) AS time, CASE quarter(time) WHEN 1 THEN 'MAM' WHEN 2 THEN 'JJA' WHEN 3 THEN 'SON' ELSE 'DJF' END AS season, avg(precip) AS precip FROM dense GROUP BY 1, 2) WINDOW s AS (PARTITION BY season)"), "precip climatology anomaly")
def i14_series(spark, sf):
    return indices.seasonal_anomaly(dense(spark, sf), "precip", by_pixel=False)


@query("i15_calendar_anomaly", cube_sql(f"SELECT pixel_id, time, precip - avg(precip) OVER ({MONTH}) AS anomaly FROM dense"), "anomaly")
def i15(spark, sf):
    return indices.calendar_anomaly(dense(spark, sf), "precip", keys=KEY).select("pixel_id", "time", "anomaly")


def _normal_sql(p: str) -> str:
    """The inverse normal distribution as SQL, from the same fixed values."""
    power = lambda c, r: reduce(lambda a, b: f"({a} * ({r}) + {b!r})", c[1:], repr(c[0]))
    q, near, far = f"({p} - 0.5)", f"0.180625 - ({p} - 0.5) ** 2", f"sqrt(-ln(least({p}, 1 - {p}))) - 1.6"
    tail = f"{power(indices._TAIL[0], far)} / {power(indices._TAIL[1], far)}"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {power(indices._CENTRE[0], near)} / {power(indices._CENTRE[1], near)} WHEN {q} < 0 THEN -({tail}) ELSE {tail} END"


def _spi_sql(n: int, name: str, distribution: str = "gamma") -> str:
    """``name``: pixel_id, time and SPI of the sums of n months. The gamma distribution function is summed term by term from logarithms."""
    fit = {
        "gamma": f"""SELECT *, coalesce(zeros / nullif(filled, 0), 0) AS p0, (1 + sqrt(1 + 4 * a / 3)) / nullif(4 * a, 0) AS shape, mean / ((1 + sqrt(1 + 4 * a / 3)) / nullif(4 * a, 0)) AS size, 0.0 AS loc FROM (
            SELECT *, ln(mean) - logs AS a FROM (SELECT pixel_id, time, x, count(*) FILTER (x <= 0) OVER g AS zeros, count(x) OVER g AS filled, avg(x) FILTER (x > 0) OVER g AS mean, avg(ln(nullif(greatest(x, 0), 0))) FILTER (x > 0) OVER g AS logs
                FROM {name}_x WINDOW g AS (PARTITION BY pixel_id, month(time))))""",
        "pearson": f"""SELECT *, 0.0 AS p0, 4 / nullif(skew * skew, 0) AS shape, std * skew / 2 AS size, mean - 4 / nullif(skew * skew, 0) * std * skew / 2 AS loc FROM (
            SELECT *, (SELECT 1) AS one, (m3 - 3 * mean * m2 + 2 * mean ** 3) / nullif(std ** 3, 0) AS skew FROM (SELECT pixel_id, time, x, avg(x) OVER g AS mean, stddev_pop(x) OVER g AS std, avg(x * x) OVER g AS m2, avg(x * x * x) OVER g AS m3
                FROM {name}_x WINDOW g AS (PARTITION BY pixel_id, month(time))))""",
    }[distribution]
    square = reduce(lambda a, b: f"({b} - d * {a})", [f"2.0 / {k}" for k in range(11, 1, -1)], "2.0 / 12")
    return f"""{name}_x AS (SELECT pixel_id, time, CASE WHEN count(precip) OVER w = {n} THEN sum(precip) OVER w END AS x FROM dense WINDOW w AS (PARTITION BY pixel_id ORDER BY time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)),
    {name}_fit AS ({fit}),
    {name}_y AS (SELECT *, greatest((x - loc) / size, 0) AS y FROM {name}_fit WHERE x IS NOT NULL AND shape > 0 AND size <> 0),
    {name}_cdf AS (SELECT *, y / shape - 1 AS d, CASE WHEN y <= 0 OR (shape > 10000 AND p0 = 0) THEN 0 ELSE least(1, list_sum([exp(-y + (shape + k) * ln(y) - lgamma(shape + k + 1)) for k in range(CAST(80 + greatest(y - shape, 0) + 14 * sqrt(greatest(y, shape)) AS BIGINT))])) END AS c FROM {name}_y),
    {name}_p AS (SELECT *, least(greatest(p0 + (1 - p0) * CASE WHEN x <= 0 AND loc = 0 THEN 0 WHEN size < 0 THEN 1 - c ELSE c END, 1e-10), 1 - 1e-10) AS p FROM {name}_cdf),
    {name}_s AS (SELECT *, {square} AS square FROM {name}_p),
    {name}_z AS (SELECT pixel_id, time, CASE WHEN NOT (shape > 10000 AND p0 = 0) THEN {_normal_sql("p")}
        ELSE sign(size) * (d * sqrt(square * shape) + CASE WHEN abs(d) < 1e-8 THEN 1 / (3 * sqrt(shape)) ELSE -ln(square) / (2 * d * sqrt(square * shape)) END) END AS z FROM {name}_s),
    {name} AS (SELECT f.pixel_id, f.time, CASE WHEN z IS NOT NULL THEN least(greatest(z, -3.09), 3.09) END AS "SPI" FROM {name}_fit f LEFT JOIN {name}_z p ON p.pixel_id = f.pixel_id AND p.time = f.time)"""


@query("i08_spi", cube_sql("SELECT * FROM spi3", _spi_sql(3, "spi3")), '"SPI"')
def i08(spark, sf):
    return indices.spi(dense(spark, sf), "precip", 3, keys=KEY).select("pixel_id", "time", "SPI")


@query("i08_spi_pearson", cube_sql("SELECT * FROM spi3", _spi_sql(3, "spi3", "pearson")), '"SPI"')
def i08_pearson(spark, sf):
    return indices.spi(dense(spark, sf), "precip", 3, "pearson", keys=KEY).select("pixel_id", "time", "SPI")


_DISTRICT = [f"{v}{n}{m}" for v, m in (("VCI", "M"), ("RCI", "M"), ("RFE", "M"), ("SPI", "")) for n in (1, 3)]
_DISTRICT_SQL = _spi_sql(1, "spi1") + ", " + _spi_sql(3, "spi3") + """,
    ci AS (SELECT *, 100 * (vci - min(vci) OVER g) / nullif(max(vci) OVER g - min(vci) OVER g, 0) AS v, 100 * (precip - min(precip) OVER g) / nullif(max(precip) OVER g - min(precip) OVER g, 0) AS r FROM dense WINDOW g AS (PARTITION BY pixel_id, month(time))),
    wide AS (SELECT c.pixel_id, c.time, v AS "VCI1M", r AS "RCI1M", precip AS "RFE1M", s1."SPI" AS "SPI1", s3."SPI" AS "SPI3",
        CASE WHEN count(v) OVER w = 3 THEN avg(v) OVER w END AS "VCI3M", CASE WHEN count(r) OVER w = 3 THEN avg(r) OVER w END AS "RCI3M", CASE WHEN count(precip) OVER w = 3 THEN avg(precip) OVER w END AS "RFE3M"
        FROM ci c JOIN spi1 s1 ON s1.pixel_id = c.pixel_id AND s1.time = c.time JOIN spi3 s3 ON s3.pixel_id = c.pixel_id AND s3.time = c.time WINDOW w AS (PARTITION BY c.pixel_id ORDER BY c.time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
    """ + "district AS (SELECT r_regionkey AS region_id, time, " + ", ".join(f'avg("{v}") AS "{v}"' for v in _DISTRICT) + " FROM wide JOIN region ON r_regionkey = pixel_id % 5 GROUP BY 1, 2)"


@query("i13_district_features", cube_sql("SELECT *, " + ", ".join(f'lag("{v}", {k}) OVER w AS "{v}_t{k}"' for v in _DISTRICT for k in (1, 2, 3)) + " FROM district WINDOW w AS (PARTITION BY region_id ORDER BY time)", _DISTRICT_SQL),
       " ".join(f'"{v}{t}"' for v in _DISTRICT for t in ("", "_t1", "_t2", "_t3")))
def i13(spark, sf):
    cells = cubes.ship_regions(spark, sf).select("pixel_id", "region_id")
    return indices.district_features(dense(spark, sf), cells, "vci", "precip")


# events


@query("v01_thresholds", cube_sql("SELECT pixel_id, CAST(month(time) AS INTEGER) AS month, quantile_cont(precip, 0.9) AS q90, quantile_cont(precip, 0.1) AS q10, avg(precip) + 1.5 * stddev_pop(precip) AS above, avg(precip) - 1.5 * stddev_pop(precip) AS below, 42.0 AS absolute FROM dense GROUP BY 1, 2"), "q90 q10 above below absolute")
def v01(spark, sf):
    rows, found = dense(spark, sf), None
    for name, options in {"q90": ("q90",), "q10": ("q10", False), "above": ("std", True, 1.5), "below": ("std", False, 1.5), "absolute": ("abs", True, 42.0)}.items():
        part = events.thresholds(rows, "precip", *options, keys=KEY).withColumnsRenamed({"group_key": "month", "threshold": name})
        found = part if found is None else found.join(part, ["pixel_id", "month"])
    return found


EVENTS = f"found AS (SELECT *, precip < quantile_cont(precip, 0.1) OVER ({MONTH}) AS e FROM dense)"
EVENT_RUNS = f"""{EVENTS}, flagged AS (SELECT *, coalesce(e, false) AS flag FROM found),
    islands AS (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY time) - row_number() OVER (PARTITION BY pixel_id, flag ORDER BY time) AS island FROM flagged),
    runs AS (SELECT *, CASE WHEN flag THEN row_number() OVER (PARTITION BY pixel_id, flag, island ORDER BY time) ELSE 0 END AS pos, count(*) OVER (PARTITION BY pixel_id, flag, island) AS size FROM islands),
    masked AS (SELECT * FROM runs WHERE pixel_id IN (SELECT pixel_id FROM dense GROUP BY 1 HAVING NOT arg_min(precip IS NULL, time)))"""


def low_events(spark, sf):
    return events.detect(dense(spark, sf), "precip", "q10", False, keys=KEY)


@query("v02_detect", cube_sql("SELECT pixel_id, time, coalesce(e, false) AS event FROM found", EVENTS))
def v02(spark, sf):
    return low_events(spark, sf).select("pixel_id", "time", "event")


@query("v02_detect_std", cube_sql("SELECT pixel_id, time, coalesce(vci > avg(vci) OVER s + stddev_pop(vci) OVER s, false) AS event FROM dense WINDOW s AS (PARTITION BY pixel_id, quarter(time + INTERVAL 1 MONTH))".replace("quarter(time + INTERVAL 1 MONTH)", SEASON)))
def v02_std(spark, sf):
    return events.detect(dense(spark, sf), "vci", "std", period="season", keys=KEY).select("pixel_id", "time", "event")


@query("v03_event_runs", cube_sql("SELECT pixel_id, time, CAST(CASE WHEN m THEN NULL WHEN pos = 1 THEN size ELSE 0 END AS INTEGER) AS run_length, CAST(CASE WHEN NOT m THEN pos END AS INTEGER) AS run_position FROM runs JOIN (SELECT pixel_id, arg_min(precip IS NULL, time) AS m FROM dense GROUP BY 1) USING (pixel_id)", EVENT_RUNS))
def v03(spark, sf):
    return events.event_runs(low_events(spark, sf), "precip", keys=KEY).select("pixel_id", "time", "run_length", "run_position")


@query("v04_longest", cube_sql("SELECT pixel_id, CAST(max(CASE WHEN m THEN NULL WHEN pos = 1 THEN size ELSE 0 END) AS INTEGER) AS longest_run FROM runs JOIN (SELECT pixel_id, arg_min(precip IS NULL, time) AS m FROM dense GROUP BY 1) USING (pixel_id) GROUP BY 1", EVENT_RUNS))
def v04(spark, sf):
    return events.longest(low_events(spark, sf), "precip", keys=KEY)


@query("v05_events_by_time", cube_sql("SELECT time, count(*) FILTER (e) AS n_events FROM found GROUP BY 1", EVENTS))
def v05(spark, sf):
    return events.events_by_time(low_events(spark, sf))


@query("v05_run_statistics", cube_sql("SELECT p.pixel_id, CAST(max(size) AS INTEGER) AS max_run, quantile_cont(CAST(size AS DOUBLE), 0.9) AS q90_run FROM (SELECT DISTINCT pixel_id FROM dense) p LEFT JOIN (SELECT * FROM masked WHERE pos = 1) m ON m.pixel_id = p.pixel_id GROUP BY 1", EVENT_RUNS), "q90_run")
def v05_runs(spark, sf):
    return events.run_statistics(low_events(spark, sf), "precip", keys=KEY)


@query("v05_seasonal_runs", cube_sql(f"SELECT {SEASON} AS season, avg(size) AS mean_run FROM masked WHERE pos = 1 GROUP BY 1", EVENT_RUNS), "mean_run")
def v05_season(spark, sf):
    return events.seasonal_runs(low_events(spark, sf), "precip", keys=KEY)
