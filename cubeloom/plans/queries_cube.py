"""Queries over cubes: shaping (a), masks (b), calendar (c)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import text
from ..operators import aggregates as agg
from ..operators import masks, models
from ..sources import cubes
from ..sources.folders import scratch_folder
from .registry import cube_sql, query

KEY = ("pixel_id",)


@query("a01_read_layers", "SELECT * FROM part UNION ALL BY NAME SELECT * FROM supplier", "p_retailprice s_acctbal")
def a01(spark, sf):
    return cubes.read_layers(spark, [f"{sf}/part.parquet", f"{sf}/supplier.parquet"])


@query("a02_preprocessed_layers", cube_sql("SELECT lat_idx, lon_idx, time, precip, vci FROM cube"), "precip vci")
def a02(spark, sf):
    """Two layers in folders named for it, and a folder that isn't one."""
    folder, cube = scratch_folder(spark), cubes.cube_ship(spark, sf)
    for name, value in (("rain_preprocessed", "precip"), ("plants_preprocessed", "vci"), ("scratch", "price")):
        cube.select("lat_idx", "lon_idx", "time", value).write.parquet(f"{folder}/{name}")
    layers = cubes.read_preprocessed(spark, folder)
    return cubes.merge_layers([layers["rain"], layers["plants"]])


@query("a13_written_table", cube_sql("SELECT pixel_id, time, precip, vci FROM cube"), "precip vci")
def a13(spark, sf):
    """Written as CSV, and read again."""
    folder = scratch_folder(spark)
    cubes.save_table(cubes.cube_ship(spark, sf).select("pixel_id", "time", "precip", "vci"), f"{folder}/scores", "csv")
    return spark.read.option("header", True).schema("pixel_id int, time date, precip double, vci double").csv(f"{folder}/scores")


@query("a03_merge_layers", cube_sql("SELECT a.pixel_id, a.time, a.precip, b.vci FROM cube a JOIN cube b USING (pixel_id, time) WHERE a.price < 50000 AND b.vci < 60"), "precip vci")
def a03(spark, sf):
    """Whole layers are on one grid; a cell in which no month passes the limits has no rows, but isn't missing from it. Rows without a supplier are in no cell."""
    cube = cubes.cube_ship(spark, sf).filter("pixel_id IS NOT NULL")
    one, two = cube.select("pixel_id", "time", "precip", "price"), cube.select("pixel_id", "time", "vci")
    return cubes.merge_layers([one, two], KEY).filter("price < 50000 AND vci < 60").drop("price")


@query("a03_grid_mismatch", cube_sql("SELECT DISTINCT pixel_id, CAST(1 AS INTEGER) AS side FROM cube WHERE pixel_id % 7 = 0"))
def a03_grid(spark, sf):
    cube = cubes.cube_ship(spark, sf)
    return cubes.grid_mismatch(cube, cube.filter("pixel_id % 7 != 0"), KEY)


@query("a05_first_by_time", """
    SELECT CAST(p AS INTEGER) AS pixel_id, time, l_orderkey, l_linenumber, l_quantity FROM (
        SELECT *, l_suppkey % 25 AS p, last_day(l_shipdate) AS time, row_number() OVER (PARTITION BY l_suppkey % 25, last_day(l_shipdate)
            ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity, l_partkey) AS n FROM lineitem) WHERE n = 1""", "l_quantity")  # fmt: skip
def a05(spark, sf):
    rows = cubes.table(spark, sf, "lineitem").withColumns({"pixel_id": (F.col("l_suppkey") % 25).cast("int"), "time": F.last_day("l_shipdate")})
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    return cubes.first_by_time(rows, order, KEY).select("pixel_id", "time", "l_orderkey", "l_linenumber", "l_quantity")


@query("a06_predictions", cube_sql(
    "SELECT pixel_id, time, preds, 'climatology' AS model FROM c UNION ALL SELECT pixel_id, time, lag(precip) OVER (PARTITION BY pixel_id ORDER BY time), 'persistence' FROM dense",
    "c AS (SELECT pixel_id, time, avg(precip) OVER (PARTITION BY pixel_id, month(time)) AS preds FROM dense)"), "preds")
def a06(spark, sf):
    dense = cubes.dense_ship(spark, sf)
    climate = agg.climatology(dense, "precip", keys=KEY).select("pixel_id", "month", F.col("mean").alias("preds"))
    means = dense.withColumn("month", F.month("time")).join(climate, ["pixel_id", "month"]).select("pixel_id", "time", "preds")
    last = models.persistence(dense, "precip", KEY).select("pixel_id", "time", "preds")
    return cubes.predictions({"climatology": means, "persistence": last})


@query("a07_densify", cube_sql("SELECT * FROM dense"), "precip price vci")
def a07(spark, sf):
    return cubes.dense_ship(spark, sf)


@query("a08_rows_to_pixels", """
    SELECT vec_id, CAST(7 - i // 8 AS INTEGER) AS lat_idx, CAST(i % 8 AS INTEGER) AS lon_idx, -10 + (7 - i // 8) * 20.0 / 7 AS lat,
           30 + (i % 8) * 15.0 / 7 AS lon, CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, range(64) AS r(i)""", "lat lon value")  # fmt: skip
def a08(spark, sf):
    vectors = cubes.table(spark, sf, "embeddings")
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, 8))
    rows = vectors.select("vec_id", grid.cast("array<array<double>>").alias("grid"))
    return cubes.rows_to_pixels(rows, "grid", (-10.0, 10.0), (30.0, 45.0), flip=True)


@query("a09_standard_names", "SELECT CAST(s_suppkey AS DOUBLE) AS lat, s_acctbal AS lon, DATE '2000-01-31' AS time FROM supplier", "lat lon")
def a09(spark, sf):
    raw = cubes.table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("double").alias("latitude"), F.col("s_acctbal").alias("longitude"), F.lit("2000-01-31").cast("date").alias("time1"), F.lit(1).alias("crs")
    )
    return cubes.standard_names(raw, ("crs",))


@query("a10_time_of_file", """
    WITH n AS (SELECT DISTINCT year(l_shipdate) AS y, 1 + l_orderkey % 36 AS k FROM lineitem),
    m AS (SELECT *, date_trunc('year', make_date(y, 1, 1)) AS jan FROM n)
    SELECT CAST(y AS INTEGER) AS year, k, CAST(jan + to_days(CAST((8 - isodow(jan)) % 7 + 7 * (k - 1) AS INTEGER)) AS DATE) AS week,
           CASE WHEN k > 35 THEN NULL WHEN k % 3 = 2 THEN last_day(make_date(y, k // 3 + 1, 1)) ELSE make_date(y, k // 3 + 1, (k % 3 + 1) * 10) END AS dekad_0,
           CASE WHEN (k - 1) % 3 = 2 THEN last_day(make_date(y, (k - 1) // 3 + 1, 1)) ELSE make_date(y, (k - 1) // 3 + 1, ((k - 1) % 3 + 1) * 10) END AS dekad_1,
           CAST(make_date(y, 1, 1) + to_days(CAST(10 * k - 1 AS INTEGER)) AS DATE) AS day, last_day(make_date(y, (k - 1) % 12 + 1, 1)) AS month, make_date(y, 12, 31) AS annual
    FROM m""")  # fmt: skip
def a10(spark, sf):
    names = cubes.table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year"), (1 + F.col("l_orderkey") % 36).alias("k")).distinct()
    two, three = F.lpad(F.col("k").cast("string"), 2, "0"), F.lpad((F.col("k") * 10).cast("string"), 3, "0")
    name = {
        "week": F.concat(F.lit("VHP.G04.C07.NC.P"), "year", F.lit("0"), two, F.lit(".VH.nc")), "dekad": F.concat(F.lit("M.t"), "year", two, F.lit(".001.tif")),
        "day": F.concat(F.lit("M.A"), "year", three, F.lit(".nc")), "month": F.concat(F.lit("era_"), "year", F.lpad(((F.col("k") - 1) % 12 + 1).cast("string"), 2, "0"), F.lit(".nc")),
        "year": F.concat(F.lit("lc-300m-"), "year", F.lit("-v2.nc")),
    }
    dekad_0 = F.when(F.col("k") < 36, cal.time_of_file(name["dekad"], "dekad"))
    return names.select(
        "year", "k", cal.time_of_file(name["week"], "week").alias("week"), dekad_0.alias("dekad_0"), cal.time_of_file(name["dekad"], "dekad", 1).alias("dekad_1"),
        cal.time_of_file(name["day"], "day").alias("day"), cal.time_of_file(name["month"], "month").alias("month"), cal.time_of_file(name["year"], "year").alias("annual"),
    )


@query("a11_names", """
    SELECT DISTINCT 'chirps_' || year(l_shipdate) || '_kenya' AS layer, year(l_shipdate) || '_' || month(l_shipdate) || '_precip' AS partition FROM lineitem""")
def a11(spark, sf):
    rows = cubes.table(spark, sf, "lineitem")
    layer = text.layer_name(F.concat(F.lit("/raw/chirps_"), F.year("l_shipdate"), F.lit(".nc")), "kenya")
    return rows.select(layer.alias("layer"), text.partition_name(F.col("l_shipdate"), "precip").alias("partition")).distinct()


@query("a12_to_long", cube_sql("SELECT pixel_id, time, 'precip' AS variable, precip AS value FROM cube UNION ALL SELECT pixel_id, time, 'vci', vci FROM cube"), "value")
def a12(spark, sf):
    return cubes.to_long(cubes.cube_ship(spark, sf), ["precip", "vci"], KEY)


_KINDS = ["click", "error", "purchase", "signup", "view"]


@query("a12_to_cube", f"""
    SELECT CAST(user_id AS INTEGER) AS pixel_id, CAST(ts AS DATE) AS time, {', '.join(f"max(value) FILTER (event_type = '{k}') AS {k}" for k in _KINDS)}
    FROM events GROUP BY 1, 2""", " ".join(_KINDS))  # fmt: skip
def a12_cube(spark, sf):
    rows = cubes.table(spark, sf, "events")
    long = rows.groupBy(F.col("user_id").cast("int").alias("pixel_id"), F.to_date("ts").alias("time"), F.col("event_type").alias("variable")).agg(F.max("value").alias("value"))
    return cubes.to_cube(long, _KINDS, KEY)


@query("a14_region_lookup", "SELECT r_regionkey AS region_id, r_name AS region_name FROM region")
def a14(spark, sf):
    rows = cubes.table(spark, sf, "region").agg(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("r"))
    joined = lambda f: F.array_join(F.transform("r", lambda x: x[f].cast("string")), ", ")
    return cubes.region_lookup(rows.select(joined("r_regionkey").alias("keys"), joined("r_name").alias("values")))


@query("a15_clean_category", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z\\s]', '', 'g'), '\\s+', '_', 'g') AS name FROM part")
def a15(spark, sf):
    noisy = F.concat("p_name", F.lit(" (100%) "))
    return cubes.table(spark, sf, "part").select("p_partkey", text.clean_category(noisy).alias("name"))


@query("a17_missing_periods", cube_sql("SELECT pixel_id, time FROM dense WHERE precip IS NULL OR vci > 52"))
def a17(spark, sf):
    dense = cubes.dense_ship(spark, sf)
    return cubes.missing_periods(dense.select("pixel_id", "time"), dense.filter("precip is not null and not vci > 52"), ["pixel_id", "time"])


# masks


def located(cube):
    """Coordinates of the cells: ten degrees apart."""
    return cube.withColumns({"lat": F.col("lat_idx") * 10.0 - 20, "lon": F.col("lon_idx") * 72.0})


@query("b01_bounding_box", cube_sql("SELECT pixel_id, time, precip FROM cube WHERE lat_idx BETWEEN 1 AND 3 AND lon_idx BETWEEN 0 AND 2"), "precip")
def b01(spark, sf):
    return masks.bounding_box(located(cubes.cube_ship(spark, sf)), (10.0, -10.0), (0.0, 144.0)).select("pixel_id", "time", "precip")


@query("b02_rotate_longitude", cube_sql(
    "SELECT pixel_id, time, lat_idx, CASE WHEN lon_idx > 2 THEN lon_idx * 72.0 - 360 ELSE lon_idx * 72.0 END AS lon, CAST((lon_idx + 2) % 5 AS INTEGER) AS lon_idx FROM cube"), "lon")
def b02(spark, sf):
    return masks.rotate_longitude(located(cubes.cube_ship(spark, sf))).select("pixel_id", "time", "lat_idx", "lon", "lon_idx")


@query("b03_time_slice", cube_sql("SELECT pixel_id, time, vci FROM cube WHERE time BETWEEN DATE '1996-03-01' AND DATE '2000-06-30' AND month(time) IN (3, 4, 5) AND year(time) IN (1996, 1999, 2000)"), "vci")
def b03(spark, sf):
    cube = masks.time_slice(cubes.cube_ship(spark, sf), "1996-03-01", "2000-06-30", [3, 4, 5], [1996, 1999, 2000])
    return cube.select("pixel_id", "time", "vci")


@query("b04_match_times", cube_sql("SELECT pixel_id, time, vci FROM cube WHERE time IN (SELECT time FROM cube WHERE precip > 900)"), "vci")
def b04(spark, sf):
    cube = cubes.cube_ship(spark, sf)
    return masks.match_times(cube, cube.filter("precip > 900")).select("pixel_id", "time", "vci")


@query("b05_first_null_mask", cube_sql(
    "SELECT d.pixel_id, time, CASE WHEN NOT m.mask THEN v END AS v FROM d JOIN m USING (pixel_id)",
    "d AS (SELECT pixel_id, time, CASE WHEN precip % 3 != 0 THEN vci END AS v FROM dense), m AS (SELECT pixel_id, arg_min(v IS NULL, time) AS mask FROM d GROUP BY 1)"), "v")
def b05(spark, sf):
    dense = cubes.dense_ship(spark, sf).select("pixel_id", "time", F.when(F.col("precip") % 3 != 0, F.col("vci")).alias("v"))
    return masks.apply_mask(dense, masks.null_mask(dense, "v", KEY), ["v"], KEY)


@query("b06_union_masks", cube_sql("SELECT pixel_id, time, (precip IS NULL OR nullif(price > 40000, false) IS NULL) AS mask FROM dense"))
def b06(spark, sf):
    dense = cubes.dense_ship(spark, sf).withColumn("p", F.when(F.col("price") > 40000, F.col("price")))
    return masks.union_masks(dense, ["precip", "p"], KEY)


@query("b07_membership", "SELECT DISTINCT CAST(l_suppkey % 25 AS INTEGER) AS pixel_id, NOT (l_suppkey % 5 IN (1, 3)) AS mask, CASE WHEN l_suppkey % 5 IN (1, 3) THEN l_suppkey % 5 * 2.0 END AS v FROM lineitem", "v")
def b07(spark, sf):
    cells = cubes.ship_regions(spark, sf).withColumn("v", F.col("region_id") * 2.0)
    return masks.keep_members(masks.membership_mask(cells, "region_id", [1, 3]), "region_id", [1, 3], ["v"]).select("pixel_id", "mask", "v")


@query("b08_scale_flags", "SELECT l_orderkey, l_linenumber, CASE WHEN dn NOT IN (251, 252, 255) THEN 0.0048 * dn - 0.2 END AS ndvi FROM (SELECT *, l_partkey % 256 AS dn FROM lineitem)", "ndvi")
def b08(spark, sf):
    rows = cubes.table(spark, sf, "lineitem").withColumn("ndvi", (F.col("l_partkey") % 256).cast("double"))
    return masks.scale_flags(rows, "ndvi").select("l_orderkey", "l_linenumber", "ndvi")


LEGEND = {k: f"class_{k}" for k in range(0, 7)}


@query("b09_one_hot", "SELECT CAST(l_suppkey % 25 AS INTEGER) AS pixel_id, year, " + ", ".join(
    f"CAST(count(*) FILTER (code = {k} AND code > 0) AS BIGINT) AS class_{k}" for k in range(7)) + """
    FROM (SELECT l_suppkey, year(l_shipdate) AS year, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END + 3 * CAST(l_linestatus = 'O' AS INTEGER) AS code FROM lineitem)
    GROUP BY 1, 2""")  # fmt: skip
def b09(spark, sf):
    hot = masks.one_hot(cubes.land_cover(spark, sf), "code", LEGEND)
    return hot.groupBy("pixel_id", F.col("year").cast("long").alias("year")).agg(*[F.sum(f"class_{k}_one_hot").alias(f"class_{k}") for k in range(7)])


@query("b10_remap", "SELECT p_partkey, CASE p_size WHEN 1 THEN 10 WHEN 2 THEN 20 WHEN 7 THEN 70 ELSE p_size END AS kept, CASE p_size WHEN 1 THEN 10 WHEN 2 THEN 20 WHEN 7 THEN 70 END AS looked_up FROM part")
def b10(spark, sf):
    mapping = {1: 10, 2: 20, 7: 70}
    part = masks.remap(cubes.table(spark, sf, "part"), "p_size", mapping, "kept")
    return masks.remap(part, "p_size", mapping, "looked_up", keep=False).select("p_partkey", "kept", "looked_up")


@query("b11_nearest_pixel", cube_sql("SELECT pixel_id, time, precip FROM cube WHERE lat_idx = (SELECT lat_idx FROM cube ORDER BY abs(lat_idx * 10 - 24), lat_idx LIMIT 1) AND lon_idx = (SELECT lon_idx FROM cube ORDER BY abs(lon_idx * 72 - 100), lon_idx LIMIT 1)"), "precip")
def b11(spark, sf):
    return masks.nearest_pixel(located(cubes.cube_ship(spark, sf)), 4.0, 100.0).select("pixel_id", "time", "precip")


@query("b12_drop_nulls", cube_sql("SELECT pixel_id, time, precip, x FROM roll WHERE precip IS NOT NULL AND x IS NOT NULL"), "precip x")
def b12(spark, sf):
    from ..operators.windows import rolling_sum

    rows = rolling_sum(cubes.dense_ship(spark, sf), "precip", out="x", keys=KEY, trim=False)
    return masks.drop_nulls(rows, ["precip", "x"]).select("pixel_id", "time", "precip", "x")


@query("b13_trim_outliers", """
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem,
        (SELECT avg(l_extendedprice) m, stddev_pop(l_extendedprice) s, quantile_cont(l_extendedprice, 0.01) a, quantile_cont(l_extendedprice, 0.99) b FROM lineitem)
    WHERE abs(l_extendedprice - m) <= 1.5 * s AND l_extendedprice BETWEEN a AND b""", "l_extendedprice")  # fmt: skip
def b13(spark, sf):
    rows = masks.trim_outliers(cubes.table(spark, sf, "lineitem"), "l_extendedprice", 1.5, 0.01, 0.99)
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("b14_keep_variables", cube_sql("SELECT lat_idx, lon_idx, time, pixel_id, vci FROM cube"), "vci")
def b14(spark, sf):
    return masks.keep_variables(cubes.cube_ship(spark, sf), ["pr"])


@query("b15_target_change", cube_sql("SELECT pixel_id, time, change, p + change AS back FROM (SELECT *, lag(precip) OVER w AS p, precip - lag(precip) OVER w AS change FROM dense WINDOW w AS (PARTITION BY pixel_id ORDER BY time))"), "change back")
def b15(spark, sf):
    changed = masks.target_change(cubes.dense_ship(spark, sf), "precip", KEY)
    found = masks.undo_change(changed.withColumn("p", F.col("precip") - F.col("change")), "change", "p", "back")
    return found.select("pixel_id", "time", "change", "back")


@query("b16_standardise", cube_sql(
    "SELECT pixel_id, time, (precip - mp) / nullif(sp, 0) AS precip_norm, (vci - mv) / nullif(sv, 0) AS vci_norm, precip AS again, (ln(precip + 1e-4) - ml) / nullif(sl, 0) AS log_norm FROM dense, m",
    "m AS (SELECT avg(precip) mp, stddev_pop(precip) sp, avg(vci) mv, stddev_pop(vci) sv, avg(ln(precip + 1e-4)) ml, stddev_pop(ln(precip + 1e-4)) sl FROM dense)"), "precip_norm vci_norm again log_norm")
def b16(spark, sf):
    dense = cubes.dense_ship(spark, sf)
    norm = agg.norm_table(dense, ["precip", "vci"])
    found = masks.standardise(dense, norm, ["precip", "vci"])
    found = masks.log_standardise(masks.unstandardise(found, norm, "precip", "precip_norm", "again"), "precip", "log_norm")
    return found.select("pixel_id", "time", "precip_norm", "vci_norm", "again", "log_norm")


@query("b17_errors", cube_sql("SELECT pixel_id, time, e AS error, e * e AS squared_error, abs(e) AS absolute_error, abs(e) AS root_error, 100 * (p / nullif(precip, 0) - 1) AS bias_percent FROM (SELECT *, x / 3 AS p, x / 3 - precip AS e FROM roll)"), "error squared_error absolute_error root_error bias_percent")
def b17(spark, sf):
    from ..operators.windows import rolling_mean

    rows = rolling_mean(cubes.dense_ship(spark, sf), "precip", out="preds", keys=KEY, trim=False)
    return masks.errors(rows, "precip", "preds").select("pixel_id", "time", "error", "squared_error", "absolute_error", "root_error", "bias_percent")


@query("b18_clip", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS floored, least(greatest(c_nationkey, 1), 5) AS class FROM customer", "floored")
def b18(spark, sf):
    return cubes.table(spark, sf, "customer").select(
        "c_custkey", masks.clip(F.col("c_acctbal"), low=0.0).alias("floored"), masks.clip(F.col("c_nationkey"), 1, 5).cast("int").alias("class")
    )


# calendar

DAYS = """days AS (SELECT CAST(user_id AS INTEGER) AS pixel_id, CAST(ts AS DATE) AS time, avg(value) AS v FROM events GROUP BY 1, 2)"""
LABELS = {
    "D": "time", "M": "last_day(time)", "Y": "make_date(year(time), 12, 31)", "Q-DEC": "last_day(make_date(year(time), quarter(time) * 3, 1))",
    "W-MON": "CAST(time + to_days(CAST((8 - isodow(time)) % 7 AS INTEGER)) AS DATE)",
    "DEKAD": "make_date(year(time), month(time), CASE WHEN day(time) <= 10 THEN 1 WHEN day(time) <= 20 THEN 11 ELSE 21 END)",
}


def daily(spark, sf):
    rows = cubes.table(spark, sf, "events")
    return rows.groupBy(F.col("user_id").cast("int").alias("pixel_id"), F.to_date("ts").alias("time")).agg(F.avg("value").alias("v"))


def _resample(rule: str, label: str):
    @query(f"c01_resample_{rule.lower().replace('-', '_')}", f"""
        WITH {DAYS}, found AS (SELECT pixel_id, {label} AS time, avg(v) AS v FROM days GROUP BY 1, 2),
        every AS (SELECT DISTINCT {label} AS time FROM (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS time FROM (SELECT min(time) a, max(time) b FROM found)))
        SELECT p.pixel_id, e.time, v FROM (SELECT DISTINCT pixel_id FROM found) p CROSS JOIN every e LEFT JOIN found f ON f.pixel_id = p.pixel_id AND f.time = e.time""", "v")  # fmt: skip
    def run(spark, sf):
        return agg.resample(daily(spark, sf), rule, ["v"], KEY)


for _rule, _label in LABELS.items():
    _resample(_rule, _label)


@query("c01_resample_ship_quarters", cube_sql("SELECT pixel_id, last_day(make_date(year(time), quarter(time) * 3, 1)) AS time, avg(precip) AS precip, avg(vci) AS vci FROM dense GROUP BY 1, 2"), "precip vci")
def c01_quarters(spark, sf):
    return agg.resample(cubes.dense_ship(spark, sf), "Q-DEC", ["precip", "vci"], KEY)


@query("c03_upsample_nearest", f"""
    WITH {DAYS}, m AS (SELECT pixel_id, {LABELS['DEKAD']} AS time, avg(v) AS v FROM days GROUP BY 1, 2),
    w AS (SELECT *, lead(time) OVER o AS t2, lead(v) OVER o AS v2 FROM m WINDOW o AS (PARTITION BY pixel_id ORDER BY time)),
    d AS (SELECT *, CAST(unnest(CASE WHEN t2 IS NULL THEN [CAST(time AS TIMESTAMP)] ELSE generate_series(CAST(time AS TIMESTAMP), t2 - INTERVAL 1 DAY, INTERVAL 1 DAY) END) AS DATE) AS day FROM w)
    SELECT pixel_id, day AS time, CASE WHEN t2 IS NULL OR day - time <= t2 - day THEN v ELSE v2 END AS v FROM d""", "v")  # fmt: skip
def c03(spark, sf):
    return agg.upsample_nearest(agg.resample(daily(spark, sf), "DEKAD", ["v"], KEY, fill=False), ["v"], KEY)


@query("c04_dekad_index", """
    SELECT DISTINCT CASE d WHEN 21 THEN last_day(m) ELSE make_date(year(m), month(m), d + 9) END AS dekad
    FROM (SELECT unnest(generate_series(date_trunc('month', a), b, INTERVAL 1 MONTH)) AS m, a, b
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) + 4 AS a, CAST(o_orderdate AS DATE) + 24 AS b FROM orders)), (VALUES (1), (11), (21)) v(d)
    WHERE make_date(year(m), month(m), d) <= b AND CASE d WHEN 21 THEN last_day(m) ELSE make_date(year(m), month(m), d + 9) END >= a""")  # fmt: skip
def c04(spark, sf):
    day = F.to_date("o_orderdate")
    ends = cubes.table(spark, sf, "orders").select(F.date_add(day, 4).alias("a"), F.date_add(day, 24).alias("b")).distinct()
    return agg.dekads_between(ends, "a", "b")


@query("c05_dekad_functions", """
    SELECT day, CAST(d AS INTEGER) AS dekad, CAST((month(day) - 1) * 3 + d AS INTEGER) AS running, s AS start, e AS last, day = s AS is_start, day = e AS is_end, e AS of_number
    FROM (SELECT *, make_date(year(day), month(day), d * 10 - 9) AS s, CASE d WHEN 3 THEN last_day(day) ELSE make_date(year(day), month(day), d * 10) END AS e
        FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day, least((day(l_shipdate) - 1) // 10 + 1, 3) AS d FROM lineitem))""")  # fmt: skip
def c05(spark, sf):
    day = F.col("day")
    rows = cubes.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    return rows.select(
        "day", cal.dekad_of_month(day).alias("dekad"), cal.dekad_of_year(day).alias("running"), cal.dekad_start(day).alias("start"), cal.dekad_end(day).alias("last"),
        cal.is_dekad_start(day).alias("is_start"), cal.is_dekad_end(day).alias("is_end"), cal.dekad_date(F.year(day), cal.dekad_of_year(day)).alias("of_number"),
    )


DEKAD_END = "CASE WHEN day(time) <= 10 THEN make_date(year(time), month(time), 10) WHEN day(time) <= 20 THEN make_date(year(time), month(time), 20) ELSE last_day(time) END"


def _dekad_groups(name: str, label: str, by_start: bool):
    @query(name, f"WITH t AS (SELECT CAST(user_id AS INTEGER) AS pixel_id, CAST(ts AS DATE) AS time FROM events) SELECT pixel_id, {label} AS dekad, string_agg(CAST(time AS VARCHAR), ',' ORDER BY time) AS times FROM t GROUP BY 1, 2")
    def run(spark, sf):
        rows = cubes.table(spark, sf, "events").select(F.col("user_id").cast("int").alias("pixel_id"), F.to_date("ts").alias("time"))
        found = agg.group_into_dekads(rows, KEY, by_start=by_start)
        return found.withColumn("times", F.array_join(F.transform("times", lambda d: d.cast("string")), ","))


_dekad_groups("c07_group_into_dekads", DEKAD_END, False)
_dekad_groups("c07_group_by_dekad_starts", LABELS["DEKAD"], True)


@query("c08_minus_months", """
    SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month, last_day(m) AS month_end
    FROM (SELECT o_orderdate, date_trunc('month', o_orderdate) - INTERVAL 17 MONTH AS m FROM orders)""")  # fmt: skip
def c08(spark, sf):
    days = cubes.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.withColumns(cal.minus_months(F.col("day"), 17))


@query("c09_group_keys", """
    SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(month(o_orderdate) AS INTEGER) AS month, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'DJF' WHEN month(o_orderdate) < 6 THEN 'MAM'
        WHEN month(o_orderdate) < 9 THEN 'JJA' ELSE 'SON' END AS season, CAST(dayofyear(o_orderdate) AS INTEGER) AS dayofyear, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders""")  # fmt: skip
def c09(spark, sf):
    days = cubes.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.withColumns({k: cal.group_key(F.col("day"), k) for k in ("month", "season", "dayofyear", "year")})


@query("c10_days_in_month", """
    WITH m AS (SELECT DISTINCT last_day(o_orderdate) AS time, CAST(day(last_day(o_orderdate)) AS INTEGER) AS d, month(o_orderdate) = 2 AS feb FROM orders)
    SELECT time, d AS standard, CASE WHEN feb THEN 28 ELSE d END AS noleap, CASE WHEN feb THEN 29 ELSE d END AS all_leap, 30 AS days_360 FROM m""")  # fmt: skip
def c10(spark, sf):
    months = cubes.table(spark, sf, "orders").select(F.last_day("o_orderdate").alias("time")).distinct()
    names = {"standard": "standard", "noleap": "noleap", "all_leap": "all_leap", "days_360": "360_day"}
    return months.withColumns({n: cal.days_in_month(F.col("time"), c).cast("int") for n, c in names.items()})


@query("c11_month_end_label", "SELECT DISTINCT year(o_orderdate) || '_' || month(o_orderdate) AS label, last_day(o_orderdate) AS time FROM orders")
def c11(spark, sf):
    labels = cubes.table(spark, sf, "orders").select(F.concat_ws("_", F.year("o_orderdate"), F.month("o_orderdate")).alias("label")).distinct()
    part = lambda k: F.element_at(F.split("label", "_"), k).cast("int")
    return labels.withColumn("time", cal.month_end(part(1) * 12 + part(2) - 1))


@query("c12_valid_time", """
    SELECT l_orderkey, l_linenumber, l_suppkey, CAST(CAST(o_orderdate AS DATE) + CAST(h AS INTEGER) AS DATE) AS valid, CASE WHEN h BETWEEN 28 AND 31 THEN 1 WHEN h BETWEEN 59 AND 62 THEN 2 WHEN h BETWEEN 89 AND 92 THEN 3 END AS ahead
    FROM (SELECT *, 28 + l_partkey % 65 AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")  # fmt: skip
def c12(spark, sf):
    lines, orders = cubes.table(spark, sf, "lineitem"), cubes.table(spark, sf, "orders")
    horizon = 28 + F.col("l_partkey") % 65
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", cal.valid_time(F.to_date("o_orderdate"), horizon).alias("valid"), cal.months_ahead(horizon).alias("ahead"))


@query("c14_lead_times", """
    SELECT init, init + to_hours(CAST(6 * k AS INTEGER)) AS valid FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS init FROM orders), range(1, 861) r(k)""")
def c14(spark, sf):
    starts = cubes.table(spark, sf, "orders").select(F.date_trunc("month", "o_orderdate").alias("init")).distinct()
    steps = F.sequence(F.col("init") + F.expr("interval 6 hours"), F.col("init") + F.expr("interval 215 days"), F.expr("interval 6 hours"))
    return starts.select("init", F.explode(steps).alias("valid"))

