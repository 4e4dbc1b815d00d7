"""Operators on small cubes with known results."""

import hashlib
import math
from datetime import date, timedelta
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom.functions import calendar as cal
from cubeloom.functions.numeric import digitize
from cubeloom.operators import aggregates, evaluate, events, features, indices, joins, masks, models, order, spatial, windows
from cubeloom.plans import datasets
from cubeloom.plans.pipeline import run as run_pipeline
from cubeloom.sources import cubes
from cubeloom.streaming import ingest


def month_ends(n, year=2000):
    return [date(year + (k + 1) // 12, (k + 1) % 12 + 1, 1) - timedelta(days=1) for k in range(n)]


def cube(spark, values, n_cells=1):
    """A cube of one row of cells; values: a function of (cell, month) or a list for each cell."""
    times = month_ends(len(values) if isinstance(values, list) else 36)
    at = (lambda c, k: values[k]) if isinstance(values, list) else values
    rows = [(0, c, times[k], None if at(c, k) is None else float(at(c, k))) for c in range(n_cells) for k in range(len(times))]
    return spark.createDataFrame(rows, "lat_idx int, lon_idx int, time date, v double")


def column(df, name):
    return [r[name] for r in df.orderBy("lat_idx", "lon_idx", "time").collect()]


def test_runs_stand_at_their_start(spark):
    values = [10.0] * 20
    for k in (3, 4, 5, 6, 10, 11, 12):
        values[k] = 0.2
    found = events.detect(cube(spark, values), "v", "abs", False, 1.0)
    found = events.event_runs(found, "v")
    lengths = column(found, "run_length")
    assert lengths[3] == 4 and lengths[10] == 3 and sum(lengths) == 7
    assert column(found, "run_position")[3:7] == [1, 2, 3, 4]
    assert events.longest(found, "v").first().longest_run == 4


def test_no_runs_and_masked_series(spark):
    found = events.detect(cube(spark, [None] + [5.0] * 5), "v", "abs", False, 1.0)
    assert events.longest(found, "v").first().longest_run is None
    assert windows.longest_run(found, "event").first().longest_run == 0


def test_rolling_needs_all_values(spark):
    df = cube(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0])
    assert column(windows.rolling_sum(df, "v", trim=False), "v_cumsum") == [None] * 5 + [15.0]
    assert column(windows.rolling_mean(df, "v"), "v_mean") == [5.0]


def test_average_ranks_skip_nulls(spark):
    df = cube(spark, [3.0, None, 1.0, 3.0, 2.0])
    rank, n = windows.average_rank("v", ["lon_idx"])
    found = df.select("*", rank.alias("r"), n.alias("n"))
    assert column(found, "r") == [3.5, None, 1.0, 3.5, 2.0] and column(found, "n") == [5] * 5


def test_condition_index_is_bounded(spark):
    rng = np.random.default_rng(1)
    values = rng.random((4, 36))
    found = indices.condition_index(cube(spark, lambda c, k: values[c, k], 4), "v", window=1)
    got = [x for x in column(found, "v_ci")]
    assert min(got) == 0 and max(got) == 100
    flat = indices.condition_index(cube(spark, lambda c, k: 1), "v", window=1)
    assert flat.filter("v_ci is not null").count() == 0


def test_spi_is_standard(spark):
    rng = np.random.default_rng(2)
    values = rng.gamma(2.0, 30.0, (3, 1200))
    times = month_ends(1200, 1900)
    rows = [(0, c, times[k], float(values[c, k])) for c in range(3) for k in range(1200)]
    df = spark.createDataFrame(rows, "lat_idx int, lon_idx int, time date, v double")
    for kind in ("gamma", "pearson"):
        found = indices.spi(df, "v", 3, kind).agg(F.avg("SPI").alias("m"), F.stddev_pop("SPI").alias("s"), F.count("SPI").alias("n")).first()
        assert abs(found.m) < 0.05 and abs(found.s - 1) < 0.05 and found.n == 3 * 1198


def test_gamma_and_quantile_against_tables(spark):
    # chi-square with 2k degrees of freedom, whole shapes by Poisson's sum, and the normal distribution of the standard library
    cases = [(1.0, 1.0, 1 - np.exp(-1)), (2.0, 3.0, 1 - 4 * np.exp(-3)), (5.0, 2.5, 0.1088220), (0.5, 4.0, 0.9953223), (3.0, 0.0, 0.0), (2.0, 900.0, 1.0)]
    for shape, x in ((40, 25.0), (40, 90.0), (700, 650.0), (3000, 3050.0), (1, 30.0)):
        terms = np.cumsum(np.append(0.0, np.log(x) - np.log(np.arange(1, shape))))
        cases.append((float(shape), x, float(1 - np.exp(terms - x).sum())))
    cases = [tuple(map(float, c)) for c in cases]
    df = spark.createDataFrame(cases, "s double, x double, p double")
    for r in df.select("p", indices.gamma_cdf(F.col("s"), F.col("x")).alias("got")).collect():
        assert r.got == pytest.approx(r.p, abs=1e-6 if r.p in (0.1088220, 0.9953223) else 1e-10)
    shares = [1e-9, 1e-4, 0.001, 0.02425, 0.075, 0.3, 0.5, 0.6, 0.925, 0.975, 0.9999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in shares], "p double")
    for r in df.select("p", indices.normal_quantile(F.col("p")).alias("z")).collect():
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-9)
    # where both are right, the share by its series and the saddlepoint agree
    df = spark.createDataFrame([(s, s + z * s**0.5) for s in (1e4, 1e5) for z in (-3.0, -0.7, 0.0, 1e-9, 0.3, 2.5)], "s double, x double")
    for r in df.select(indices.normal_deviate(F.col("s"), F.col("x")).alias("z"), indices.gamma_cdf(F.col("s"), F.col("x")).alias("p")).collect():
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-6)
    for r in spark.createDataFrame([(v,) for v in (1e-3, 0.5, 1.0, 9.99, 10.0, 1e4, 1e9)], "v double").select("v", indices.log_gamma(F.col("v")).alias("g")).collect():
        assert r.g == pytest.approx(math.lgamma(r.v), rel=1e-13, abs=1e-13)


def test_digitize(spark):
    df = cube(spark, [-1.0, 0.0, 20.0, 100.0, None])
    assert column(df.withColumn("d", digitize(F.col("v"), [0, 20, 40, 60, 80])), "d") == [0, 1, 2, 5, None]


def test_calendar(spark):
    days = ["2000-02-29", "2000-12-31", "2001-01-01", "2001-02-10", "2001-02-11", "2001-02-28"]
    df = spark.createDataFrame([(d,) for d in days], "s string").select(F.col("s").cast("date").alias("d"))
    got = df.select(cal.dekad_of_year(F.col("d")).alias("n"), cal.season(F.col("d")).alias("s"), cal.is_dekad_end(F.col("d")).alias("e"), cal.week_end_monday(F.col("d")).alias("w")).collect()
    assert [r.n for r in got] == [6, 36, 1, 4, 5, 6] and [r.s for r in got] == ["DJF"] * 6
    assert [r.e for r in got] == [True, True, False, True, False, True]
    assert [r.w for r in got][:3] == [date(2000, 3, 6), date(2001, 1, 1), date(2001, 1, 1)]
    name = spark.createDataFrame([("VHP.G04.C07.NC.P1981035.VH.nc", "x.t200915.tif")], "a string, b string")
    first = name.select(cal.time_of_file(F.col("a"), "week").alias("w"), cal.time_of_file(F.col("b"), "dekad").alias("d0"), cal.time_of_file(F.col("b"), "dekad", 1).alias("d1")).first()
    assert (first.w, first.d0, first.d1) == (date(1981, 8, 31), date(2009, 6, 10), date(2009, 5, 31))


def test_mode_takes_the_least_of_equals(spark):
    assert aggregates.mode_over_time(cube(spark, [2.0, 1.0, 2.0, 1.0, None]), "v").first()["mode"] == 1.0


def test_neighbours(spark):
    rows = [(i, j, date(2000, 1, 31), float(10 * i + j)) for i in range(5) for j in range(5)]
    df = spark.createDataFrame(rows, "lat_idx int, lon_idx int, time date, v double")
    found = joins.surrounding(df, "v")
    assert found.count() == 9
    one = found.filter("lat_idx = 2 and lon_idx = 2").first()
    assert one["lat_1_lon_0_v"] == 12 and one["lat_-1_lon_1_v"] == 31


def test_rasterise_later_polygon_wins(spark):
    cells = spark.createDataFrame([(i, j, i + 0.5, j + 0.5) for i in range(3) for j in range(3)], "lat_idx int, lon_idx int, lat double, lon double")
    ring = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    shapes = spark.createDataFrame([(1, "x", ring(0.0, 2.0)), (2, "y", ring(1.0, 3.0)), (3, "z", [])], "poly_id int, name string, ring array<struct<x:double,y:double>>")
    got = {(r.lat_idx, r.lon_idx): r.poly_id for r in spatial.rasterise(cells, shapes, origin="center").collect()}
    assert got[0, 0] == 1 and got[1, 1] == 2 and got[2, 2] == 2 and got[0, 2] is None


def test_regridding_keeps_a_constant_and_its_nulls(spark):
    rows = [(i, j, float(i), float(j), date(2000, 1, 31), None if (i, j) == (0, 0) else 7.0) for i in range(4) for j in range(4)]
    df = spark.createDataFrame(rows, "lat_idx int, lon_idx int, lat double, lon double, time date, v double")
    target = spatial.axes(spark, [0.5, 2.5, 9.0], [0.5, 2.0])
    for method in ("nearest", "bilinear", "conservative", "distance", "nearest_to_target"):
        values = {None if r.v is None else round(r.v, 9) for r in spatial.regrid(df, target, ["v"], method).collect()}
        assert values <= {7.0, None} and 7.0 in values, method
    assert spatial.regrid(df, target, ["v"], "bilinear").filter("lat = 0.5 and lon = 0.5").first().v is None
    assert spatial.regrid(df, target, ["v"], "bilinear").filter("lat = 9.0").count() == 0


def test_examples_do_not_leak(spark):
    df = cube(spark, lambda c, k: 100 * c + k, 3)
    found = features.one_month_examples(df, "v", ["v"], 4, 4)
    assert found.count() == 3 * 32
    row = found.filter("lon_idx = 1 and target_month = '2000-06-30'").first()
    assert [row[f"v_t{k}"] for k in (1, 2, 3, 4)] == [104, 103, 102, 101] and row.y == 105
    now = features.nowcast_examples(df, "v", ["v"], 4, 4).first()
    assert now.v_t0 == -9999
    split = features.split_by_year(found, [2002])
    assert {(r.split, r.y) for r in split.select("split", F.year("target_month").alias("y")).distinct().collect()} == {("train", 2000), ("train", 2001), ("test", 2002)}
    previous = features.with_previous_year(split)
    assert {r.prev_y for r in previous.filter("split = 'test'").collect()} == {0.0}


def test_scores_of_a_perfect_model(spark):
    df = cube(spark, lambda c, k: k, 2).withColumn("p", F.col("v")).withColumn("model", F.lit("m"))
    total = evaluate.evaluate(df, "v", "p").filter("period = 'total'").first()
    assert total.rmse == 0 and total.r2 == 1
    constant = cube(spark, lambda c, k: 1).withColumn("p", F.lit(1.0))
    assert evaluate.scores(constant, "v", "p", ["lon_idx"]).first().r2 is None
    assert evaluate.missing_agreement(df, "v", "p").first().ok


def test_grid_check_and_masks(spark):
    df = cube(spark, lambda c, k: k, 3)
    with pytest.raises(ValueError):
        cubes.merge_layers([df, df.filter("lon_idx < 2").withColumnRenamed("v", "w")])
    with pytest.raises(ValueError):
        joins.outer_merge(df, df.withColumn("v", F.col("v") + 1), ["v"], check=True)
    with pytest.raises(ValueError):
        masks.bounding_box(df.withColumns({"lat": F.lit(0.0), "lon": F.lit(0.0)}), (1.0, 2.0), (1.0, 2.0), check=True)
    assert masks.static_variables(df.withColumn("h", F.col("lon_idx") * 2)) == ["h"]
    assert cubes.densify(df.filter("not (lon_idx = 1 and v = 3)")).filter("v is null").count() == 1


def test_read_preprocessed_and_tables(spark, tmp_path):
    df = cube(spark, lambda c, k: k)
    for name in ("a_preprocessed", "b_preprocessed", "raw_b"):
        df.write.parquet(f"{tmp_path}/{name}")
    assert sorted(cubes.read_preprocessed(spark, str(tmp_path))) == ["a", "b"]
    cubes.save_table(df, f"{tmp_path}/csv", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 36


def test_whole_job_restarts(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(c, t, float(50 + 40 * np.sin(k / 6 * np.pi) + rng.normal()), float(k % 12)) for c in range(4) for k, t in enumerate(month_ends(48, 1998))]
    source = spark.createDataFrame(rows, "pixel_id int, time date, precip double, vci double")
    n = run_pipeline(spark, source, str(tmp_path)).count()
    scores = run_pipeline(spark, source.limit(0), str(tmp_path), {"run_from": "scores"})
    assert scores.count() == n > 0
    with pytest.raises(ValueError):
        run_pipeline(spark, source, str(tmp_path), {"no such": 1})
    mean = {r.model: r.v for r in scores.filter("metric = 'rmse'").groupBy("model").agg(F.avg("value").alias("v")).collect()}
    assert mean["climatology"] < mean["persistence"]


def test_streamed_means_equal_batch(spark, tmp_path):
    rows = [(c, date(2000, 1, 1) + timedelta(days=3 * k), float(k * (c + 1))) for c in range(3) for k in range(80)]
    df = spark.createDataFrame(rows, "pixel_id int, time date, v double")
    for part in (df.filter("day(time) % 2 = 0"), df.filter("day(time) % 2 = 1")):
        part.repartition(3).write.mode("append").parquet(f"{tmp_path}/raw")
        ingest.start_monthly_sums(spark, f"{tmp_path}/raw", df.schema, f"{tmp_path}/sums", f"{tmp_path}/seen", "v", files_each=2).awaitTermination()
    got = {(r.pixel_id, r.time): r["mean"] for r in ingest.monthly_means(spark, f"{tmp_path}/sums").collect()}
    want = {(r.pixel_id, r.time): r.m for r in df.groupBy("pixel_id", F.last_day("time").alias("time")).agg(F.avg("v").alias("m")).collect()}
    assert got == pytest.approx(want)


def test_final_means_leave_open_months_out(spark, tmp_path):
    rows = [(0, date(2000, m, d), float(m)) for m in range(1, 7) for d in (1, 15)]
    df = spark.createDataFrame(rows, "pixel_id int, time date, v double")
    df.coalesce(1).write.parquet(f"{tmp_path}/raw")
    ingest.start_final_means(spark, f"{tmp_path}/raw", df.schema, f"{tmp_path}/final", f"{tmp_path}/seen", "v").awaitTermination()
    got = {r.time.month: r["mean"] for r in spark.read.parquet(f"{tmp_path}/final").collect()}
    assert got and 6 not in got and all(m == v for m, v in got.items())


def test_district_mask_and_clusters(spark):
    regions = spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "pixel_id int, region_name string")
    assert [r["mask"] for r in datasets.district_mask(regions, ["a"]).orderBy("pixel_id").collect()] == [False, True, True]
    a = spark.createDataFrame([(k, k // 5) for k in range(10)], "vec_id long, cluster int")
    b = spark.createDataFrame([(k, 1 - k // 5) for k in range(10)], "vec_id long, cluster int")
    assert models.match_labels(a, b, "cluster", ["vec_id"]) == {1: 0, 0: 1}


def test_dekads_by_their_ends(spark):
    dates = spark.createDataFrame([("2019-01-05", "2019-01-25"), ("2019-02-21", "2019-03-01")], "a string, b string").selectExpr("cast(a as date) a", "cast(b as date) b")
    ends = {str(r.dekad) for r in aggregates.dekads_between(dates, "a", "b").collect()}
    assert ends == {"2019-01-10", "2019-01-20", "2019-01-31", "2019-02-28", "2019-03-10"}
    days = spark.createDataFrame([(1, "2020-02-29"), (1, "2020-02-21"), (1, "2020-02-29"), (1, "2020-02-10")], "pixel_id int, time string").withColumn("time", F.col("time").cast("date"))
    named = lambda **how: {str(r.dekad): [str(t) for t in r.times] for r in aggregates.group_into_dekads(days, ["pixel_id"], **how).collect()}
    assert named() == {"2020-02-10": ["2020-02-10"], "2020-02-29": ["2020-02-21", "2020-02-29", "2020-02-29"]}
    assert set(named(by_start=True)) == {"2020-02-01", "2020-02-21"}


@pytest.mark.parametrize("method", ["nearest", "bilinear", "conservative", "distance", "largest_area", "nearest_to_target"])
def test_regridding_where_a_cell_is_absent(spark, method):
    """A constant field stays constant wherever it has a value, and bilinear needs all four."""
    cells = [(i, j, float(i), float(j), 10.0) for i in range(3) for j in range(3) if (i, j) != (0, 0)]
    df = spark.createDataFrame(cells, "lat_idx int, lon_idx int, lat double, lon double, v double").withColumn("time", F.lit("2020-01-31").cast("date"))
    found = {(r.lat_idx, r.lon_idx): r.v for r in spatial.regrid(df, spatial.axes(spark, [0.5, 1.5], [0.5, 1.5]), ["v"], method).collect()}
    assert all(v is None or abs(v - 10) < 1e-9 for v in found.values())
    assert abs(found[1, 1] - 10) < 1e-9
    if method == "bilinear":
        assert found[0, 0] is None


def test_gradient_descent_with_early_stopping(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) * [1, 10, 0.1] + [5, 0, 2]
    y = x @ [2.0, -0.3, 4.0] + 7 + rng.normal(size=400) * 0.05
    rows = [(float(a), float(b), float(c), float(t), bool(k % 5 == 0)) for k, ((a, b, c), t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, validation boolean").repartition(3)
    model = models.linear_by_gradient(df, ["a", "b", "c"])
    assert model.rounds > 5
    assert np.allclose(model.weights / model.std, [2.0, -0.3, 4.0], atol=0.1)
    found = model.transform(df).agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2)).alias("rmse")).first().rmse
    assert found < 0.1
    # where the validation rows say otherwise, descent stops at once
    turned = df.withColumn("y", F.when(F.col("validation"), -5 * F.col("y")).otherwise(F.col("y")))
    assert models.linear_by_gradient(turned, ["a", "b", "c"], patience=3).rounds < model.rounds
    constant = df.withColumn("a", F.lit(1.0)).withColumn("validation", F.lit(None).cast("boolean"))
    assert np.isfinite(models.linear_by_gradient(constant, ["a", "b"]).weights).all()


def test_gradient_descent_equals_a_loop_over_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2)) * [3, 1] + [1, 5]
    y = x @ [1.5, -2.0] + rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b), float(t), k % 4 == 0) for k, ((a, b), t) in enumerate(zip(x, y, strict=True))], "a double, b double, y double, validation boolean")
    model = models.linear_by_gradient(df.repartition(5), ["a", "b"], rate=0.2, epochs=7, batches=9, patience=99, penalty=0.01, seed=3)
    rows = df.withColumn("batch", models.batch_number(["a", "b", "y"], 9, 3)).collect()
    use = np.array([[r.a, r.b, r.y] for r in rows if not r.validation])
    batch = np.array([r.batch for r in rows if not r.validation])
    check = np.array([[r.a, r.b, r.y] for r in rows if r.validation])
    mean, std = use.mean(0), use.std(0)
    z, v = (use - mean) / std, (check - mean) / std
    w, c, t, best = np.zeros(2), 0.0, 0, (np.inf, None)
    for epoch in range(1, 8):
        for k in models.batch_order(9, epoch, 3):
            part = z[batch == k]
            if len(part):
                t += 1
                error = part[:, :2] @ w + c - part[:, 2]
                w, c = w - 0.2 / t**0.25 * (part[:, :2].T @ error / len(part) + 0.01 * w), c - 0.2 / t**0.25 * error.mean()
        best = min(best, (float(((v[:, :2] @ w + c - v[:, 2]) ** 2).mean()), (epoch, w, c)), key=lambda b: b[0])
    epoch, w, c = best[1]
    assert model.rounds == epoch and np.allclose(model.weights, w * std[2], rtol=1e-9) and np.isclose(model.intercept, c * std[2] + mean[2], rtol=1e-9)


def test_distance_takes_the_four_nearest_cells(spark):
    """Rows ten apart, columns one: all four lie in the first row."""
    cells = [(i, j, 10.0 * i, float(j), 100.0 * i + j) for i in range(2) for j in range(5)]
    df = spark.createDataFrame(cells, "lat_idx int, lon_idx int, lat double, lon double, v double").withColumn("time", F.lit("2020-01-31").cast("date"))
    lat, lon = [1.0, 5.0, 10.0, -3.0], [2.0, 2.2, 9.0]
    found = {(r.lat, r.lon): r.v for r in spatial.regrid(df, spatial.axes(spark, lat, lon), ["v"], "distance").collect()}
    for (y, x), v in found.items():
        near = sorted((np.hypot(b - y, c - x), i, j, w) for i, j, b, c, w in cells)[:4]
        want = near[0][3] if near[0][0] == 0 else sum(w / d for d, *_, w in near) / sum(1 / d for d, *_ in near)
        assert v == pytest.approx(want), (y, x)
    assert len(found) == 12 and found[1.0, 2.0] == pytest.approx(1.69, abs=0.005)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 97, 100, 4097])
def test_permutations(spark, n):
    for seed in (1, 2):
        found = [r.p for r in spark.range(n).select(order.permuted(F.col("id"), n, seed).alias("p")).collect()]
        assert sorted(found) == list(range(n))
        assert n < 50 or sum(a == b for a, b in enumerate(found)) < n / 5
    rows, total = order.row_numbers(spark.range(n).repartition(3))
    assert total == n and sorted(r["_row"] for r in rows.collect()) == list(range(n))


def test_permutation_importance_of_a_linear_model(spark):
    """The error that a permuted column makes in a noiseless linear model is the weight's size times the root of 2 times its deviation."""
    weights, scales = (2.0, -0.5, 0.0), (1.0, 4.0, 3.0)
    rows = spark.range(20_000).select(*[(F.randn(k) * s).alias(f"x{k}") for k, s in enumerate(scales)])
    rows = rows.withColumn("y", sum(F.col(f"x{k}") * w for k, w in enumerate(weights)) + 3)
    rows = features.feature_vector(rows, ["x0", "x1", "x2"])
    found = {r.feature: r.importance for r in models.permutation_importance(models.linear(rows), rows, ["x0", "x1", "x2"]).collect()}
    for k, (w, s) in enumerate(zip(weights, scales, strict=True)):
        assert found[f"x{k}"] == pytest.approx(abs(w) * s * 2**0.5, rel=0.05, abs=1e-3)


def test_subset_fits_equal_least_squares(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + 3
    x[:, 3] = x[:, 0] - 2 * x[:, 1]  # what others determine
    y = x[:, 0] - x[:, 2] + rng.normal(size=200)
    rows = [(*map(float, r), float(t), "train" if k % 3 else "test") for k, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y double, split string")
    found = {f.name: f for f in features.subset_fits(df, {"p": ["a", "b"], "q": ["c"], "r": ["d"]})}
    assert set(found) == {"p", "q", "r", "p+q", "p+r", "q+r", "p+q+r"}
    train, test = np.arange(200) % 3 > 0, np.arange(200) % 3 == 0
    for f in found.values():
        z = np.column_stack([np.ones(200), *[x[:, "abcd".index(c)] for c in f.columns]])
        guess = z[test] @ np.linalg.lstsq(z[train], y[train], rcond=None)[0]
        assert f.rmse == pytest.approx(np.sqrt(((y[test] - guess) ** 2).mean())) and f.n == test.sum()
        assert f.r2 == pytest.approx(1 - ((y[test] - guess) ** 2).sum() / ((y[test] - y[test].mean()) ** 2).sum())
        assert np.allclose(z[test] @ [f.intercept, *f.coefficients], guess)


def test_clusters_by_month_equal_plain_steps(spark):
    rng = np.random.default_rng(6)
    rows = [(k, 1 + k % 3 if k % 3 else None, (rng.normal(size=3) + 5 * (k % 4)).tolist()) for k in range(120)] + [(500, 7, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, month int, features array<double>").repartition(4)
    found = models.clusters_by_group(df, (2, 4), steps=50).collect()
    assert {(r.vec_id, r.k): r.cluster for r in found if r.month == 7} == {(500, 2): 0, (500, 4): 0}
    hashed = lambda v: int(hashlib.md5(f"{v}:1".encode()).hexdigest()[:8], 16)
    for month in (None, 2, 3):
        points = sorted((hashed(v), v, f) for v, m, f in rows if m == month)
        x = np.array([f for *_, f in points])
        for k in (2, 4):
            centres = x[:k].copy()
            for _ in range(50):
                near = ((x[:, None] - centres) ** 2).sum(-1)
                label = near.argmin(1)
                centres = np.array([x[label == c].mean(0) if (label == c).any() else centres[c] for c in range(k)])
            near = ((x[:, None] - centres) ** 2).sum(-1)
            got = {r.vec_id: (r.cluster, r.distance) for r in found if r.month == month and r.k == k}
            assert [got[v][0] for _, v, _ in points] == near.argmin(1).tolist()
            assert sum(d * d for _, d in got.values()) == pytest.approx(near.min(1).sum())


def test_late_rows_are_counted(spark, tmp_path):
    day = lambda m, d: date(2000, m, d)
    first = [(0, day(m, d), float(m)) for m in range(1, 7) for d in (1, 15)] + [(1, day(2, 3), None)]
    late = [(0, day(1, 20), 99.0), (2, day(2, 1), 5.0), (0, day(8, 5), 1.0)]
    schema = "pixel_id int, time date, v double"
    for part in (first, late):
        df = spark.createDataFrame(part, schema)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/raw")
        ingest.start_final_means(spark, f"{tmp_path}/raw", df.schema, f"{tmp_path}/final", f"{tmp_path}/seen", "v").awaitTermination()
    got = {(r.pixel_id, r.time.month): (r["mean"], r.n, r.late) for r in ingest.late_rows(spark, f"{tmp_path}/raw", df.schema, f"{tmp_path}/final").collect()}
    assert got == {(0, 1): (1.0, 2, 1), **{(0, m): (float(m), 2, 0) for m in range(2, 7)}, (1, 2): (None, 0, 0), (2, 2): (None, 0, 1)}


def test_late_rows_are_merged(spark, tmp_path):
    day = lambda m, d: date(2000, m, d)
    first = [(0, day(m, d), float(m)) for m in range(1, 7) for d in (1, 15)]
    late = [(0, day(1, 20), 99.0), (2, day(2, 1), 5.0), (0, day(3, 2), None), (0, day(8, 5), 1.0)]
    for part in (first, late):
        df = spark.createDataFrame(part, "pixel_id int, time date, v double")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/raw")
        ingest.start_final_means(spark, f"{tmp_path}/raw", df.schema, f"{tmp_path}/final", f"{tmp_path}/seen", "v").awaitTermination()
    got = {(r.pixel_id, r.time.month): (r["mean"], r.n, r.amended) for r in ingest.amended_means(spark, f"{tmp_path}/raw", df.schema, f"{tmp_path}/final", "v").collect()}
    assert got == {(0, 1): (101 / 3, 3, True), (2, 2): (5.0, 1, True), (0, 3): (3.0, 2, True), **{(0, m): (float(m), 2, False) for m in (2, 4, 5, 6)}}


def test_neighbours_of_repeated_rows(spark):
    rows = [(i, j, date(2000, 1, 31), float(10 * i + j)) for i in range(3) for j in range(3)] + [(1, 1, date(2000, 1, 31), 50.0)] * 2
    for n in (1, 6):
        found = joins.surrounding(spark.createDataFrame(rows, "lat_idx int, lon_idx int, time date, v double").repartition(n), "v", complete=False)
        found = {(r.lat_idx, r.lon_idx): r for r in found.collect()}
        assert len(found) == 9 and found[1, 1].v == 11.0 and found[2, 2]["lat_1_lon_1_v"] == 50.0


def test_labels_matched_by_region(spark):
    rows = [(k, k % 2, (k // 2 + k % 2) % 3, (k // 2) % 3) for k in range(120)]
    df = spark.createDataFrame(rows, "id int, region int, k long, r long")
    found = models.match_labels_by(df.select("id", F.col("r").alias("k")), df.select("id", "region", "k"), "k", ["id"], "region")
    assert {(r.region, r.label): r.stands_for for r in found.collect()} == {(g, a): (a - g) % 3 for g in range(2) for a in range(3)}
