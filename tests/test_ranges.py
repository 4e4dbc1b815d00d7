"""Ranks, places and percentiles by ranges of the value, against plain Python."""

import random
import statistics
from datetime import date

import pytest
from pyspark.sql import functions as F

from cubeloom.operators import aggregates, evaluate, features, models, order, windows

SCHEMA = "g string, i int, v double, w double"


def rows(n=3000, seed=5):
    """Three groups, the null one too: one without ties, one with a value in two thirds of its rows, one with a row; a tenth of the values is missing."""
    r = random.Random(seed)
    found = []
    for i in range(n):
        g = ("plain", "tied", None)[i % 3]
        v = r.gauss(0, 100) if g == "plain" else (0.0 if r.random() < 0.67 else float(r.randrange(40)))
        found.append((g, i, None if r.random() < 0.1 else v, None if r.random() < 0.1 else v + r.randrange(60)))
    return [*found, ("single", n, 1.0, 1.0)]


def average_ranks(values):
    at = {}
    for k, v in enumerate(sorted(values), 1):
        at.setdefault(v, []).append(k)
    return [sum(at[v]) / len(at[v]) for v in values]


def by_group(data):
    found = {}
    for r in data:
        found.setdefault(r[0], []).append(r)
    return found


def test_spearman_equals_ranks_of_rows(spark):
    data = rows()
    found = {r["g"]: r["rho"] for r in aggregates.spearman(spark.createDataFrame(data, SCHEMA), "v", "w", ["g"]).collect()}
    assert set(found) == {"plain", "tied", "single", None} and found["single"] is None
    for g, part in by_group(data).items():
        both = [(r[2], r[3]) for r in part if r[2] is not None and r[3] is not None]
        if len(both) > 1:
            assert found[g] == pytest.approx(statistics.correlation(*map(average_ranks, zip(*both, strict=True))), abs=1e-12)


def test_spearman_over_all_and_of_nothing(spark):
    df = spark.createDataFrame([("a", i, float(i), float(-(i**3))) for i in range(500)], SCHEMA)
    assert aggregates.spearman(df, "v", "w", []).first()["rho"] == pytest.approx(-1)
    assert aggregates.spearman(df.filter("i < 0"), "v", "w", ["g"]).count() == 0


def test_spearman_has_no_window_over_a_group(spark):
    """Every window is over a range, or over a row for each range."""
    df = spark.createDataFrame(rows(300), SCHEMA)
    plan = aggregates.spearman(df, "v", "w", ["g"])._jdf.queryExecution().optimizedPlan().toString()
    found = [line for line in plan.splitlines() if "Window [" in line]
    assert found and all("_range" in line for line in found)


def test_extremes_from_both_ends(spark):
    data = rows()
    found = {r["i"]: r for r in aggregates.flag_extremes(spark.createDataFrame(data, SCHEMA), "v", (5, 900), ["g"], ["i"]).collect()}
    assert len(found) == len(data)
    for part in by_group(data).values():
        for side, sign in (("top", -1), ("bottom", 1)):
            ranked = sorted(part, key=lambda r: (r[2] is None, sign * (r[2] or 0), r[1]))
            for n in (5, 900):
                assert [found[r[1]][f"{side}_{n}"] for r in ranked] == [k < n for k in range(len(ranked))]


def test_places_put_nulls_first(spark):
    data = rows()
    found = {r["i"]: (r["_place"], r["_all"]) for r in order.places(spark.createDataFrame(data, SCHEMA), "v", ["g"], ["i"]).collect()}
    for part in by_group(data).values():
        ranked = sorted(part, key=lambda r: (r[2] is not None, r[2] or 0, r[1]))
        assert [found[r[1]] for r in ranked] == [(k, len(part)) for k in range(1, len(part) + 1)]


def test_percentiles_of_groups(spark):
    data = rows()
    found = {r["g"]: r for r in order.percentiles(spark.createDataFrame(data, SCHEMA), "v", {"a": 0.05, "b": 0.5, "c": 1.0}, ["g"]).collect()}
    for g, part in by_group(data).items():
        values = sorted(r[2] for r in part if r[2] is not None)
        for name, q in (("a", 0.05), ("b", 0.5), ("c", 1.0)):
            at = q * (len(values) - 1)
            low = int(at)
            high = min(low + 1, len(values) - 1)
            assert found[g][name] == pytest.approx(values[low] + (values[high] - values[low]) * (at - low), abs=1e-9)


def test_summary_of_many_variables(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("none", F.lit(None).cast("double"))
    found = {r["variable"]: r for r in aggregates.summary(df, ["v", "w", "i", "none"]).collect()}
    assert set(found) == {"v", "w", "i", "none"} and found["none"]["median"] is None and found["none"]["mean"] is None
    for name, at in (("v", 2), ("w", 3), ("i", 1)):
        values = [r[at] for r in rows() if r[at] is not None]
        assert (found[name]["min"], found[name]["max"]) == (min(values), max(values))
        assert found[name]["mean"] == pytest.approx(statistics.fmean(values)) and found[name]["median"] == pytest.approx(statistics.median(values))


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert order.places(df, "v", [], []).count() == 0 and order.places_from_both_ends(df, "v", ["g"], ["i"]).count() == 0
    assert windows.empirical_cdf(df, "v", ["g"]).count() == 0 and windows.terciles(df, "v").count() == 0
    assert [tuple(r) for r in aggregates.summary(df, ["v"]).collect()] == [("v", None, None, None, None)]
    assert tuple(aggregates.colour_range(df, "v").first()) == (None, None)


def test_scores_by_model_equal_those_of_each(spark):
    times = [date(2000, m, 1) for m in range(1, 13)]
    data = [(m, p, t, float(3 * p + k), None if (k + p) % 5 == 4 else 3.0 * p + k + (m == "b") * (k % 3)) for m in "ab" for p in range(4) for k, t in enumerate(times)]
    df = spark.createDataFrame(data, "model string, pixel_id int, time date, y double, preds double")
    for score in (evaluate.spatial_rmse, evaluate.spatial_r2):
        both = score(df, "y", "preds", ["pixel_id"], by=("model",)).collect()
        for m in "ab":
            alone = {r[0]: r[1] for r in score(df.filter(F.col("model") == m), "y", "preds", ["pixel_id"]).collect()}
            assert {r[1]: r[2] for r in both if r["model"] == m} == pytest.approx(alone)
    total = {r["model"]: r["rmse"] for r in evaluate.evaluate(df, "y", "preds", by=("model",)).filter("period = 'total'").collect()}
    assert total["a"] == 0 and total["b"] > 0


def test_bins_and_folds(spark):
    df = spark.createDataFrame([(i, None if i == 3 else float(i), 7.0) for i in range(33)], "i int, x double, same double")
    found = {r["i"]: r for r in features.binned(df, ["x", "same"], 16).collect()}
    assert [found[i]["x"] for i in (0, 1, 2, 3, 16, 31, 32)] == [0, 0, 1, None, 8, 15, 15] and {r["same"] for r in found.values()} == {0.0}
    first, second = (sorted(features.fold(df.repartition(n), ["i"], 3).select("i", "fold").collect()) for n in (1, 5))
    assert first == second and {r["fold"] for r in first} == {0, 1, 2}


def test_grid_search_takes_the_best_candidate(spark):
    """On noise, the strongest penalty errs least; on a line, none does."""
    r = random.Random(2)
    x = [r.gauss(0, 1) for _ in range(90)]
    for slope, best in ((0.0, 50.0), (9.0, 0.0)):
        df = spark.createDataFrame([(i, v, slope * v + r.gauss(0, 1)) for i, v in enumerate(x)], "i int, x double, y double")
        df = features.feature_vector(features.fold(df, ["i"]), ["x"])
        found = models.grid_search(df, regs=(0.0, 50.0), nets=(0.0,), fold="fold")
        scores = {s["reg"]: s["rmse"] for s in models.grid_scores(spark, found).collect()}
        assert min(scores, key=scores.get) == best
