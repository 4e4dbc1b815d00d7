"""Skill scores by pixel, month, region and model, each from sufficient sums in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import season
from ..functions.numeric import ratio
from ..sources.cubes import PIXEL
from .joins import full_product
from .order import same_group


def pairs(df: DataFrame, truth: str, preds: str) -> DataFrame:
    return df.filter(F.col(truth).isNotNull() & F.col(preds).isNotNull())


def _sums(truth: str, preds: str) -> dict[str, Column]:
    t, p = F.col(truth), F.col(preds)
    sse = F.sum((t - p) * (t - p))
    # about the mean from the variance: the plain difference of sums loses digits
    sst = F.var_pop(t) * F.count("*")
    return {
        "rmse": F.sqrt(sse / F.count("*")), "mae": F.avg(F.abs(t - p)),
        "r2": F.when((F.count("*") > 1) & (sst > 1e-12), 1 - ratio(sse, sst)), "n": F.count("*"),
    }


def scores(df: DataFrame, truth: str, preds: str, by: list, metrics=("rmse", "r2")) -> DataFrame:
    """Scores by group, on rows with both values. r2 is null for a constant truth and for fewer than two rows."""
    sums = _sums(truth, preds)
    return pairs(df, truth, preds).groupBy(*by).agg(*[sums[m].alias(m) for m in metrics])


def evaluate(df: DataFrame, truth: str, preds: str, time: str = "time", by: tuple[str, ...] = ()) -> DataFrame:
    """RMSE and R2 of each month, and of all together (``period`` "total"), in each group of ``by``."""
    months = scores(df, truth, preds, [*by, F.date_format(time, "yyyy-MM").alias("period")])
    return months.unionByName(scores(df, truth, preds, [*by, F.lit("total").alias("period")]))


def spatial_rmse(df: DataFrame, truth: str, preds: str, keys=PIXEL, time: str = "time", by: tuple[str, ...] = ()) -> DataFrame:
    """RMSE by cell over all times of the group, missing ones counted too; null where the first prediction is missing."""
    times = df.groupBy(*by).agg(F.countDistinct(time).alias("_t"))
    e = F.col(truth) - F.col(preds)
    found = df.groupBy(*by, *keys).agg(F.coalesce(F.sum(e * e), F.lit(0.0)).alias("_s"), F.min_by(F.isnull(preds), time).alias("_mask"))
    found = same_group(found, times, [*by])
    return found.select(*by, *keys, F.when(~F.col("_mask"), F.sqrt(F.col("_s") / F.col("_t"))).alias("rmse"))


def spatial_r2(df: DataFrame, truth: str, preds: str, keys=PIXEL, by: tuple[str, ...] = ()) -> DataFrame:
    """R2 by cell, whose total is taken about the mean of all predictions of the group."""
    centre = df.groupBy(*by).agg(F.avg(preds).alias("_c"))
    t, p = F.col(truth), F.col(preds)
    rows = same_group(df, centre, [*by])
    return rows.groupBy(*by, *keys).agg((1 - ratio(F.sum((t - p) * (t - p)), F.sum((t - F.col("_c")) * (t - F.col("_c"))))).alias("r2"))


def nse(df: DataFrame, truth: str, preds: str, by: list) -> DataFrame:
    """Nash-Sutcliffe efficiency by group."""
    return scores(df, truth, preds, by, ("r2", "rmse")).withColumnRenamed("r2", "nse")


def temporal_scores(df: DataFrame, truth: str, preds: str, by: list, time: str = "time") -> DataFrame:
    """``r2, rmse`` of the series of means over all cells that have both values, by group."""
    pairs = df.filter(F.col(truth).isNotNull() & F.col(preds).isNotNull())
    means = pairs.groupBy(*by, time).agg(F.avg(truth).alias(truth), F.avg(preds).alias(preds))
    return scores(means, truth, preds, by, ("r2", "rmse"))


def monthly_scores(df: DataFrame, truth: str, preds: str, model: str = "model", time: str = "time") -> DataFrame:
    return scores(df, truth, preds, [model, F.month(time).alias("month")])


def annual_scores(df: DataFrame, truth: str, preds: str, model: str = "model", time: str = "time", years: list[int] | None = None) -> DataFrame:
    """``model, year, month, metric, value``."""
    if years is not None:
        df = df.filter(F.year(time).isin(years))
    found = scores(df, truth, preds, [model, F.year(time).alias("year"), F.month(time).alias("month")])
    return found.unpivot([model, "year", "month"], ["rmse", "r2"], "metric", "value")


def region_series(df: DataFrame, cells: DataFrame, truth: str, preds: str, level: str, keys=("pixel_id",), time: str = "time", model: str = "model") -> DataFrame:
    """``admin_level_name, model, datetime, region_name, predicted_mean_value, true_mean_value``."""
    found = df.join(cells.select(*keys, "region_name"), [*keys]).groupBy(model, time, "region_name")
    found = found.agg(F.avg(preds).alias("predicted_mean_value"), F.avg(truth).alias("true_mean_value"))
    return found.select(F.lit(level).alias("admin_level_name"), model, F.col(time).alias("datetime"), "region_name", "predicted_mean_value", "true_mean_value")


def landcover_series(df: DataFrame, cover: DataFrame, truth: str, preds: str, suffix: str = "_one_hot", keys=("pixel_id",), time: str = "time", model: str = "model") -> DataFrame:
    """region_series() for classes of land cover, of which a cell may have several."""
    hot = [c for c in cover.columns if c.endswith(suffix)]
    long = cover.unpivot([*keys], [F.col(c).cast("int").alias(c.removesuffix(suffix)) for c in hot], "region_name", "_in").filter("_in = 1")
    return region_series(df, long, truth, preds, "landcover", keys, time, model)


def region_scores(series: DataFrame, by_region: bool = True) -> DataFrame:
    """RMSE, MAE and R2 by model and level, and by region; combinations that have no rows are null."""
    by = ["model", "admin_level_name"] + ["region_name"] * by_region
    found = scores(series, "true_mean_value", "predicted_mean_value", by, ("rmse", "mae", "r2"))
    return full_product(found, by, ["rmse", "mae", "r2"]) if by_region else found


def region_seasonality(series: DataFrame) -> DataFrame:
    found = series.groupBy("model", "region_name", F.month("datetime").alias("month"))
    return found.agg(F.avg("true_mean_value").alias("true"), F.avg("predicted_mean_value").alias("predicted"))


def event_confusion(df: DataFrame, truth: str, preds: str, threshold: float = 20.0, by: list | None = None) -> DataFrame:
    """Counts of events (at or below the threshold) hit, missed and falsely seen, and their shares of all rows, nulls included."""
    t, p = F.col(truth) <= threshold, F.col(preds) <= threshold
    n = F.count("*")
    counts = {"tp": t & p, "fp": ~t & p, "fn": t & ~p, "tn": ~t & ~p}
    return df.groupBy(*(by or [])).agg(*[F.count_if(c).alias(k) for k, c in counts.items()], *[ratio(F.count_if(c), n).alias(f"{k}_rate") for k, c in counts.items()])


def class_confusion(df: DataFrame, truth: str, preds: str, by: list[str] | None = None) -> DataFrame:
    """Counts of each true and predicted class, and the share of the true class's rows."""
    rows = pairs(df, truth, preds).groupBy(*(by or []), truth, preds).agg(F.count("*").alias("n"))
    return rows.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*(by or []), truth))))


def class_accuracy(df: DataFrame, truth: str, preds: str, by: list) -> DataFrame:
    """Shares of rows whose class is right, and off by at most one and two."""
    off = F.abs(F.col(truth) - F.col(preds))
    return pairs(df, truth, preds).groupBy(*by).agg(*[F.avg((off <= k).cast("double")).alias(n) for k, n in ((0, "accuracy"), (1, "within_1"), (2, "within_2"))])


def mean_error(df: DataFrame, truth: str, preds: str, by: list) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.col(preds) - F.col(truth)).alias("mean_error"))


def skill_difference(found: DataFrame, model: str, baseline: str, by: list[str], metric: str = "rmse") -> DataFrame:
    """A model's score less the baseline's."""
    one = found.filter(F.col("model") == model).select(*by, F.col(metric).alias("_a"))
    two = found.filter(F.col("model") == baseline).select(*by, F.col(metric).alias("_b"))
    return one.join(two, by).select(*by, (F.col("_a") - F.col("_b")).alias("difference"))


def missing_agreement(df: DataFrame, truth: str, preds: str, least: float = 0.92) -> DataFrame:
    """The share of rows in which both values are there or both are missing, and whether it is above ``least``."""
    return df.agg(F.avg((F.isnull(truth) == F.isnull(preds)).cast("double")).alias("agreement")).withColumn("ok", F.col("agreement") > least)


def seasonal_confusion(df: DataFrame, truth: str, preds: str, time: str = "time") -> DataFrame:
    return class_confusion(df.withColumn("season", season(F.col(time))), truth, preds, ["season"])
