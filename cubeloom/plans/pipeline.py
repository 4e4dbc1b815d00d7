"""The whole job over tables: cube, examples, predictions, scores; each step reads and writes Parquet, and any can be the first."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..operators import evaluate, features, models
from ..sources import cubes

#: What a configuration may set, and what holds where it doesn't.
DEFAULTS = {"target": "precip", "predictors": ["precip", "vci"], "pred_months": 3, "test_years": [2000, 2001], "run_from": "cube"}
STEPS = ("cube", "examples", "predictions", "scores")


def run(spark: SparkSession, source: DataFrame, folder: str, config: Mapping | None = None) -> DataFrame:
    """Run the steps from ``run_from`` on; what earlier steps wrote to the folder is read. Returns the scores."""
    settings = DEFAULTS | dict(config or {})
    unknown = set(settings) - set(DEFAULTS)
    if unknown or settings["run_from"] not in STEPS:
        raise ValueError(f"unknown settings {sorted(unknown)} or step {settings['run_from']}")
    first = STEPS.index(settings["run_from"])
    months, predictors = settings["pred_months"], settings["predictors"]
    keys = ("pixel_id",)

    def cube() -> DataFrame:
        return cubes.densify(source, keys).select(*keys, "time", *dict.fromkeys([settings["target"], *predictors]))

    def examples() -> DataFrame:
        found = features.one_month_examples(read("cube"), settings["target"], predictors, months, months, keys)
        found = features.with_previous_year(features.split_by_year(found, settings["test_years"]), keys)
        return features.complete(found, [c for c in found.columns if c not in (*keys, "split")])

    def predictions() -> DataFrame:
        found = read("examples")
        train, test = found.filter("split = 'train'"), found.filter("split = 'test'")
        columns = [c for c in found.columns if c not in (*keys, "split", "target_month", "y")]
        fitted = models.linear(features.feature_vector(train, columns))
        linear = fitted.transform(features.feature_vector(test, columns)).select(*keys, "target_month", "y", "prediction")
        last = test.select(*keys, "target_month", "y", f"{settings['target']}_t1")
        climate = models.climatology_model(train, test, keys=keys).select(*keys, "target_month", "y", "preds")
        tables = {"linear": linear.withColumnRenamed("prediction", "preds"), "persistence": last.withColumnRenamed(f"{settings['target']}_t1", "preds"), "climatology": climate}
        return cubes.predictions(tables)

    def scores() -> DataFrame:
        return evaluate.annual_scores(read("predictions"), "y", "preds", time="target_month")

    def read(step: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{step}")

    for name, step in list(zip(STEPS, (cube, examples, predictions, scores), strict=True))[first:]:
        step().write.mode("overwrite").parquet(f"{folder}/{name}")
    return read("scores")
