"""Baselines, regressions, trees and clusters on MLlib."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import month_index
from ..sources.cubes import PIXEL
from ..sources.folders import scratch_folder
from .features import dealt_number, moments, standard_gram
from .joins import crosstab
from .order import permuted, row_numbers


def persistence(df: DataFrame, target: str, keys=PIXEL, time: str = "time") -> DataFrame:
    """``preds``: the value of the month before, null where the series has no row for it."""
    w = Window.partitionBy(*keys).orderBy(month_index(F.col(time))).rangeBetween(-1, -1)
    return df.withColumn("preds", F.max(target).over(w))


def climatology_model(train: DataFrame, test: DataFrame, target: str = "y", keys=PIXEL, month: str = "target_month") -> DataFrame:
    """``preds``: the cell's mean of the calendar month in training."""
    means = train.groupBy(*keys, F.month(month).alias("_month")).agg(F.avg(target).alias("preds"))
    return test.withColumn("_month", F.month(month)).join(means, [*keys, "_month"], "left").drop("_month")


def observation_weights(df: DataFrame, target: str = "y", below: float = 15.0, weight: float = 10.0) -> DataFrame:
    """``weight``: low targets count more."""
    return df.withColumn("weight", F.when(F.col(target) <= below, weight).otherwise(1.0))


def linear(train: DataFrame, kind: str = "ols", label: str = "y", weight: str | None = None):
    """Fitted linear regression: ols, elastic net or huber."""
    options = {"ols": {}, "elastic": {"regParam": 0.1, "elasticNetParam": 0.5}, "huber": {"loss": "huber", "epsilon": 1.35}}[kind]
    if weight is not None:
        options = options | {"weightCol": weight}
    return LinearRegression(labelCol=label, featuresCol="features", maxIter=100, **options).fit(train)


@dataclass
class GradientModel:
    """Weights of standardised columns, and after how many epochs they were best on the validation rows."""

    columns: list[str]
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    intercept: float
    rounds: int

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        parts = [(F.col(c) - float(m)) / float(s) * float(w) for c, m, s, w in zip(self.columns, self.mean, self.std, self.weights, strict=True)]
        return df.withColumn(out, reduce(lambda a, b: a + b, parts, F.lit(float(self.intercept))))


def batch_number(columns: list[str], batches: int, seed: int):
    """The mini-batch that a row is in, by a hash of its values."""
    return F.pmod(F.xxhash64(*[F.col(c).cast("double") for c in columns], F.lit(seed)), F.lit(batches)).cast("int")


def batch_order(batches: int, epoch: int, seed: int) -> list[int]:
    """The order of the mini-batches in an epoch."""
    return np.random.default_rng([seed, epoch]).permutation(batches).tolist()


def linear_by_gradient(
    train: DataFrame, columns: list[str], label: str = "y", validation: str = "validation", rate: float = 0.1, epochs: int = 500, patience: int = 10,
    batches: int = 64, penalty: float = 1e-4, power: float = 0.25, seed: int = 1,
) -> GradientModel:
    """Linear regression by stochastic gradient descent in mini-batches, stopped early.

    Rows are dealt into ``batches`` mini-batches by a hash; each epoch takes them in an order of its own. Step t follows the gradient of half the mean squared
    error on one batch, plus ``penalty`` times the weights, at the rate ``rate / t ** power``. After each epoch the loss on the validation rows (on the
    training rows, if there are none) is looked at: without a smaller one for ``patience`` epochs descent ends, and the best weights stay.

    The gradient of a batch only needs the sums of products of its rows. One aggregate gives them for every batch, so Spark is asked once, however many
    steps are made; the driver holds ``batches`` matrices of d * d numbers. Columns and label are standardised by the training rows.
    """
    names = [*columns, label]
    checked = F.coalesce(F.col(validation), F.lit(False))
    found = moments(train, names, F.when(checked, -1).otherwise(batch_number(names, batches, seed)))
    parts = {k: part for k, part in found.items() if k >= 0}
    if not parts:
        raise ValueError("there are no rows to train on")
    n, total, gram = (sum(part[i] for part in parts.values()) for i in range(3))
    mean = total / n
    std = np.sqrt(np.maximum(np.diag(gram) / n - mean**2, 0))
    std[std < 1e-12] = 1.0
    grams = {k: standard_gram(part, mean, std) for k, part in parts.items()}
    check = standard_gram(found.get(-1, (n, total, gram)), mean, std)
    w = best = np.zeros(len(columns) + 1)  # the constant first
    held = np.append(0.0, np.full(len(columns), penalty))
    least, at, t = np.inf, 0, 0
    for epoch in range(1, epochs + 1):
        for k in batch_order(batches, epoch, seed):
            if k in grams:
                t += 1
                g = grams[k]
                w = w - rate / t**power * (g[:-1, :-1] @ w - g[:-1, -1] + held * w)
        loss = float(w @ check[:-1, :-1] @ w - 2 * w @ check[:-1, -1] + check[-1, -1])
        if loss < least - 1e-12:
            least, best, at = loss, w, epoch
        elif epoch - at >= patience:
            break
    return GradientModel(columns, mean[:-1], std[:-1], best[1:] * std[-1], float(best[0] * std[-1] + mean[-1]), at)


def boosted_trees(train: DataFrame, label: str = "y", validation: str | None = None, iterations: int = 20, depth: int = 4, seed: int = 1):
    """Gradient-boosted trees; rows marked in ``validation`` stop it early."""
    model = GBTRegressor(labelCol=label, featuresCol="features", maxIter=iterations, maxDepth=depth, seed=seed)
    if validation is not None:
        model = model.setValidationIndicatorCol(validation)
    return model.fit(train)


def random_forest(train: DataFrame, label: str = "y", trees: int = 20, depth: int = 6, seed: int = 1):
    return RandomForestRegressor(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed).fit(train)


def permutation_importance(model, df: DataFrame, columns: list[str], label: str = "y", seed: int = 1) -> DataFrame:
    """``feature, importance``: how much RMSE grows when a feature's values change places between rows.

    Each feature has a permutation of its own. A value's new row is computed from its row's number (order.permuted()), so one exchange sends all values to
    their rows; all features are then scored in one pass. Nothing is sorted or collected but a number for each feature.
    """
    rows, n = row_numbers(df.select(vector_to_array("features").alias("_v"), F.col(label).cast("double").alias("_y")))
    sent = F.array(*[F.struct(F.lit(k).alias("k"), permuted(F.col("_row"), n, seed + k).alias("to"), F.get("_v", F.lit(k)).alias("x")) for k in range(len(columns))])
    sent = rows.select(F.explode(sent).alias("m")).select("m.*")
    given = sent.groupBy(F.col("to").alias("_row")).agg(*[F.max(F.when(F.col("k") == k, F.col("x"))).alias(f"_x{k}") for k in range(len(columns))])
    tries = [F.struct(F.lit(-1).alias("k"), F.col("_v").alias("v"))]
    tries += [F.struct(F.lit(k).alias("k"), _with_place("_v", k, F.col(f"_x{k}")).alias("v")) for k in range(len(columns))]
    rows = rows.join(given, "_row").select("_y", F.explode(F.array(*tries)).alias("t")).select("_y", "t.k", array_to_vector("t.v").alias("features"))
    scores = model.transform(rows).groupBy("k").agg(F.sqrt(F.avg((F.col("_y") - F.col("prediction")) ** 2)).alias("rmse"))
    base = scores.filter("k < 0").select(F.col("rmse").alias("base"))
    name = F.get(F.array(*map(F.lit, columns)), F.col("k"))
    return scores.filter("k >= 0").join(F.broadcast(base)).select(name.alias("feature"), (F.col("rmse") - F.col("base")).alias("importance"))  # one row


def _with_place(array: str, k: int, value):
    """The array with another value in place k."""
    return F.transform(array, lambda x, i: F.when(i == k, value).otherwise(x))


def grid_search(train: DataFrame, label: str = "y", regs=(0.0, 0.1, 1.0), nets=(0.0, 0.5), folds: int = 3, seed: int = 1, fold: str | None = None):
    """Scaled features and a linear model, chosen by cross-validation; ``fold`` names a column of fold numbers (features.fold()) to take in place of chance."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    model = LinearRegression(labelCol=label, featuresCol="scaled")
    grid = ParamGridBuilder().addGrid(model.regParam, list(regs)).addGrid(model.elasticNetParam, list(nets)).build()
    judge = RegressionEvaluator(labelCol=label, metricName="rmse")
    search = CrossValidator(estimator=Pipeline(stages=[scaler, model]), estimatorParamMaps=grid, evaluator=judge, numFolds=folds, seed=seed, parallelism=4)
    return (search if fold is None else search.setFoldCol(fold)).fit(train)


def grid_scores(spark: SparkSession, found) -> DataFrame:
    """``reg, net, rmse``: the mean RMSE over the folds of each candidate of a grid search, a row for each."""
    rows = [({p.name: v for p, v in m.items()}, s) for m, s in zip(found.getEstimatorParamMaps(), found.avgMetrics, strict=True)]
    return spark.createDataFrame([(float(m["regParam"]), float(m["elasticNetParam"]), float(s)) for m, s in rows], "reg double, net double, rmse double")


def linear_contributions(train: DataFrame, df: DataFrame, coefficients: list[float], columns: list[str]) -> DataFrame:
    """``shap_{column}``: coefficient times the distance from the training mean."""
    means = train.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    found = df.join(F.broadcast(means))  # one row
    return found.withColumns({f"shap_{c}": F.lit(float(b)) * (F.col(c) - F.col(f"_m_{c}")) for b, c in zip(coefficients, columns, strict=True)}).drop(*[f"_m_{c}" for c in columns])


def vector_means(df: DataFrame) -> DataFrame:
    return df.select(Summarizer.mean(F.col("features")).alias("mean"))


def contribution_summary(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Mean absolute contribution of each variable by group."""
    long = df.unpivot(by, [F.col(f"shap_{c}").alias(c) for c in columns], "variable", "shap")
    return long.groupBy(*by, "variable").agg(F.avg(F.abs(F.col("shap"))).alias("mean_abs"), F.avg("shap").alias("mean"))


def clusters(df: DataFrame, ks=(3, 5), months: list[int] | None = None, keys: list[str] | None = None, seed: int = 1) -> DataFrame:
    """K-means of ``features`` for several k, by month if there is a ``month`` column: ``keys, month, k, cluster``."""
    keys = keys or ["vec_id"]
    found = None
    for month in months or [None]:
        part = df if month is None else df.filter(F.col("month") == month)
        part = part.select(*keys, "features").cache()
        models = [KMeans(k=k, seed=seed, featuresCol="features", predictionCol=f"_{k}").fit(part) for k in ks]
        part.unpersist()
        for model in models:  # one after the other on the same rows, so that they are made once
            part = model.transform(part)
        labels = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_{k}").alias("cluster")) for k in ks])).alias("l")
        part = part.select(*keys, F.lit(month).cast("int").alias("month"), labels).select(*keys, "month", "l.k", "l.cluster")
        found = part if found is None else found.unionByName(part)
    return found


def clusters_by_group(df: DataFrame, ks=(3, 5), by: str = "month", keys: list[str] | None = None, steps: int = 20, seed: int = 1) -> DataFrame:
    """K-means of the array ``features`` in each group and for each k: ``keys, by, k, cluster, distance``.

    All groups and ks take their Lloyd steps together: a step is one aggregate by group, k and cluster over the rows, whose centres (groups x sum of ks of
    them) go to the driver and back as a broadcast. The k first rows of a group in a hash order are the first centres, so a group with fewer rows than k has fewer clusters; of
    equally near centres the lower number counts, and a cluster without rows keeps its centre. Ends when no centre moves, after ``steps`` at the latest.
    """
    keys = keys or ["vec_id"]
    spark, path = df.sparkSession, scratch_folder(df.sparkSession)
    df.filter(F.col("features").isNotNull()).select(*keys, by, F.col("features").cast("array<double>").alias("features")).write.parquet(path)
    points = spark.read.parquet(path)
    first = Window.partitionBy(by).orderBy(dealt_number(F.concat_ws(":", *keys), seed), *keys)  # Spark keeps the first few of each task before it deals them out
    starts = points.withColumn("_c", F.row_number().over(first)).filter(F.col("_c") <= max(ks)).select(by, "_c", "features").collect()
    now = {(r[by], k, r["_c"] - 1): list(r["features"]) for r in starts for k in ks if r["_c"] <= k}
    width = len(starts[0]["features"]) if starts else 0
    kind = points.schema[by].dataType.simpleString()

    def labelled() -> DataFrame:
        held: dict = {}
        for (group, k, c), centre in sorted(now.items(), key=lambda x: (str(x[0][0]), *x[0][1:])):
            held.setdefault((group, k), []).append((c, centre))
        rows = spark.createDataFrame([(g, k, cs) for (g, k), cs in held.items()], f"_of {kind}, k int, _centres array<struct<c:int,at:array<double>>>")
        met = points.join(F.broadcast(rows), F.col(by).eqNullSafe(F.col("_of")))
        apart = F.transform("_centres", lambda c: F.struct(F.aggregate(F.zip_with("features", c["at"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v).alias("d"), c["c"].alias("c")))
        return met.withColumn("_near", F.array_min(apart)).select(*keys, by, "k", F.col("_near.c").alias("cluster"), F.sqrt("_near.d").alias("distance"), "features")

    for _ in range(steps):
        means = F.array(*[F.avg(F.get("features", F.lit(i))) for i in range(width)]).alias("at")
        after = now | {(r[by], r["k"], r["cluster"]): list(r["at"]) for r in labelled().groupBy(by, "k", "cluster").agg(means).collect()}
        moved = max((abs(x - y) for at in now for x, y in zip(now[at], after[at], strict=True)), default=0.0)
        now = after
        if moved == 0:
            break
    return labelled().drop("features")


def principal_components(df: DataFrame, n: int = 2) -> DataFrame:
    """``pc_1`` to ``pc_n`` of ``features``."""
    found = PCA(k=n, inputCol="features", outputCol="_pc").fit(df).transform(df).withColumn("_pc", vector_to_array("_pc"))
    return found.withColumns({f"pc_{k + 1}": F.get("_pc", F.lit(k)) for k in range(n)}).drop("_pc")


def match_labels(reference: DataFrame, labels: DataFrame, column: str, keys: list[str]) -> dict[int, int]:
    """Which reference label each label stands for: the pair with the most rows first, each label once.

    Rows are counted on Spark; the counts, one for each pair of labels, are few.
    """
    counts = crosstab(labels.withColumnRenamed(column, "_a"), reference.withColumnRenamed(column, "_b"), "_a", "_b", keys)
    rows = sorted(counts.collect(), key=lambda r: (-r["n"], r["_a"], r["_b"]))
    chosen: dict[int, int] = {}
    for r in rows:
        if r["_a"] not in chosen and r["_b"] not in chosen.values():
            chosen[r["_a"]] = r["_b"]
    free = sorted({r["_b"] for r in rows} - set(chosen.values()))
    for a in sorted({r["_a"] for r in rows} - set(chosen)):
        chosen[a] = free.pop(0) if free else a
    return chosen


def match_labels_by(reference: DataFrame, labels: DataFrame, column: str, keys: list[str], by: str) -> DataFrame:
    """match_labels() inside each group of ``by``: ``by, label, stands_for``, where a label that finds none keeps its own number.

    A group has a row for each pair of labels, so each is matched in one piece.
    """
    met = labels.withColumnRenamed(column, "_a").join(reference.withColumnRenamed(column, "_b"), keys)
    counts = met.groupBy(by, "_a", "_b").agg(F.count("*").alias("n"))

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        chosen: dict[int, int] = {}
        for a, b in rows.sort_values(["n", "_a", "_b"], ascending=[False, True, True])[["_a", "_b"]].itertuples(index=False):
            if a not in chosen and b not in chosen.values():
                chosen[a] = b
        free = sorted(set(rows["_b"]) - set(chosen.values()))
        for a in sorted(set(rows["_a"]) - set(chosen)):
            chosen[a] = free.pop(0) if free else a
        return pd.DataFrame({by: rows[by].iloc[0], "label": list(chosen), "stands_for": list(chosen.values())})

    kind = dict(counts.dtypes)[by]
    return counts.groupBy(by).applyInPandas(match, f"`{by}` {kind}, label long, stands_for long")


def save_predictions(df: DataFrame, path: str, model: str) -> None:
    """Predictions of one model in a folder of its own, beside those of others."""
    df.write.mode("overwrite").parquet(f"{path}/model={model}")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
