"""Training examples: sliding windows over a dense monthly cube, splits, and feature blocks.

An example is a cell and a target month with the values of the months before it as columns ``{variable}_t{k}``; windows
never copy the cube, as lags are columns of one pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import month_index
from ..functions.numeric import ratio
from ..sources.cubes import PIXEL, densify
from .aggregates import norm_table, static_means
from .masks import standardise
from .windows import previous_year

FILL = -9999.0


def _lagged(df: DataFrame, target: str, predictors: list[str], pred_months: int, keys, time: str) -> DataFrame:
    df = densify(df, keys, time)
    w = Window.partitionBy(*keys).orderBy("_m")
    # the months that the cube has before a target month, inside its window, whether or not a cell has values there
    df = df.withColumn("_m", month_index(F.col(time)))
    at = lambda v, k: F.max(F.when(F.lit(True), F.col(v))).over(w.rangeBetween(-k, -k))
    lags = {f"{v}_t{k}": at(v, k) for v in predictors for k in range(1, pred_months + 1)}
    n = F.count(F.lit(1)).over(w.rangeBetween(-pred_months, -1))
    return df.withColumns(lags | {"_x_months": n, "y": F.col(target)})


def one_month_examples(
    df: DataFrame, target: str, predictors: list[str], pred_months: int = 11, expected: int | None = None, keys=PIXEL, time: str = "time"
) -> DataFrame:
    """Examples that forecast a month from those before: ``target_month``, lags 1 to ``pred_months`` of each predictor, ``y``.

    A month is a target when the cube has ``expected`` months in its window (None: at least one).
    """
    found = _lagged(df, target, predictors, pred_months, keys, time)
    enough = F.col("_x_months") == expected if expected is not None else F.col("_x_months") > 0
    names = [f"{v}_t{k}" for v in predictors for k in range(1, pred_months + 1)]
    return found.filter(enough).select(*keys, F.col(time).alias("target_month"), *names, "y")


def nowcast_examples(
    df: DataFrame, target: str, predictors: list[str], pred_months: int = 11, expected: int | None = None, keys=PIXEL, time: str = "time"
) -> DataFrame:
    """As one_month_examples(), with the other predictors of the target month itself as ``{v}_t0`` and a fill for the target's."""
    found = _lagged(df, target, predictors, pred_months, keys, time)
    enough = F.col("_x_months") == expected if expected is not None else F.col("_x_months") > 0
    now = [F.lit(FILL).alias(f"{v}_t0") if v == target else F.col(v).alias(f"{v}_t0") for v in predictors]
    names = [f"{v}_t{k}" for v in predictors for k in range(1, pred_months + 1)]
    return found.filter(enough).select(*keys, F.col(time).alias("target_month"), *now, *names, "y")


def split_by_year(examples: DataFrame, test_years: list[int], month: str = "target_month") -> DataFrame:
    """``split``: test in the test years, train before the first of them; other months go."""
    year = F.year(month)
    split = F.when(year.isin(test_years), "test").when(year < min(test_years), "train")
    return examples.withColumn("split", split).filter(F.col("split").isNotNull())


def pixel_code(n_lon: int) -> Column:
    return (F.col("lat_idx") * n_lon + F.col("lon_idx")).cast("int")


def static_features(df: DataFrame, values: list[str], test_years: list[int], keys=PIXEL, time: str = "time") -> DataFrame:
    """Means of each cell and of all, standardised over the cells; deviations of 0 count as 1."""
    means = static_means(df, values, test_years, keys, time)
    names = [c for c in means.columns if c not in keys]
    norm = norm_table(means, names).withColumn("std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))
    return standardise(means, norm, names)


def yearly_aggregates(examples: DataFrame, predictors: list[str], pred_months: int) -> DataFrame:
    """``{v}_mean``: the mean of each predictor over an example's window, nulls aside."""
    means = {}
    for v in predictors:
        lags = [F.col(f"{v}_t{k}") for k in range(1, pred_months + 1)]
        total = sum((F.coalesce(c, F.lit(0.0)) for c in lags), F.lit(0.0))
        means[f"{v}_mean"] = F.try_divide(total, sum((c.isNotNull().cast("int") for c in lags), F.lit(0)))
    return examples.withColumns(means)


def one_hot_months(examples: DataFrame, month: str = "target_month") -> DataFrame:
    """``month_1`` to ``month_12``."""
    return examples.withColumns({f"month_{k}": (F.month(month) == k).cast("int") for k in range(1, 13)})


def one_hot_locations(code: Column, n: int) -> Column:
    """A vector of n - 1 places; the first location is all zeros."""
    return F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda k: (k == code).cast("int"))


def with_previous_year(examples: DataFrame, keys=PIXEL) -> DataFrame:
    """``prev_y``: y of the same month a year before, in the same split; 0 where that example doesn't exist."""
    return previous_year(examples, "y", "prev_y", keys, "target_month", ("split",))


def complete(examples: DataFrame, columns: list[str]) -> DataFrame:
    return examples.dropna("any", subset=columns)


def feature_vector(examples: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """The columns as one vector, in the order given."""
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="skip").transform(examples)


def dealt_number(key: Column, seed: int) -> Column:
    """A number below 2**32 that the key's text and the seed decide."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")


def validation_mask(examples: DataFrame, ratio: float = 0.1, seed: int = 1, month: str = "target_month") -> DataFrame:
    """``validation``: whole months, chosen by a hash of the month."""
    chosen = dealt_number(F.col(month), seed) % 1000 < int(1000 * ratio)
    return examples.withColumn("validation", chosen)


def fold(examples: DataFrame, keys: list[str], folds: int = 3, seed: int = 1, out: str = "fold") -> DataFrame:
    """``out``: a fold number that a hash of the keys decides, so that an example keeps its fold whatever the partitions or the other rows."""
    return examples.withColumn(out, (dealt_number(F.concat_ws(":", *keys), seed) % folds).cast("int"))


def binned(df: DataFrame, columns: list[str], bins: int = 16) -> DataFrame:
    """Each column's equal-width bin, from 0.0, in place of its value; a column of one value is bin 0, nulls stay."""
    ends = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("a", F.min), ("b", F.max))])
    found = df.join(F.broadcast(ends))  # one row
    place = lambda c: F.coalesce(F.floor(bins * ratio(F.col(c) - F.col(f"_a_{c}"), F.col(f"_b_{c}") - F.col(f"_a_{c}"))), F.lit(0))
    return found.withColumns({c: F.when(F.col(c).isNotNull(), F.least(place(c), F.lit(bins - 1)).cast("double")) for c in columns}).drop(*ends.columns)


def feature_subsets(groups: dict[str, list[str]], least: int = 1) -> list[tuple[str, list[str]]]:
    """Every combination of groups of columns, by name."""
    names = sorted(groups)
    found = [c for n in range(least, len(names) + 1) for c in combinations(names, n)]
    return [("+".join(c), [x for g in c for x in groups[g]]) for c in found]


def moments(df: DataFrame, columns: list[str], by: Column) -> dict:
    """Counts, sums and sums of products of ``columns``, by the value of ``by``, from one aggregate.

    A row for each value of ``by`` comes to the driver, of d * d numbers for d columns, whatever the number of rows. Rows
    with a null in a column are left out.
    """
    rows = df.dropna(subset=columns).select(by.alias("_by"), *[F.col(c).cast("double").alias(c) for c in columns])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    products = F.array(*[F.sum(F.col(columns[i]) * F.col(columns[j])) for i, j in pairs])
    found = {}
    for r in rows.groupBy("_by").agg(F.count("*").alias("n"), F.array(*map(F.sum, columns)).alias("s"), products.alias("p")).collect():
        gram = np.zeros((len(columns), len(columns)))
        for (i, j), v in zip(pairs, r["p"], strict=True):
            gram[i, j] = gram[j, i] = v
        found[r["_by"]] = r["n"], np.array(r["s"]), gram
    return found


def standard_gram(part: tuple, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Means of products of a constant and the columns less ``mean`` over ``std``, from their moments."""
    n, total, gram = part
    out = np.ones((len(mean) + 1, len(mean) + 1))
    out[0, 1:] = out[1:, 0] = (total - n * mean) / std / n
    out[1:, 1:] = (gram - np.outer(total, mean) - np.outer(mean, total) + n * np.outer(mean, mean)) / np.outer(std, std) / n
    return out


def swept(a: np.ndarray, k: int) -> np.ndarray:
    """The matrix with column k swept in: least squares on the columns swept so far stand in the others."""
    d, row = a[k, k], a[k]
    out = a - np.outer(a[:, k], row) / d
    out[k], out[:, k] = row / d, a[:, k] / d
    out[k, k] = -1 / d
    return out


@dataclass
class SubsetFit:
    """A subset of groups of columns, its least-squares fit on the training rows and its scores on the test rows."""

    name: str
    columns: list[str]
    coefficients: list[float]
    intercept: float
    rmse: float
    r2: float | None
    n: int


def subset_fits(df: DataFrame, groups: dict[str, list[str]], label: str = "y", split: str = "split", least: int = 1) -> list[SubsetFit]:
    """Linear fits of ``label`` on every combination of groups of columns, trained where ``split`` is train and scored where it is test.

    One aggregate over the rows gives the products of all columns; everything else is that matrix. Groups are swept in one after the other, each
    combination from the one it extends, so 2 ** n fits take as many sweeps. A column that the others already determine
    keeps the coefficient 0.
    """
    columns = [c for g in sorted(groups) for c in groups[g]]
    found = moments(df, [*columns, label], F.col(split))
    if "train" not in found:
        raise ValueError("there are no rows to train on")
    n, total, gram = found["train"]
    mean = total / n
    std = np.sqrt(np.maximum(np.diag(gram) / n - mean**2, 0))
    std[std < 1e-12] = 1.0
    start, test = standard_gram(found["train"], mean, std), found.get("test")
    check = standard_gram(test, mean, std) if test else None
    place = {c: k + 1 for k, c in enumerate(columns)}
    y, out, names = len(columns) + 1, [], sorted(groups)

    def grow(a: np.ndarray, at: int, chosen: list[str], used: list[str]) -> None:
        if len(chosen) >= least:
            b = np.zeros(y + 1)
            b[0], b[[place[c] for c in used]], b[y] = -a[0, y], [-a[place[c], y] for c in used], 1.0
            sse = float(b @ check @ b * std[-1] ** 2) if check is not None else float("nan")
            sst = float((check[y, y] - check[0, y] ** 2) * std[-1] ** 2) if check is not None else 0.0
            every = [c for g in chosen for c in groups[g]]
            slopes = [float(-b[place[c]] * std[-1] / std[place[c] - 1]) for c in every]
            base = float(mean[-1] - b[0] * std[-1] - sum(s * mean[place[c] - 1] for s, c in zip(slopes, every, strict=True)))
            out.append(SubsetFit("+".join(chosen), every, slopes, base, max(sse, 0.0) ** 0.5, 1 - sse / sst if test and test[0] > 1 and sst > 1e-12 else None, test[0] if test else 0))
        for k in range(at, len(names)):
            b, more = a, []
            for c in groups[names[k]]:
                if b[place[c], place[c]] > 1e-10:
                    b, more = swept(b, place[c]), [*more, c]
            grow(b, k + 1, [*chosen, names[k]], used + more)

    grow(swept(start, 0), 0, [], [])
    return out


def subset_scores(df: DataFrame, groups: dict[str, list[str]], label: str = "y", split: str = "split", least: int = 1) -> DataFrame:
    """``model, rmse, r2, n`` of subset_fits(): a row for each combination of groups."""
    rows = [(f.name, f.rmse, f.r2, f.n) for f in subset_fits(df, groups, label, split, least)]
    return df.sparkSession.createDataFrame(rows, "model string, rmse double, r2 double, n long")


def training_periods(years: DataFrame, test: int, train: int, test_tercile: str, train_tercile: str, seed: int = 1) -> DataFrame:
    """``year, role``: years drawn from terciles (see windows.terciles) for test and training, which never overlap.

    Years are in a random order that the seed fixes. Training is filled up from years left over if its tercile is short.
    """
    order = dealt_number(F.col("year"), seed)
    everything = Window.partitionBy()  # over one row for each year
    rows = years.withColumn("_o", order).withColumn("_t", F.row_number().over(Window.partitionBy("tercile").orderBy("_o", "year")))
    rows = rows.withColumn("_test", (F.col("tercile") == test_tercile) & (F.col("_t") <= test))
    preferred = F.when(F.col("_test"), 2).when(F.col("tercile") == train_tercile, 0).otherwise(1)
    rows = rows.withColumn("_p", F.row_number().over(everything.orderBy(preferred, "_o", "year")))
    role = F.when(F.col("_test"), "test").when(F.col("_p") <= train, "train")
    return rows.withColumn("role", role).filter(F.col("role").isNotNull()).select("year", "tercile", "role")


