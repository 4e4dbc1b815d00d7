"""Percentiles and places in an order over whole tables or large groups, without one task that holds a group.

Rows are dealt into ranges of the value, whose edges come from a sketch; the ranges are summed up in order (a row for each
of them), and what is left to do happens inside a range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.folders import scratch_folder

_RANGES = 256


def row_numbers(df: DataFrame, out: str = "_row") -> tuple[DataFrame, int]:
    """``df`` with a number for each row, from 0 on without gaps, and how many there are.

    The rows are written first, so that a row keeps its number whatever is computed again. Tasks number their own rows; what the tasks before them
    have is summed over one row for each task, which is also all that is broadcast.
    """
    path = scratch_folder(df.sparkSession)
    df.withColumn("_part", F.spark_partition_id()).withColumn(out, F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    spans = rows.groupBy("_part").agg(F.min(out).alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # over one row for each task
    shift = spans.select("_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    total = spans.agg(F.sum("_n")).first()[0] or 0
    return rows.join(F.broadcast(shift), "_part").withColumn(out, F.col(out) + F.col("_shift")).drop("_part", "_shift"), total


def permuted(number: Column, n: int, seed: int) -> Column:
    """Where a permutation of 0 .. n - 1, which the seed chooses, sends ``number``: computed, so no row has to know of another.

    A Feistel network on pairs (left below a, right below b) with a * b just above n: each half is moved by a hash of the other, which can be
    undone. What lands beyond n walks on along its cycle, which comes back below n after as many steps as there are numbers too many.
    """
    if n < 2:
        return number
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def moved(x: Column) -> Column:
        halves = F.struct(F.floor(x / b).cast("long").alias("left"), (x % b).cast("long").alias("right"))

        def step(s: Column, k: Column) -> Column:
            left = F.pmod(s["left"] + F.pmod(F.xxhash64(s["right"], k), F.lit(a)), F.lit(a))
            right = F.pmod(s["right"] + F.pmod(F.xxhash64(left, k + 1), F.lit(b)), F.lit(b))
            return F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"))

        rounds = F.array(*[F.lit(16 * seed + 2 * k) for k in range(4)])
        return F.aggregate(rounds, halves, step, lambda s: s["left"] * b + s["right"])

    spare = a * b - n
    if not spare:
        return moved(number)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(min(spare, 64))), moved(number), lambda x, _: F.when(x < n, x).otherwise(moved(x)))
    # of n numbers some root of n are too many, so that 64 steps beyond them in a row don't occur; should they, the job fails
    return walked if spare <= 64 else F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a number left the permutation")).cast("long"))


def stored(df: DataFrame) -> DataFrame:
    """``df``, written once and read again, so that several steps over it don't compute it again."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _dealt(df: DataFrame, value: str, by: list[str], weight: Column) -> DataFrame:
    """``df`` with ``_range``, the rows of it (``_sum``) and before it in the group (``_before``), all of the group (``_all``) and those without a value (``_nulls``), which come first.

    Reads ``df`` three times, so it should be stored. A range is found in two steps, among every 16th edge and then among the 15 that follow.
    """
    edges = F.percentile_approx(value, F.array(*[F.lit(k / _RANGES) for k in range(1, _RANGES)]), F.lit(4 * _RANGES))
    none = F.coalesce(F.sum(F.when(F.col(value).isNull(), weight)), F.lit(0))
    edges = df.groupBy(*by).agg(F.coalesce(edges, F.array()).alias("_edges"), F.sum(weight).alias("_all"), none.alias("_nulls"))
    edges = edges.withColumn("_coarse", F.filter("_edges", lambda e, i: i % 16 == 15))
    below = lambda edges: F.size(F.filter(edges, lambda e: e < F.col(value)))
    found = same_group(df, edges, by).withColumn("_step", 16 * below(F.col("_coarse")))
    number = F.col("_step") + below(F.slice("_edges", F.col("_step") + 1, F.lit(15)))
    found = found.withColumn("_range", F.when(F.col(value).isNull(), -1).otherwise(number)).drop("_edges", "_coarse", "_step")
    sums = found.groupBy(*by, "_range").agg(F.sum(weight).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_sum")  # a row for each range
    return same_group(found, sums.withColumn("_before", before), [*by, "_range"])


def same_group(df: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """Rows with those of the other table that are of their group; null is a group too."""
    if not by:
        return df.join(F.broadcast(other))  # one row
    named = other.withColumnsRenamed({c: f"_of_{c}" for c in by})
    met = df.join(named, [df[c].eqNullSafe(named[f"_of_{c}"]) for c in by])
    return met.drop(*[f"_of_{c}" for c in by])


def places(df: DataFrame, value: str, by: list[str], ties: list[str], out: str = "_place", count: str = "_all") -> DataFrame:
    """The place of each row, from 1, in its group by value and ties, nulls first; and the rows of the group."""
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(value, *ties))
    found = _dealt(stored(df), value, by, F.lit(1))
    return found.withColumn(out, F.col("_before") + inside).withColumnRenamed("_all", count).drop("_range", "_before", "_sum", "_nulls")


def places_from_both_ends(df: DataFrame, value: str, by: list[str], ties: list[str], least: str = "_least", most: str = "_most") -> DataFrame:
    """The place of each row, from 1, counted from the least value and from the most, ties in one order both ways and nulls last both ways.

    Rows are dealt once: what is above a range is the group without the range and what is below it. Both orders share the exchange by range.
    """
    inside = Window.partitionBy(*by, "_range")
    up, down = F.row_number().over(inside.orderBy(value, *ties)), F.row_number().over(inside.orderBy(F.col(value).desc(), *ties))
    found = _dealt(stored(df), value, by, F.lit(1)).withColumns({"_up": up, "_down": down})
    last = F.col("_all") - F.col("_nulls") + F.col("_up")
    places = {least: F.col("_before") - F.col("_nulls") + F.col("_up"), most: F.col("_all") - F.col("_before") - F.col("_sum") + F.col("_down")}
    found = found.withColumns({name: F.when(F.col(value).isNull(), last).otherwise(at) for name, at in places.items()})
    return found.drop("_range", "_before", "_sum", "_all", "_nulls", "_up", "_down")


def value_counts(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``by, value, _n``: how often each value stands in its group, nulls left out; stored."""
    return stored(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n")))


def average_ranks(counts: DataFrame, value: str, by: list[str], out: str = "_rank") -> DataFrame:
    """Counted values (value_counts()) with the mean of the places that a value's rows take in the group, and the rows of the group (``_all``)."""
    upto = F.sum("_n").over(Window.partitionBy(*by, "_range").orderBy(value))
    dealt = _dealt(counts, value, by, F.col("_n")).withColumn(out, F.col("_before") + upto - (F.col("_n") - 1) / 2)
    return dealt.select(*by, value, "_n", out, "_all")


def percentiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact percentiles, linear between values, of each group: ``by`` and a column for each of ``shares``.

    Equal values are counted first. A group without a value has no row; without groups the row of an empty table has nulls.
    """
    return percentiles_of_counts(value_counts(df, value, by or []), value, shares, by or [])


def percentiles_of_counts(counts: DataFrame, value: str, shares: dict[str, float], by: list[str]) -> DataFrame:
    """percentiles() of counted values (value_counts())."""
    dealt = _dealt(counts, value, by, F.col("_n"))
    wanted = [F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), at(F.lit(q) * (F.col("_all") - 1)).cast("long").alias("at")) for name, q in shares.items() for side, at in (("low", F.floor), ("high", F.ceil))]
    held = dealt.select(*by, "_range", "_before", "_all", "_sum").distinct()
    hit = held.withColumn("_w", F.explode(F.array(*wanted))).filter("_w.at >= _before and _w.at < _before + _sum")
    hit = hit.select(*by, "_range", "_w").groupBy(*by, "_range").agg(F.collect_list("_w").alias("_ws"))  # two for each share at most
    inside = F.sum("_n").over(Window.partitionBy(*by, "_range").orderBy(value))
    upto = same_group(dealt, hit, [*by, "_range"]).withColumn("_upto", F.col("_before") + inside)
    picked = upto.withColumn("_w", F.explode("_ws")).filter("_w.at < _upto and _w.at >= _upto - _n")
    ends = {(name, side): F.max(F.when((F.col("_w.name") == name) & (F.col("_w.side") == side), F.col(value))) for name in shares for side in ("low", "high")}
    columns = []
    for name, q in shares.items():
        at = F.lit(q) * (F.max("_all") - 1)
        low, high = ends[name, "low"].cast("double"), ends[name, "high"].cast("double")
        columns.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return picked.groupBy(*by).agg(*columns)
