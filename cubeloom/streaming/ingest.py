"""Monthly means kept up to date from files as they arrive.

Every batch of new files is added to sums and counts by cell and month, which are stored by batch number, so that a batch
that runs twice replaces itself. Means read from the sums equal those of a batch job over the same files, however late a
file comes; the watermark variant gives each month once it can no longer change, and what comes too late for that can be merged in afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, DoubleType, LongType, StructField, StructType


def _open(spark: SparkSession, raw: str, schema: StructType, files_each: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(raw)


def start_monthly_sums(
    spark: SparkSession, raw: str, schema: StructType, folder: str, checkpoint: str, value: str, keys=("pixel_id",), time: str = "time", files_each: int = 8
) -> StreamingQuery:
    """Add the new files of ``raw`` to the sums in ``folder`` and stop when there are no more; files done before are not read."""

    def add(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(*keys, F.last_day(time).alias(time)).agg(F.sum(value).alias("total"), F.count(value).alias("n"))
        sums.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream = _open(spark, raw, schema, files_each).writeStream.foreachBatch(add)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monthly_means(spark: SparkSession, folder: str, keys=("pixel_id",), time: str = "time") -> DataFrame:
    """The means as of the batches so far."""
    sums = spark.read.parquet(folder).groupBy(*keys, time).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return sums.select(*keys, time, F.try_divide("total", "n").alias("mean"))


def start_final_means(
    spark: SparkSession, raw: str, schema: StructType, folder: str, checkpoint: str, value: str, keys=("pixel_id",), time: str = "time",
    late: str = "40 days", files_each: int = 8,
) -> StreamingQuery:
    """Write each month's means once, when the watermark has passed the month by ``late``, which must be longer than a month.

    Each row of ``folder`` says from how many values (``n``) and rows (``rows``) its mean comes. Sums of open months are the stream's state, which lies with the
    checkpoint: a run that is started again goes on where the last one ended. Rows that come after their month was given out no longer
    change it; late_rows() counts them.
    """
    rows = _open(spark, raw, schema, files_each).withColumn("_at", F.to_timestamp(F.last_day(time))).withWatermark("_at", late)
    means = rows.groupBy(*keys, "_at").agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.count("*").alias("rows"))
    stream = means.select(*keys, F.to_date("_at").alias(time), "mean", "n", "rows").writeStream.outputMode("append").format("parquet")
    return stream.option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(spark: SparkSession, raw: str, schema: StructType, folder: str, keys=("pixel_id",), time: str = "time") -> DataFrame:
    """``keys, time, mean, n, late`` of all months up to the last that start_final_means() has given out: its means, and how many rows came too late for them.

    A month of which every row came too late has a null mean and 0 values.
    """
    final = spark.read.schema(StructType([*(schema[k] for k in keys), StructField(time, DateType()), StructField("mean", DoubleType()), StructField("n", LongType()), StructField("rows", LongType())])).parquet(folder)
    last = final.agg(F.max(time).alias("_last"))  # one row
    came = spark.read.schema(schema).parquet(raw).groupBy(*keys, F.last_day(time).alias(time)).agg(F.count("*").alias("_came"))
    closed = came.join(F.broadcast(last), F.col(time) <= F.col("_last")).join(final, [*keys, time], "left")
    return closed.select(*keys, time, "mean", F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.col("_came") - F.coalesce("rows", F.lit(0))).cast("long").alias("late"))


def amended_means(spark: SparkSession, raw: str, schema: StructType, folder: str, value: str, keys=("pixel_id",), time: str = "time") -> DataFrame:
    """``keys, time, mean, n, amended``: the months that start_final_means() has given out, those with late rows computed again from all their rows.

    Only rows of amended months are aggregated; what was given out in time is taken as it stands. The folder isn't changed, so a reader of the first
    edition and one of the amended means can work side by side.
    """
    given = late_rows(spark, raw, schema, folder, keys, time)
    late = given.filter("late > 0").select(*keys, time)
    rows = spark.read.schema(schema).parquet(raw).withColumn(time, F.last_day(time))
    again = rows.join(late, [*keys, time], "left_semi").groupBy(*keys, time).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    kept = given.filter("late = 0").select(*keys, time, "mean", "n", F.lit(False).alias("amended"))
    return kept.unionByName(again.withColumn("amended", F.lit(True)))
