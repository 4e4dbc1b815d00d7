"""What the operators need from the session: a shared folder to cut lineage in."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of so many rows of a few numbers each are sent to every executor; larger ones meet others in a shuffle.
FEW = 1 << 18


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Where that is unset, one machine gets a temporary folder (as in tests); on a cluster that is an error, as each executor
    would write to a disk of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cubeloom-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder: unlike a checkpoint, its size is known to the planner."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Workspace:
    """A folder for tables that one operator writes and reads again, and can delete when its result no longer needs them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/work-{uuid.uuid4().hex}", 0

    def stored(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``df``, marked for a broadcast where it, or the table ``of`` that has as many rows at least, has at most FEW."""
    return F.broadcast(df) if (df if of is None else of).count() <= FEW else df


_kept: list[Callable] = []


def worker_cache(make: Callable) -> Callable:
    """``make``, of which a Python worker keeps the last results for all its tasks, until release_caches()."""
    _kept.append(functools.lru_cache(maxsize=2)(make))
    return _kept[-1]


def release_caches() -> None:
    """Drop what a Python worker keeps from tasks of other operators: it outlives them, and with it a tokenizer's cache."""
    for make in _kept:
        make.cache_clear()
    pa.default_memory_pool().release_unused()


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name like ``wanted`` with which no column of ``df`` begins."""
    while any(c.lower().startswith(wanted.lower()) for c in df.columns):
        wanted = f"{wanted}_"
    return wanted
