"""Connected components of an edge table, by alternating stars, all on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import Workspace, cut, few

#: Edges that a task makes stars of at once.
_BLOCK = 1 << 20


def _forest(v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id that some edges connect an id with, and the id, for each id but the least ones."""
    ids, at = np.unique(np.concatenate([v, u]), return_inverse=True)
    a, b = at[: len(v)], at[len(v) :]
    own = np.arange(len(ids))
    root = own
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        root = root.copy()
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    rest = root != own
    return ids[root[rest]], ids[rest]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges ``v, u`` that connect what those of a block connect, each id with the least one."""
    parts, held = [], 0

    def made() -> pa.RecordBatch:
        v, u = _forest(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(v), pa.array(u)], ["v", "u"])

    for batch in batches:
        parts.append([batch.column(k).to_numpy() for k in (0, 1)])
        held += len(batch)
        if held >= _BLOCK:
            yield made()
            parts, held = [], 0
    if held:
        yield made()


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) for every id in the edges ``a, b``.

    Edges become stars around the smallest id, block by block. Then each step hangs neighbours under the smallest id that is
    near: first the larger neighbours of every id, then it and its smaller ones. It ends when each id has either larger neighbours only or a
    single one, which is smaller. Minima come from partial
    aggregates, so an id with very many neighbours is never gathered. Repeated edges and those of an id with itself make no difference, edges with a
    null are left out, and without edges nothing is returned. Each step's edges are written and the last step's deleted.
    """
    work = Workspace(edges.sparkSession)
    now = edges.select(F.least("a", "b").cast("long").alias("v"), F.greatest("a", "b").cast("long").alias("u")).filter("u > v")
    now = work.stored(now.mapInArrow(_stars, "v long, u long"))
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        near = both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
        near = work.stored(near.selectExpr("u", "least(low, u) m", "low < u and low < high open"))
        if near.filter("open").isEmpty():
            break
        large = both.join(few(near.select("u", "m")), "u").filter("v > u").select(F.col("m").alias("v"), F.col("v").alias("u"))
        before, work = work, Workspace(edges.sparkSession)
        large = work.stored(large.filter("u > v").distinct())
        least = work.stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(few(least), "u")
        small = small.select(F.col("m").alias("v"), F.explode(F.array("u", "v")).alias("u"))
        now = work.stored(small.filter("u > v").mapInArrow(_stars, "v long, u long"))
        before.drop()
    found = cut(near.selectExpr("u id", "m component"))
    work.drop()
    return found
