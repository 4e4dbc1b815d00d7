"""Merkle manifest of a table, level by level, with DataFrame operations.

Leaves are numbered inside their group. At each level a node computes the indices of its siblings (its slot in the run plus
1, 2, ... modulo the fan-out; with a fan-out of two that is XOR with one), and an equijoin on group and index fetches their digests;
the rows in slot zero, which then know their whole run, emit the parents. What a node got from its siblings is also its part of
the proofs of all leaves below it, which run down again by the same indices. A level has a third of the rows of the one
below it, so both ways together handle three rows a leaf; a group that holds most leaves spreads by its indices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import Workspace, cut

FANOUT = 3
PATH = "array<struct<before:binary,after:binary>>"


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    """SHA-256 of a row's fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def joined_digest(digests: Column) -> Column:
    """SHA-256 over digests that stand one after the other, each as lowercase hex text; 32 bytes."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)).cast("binary"), 256))


def numbered(rows: DataFrame, order: list[str], work: Workspace) -> DataFrame:
    """``rows`` with ``idx``, the place (from 0) in its ``grp`` by ``order`` (nulls first).

    Rows are dealt into ranges of group and order, so a large group fills many tasks. Each task numbers its own rows; what stands before them in
    their group is summed over one row for each task and group. Ties share a range and get places in the order met, once
    and for all, as the table is written.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = work.stored(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    spans = dealt.groupBy("grp", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("grp", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return dealt.join(spans, ["grp", "_part"]).withColumn("idx", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def with_siblings(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``grp, idx, digest`` with the siblings' digests ``before`` and ``after`` each node, one after the other."""
    slot, none = F.col("idx") % fanout, F.lit(b"")
    found = nodes.select("grp", "idx", "digest")
    for k in range(1, fanout):
        other = nodes.select("grp", F.col("idx").alias("_at"), F.col("digest").alias(f"_sibling_{k}"))
        found = found.withColumn("_at", F.col("idx") - slot + (slot + k) % fanout).join(other, ["grp", "_at"], "left").drop("_at")
    placed = [F.coalesce(*[F.when((slot + k) % fanout == j, F.col(f"_sibling_{k}")) for k in range(1, fanout)], none) for j in range(fanout)]
    before = F.concat(*[F.when(slot > j, placed[j]).otherwise(none) for j in range(fanout)])
    after = F.concat(*[F.when(slot < j, placed[j]).otherwise(none) for j in range(fanout)])
    return found.select("grp", "idx", "digest", before.alias("before"), after.alias("after"))


def merkle_paths(nodes: DataFrame, work: Workspace, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """Trees over ``grp, idx, digest``: the roots as ``grp, root``, and for each leaf ``grp, idx, path``.

    While a group has several nodes, each run of ``fanout`` consecutive ones (the last may be shorter, even a single one) becomes one
    node. A path holds the siblings of the leaf and of its ancestors, from below. A group of one leaf is its own root.
    Every level is written, so a lost executor costs tasks of one level.
    """
    levels, roots = [], []
    alone = (F.col("idx") == 0) & (F.length("after") == 0)
    last = nodes.agg(F.max("idx")).first()[0] or 0
    while not levels or last > 0:
        last //= fanout if levels else 1
        level = work.stored(with_siblings(nodes, fanout))
        levels.append(level)
        roots.append(level.filter(alone).select("grp", F.col("digest").alias("root")))
        whole = F.concat("digest", "after")
        first = level.filter((F.col("idx") % fanout == 0) & ~alone)
        nodes = first.select("grp", F.floor(F.col("idx") / fanout).alias("idx"), joined_digest(whole).alias("digest"))
    paths = None
    for level in reversed(levels):
        own = F.array(F.struct("before", "after"))
        ends = level.filter(alone).select("grp", "idx", F.array().cast(PATH).alias("path"))
        if paths is not None:
            above = paths.select("grp", F.col("idx").alias("_up"), F.col("path").alias("_above"))
            below = level.filter(~alone).withColumn("_up", F.floor(F.col("idx") / fanout)).join(above, ["grp", "_up"])
            ends = ends.unionByName(below.select("grp", "idx", F.concat(own, F.col("_above")).alias("path")))
        paths = ends
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return work.stored(found), paths


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda digest, step: joined_digest(F.concat(step["before"], digest, step["after"])))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings on the path, from below, as lowercase hex."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.lower(F.hex(F.concat(step["before"], step["after"])))), "").cast("binary"), 256)


def merkle_manifest(rows: DataFrame, group: Column, order: list[Column], leaf: Column, work: Workspace, fanout: int = FANOUT) -> DataFrame:
    """All columns of ``rows`` with ``leaf``, ``subroot`` and ``root`` (32 bytes each) and ``path``, the siblings from the leaf up to the root.

    Leaves of a group ascend by ``order``, nulls first, ties by the leaf's digest (rows that tie in both are alike); groups ascend by their names' UTF-8 bytes, null first.
    An empty table has no leaves and no root. The rows come with the leaves through one write, so select what is needed first. Tables lie in ``work``.
    """
    named = F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))
    wanted = [leaf.alias("leaf"), *[o.alias(f"_order_{k}") for k, o in enumerate(order)]]
    leaves = numbered(rows.select("*", named.alias("grp"), *wanted), [*[f"_order_{k}" for k in range(len(order))], "leaf"], work)
    leaves = work.stored(leaves.drop(*[f"_order_{k}" for k in range(len(order))]))
    subroots, paths = merkle_paths(leaves.select("grp", "idx", F.col("leaf").alias("digest")), work, fanout)
    tops = numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("digest")), ["name"], work)
    tops = work.stored(tops)
    root, upper = merkle_paths(tops.select("grp", "idx", "digest"), work, fanout)
    upper = tops.join(upper, ["grp", "idx"]).join(root, "grp")
    upper = work.stored(upper.select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), "root", F.col("path").alias("_upper")))
    found = leaves.join(paths, ["grp", "idx"]).join(upper, "grp")
    return found.withColumn("path", F.concat("path", "_upper")).drop("grp", "idx", "_upper")


def manifest_audit(docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """The manifest of ``docs`` by source, and each row held against it after tampering.

    Reads ``doc_id, source, lang, n_chars, text`` only, so other columns may have any name. ``tampered`` says which rows are altered
    (by default where two divides the CRC-32 of the decimal id): their line feeds go. Returns ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``,
    one row for each row of ``docs``. Null fields have a mark of their own in the leaf, so null and empty text differ; null ids come first and
    are not tampered with; a null source is a group of its own, before the others; rows that repeat an id stand next to each other, by digest. A text of
    any length is hashed whole. An empty table gives no rows.
    """
    if tampered is None:
        tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    spark, fields = docs.sparkSession, ["doc_id", "source", "lang", "n_chars"]
    work = Workspace(spark)
    after = F.when(F.coalesce(tampered, F.lit(False)), F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = docs.select("doc_id", "source", row_digest(*[F.col(c) for c in fields], after).alias("met"), row_digest(*[F.col(c) for c in [*fields, "text"]]).alias("own"))
    known = merkle_manifest(rows, F.col("source"), [F.col("doc_id")], F.col("own"), work, fanout)
    text = lambda c: F.lower(F.hex(c))
    found = known.select("doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), text(folded(F.col("path"), F.col("met"))).alias("folded_root"))
    found = cut(found.withColumn("verified", F.col("folded_root") == F.col("root")))
    work.drop()
    return found
