"""Exact de-duplication with DataFrame operations only.

Texts are combined in three steps that each group by the digest *and* the full text: inside each map
task (the partial aggregate), in salted digest groups, and over the salts' winners. The salt is the
number of the map task, so a task sends one row for each of its texts, a text that fills a third of
the table reaches a salted group once a task, and the last step sees it at most once a salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import cut, free_name


def sha256(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text in UTF-8."""
    return F.sha2(text.cast("binary"), 256)


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda text: text,
    digest: Callable[[Column], Column] = sha256,
    salts: int = 64,
) -> DataFrame:
    """Every row of ``docs`` with the group of equal texts that it is in.

    Returns ``id_col, keep_id, group_size, kept, text_sha256``: one row for each input row. Two texts
    are equal when their normalised forms are identical (by default, nothing is changed); null
    counts as the empty text. The largest id of a group stays; null ids lose to any other, and in
    a group of null ids only they all stay. Repeated rows with one id stay or go together. Other
    columns of ``docs`` are not read. An empty table gives an empty result.

    Documents learn their group by digest. Should two different texts ever share a digest, the
    combining steps notice, as they compare full texts, and the lookup then goes by digest and text.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(normalise(F.col(text_col)), F.lit("")).alias("_text")
    ).withColumn("_digest", digest(F.col("_text")))
    salted = (
        rows.withColumn("_salt", F.spark_partition_id() % salts)
        .groupBy("_digest", "_text", "_salt")
        .agg(F.max("_id").alias("_keep"), F.count("*").alias("_size"))
    )
    texts = salted.groupBy("_digest", "_text").agg(F.max("_keep").alias("_keep"), F.sum("_size").alias("_size"))
    groups = cut(
        texts.groupBy("_digest").agg(
            F.max("_keep").alias("keep_id"), F.sum("_size").alias("group_size"), F.count("*").alias("_texts")
        )
    )
    if groups.filter("_texts > 1").isEmpty():
        found = rows.drop("_text").join(groups.drop("_texts"), "_digest")
        text_digest = F.col("_digest")
        if digest is not sha256:
            found, text_digest = rows.join(groups.drop("_texts"), "_digest"), sha256(F.col("_text"))
    else:
        found = rows.join(texts.withColumnsRenamed({"_keep": "keep_id", "_size": "group_size"}), ["_digest", "_text"])
        text_digest = sha256(F.col("_text"))
    return found.select(
        F.col("_id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long"),
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        text_digest.alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay of each group of equal texts.

    Rows are told apart by their ids: those that repeat an id stay or go together, and those without an id stay. Null counts as the empty text, texts are
    compared whole, other columns may have any names, and an empty table stays empty.
    """
    own = free_name(docs, "dropped_id")
    dropped = exact_groups(docs, id_col, text_col, **options).filter("not kept").select(F.col(id_col).alias(own)).distinct()
    return docs.join(dropped, docs[id_col] == dropped[own], "left_anti")
