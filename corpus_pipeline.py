"""From raw documents to packed training sequences, in five stages.

Documents of poor quality go, then exact copies, then near copies; sources are mixed to their target weights (small
sources are repeated, nothing is dropped); what is left is packed into sequences. Each stage is written as Parquet to
the cluster's shared folder and read again by the next, so a lost executor costs the tasks that it ran.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cubeloom.llm.exact_dedup import exact_dedup
from cubeloom.llm.jaccard_join import drop_near_duplicates
from cubeloom.llm.line_labels import fit_line_labels, keep_quality
from cubeloom.llm.mixing import mix_sources
from cubeloom.llm.packing import pack_best_fit
from cubeloom.llm.session import shared_folder
from cubeloom.shipping import shipped


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the field is fitted on the labelled ones among ``docs``.

    Null and empty texts have no words and go; null ids and repeated rows are judged like any other; without labels of both
    kinds only the base rules count; an empty table stays empty. Columns besides ``doc_id`` and ``text`` are kept as they are.
    """
    return keep_quality(docs, fit_line_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays.

    Null counts as the empty text; rows without an id stay, rows that repeat the id of one that stays stay with it; an empty
    table stays empty. Other columns are kept as they are.
    """
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of a similarity of 0.8 or more connect, that with the smallest id stays.

    Texts without a word, rows without an id, and rows that repeat the id of one that stays, stay; an empty table stays empty.
    Other columns are kept as they are.
    """
    return drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks, once at least, in the order of reading.

    Null sources are one source of their own, null texts count as one token, rows that repeat an id are read alike; an empty
    table stays empty. Other columns are kept as they are.
    """
    return mix_sources(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens.

    A null text is one piece of one token; null ids stay null, repeated rows are packed each for itself; an empty table gives no
    rows.
    """
    return pack_best_fit(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", shipped(quality_stage)),
    ("exact dedup", shipped(exact_stage)),
    ("n-gram Jaccard join", shipped(near_stage)),
    ("mixing sources to target weights", shipped(mixing_stage)),
    ("best-fit packing", shipped(packing_stage)),
]

#: Tokenisation, the fitted field and the links have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, one after the other. An empty table gives no rows."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
