"""Names of layers, partitions and categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def layer_name(file_name: Column, subset: Column | str) -> Column:
    """``{stem}_{subset}`` of a file name."""
    subset = F.lit(subset) if isinstance(subset, str) else subset
    return F.concat_ws("_", F.regexp_replace(F.regexp_replace(file_name, r"^.*/", ""), r"\.[^.]*$", ""), subset)


def partition_name(day: Column, variable: str) -> Column:
    """``{year}_{month}_{variable}``."""
    return F.concat_ws("_", F.year(day).cast("string"), F.month(day).cast("string"), F.lit(variable))


def clean_category(name: Column) -> Column:
    """Lower case; digits and punctuation go, what is between words becomes one underscore."""
    letters = F.regexp_replace(F.lower(name), r"[^a-z\s_/-]", "")
    return F.rtrim(F.regexp_replace(F.trim(letters), r"[\s_/-]+", "_"), F.lit("_"))
