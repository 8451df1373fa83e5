"""Joins within documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within_documents(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """Inner join of rows of one document where ``key`` of the left equals ``other`` of the right side.

    Both sides are dealt by document alone, so several such joins need one exchange and one sort of each table, and
    what one join adds does not travel to the next.  An equality of both keys would be dealt by both: hence a range of one value.
    """
    right = right.withColumnsRenamed({"document_id": "_document", other: "_other"})
    met = (F.col("document_id") == F.col("_document")) & F.col("_other").between(F.col(key), F.col(key))
    return left.join(right, met).drop("_document", "_other")
