"""Folds of labelled documents, and bounded samples of them to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """crc32 of the id as text; rows without an id are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(True))


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label): one row for each labelled document outside the held-out fold, label 0 or 1."""
    rows = labels.where(F.col(label).isin(0, 1) & ~held_out())
    return rows.groupBy("doc_id").agg(F.max(label).alias("label"))


def sample(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, by a hash of their id: the same ones each time.

    A threshold from a count leaves little more than ``most`` rows before they are sorted, however many partitions there are.
    """
    n = rows.count()
    share = (most + 8 * most**0.5 + 8) / max(n, 1)
    h = F.xxhash64("doc_id")
    if share < 1:
        rows = rows.where(h < int((2 * share - 1) * 2**63))
    return rows.orderBy(h, "doc_id").limit(most)
