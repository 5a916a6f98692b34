"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after deleting white space (U+0020, U+0009-U+000D).  The first
read keeps only a length and the hash of a short prefix of each text; groups of one length, then
of one prefix hash, that hold one text are done.  The full content is read (hashed with sha-256)
only for rows of the groups that are left.  Rows of a text with a million copies never meet in
one task: groups are counted with partial aggregation and written, then joined back as narrow
rows, by broadcast within the limit of ``bounded`` and else by a join that Spark splits when skewed.

Null texts count as empty, and all empty ones are equal.  Of equal texts the one with the most
code points stays, then the smallest doc_id (a null doc_id loses to any other).  Rows that
repeat a doc_id with an equal text are marked alike; ``drop_exact_duplicates`` keeps one of them.
A doc_id on several different texts says nothing: rows are told apart by doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, bounded, text_key, without_rows

#: The characters deleted before texts are compared.
WHITE = " \t\n\u000b\f\r"
PREFIX = 64
_LENGTH, _PREFIX, _FULL = "norm_length", "prefix_hash", "text_sha256"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def _signatures(docs: DataFrame, digests: bool) -> DataFrame:
    norm = docs.select("doc_id", text_key().alias("t"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), normalised(F.col("text")).alias("norm"))
    full = [F.sha2(F.col("norm").cast("binary"), 256).alias(_FULL)] if digests else []
    return norm.select("doc_id", "t", "n_chars", F.octet_length("norm").alias(_LENGTH), F.xxhash64(F.substring("norm", 1, PREFIX)).alias(_PREFIX), *full)


def _shared(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)


def _hashed(docs: DataFrame, scratch: Scratch, digests: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, n_chars, length, prefix hash, full hash) of rows whose length and prefix occur twice, and of the others."""
    rows = scratch.write(_signatures(docs, digests), "signatures")
    by_length = rows.join(bounded(_shared(rows, _LENGTH)), _LENGTH, "left_semi")
    suspects = bounded(scratch.write(_shared(by_length, _LENGTH, _PREFIX), "suspects"))
    key = [_LENGTH, _PREFIX]
    alone = rows.join(suspects, key, "left_anti")
    if digests:
        return rows.join(suspects, key, "left_semi"), alone
    again = docs.select("doc_id", text_key().alias("t"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), normalised(F.col("text")).alias("norm"))
    again = again.select("doc_id", "t", "n_chars", F.octet_length("norm").alias(_LENGTH), F.xxhash64(F.substring("norm", 1, PREFIX)).alias(_PREFIX), "norm")
    again = again.join(suspects, key, "left_semi").select("doc_id", "t", "n_chars", *key, F.sha2(F.col("norm").cast("binary"), 256).alias(_FULL))
    return scratch.write(again, "hashed"), alone.withColumn(_FULL, F.lit(None).cast("string"))


def _order() -> list[Column]:
    """Smallest: the row that stays."""
    return [(-F.col("n_chars")).alias("minus"), F.col("doc_id").isNull().alias("none"), F.col("doc_id")]


def exact_duplicates(docs: DataFrame, scratch: Scratch, digests: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row.

    ``digests``: the caller wants the full hash of every row, so the first read makes it; otherwise it is
    null for rows that a length or a prefix sets apart.
    """
    hashed, alone = _hashed(docs, scratch, digests)
    key = [_LENGTH, _PREFIX, _FULL]
    groups = hashed.groupBy(*key).agg(F.min(F.struct(*_order())).alias("best"), F.count("*").alias("group_size"))
    keep = F.col("best.doc_id")
    members = hashed.join(bounded(scratch.write(groups, "groups")), key).select(
        "doc_id",
        keep.alias("keep_id"),
        "group_size",
        (F.col("doc_id").eqNullSafe(keep) & (F.col("n_chars") == -F.col("best.minus"))).alias("kept"),
        _FULL,
    )
    single = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), _FULL)
    return members.unionByName(single)


def drop_exact_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; what length and prefix set apart is not hashed in full."""
    hashed, _ = _hashed(docs, scratch, False)
    key = [_LENGTH, _PREFIX, _FULL]
    shared = bounded(scratch.write(_shared(hashed, *key), "shared"))
    rows = hashed.join(shared, key, "left_semi").select("doc_id", "t", "n_chars", F.struct(*key).alias("group"))
    return without_rows(docs, scratch.write(rows, "copies"), F.struct(*_order(), "t"), scratch)
