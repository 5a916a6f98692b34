"""Replicated logs (region_id, idx, term, size): append, fetch, gaps, compaction and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new batch wins and cuts the log: what the old one had from its first index on is gone."""
    first = new.groupBy("region_id").agg(F.min("idx").alias("first"))
    kept = old.join(first, "region_id", "left").where(F.col("first").isNull() | (F.col("idx") < F.col("first")))
    return kept.select(old.columns).unionByName(new.select(old.columns))


def fetch(rows: DataFrame, low: int, high: int, max_bytes: int) -> DataFrame:
    """Entries of [low, high) while their sizes sum to at most ``max_bytes``; the first one always."""
    part = rows.where((F.col("idx") >= low) & (F.col("idx") < high))
    order = Window.partitionBy("region_id").orderBy("idx")
    part = part.withColumn("total", F.sum("size").over(order)).withColumn("rn", F.row_number().over(order))
    return part.where((F.col("total") <= max_bytes) | (F.col("rn") == 1)).drop("rn")


def islands(rows: DataFrame) -> DataFrame:
    """Runs of consecutive indexes: first, last and count of each."""
    order = Window.partitionBy("region_id").orderBy("idx")
    marked = rows.withColumn("island", F.col("idx") - F.row_number().over(order))
    return marked.groupBy("region_id", "island").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("n")).drop("island")


def collected(rows: DataFrame, calls: list[tuple[int, int]]) -> DataFrame:
    """Entries that each of a list of collections [start, end) deletes, in their order."""
    call = F.lit(None).cast("int")
    for k in range(len(calls) - 1, -1, -1):
        start, end = calls[k]
        call = F.when((F.col("idx") >= start) & (F.col("idx") < end), k).otherwise(call)
    hit = rows.select("region_id", call.alias("call")).where("call IS NOT NULL")
    return hit.groupBy("region_id", "call").agg(F.count("*").alias("n_deleted"))


def compaction(state: DataFrame, count_limit: int, size_limit: int, threshold: int) -> DataFrame:
    """state (region_id, first_idx, applied_idx, replicated_idx, log_size): the index to compact to, or none."""
    applied, first, replicated = F.col("applied_idx"), F.col("first_idx"), F.col("replicated_idx")
    to = F.when(((applied > first) & (applied - first >= count_limit)) | (F.col("log_size") >= size_limit), applied)
    to = to.when((replicated >= first) & (replicated - first > threshold), replicated) - 1
    return state.select("region_id", F.when(to >= first, to).alias("compact_idx"))


def progress(rows: DataFrame) -> DataFrame:
    return rows.groupBy("region_id").agg(F.max("idx").alias("applied_idx"), F.max("term").alias("term"), F.count("*").alias("n_entries"), F.sum("size").alias("n_bytes"))


def replies(entries: DataFrame, callbacks: DataFrame) -> DataFrame:
    """Callbacks (region_id, idx, term) by what became of them: done, stale (overtaken) or waiting."""
    last = entries.groupBy("region_id").agg(F.max("idx").alias("last"))
    both = callbacks.join(entries.select("region_id", "idx", F.col("term").alias("own")), ["region_id", "idx"], "left").join(last, "region_id")
    state = F.when(F.col("own") == F.col("term"), "done").when(F.col("idx") <= F.col("last"), "stale").otherwise("waiting")
    return both.select("region_id", "idx", state.alias("reply"))


def applied(entries: DataFrame, applied_idx: DataFrame) -> DataFrame:
    """Entries that their region has applied already."""
    return entries.join(applied_idx, (entries["region_id"] == applied_idx["region_id"]) & (entries["idx"] <= applied_idx["applied_idx"]), "left_semi")


def size_after_compaction(size: Column, total: Column, left: Column) -> Column:
    """Estimate by the share of entries that stay."""
    return F.when(total > 0, F.floor(size * (left / total))).otherwise(0).cast("long")
