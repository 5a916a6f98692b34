"""Reads of a multi-version table (k, start_ts, commit_ts, op, value) and the rows that transactions write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATA_OPS = ("P", "D")
INLINE_BYTES = 64


def newest(rows: DataFrame, *extra: str) -> DataFrame:
    """Newest data version of each key, deletes included: one partial aggregate, no sort of a key's history."""
    data = rows.where(F.col("op").isin(*DATA_OPS))
    best = F.max_by(F.struct("commit_ts", "op", "value", *extra), "commit_ts").alias("v")
    return data.groupBy("k").agg(best).select("k", "v.*")


def as_of(rows: DataFrame, ts: int) -> DataFrame:
    """Live version of each key at ``ts``: the filter reaches the scan."""
    return newest(rows.where(F.col("commit_ts") <= ts)).where("op <> 'D'").select("k", "commit_ts", "value")


def point_get(rows: DataFrame, key: str) -> DataFrame:
    return newest(rows.where(F.col("k") == key)).where("op <> 'D'").select("k", "commit_ts", "value")


def in_range(rows: DataFrame, start: str, end: str) -> DataFrame:
    rows = rows.where(F.col("k") >= start)
    return rows.where(F.col("k") < end) if end else rows


def range_scan(rows: DataFrame, start: str, end: str) -> DataFrame:
    return newest(in_range(rows, start, end)).where("op <> 'D'").select("k", "commit_ts", "value")


def prewrites(rows: DataFrame, size: Column) -> DataFrame:
    """Rows of a prewrite: a lock, and a default row where the value is too long to lie in it."""
    cf = F.explode(F.when(size > INLINE_BYTES, F.array(F.lit("lock"), F.lit("default"))).otherwise(F.array(F.lit("lock"))))
    return rows.where("op <> 'R'").select(cf.alias("cf"), "k", "start_ts")


def commits(commit: DataFrame, locks: DataFrame) -> DataFrame:
    """What a commit makes of its lock (k, start_ts, op, primary_key): a write, a status row for a lock-only primary, or nothing."""
    both = commit.join(locks, ["k", "start_ts"])
    made = F.when(F.col("op") != "L", "write").when(F.col("primary_key") == F.col("k"), "status").otherwise("none")
    return both.select("k", "start_ts", "commit_ts", "op", made.alias("made"))


def open_locks(prewritten: DataFrame, ended: DataFrame) -> DataFrame:
    """Locks that no commit or rollback (k, start_ts) has ended."""
    return prewritten.join(ended, ["k", "start_ts"], "left_anti")


def delete_range(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Tombstones, one version above the newest, for each live key of the range."""
    live = range_scan(rows, start, end)
    return live.select("k", (F.col("commit_ts") + 1).alias("commit_ts"), F.lit("D").alias("op"))


def without_range(rows: DataFrame, start: str, end: str) -> DataFrame:
    inside = F.col("k") >= start
    return rows.where(~(inside & (F.col("k") < end)) if end else ~inside)


def merge_locks_and_writes(locks: DataFrame, writes: DataFrame) -> DataFrame:
    """Both by key, a key's lock before its writes, those newest first: the place of each row in its key."""
    from pyspark.sql import Window

    rows = locks.select("k", F.lit(1).alias("is_lock"), F.col("start_ts").alias("ts")).unionByName(writes.select("k", F.lit(0).alias("is_lock"), F.col("commit_ts").alias("ts")))
    order = Window.partitionBy("k").orderBy(F.desc("is_lock"), F.desc("ts"))
    return rows.withColumn("place", F.row_number().over(order).cast("long"))
