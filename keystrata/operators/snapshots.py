"""Range snapshots: export into column families, import back, and the registry of snapshot files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running_sum
from .versions import INLINE_BYTES


def export(rows: DataFrame, locks: DataFrame, size: Column) -> DataFrame:
    """One table of the three families: (cf, k, ts, start_ts, op, value, short).

    write: every committed version and rollback; default: values too long to lie in a write; lock: open locks.
    """
    long_ = (size > INLINE_BYTES) & (F.col("op") == "P")
    none = F.lit(None).cast("double")
    write = rows.select(F.lit("write").alias("cf"), "k", F.when(F.col("op") == "R", F.col("start_ts")).otherwise(F.col("commit_ts")).alias("ts"), "start_ts", "op", F.when(long_, none).otherwise(F.col("value")).alias("value"), (~long_).alias("short"))
    default = rows.where(long_).select(F.lit("default").alias("cf"), "k", F.col("start_ts").alias("ts"), "start_ts", F.lit("P").alias("op"), "value", F.lit(False).alias("short"))
    lock = locks.select(F.lit("lock").alias("cf"), "k", F.col("start_ts").alias("ts"), "start_ts", "op", "value", F.lit(True).alias("short"))
    return write.unionByName(default).unionByName(lock)


def load(families: DataFrame) -> DataFrame:
    """Committed rows again: a write whose value is elsewhere takes it from the default family; a missing one is an error row."""
    write = families.where("cf = 'write'")
    default = families.where("cf = 'default'").select("k", "start_ts", F.col("value").alias("far"), F.lit(True).alias("found"))
    both = write.join(default, ["k", "start_ts"], "left")
    bad = ~F.col("short") & F.col("found").isNull()
    return both.select("k", "start_ts", F.col("ts").alias("commit_ts"), "op", F.when(F.col("short"), F.col("value")).otherwise(F.col("far")).alias("value"), bad.alias("broken"))


def family_statistics(families: DataFrame) -> DataFrame:
    return families.groupBy("cf").agg(F.count("*").alias("n_rows"), F.sum(F.length("k")).cast("long").alias("key_bytes"), F.min("k").alias("first_key"), F.max("k").alias("last_key"))


def names(files: DataFrame) -> DataFrame:
    """Files as ``gen_region_term_idx`` or ``rev_...``, parsed into their parts."""
    parts = F.split("name", "_")
    return files.select("*", (F.get(parts, F.lit(0)) == "gen").alias("is_sending"), *(F.get(parts, F.lit(k + 1)).cast("long").alias(c) for k, c in enumerate(("region_id", "term", "idx"))))


def idle_order(files: DataFrame) -> DataFrame:
    """Place of each file: region, term, index, received before sent.  Files are numbered within their region; what
    lies before it comes from a table of one row for each region."""
    counts = files.groupBy("region_id").agg(F.count("*").alias("n"))
    before = running_sum(counts, "n", "region_id", "so_far").select("region_id", (F.col("so_far") - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("region_id").orderBy("term", "idx", "is_sending"))
    return files.withColumn("own", own).join(before, "region_id").withColumn("place", (F.col("own") + F.col("before")).cast("long")).drop("own", "before")


def evict_oldest(files: DataFrame, most: int, span: int = 1024) -> DataFrame:
    """files (name, mtime, size, is_sending): the oldest sent ones that must go until all sizes are at most ``most``.

    The running size is taken within spans of time, on top of a table of one row for each span.
    """
    total = files.agg(F.sum("size").alias("total"))
    sent = files.where("is_sending").withColumn("span", F.floor(F.col("mtime") / span))
    sums = sent.groupBy("span").agg(F.sum("size").alias("n"))
    before = running_sum(sums, "n", "span", "so_far").select("span", (F.col("so_far") - F.col("n")).alias("before"))
    own = Window.partitionBy("span").orderBy("mtime", "name").rowsBetween(Window.unboundedPreceding, -1)
    sent = sent.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0))).join(before, "span")
    return sent.crossJoin(total).where(F.col("total") - F.col("before") - F.col("own") > most).select("name")  # with one row


def save(families: DataFrame, path: str) -> DataFrame:
    """Writes the families as files below ``path`` and, when they are all there, their manifest; returns the manifest."""
    families.write.mode("overwrite").partitionBy("cf").parquet(f"{path}/data")
    spark = families.sparkSession
    _sums(spark.read.schema(families.schema).parquet(f"{path}/data")).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def open_saved(spark, path: str) -> DataFrame:
    """The families of a snapshot; ValueError unless they are as the manifest says (none: the snapshot is not complete)."""
    families, want = spark.read.parquet(f"{path}/data"), spark.read.parquet(f"{path}/manifest")
    if not _sums(families).exceptAll(want).isEmpty() or not want.select("cf").exceptAll(families.select("cf").distinct()).isEmpty():
        raise ValueError(f"the snapshot at {path} differs from its manifest")
    return families


def _sums(families: DataFrame) -> DataFrame:
    """Rows and an order-free checksum of each family."""
    columns = sorted(c for c in families.columns if c != "cf")
    return families.groupBy("cf").agg(F.count("*").alias("n_rows"), F.expr(f"bit_xor(xxhash64({', '.join(columns)}))").alias("checksum"))


def collectable(files: DataFrame, state: DataFrame, now: int, timeout: int) -> DataFrame:
    """Why a snapshot file may go: compacted, expired or applied (state: region_id, truncated_idx, truncated_term, applying)."""
    both = files.join(state, "region_id")
    term, idx = F.col("term"), F.col("idx")
    why = F.when(F.col("is_sending"), F.when((term < F.col("truncated_term")) | (idx < F.col("truncated_idx")), "compacted").when(now - F.col("mtime") > timeout, "expired"))
    why = why.when((term <= F.col("truncated_term")) & ((idx < F.col("truncated_idx")) | ((idx == F.col("truncated_idx")) & ~F.col("applying"))), "applied")
    return both.select("name", why.alias("why")).where("why IS NOT NULL")
