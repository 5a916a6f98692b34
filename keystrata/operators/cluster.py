"""Peers, requests and flow: health, classification and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import quorum

READS, WRITES, INVALID = ("Get", "Snap"), ("Put", "Delete", "DeleteRange", "IngestSST"), ("Prewrite", "Invalid")
UNCHECKED = ("CompactLog", "ComputeHash", "VerifyHash", "InvalidAdmin")


def min_progress(peers: DataFrame) -> DataFrame:
    return peers.groupBy("region_id").agg(F.coalesce(F.min("matched"), F.lit(0)).cast("long").alias("min_matched"))


def health(peers: DataFrame) -> DataFrame:
    """peers (region_id, matched, truncated): are enough of them not behind the truncated log."""
    out = peers.groupBy("region_id").agg(F.count("*").alias("n_peers"), F.sum((F.col("matched") >= F.col("truncated")).cast("long")).alias("n_healthy"))
    return out.withColumn("has_quorum", F.col("n_healthy") >= quorum(F.col("n_peers")))


def down(peers: DataFrame, now: int, most: int) -> DataFrame:
    return peers.where(now - F.col("seen") > most).select("region_id", "peer_id", (now - F.col("seen")).alias("silent"))


def pending(peers: DataFrame) -> DataFrame:
    return peers.where(F.col("matched") < F.col("truncated")).select("region_id", "peer_id")


def leader_candidates(peers: DataFrame, most_lag: int) -> DataFrame:
    """Peers that may take over: no snapshot under way in their region, and close to its last index."""
    blocked = peers.where("snapshotting").select("region_id").distinct()
    return peers.join(blocked, "region_id", "left_anti").where(F.col("last_idx") <= F.col("matched") + most_lag).select("region_id", "peer_id")


def flow_deltas(reports: DataFrame) -> DataFrame:
    """reports (region_id, at, n_bytes, n_keys), running totals: what came since the report before."""
    order = Window.partitionBy("region_id").orderBy("at")
    return reports.select("region_id", "at", *((F.col(c) - F.coalesce(F.lag(c).over(order), F.lit(0))).alias(f"d_{c}") for c in ("n_bytes", "n_keys")))


def flow_totals(rows: DataFrame) -> DataFrame:
    """Bytes and keys of each region and of all, in one pass; the total has region_id -1."""
    out = rows.rollup("region_id").agg(F.sum("size").alias("n_bytes"), F.count("*").alias("n_keys"))
    return out.select(F.coalesce("region_id", F.lit(-1).cast("long")).alias("region_id"), "n_bytes", "n_keys")


def policy(commands: Column, admin: Column, read_quorum: Column, applied_to_term: Column, lease: Column) -> Column:
    """How a request is served."""
    has = lambda kinds: F.exists(commands, lambda c: c.isin(*kinds))
    first = lambda kinds: F.array_position(F.transform(commands, lambda c: c.isin(*kinds)), F.lit(True))
    return (
        F.when(admin == "ChangePeer", "conf-change")
        .when(admin == "TransferLeader", "transfer-leader")
        .when(admin.isNotNull(), "propose")
        .when(has(INVALID), "invalid")
        .when(has(READS) & has(WRITES), "invalid")
        .when(first(WRITES) > 0, "propose")
        .when(read_quorum | ~applied_to_term | (lease != "valid"), "read-index")
        .otherwise("read-local")
    )


def epoch_matches(admin: Column, version: Column, conf: Column, own_version: Column, own_conf: Column) -> Column:
    """Which parts of the epoch count depends on the command."""
    check_version = admin.isNull() | ~admin.isin(*UNCHECKED, "ChangePeer")
    check_conf = admin.isNotNull() & ~admin.isin(*UNCHECKED)
    return ~((check_version & (version != own_version)) | (check_conf & (conf != own_conf)))


def read_check(peer: Column, own_peer: Column, term: Column, own_term: Column, version: Column, own_version: Column, applied_term: Column) -> Column:
    return (
        F.when(peer != own_peer, "peer-mismatch")
        .when((term != 0) & (own_term > term + 1), "stale-command")
        .when(version != own_version, "epoch-mismatch")
        .when(applied_term != own_term, "expired")
        .otherwise("ok")
    )


def latch_conflicts(rows: DataFrame, slot: Column) -> DataFrame:
    """rows (txn, k): latch slots, by an expression over the key, that several transactions want at once."""
    out = rows.select(slot.alias("slot"), "txn").groupBy("slot").agg(F.count_distinct("txn").alias("n_txns"))
    return out.where("n_txns > 1")


def sessions(reads: DataFrame, gap: int) -> DataFrame:
    """reads (peer_id, at): reads that share one confirmation, parted where none came for more than ``gap``."""
    order = Window.partitionBy("peer_id").orderBy("at")
    new = F.when(F.col("at") - F.lag("at").over(order) > gap, 1).otherwise(0)
    marked = reads.withColumn("new", new).withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("peer_id", "session").agg(F.min("at").alias("first_at"), F.count("*").alias("n_reads"))


def newest_state(changes: DataFrame) -> DataFrame:
    """changes (region_id, at, state): the last one of each region."""
    return changes.groupBy("region_id").agg(F.max_by("state", "at").alias("state"), F.max("at").alias("at"))


def content_hash(rows: DataFrame) -> DataFrame:
    """Order-free hash of the rows of each region."""
    return rows.groupBy("region_id").agg(F.expr("bit_xor(xxhash64(k, start_ts, op, value))").alias("hash"), F.count("*").alias("n_rows"))
