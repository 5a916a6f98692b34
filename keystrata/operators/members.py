"""Membership, messages, pending ranges and leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from .ordered import running_sum


def change_peers(regions: DataFrame, changes: DataFrame) -> DataFrame:
    """regions (region_id, peers, conf_version), changes (region_id, kind, peer_id), one a region: the new peers and what came of it."""
    both = regions.join(changes, "region_id")
    has = F.array_contains("peers", F.col("peer_id"))
    outcome = F.when((F.col("kind") == "add") & has, "duplicate").when((F.col("kind") == "remove") & ~has, "missing").otherwise("ok")
    peers = F.when(outcome != "ok", F.col("peers")).when(F.col("kind") == "add", F.array_append("peers", F.col("peer_id"))).otherwise(F.array_remove("peers", F.col("peer_id")))
    conf = F.col("conf_version") + (outcome == "ok").cast("long")
    return both.select("region_id", outcome.alias("outcome"), peers.alias("peers"), conf.alias("conf_version"))


def drained(pending: DataFrame, start: str, end: str, now: int) -> DataFrame:
    """Pending deletions (region_id, start_key, end_key, timeout): those that a new range takes over, else those past their time."""
    hit = K.overlap(F.col("start_key"), F.col("end_key"), F.lit(start), F.lit(end))
    return pending.select("region_id", F.when(hit, "drained").when(F.col("timeout") < now, "expired").otherwise("pending").alias("state"))


def is_initial(kind: Column, commit: Column) -> Column:
    return kind.isin("vote", "prevote") | ((kind == "heartbeat") & (commit == 0))


def message_checks(messages: DataFrame, regions: DataFrame) -> DataFrame:
    """messages (event_id, region_id, kind, commit, sender, version): what to do with each; regions has peers."""
    both = messages.join(regions.select("region_id", "peers", F.col("version").alias("own")), "region_id", "left")
    known = F.array_contains("peers", F.col("sender"))
    act = F.when(F.col("own").isNull(), "to-store").when((F.col("version") < F.col("own")) & ~known, "stale").when(is_initial(F.col("kind"), F.col("commit")), "initial").otherwise("step")
    return both.select("event_id", act.alias("act"))


def snapshot_valid(idx: Column, conf: Column, truncated: Column, latest_conf: Column) -> Column:
    return (idx >= truncated) & (conf >= latest_conf)


def registry(states: DataFrame) -> DataFrame:
    """states (name, state): snapshots on their way out and in, each counted once."""
    rows = states.groupBy("name").agg(F.collect_set("state").alias("s"))
    out = rows.select(F.arrays_overlap("s", F.array(F.lit("generating"), F.lit("sending"))).alias("o"), F.arrays_overlap("s", F.array(F.lit("receiving"), F.lit("applying"))).alias("i"))
    return out.agg(F.count_if("o").alias("n_sending"), F.count_if("i").alias("n_receiving"))


def progress_indexes(peers: DataFrame, alive_after: int) -> DataFrame:
    """The index that all peers have, and the one that all peers heard of lately and not truncated have."""
    alive = (F.col("seen") > alive_after) & (F.col("matched") >= F.col("truncated"))
    return peers.groupBy("region_id").agg(F.least(F.min("matched"), F.max("last_idx")).alias("replicated_idx"), F.coalesce(F.min(F.when(alive, F.col("matched"))), F.max("last_idx")).alias("alive_idx"))


def proposal_times(entries: DataFrame, proposals: DataFrame) -> DataFrame:
    """When each committed entry was proposed: by index and term, so that an overwritten proposal gives none."""
    return entries.join(proposals, ["region_id", "idx", "term"], "left")


def split_requests(requests: DataFrame, regions: DataFrame) -> DataFrame:
    """requests (request_id, region_id, cuts): is the list not empty, rising, and inside the region."""
    both = requests.join(regions, "region_id")
    pairs = F.arrays_zip(F.col("cuts").alias("a"), F.slice("cuts", F.lit(2), F.size("cuts")).alias("b"))
    rising = F.forall(pairs, lambda p: p["b"].isNull() | (p["a"] < p["b"]))
    inside = F.forall("cuts", lambda c: K.strictly_within(c, F.col("start_key"), F.col("end_key")))
    verdict = F.when(F.size("cuts") == 0, "empty").when(~rising, "not-rising").when(~inside, "outside").otherwise("ok")
    return both.select("request_id", verdict.alias("verdict"))


def leases(events: DataFrame, now: DataFrame, length: int) -> DataFrame:
    """events (peer_id, seq, sent, suspect): renewals and suspicions of leases, in their order; now: one row (now).

    A lease is bound to the time a message was sent plus ``length``.  A suspicion ends it and holds until a renewal
    with a later bound; a renewal of a valid lease counts if its bound is later.  So only the last suspicion of
    a peer matters, and of the renewals after it the one with the latest bound.
    """
    rows = events.select("peer_id", "seq", "suspect", (F.col("sent") + length).alias("bound"))
    last = rows.where("suspect").groupBy("peer_id").agg(F.max_by(F.struct("seq", "bound"), "seq").alias("held"))
    both = rows.join(last, "peer_id", "left")
    counts = ~F.col("suspect") & (F.col("held").isNull() | ((F.col("seq") > F.col("held.seq")) & (F.col("bound") > F.col("held.bound"))))
    out = both.groupBy("peer_id").agg(F.max(F.when(counts, F.col("bound"))).alias("bound"), F.bool_or(F.col("held").isNotNull()).alias("held"))
    state = F.when(F.col("bound").isNull() & F.col("held"), "suspect").when(F.col("bound") > F.col("now"), "valid").otherwise("expired")
    return out.crossJoin(now).select("peer_id", state.alias("lease"))  # with one row


def stream_pieces(parts: DataFrame, chunk: int) -> DataFrame:
    """parts (part, size) sent one after the other: which bytes of which chunk each one fills."""
    ends = running_sum(parts.where("size > 0"), "size", "part", "end").withColumn("begin", F.col("end") - F.col("size"))
    each = ends.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("begin") / chunk), F.floor((F.col("end") - 1) / chunk))))
    first = F.greatest(F.col("begin"), F.col("chunk") * chunk)
    return each.select("part", "chunk", (first - F.col("begin")).alias("from_byte"), (F.least(F.col("end"), (F.col("chunk") + 1) * chunk) - first).alias("n_bytes"))
