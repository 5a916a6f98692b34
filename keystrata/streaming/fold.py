"""Streaming: an ordered fold of replicated logs, and an idempotent sink.

A stream gives no order across partitions, so each region keeps what has come too early and
releases entries only in unbroken order; a gap waits, and is reported once it has waited for the
timeout.  Entries at or below the applied index come again after a restart and are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "region_id long, applied_idx long, n_entries long, n_bytes long, status string"
STATE = "applied long, entries long, bytes long, waiting_idx array<long>, waiting_size array<long>"


def fold(state: tuple | None, idx: list[int], size: list[int]) -> tuple:
    """applied, entries, bytes and what still waits, after more entries in any order."""
    applied, entries, total, early = (state[0], state[1], state[2], dict(zip(state[3], state[4]))) if state else (0, 0, 0, {})
    for i, n in zip(idx, size):
        if i > applied:
            early.setdefault(int(i), int(n))
    while applied + 1 in early:
        applied += 1
        entries, total = entries + 1, total + early.pop(applied)
    rest = sorted(early.items())
    return applied, entries, total, [i for i, _ in rest], [n for _, n in rest]


def apply_in_order(stream: DataFrame, timeout_ms: int = 600_000) -> DataFrame:
    """stream (region_id, idx, size): after each batch, how far each region with news has come."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            applied, entries, total, early, _ = state.get
            if early:
                yield pd.DataFrame([(key[0], applied, entries, total, "gap")], columns=["region_id", "applied_idx", "n_entries", "n_bytes", "status"])
            return
        own = state.get if state.exists else None
        for pdf in batches:
            own = fold(own, pdf["idx"].tolist(), pdf["size"].tolist())
        state.update(own)
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame([(key[0], *own[:3], "waiting" if own[3] else "ok")], columns=["region_id", "applied_idx", "n_entries", "n_bytes", "status"])

    return stream.groupBy("region_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def write_once(stream: DataFrame, path: str, checkpoint: str):
    """Each batch to a folder named by its number: a batch that runs again overwrites its own rows."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
