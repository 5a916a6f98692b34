"""Best-fit packing of token sequences by a configuration linear program.

A configuration says how many pieces of each length share one sequence.  The covering
program over the length histogram (as few sequences as possible, every piece in one) is solved
by multiplicative weights: each length has a price, a knapsack dynamic program finds the most
valuable configurations, and the lengths they serve become cheaper in proportion to the share of
their demand that is served.  Step masses are rounded down to whole sequences, never past
the demand; the few pieces left at the end are placed best fit, longest first.

Spark makes the pieces, the histogram and the placement; the driver holds the histogram (at
most ``capacity`` rows) and the plan, whose size depends on ``classes`` and ``capacity`` and
the logarithm of the demand, not on the number of documents.

Null texts count as empty: one piece that holds the end id alone.  Repeated rows are packed as
often as they occur.  An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .storage import Scratch, lean, sliced

CAPACITY, END_ID = 4096, 1
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each document: where it begins, its length and the crc32 of its ids."""

    def run(batches):
        enc, end = encoder(vocabulary, library=True), end_id.to_bytes(4, "little")
        for batch in sliced(batches):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
                ids = memoryview(ids + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, crc32(part)))
            columns = [*zip(*rows)] or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run, encodes=True), _PIECES)


def knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """prices[n] of one piece of length n (0: none on offer). For each room: the best value, and its longest first piece."""
    value, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    offer = np.flatnonzero(prices)
    least, most = int(offer[0]), int(offer[-1])
    price = np.where(prices > 0, prices, -np.inf)[::-1]  # from the longest: of equal sums the first is taken
    n = len(price) - 1
    for c in range(least, capacity + 1):
        top = min(c, most)
        sums = price[n - top : n - least + 1] + value[c - top : c - least + 1]
        k = int(sums.argmax())
        if sums[k] > value[c - 1]:
            value[c], choice[c] = sums[k], top - k
        else:
            value[c] = value[c - 1]
    return value, choice


def configurations(counts: np.ndarray, capacity: int = CAPACITY, rate: float = 1.0, step: float = 0.5, near: float = 0.01, rounds: int = 160) -> list[tuple[dict[int, int], int]]:
    """counts[n]: pieces of length n.  Configurations (length: how many) and in how many sequences each is used.

    Each round prices all configurations with one knapsack and uses, for each length, the best one
    that has it, if its value is within ``near`` of the best of all: at most the share ``step`` of
    any demand in it, and at least one sequence.
    """
    demand = counts.astype(np.int64).copy()
    out: list[tuple[dict[int, int], int]] = []
    if demand[capacity]:
        out.append(({capacity: 1}, int(demand[capacity])))
        demand[capacity] = 0
    left = demand.tolist()
    need = demand.tolist()
    weight = np.arange(len(demand)) * (1 + 1e-6 * np.arange(len(demand)))  # a little more for what is harder to place
    for _ in range(rounds):
        offer = np.where(np.array(left) > 0, weight, 0)
        if not offer.any():
            break
        value, choice = knapsack(offer, capacity)
        served = np.zeros(len(demand))
        available = np.flatnonzero(offer).tolist()
        for n in np.flatnonzero(offer)[::-1].tolist():
            if offer[n] + value[capacity - n] < (1 - near) * value[capacity]:
                continue
            contents, room = {n: 1}, capacity - n
            while room > 0:
                k = int(choice[room])
                if k:
                    contents[k] = contents.get(k, 0) + 1
                room -= k or 1
            if any(many > left[k] for k, many in contents.items()):  # the knapsack knows no demands
                contents = _within(contents, left, available, capacity)
                if sum(offer[k] * many for k, many in contents.items()) < (1 - near) * value[capacity]:
                    continue
            copies = max(1, min(min(left[k] // many for k, many in contents.items()), min(int(step * need[k] / many) for k, many in contents.items())))
            out.append((contents, copies))
            for k, many in contents.items():
                left[k] -= copies * many
                served[k] += copies * many
        if not served.any():
            break
        weight = weight * np.exp(-rate * served / np.maximum(demand, 1))
    return out + best_fit(np.array(left), capacity)


def _within(contents: dict[int, int], left: list[int], available: list[int], capacity: int) -> dict[int, int]:
    """Without what is more than is left, filled up with the longest pieces that fit."""
    contents = {k: min(many, left[k]) for k, many in contents.items() if left[k]}
    room = capacity - sum(k * many for k, many in contents.items())
    at = bisect_right(available, room)
    while at:
        k = available[at - 1]
        many = min(room // k, left[k] - contents.get(k, 0))
        if many > 0:
            contents[k] = contents.get(k, 0) + many
            room -= k * many
        at = min(at - 1, bisect_right(available, room))
    return contents


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Longest first, each into the fullest sequence with room: alike sequences are handled together."""
    room: dict[int, dict[tuple, int]] = {capacity: {}}  # room left: contents: how many sequences
    for n in np.flatnonzero(left)[::-1].tolist():
        need = int(left[n])
        while need:
            at = min((r for r, held in room.items() if r >= n and held), default=None)
            if at is None:
                per = capacity // n
                full, rest = divmod(need, per)
                for k, many in ((per, full), (rest, 1)):
                    if k and many:
                        held = room.setdefault(capacity - k * n, {})
                        held[((n, k),)] = held.get(((n, k),), 0) + many
                break
            contents, many = next(iter(room[at].items()))
            per = min(at // n, need)
            take = min(many, need // per)
            if take == many:
                del room[at][contents]
            else:
                room[at][contents] = many - take
            held, key = room.setdefault(at - per * n, {}), (*contents, (n, per))
            held[key] = held.get(key, 0) + take
            need -= take * per
    return [(dict(contents), many) for held in room.values() for contents, many in held.items()]


def _intervals(plan: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """For each length and configuration: first rank, pieces a sequence, first sequence; sorted by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for contents, copies in plan:
        for n, many in contents.items():
            rows.append((n, used.get(n, 0), many, sequence))
            used[n] = used.get(n, 0) + many * copies
        sequence += copies
    rows.sort()
    size, rank, many, first = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 4
    return size, rank, many, first


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (a written table with doc_id, piece, start, length, ids_crc32)."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    size, before, many, first = _intervals(configurations(counts, capacity))
    keys = (size << 44) + before

    # Ranks within a length: each (length, salt) is numbered alone, then moved by the count of the salts before it.
    salts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    base = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    base = base.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("own", F.row_number().over(own) - 1).join(base, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("base")).alias("rank"))

    def run(batches):
        for batch in batches:
            n, r = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, (n << 44) + r, "right") - 1
            sequence = first[at] + (r - before[at]) // many[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64())], [*batch.schema.names[:5], "sequence_id"])

    placed = ranked.mapInArrow(lean(run), _PIECES + ", sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "piece", "ids_crc32")
    return placed.withColumn("offset", F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))


def pack_documents(docs: DataFrame, vocabulary: str, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    return pack(scratch.write(token_pieces(docs, vocabulary, capacity), "pieces"), capacity)
