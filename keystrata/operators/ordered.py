"""Steps over a whole table in the order of a key, in many tasks.

Rows are dealt into blocks of neighbouring keys by cuts that are quantiles of a sample of the keys.  Windows run
within a block; what a block needs of the others (a last range, a sum) is one row for each block, which the driver
puts in order: at most ``MOST`` rows, however large the table is.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks at most, and sampled keys for each.
MOST, SAMPLED = 4096, 32


def cuts(rows: DataFrame, key: str) -> list:
    """At most as many keys as there are shuffle partitions (``MOST`` at most); equal keys are never parted.

    A threshold on the key's hash, from a count, bounds the sample.
    """
    blocks = min(MOST, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = rows.select(key).where(F.col(key).isNotNull()).distinct()
    share = blocks * SAMPLED / max(1, keys.count())
    if share < 1:
        keys = keys.where(F.xxhash64(key) < int((2 * share - 1) * 2**63))
    sample = sorted(r[0] for r in keys.collect())
    return sorted({sample[len(sample) * i // blocks] for i in range(1, blocks)}) if sample else []


def block_of(key: Column, at: list) -> Column:
    """How many cuts are at or below the key; compares with about twice the square root of their number."""
    if not at:
        return F.lit(0)
    wide = math.isqrt(len(at) - 1) + 1
    groups = [at[i : i + wide] for i in range(0, len(at), wide)]
    array = lambda values: F.array(*map(F.lit, values))
    n = F.size(F.filter(array([g[0] for g in groups]), lambda c: c <= key))
    own = F.get(F.array(*map(array, groups)), F.greatest(n - 1, F.lit(0)))
    return F.when(n == 0, 0).otherwise((n - 1) * wide + F.size(F.filter(own, lambda c: c <= key)))


def _carried(blocks: DataFrame, values: list[tuple]) -> DataFrame:
    """A table of (block, carried) to be broadcast; its types are those of ``blocks``."""
    schema = blocks.schema
    return F.broadcast(blocks.sparkSession.createDataFrame(values, schema).toDF("block", "carried"))


def as_of(keys: DataFrame, points: DataFrame, at: str) -> DataFrame:
    """keys (key), distinct: each with ``point``, a struct of the row of ``points`` with the largest ``at`` not above it.

    Keys below all points, and null ones, have no row.  Rows of ``points`` with a null ``at`` count for nothing.
    """
    known = points.where(F.col(at).isNotNull()).select(F.col(at).alias("key"), F.struct(*points.columns).alias("point"))
    asked = keys.where(F.col("key").isNotNull()).select("key", F.lit(None).cast(known.schema["point"].dataType).alias("point"))
    both = known.unionByName(asked)
    at_cuts = cuts(both, "key")
    last = known.groupBy(block_of(F.col("key"), at_cuts).alias("block")).agg(F.max_by("point", "key").alias("carried"))
    held, values = dict(map(tuple, last.collect())), []
    for block in range(1, len(at_cuts) + 1):
        before = held.get(block - 1, values[-1][1] if values else None)
        values.append((block, before))
    order = Window.partitionBy("block").orderBy("key", F.col("point").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("block", block_of(F.col("key"), at_cuts)).withColumn("found", F.last("point", ignorenulls=True).over(order))
    both = both.where("point IS NULL").join(_carried(last, values), "block", "left")
    return both.select("key", F.coalesce("found", "carried").alias("point")).where("point IS NOT NULL")


def running_sum(rows: DataFrame, value: str, key: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with this row, by ``key`` (distinct, not null)."""
    at = cuts(rows, key)
    rows = rows.withColumn("block", block_of(F.col(key), at))
    sums = rows.groupBy("block").agg(F.sum(value).alias("carried"))
    own = dict(map(tuple, sums.collect()))
    totals = accumulate((own.get(b) or 0 for b in range(len(at))), initial=0)
    order = Window.partitionBy("block").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.withColumn(name, F.sum(value).over(order)).join(_carried(sums, list(enumerate(totals))), "block")
    return both.withColumn(name, F.col(name) + F.col("carried")).drop("block", "carried")


def neighbours(rows: DataFrame, value: str, key: str, below: str, above: str) -> DataFrame:
    """``rows`` with the ``value`` of the row below and above each by ``key`` (distinct, not null); null at the ends."""
    at = cuts(rows, key)
    rows = rows.withColumn("block", block_of(F.col(key), at))
    ends = rows.groupBy("block").agg(F.min_by(value, key).alias("first"), F.max_by(value, key).alias("last")).orderBy("block").collect()
    order = Window.partitionBy("block").orderBy(key)
    both = rows.withColumn(below, F.lag(value).over(order)).withColumn(above, F.lead(value).over(order))
    kind = rows.select("block", F.col(value).alias("carried"))
    for name, pairs in ((below, zip(ends[1:], [r["last"] for r in ends])), (above, zip(ends, [r["first"] for r in ends[1:]]))):
        both = both.join(_carried(kind, [(r["block"], v) for r, v in pairs]), "block", "left")
        both = both.withColumn(name, F.coalesce(name, "carried")).drop("carried")
    return both.drop("block")
