"""Key ranges (region_id, start_key, end_key): lookup, overlap, coverage, neighbours and splits.

Ranges that are disjoint are looked up by an as-of step over blocks of neighbouring keys, not by a range join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from .ordered import as_of, neighbours, running_sum


def _holding(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """keys (key), distinct: each with the one of the disjoint ranges that holds it, as region_id, start_key, end_key."""
    found = as_of(keys, ranges.select("region_id", "start_key", "end_key"), "start_key").select("key", "point.*")
    return found.where(K.within(F.col("key"), F.col("start_key"), F.col("end_key")))


def locate(rows: DataFrame, ranges: DataFrame, key: str = "k") -> DataFrame:
    """The one of the disjoint ranges that holds each row's key: distinct keys are looked up, then rows join by key, so
    that hot keys cost one lookup."""
    found = _holding(rows.select(F.col(key).alias("key")).distinct(), ranges)
    return rows.join(found.select(F.col("key").alias(key), "region_id"), key)


def members(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """For each distinct key how many of the disjoint ranges hold it: half open, open and closed."""
    inside = _holding(keys.select(F.col("k").alias("key")), ranges)
    inside = inside.select(F.col("key").alias("k"), F.lit(1).alias("half_open"), (F.col("key") > F.col("start_key")).cast("int").alias("open"))
    end = ranges.where("end_key <> '' AND end_key >= start_key").select(F.col("end_key").alias("k"))
    at_end = keys.select("k").join(end, "k").select("k", F.lit(0).alias("half_open"), F.lit(0).alias("open"))
    both = inside.unionByName(at_end)
    return both.groupBy("k").agg(F.sum("half_open").alias("n_half_open"), F.sum("open").alias("n_open"), F.count("*").alias("n_closed"))


def exceeding(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """For each range how many of the distinct keys are at or above its end: each key counts at the last end not above
    it, and ends are summed up from above."""
    ends = ranges.where("end_key <> ''").groupBy("end_key").agg(F.collect_list("region_id").alias("ids"))
    at = as_of(keys.select(F.col("k").alias("key")), ends.select("end_key"), "end_key").groupBy(F.col("point.end_key").alias("end_key")).agg(F.count("*").alias("n"))
    counted = ends.join(at, "end_key", "left").fillna(0, ["n"])
    below = running_sum(counted, "n", "end_key", "so_far").withColumn("n_exceeding", F.col("n") - F.col("so_far"))
    return below.crossJoin(at.agg(F.sum("n").alias("total"))).select(F.explode("ids").alias("region_id"), (F.col("n_exceeding") + F.col("total")).alias("n_exceeding")).where("n_exceeding > 0")  # with one row


def _meeting(wanted: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each row of ``wanted`` (s, e) with each of the disjoint ranges that shares a key with it.

    Ranges are numbered in order; both bounds of a row are looked up, and the numbers between them are joined by
    equality, so that the work grows with the result.
    """
    numbered = running_sum(ranges.withColumn("one", F.lit(1).cast("long")), "one", "start_key", "place").drop("one")
    bounds = wanted.select(F.explode(F.array("s", "e")).alias("key")).distinct()
    at = as_of(bounds, numbered.select("start_key", "place"), "start_key").select("key", F.col("point.place").alias("place"))
    both = wanted.join(at.withColumnsRenamed({"key": "s", "place": "low"}), "s", "left").join(at.withColumnsRenamed({"key": "e", "place": "high"}), "e", "left")
    both = both.crossJoin(numbered.agg(F.max("place").alias("top")))  # with one row
    high = F.when(F.col("e") == "", F.col("top")).otherwise(F.col("high"))
    low = F.coalesce("low", F.lit(1).cast("long"))
    each = both.withColumn("place", F.explode(F.when(low <= high, F.sequence(low, high)))).drop("low", "high", "top")
    return each.join(numbered, "place").where(K.overlap(F.col("s"), F.col("e"), F.col("start_key"), F.col("end_key"))).drop("place")


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of ranges of different ids that share a key; those of ``b`` are disjoint."""
    wanted = a.select(F.col("region_id").alias("a_id"), F.col("start_key").alias("s"), F.col("end_key").alias("e"))
    return _meeting(wanted, b.select("region_id", "start_key", "end_key")).where("a_id <> region_id").select("a_id", F.col("region_id").alias("b_id"))


def ending_in(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """Ranges whose end lies in (start, end]; an empty end is above every key."""
    hit = (F.col("end_key") != "") & (F.col("end_key") > start)
    return ranges.where((hit & (F.col("end_key") <= end)) if end else (hit | (F.col("end_key") == "")))


def coverage(ranges: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (want_id, want_start, want_end): is it covered without a gap by the disjoint ranges, and by how many."""
    ws, we = F.col("want_start"), F.col("want_end")
    met = _meeting(wanted.select("want_id", ws.alias("s"), we.alias("e")), ranges.select("region_id", "start_key", "end_key"))
    hit = wanted.join(met.drop("s", "e"), "want_id", "left")
    order = Window.partitionBy("want_id").orderBy("start_key")
    before = F.lag("end_key").over(order)
    gap = F.when(F.col("region_id").isNull(), 1).when(before.isNull() & (F.col("start_key") > ws), 1).when((before != "") & (before < F.col("start_key")), 1).otherwise(0)
    out = hit.withColumn("gap", gap).groupBy("want_id", "want_end").agg(
        F.sum("gap").alias("gaps"), F.count("region_id").alias("n_ranges"), F.max(F.when(F.col("end_key") == "", 1).otherwise(0)).alias("open_end"), F.max("end_key").alias("last_end")
    )
    reaches = (F.col("open_end") == 1) | ((we != "") & (F.col("last_end") >= we))
    return out.select("want_id", ((F.col("gaps") == 0) & reaches).alias("covered"), "n_ranges")


def siblings(ranges: DataFrame) -> DataFrame:
    """The neighbours below and above of each of the disjoint ranges."""
    return neighbours(ranges.select("region_id", "start_key"), "region_id", "start_key", "left_id", "right_id").select("region_id", "left_id", "right_id")


def split(ranges: DataFrame, cuts: DataFrame) -> DataFrame:
    """cuts (region_id, cut): each range in n + 1 pieces, its version raised by n; cuts outside or on the start are dropped."""
    good = cuts.join(ranges, "region_id").where(K.strictly_within(F.col("cut"), F.col("start_key"), F.col("end_key"))).groupBy("region_id").agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    both = ranges.join(good, "region_id", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<string>")))
    starts = F.concat(F.array("start_key"), F.col("cuts"))
    ends = F.concat(F.col("cuts"), F.array("end_key"))
    both = both.withColumn("n", F.size("cuts")).select("region_id", "version", "n", F.posexplode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("piece", "p"))
    return both.select("region_id", F.col("piece").cast("long").alias("piece"), F.col("p.s").alias("start_key"), F.col("p.e").alias("end_key"), (F.col("version") + F.col("n")).alias("version"))


def minus(old: DataFrame, new: DataFrame) -> DataFrame:
    """What of each old range (region_id, start_key, end_key) its new one does not cover: none, one or two pieces."""
    n = new.select("region_id", F.col("start_key").alias("ns"), F.col("end_key").alias("ne"))
    both = old.join(n, "region_id")
    below = both.where(F.col("start_key") < F.col("ns")).select("region_id", "start_key", F.col("ns").alias("end_key"))
    above = both.where((F.col("ne") != "") & ((F.col("end_key") == "") | (F.col("end_key") > F.col("ne")))).select("region_id", F.col("ne").alias("start_key"), "end_key")
    return below.unionByName(above)


def split_keys_by_count(rows: DataFrame, per: int, most: int) -> DataFrame:
    """rows (region_id, seq, k): every ``per``-th row opens a piece; the last cut goes if the rest and a piece stay below ``most``."""
    order = Window.partitionBy("region_id").orderBy("seq")
    n = F.count("*").over(Window.partitionBy("region_id"))
    marked = rows.select("region_id", "seq", "k", F.row_number().over(order).alias("rn"), n.alias("n"))
    cut = (F.col("rn") > 1) & ((F.col("rn") - 1) % per == 0)
    tail = (F.col("n") - 1) % per + 1
    last = F.col("rn") + per > F.col("n")
    return marked.where(cut & ~(last & (tail + per < most))).select("region_id", "seq", "k")


def split_keys_by_size(rows: DataFrame, per: int, most: int = 0) -> DataFrame:
    """rows (region_id, seq, size): cuts where the running size passes ``per``; it starts again at 0, or at this row's
    size if it had met ``per`` exactly.  A region's last cut goes if what follows it and a piece stay below ``most``.

    A sum that resets has no window form, so each region is scanned in order, batch by batch: the
    state is a few numbers, and no region is held in memory.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        region, total, held = None, 0, None
        for pdf in batches:
            out = []
            for r, seq, n in zip(pdf["region_id"], pdf["seq"], pdf["size"], strict=True):
                if r != region:
                    if held and total + per >= most:
                        out.append(held)
                    region, total, held = r, 0, None
                exact = total == per
                total += n
                if total > per:
                    total = n if exact else 0
                    if held:
                        out.append(held)
                    held = (r, seq)
            yield pd.DataFrame(out, columns=["region_id", "seq"])
        if held and total + per >= most:
            yield pd.DataFrame([held], columns=["region_id", "seq"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("region_id", "seq", "size").repartition(parts, "region_id").sortWithinPartitions("region_id", "seq").mapInPandas(scan, "region_id long, seq long")


def split_keys(by_size: DataFrame, by_count: DataFrame) -> DataFrame:
    """(region_id, seq) of both checks: a region's cuts by size if it has any, else those by count."""
    own = by_size.select("region_id", "seq", F.lit("size").alias("by"))
    rest = by_count.select("region_id", "seq", F.lit("count").alias("by")).join(by_size.select("region_id").distinct(), "region_id", "left_anti")
    return own.unionByName(rest)


def split_keys_by_table(rows: DataFrame) -> DataFrame:
    """rows (table_id, k): the first key of each table after the first."""
    return rows.groupBy("table_id").agg(F.min("k").alias("k")).where(F.col("table_id") > rows.agg(F.min("table_id")).head()[0])


def half_split(rows: DataFrame, step: int) -> DataFrame:
    """rows (region_id, seq, k): the middle one of every ``step``-th row."""
    order = Window.partitionBy("region_id").orderBy("seq")
    seen = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") % step == 0)
    seen = seen.withColumn("at", F.floor(F.col("rn") / step) - 1).withColumn("n", F.count("*").over(Window.partitionBy("region_id")))
    return seen.where(F.col("at") == F.floor(F.col("n") / 2)).select("region_id", "seq", "k")
