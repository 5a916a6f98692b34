"""Key ranges, codes and packed numbers as column expressions. An empty end key is no bound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def within(key: Column, start: Column, end: Column) -> Column:
    return (key >= start) & ((end == "") | (key < end))


def strictly_within(key: Column, start: Column, end: Column) -> Column:
    return (key > start) & ((end == "") | (key < end))


def within_closed(key: Column, start: Column, end: Column) -> Column:
    return (key >= start) & ((end == "") | (key <= end))


def overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return ((end_b == "") | (start_a < end_b)) & ((end_a == "") | (start_b < end_a))


def epoch_older(version: Column, conf: Column, than_version: Column, than_conf: Column) -> Column:
    """Stale if either part is behind."""
    return (version < than_version) | (conf < than_conf)


def epoch_differs(version: Column, conf: Column, than_version: Column, than_conf: Column) -> Column:
    """Stale if either part differs."""
    return (version != than_version) | (conf != than_conf)


def pack_timestamp(physical: Column, logical: Column) -> Column:
    """physical << 18 + logical, as a long: guard physical < 2 ** 45."""
    return F.shiftleft(physical.cast("long"), 18) + logical


def unpack_timestamp(ts: Column) -> tuple[Column, Column]:
    return F.shiftright(ts, 18), ts.bitwiseAND(F.lit((1 << 18) - 1))


def pack_lease(seconds: Column, millis: Column) -> Column:
    return F.shiftleft(seconds.cast("long"), 10).bitwiseOR(millis.cast("long"))


def comparable_bytes(key: Column) -> Column:
    """Order-preserving code in hexadecimal: groups of eight bytes, each followed by 0xFF less its padding."""
    raw = key.cast("binary")
    groups = F.sequence(F.lit(0), F.floor(F.length(raw) / 8).cast("int"))

    text = F.hex(raw)
    parts = F.transform(groups, lambda i: F.concat(F.rpad(F.substring(text, i * 16 + 1, F.lit(16)), 16, "0"), F.lpad(F.hex(F.lit(255) - (8 - F.least(F.lit(8), F.length(raw) - i * 8)).cast("int")), 2, "0")))
    return F.array_join(parts, "")


def quorum(n: Column) -> Column:
    return F.floor(n / 2).cast("long") + 1


def same_table(a: Column, b: Column, length: int) -> Column:
    """Both are table keys (``t`` first) of one table: equal in their first ``length`` characters."""
    return a.startswith("t") & b.startswith("t") & (F.length(a) >= length) & (F.substring(a, 1, length) == F.substring(b, 1, length))


def next_table(key: Column, length: int) -> Column:
    """The first key after all of a key's table; a key too short to name one counts as of table 0."""
    number = F.when(F.length(key) >= length, F.substring(key, 2, length - 1).cast("long")).otherwise(0)
    return F.concat(F.lit("t"), F.lpad((number + 1).cast("string"), length - 1, "0"))


def raw_bounds(start: Column, end: Column) -> tuple[Column, Column]:
    """Bounds that are always there: the least and the greatest data key in place of empty ones."""
    return F.coalesce(F.nullif(start, F.lit("")), F.lit("t")), F.coalesce(F.nullif(end, F.lit("")), F.lit("u"))
