"""Raw requests of replicated commands, regrouped into transaction steps and replayed.

requests: cmd (ordered), pos, kind (put, delete), cf (default, lock, write), k, start_ts, rollback (of a put into write)

A command is read by position: a value for the default family is followed by its lock, a write by
the delete of its lock (a rollback's is optional), the delete of a value by a rollback and its
lock's delete.  What a request belongs to shows in its neighbours alone, so two looks back and
ahead in the command replace a parser.  A command that breaks the order becomes one error row and
nothing else of it counts; one that begins with a delete in the write family only collects
garbage and is dropped whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def steps(requests: DataFrame) -> DataFrame:
    """(cmd, pos, step, k, start_ts, has_default): prewrite, commit, rollback, pessimistic_rollback, or error."""
    what = F.concat_ws("-", "kind", "cf", F.when(F.col("rollback"), "rollback"))
    order = Window.partitionBy("cmd").orderBy("pos")
    rows = requests.withColumn("w", what).select("*", *(F.lead("w", n).over(order).alias(f"next{n}") for n in (1, 2)), F.lag("w").over(order).alias("last"))
    rows = rows.withColumn("head", F.first("w").over(order))
    w, next1, next2, last = (F.col(c) for c in ("w", "next1", "next2", "last"))
    taken = (w == "put-lock") & last.eqNullSafe("put-default")
    taken |= (w == "delete-lock") & last.isin("put-write", "put-write-rollback")
    taken |= (w == "put-write-rollback") & last.eqNullSafe("delete-default")
    step = (
        F.when(w == "put-default", F.when(next1 == "put-lock", "prewrite").otherwise("error"))
        .when(w == "put-lock", "prewrite")
        .when(w == "put-write", F.when(next1 == "delete-lock", "commit").otherwise("error"))
        .when(w == "put-write-rollback", "rollback")
        .when(w == "delete-default", F.when((next1 == "put-write-rollback") & (next2 == "delete-lock"), "rollback").otherwise("error"))
        .when(w == "delete-lock", "pessimistic_rollback")
        .when(w != "delete-write", "error")
    )
    rows = rows.where((F.col("head") != "delete-write") & ~F.coalesce(taken, F.lit(False))).withColumn("step", step).where("step IS NOT NULL")
    broken = F.max((F.col("step") == "error").cast("int")).over(Window.partitionBy("cmd")) == 1
    rows = rows.withColumn("step", F.when(broken, "error").otherwise(F.col("step")))
    rows = rows.withColumn("nth", F.row_number().over(order)).where((F.col("step") != "error") | (F.col("nth") == 1))
    return rows.select("cmd", "pos", "step", "k", "start_ts", F.col("cf").eqNullSafe("default").alias("has_default"))


def commit_status(of: DataFrame) -> DataFrame:
    """steps: each commit with what became of it, ok or no-lock (its lock was never written)."""
    locks = of.where("step = 'prewrite'").select("k", "start_ts", F.lit(True).alias("there")).distinct()
    both = of.where("step = 'commit'").join(locks, ["k", "start_ts"], "left")
    return both.select("cmd", "k", "start_ts", F.when(F.col("there"), "ok").otherwise("no-lock").alias("status"))


def locks_after(of: DataFrame, applied: int) -> DataFrame:
    """steps replayed up to a command: the locks that are left (k, start_ts).  A prewrite puts a key's lock, a commit or
    either kind of rollback takes it away; the newest step of a key decides, so one aggregate replaces the replay."""
    done = of.where((F.col("cmd") <= applied) & (F.col("step") != "error"))
    newest = done.groupBy("k").agg(F.max(F.struct("cmd", "pos", "step", "start_ts")).alias("last"))
    return newest.where("last.step = 'prewrite'").select("k", F.col("last.start_ts").alias("start_ts"))


def lock_values(of: DataFrame, values: DataFrame) -> DataFrame:
    """Prewrites with the value that lies in the default family (values: k, start_ts, value); ``broken`` where it is missing."""
    locks = of.where("step = 'prewrite'")
    own = values.select("k", "start_ts", "value", F.lit(True).alias("found"))
    both = locks.join(own, ["k", "start_ts"], "left")
    return both.select("k", "start_ts", F.when(F.col("has_default"), F.col("value")).alias("value"), (F.col("has_default") & F.col("found").isNull()).alias("broken"))


def order_violations(rows: DataFrame, part: str, seq: str, order: Column) -> DataFrame:
    """Rows that are not strictly above the one before them in their file: what an ordered writer refuses."""
    before = F.lag(order).over(Window.partitionBy(part).orderBy(seq))
    return rows.withColumn("refused", F.coalesce(order <= before, F.lit(False)))
