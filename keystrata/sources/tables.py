"""Key histories as DataFrames, derived from the ``events`` table.

mutations: k, start_ts, commit_ts, op (P put, D delete, L lock only, R rollback), value, and what they come from
regions:   region_id, start_key, end_key ('' is no bound), version, conf_version
log:       region_id, idx, term, size, event_id
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS_PER_REGION = 25


def key_of(user: Column | str) -> Column:
    return F.concat(F.lit("t"), F.lpad(F.col(user).cast("string") if isinstance(user, str) else user.cast("string"), 10, "0"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.col("event_id") % 10
    return events(spark, sf_dir).select(
        key_of("user_id").alias("k"),
        (F.col("event_id") * 10).alias("start_ts"),
        (F.col("event_id") * 10 + 5).alias("commit_ts"),
        F.when(last == 0, "R").when(last == 1, "L").when(last == 2, "D").otherwise("P").alias("op"),
        "value",
        "event_id",
        "user_id",
        F.floor(F.col("user_id") / KEYS_PER_REGION).cast("long").alias("region_id"),
        (F.length("props") + 16).cast("long").alias("size"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each block of users; the only driver-side number is the largest block."""
    ids = events(spark, sf_dir).agg(F.max(F.floor(F.col("user_id") / KEYS_PER_REGION)).cast("long").alias("top"))
    rows = ids.select("top", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("region_id"))
    n = F.lit(KEYS_PER_REGION)
    return rows.select(
        "region_id",
        F.when(F.col("region_id") == 0, "").otherwise(key_of(F.col("region_id") * n)).alias("start_key"),
        F.when(F.col("region_id") == F.col("top"), "").otherwise(key_of((F.col("region_id") + 1) * n)).alias("end_key"),
        (1 + F.col("region_id") % 3).alias("version"),
        (1 + F.col("region_id") % 2).alias("conf_version"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = F.row_number().over(Window.partitionBy("region_id").orderBy("event_id")).cast("long")
    rows = mutations(spark, sf_dir).select("region_id", idx.alias("idx"), "size", "event_id", "k", "op")
    return rows.withColumn("term", (1 + F.floor(F.col("idx") / 500)).cast("long"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the transactions of ``mutations`` send: a command at start_ts and one at commit_ts, of one to three requests.

    Values above 100 lie in the default family; of those, ``error`` events lost their lock, ``view`` events are never
    committed, and lock-only ``signup`` events are collected as garbage when they commit.
    """
    rows = events(spark, sf_dir).select("event_id", "event_type").join(mutations(spark, sf_dir), "event_id")
    op, kind, large = F.col("op"), F.col("event_type"), F.col("value") > 100

    def one(what: str, cf: str, rollback: Column | bool = False) -> Column:
        return F.struct(F.lit(what).alias("kind"), F.lit(cf).alias("cf"), (rollback if isinstance(rollback, Column) else F.lit(rollback)).alias("rollback"))

    first = F.array(F.when(large, one("put", "default")), F.when(~(large & (kind == "error")), one("put", "lock")))
    write = F.array(F.when((op == "L") & (kind == "signup"), one("delete", "write")), F.when((op == "R") & large, one("delete", "default")), one("put", "write", op == "R"), one("delete", "lock"))
    second = F.when((op == "P") & (kind == "view"), F.array().cast(write_type())).otherwise(write)
    both = F.explode(F.array(F.struct(F.col("start_ts").alias("cmd"), first.alias("sent")), F.struct(F.col("commit_ts").alias("cmd"), second.alias("sent"))))
    out = rows.select("k", "start_ts", "region_id", "value", both.alias("c")).select("*", F.posexplode(F.filter("c.sent", lambda x: x.isNotNull())).alias("pos", "r"))
    return out.select(F.col("c.cmd").alias("cmd"), "pos", "r.kind", "r.cf", "r.rollback", "k", "start_ts", "region_id", "value")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; in local mode a temporary one where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="keystrata-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_type() -> str:
    return "array<struct<kind:string,cf:string,rollback:boolean>>"


#: The same in DuckDB's SQL, as common table expressions.
SQL = """
mutations AS (
  SELECT 't' || lpad(CAST(user_id AS VARCHAR), 10, '0') AS k, event_id * 10 AS start_ts, event_id * 10 + 5 AS commit_ts,
    CASE event_id % 10 WHEN 0 THEN 'R' WHEN 1 THEN 'L' WHEN 2 THEN 'D' ELSE 'P' END AS op, value, event_id, user_id,
    CAST(floor(user_id / 25) AS BIGINT) AS region_id, CAST(length(props) + 16 AS BIGINT) AS size
  FROM events),
top AS (SELECT max(region_id) AS top FROM mutations),
regions AS (
  SELECT i AS region_id, CASE WHEN i = 0 THEN '' ELSE 't' || lpad(CAST(i * 25 AS VARCHAR), 10, '0') END AS start_key,
    CASE WHEN i = top THEN '' ELSE 't' || lpad(CAST((i + 1) * 25 AS VARCHAR), 10, '0') END AS end_key, 1 + i % 3 AS version, 1 + i % 2 AS conf_version
  FROM (SELECT top, unnest(range(0, top + 1)) AS i FROM top)),
log AS (
  SELECT *, CAST(1 + floor(idx / 500) AS BIGINT) AS term
  FROM (SELECT region_id, row_number() OVER (PARTITION BY region_id ORDER BY event_id) AS idx, size, event_id, k, op FROM mutations))
"""

#: What the requests amount to, told from the events themselves.
STEPS_SQL = """, steps AS (
  SELECT m.start_ts AS cmd, CASE WHEN m.value > 100 AND e.event_type = 'error' THEN 'error' ELSE 'prewrite' END AS step, m.k, m.start_ts, m.value > 100 AS has_default, m.region_id, m.value
  FROM mutations m JOIN events e ON e.event_id = m.event_id
  UNION ALL
  SELECT m.commit_ts, CASE WHEN m.op = 'R' THEN 'rollback' ELSE 'commit' END, m.k, m.start_ts, m.op = 'R' AND m.value > 100, m.region_id, m.value
  FROM mutations m JOIN events e ON e.event_id = m.event_id
  WHERE NOT (m.op = 'P' AND e.event_type = 'view') AND NOT (m.op = 'L' AND e.event_type = 'signup'))
"""
