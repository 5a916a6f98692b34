"""Shared scratch folder: written tables that cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
#: Bytes of text that are taken apart at a time in a Python worker.
SLICE = 4 << 20
#: Bytes of Arrow batches after which a task gives freed memory back.
BETWEEN = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where it is unset, a temporary folder in local mode; an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="keystrata-"))
    return "file://" + _LOCAL[0]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


class Scratch:
    """A run's own folder below the shared one; removed when the process ends, tables earlier by ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def close(self) -> None:
        try:
            delete(self.spark, self.path)
        except Exception:  # the session has ended before the process
            pass

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the table once and reads it back: the plan above starts from files."""
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.path}/{name}")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spread(df.select(*columns) if columns else df)


def spread(files: DataFrame) -> DataFrame:
    """A table of fewer input splits than cores (one small file, say) is dealt to all cores; any other is read in place."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(cores) if files.rdd.getNumPartitions() < cores else files


def bounded(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Marks a table of a few narrow columns for broadcast if it has at most ``rows`` rows; else leaves the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``size`` bytes of text (one row at least), none of them empty."""
    for batch in batches:
        ends, at = np.cumsum(_lengths(batch.column(column))), 0
        while at < len(batch):
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, end - at)
            at = end


def _lengths(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], encodes: bool = False) -> Callable:
    """``run`` for mapInArrow, in a worker that stays as small as this task needs.

    Spark keeps a Python worker for the next tasks, and the allocators keep what a task has freed, so that the steps of a
    job add up.  Freed memory goes back to the system before and after the task and every ``BETWEEN`` bytes of input; encoders and
    their memos go when a task that does not encode begins.
    """

    def task(batches):
        if not encodes:
            _forget_encoders()
        give_back()
        try:
            yield from run(_giving_back(batches))
        finally:
            give_back()

    return task


def _giving_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = 0
    for batch in batches:
        yield batch
        seen += batch.nbytes
        if seen >= BETWEEN:
            give_back()
            seen = 0


def give_back() -> None:
    """Returns freed memory, Arrow's and that of malloc, to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)


def _forget_encoders() -> None:
    bpe = sys.modules.get("keystrata.llm.bpe")
    if bpe and bpe._ENCODERS:
        bpe._ENCODERS.clear()
        gc.collect()


def text_key() -> Column:
    """What tells rows with one doc_id apart: a hash of the whole text as it stands."""
    return F.xxhash64("text")


def without_rows(docs: DataFrame, rows: DataFrame, order: Column, scratch: Scratch) -> DataFrame:
    """``docs`` with one row of each group: the smallest by ``order``.

    rows: a written table of (doc_id, t, group) of the groups with several rows, and what ``order`` needs.  A row
    goes by its doc_id (null ones as well) and text; rows that repeat both are one, of which one stays.
    """
    best = rows.groupBy("group").agg(F.min(order).alias("best"))
    both = rows.groupBy("group", "doc_id", "t").agg(F.min(order).alias("own"), F.count("*").alias("times")).join(bounded(best), "group")
    both = scratch.write(both.select("doc_id", "t", (F.col("own") == F.col("best")).alias("first"), "times").where("not first OR times > 1"), "leaving")
    gone = both.where("not first").select("doc_id", "t")
    rest = _joined(docs, gone, "left_anti")
    repeated = both.where("first").select("doc_id", "t")
    if repeated.isEmpty():
        return rest
    once = _joined(rest, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return _joined(rest, repeated, "left_anti").unionByName(once)


def _joined(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    rows = bounded(rows.withColumnsRenamed({"doc_id": "_doc", "t": "_text"}))
    return docs.join(rows, docs["doc_id"].eqNullSafe(rows["_doc"]) & (F.xxhash64(docs["text"]) == rows["_text"]), how)
