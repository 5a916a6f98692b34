"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

Data file: for each document one frame
    u64 length | u32 masked crc of those 8 bytes | payload | u32 masked crc of the payload
(little-endian; a masked crc is the crc-32 turned right by 15 bits plus a constant).  Payload:
u8 flags (1: doc_id is there, 2: ids of 32 bits, else of 16), i64 doc_id, u32 ids, then the ids
compressed with zstd.  Index file: u64 offset | u32 frame length | u32 ids, for each frame.

Documents are dealt to files by ranges of doc_id, so the files in their order hold them in
ascending doc_id order (null doc_ids first; equal ones by their ids).  Only encoded payloads are
shuffled.  Each task writes under a name of its own and reports it in the manifest, a Parquet
table that Spark commits; a task that runs twice leaves one file that no manifest names.  Files
go to any store that pyarrow.fs opens (file, hdfs, s3, gs).

Null texts count as empty: the end id alone.  An empty table gives an empty manifest.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .storage import sliced

#: Fixed values of the frame's masked checksum.
MASK_TURN, MASK_ADD = 15, 0xA282EAD8
_HEAD, _INDEX = struct.Struct("<BqI"), struct.Struct("<QII")
_MANIFEST = "bucket int, data string, index string, n_records long, n_tokens long, n_bytes long"


def masked_crc(data: bytes) -> int:
    c = crc32(data)
    return ((c >> MASK_TURN | c << 32 - MASK_TURN) + MASK_ADD) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def head(doc_id: int | None, wide: bool, n: int) -> bytes:
    return _HEAD.pack((doc_id is not None) + 2 * wide, doc_id or 0, n)


def entry(offset: int, size: int, n: int) -> bytes:
    return _INDEX.pack(offset, size, n)


def unframe(data: bytes) -> bytes:
    """The payload of one frame; ValueError if it is cut or changed."""
    if len(data) < 16 or struct.unpack_from("<I", data, 8)[0] != masked_crc(data[:8]):
        raise ValueError("the length of a record is damaged")
    end = 12 + struct.unpack_from("<Q", data)[0]
    if len(data) != end + 4 or struct.unpack_from("<I", data, end)[0] != masked_crc(data[12:end]):
        raise ValueError("a record is damaged")
    return data[12:end]


class _Codec:
    def __init__(self) -> None:
        import zstandard

        self._pack, self._unpack = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()

    def body(self, ids: bytes) -> tuple[bool, bytes]:
        array = np.frombuffer(ids, "<u4")
        wide = bool(len(array)) and int(array.max()) > 0xFFFF
        return wide, self._pack.compress(ids if wide else array.astype("<u2").tobytes())

    def ids(self, wide: bool, body: bytes) -> np.ndarray:
        return np.frombuffer(self._unpack.decompress(body), "<u4" if wide else "<u2").astype("<u4")


def write_records(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = 1, files: int | None = None) -> DataFrame:
    """Encodes and writes ``docs`` (doc_id, text) below ``path``; the manifest, one row for each file."""
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    bounds = docs.select("doc_id").approxQuantile("doc_id", [i / files for i in range(1, files)], 0.2 / files) if files > 1 else []
    cuts = np.unique(np.array(bounds, np.int64))

    def encode(batches):
        enc, codec = encoder(vocabulary, library=True), _Codec()
        end = b"" if end_id is None else end_id.to_bytes(4, "little")
        for batch in sliced(batches):
            ids = [x + end for x in enc.encode(batch.column("text").to_pylist())]
            bodies = [codec.body(x) for x in ids]
            doc_id = batch.column("doc_id")
            bucket = np.searchsorted(cuts, doc_id.fill_null(-(2**63)).to_numpy(zero_copy_only=False), "right")
            columns = [pa.array(bucket, pa.int32()), doc_id, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([w for w, _ in bodies], pa.bool_()), pa.array([b for _, b in bodies], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "doc_id", "n_tokens", "wide", "body"])

    encoded = docs.mapInArrow(encode, "bucket int, doc_id long, n_tokens long, wide boolean, body binary")
    dealt = encoded.repartitionById(files, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "n_tokens", "body")

    def write(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        open_at, made = None, []
        for batch in batches:
            for bucket, doc_id, n, wide, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_at != bucket:
                    if made:
                        data.close(), index.close()
                    name = f"part-{bucket:06d}-{uuid.uuid4().hex}"
                    store.create_dir(base, recursive=True)
                    data, index = store.open_output_stream(f"{base}/{name}.records"), store.open_output_stream(f"{base}/{name}.index")
                    open_at = bucket
                    made.append([bucket, f"{name}.records", f"{name}.index", 0, 0, 0])
                record = frame(head(doc_id, wide, n) + body)
                data.write(record)
                index.write(entry(made[-1][5], len(record), n))
                made[-1][3:] = made[-1][3] + 1, made[-1][4] + n, made[-1][5] + len(record)
        if made:
            data.close(), index.close()
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds, strict=True)], [f.split()[0] for f in _MANIFEST.split(", ")])

    at = f"{path}/manifest"
    dealt.mapInArrow(write, _MANIFEST).write.mode("overwrite").parquet(at)
    return spark.read.schema(_MANIFEST).parquet(at)


def read_file(path: str, data: str, index: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of each record of one file, found by its index; damage raises ValueError."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    codec = _Codec()
    with store.open_input_stream(f"{base}/{index}") as f:
        entries = f.read()
    with store.open_input_stream(f"{base}/{data}", buffer_size=1 << 20) as f:
        for _, size, n in _INDEX.iter_unpack(entries):
            payload = unframe(f.read(size))
            flags, doc_id, count = _HEAD.unpack_from(payload)
            ids = codec.ids(bool(flags & 2), payload[_HEAD.size :])
            if not n == count == len(ids):
                raise ValueError("a record and its index differ")
            yield (doc_id if flags & 1 else None), ids


def read_record(path: str, data: str, index: str, k: int) -> tuple[int | None, np.ndarray]:
    """The k-th record of a file, by its offset: what a shuffled reader calls."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{base}/{index}") as f:
        offset, size, _ = _INDEX.unpack(f.read_at(_INDEX.size, k * _INDEX.size))
    with store.open_input_file(f"{base}/{data}") as f:
        payload = unframe(f.read_at(size, offset))
    flags, doc_id, _ = _HEAD.unpack_from(payload)
    return (doc_id if flags & 1 else None), _Codec().ids(bool(flags & 2), payload[_HEAD.size :])


def _held(records: Iterator[tuple[int | None, np.ndarray]], size: int = 1 << 20) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """Records by the list, of little more than ``size`` ids each."""
    held, n = [], 0
    for record in records:
        held.append(record)
        n += len(record[1]) + 16
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _placed(manifest: DataFrame) -> DataFrame:
    """Each file with the number of ids before it; one row for each file, each in a task of its own."""
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("bucket", "data", "index", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"))
    top = manifest.agg(F.max("bucket")).head()[0]
    return files.repartitionById((top or 0) + 1, F.col("bucket"))


def read_records(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of every record."""

    def read(batches):
        for batch in batches:
            for _, data, index, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for held in _held(read_file(path, data, index)):
                    ends = np.cumsum([0, *(len(ids) for _, ids in held)])
                    own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([ids for _, ids in held]).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int64()), pa.array(ends[:-1] + start, pa.int64()), own], ["doc_id", "start", "ids"])
                    start += int(ends[-1])

    return _placed(manifest).mapInArrow(read, "doc_id long, start long, ids array<int>")


def read_digests(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc-32 of the ids, read back from the files."""

    def read(batches):
        for batch in batches:
            for _, data, index, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for held in _held(read_file(path, data, index)):
                    rows = []
                    for doc_id, ids in held:
                        rows.append((doc_id, start, len(ids), crc32(ids)))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(manifest).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip_digests(docs: DataFrame, path: str, vocabulary: str, files: int | None = None) -> DataFrame:
    return read_digests(write_records(docs, path, vocabulary, files=files), path)


def remove(spark: SparkSession, path: str) -> None:
    from .storage import delete

    delete(spark, path)
