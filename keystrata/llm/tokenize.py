"""Token ids of whole texts as Spark tables: encode, decode and the digests of both.

Every step is a narrow map over Arrow batches; nothing is shuffled.  A null text counts as
empty; null or repeated doc_ids are carried as they are, one row out for each row in.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import encoder
from .storage import sliced

#: The vocabulary of the contract's queries.
WORD_BPE = "word_bpe_49k.json"


def public_vocabulary(name: str = WORD_BPE) -> str:
    """Path of an installed public vocabulary file; any other path may be passed instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", library: bool = False) -> DataFrame:
    """Adds ``ids`` (array of int); ``library``: merge with the tokenizers library, not the segment tree."""

    def run(batches):
        enc = encoder(vocabulary, library)
        for batch in batches:
            made = [np.frombuffer(x, "<i4") for x in enc.encode(batch.column(text).to_pylist())]
            ends = np.cumsum([0, *map(len, made)])
            flat = np.concatenate(made) if made else np.empty(0, np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, ids])

    return docs.mapInArrow(run, _schema(docs, ids, "array<int>"))


def bpe_decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of ``ids``: tokens joined by a space, as the vocabulary names no decoder. Null ids: empty."""

    def run(batches):
        decode = encoder(vocabulary).decode
        for batch in batches:
            made = [decode(np.asarray(x or [], "<u4").tobytes()) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, text])

    return df.mapInArrow(run, _schema(df, text, "string"))


def _schema(df: DataFrame, name: str, kind: str):
    from pyspark.sql.types import StructType, _parse_datatype_string

    if name in df.columns:
        raise ValueError(f"the table has a column {name}; pass another name")
    return StructType([*df.schema.fields, *_parse_datatype_string(f"{name} {kind}").fields])


def bpe_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, sha256 of the ids and of the text decoded from them."""

    def run(batches):
        enc = encoder(vocabulary)
        for batch in sliced(batches):
            counts, of_ids, of_text = [], [], []
            for ids in enc.encode(batch.column("text").to_pylist()):
                counts.append(len(ids) // 4)
                of_ids.append(sha256(ids).hexdigest())
                of_text.append(sha256(enc.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
