"""Repeated passages: hash every run of several consecutive sentences and remove the later copies.

A text is cut into sentences after ``.``, ``!``, ``?`` or an ellipsis before white space, after
their CJK forms and at blank lines; clauses (``,``, ``;``, ``:``) count as sentences too, so that a
passage set into the middle of another sentence meets its copies after its first clause.  The
pieces with the white space after them tile the text.  Single line ends are ends of sentences in
lists and the like, but not in wrapped text, so a text that has such ends is cut both ways, and
the runs of both are hashed; what goes is told by the finer pieces.

A run is several consecutive sentences (two at least), as few as hold ``WORDS`` words: the one that
starts at each sentence and the one that ends at each.  So every whole sentence of a passage with
that many words, but for what is no whole sentence at its ends, lies in a run inside it.  Words
are parted by white space; two characters of a script without spaces count as one.  Runs are
equal when their words are (lower case, any white space).

Across the corpus the first occurrence of a run is in the document of smallest doc_id, there at
the smallest position; sentences covered by any other occurrence are removed.  Only hashes are
shuffled: one row for each run and document, written once and counted with partial aggregation; a
run that a third of the corpus has is joined back as narrow rows, which Spark splits when they are skewed.

Null texts stay null.  Documents with fewer words than a run stay as they are.  Rows that repeat
a doc_id are one document (equal texts: all stay, their inner repeats go); rows with a null
doc_id lose only what repeats inside them.  A document that is all repeats stays with an empty text.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .storage import Scratch, lean, sliced

WORDS, SEVERAL = 20, 2
#: Each match looks at white space or a CJK stop only, so that no text takes more than linear time.  Group 1: a single line end.
_CUT = re.compile(r"(?<=[.!?…,;:])\s+|(?<=[。！？，；：])(?![。！？，；：])|(\n[^\S\n]*(?!\s))|\n\s+")
#: Han, kana, Thai, Lao, Khmer and Burmese, which are written without spaces.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_COUNTS = ("n_sentences", "n_removed")


def cut(text: str) -> tuple[list[str], list[int]]:
    """Pieces that join to the text, and the numbers of those that begin after a single line end."""
    at, out, lines = 0, [], []
    for m in _CUT.finditer(text):
        end = m.end()
        if end > at:
            out.append(text[at:end])
            at = end
            if m.group(1) is not None:
                lines.append(len(out))
    if at < len(text):
        out.append(text[at:])
    return out, lines


def sentences(text: str) -> list[str]:
    return cut(text)[0]


def _n_words(piece: str) -> int:
    n = piece.count(" ") + 1
    return n if piece.isascii() else n + len(_UNSPACED.findall(piece)) // 2


def _spans(counts: list[int], words: int) -> set[tuple[int, int]]:
    """(first, end) of the shortest runs of ``SEVERAL`` sentences or more with so many words that start or end at each."""
    n, out, before = len(counts), set(), [0]
    for c in counts:
        before.append(before[-1] + c)
    end = start = 0
    for i in range(n):
        end = max(end, i + SEVERAL)
        while end <= n and before[end] - before[i] < words:
            end += 1
        if end <= n:
            out.add((i, end))
        last = i + 1 - SEVERAL
        while start < last and before[i + 1] - before[start + 1] >= words:
            start += 1
        if start <= last and before[i + 1] - before[start] >= words:
            out.add((start, i + 1))
    return out


def runs(parts: list[str], words: int = WORDS, lines: list[int] | tuple = ()) -> list[tuple[int, int, bytes]]:
    """(first piece, end, 16-byte hash) of every run, in order of place; each run once.  ``lines``: as of ``cut``."""
    own = [" ".join(p.lower().split()) for p in parts]
    kept = [i for i, p in enumerate(own) if p]  # pieces with words
    own = [own[i] for i in kept]
    counts = [_n_words(p) for p in own]
    found = _spans(counts, words)
    if lines:  # and without the cuts at single line ends
        inner, ends = set(lines), []
        for k, i in enumerate(kept):
            if k and not (i in inner):
                ends.append(k)
        ends = [0, *ends, len(own)] if own else [0]
        joined = [sum(counts[a:b]) for a, b in zip(ends, ends[1:])]
        found |= {(ends[i], ends[j]) for i, j in _spans(joined, words)}
    if not found:
        return []
    raw = [p.encode("utf-8", "surrogatepass") for p in own]
    text, at = memoryview(b" ".join(raw)), [0]
    for p in raw:
        at.append(at[-1] + len(p) + 1)
    digest = xxhash.xxh3_128_digest
    return [(kept[i], kept[j - 1] + 1, digest(text[at[i] : at[j] - 1])) for i, j in sorted(found)]


def _runs_of(text: str, words: int) -> tuple[list[str], list[tuple[int, int, bytes]]]:
    parts, lines = cut(text)
    return parts, runs(parts, words, lines)


def _run_table(docs: DataFrame, words: int) -> DataFrame:
    """(h, g, doc_id): each run once for each document."""

    def run(batches):
        for batch in sliced(batches):
            ids, many, digests = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text and doc_id is not None:
                    own = {d for _, _, d in _runs_of(text, words)[1]}
                    ids.append(doc_id)
                    many.append(len(own))
                    digests += own
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array((both[:, 1] >> 32).astype(np.int32)), pa.array(np.repeat(np.array(ids, np.int64), many))], ["h", "g", "doc_id"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "h long, g int, doc_id long")


def without_repeats(docs: DataFrame, scratch: Scratch, words: int = WORDS) -> DataFrame:
    """All columns of ``docs``, with the text that stays, then n_sentences and n_removed (in place of columns of these names)."""
    return _stripped(docs.drop(*_COUNTS), scratch, words, True)


def drop_repeats(docs: DataFrame, scratch: Scratch, words: int = WORDS) -> DataFrame:
    """The columns of ``docs``, whatever their names, with the text that stays."""
    return _stripped(docs, scratch, words, False)


def _stripped(docs: DataFrame, scratch: Scratch, words: int, counted: bool) -> DataFrame:
    table = scratch.write(_run_table(docs, words), "runs")
    first = table.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h", "g", "first")
    first = scratch.write(first, "repeated")
    later = table.join(first, ["h", "g"]).where("doc_id > first").select("doc_id", "h")
    mark = f"_gone_{uuid.uuid4().hex}"
    gone = scratch.write(later.groupBy("doc_id").agg(F.collect_set("h").alias(mark)), "later")
    scratch.drop("runs")
    both = docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left").select(*(docs[f"`{c}`"] for c in docs.columns), gone[mark])

    def run(batches):
        for batch in sliced(batches):
            texts, totals, removed = [], [], []
            gone = batch.column(batch.schema.get_field_index(mark))
            for text, hashes in zip(batch.column(at).to_pylist(), gone.to_pylist(), strict=True):
                kept, n, m = strip(text, hashes or (), words)
                texts.append(kept)
                totals.append(n)
                removed.append(m)
            columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns[:-1])]
            names = batch.schema.names[:-1]
            if counted:
                columns, names = [*columns, pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], [*names, *_COUNTS]
            yield pa.RecordBatch.from_arrays(columns, names)

    at = docs.columns.index("text")
    return both.mapInArrow(lean(run), StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in _COUNTS if counted)]))


def strip(text: str | None, gone, words: int = WORDS) -> tuple[str | None, int, int]:
    """The text without sentences covered by runs in ``gone`` (first 8 bytes of their hashes) or met before in it."""
    if not text:
        return text, 0, 0
    parts, own = _runs_of(text, words)
    lost, seen, gone = set(), {}, set(gone)
    for i, j, digest in own:
        if int.from_bytes(digest[:8], "little", signed=True) in gone or i >= seen.setdefault(digest, j):
            lost.update(range(i, j))
    return ("".join(p for k, p in enumerate(parts) if k not in lost) if lost else text), len(parts), len(lost)
