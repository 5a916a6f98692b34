"""The thin queries of the operators over the tables of a folder, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import langid, toxicity
from .exact import exact_duplicates
from .labelled import held_out
from .neardup import near_duplicates
from .packing import pack_documents
from .quality import quality_scores
from .records import round_trip_digests
from .rules import quality_by_rules
from .spans import without_repeats
from .storage import Scratch, documents
from .tokenize import bpe_digests, public_vocabulary

Query = Callable[[SparkSession, str], DataFrame]


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"), Scratch(spark, "op1"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 75 * (p.n + q.n - i)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT reach.d, edge.y FROM reach JOIN edge ON reach.m = edge.x),
top AS (SELECT d, min(m) AS component_id FROM reach GROUP BY d)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, top.component_id, d.doc_id = top.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN top ON top.d = d.doc_id
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir, "doc_id", "text"), public_vocabulary())


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(documents(spark, sf_dir, "doc_id", "text"), Scratch(spark, "op3"), digests=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
b AS (SELECT norm, count(*) AS group_size, max(n_chars) AS most FROM d GROUP BY norm),
k AS (SELECT d.norm, min(d.doc_id) AS keep_id FROM d JOIN b ON d.norm = b.norm AND d.n_chars = b.most GROUP BY d.norm)
SELECT d.doc_id, k.keep_id, b.group_size, d.doc_id = k.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN b ON d.norm = b.norm JOIN k ON d.norm = k.norm
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.toxicity_scores(docs, toxicity.fit_labelled(docs, labels))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir, "doc_id", "text"), public_vocabulary(), Scratch(spark, "op5"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_by_rules(documents(spark, sf_dir, "doc_id", "text"), Scratch(spark, "op6"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_scores(documents(spark, sf_dir, "doc_id", "text"), labels, Scratch(spark, "op7"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    return langid.languages(docs, langid.fit(docs.where(~held_out(parts=3, part=1))))


def op9_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op9")
    return round_trip_digests(documents(spark, sf_dir, "doc_id", "text"), f"{scratch.path}/records", public_vocabulary())


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir, "doc_id", "text"), Scratch(spark, "op10"))


QUERIES: dict[str, Query] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_bpe": op2_bpe,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality": op7_quality,
    "op8_language": op8_language,
    "op9_records": op9_records,
    "op10_substring_dedup": op10_substring_dedup,
}
ORACLES: dict[str, str] = {"op1_near_dedup": OP1_SQL, "op3_exact_dedup": OP3_SQL}
