"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns, for every operator."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.llm import exact, labelled, langid, neardup, packing, quality, records, rules, spans, tokenize, toxicity
from keystrata.llm.storage import Scratch

LONG = " ".join(f"w{i}" for i in range(6000)) + "."
BASE = " ".join(f"alpha{i}" for i in range(60)) + "."
NEAR = BASE.replace("alpha59", "omega")
#: Extra columns named like those that operators make inside.
ROWS = [
    (1, BASE, "en", 7),
    (2, NEAR, "en", 7),
    (3, BASE + "\n", "en", 7),
    (4, None, None, None),
    (5, "", "de", 0),
    (6, " \t\n", "de", 0),
    (7, LONG, "en", 1),
    (8, "two words", "en", 1),
    (8, "two words", "en", 1),
    (9, "TWO  words", "de", 1),
    (None, "no id here", "en", 1),
    (10, "żółć 你好 İΣ <|endoftext|>", "de", 2),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, length long")


@pytest.fixture(scope="module")
def vocabulary():
    return tokenize.public_vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    t.no_truncation(), t.no_padding()
    return t


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_bpe_digests(docs, vocabulary, library):
    out = tokenize.bpe_digests(docs, vocabulary).collect()
    assert len(out) == len(ROWS)
    for row, (doc_id, text, *_) in zip(out, ROWS):
        ids = ids_of(library, text)
        assert (row.doc_id, row.n_tokens) == (doc_id, len(ids))
        assert row.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids.tolist(), skip_special_tokens=False).encode()).hexdigest()
    assert tokenize.bpe_digests(docs.limit(0), vocabulary).collect() == []


def test_bpe_columns(docs, vocabulary, library):
    out = tokenize.bpe_decode(tokenize.bpe_encode(docs, vocabulary), vocabulary)
    assert out.columns == [*docs.columns, "ids", "decoded"]
    for row, (_, text, *_) in zip(out.collect(), ROWS):
        assert row.ids == ids_of(library, text).tolist() and row.decoded == library.decode(row.ids, skip_special_tokens=False)
    with pytest.raises(ValueError):
        tokenize.bpe_encode(docs.withColumnRenamed("length", "ids"), vocabulary)


def brute_exact(rows):
    squeezed = [(i, t or "", "".join(c for c in t or "" if c not in " \t\n\x0b\f\r")) for i, t, *_ in rows]
    out = []
    for i, t, n in squeezed:
        group = [(len(b), a) for a, b, m in squeezed if m == n]
        most = max(x for x, _ in group)
        keep = min((a for x, a in group if x == most and a is not None), default=None)
        out.append((i, keep, len(group), i == keep and len(t) == most, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(map(str, out))


def test_exact(spark, docs):
    out = exact.exact_duplicates(docs, Scratch(spark, "t"), digests=True)
    assert sorted(map(str, map(tuple, out.collect()))) == brute_exact(ROWS)
    narrow = exact.exact_duplicates(docs, Scratch(spark, "t"))
    assert sorted(map(str, (tuple(r)[:4] for r in narrow.collect()))) == sorted(map(str, (tuple(r)[:4] for r in out.collect())))
    kept = exact.drop_exact_duplicates(docs, Scratch(spark, "t"))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["2", "3", "6", "7", "8", "9", "10", "None"])
    assert exact.exact_duplicates(docs.limit(0), Scratch(spark, "t")).collect() == []


def test_near(spark, docs):
    out = neardup.near_duplicates(docs, Scratch(spark, "t")).collect()
    assert len(out) == len(ROWS)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}
    assert got[1] == (56, 1, True) and got[2] == (56, 1, False) and got[3] == (56, 1, False)
    assert got[4] == (0, 4, True) and got[5] == (0, 5, True) and got[6] == (0, 6, True)
    assert got[7] == (5996, 7, True) and got[8] == (1, 8, True) and got[9] == (1, 8, False)
    assert got[None] == (1, None, True)
    assert neardup.drop_near_duplicates(docs, Scratch(spark, "t")).columns == docs.columns
    assert neardup.near_duplicates(docs.limit(0), Scratch(spark, "t")).collect() == []


def test_spans(spark, docs):
    out = by_id(spans.without_repeats(docs, Scratch(spark, "t")))
    assert out[1].text == BASE and out[3].text == BASE + "\n" and out[3].n_removed == 0  # one sentence is no run
    assert out[2].text == NEAR and out[4].text is None and out[8].text == "two words" and out[None].text == "no id here"
    assert spans.without_repeats(docs.limit(0), Scratch(spark, "t")).collect() == []
    clash = docs.select("*", F.lit(1).alias("n_removed"), F.lit("x").alias("h"), F.lit(2).alias("first"))
    assert spans.drop_repeats(clash, Scratch(spark, "t")).columns == clash.columns
    assert sorted(spans.without_repeats(clash, Scratch(spark, "t")).columns) == sorted([*clash.columns, "n_sentences"])


def test_rows_of_one_id_with_several_texts(spark):
    rows = [(1, "same text here"), (5, "same text here"), (5, "a text of its own, quite long"), (None, "same text here"), (None, "only null"), (None, "only null"), (9, " \n"), (9, " \n"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in exact.drop_exact_duplicates(docs, Scratch(spark, "t")).collect()]
    assert sorted(got, key=str) == sorted([(1, "same text here"), (5, "a text of its own, quite long"), (None, "only null"), (9, " \n")], key=str)
    got = [tuple(r) for r in neardup.drop_near_duplicates(docs, Scratch(spark, "t")).collect()]
    assert sorted(got, key=str) == sorted([(1, "same text here"), (5, "a text of its own, quite long"), (None, "only null"), (9, " \n"), (9, " \n"), (8, None)], key=str)


def test_packing(spark, docs, vocabulary, library):
    out = packing.pack_documents(docs, vocabulary, Scratch(spark, "t")).collect()
    want = []
    for doc_id, text, *_ in ROWS:
        ids = np.append(ids_of(library, text), 1).astype("<u4")
        want += [(doc_id, k, k * 4096, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(np.split(ids, range(4096, len(ids), 4096)))]
    assert sorted(map(str, (tuple(r)[:5] for r in out))) == sorted(map(str, want))
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(docs.limit(0), vocabulary, Scratch(spark, "t")).collect() == []


def test_records(spark, docs, vocabulary, library):
    path = Scratch(spark, "t").path + "/records"
    manifest = records.write_records(docs, path, vocabulary, files=3)
    out = records.read_digests(manifest, path).collect()
    ids = {i: np.append(ids_of(library, t), 1).astype("<u4") for i, t, *_ in ROWS}
    order = sorted((i for i, *_ in ROWS), key=lambda i: (i is not None, i or 0))
    start = 0
    for r, i in zip(sorted(out, key=lambda r: r.start), order, strict=True):
        assert tuple(r) == (i, start, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        start += len(ids[i])
    assert {r.doc_id: r.ids for r in records.read_records(manifest, path).collect()} == {i: x.astype(int).tolist() for i, x in ids.items()}
    part = manifest.orderBy("bucket").head()
    assert [records.read_record(path, part.data, part["index"], k)[0] for k in range(part.n_records)] == order[: part.n_records]
    empty = records.write_records(docs.limit(0), path + "-none", vocabulary, files=3)
    assert records.read_digests(empty, path + "-none").collect() == []


def test_damaged_records_are_refused():
    good = records.frame(b"payload")
    assert records.unframe(good) == b"payload"
    for k in range(len(good)):
        with pytest.raises(ValueError):
            records.unframe(good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :])
    with pytest.raises(ValueError):
        records.unframe(good[:-1])


def test_rules(spark, docs):
    out = rules.quality_by_rules(docs, Scratch(spark, "t")).collect()
    assert len(out) == len(ROWS)
    got = {r.doc_id: r for r in out}
    assert (got[4].n_words, got[4].base_failed, got[4].kept) == (0, True, False) and got[8].base_failed and got[7].n_words == 6000
    assert rules.quality_by_rules(docs.limit(0), Scratch(spark, "t")).collect() == []


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 0), (8, 0), (8, 0), (99, 1), (None, 1)], "doc_id long, quality int")
    out = quality.quality_scores(docs, labels, Scratch(spark, "t")).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    none = quality.quality_scores(docs, labels.limit(0), Scratch(spark, "t")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels, Scratch(spark, "t")).collect() == []


def test_languages(docs):
    model = langid.fit(docs.where(~labelled.held_out(parts=3, part=1)))
    out = langid.languages(docs, model).collect()
    assert len(out) == len(ROWS)
    got = {r.doc_id: r for r in out}
    assert got[4].lang_pred == got[5].lang_pred == got[6].lang_pred == "und" and got[4].score == 0
    assert {r.lang_pred for r in out} <= {"en", "de", "und"}
    assert {r.lang_pred for r in langid.languages(docs, langid.fit(docs.limit(0))).collect()} == {"und"}


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 0), (7, 1), (8, 1), (9, 0), (None, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity_scores(docs, toxicity.fit_labelled(docs, labels)).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert {r.held_out for r in out if r.doc_id is not None} == {True, False}
    none = toxicity.fit_labelled(docs, labels.limit(0))
    assert {r.score for r in toxicity.toxicity_scores(docs, none).collect()} == {0.0}
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
