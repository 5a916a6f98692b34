"""Each stage of the pipeline against brute force on what the stage before it kept."""

import re

import numpy as np
import pytest

import brute
import corpus_pipeline
from keystrata.llm import queries, tokenize, toxicity
from keystrata.llm.storage import Scratch

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    columns = docs.columns
    out["documents"] = [r.asDict() for r in docs.collect()]
    scratch = Scratch(spark, "test-pipeline")
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.write(stage(spark, docs, DATA), name)
        if name != "packing":
            assert docs.columns == columns
        out[name] = [r.asDict() for r in docs.collect()]
    return out


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "substring_dedup", "packing"]


def test_toxicity(spark, kept):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    net = toxicity.fit_labelled(docs, spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic"))
    before = texts(kept["documents"])
    scores = dict(zip(before, net.scores(list(before.values()))))
    assert set(texts(kept["toxicity"])) == {i for i, s in scores.items() if s < 0.5}


def test_exact(kept):
    best = {}
    for i, t in texts(kept["toxicity"]).items():
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = max(best.get(key, (-1, 0)), (len(t), -i))
    assert set(texts(kept["exact_dedup"])) == {-i for _, i in best.values()}


def test_near(kept):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))

    def sets(t):
        w = words(t)
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    own = {i: sets(t) for i, t in texts(kept["exact_dedup"]).items()}
    top = {i: i for i in own}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(own)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(own[a] & own[b])
            if both and 100 * both >= 75 * (len(own[a]) + len(own[b]) - both):
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    assert set(texts(kept["near_dedup"])) == {i for i in ids if find(i) == i}


def test_substring(kept):
    before, after = texts(kept["near_dedup"]), kept["substring_dedup"]
    want = brute.without_repeats({i: t or "" for i, t in before.items()})
    assert {r["doc_id"]: (r["text"] or "").split() for r in after} == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in after)


def test_packing(kept):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenize.public_vocabulary())
    lengths = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in texts(kept["substring_dedup"]).items()}
    got, sequences = {}, {}
    for r in kept["packing"]:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == lengths
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(sequences) <= -(-sum(lengths.values()) // 4096) + 2


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) <= names and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
