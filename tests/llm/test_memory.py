"""What tasks leave in the Python workers that Spark keeps for the next ones."""

import pyarrow as pa
import pytest

from keystrata.llm import bpe, neardup, packing, spans, storage, toxicity
from keystrata.llm.storage import Scratch
from keystrata.llm.tokenize import public_vocabulary

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tasks(spark):
    """The Python functions of the pipeline's stages."""
    docs, own, kind, made = spark.read.parquet(f"{DATA}/documents.parquet").limit(60), [], type(spark.range(1)), {}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic")
    scratch = Scratch(spark, "test-memory")
    plain = kind.mapInArrow
    kind.mapInArrow = lambda self, f, *a, **b: own.append(f) or plain(self, f, *a, **b)
    try:
        for name, stage in (
            ("toxicity", lambda: toxicity.drop_toxic(docs, labels)),
            ("near_dedup", lambda: neardup.drop_near_duplicates(docs, scratch)),
            ("substring_dedup", lambda: spans.drop_repeats(docs, scratch)),
            ("packing", lambda: packing.token_pieces(docs, public_vocabulary())),
        ):
            stage()
            made[name], own[:] = [*own], []
    finally:
        kind.mapInArrow = plain
    return made


@pytest.mark.parametrize("stage", ["toxicity", "near_dedup", "substring_dedup"])
def test_other_tasks_drop_the_encoder(tasks, stage):
    assert tasks[stage]
    for task in tasks[stage]:
        bpe.encoder(public_vocabulary(), library=True)
        assert list(task(iter(()))) == []
        assert not bpe._ENCODERS


def test_encoding_tasks_keep_the_encoder_without_its_file(tasks):
    own = bpe.encoder(public_vocabulary(), library=True)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["Some words, and a number: 12.", None]})
    rows = [r for b in tasks["packing"][0](iter([batch])) for r in b.to_pylist()]
    assert [(r["doc_id"], r["start"]) for r in rows] == [(1, 0), (2, 0)] and rows[1]["length"] == 1
    assert bpe.encoder(public_vocabulary(), library=True) is own and not own._backend.model


def test_freed_memory_goes_back_while_a_task_runs(tasks, monkeypatch):
    times = []
    monkeypatch.setattr(storage, "give_back", lambda: times.append(1))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["x" * (storage.BETWEEN + 1)]})
    list(tasks["packing"][0](iter([batch, batch])))
    assert len(times) == 4  # before, after each of two batches, after
