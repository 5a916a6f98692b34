"""Language identification by nearest centroid.

A text is the vector of its letter trigrams (over bytes of its lower-cased UTF-8, everything but
letters as one class), damped, weighted by inverse document frequency and normalised.  Each
language has several centroids, found by clustering its vectors on the sphere; a text takes the
language of the nearest one by cosine.  A text farther from it than nearly all texts of that
language were (``REJECT`` of them) is marked rejected; its language is still named.

At most ``SAMPLE`` documents of each language are learned from, as trigram counts.  Texts
without a letter, and null texts, are ``und`` with score 0.  If nothing can be learned all are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out

SAMPLE, FEATURES, CENTROIDS, REJECT = 1200, 4096, 4, 0.005
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def _classes() -> np.ndarray:
    of = np.zeros(256, np.int32)
    of[97:123] = np.arange(1, 27)
    of[128:] = 27 + np.arange(128) % 32  # bytes of letters beyond ASCII
    return of


_CLASS = _classes()


def trigrams(text: str) -> np.ndarray:
    c = _CLASS[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    code = c[:-2] << 12 | c[1:-1] << 6 | c[2:]
    return code[c[1:-1] > 0]


def counted(docs: DataFrame) -> DataFrame:
    """(lang, codes, counts): trigrams of each row."""

    def run(batches):
        for batch in batches:
            codes, counts = [], []
            for text in batch.column("text").to_pylist():
                c, n = np.unique(trigrams(text or ""), return_counts=True)
                codes.append(c.astype(np.int32))
                counts.append(n.astype(np.int32))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(codes, kind), pa.array(counts, kind)], ["lang", "codes", "counts"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, codes array<int>, counts array<int>")


class Centroids:
    """Fitted on (language, codes, counts) rows."""

    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 3):
        seen = np.zeros(1 << 18, np.int64)
        for _, codes, _ in rows:
            seen[codes] += 1
        top = np.argsort(-seen, kind="stable")[:FEATURES]
        top = top[seen[top] > 0]
        self.place = np.full(1 << 18, len(top), np.int32)  # the last place takes what is no feature
        self.place[top] = np.arange(len(top))
        self.idf = np.append(np.log((1 + len(rows)) / (1 + seen[top])) + 0.1, 0).astype(np.float32)
        self.names: list[str] = []
        self.least: list[float] = []
        self.centroids = np.zeros((0, len(self.idf)), np.float32)
        draw = np.random.default_rng(seed)
        for lang in sorted({r[0] for r in rows}):
            x = np.stack([self._weigh(codes, counts) for name, codes, counts in rows if name == lang])
            centre = self._cluster(x, draw)
            self.centroids = np.concatenate([self.centroids, centre])
            self.names += [lang] * len(centre)
            self.least += [float(np.quantile((x @ centre.T).max(1), REJECT))] * len(centre)

    def _weigh(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = np.bincount(self.place[codes], counts, len(self.idf)).astype(np.float32)
        return self._unit(np.log1p(v) * self.idf)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / max(float(np.sqrt(v @ v)), 1e-9)

    def _cluster(self, x: np.ndarray, draw: np.random.Generator) -> np.ndarray:
        centre = x[draw.choice(len(x), min(CENTROIDS, len(x)), replace=False)]
        for _ in range(10):
            near = (x @ centre.T).argmax(1)
            centre = np.stack([self._unit(x[near == k].mean(0)) if (near == k).any() else centre[k] for k in range(len(centre))])
        return centre

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine to its nearest centroid, rejected."""
        if not text or not self.names or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        v = np.log1p(np.bincount(self.place[trigrams(text)], minlength=len(self.idf)).astype(np.float32)) * self.idf
        cosine = self.centroids @ self._unit(v)
        k = int(cosine.argmax())
        score = min(1.0, max(0.0, float(cosine[k])))
        return self.names[k], score, score < self.least[k]


def fit(docs: DataFrame, most: int = SAMPLE) -> Centroids:
    """docs: (doc_id, text, lang), only rows to learn from; nearly ``most`` of each language, chosen by a hash of the id."""
    known = docs.where(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Centroids([])
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, most / n)).otherwise(share)
    rows = counted(known.where(part < share)).collect()
    return Centroids([(r["lang"], np.array(r["codes"], np.int64), np.array(r["counts"], np.int64)) for r in rows])


def languages(docs: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        predict = shared.value.predict
        for batch in batches:
            found = [predict(t) for t in batch.column("text").to_pylist()]
            lang, score, far = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", "text", held_out(parts=3, part=1).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
