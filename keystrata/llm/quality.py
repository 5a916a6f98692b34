"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Shallow trees on bootstrap samples of labelled rows give their paths as rules (conjunctions of
comparisons); a logistic model over all rules is fitted with an l1 penalty, so that few rules
keep a weight; those are compiled into one Spark column expression over the statistics.

The text is read once, for its statistics, which are written as a narrow table.  At most
``SAMPLE`` labelled rows (their statistics, not their texts) come to the driver.

Null texts count as empty; an empty text has all statistics 0 and is scored like any other.
Without labels of both kinds the score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, learnable, sample
from .storage import Scratch

SAMPLE, TREES, LEVELS, CUTS, PENALTY = 12_000, 24, 3, 16, 0.002
STATISTICS = ["words", "mean_length", "distinct", "top_word", "next_same", "symbols", "bars", "calls", "capitals", "letters", "digits", "lines", "dup_lines", "dup_runs", "stops", "short", "longest"]


def statistics(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    count = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    runs = list(zip(words, words[1:], words[2:], words[3:]))
    ascii_ = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    bins = np.bincount(ascii_, minlength=256)
    return [
        float(n),
        chars / n,
        len(count) / n,
        max(count.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        float(bins[[35, 42, 36, 37, 38, 60, 62]].sum()) / n,
        float(bins[124]) / n,
        float(bins[33] + bins[63]) / n,
        float(bins[65:91].sum()) / chars,
        float(bins[97:123].sum() + bins[65:91].sum() + bins[192:].sum()) / chars,
        float(bins[48:58].sum()) / chars,
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
        1 - len(set(runs)) / len(runs) if runs else 0.0,
        float(bins[46]) / n,
        sum(1 for w in words if len(w) <= 3) / n,
        max(map(len, count)) / 10,
    ]


def _table(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = np.array([statistics(t) for t in batch.column("text").to_pylist()], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in rows.T)], ["doc_id", *STATISTICS])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in STATISTICS))


Rule = tuple[tuple[int, bool, float], ...]


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = 7, trees: int = TREES, levels: int = LEVELS) -> list[Rule]:
    """Paths from the root to every other node: (statistic, above?, cut) each."""
    draw = np.random.default_rng(seed)
    tests: list[tuple[int, float]] = []
    for f in range(x.shape[1]):
        tests += [(f, float(c)) for c in np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, CUTS)))]
    above = np.stack([x[:, f] > c for f, c in tests], 1).astype(np.float32)
    rules: set[Rule] = set()
    for _ in range(trees):
        weight = draw.multinomial(len(y), np.full(len(y), 1 / len(y))).astype(np.float32)
        offered = draw.random(len(tests)) < 0.5
        nodes: list[tuple[Rule, np.ndarray]] = [((), weight)]
        for _ in range(levels):
            further = []
            for path, w in nodes:
                total, ones = w.sum(), (w * y).sum()
                if total < 20 or ones in (0, total):
                    continue
                up, up_ones = w @ above, (w * y) @ above
                down, down_ones = total - up, ones - up_ones
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = up_ones * (1 - up_ones / up) + down_ones * (1 - down_ones / down)
                gain = np.where(offered & (up >= 5) & (down >= 5), gain, np.inf)
                k = int(gain.argmin())
                if not np.isfinite(gain[k]):
                    continue
                f, c = tests[k]
                for side, rows in ((True, above[:, k]), (False, 1 - above[:, k])):
                    further.append(((*path, (f, side, c)), w * rows))
            rules.update(path for path, _ in further)
            nodes = further
    return sorted(rules)


def _holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float32)
    for k, rule in enumerate(rules):
        for f, side, c in rule:
            out[:, k] *= (x[:, f] > c) == side
    return out


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient; the intercept is free of the penalty."""
    share = min(0.999, max(0.001, float(y.mean())))
    w, b = np.zeros(x.shape[1]), float(np.log(share / (1 - share)))
    v, c, t = w.copy(), b, 1.0
    probe = np.ones(x.shape[1])
    for _ in range(12):  # the largest curvature, by power iteration
        probe = x.T @ (x @ probe)
        probe /= np.linalg.norm(probe) or 1
    step = 1 / (0.25 * (np.linalg.norm(x @ probe) ** 2 / len(y) + 1) + 1e-9)
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(x @ v + c))) - y
        new = v - step * (x.T @ error) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        free = c - step * error.mean()
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, c = new + (last - 1) / t * (new - w), free + (last - 1) / t * (free - b)
        w, b = new, free
    return w, b


def compiled(rules: list[Rule], weights: np.ndarray, intercept: float) -> Column:
    """The probability as a column expression over the statistics."""
    odds = F.lit(float(intercept))
    for rule, w in zip(rules, weights, strict=True):
        if w:
            holds = None
            for f, side, c in rule:
                test = F.col(STATISTICS[f]) > c if side else F.col(STATISTICS[f]) <= c
                holds = test if holds is None else holds & test
            odds = odds + F.when(holds, float(w)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def fit(rows: np.ndarray, labels: np.ndarray) -> tuple[list[Rule], np.ndarray, float]:
    if len(np.unique(labels)) < 2:
        share = min(0.999, max(0.001, float(labels.mean()))) if len(labels) else 0.5
        return [], np.empty(0), float(np.log(share / (1 - share)))
    rules = tree_rules(rows, labels)
    if not rules:
        share = float(labels.mean())
        return [], np.empty(0), float(np.log(share / (1 - share)))
    weights, intercept = lasso_logistic(_holds(rules, rows).astype(float), labels)
    return rules, weights, intercept


def quality_scores(docs: DataFrame, labels: DataFrame, scratch: Scratch, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs`` (doc_id, text); labels: (doc_id, quality)."""
    table = scratch.write(_table(docs), "statistics")
    rows = sample(table.join(learnable(labels, "quality"), "doc_id"), SAMPLE).select("label", *STATISTICS).toPandas()
    rules, weights, intercept = fit(rows[STATISTICS].to_numpy(float), rows["label"].to_numpy(float))
    scored = table.withColumn("score", compiled(rules, weights, intercept))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
