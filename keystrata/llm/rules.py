"""Quality rules by weak supervision, in DataFrame functions alone.

Rules look at statistics of a text and vote good, bad or nothing.  No rule decides: expectation
maximisation over how often each pattern of votes occurs in the whole table estimates the share
of good documents and of each kind of bad ones, and how often each rule votes what in each.
The posterior probability of a good document then replaces the test that all rules pass.

The text is read once, for its statistics; they are written as a narrow table.  The patterns of
eight rules with three outcomes are at most 3 ** 8 = 6561 rows: those alone come to the
driver.  Nothing else is shuffled.

Null texts count as empty and have no words: base_failed and not kept.  Empty tables give empty
results.  Rows are judged one by one, repeated ones alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: The separators of words, and the symbols that are counted.
WHITE, WORD, SYMBOLS = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]", "[#*$%&|<>]"


def _count(text: str, characters: str) -> Column:
    return F.regexp_count(F.col(text), F.lit(characters))


def _joined(hashes: str, apart: int) -> Column:
    """Hashes of runs of twice the length, from those of two runs that begin so far apart."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(F.col(hashes), i + apart)))


def _covered(grams: str) -> Column:
    """Words that lie in windows whose hash occurs twice or more: windows sorted by hash meet their equals."""
    hash_and_place = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twins(s: Column) -> Column:
        same = F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]))
        return F.sort_array(F.filter(same, lambda p: p.isNotNull()))

    def union(places: Column) -> Column:
        own = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(own, F.lit(0), lambda a, x: a + x)

    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  names a value once
    return bound(hash_and_place, lambda s: bound(twins(s), union))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the contract, and those that only rules use; all long."""
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    t = t.withColumn("words", F.filter(F.split("t", WHITE + "+"), lambda w: w != ""))
    t = t.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)))
    t = t.select("doc_id", "t", "words", "lines", F.size("words").alias("n_words"))
    t = t.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    t = t.withColumn("by2", _joined("hashes", 1))
    t = t.withColumn("by4", _joined("by2", 2))
    t = t.withColumn("by8", _joined("by4", 4))
    grams = F.when(F.col("n_words") >= WINDOW, F.slice("by8", F.lit(1), F.col("n_words") - (WINDOW - 1)))
    t = t.select(
        "doc_id",
        "n_words",
        F.coalesce(grams, F.array().cast("array<long>")).alias("grams"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        _count("t", SYMBOLS).alias("n_symbols"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.array_distinct("hashes")).alias("n_distinct"),
        _count("t", "[A-Z]").alias("n_capitals"),
        _count("t", "[!?]").alias("n_calls"),
    )
    repeat = F.when(F.size(F.array_distinct("grams")) < F.size("grams"), _covered("grams")).otherwise(0)
    t = t.withColumn("n_repeat_words", repeat).drop("grams")
    return t.select("doc_id", *(F.col(c).cast("long") for c in t.columns if c != "doc_id"))


def votes() -> dict[str, tuple[Column, Column]]:
    """name: (when it votes bad, when it votes good); neither: it abstains."""
    c, n = F.col, F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    mean = F.col("word_chars") / n
    return {
        "symbols": (c("n_symbols") > 0.1 * n, c("n_symbols") <= 0.01 * n),
        "repeats": (100 * c("n_repeat_words") > 20 * n, 100 * c("n_repeat_words") <= 5 * n),
        "lines": ((c("n_dup_lines") >= 3) & (10 * c("n_dup_lines") > 2 * c("n_lines")), c("n_dup_lines") == 0),
        "capitals": (c("n_capitals") > 0.4 * chars, c("n_capitals") < 0.1 * chars),
        "calls": (c("n_calls") > 0.3 * n, c("n_calls") < 0.05 * n),
        "length": (c("n_words") < 10, c("n_words") >= 50),
        "mean": ((mean < 2.5) | (mean > 14), (mean > 3.5) & (mean < 10)),
        "variety": (c("n_distinct") < 0.2 * n, c("n_distinct") > 0.35 * n),
    }


BAD, GOOD, NONE = 0, 1, 2


def expectation_maximisation(patterns: dict[tuple[int, ...], int], rounds: int = 40) -> tuple[list[float], list[list[list[float]]]]:
    """patterns: how often each tuple of votes occurs.  Shares of the classes, and [class][rule][vote] rates;
    a rule that abstains says nothing (rate 1).

    Class 0 is a good document, class 1 + r one that is bad in the way that rule r looks for: bad documents
    seldom fail every rule, so one class for all of them would leave single failures to the good ones.
    """
    rules = len(next(iter(patterns), ()))
    total = sum(patterns.values()) or 1
    belief = {}
    for p in patterns:  # to begin with: good if all pass, else bad in each way that a rule names
        against = [float(v == BAD) for v in p]
        weight = [0.1 if any(against) else 1.0, *(0.9 * x / sum(against) if any(against) else 0.0 for x in against)]
        belief[p] = weight
    for _ in range(rounds):
        shares = [(1e-6 + sum(n * belief[p][k] for p, n in patterns.items())) / (total + 1e-6 * (rules + 1)) for k in range(rules + 1)]
        rates = []
        for k in range(rules + 1):
            mass = [[0.05, 0.05] for _ in range(rules)]
            for p, n in patterns.items():
                for r, v in enumerate(p):
                    if v != NONE:
                        mass[r][v] += n * belief[p][k]
            rates.append([[*(m / sum(row) for m in row), 1.0] for row in mass])
        for p in patterns:
            logs = [math.log(shares[k]) + sum(math.log(rates[k][r][v]) for r, v in enumerate(p)) for k in range(rules + 1)]
            top = max(logs)
            weight = [math.exp(x - top) for x in logs]
            belief[p] = [w / sum(weight) for w in weight]
    return shares, rates


def quality_by_rules(docs: DataFrame, scratch: Scratch, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, quality (posterior) and kept of each row of ``docs`` (doc_id, text)."""
    stats = scratch.write(statistics(docs), "statistics")
    names = list(votes())
    vote = [F.when(bad, BAD).when(good, GOOD).otherwise(NONE).alias(f"vote_{k}") for k, (bad, good) in votes().items()]
    marked = stats.select("*", *vote)
    seen = marked.groupBy(*(f"vote_{k}" for k in names)).agg(F.count("*").alias("n")).collect()
    shares, rates = expectation_maximisation({tuple(r[:-1]): r["n"] for r in seen} or {(NONE,) * len(names): 1})
    scores = []
    for share, by_rule in zip(shares, rates, strict=True):
        score = F.lit(math.log(share))
        for k, by in zip(names, by_rule, strict=True):
            score = score + F.when(F.col(f"vote_{k}") == BAD, math.log(by[BAD])).when(F.col(f"vote_{k}") == GOOD, math.log(by[GOOD])).otherwise(math.log(by[NONE]))
        scores.append(score)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    good, *bad = (F.get("scores", F.lit(k)) for k in range(len(scores)))
    quality = 1 / (1 + sum((F.exp(F.least(x - good, F.lit(500.0))) for x in bad), F.lit(0.0)))
    out = marked.withColumn("scores", F.array(*scores)).withColumn("quality", quality).withColumn("base_failed", failed)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *counts, "base_failed", (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"), "quality")
