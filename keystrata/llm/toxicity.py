"""Toxicity: a bidirectional gated recurrent network with attention pooling, written in numpy.

A word's input is an embedding of the word and the mean of embeddings of its character 4-grams
(both by hashed buckets), so that endings never seen still tell.  A word of more than ``LONGEST`` bytes, as
in texts without white space, is read as pieces of ``PIECE`` characters, each with the last
``SHARED`` of the piece before it; each piece counts as a word.  A gated recurrent unit reads the
words in both directions and gives each one a state with what stands around it; attention pools the
states of a window of ``WINDOW`` words, and a linear layer scores it.  A window starts at each word
of the whole text (stride 1), all are scored, and a text is as toxic as its worst window.

States do not depend on the window, so the recurrence runs once over segments of ``SEGMENT`` words,
dealt so that each window lies whole in exactly one of them; attention over all windows of a segment
is a difference of two running sums (energies count down to ``FLOOR`` below the segment's highest).

Learning: at most ``SAMPLE`` texts labelled toxic and ``CLEAN`` labelled clean, and ``SAMPLE_CHARS`` characters of either,
chosen by a hash of their ids.  Only texts are labelled, not windows, so each round first scores all windows
of all sampled texts, and then learns from each text's worst one and, for the clean ones, one drawn
from all windows, each with words before and after it up to ``AROUND`` in all, for ``ROUNDS`` rounds
and until ``UPDATES`` steps are made.

Null texts count as empty.  A text without words gets the score of an empty window.  Without
labels of both kinds the score is the share of label 1 (0 without any).
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .labelled import held_out, learnable, sample
from .storage import bounded, lean, sliced

SAMPLE, CLEAN, SAMPLE_CHARS, WINDOW, SEGMENT, AROUND, FLOOR = 900, 2700, 15_000_000, 48, 192, 96, 20.0
BUCKETS, WIDTH, STATE = 1 << 14, 8, 8
ROUNDS, UPDATES, BATCH, RATE, TABLE_RATE, STEP_BYTES = 6, 250, 128, 0.01, 0.003, 1_500_000
LONGEST, PIECE, SHARED = 40, 10, 3
_AROUND = " \t\r\n.,;:!?\"'()[]{}|*#$%&<>…"


def _buckets(words: list[bytes]) -> np.ndarray:
    """FNV-like hash of each word, by columns of bytes of all words at once."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    h = np.full(len(words), 0x811C9DC5, np.uint64)
    flat = np.frombuffer(b"".join(words), np.uint8)
    start = np.cumsum(lengths) - lengths
    for k in range(int(lengths.max(initial=0))):
        rows = np.flatnonzero(lengths > k)
        h[rows] = (h[rows] ^ flat[start[rows] + k]) * np.uint64(0x100000001B3)
    return ((h ^ h >> np.uint64(29)) % np.uint64(BUCKETS)).astype(np.int64)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, buckets of all their 4-grams, and where each word's begin."""
    raw = [w.lower().strip(_AROUND).encode("utf-8", "surrogatepass") for w in words]
    marked = [b"^" + w + b"$$" if w else b"^-$$" for w in raw]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    flat = np.frombuffer(b"".join(marked) + b"\0\0\0", np.uint8).astype(np.uint64)
    gram = flat[:-3] | flat[1:-2] << np.uint64(8) | flat[2:-1] << np.uint64(16) | flat[3:] << np.uint64(24)
    inside = np.ones(len(gram), bool)
    ends = np.cumsum(lengths)
    for k in (1, 2, 3):
        inside[ends - k] = False
    gram = gram[inside] * np.uint64(0x9E3779B97F4A7C15)
    first = np.concatenate([[0], np.cumsum(lengths - 3)[:-1]]) if len(words) else np.empty(0, np.int64)
    return _buckets(raw), (gram >> np.uint64(40)).astype(np.int64) % BUCKETS, first.astype(np.int64)


def pieces(word: str) -> list[str]:
    """The word itself, or a long one in overlapping pieces."""
    if len(word) > LONGEST // 4 and len((low := word.lower()).strip(_AROUND).encode("utf-8", "surrogatepass")) > LONGEST:
        return [low[a : a + PIECE] for a in range(0, len(low) - SHARED, PIECE - SHARED)]
    return [word]


def words_of(text: str | None) -> list[str]:
    """Words between white space, long ones in pieces."""
    return [p for w in (text or "").split() for p in pieces(w)]


def segments(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """count: words of each text.  Owner, first word and number of words of each segment; each window of ``WINDOW`` words
    lies in one, a text with fewer words is one."""
    hop = SEGMENT - WINDOW + 1
    many = np.maximum(1, -(-(count - WINDOW + 1) // hop))
    owner = np.repeat(np.arange(len(count)), many)
    first = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * hop
    return owner, first, np.minimum(SEGMENT, count[owner] - first)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, seed: int = 11):
        draw = np.random.default_rng(seed)
        rand = lambda *shape, by=0.2: (draw.standard_normal(shape) * by).astype(np.float32)
        self.p = {
            "word": rand(BUCKETS, WIDTH, by=0.05),
            "char": rand(BUCKETS, WIDTH, by=0.05),
            "inw": rand(2 * WIDTH, 6 * STATE, by=0.3),
            "inb": np.zeros(6 * STATE, np.float32),
            "rec": rand(2, STATE, 3 * STATE, by=0.3),
            "att": rand(2 * STATE, by=0.3),
            "out": rand(2 * STATE, by=0.3),
            "bias": np.zeros(1, np.float32),
        }
        self.constant: float | None = None

    # -- inputs ----------------------------------------------------------------------------

    def inputs(self, features: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        bucket, grams, first = features
        if not len(bucket):
            return np.zeros((0, 2 * WIDTH), np.float32)
        count = np.diff(np.append(first, len(grams)))[:, None]
        return np.concatenate([self.p["word"][bucket], np.add.reduceat(self.p["char"][grams], first) / count], 1).astype(np.float32)

    # -- forward and backward --------------------------------------------------------------

    def forward(self, x: np.ndarray, ids: np.ndarray, inside: np.ndarray | None = None, keep: bool = False):
        """x: inputs of distinct words; ids: a row of word numbers for each window and what stands around it, -1 where
        the text is over; inside: where the window is. Logits."""
        there = ids >= 0
        inside = there if inside is None else inside & there
        gates = (x @ self.p["inw"] + self.p["inb"]) if len(x) else np.zeros((1, 6 * STATE), np.float32)
        gates = np.stack([gates[:, : 3 * STATE], gates[:, 3 * STATE :]])  # directions first
        n, steps = ids.shape
        at = np.where(there, ids, 0)
        h = np.zeros((2, n, STATE), np.float32)
        states = np.zeros((steps, 2, n, STATE), np.float32)  # by place in the window
        saved = []
        for k in range(steps):
            i, j = k, steps - 1 - k
            g = np.stack([gates[0][at[:, i]], gates[1][at[:, j]]])
            u = h @ self.p["rec"]
            rz = _sigmoid(g[..., : 2 * STATE] + u[..., : 2 * STATE])
            r, z = rz[..., :STATE], rz[..., STATE:]
            new = np.tanh(g[..., 2 * STATE :] + r * u[..., 2 * STATE :])
            m = np.stack([there[:, i], there[:, j]])[..., None]
            after = np.where(m, new + z * (h - new), h)
            if keep:
                saved.append((h, r, z, new, u[..., 2 * STATE :], m))
            h = after
            states[i, 0], states[j, 1] = h[0], h[1]
        both = np.concatenate([states[:, 0], states[:, 1]], 2)  # step, window, state
        energy = np.where(inside.T, both @ self.p["att"], -1e9)
        weight = np.exp(energy - energy.max(0))
        weight *= inside.T
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = (both * weight[..., None]).sum(0)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (at, both, weight, pooled, saved)) if keep else logit

    def gradients(self, features, ids: np.ndarray, y: np.ndarray, weight_of: np.ndarray | float = 1.0, inside: np.ndarray | None = None) -> dict[str, np.ndarray]:
        x, p = self.inputs(features), self.p
        logit, (at, both, weight, pooled, saved) = self.forward(x, ids, inside, keep=True)
        d = ((_sigmoid(logit) - y) * weight_of / len(y)).astype(np.float32)
        g = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
        de = weight * ((both - pooled) @ p["out"]) * d
        g["att"] = (both * de[..., None]).sum((0, 1))
        dh_at = (weight * d)[..., None] * p["out"] + de[..., None] * p["att"]
        steps = len(saved)
        dgates = np.empty((2, steps, len(y), 3 * STATE), dh_at.dtype)  # by place
        g["rec"] = np.zeros_like(p["rec"])
        back = p["rec"].transpose(0, 2, 1)
        dh = np.zeros((2, len(y), STATE), np.float32)
        for k in range(steps - 1, -1, -1):
            i, j = k, steps - 1 - k
            before, r, z, new, un, m = saved[k]
            dh = dh + np.stack([dh_at[i, :, :STATE], dh_at[j, :, STATE:]])
            past, dh = dh * ~m, dh * m
            da_z = dh * (before - new) * z * (1 - z)
            da_n = dh * (1 - z) * (1 - new * new)
            da_r = da_n * un * r * (1 - r)
            own = np.concatenate([da_r, da_z, da_n], 2)
            dgates[0, i], dgates[1, j] = own[0], own[1]
            rec = own
            rec[..., 2 * STATE :] *= r
            g["rec"] += before.transpose(0, 2, 1) @ rec
            dh = dh * z + past + rec @ back
        by_word = np.concatenate([dgates[0], dgates[1]], 2).reshape(-1, 6 * STATE)
        dgate = _summed(at.T.reshape(-1), by_word, len(x))
        g["inw"], g["inb"] = x.T @ dgate, dgate.sum(0)
        dx = dgate @ p["inw"].T
        bucket, grams, first = features
        count = np.diff(np.append(first, len(grams)))
        g["word"] = _summed(bucket, dx[:, :WIDTH], BUCKETS)
        g["char"] = _summed(grams, np.repeat(dx[:, WIDTH:] / count[:, None], count, 0), BUCKETS)
        return g

    # -- texts -----------------------------------------------------------------------------

    def scores(self, texts: list[str | None]) -> list[float]:
        """The worst window's probability of each text."""
        if self.constant is not None:
            return [self.constant] * len(texts)
        if not texts:
            return []
        words, places, count = numbered(texts)
        return _sigmoid(self.worst(self.inputs(word_features(words)), places, count)[0]).tolist()

    def worst(self, x: np.ndarray, places: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``forward`` of all windows of all texts: the highest logit of each text, and the word where that window begins.

        places: word numbers of all texts in a row, ``count`` of them from each.
        """
        best, start = np.full(len(count), self.p["bias"][0], float), np.zeros(len(count), np.int64)
        owner, first, length = segments(count)
        some = length > 0
        owner, first, length = owner[some], first[some], length[some]
        if not len(owner):
            return best, start
        energy, value = self._states(x, places, (np.cumsum(count) - count)[owner] + first, length)
        at = np.cumsum(length) - length
        energy -= np.repeat(np.maximum.reduceat(energy, at), length)
        weight = np.exp(np.maximum(energy, -FLOOR))
        sums = [np.concatenate([[0.0], np.cumsum(w)]) for w in (weight, weight * value)]
        many = np.maximum(1, length - WINDOW + 1)
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        low = np.repeat(at, many) + inner
        high = low + np.repeat(np.minimum(length, WINDOW), many)
        logit = (sums[1][high] - sums[1][low]) / (sums[0][high] - sums[0][low]) + self.p["bias"][0]
        text = np.repeat(owner, many)  # in order
        begins = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        best[text[begins]] = np.maximum.reduceat(logit, begins)
        top = np.flatnonzero(logit == best[text])
        top = top[np.append(True, text[top][1:] != text[top][:-1])]
        start[text[top]] = (np.repeat(first, many) + inner)[top]
        return best, start

    def _states(self, x: np.ndarray, places: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Energy and output of each word of each segment (segments in a row), each segment read in both directions.

        Segments are columns, the longest first, so those that are over fall off the end.
        """
        p, k2, k3 = self.p, 2 * STATE, 3 * STATE
        sign = np.repeat(np.float32([-1, -1, 2]), STATE)  # what exp takes for the two gates and the new state
        order = np.argsort(-length, kind="stable")
        at, begin = (np.cumsum(length) - length)[order], begin[order]
        total, length = int(length.sum()), length[order]
        energy, value = np.zeros(total), np.zeros(total)
        live = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")  # columns that have so many words
        with np.errstate(over="ignore"):
            for d in (0, 1):
                half = slice(d * STATE, (d + 1) * STATE)
                gates = ((x @ p["inw"][:, d * k3 : (d + 1) * k3] + p["inb"][d * k3 : (d + 1) * k3]) * sign).astype(np.float32)
                after = np.concatenate([p["rec"][d].T * sign[:, None], p["att"][None, half], p["out"][None, half]]).astype(np.float32)
                h, u = np.zeros((STATE, len(length)), np.float32), np.zeros((k3 + 2, len(length)), np.float32)
                for step in range(length[0]):
                    n = int(live[step])
                    h, u = h[:, :n], u[:, :n]
                    place = length[:n] - 1 - step if d else step
                    g = gates[places[begin[:n] + place]].T
                    rz = np.add(g[:k2], u[:k2])
                    np.exp(rz, out=rz)
                    rz += 1
                    np.divide(1, rz, out=rz)
                    new = rz[:STATE] * u[k2:k3]
                    new += g[k2:]
                    np.exp(new, out=new)  # tanh
                    new += 1
                    np.divide(-2, new, out=new)
                    new += 1
                    h = h - new
                    h *= rz[STATE:]
                    h += new
                    u = after @ h
                    energy[at[:n] + place] += u[k3]
                    value[at[:n] + place] += u[k3 + 1]
        return energy, value


def _summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by row number."""
    order = np.argsort(rows, kind="stable")
    own = rows[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, np.int64)
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(own):
        out[own[first]] = np.add.reduceat(values[order], first)
    return out


def numbered(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words as ``words_of`` gives them, each white-space word's once; the numbers of the words of all texts in a row; how
    many each text has."""
    split = [(t or "").split() for t in texts]
    known = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
    places = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int32)
    count = np.fromiter(map(len, split), np.int64, len(split))
    parts = [pieces(w) for w in known]
    many = np.fromiter(map(len, parts), np.int64, len(parts))
    if many.max(initial=1) > 1:
        first, own = np.cumsum(many) - many, many[places]
        ends = np.concatenate([[0], np.cumsum(own)])
        places = (np.repeat(first[places] - ends[:-1], own) + np.arange(ends[-1])).astype(np.int32)
        count = ends[np.cumsum(count)] - ends[np.cumsum(count) - count]
    return list(chain.from_iterable(parts)), places, count


def _telling(buckets: np.ndarray, ends: np.ndarray, places: np.ndarray, count: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """For each bucket: how far beyond chance more toxic texts than clean ones have it; what the embeddings start with."""
    seen = np.zeros((2, BUCKETS))
    for k, text in enumerate(np.split(places, np.cumsum(count)[:-1])):
        own = np.unique(text)
        if len(own):
            seen[int(labels[k])][np.unique(np.concatenate([buckets[ends[w] : ends[w + 1]] for w in own]))] += 1
    clean, toxic = (labels == 0).sum(), (labels == 1).sum()
    both = (seen[0] + seen[1]) / len(labels)
    chance = np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / clean + 1 / toxic))
    z = (seen[1] / toxic - seen[0] / clean) / chance
    return np.clip((np.abs(z) - 3) * np.sign(z) * (np.abs(z) > 3) / 5, -1, 2).astype(np.float32)


def fit(texts: list[str | None], labels: np.ndarray, seed: int = 5, rounds: int = ROUNDS) -> Network:
    net, draw = Network(seed), np.random.default_rng(seed)
    if len(np.unique(labels)) < 2:
        net.constant = float(labels.mean()) if len(labels) else 0.0
        return net
    words, places, count = numbered(texts)
    begin = np.cumsum(count) - count
    bucket, grams, first = word_features(words)
    last = np.append(first, len(grams))
    net.p["word"][:, 0] = _telling(bucket, np.arange(len(bucket) + 1), places, count, labels)
    net.p["char"][:, 0] = _telling(grams, last, places, count, labels)
    weight = np.where(labels == 1, np.sqrt((labels == 0).sum() / (labels == 1).sum()), 1).astype(np.float32)
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    t = 0
    turn = 0
    while turn < rounds or t < UPDATES:
        x = net.inputs((bucket, grams, first))
        if turn == 0:  # before anything is learned: by the telling words in it
            total = np.cumsum(np.append(0, x[:, [0, WIDTH]].max(1, initial=-np.inf)[places].astype(float)))
            worst = np.array([_highest(total[b : b + c + 1]) for b, c in zip(begin, count)])
        else:
            worst = net.worst(x, places, count)[1]
        other = (draw.random(len(texts)) * np.maximum(1, count - WINDOW + 1)).astype(np.int64)
        text = np.concatenate([np.arange(len(texts)), np.flatnonzero(labels == 0)])
        start = np.concatenate([worst, other[labels == 0]])
        turned = draw.permutation(len(text))
        turn += 1
        batch = min(BATCH, max(16, len(text) // 12))
        for a in range(0, len(text), batch):
            own, at = text[turned[a : a + batch]], start[turned[a : a + batch]]
            left = np.maximum(0, at - draw.integers(0, AROUND - WINDOW + 1, len(at)))
            place = left[:, None] + np.arange(AROUND)
            there = place < count[own][:, None]
            ids = np.where(there, places[np.where(there, begin[own][:, None] + place, 0)], -1)
            inside = (place >= at[:, None]) & (place < at[:, None] + WINDOW)
            part, inverse = np.unique(ids, return_inverse=True)
            inverse = inverse.reshape(ids.shape) - int((part < 0).any())
            used = part[part >= 0]
            spans = [grams[first[w] : last[w + 1]] for w in used]
            begins = np.cumsum([0, *map(len, spans)])[:-1]
            if not len(used):
                continue
            t += 1
            features = (bucket[used], np.concatenate(spans), begins)
            for k, g in net.gradients(features, inverse, labels[own].astype(np.float32), weight[own], inside).items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                net.p[k] -= (TABLE_RATE if k in ("word", "char") else RATE) * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-6)
        if t == 0:  # no text has a word
            break
    return net


def _highest(total: np.ndarray) -> int:
    """Where the window of the highest sum begins, by running sums."""
    return int((total[WINDOW:] - total[:-WINDOW]).argmax()) if len(total) > WINDOW else 0


def fit_labelled(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE, clean: int = CLEAN, most_chars: int = SAMPLE_CHARS) -> Network:
    """docs: (doc_id, text); labels: (doc_id, toxic), from which held-out rows are left out here.

    Of an id with several texts the first in their order is taken.
    """
    known = learnable(labels, "toxic").join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = sample(known.where("label = 1"), toxic).unionByName(sample(known.where("label = 0"), clean))
    rows = docs.select("doc_id", "text").join(bounded(chosen, toxic + clean), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    so_far = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")  # of the sample alone
    rows = rows.withColumn("chars", F.sum(F.coalesce(F.length("text"), F.lit(0))).over(so_far)).where(F.col("chars") <= most_chars)
    rows = rows.select("doc_id", "text", "label").toPandas().sort_values("doc_id")
    return fit([t if isinstance(t, str) else None for t in rows["text"]], rows["label"].to_numpy(int))


def toxicity_scores(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in sliced(batches, size=STEP_BYTES):
            scores = shared.value.scores(batch.column("text").to_pylist())
            hit = [int(s >= 0.5) for s in scores]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array(hit, pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out().alias("held_out"))
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_labelled(docs, labels))

    def run(batches):
        for batch in sliced(batches, size=STEP_BYTES):
            yield batch.filter(pa.array([s < threshold for s in shared.value.scores(batch.column("text").to_pylist())], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
