"""Near-duplicate groups by a chosen-path similarity join over minwise tokens.

A document is the set of its distinct runs of five words (A-Z lower-cased, words parted by white
space; fewer words: the whole sequence).  Two documents are linked when 100 * intersection >=
75 * union, counted on the full sets; groups are the connected components.

Equal sets are one class from the start.  A class has ``COORDINATES`` minwise tokens.  Each of
``TREES`` independent trees starts with all classes and branches by two coordinates drawn for the
node: classes with the same token share a child, so that a pair of similarity 0.75 is expected to
share 1.5 children of each node that it shares, while others part quickly.  Nodes with one class
end at once.  At the root each class is compared with its node's pivot (in large nodes with a
second one), which joins a whole group of near copies by as many links as it has classes.  Then a
node is
  - done, when all its classes are known to be in one component;
  - small, with at most ``SMALL`` classes and ``SMALL_SET`` shingles in all: compared exhaustively;
  - led by one component, with at most ``REST`` classes of others: those meet all of it, in blocks;
  - else branched further, by tokens drawn anew.
After ``DEPTH`` levels a node still large is compared exhaustively in pairs of blocks, so no pair
that shares a node there is dropped.  Comparisons look at the tokens first (a pair of similarity
0.75 agrees in 48 of 64; fewer than ``AGREE`` are out), then at the full sets.  A pair of similarity
0.75 shares no node at level L with probability (0.25 + 0.75 q) ** 11, where q is 0 at L = 0 and
(0.25 + 0.75 q) ** 2 of the one before at each further level: 3e-7 at the root, 5e-6 at level
``DEPTH``, if tokens are independent.

Groups never meet in one task: pivots and counts are partial aggregates, and what does meet is
bounded in rows and in bytes.  Null or empty texts, or texts without words, have no shingles and
stay alone.  Classes are not named by doc_id, so one doc_id on several texts links nothing by
itself; a component_id is the smallest doc_id of its group.  A null doc_id takes the component_id
of its group; if the whole group has none, it is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import Scratch, bounded, lean, sliced, text_key, without_rows

WORDS, PERCENT = 5, 75
TREES, COORDINATES, AGREE = 8, 64, 29
#: Bounds of what meets in one task: classes and shingles (8 bytes each) of a node, classes of a led node outside its
#: leading component.
SMALL, SMALL_SET, REST, DEPTH = 4096, 1 << 22, 256, 4


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``words`` words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, tokens)), ">u8").astype(np.uint64)
    odd = np.random.default_rng(words).integers(1, 2**63, words, np.uint64) * np.uint64(2) + np.uint64(1)
    n = max(1, len(h) - words + 1)
    run = min(words, len(h))
    total = np.full(n, len(h) if len(h) < words else 0, np.uint64)
    for k in range(run):
        total += h[k : k + n] * odd[k]
    return np.unique(_mix(total))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Minwise:
    """Tokens of a set, the roots that they lead to, and the children of a node."""

    def __init__(self) -> None:
        draw = np.random.default_rng(75)
        self.a = draw.integers(1, 2**63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 2**63, COORDINATES, np.uint64)
        order = draw.permutation(COORDINATES).tolist()  # no coordinate serves two roots
        self.roots = [(tree, order.pop()) for tree in range(TREES) for _ in range(1 + (tree % 3 == 0))]

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        low = np.full(COORDINATES, 2**32 - 1, np.uint64)
        for at in range(0, len(hashes), 2048):
            part = hashes[at : at + 2048, None] * self.a
            part += self.b
            part >>= np.uint64(32)
            np.minimum(low, part.min(0), out=low)
        return low.astype(np.uint32)

    def root_nodes(self, tokens: np.ndarray) -> np.ndarray:
        """tokens: a row for each class."""
        return np.stack([_mix(tokens[:, c] + np.uint64((tree * 251 + c + 1) << 33)) for tree, c in self.roots], 1).view(np.int64)

    def children(self, node: np.ndarray, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Which rows go on, and to which child: all of them twice, by two coordinates."""
        seed, rows, c = _mix(node.view(np.uint64) + np.uint64(1)), np.arange(len(node)), np.uint64(0)
        for k in (0, 1):
            draw = seed >> np.uint64(8 * k + 4)
            c = draw % np.uint64(COORDINATES) if k == 0 else (c + np.uint64(1) + draw % np.uint64(COORDINATES - 1)) % np.uint64(COORDINATES)
            yield rows, _mix(seed ^ _mix(tokens[rows, c.astype(np.int64)].astype(np.uint64) + (c << np.uint64(34)))).view(np.int64)


_MINWISE: list[_Minwise] = []


def minwise() -> _Minwise:
    if not _MINWISE:
        _MINWISE.append(_Minwise())
    return _MINWISE[0]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), COORDINATES)


def _signatures(docs: DataFrame) -> DataFrame:
    def run(batches):
        of = minwise()
        for batch in sliced(batches):
            sizes, keys, tokens = [], [], []
            for text in batch.column("text").to_pylist():
                own = shingles(text)
                sizes.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                tokens.append(of.tokens(own))
            both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            roots = of.root_nodes(np.stack(tokens))
            width = roots.shape[1]
            columns = [
                batch.column("doc_id"),
                batch.column("t"),
                pa.array(sizes, pa.int64()),
                pa.array(both[:, 0]),
                pa.array(both[:, 1]),
                pa.array([t.tobytes() for t in tokens], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(roots) + 1) * width, pa.int32()), pa.array(roots.reshape(-1))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "n", "h", "g", "tokens", "roots"])

    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("t"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, t long, n long, h long, g long, tokens binary, roots array<long>")


class _Texts:
    """Full sets of classes, read from the text of the row that stands for each."""

    def __init__(self, docs: DataFrame, classes: DataFrame):
        self.docs, self.classes = docs, classes

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, content) of the classes in ``ids`` (id)."""

        def run(batches):
            for batch in sliced(batches):
                made = [shingles(t).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.binary())], ["id", "content"])

        want = bounded(self.classes.select("id", "rep.doc_id", "rep.t").join(ids, "id", "left_semi"), 1_000_000)
        docs = self.docs.select(F.col("doc_id").cast("long"), text_key().alias("t"), "text")
        same = docs["doc_id"].eqNullSafe(want["doc_id"]) & (docs["t"] == want["t"])
        return docs.join(want, same).select("id", "text").mapInArrow(lean(run), "id long, content binary")


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and tokens allow the similarity."""

    def run(batches):
        for batch in batches:
            p, q = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("p", "q"))
            ok = (_matrix(batch.column("s")) == _matrix(batch.column("t"))).sum(1) >= AGREE
            ok &= 100 * np.minimum(p, q) >= PERCENT * np.maximum(p, q)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], ["a", "b"])

    left = classes.select(F.col("id").alias("a"), F.col("n").alias("p"), F.col("tokens").alias("s"))
    right = classes.select(F.col("id").alias("b"), F.col("n").alias("q"), F.col("tokens").alias("t"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "p", "q", "s", "t").mapInArrow(lean(run), "a long, b long")


def _confirmed(pairs: DataFrame, texts: _Texts, scratch: Scratch, step: int) -> DataFrame:
    """Pairs that are linked, counted on their full sets."""
    ids = scratch.write(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), f"ids{step}")
    sets = scratch.write(texts.sets(ids), f"sets{step}")

    def run(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            ok = pa.array([linked(_set(x[k]), _set(y[k])) for k in range(len(batch))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    left, right = sets.select(F.col("id").alias("a"), F.col("content").alias("x")), sets.select(F.col("id").alias("b"), F.col("content").alias("y"))
    links = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")
    links = scratch.write(links.distinct(), f"links{step}")
    for name in ("ids", "sets", "pairs"):
        scratch.drop(f"{name}{step}")
    return links


def _set(content: pa.Scalar) -> np.ndarray:
    return np.frombuffer(content.as_buffer(), np.uint64)


def _star(rows: DataFrame) -> DataFrame:
    """rows (node, id, pivot): each class with its node's pivot, once."""
    return rows.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()


def _by_node(rows: DataFrame, work, schema: str) -> DataFrame:
    """Runs a module function over the classes of one small node after the other."""

    def run(batches):
        for node in _groups(batches):
            yield from work(node)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "node").sortWithinPartitions("node", "id").mapInArrow(lean(run), schema)


_CLOSE = "node long, id long, component long, n long, tokens binary"
_ROW = ["node", "id", "component", "n", "tokens"]


def _apart(mark: DataFrame, tokens: DataFrame | None, scratch: Scratch, step: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Rows of nodes (node, id, component, n) whose classes lie in several components: those to be compared, as small
    nodes, and those of large ones, if there are any.  ``tokens``: where the rows do not carry them yet."""
    drawn = F.min(F.struct(F.xxhash64("id", F.lit(step)).alias("h"), F.col("id")))
    parts = mark.groupBy("node", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"), drawn.alias("p"))
    nodes = parts.groupBy("node").agg(F.sum("c").alias("size"), F.sum("s").alias("shingles"), F.max(F.struct("c", "s", "component")).alias("top"), F.min("p")["id"].alias("pivot"))
    small = (F.col("size") <= SMALL) & (F.col("shingles") <= SMALL_SET)
    led = (F.col("size") - F.col("top.c") <= REST) & (F.col("shingles") - F.col("top.s") <= SMALL_SET / 4)
    blocks = F.when(small, 0).when(led, _blocks("size", "shingles")).otherwise(-1)
    nodes = nodes.where(F.col("size") > F.col("top.c")).select("node", "pivot", "size", "shingles", F.col("top.component").alias("lead"), blocks.alias("blocks"))
    nodes = scratch.write(nodes, f"mixed{step}")
    kinds = {r[0] for r in nodes.select(F.signum("blocks").cast("int")).distinct().collect()}
    if not kinds:
        return [], None
    rows = mark.drop("pivot").join(bounded(nodes), "node")
    rows = rows.join(tokens, "id") if tokens is not None else rows
    rows = scratch.write(rows.select("node", "id", "component", "n", "tokens", "pivot", "size", "shingles", "lead", "blocks"), f"members{step}")
    few = [rows.where("blocks = 0")]
    if 1 in kinds:
        all_blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
        own = F.when(F.col("component") == F.col("lead"), F.array(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))).otherwise(all_blocks)
        few.append(rows.where("blocks > 0").withColumn("block", F.explode(own)).withColumn("node", F.xxhash64("node", "block")))
    return [f.select(*_ROW) for f in few], rows.where("blocks < 0") if -1 in kinds else None


def _blocks(rows: str, shingles: str) -> Column:
    """In how many blocks a node is dealt, so that two of them make a small node."""
    return F.ceil(F.greatest(F.col(rows) * (3 / SMALL), F.col(shingles) * (3 / SMALL_SET))).cast("int")


def _node_links(few: DataFrame, texts: _Texts, scratch: Scratch) -> DataFrame:
    """Links that join components within small nodes (node, id, component, n, tokens).

    First the tokens say which classes of a node have a candidate in another component; only those meet
    again with their full sets.  A node gives a link where two of its components join, not each pair.
    """
    close = scratch.write(_by_node(few, close_classes, _CLOSE), "close")
    sets = scratch.write(texts.sets(scratch.write(close.select("id").distinct(), "close-ids")), "close-sets")
    links = scratch.write(_by_node(close.join(sets, "id"), joining_links, "a long, b long"), "links-small")
    for name in ("close", "close-ids", "close-sets"):
        scratch.drop(name)
    return links


def _groups(batches) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        node = batch.column("node").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                if held and node[start] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(start, end - start))
                last = node[start]
    if held:
        yield pa.Table.from_batches(held)


def _candidates(node: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each class outside the largest component with the classes of other components that its tokens agree with."""
    comp, n = (node.column(c).to_numpy() for c in ("component", "n"))
    tokens = _matrix(node.column("tokens").combine_chunks())
    names, count = np.unique(comp, return_counts=True)
    for i in np.flatnonzero(comp != names[count.argmax()]).tolist():  # each pair has one of these
        ok = (tokens == tokens[i]).sum(1) >= AGREE
        ok &= (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i]))
        yield i, np.flatnonzero(ok)


def close_classes(node: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows of classes that have a candidate."""
    hit = np.zeros(len(node), bool)
    for i, others in _candidates(node):
        if len(others):
            hit[i] = True
            hit[others] = True
    if hit.any():
        yield from node.filter(pa.array(hit)).to_batches()


def joining_links(node: pa.Table) -> Iterator[pa.RecordBatch]:
    """Candidates confirmed on full sets, as long as they join components that are apart yet."""
    ids = node.column("id").to_pylist()
    sets = [_set(x) for x in node.column("content")]
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.get(x, x) != x:
            top[x] = top.get(top[x], top[x])
            x = top[x]
        return x

    comp, a, b = node.column("component").to_pylist(), [], []
    for i, others in _candidates(node):
        for j in others.tolist():
            p, q = find(comp[i]), find(comp[j])
            if p != q and linked(sets[i], sets[j]):
                top[max(p, q)] = min(p, q)
                a.append(ids[i])
                b.append(ids[j])
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """100 * intersection >= 75 * union of two sorted sets."""
    if not len(x) or not len(y):
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[at] == y).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _branch(rows: DataFrame) -> DataFrame:
    """Rows of large nodes (node, id, component, n, tokens): the same classes in their children."""

    def run(batches):
        for batch in batches:
            node, tokens = batch.column("node").to_numpy(zero_copy_only=False).copy(), _matrix(batch.column("tokens"))
            for rows_, child in minwise().children(node, tokens):
                yield pa.RecordBatch.from_arrays([pa.array(child), *batch.take(pa.array(rows_)).columns[1:]], batch.schema.names)

    return rows.select(*_ROW).mapInArrow(lean(run), _CLOSE)


def _pairs_of_blocks(rows: DataFrame) -> DataFrame:
    """Nodes that no level has made small, as pairs of blocks: every pair of their classes shares one at least."""
    own = rows.withColumn("many", _blocks("size", "shingles")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("many")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    return own.withColumn("node", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))).select(*_ROW)


def _groups_of_classes(classes: DataFrame, texts: _Texts, scratch: Scratch) -> DataFrame:
    """(id, component) of the classes that are linked with another."""
    tokens = classes.select("id", "n", "tokens")
    nodes = classes.select("id", "n", F.explode("roots").alias("node"))
    shared = nodes.groupBy("node").agg(F.count("*").alias("size"), F.min("id").alias("pivot"), F.expr("bit_xor(xxhash64(id))").alias("print")).where("size > 1")
    # Nodes of different trees with the same classes are one.
    once = scratch.write(shared.groupBy("size", "pivot", "print").agg(F.min("node").alias("node")).select("node", "pivot"), "roots")
    frontier = scratch.write(nodes.join(bounded(once), "node").distinct(), "nodes0")  # node, id, n, pivot

    # Pivots first: they join whole groups of near copies.
    links = _confirmed(scratch.write(_agreeing(_star(frontier), tokens), "pairs0"), texts, scratch, 0)
    groups = components(links, scratch, "components0")
    name = lambda rows: rows.join(bounded(groups), "id", "left").withColumn("component", F.coalesce("component", "id"))
    frontier = name(frontier)
    small: list[DataFrame] = []
    for step in range(DEPTH + 1):
        few, large = _apart(frontier, None if step else tokens.drop("n"), scratch, step)
        small += few
        if large is None:
            break
        if step == DEPTH:
            small.append(_pairs_of_blocks(large))
            break
        if step == 0:  # another pivot for nodes whose first one was the odd one out
            links = links.unionByName(_confirmed(scratch.write(_agreeing(_star(large), tokens), "pairs1"), texts, scratch, 1))
            groups = components(links, scratch, "components1")
            large = name(large.drop("component"))
        frontier = scratch.write(_branch(large), f"nodes{step + 1}")
    if small:
        few = small[0]
        for more in small[1:]:
            few = few.unionByName(more)
        links = links.unionByName(_node_links(few, texts, scratch))
        groups = components(links, scratch, "components-small")
    return groups


def _grouped(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, t, n, component (null: no shingles), component_id and size (rows of the component) of each row."""
    rows = scratch.write(_signatures(docs), "signatures")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t"))
    classes = rows.where("n > 0").groupBy("h", "g", "n").agg(rep.alias("rep"), F.count("*").alias("copies"), F.first("tokens").alias("tokens"), F.first("roots").alias("roots"))
    classes = scratch.write(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    groups = _groups_of_classes(classes, _Texts(docs, classes), scratch)

    named = classes.select("h", "g", "n", "id", "rep.doc_id", "copies").join(bounded(groups), "id", "left").withColumn("component", F.coalesce("component", "id"))
    top = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("size"))
    named = scratch.write(named.drop("doc_id", "copies", "id").join(top, "component"), "named")
    return rows.select("doc_id", "t", "n", "h", "g").join(named, ["h", "g", "n"], "left").drop("h", "g")


def near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (doc_id, text)."""
    top = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    rows = _grouped(docs, scratch).select("doc_id", F.col("n").alias("n_shingles"), top)
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group one row, that of the smallest doc_id
    (null ones last; then by a hash of the text), and all rows without shingles."""
    rows = scratch.write(_grouped(docs, scratch).where("size > 1").select("doc_id", "t", F.col("component").alias("group")), "grouped")
    return without_rows(docs, rows, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t"), scratch)
