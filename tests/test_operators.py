"""Operators on small literal tables."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from keystrata.functions import keys as K
from keystrata.operators import logs, ranges, snapshots, versions
from keystrata.operators.ordered import running_sum
from keystrata.plans import catalog
from keystrata.streaming import fold as S

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    ("key", "start", "end", "half", "closed", "open_"),
    [
        ("", "", "", True, True, False),
        ("", "", "6", True, True, False),
        ("", "3", "6", False, False, False),
        ("4", "3", "6", True, True, True),
        ("4", "3", "", True, True, True),
        ("3", "3", "", True, True, False),
        ("2", "3", "6", False, False, False),
        ("6", "3", "6", False, True, False),
    ],
)
def test_key_in_range(spark, key, start, end, half, closed, open_):
    a = (F.lit(key), F.lit(start), F.lit(end))
    assert tuple(spark.range(1).select(K.within(*a), K.within_closed(*a), K.strictly_within(*a)).head()) == (half, closed, open_)


@pytest.mark.parametrize(("v", "c", "older"), [(11, 10, False), (10, 11, False), (10, 10, False), (10, 9, True), (9, 10, True)])
def test_epochs(spark, v, c, older):
    a = (F.lit(v), F.lit(c), F.lit(10), F.lit(10))
    assert tuple(spark.range(1).select(K.epoch_older(*a), K.epoch_differs(*a)).head()) == (older, (v, c) != (10, 10))


def test_comparable_bytes_keep_the_order(spark):
    keys = ["", "a", "ab", "abcdefgh", "abcdefgha", "abcdefgi", "b"]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", K.comparable_bytes(F.col("k")).alias("c"))
    assert [r.k for r in df.orderBy("c").collect()] == sorted(keys)
    assert {r.k: len(r.c) // 2 for r in df.collect()} == {k: (len(k) // 8 + 1) * 9 for k in keys}


@pytest.mark.parametrize(("low", "high", "most", "want"), [(4, 5, 10**9, [4]), (4, 6, 10**9, [4, 5]), (4, 7, 0, [4]), (4, 7, 20, [4, 5]), (4, 7, 25, [4, 5]), (4, 7, 29, [4, 5]), (4, 7, 30, [4, 5, 6])])
def test_fetch_by_budget(spark, low, high, most, want):
    log = spark.createDataFrame([(1, i, i, 10) for i in (3, 4, 5, 6)], "region_id long, idx long, term long, size long")
    assert [r.idx for r in logs.fetch(log, low, high, most).orderBy("idx").collect()] == want


def test_append_cuts_the_log(spark):
    schema = "region_id long, idx long, term long"
    old = spark.createDataFrame([(1, i, 1) for i in range(1, 8)] + [(2, 1, 1)], schema)
    new = spark.createDataFrame([(1, 3, 2), (1, 4, 2)], schema)
    assert rows(logs.append(old, new)) == [(1, 1, 1), (1, 2, 1), (1, 3, 2), (1, 4, 2), (2, 1, 1)]


def test_collection_counts(spark):
    log = spark.createDataFrame([(1, i) for i in range(100)], "region_id long, idx long")
    assert rows(logs.collected(log, [(0, 10), (0, 50), (50, 50), (50, 60)])) == [(1, 0, 10), (1, 1, 40), (1, 3, 10)]


def cuts_by_loop(sizes, per, most):
    total, cuts = 0, []
    for i, n in enumerate(sizes):
        exact = total == per
        total += n
        if total > per:
            cuts.append(i)
            total = n if exact else 0
    return cuts[:-1] if cuts and total + per < most else cuts


@pytest.mark.parametrize("most", [0, 15, 30])
def test_split_by_size_is_the_loop(spark, most):
    import random

    draw = random.Random(1)
    sizes = {r: [draw.randint(1, 6) for _ in range(200)] for r in range(5)}
    df = spark.createDataFrame([(r, i, n) for r, s in sizes.items() for i, n in enumerate(s)], "region_id long, seq long, size long")
    assert rows(ranges.split_keys_by_size(df, 10, most)) == sorted((r, i) for r, s in sizes.items() for i in cuts_by_loop(s, 10, most))


def test_split_pieces_tile_the_range(spark):
    regions = spark.createDataFrame([(1, "a", "m", 3), (2, "m", "", 1)], "region_id long, start_key string, end_key string, version long")
    cuts = spark.createDataFrame([(1, "c"), (1, "g"), (1, "g"), (1, "z"), (2, "q")], "region_id long, cut string")
    assert rows(ranges.split(regions, cuts)) == [(1, 0, "a", "c", 5), (1, 1, "c", "g", 5), (1, 2, "g", "m", 5), (2, 0, "m", "q", 2), (2, 1, "q", "", 2)]


def test_coverage_sees_gaps(spark):
    regions = spark.createDataFrame([(1, "", "c"), (2, "c", "f"), (3, "h", "")], "region_id long, start_key string, end_key string")
    wanted = spark.createDataFrame([(1, "a", "f"), (2, "a", "g"), (3, "d", "i"), (4, "k", ""), (5, "f", "g")], "want_id long, want_start string, want_end string")
    assert {r.want_id: r.covered for r in ranges.coverage(regions, wanted).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False}


def test_snapshot_round_trip(spark):
    schema = "k string, start_ts long, commit_ts long, op string, value double, size long"
    data = spark.createDataFrame([("a", 1, 2, "P", 1.0, 10), ("a", 3, 4, "P", 2.0, 100), ("b", 5, 6, "D", None, 5), ("c", 7, 7, "R", None, 5)], schema)
    families = snapshots.export(data, data.limit(0), F.col("size"))
    back = snapshots.load(families)
    assert rows(back.drop("broken").fillna(-1.0)) == rows(data.drop("size").select("k", "start_ts", "commit_ts", "op", "value").fillna(-1.0))
    lost = snapshots.load(families.where("cf <> 'default'"))
    assert [r.k for r in lost.where("broken").collect()] == ["a"]


def test_deleted_keys_are_not_read(spark):
    schema = "k string, start_ts long, commit_ts long, op string, value double"
    data = spark.createDataFrame([("a", 1, 2, "P", 1.0), ("a", 3, 4, "D", None), ("b", 1, 5, "P", 2.0), ("b", 6, 9, "L", None), ("c", 1, 1, "R", None)], schema)
    assert rows(versions.as_of(data, 3)) == [("a", 2, 1.0)]
    assert rows(versions.as_of(data, 9)) == [("b", 5, 2.0)]
    assert rows(versions.as_of(data.limit(0), 9)) == []


def test_fold_releases_only_unbroken_runs():
    state = S.fold(None, [3, 2, 5], [30, 20, 50])
    assert state == (0, 0, 0, [2, 3, 5], [20, 30, 50])
    state = S.fold(state, [1, 1, 2], [10, 99, 99])
    assert state == (3, 3, 60, [5], [50])
    assert S.fold(state, [1, 2, 3], [9, 9, 9]) == state  # replay


def test_streaming_fold_equals_the_batch(spark, tmp_path):
    log = [(r, i, 10 * r + i) for r in (1, 2) for i in range(1, 21)]
    pd.DataFrame(log, columns=["region_id", "idx", "size"]).sample(frac=1, random_state=3).to_csv(tmp_path / "all.csv", index=False, header=False)
    lines = (tmp_path / "all.csv").read_text().splitlines()
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"{k}.csv").write_text("\n".join(lines[k::4]))
    stream = spark.readStream.schema("region_id long, idx long, size long").option("maxFilesPerTrigger", 1).csv(str(tmp_path / "in"))
    q = S.write_once(S.apply_in_order(stream), str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).groupBy("region_id").agg(F.max(F.struct("applied_idx", "n_entries", "n_bytes")).alias("s")).select("region_id", "s.*")
    assert rows(out) == [(r, 20, 20, sum(n for a, _, n in log if a == r)) for r in (1, 2)]


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_leases_by_replay(spark):
    import random

    from keystrata.operators import members

    draw, rows = random.Random(3), []
    for peer in range(40):
        for seq in range(draw.randrange(1, 12)):
            rows.append((peer, seq, draw.randrange(100), draw.random() < 0.3))
    want = {}
    for peer, seq, sent, suspect in rows:  # in order
        valid, held = want.get(peer, (None, None))
        bound = sent + 50
        if suspect:
            valid, held = None, bound
        elif held is not None:
            if held < bound:
                valid, held = bound, None
        elif valid is None or valid < bound:
            valid = bound
        want[peer] = valid, held
    state = lambda valid, held: "suspect" if held is not None else "valid" if valid > 100 else "expired"
    got = members.leases(spark.createDataFrame(rows, "peer_id long, seq long, sent long, suspect boolean"), spark.createDataFrame([(100,)], "now long"), 50)
    assert {r.peer_id: r.lease for r in got.collect()} == {p: state(*x) for p, x in want.items()}


def test_commands_out_of_order_are_one_error_row(spark):
    from keystrata.operators import requests

    put, delete = (lambda cf, r=False: ("put", cf, r)), (lambda cf: ("delete", cf, False))
    commands = {
        1: ([put("default"), put("lock")], ["prewrite"]),
        2: ([put("lock"), put("lock")], ["prewrite", "prewrite"]),
        3: ([put("default")], ["error"]),
        4: ([put("lock"), put("default"), delete("lock")], ["error"]),
        5: ([put("write"), delete("lock"), delete("lock")], ["commit", "pessimistic_rollback"]),
        6: ([put("write")], ["error"]),
        7: ([put("write", True)], ["rollback"]),
        8: ([delete("default"), put("write", True), delete("lock"), put("lock")], ["rollback", "prewrite"]),
        9: ([delete("default"), delete("lock")], ["error"]),
        10: ([delete("write"), put("lock")], []),
        11: ([put("lock"), delete("write")], ["prewrite"]),
        12: ([put("other")], ["error"]),
    }
    rows = [(c, p, *r, f"k{p}", 1) for c, (sent, _) in commands.items() for p, r in enumerate(sent)]
    out = requests.steps(spark.createDataFrame(rows, "cmd long, pos int, kind string, cf string, rollback boolean, k string, start_ts long")).orderBy("cmd", "pos").collect()
    for c, (_, want) in commands.items():
        assert [r.step for r in out if r.cmd == c] == want, c


def test_rollback_deletes_its_lock(spark):
    from keystrata.operators import requests

    rows = [(1, "prewrite", "a"), (1, "prewrite", "b"), (1, "prewrite", "c"), (2, "rollback", "a"), (3, "commit", "b"), (4, "prewrite", "b"), (5, "pessimistic_rollback", "c"), (6, "error", "b")]
    of = spark.createDataFrame([(c, 0, s, k, c, False) for c, s, k in rows], "cmd long, pos int, step string, k string, start_ts long, has_default boolean")
    left = lambda applied: {r.k: r.start_ts for r in requests.locks_after(of, applied).collect()}
    assert left(1) == {"a": 1, "b": 1, "c": 1} and left(3) == {"c": 1} and left(9) == {"b": 4}
    status = {(r.k, r.start_ts): r.status for r in requests.commit_status(of.withColumn("start_ts", of.cmd * 0 + 1)).collect()}
    assert status == {("b", 1): "ok"}


def test_snapshot_without_its_whole_data_is_refused(spark, tmp_path):
    from keystrata.operators import snapshots

    families = spark.createDataFrame([("write", "a", 1), ("write", "b", 2), ("lock", "c", 3)], "cf string, k string, ts long")
    path = f"file://{tmp_path}/snapshot"
    manifest = {r.cf: r.n_rows for r in snapshots.save(families, path).collect()}
    assert manifest == {"write": 2, "lock": 1}
    assert sorted(map(str, snapshots.open_saved(spark, path).select("cf", "k", "ts").collect())) == sorted(map(str, families.collect()))
    families.where("k <> 'b'").write.mode("overwrite").partitionBy("cf").parquet(f"{path}/data")
    with pytest.raises(ValueError):
        snapshots.open_saved(spark, path)
    families.where("cf = 'write'").write.mode("overwrite").partitionBy("cf").parquet(f"{path}/data")
    with pytest.raises(ValueError):
        snapshots.open_saved(spark, path)


def test_checksums_by_brute_force(spark):
    import zlib

    from keystrata.plans import catalog
    from keystrata.sources import tables

    data = "/root/testdata/sf0.001"
    props = {r.event_id: r.props for r in tables.events(spark, data).collect()}
    for r in catalog.QUERIES["q_value_crc32"](spark, data).collect():
        assert (r.crc, r.n_bytes) == (zlib.crc32(props[r.event_id].encode()), len(props[r.event_id].encode()))


@pytest.mark.parametrize("blocks", ("1", "16"))
def test_steps_in_key_order(spark, blocks):
    """Against plain loops: disjoint ranges with gaps and keys at their ends, a range that has a third of the keys, no ranges, no keys."""
    draw = random.Random(5)
    edges = sorted({"".join(draw.choices("abc", k=4)) for _ in range(60)})
    some = [(i, s, e) for i, (s, e) in enumerate(zip(edges, edges[1:])) if i % 5] + [(90, edges[-1], "")]
    keys = sorted({"".join(draw.choices("abc", k=draw.randint(1, 6))) for _ in range(300)} | set(edges) | {"b" + "a" * k for k in range(4, 150)})
    shape, before = "region_id long, start_key string, end_key string", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", blocks)
    try:
        for ks, rs in ((keys, some), (keys, []), ([], some)):
            table, known = spark.createDataFrame([(k,) for k in ks] + [(None,)], "k string"), spark.createDataFrame(rs, shape)
            got = ranges.locate(table, known).collect()
            holds = lambda k, s, e: k >= s and (not e or k < e)
            assert sorted(map(tuple, got)) == [(k, i) for k in ks for i, s, e in rs if holds(k, s, e)]
            want = []
            for k in ks:
                hit = [(holds(k, s, e), holds(k, s, e) and k > s) for _, s, e in rs if k >= s and (not e or k <= e)]
                want += [(k, sum(h for h, _ in hit), sum(o for _, o in hit), len(hit))] if hit else []
            assert sorted(map(tuple, ranges.members(table, known).collect())) == want
            over = [(i, n) for i, _, e in rs if e and (n := sum(k >= e for k in ks))]
            asked = [(j, s, e) for j, (s, e) in enumerate([("", ""), ("", "b"), ("a", "aa"), ("abab", "c"), ("bb", ""), ("cccc", "ccccc"), ("", "a"), ("ab", "ab")])]
            meet = lambda s, e, x, y: (not y or s < y) and (not e or x < e)
            pairs = sorted((j, i) for j, s, e in asked for i, x, y in rs if j != i and meet(s, e, x, y))
            assert rows(ranges.overlaps(spark.createDataFrame(asked, shape), known)) == pairs
            assert sorted(map(tuple, ranges.exceeding(table, known).collect())) == over
            ids = [i for i, _, _ in rs]
            assert sorted(map(tuple, ranges.siblings(known).collect()), key=lambda r: r[0]) == list(zip(ids, [None, *ids], [*ids[1:], None]))
            sizes = known.selectExpr("region_id", "start_key", "region_id + 1 AS n")
            sums = {i: sum(j + 1 for j in ids[: at + 1]) for at, i in enumerate(ids)}
            assert {r.region_id: r.so_far for r in running_sum(sizes, "n", "start_key", "so_far").collect()} == sums
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_lookups_have_no_nested_loops(spark):
    for name in ("q_key_to_region", "q_key_in_region", "q_key_in_region_exclusive", "q_range_empty"):
        plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
