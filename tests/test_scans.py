"""Scans over range partitions: previous values and running sums of hot and null groups, and the operators that use them."""

import random

from pyspark.sql import functions as F

from treeledger import cluster
from treeledger.operators import progress, watch


def rows(r, n=4_000):
    """One group has nine tenths of the rows, a null is a group as well, and values have gaps."""
    groups = ["hot"] * 18 + ["a", None]
    return [(r.choice(groups), i, r.choice([None, None, r.randint(0, 99)])) for i in range(n)]


def test_previous_value_and_running_total(spark):
    data = rows(random.Random(1))
    df = spark.createDataFrame(data, "g string, i bigint, v bigint").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        before = {x.i: x.p for x in cluster.previous_value(df, ["g"], ["i"], F.col("v"), "p").collect()}
        sums = {x.i: x.s for x in cluster.running_total(df, ["g"], ["i"], F.coalesce("v", F.lit(0)), "s").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    last, total = {}, {}
    for g, i, v in data:
        assert before[i] == last.get(g) and sums[i] == total.get(g, 0)
        total[g] = total.get(g, 0) + (v or 0)
        last[g] = last.get(g) if v is None else v
    assert len(before) == len(sums) == len(data)


def test_streams_without_a_cursor_keep_their_rows(spark):
    flags = "wrapped boolean, history_done boolean, user_dropped boolean, kernel_dropped boolean, must_scan boolean, root_changed boolean, unmounted boolean"
    none = (False,) * 7
    events = spark.createDataFrame(
        [("known", i, i, 10 + i, "root/a", *none) for i in range(3)] + [("new", i, i, e, "a/b", *none) for i, e in enumerate([9, 12, 11, 0, 13])],
        f"stream string, seq bigint, ts_ms bigint, event_id bigint, device_path string, {flags}",
    )
    seeds = spark.createDataFrame([("known", "root", 11)], "stream string, root string, event_id bigint")
    got = {(x.stream, x.seq): (x.epoch, x.path) for x in watch.reduce_raw_events(events, seeds).collect()}
    assert got == {
        ("known", 0): (1, "a"), ("known", 1): (1, "a"), ("known", 2): (1, "a"),
        ("new", 0): (0, "a/b"), ("new", 1): (0, "a/b"), ("new", 2): (1, "a/b"), ("new", 3): (1, "a/b"), ("new", 4): (1, "a/b"),
    }


def test_cursor_breaks_follow_their_predecessor(spark):
    r = random.Random(2)
    data, old = [], {}
    want = {}
    for i in range(800):
        key = r.choice([("w", "s")] * 9 + [("w", None)])
        now = (r.choice(["j", "j", "j", None]), r.choice([1, 1, 1, 2]), r.randint(0, 9))
        p = old.get(key)
        want[i] = p is None or (p[0] == now[0] and p[1] == now[1] and now[2] >= p[2])
        old[key] = now
        data.append((*key, i, i * 10, *now))
    df = spark.createDataFrame(data, "watch string, stream string, seq bigint, ts_ms bigint, journal string, epoch bigint, event_id bigint")
    assert {x.seq: x.follows for x in watch.cursor_breaks(df).collect()} == want


def test_active_time_without_a_gathered_run(spark):
    r, events, want = random.Random(3), [], {}
    for run in ("a", "b"):
        at, paused = 1_000, 0
        events.append((run, 0, at, "started", None))
        for i in range(1, 300):
            at += r.choice([0, 5, 70])
            if r.random() < 0.3:
                ms = r.randint(0, 4)
                events.append((run, i, at, "resumed", ms))
            else:
                events.append((run, i, at, "progress", None))
    for run, seq, at, kind, _ in events:
        if kind == "progress":
            paused = sum(ms for g, _, t, k, ms in events if g == run and k == "resumed" and t <= at)
            want[run, seq] = at - 1_000 - paused
    df = spark.createDataFrame(events, "run_id string, seq bigint, ts_ms bigint, kind string, paused_ms bigint")
    assert {(x.run_id, x.seq): x.active_ms for x in progress.progress_samples(df, ["run_id"]).collect()} == want
