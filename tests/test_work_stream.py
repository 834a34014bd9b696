"""Live work batches against their batch forms and against a plain model of the trigger."""

import random

import pytest
from pyspark.sql import functions as F

from treeledger.operators import watch
from treeledger.streaming import work

ROW = "watch string, ts_ms bigint, kind string, path string, invalidation string, ticket bigint"
END = 10_000_000


def run(spark, tmp_path, parts, **more):
    work.keyed_state(spark)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        spark.createDataFrame(part, ROW).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(source)
    made = work.work_stream(stream, **more)
    query = made.writeStream.option("checkpointLocation", str(tmp_path / "c")).outputMode("append").format("parquet").option("path", out)
    started = query.trigger(availableNow=True).start()
    started.awaitTermination(600)
    if started.exception():
        raise started.exception()
    return spark.read.parquet(out), started


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_stream_equals_the_batch_forms(spark, tmp_path, rocks):
    r, parts, at = random.Random(7), [], 1_000_000
    for _ in range(5):
        part = []
        for _ in range(60):
            at += r.choice([0, 1, 500, 1_999, 2_000, 2_001, 9_000])
            bad = "kernel_dropped" if r.random() < 0.04 else None
            part.append((r.choice("vw"), at, "change", None if bad else r.choice("abcdefgh"), bad, None))
        parts.append(part)
    last = [(w, at + END, "change", "end", None, None) for w in "vw"]
    got, _ = run(spark, tmp_path, [*parts, last, [("x", at + 2 * END, "change", "x", None, None)]], max_paths=4)
    rows = spark.createDataFrame([row for p in [*parts, last] for row in p], ROW)
    batches = watch.debounced_batches(rows, ["watch"], max_paths=4).collect()
    want = {(b.watch, b.batch): (b.first_ms, b.due_ms, b.events, b.paths, b.coverage) for b in batches}
    seen = {(b.watch, b.batch): (b.first_ms, b.due_ms, b.events, b.paths, b.coverage) for b in got.where("watch <> 'x'").collect()}
    assert seen == want
    paths = {tuple(x) for x in watch.batch_paths(rows, ["watch"]).select("watch", "batch", "path", "ts_ms").collect()}
    assert {tuple(x) for x in got.where("path is not null and watch <> 'x'").select("watch", "batch", "path", "path_ms").collect()} == paths
    assert got.where("path is not null").count() == got.where("path is not null").select("watch", "batch", "path").distinct().count()


def test_failed_tickets_are_queued_again(spark, tmp_path, rocks):
    c = lambda t, p, bad=None: ("w", t, "change", p, bad, None)
    settle = lambda t, kind, n: ("w", t, kind, None, None, n)
    parts = [
        [c(1_000, "a")], [settle(10_000, "done", 1), c(11_000, "b"), c(11_500, "c")],  # 1: bootstrap; 2: b, c
        [c(20_000, "d")], [settle(21_000, "failed", 2)],  # d waits for ticket 2; it fails within d's quiet period: 3 has b, c, d
        [settle(30_000, "failed", 3)],  # nothing newer: 4 is retried at once
        [settle(40_000, "done", 4), settle(40_001, "failed", 4), c(50_000, None, "user_dropped")],  # settled once; 5: full
        [settle(60_000, "failed", 5), ("w", 70_000, "periodic", None, None, None)],  # 6: at once; the request waits for it
        [settle(80_000, "done", 6), ("w", 90_000, "periodic", None, None, None)],  # 7: that request; this one waits for 7
        [settle(95_000, "done", 7), ("v", END, "change", "z", None, None)], [("v", 2 * END, "change", "z", None, None)],
    ]
    got, _ = run(spark, tmp_path, parts, acknowledged=True)
    seen = {}
    for x in got.where("watch = 'w'").orderBy("batch", "path").collect():
        seen.setdefault((x.batch, x.coverage), []).append(x.path)
    assert seen == {
        (1, "full: bootstrap"): ["a"], (2, "incremental"): ["b", "c"], (3, "incremental"): ["b", "c", "d"], (4, "incremental"): ["b", "c", "d"],
        (5, "full: user_dropped"): [None], (6, "full: user_dropped"): [None], (7, "full: periodic"): [None], (8, "full: periodic"): [None],
    }
    due = {x.batch: x.due_ms for x in got.where("watch = 'w'").collect()}
    assert due[3] == 22_000 and due[4] == 30_000 and due[7] == 70_000 and due[8] == 90_000


def test_idle_watches_are_forgotten(spark, tmp_path, rocks):
    """Twenty rounds of new watches: the state holds the last few only."""
    parts = [[(f"w{i}", i * 100_000 + k, "change", f"p{k}", None, None) for k in range(5)] for i in range(20)]
    got, query = run(spark, tmp_path, parts, forget_ms=50_000)
    sizes = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    assert max(sizes[-6:]) <= max(sizes[2:8]) + 2
    assert got.select("watch").distinct().count() >= 18 and {x.coverage for x in got.select("coverage").distinct().collect()} == {"full: bootstrap"}
    assert got.where(F.col("path").isNull()).isEmpty()
