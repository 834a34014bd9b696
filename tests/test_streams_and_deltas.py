"""Streams against their batch forms or a plain model; chunk bounds against a byte-by-byte model; run folds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeledger.operators import delta, history, progress, watch
from treeledger.streaming import events as st


def greedy(times, spacing):
    kept, last = [], None
    for t in sorted(times):
        if last is None or t - last >= spacing:
            kept.append(t)
            last = t
    return kept


def finished(writer):
    started = writer.trigger(availableNow=True).start()
    started.awaitTermination()


def test_throttle_batch_and_stream_equal_the_greedy_chain(spark, tmp_path):
    rng = random.Random(3)
    rows, want = [], {}
    for phase, step in (("dense", 7), ("sparse", 90_000), ("mixed", 0)):
        t, times = 1_000_000, []
        for _ in range(2500):
            t += step or rng.choice([0, 1, 40, 99, 100, 101, 70_000])
            times.append(t)
        rows += [("r", i, "progress", phase, x) for i, x in enumerate(times)]
        want[phase] = greedy(times, 100)
    df = spark.createDataFrame(rows, "run_id string, seq bigint, kind string, phase string, ts_ms bigint")
    got = {}
    for r in progress.throttled(df, ["run_id"]).collect():
        got.setdefault(r["phase"], []).append(r["ts_ms"])
    assert {k: sorted(v) for k, v in got.items()} == want
    source = str(tmp_path / "in")
    for part in range(3):
        df.where((F.col("seq") >= part * 900) & (F.col("seq") < (part + 1) * 900)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(source)
    out = str(tmp_path / "out")
    finished(st.throttle_stream(stream).writeStream.option("checkpointLocation", str(tmp_path / "c")).outputMode("append").format("parquet").option("path", out))
    got = {}
    for r in spark.read.parquet(out).collect():
        got.setdefault(r["phase"], []).append(r["ts_ms"])
    assert {k: sorted(v) for k, v in got.items()} == want


def test_change_batches_batch_and_stream(spark, tmp_path):
    rows = [
        ("w", 1000, "a", None), ("w", 2500, "b", None), ("w", 4499, "a", None), ("w", 6499, "c", None), ("w", 6500, "d", None), ("w", 6600, "e", None),
        ("w", 6700, "f", None), ("w", 20000, "x", "kernel_dropped"), ("w", 30000, "y", None), ("w", 90000, "z", None),
    ]
    df = spark.createDataFrame(rows, "watch string, ts_ms bigint, path string, invalidation string").coalesce(1)
    batch = watch.debounced_batches(df, ["watch"], max_paths=3, slice_ms=5000)
    got = [(r["batch"], r["first_ms"], r["due_ms"], r["events"], r["coverage"]) for r in batch.orderBy("batch").collect()]
    want = [
        (1, 1000, 6499, 3, "full: bootstrap"), (2, 6499, 8700, 4, "full: more than 3 changes"), (3, 20000, 22000, 1, "full: kernel_dropped"),
        (4, 30000, 32000, 1, "incremental"), (5, 90000, 92000, 1, "incremental"),
    ]
    assert got == want
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.orderBy("ts_ms").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    finished(st.change_stream(stream, max_paths=3).writeStream.option("checkpointLocation", str(tmp_path / "c")).outputMode("append").format("parquet").option("path", out))
    seen = {(r["batch"], r["first_ms"], r["due_ms"], r["events"], r["coverage"]) for r in spark.read.parquet(out).collect()}
    assert seen >= set(want[:4])


def test_raw_events_reset_epochs_across_slices(spark):
    rng = random.Random(9)
    rows, cursor, epoch, want = [], 5, 0, []
    for seq in range(300):
        event_id = rng.choice([0, cursor, cursor + 3, cursor + 1, max(cursor - 2, 1)])
        wrapped = rng.random() < 0.03
        if wrapped or (event_id and event_id < cursor):
            epoch, cursor = epoch + 1, event_id
        elif event_id:
            cursor = max(cursor, event_id)
        want.append(epoch)
        rows.append(("s", seq, seq * 100, event_id, "root/a", wrapped, False, False, False, False, False, False))
    flags = "wrapped boolean, history_done boolean, user_dropped boolean, kernel_dropped boolean, must_scan boolean, root_changed boolean, unmounted boolean"
    df = spark.createDataFrame(rows, f"stream string, seq bigint, ts_ms bigint, event_id bigint, device_path string, {flags}")
    seeds = spark.createDataFrame([("s", "root", 5)], "stream string, root string, event_id bigint")
    got = watch.reduce_raw_events(df, seeds, slice_ms=1000).orderBy("seq").collect()
    assert [r["epoch"] for r in got] == want and {r["path"] for r in got} == {"a"}


def model_boundaries(data, minimum, average, maximum):
    mask = (1 << max(1, (average - minimum).bit_length() - 1)) - 1
    gear = [int(g) for g in delta._GEAR]
    ends, start = [], 0
    while len(data) - start > minimum:
        limit = min(start + maximum, len(data))
        end = limit
        for e in range(start + minimum, limit + 1):
            h = sum(gear[data[e - 1 - k]] << k for k in range(min(32, e))) & (2**64 - 1)
            if (h >> 16) & mask == 0:
                end = e
                break
        ends.append(end)
        start = end
    if start < len(data):
        ends.append(len(data))
    return ends


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 500, 3000])
def test_chunk_bounds_equal_the_model(size):
    data = np.random.default_rng(size).integers(97, 110, size, dtype=np.uint8).tobytes()
    got = delta.boundaries(data, 64, 128, 512)
    assert got == model_boundaries(data, 64, 128, 512)
    lengths = np.diff([0, *got])
    assert got == [] if not size else got[-1] == size
    assert all(n <= 512 for n in lengths) and all(n >= 64 for n in lengths[:-1])


def test_an_edit_moves_few_chunks(spark):
    body = np.random.default_rng(1).integers(97, 122, 60_000, dtype=np.uint8).tobytes()
    edited = body[:30_000] + b"inserted" + body[30_000:]
    cut = lambda b: delta.chunk_table(spark.createDataFrame([("f", bytearray(b))], "name string, content binary"), ["name"], "content", 256, 1024, 4096)
    recipe = delta.delta_recipe(cut(edited), cut(body), ["name"], minimum_size=1000)
    saved = delta.delta_savings(recipe, ["name"]).first()
    assert saved["size"] == 60_008 and saved["blob_bytes"] < 10_000
    payload = spark.createDataFrame([("f", 60_008, saved["blob_bytes"] - 1)], "name string, size bigint, blob_size bigint")
    bases = spark.createDataFrame([("f", 60_000)], "name string, base_size bigint")
    assert [r["fault"] for r in delta.recipe_faults(recipe, payload, bases, ["name"]).collect()] == ["reads beyond its blob"]


def model_stagger(times, now):
    keep_step = [(30, 3600), (3600, 86_400), (86_400, 30 * 86_400), (7 * 86_400, 365 * 86_400)]
    removed, last = [], None
    for t in sorted(times):
        age = now - t
        if age > 365 * 86_400:
            removed.append(t)
        elif last is None:
            last = t
        elif t - last < next((s for s, end in keep_step if age < end), 365 * 86_400):
            removed.append(t)
        else:
            last = t
    return removed


def test_stagger_and_retention(spark):
    rng, now = random.Random(4), 2_000_000_000
    times = [now - rng.choice([rng.randrange(4000), rng.randrange(90_000), rng.randrange(40 * 86_400), rng.randrange(400 * 86_400)]) for _ in range(300)]
    times += times[:20]
    runs = spark.createDataFrame([("s", str(i), t * 1000, 10) for i, t in enumerate(times)], "store string, run_id string, at_ms bigint, bytes bigint")
    seconds = runs.withColumn("at_s", F.floor(F.col("at_ms") / 1000).cast("bigint"))
    got = {r["at_s"] for r in history.stagger_removals(seconds, ["store"], now).collect()}
    assert got == set(model_stagger(times, now))
    ordered = sorted(range(len(times)), key=lambda i: (times[i], str(i)))
    doomed = {next(i for i in ordered if times[i] == t) for t in model_stagger(times, now)}
    doomed |= {i for i in ordered if times[i] * 1000 < now * 1000 - 200 * 86_400_000}
    total = sum(10 for i in ordered if i not in doomed)
    for i in ordered:
        if total <= 400:
            break
        if i not in doomed:
            doomed.add(i)
            total -= 10
    doomed.discard(ordered[-1])
    plan = history.retention_plan(runs, ["store"], now * 1000, keep_days=200, max_bytes=400)
    assert {int(r["run_id"]) for r in plan.where("drop").collect()} == doomed
