"""Streams whose state ends: flat over many rounds of new runs, equal to the forms that keep everything, late rows counted."""

import pytest

from treeledger.streaming import events as st

ROW = (
    "run_id string, seq bigint, ts_ms bigint, kind string, level string, outcome string, bytes bigint, phase string, items_done bigint, "
    "items_total bigint, bytes_done bigint, bytes_total bigint, label string, status string"
)
ROUNDS, STEP = 20, 100_000


def rounds():
    """Each round has runs of its own, and one late row of the run ten rounds before."""
    out = []
    for i in range(ROUNDS):
        at, run = 1_000_000 + i * STEP, f"r{i}"
        rows = [
            (run, 1, at, "phase_start", None, None, None, "copy", None, 9, None, 90, "begin", None),
            (run, 2, at + 10, "progress", None, None, None, "copy", 3, None, 30, None, None, None),
            (run, 3, at + 20, "progress", None, None, None, "copy", 5, None, 50, None, None, None),
            (run, 4, at + 130, "progress", None, None, None, "copy", 6, None, 60, None, None, None),
            (run, 5, at + 200, "item_result", None, "ok", 7, None, None, None, None, None, None, None),
            (run, 6, at + 300, "log", "warn", None, None, None, None, None, None, None, None, None),
            (run, 7, at + 400, "phase_end", None, None, None, "copy", 9, None, 90, None, None, "completed"),
        ]
        if i >= 10:
            rows.append((f"r{i - 10}", 99, at - 10 * STEP + 500, "progress", None, None, None, "copy", 1, None, 1, None, None, None))
        out.append(rows)
    return out


def streamed(spark, folder):
    for rows in rounds():
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@pytest.mark.parametrize("name", ["stages", "counters", "throttle"])
def test_state_stays_flat_and_late_rows_are_counted(spark, tmp_path, name):
    events, forget = streamed(spark, str(tmp_path)), st.Forget(after_ms=2 * STEP, delay="1 second")
    made = {"stages": st.stage_stream, "counters": st.run_counter_stream, "throttle": st.throttle_stream}[name](events, forget=forget)
    late, out = st.LateRows(), str(tmp_path / "out")
    spark.streams.addListener(late)
    try:
        if name == "throttle":
            writer = made.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).format("parquet").option("path", out)
        else:
            writer = st.update_table(made, out, str(tmp_path / "c"))
        query = writer.queryName(name).trigger(availableNow=True).start()
        query.awaitTermination(600)
        spark._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(late)
    table = late.table(spark).orderBy("round").collect()
    assert max(r.held for r in table) <= 5 and len({r.round for r in table}) >= ROUNDS
    # A late row is ten rounds behind; the stages and the throttle take progress rows, the counters every row.
    assert late.dropped(name) == ROUNDS - 10
    late.save(spark, str(tmp_path / "late"))
    assert spark.read.parquet(str(tmp_path / "late")).selectExpr("sum(dropped)").first()[0] == ROUNDS - 10 and not late.seen
    if name == "throttle":
        kept = sorted((r.run_id, r.seq) for r in spark.read.parquet(out).collect())
        assert kept == sorted((f"r{i}", s) for i in range(ROUNDS) for s in (2, 4))
    elif name == "counters":
        got = {r.run_id: (r.warnings, r.errors, r.done, r.failed, r.bytes_done) for r in st.latest_rows(spark, out, ["run_id"]).collect()}
        assert got == {f"r{i}": (1, 0, 1, 0, 7) for i in range(ROUNDS)}
    else:
        got = {r.run_id: (r.items_done, r.bytes_done, r.active, r.done) for r in st.latest_rows(spark, out, ["run_id", "phase"]).collect()}
        assert got == {f"r{i}": (9, 90, False, True) for i in range(ROUNDS)}
    with pytest.raises(ValueError):
        st.throttle_stream(events, 100, st.Forget(99))
