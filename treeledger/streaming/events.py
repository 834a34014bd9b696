"""Structured Streaming forms: counters, phase states, throttling, debounced changes, routing, compare rounds."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.progress import COUNTERS, SPACING_MS
from ..operators.stats import side_stats
from ..operators.watch import DEBOUNCE_MS, FULL_VERIFICATION, MAX_PATHS
from ..sources.runs import routed, write_routed_buckets


def watermarked(events: DataFrame, delay: str) -> DataFrame:
    """Add `event_time` from ts_ms and accept rows up to `delay` late."""
    return events.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", delay)


def run_counters(events: DataFrame) -> DataFrame:
    """Per run: warnings, errors and item outcomes so far. A streaming aggregate for update mode."""
    log, level = F.col("kind") == "log", F.col("level")
    item = F.col("kind") == "item_result"
    outcome = lambda o: F.count_if(item & (F.col("outcome") == o))
    return events.groupBy("run_id").agg(
        F.count_if(log & (level == "warn")).alias("warnings"),
        F.count_if((log & (level == "error")) | (F.col("kind") == "error")).alias("errors"),
        outcome("ok").alias("done"), outcome("kept").alias("skipped"), outcome("failed").alias("failed"), outcome("cancelled").alias("cancelled"),
        F.sum(F.when(item & (F.col("outcome") == "ok"), F.col("bytes")).otherwise(0)).cast("bigint").alias("bytes_done"),
    )


# --- phase states -------------------------------------------------------------------------------------------

_STAGE = "run_id string, phase string, items_done bigint, items_total bigint, bytes_done bigint, bytes_total bigint, label string, active boolean, done boolean, failed boolean, cancelled boolean"
_STAGE_STATE = "counters array<bigint>, label string, active boolean, status string"


@dataclass(frozen=True)
class Forget:
    """When a group's state ends: once the watermark, `delay` behind the newest row, is `after_ms` past the group's last row.

    Rows behind the watermark are dropped then; `LateRows` counts them.
    """

    after_ms: int
    delay: str = "10 seconds"

    def timed(self, events: DataFrame) -> DataFrame:
        return watermarked(events, self.delay)

    def set(self, state: GroupState, last_ms: int) -> None:
        state.setTimeoutTimestamp(max(int(last_ms) + self.after_ms, state.getCurrentWatermarkMs() + 1))


def _by_group(
    events: DataFrame, keys: list[str], columns: list[str], forget: Forget | None, step, output: str, kept: str, mode: str
) -> DataFrame:
    """`step(key, rows, state) -> output rows` per group and micro-batch. With `forget`, the state carries the group's last
    ts_ms in its last field, and a group past its time is removed without a row; without it, states stay for good."""
    names = [part.split()[0] for part in output.split(", ")]
    clock = "" if forget is None else ", last_seen bigint"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))
        old = state.get if state.exists else None
        new, out = step(rows, None if old is None else old if forget is None else old[:-1])
        if forget is None:
            if new is not None:
                state.update(new)
        else:
            last = max(int(rows["ts_ms"].max()), old[-1] if old else 0)
            state.update((*new, last))
            forget.set(state, last)
        yield pd.DataFrame([(*key, *row) for row in out], columns=names)

    timeout = GroupStateTimeout.NoTimeout if forget is None else GroupStateTimeout.EventTimeTimeout
    timed = events if forget is None else forget.timed(events)
    wanted = [*keys, *columns] + ([] if forget is None else [c for c in ("ts_ms", "event_time") if c not in columns])
    return timed.select(*wanted).groupBy(*keys).applyInPandasWithState(run, output, kept + clock, mode, timeout)


def stage_stream(events: DataFrame, forget: Forget | None = None) -> DataFrame:
    """The state of each (run, phase) after every micro-batch, for update mode.

    State per phase is its four counters, label and status; rows of a batch apply in `seq` order. With `forget`, phases that
    have been quiet long enough leave the state; their last row has been emitted.
    """

    def reduce(rows: pd.DataFrame, old: tuple | None) -> tuple[tuple, list[tuple]]:
        counters, label, active, status = old or ([0, 0, 0, 0], "", True, "")
        counters = list(counters)
        for row in rows.sort_values("seq").itertuples(index=False):
            seen = [getattr(row, c) for c in COUNTERS]
            given = [0 if pd.isna(v) else int(v) for v in seen]
            if row.kind == "phase_start":
                counters = [0, given[1], 0, given[3]]
                label = label if row.label is None else row.label
                active, status = True, ""
            elif row.kind == "totals":
                counters = given
            elif row.kind == "progress":
                counters = [max(a, b) for a, b in zip(counters, given)]
                label = ""
            elif row.kind == "phase_end":
                counters = [old if pd.isna(v) else int(v) for old, v in zip(counters, seen)]
                active, status = False, row.status or ""
        ends = [status == x for x in ("completed", "failed", "cancelled")]
        return (counters, label, active, status), [(*counters, label, active, *ends)]

    wanted = events.where(F.col("kind").isin("phase_start", "totals", "progress", "phase_end") & F.col("phase").isNotNull())
    return _by_group(wanted, ["run_id", "phase"], ["seq", "kind", *COUNTERS, "label", "status"], forget, reduce, _STAGE, _STAGE_STATE, "update")


_TALLY = "warnings bigint, errors bigint, done bigint, skipped bigint, failed bigint, cancelled bigint, bytes_done bigint"


def run_counter_stream(events: DataFrame, forget: Forget) -> DataFrame:
    """The counters of `run_counters` after every micro-batch, for update mode, with a state that ends.

    A streaming aggregate by run alone keeps every run for good. Here a micro-batch's rows are numbers before they are
    grouped, and a run that has been quiet long enough leaves the state.
    """
    log, level, item = F.col("kind") == "log", F.col("level"), F.col("kind") == "item_result"
    outcome = lambda o: item & (F.col("outcome") == o)
    flags = [
        log & (level == "warn"), (log & (level == "error")) | (F.col("kind") == "error"),
        outcome("ok"), outcome("kept"), outcome("failed"), outcome("cancelled"),
    ]
    names = [part.split()[0] for part in _TALLY.split(", ")]
    numbers = [F.coalesce(f, F.lit(False)).cast("bigint").alias(n) for f, n in zip(flags, names, strict=False)]
    size = F.when(F.coalesce(outcome("ok"), F.lit(False)), F.coalesce("bytes", F.lit(0))).otherwise(0).cast("bigint").alias(names[-1])
    rows = events.select("run_id", "ts_ms", *numbers, size)

    def add(found: pd.DataFrame, old: tuple | None) -> tuple[tuple, list[tuple]]:
        sums = tuple(int(found[n].sum()) + o for n, o in zip(names, old or [0] * len(names), strict=True))
        return sums, [sums]

    return _by_group(rows, ["run_id"], names, forget, add, f"run_id string, {_TALLY}", _TALLY, "update")


def throttle_stream(events: DataFrame, spacing_ms: int = SPACING_MS, forget: Forget | None = None) -> DataFrame:
    """Progress rows kept when each must follow the last kept one of its phase by the spacing (append mode).

    A micro-batch brings one phase's rows to one task; bound it at the source (files or offsets per trigger). With `forget`,
    quiet phases leave the state; a row of one that comes back is kept, as it follows by more than the spacing anyway if
    `forget.after_ms` is no less than that.
    """
    if forget is not None and forget.after_ms < spacing_ms:
        raise ValueError("a phase can't be forgotten before the spacing has passed")

    def keep(rows: pd.DataFrame, old: tuple | None) -> tuple[tuple, list[tuple]]:
        last, out = old[0] if old else None, []
        ordered = rows.sort_values(["ts_ms", "seq"])
        for ts, seq in zip(ordered["ts_ms"], ordered["seq"], strict=True):
            if last is None or ts - last >= spacing_ms:
                last = int(ts)
                out.append((ts, seq))
        return (last,), out

    wanted = events.where("kind = 'progress'")
    output = "run_id string, phase string, ts_ms bigint, seq bigint"
    return _by_group(wanted, ["run_id", "phase"], ["ts_ms", "seq"], forget, keep, output, "last bigint", "append")


class LateRows(StreamingQueryListener):
    """Counts the rows that a query's stateful operators drop behind the watermark, and the size of their state, per round.

    Add it with `spark.streams.addListener`; `table` gives what was seen, one row per round that dropped rows or holds state.
    """

    def __init__(self) -> None:
        self.seen: list[tuple[str, int, int, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.stateOperators:
            dropped = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
            self.seen.append((p.name or str(p.id), p.batchId, dropped, sum(s.numRowsTotal for s in p.stateOperators)))

    def dropped(self, query: str | None = None) -> int:
        return sum(d for q, _, d, _ in self.seen if query in (None, q))

    def table(self, spark: SparkSession) -> DataFrame:
        """query, round, dropped, held."""
        return spark.createDataFrame(list(self.seen), "query string, round bigint, dropped bigint, held bigint")

    def save(self, spark: SparkSession, path: str) -> None:
        """Append what was seen since the last call; call it between rounds or at the end, not from the listener itself."""
        rows, self.seen = self.seen, []
        if rows:
            spark.createDataFrame(rows, "query string, round bigint, dropped bigint, held bigint").write.mode("append").parquet(path)


# --- changes ------------------------------------------------------------------------------------------------

_BATCH = "watch string, batch bigint, first_ms bigint, due_ms bigint, events bigint, paths bigint, coverage string"
_BATCH_STATE = "batch bigint, first_ms bigint, last_ms bigint, events bigint, paths string, overflow boolean, invalidation string"


def change_stream(
    changes: DataFrame, policy: str = "balanced", debounce_ms: int = DEBOUNCE_MS, max_paths: int | None = MAX_PATHS, delay: str = "10 seconds"
) -> DataFrame:
    """Work batches of a live change stream (watch, ts_ms, path, invalidation), emitted once it stays quiet.

    The state of a watch holds the open batch's paths; more than `max_paths` of them, if given, make it a full scan. A batch closes when the watermark passes its deadline.
    """

    def coverage(first: bool, invalidation, overflow: bool) -> str:
        if first:
            return "full: bootstrap"
        if invalidation:
            return f"full: {invalidation}"
        if overflow:
            return f"full: more than {max_paths} changes"
        return f"full: evidence policy {policy}" if policy in FULL_VERIFICATION else "incremental"

    def gather(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, open_batch = (0, None)
        if state.exists:
            number, first, last, events, paths, overflow, invalidation = state.get
            if last is not None:
                open_batch = [first, last, events, set(json.loads(paths)), overflow, invalidation]
        out = []

        def close():
            nonlocal open_batch, number
            first, last, events, paths, overflow, invalidation = open_batch
            number += 1
            out.append((*key, number, first, last + debounce_ms, events, len(paths), coverage(number == 1, invalidation, overflow)))
            open_batch = None

        if state.hasTimedOut:
            if open_batch:
                close()
        else:
            rows = pd.concat(list(batches)).sort_values("ts_ms", kind="stable")
            for ts, path, invalid in zip(rows["ts_ms"], rows["path"], rows["invalidation"]):
                if open_batch and ts - open_batch[1] >= debounce_ms:
                    close()
                if open_batch is None:
                    open_batch = [int(ts), int(ts), 0, set(), False, None]
                open_batch[1] = max(open_batch[1], int(ts))
                open_batch[2] += 1
                if invalid:
                    open_batch[5] = invalid
                else:
                    open_batch[3].add(path)
                    open_batch[4] = max_paths is not None and len(open_batch[3]) > max_paths
        if open_batch:
            first, last, events, paths, overflow, invalidation = open_batch
            state.update((number, first, last, events, json.dumps(sorted(paths)), overflow, invalidation))
            state.setTimeoutTimestamp(max(last + debounce_ms, state.getCurrentWatermarkMs() + 1))
        else:
            state.update((number, None, None, 0, "[]", False, None))
        yield pd.DataFrame(out, columns=["watch", "batch", "first_ms", "due_ms", "events", "paths", "coverage"])

    timed = watermarked(changes, delay).select(F.col("watch").cast("string").alias("watch"), "ts_ms", "path", "invalidation", "event_time")
    return timed.groupBy("watch").applyInPandasWithState(gather, _BATCH, _BATCH_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# --- sinks ------------------------------------------------------------------------------------------------------


def route_stream(events: DataFrame, root: str, checkpoint: str, minimum_level: str = "info") -> DataStreamWriter:
    """Append events to their artifact files as they arrive: one folder per run and artifact kind."""
    body = F.to_json(F.struct(*[c for c in events.columns if c != "run_id"]), {"ignoreNullFields": "true"})
    lines = routed(events, minimum_level).select("run_id", "artifact", body.alias("value"))
    return lines.writeStream.format("text").partitionBy("run_id", "artifact").option("path", root).option(
        "checkpointLocation", checkpoint
    ).outputMode("append")


def route_stream_buckets(events: DataFrame, root: str, checkpoint: str, buckets: int = 64, minimum_level: str = "info") -> DataStreamWriter:
    """The same into buckets with an index: the files of a round don't grow with its runs. Read with `runs.read_routed`."""

    def write(rows: DataFrame, round_no: int) -> None:
        write_routed_buckets(rows, root, round_no, buckets, minimum_level)

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def update_table(updates: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Write every micro-batch of an update-mode stream as a table partition `round`; replays overwrite it."""

    def write(rows: DataFrame, round_no: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/round={round_no}")

    return updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row per key of an `update_table`."""
    rows = spark.read.parquet(path)
    fields = F.struct(*[c for c in rows.columns if c not in (*keys, "round")])
    return rows.groupBy(*keys).agg(F.max_by(fields, F.col("round")).alias("r")).select(*keys, "r.*")


def compare_rounds(changes: DataFrame, maintained, path: str, checkpoint: str, order: str = "ts_ms") -> DataStreamWriter:
    """Keep a comparison up to date with a stream of inventory changes; every round appends its per-side statistics.

    `changes` streams the columns of `maintained.CHANGE` and `order`; `maintained` is a started `Maintained`. A round decides
    the keys in the buckets of its changes again, not the inventories. A replayed round replaces what it wrote.
    """
    from ..plans.maintained import last_changes

    def round_(rows: DataFrame, round_no: int) -> None:
        maintained.apply(last_changes(rows, order), round_no + 1)
        stats = side_stats(maintained.comparison(round_no + 1).operations())
        stats.write.mode("overwrite").parquet(f"{path}/round={round_no + 1}")

    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(round_)
