"""Live work batches on keyed state: paths are state entries of their own, quiet periods are event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.watch import DEBOUNCE_MS, FULL_VERIFICATION, MAX_PATHS
from .events import watermarked

#: What a row says: a changed path or an invalidation, the result of the watch's active ticket, or a request for a full check.
CHANGE, DONE, FAILED, PERIODIC = "change", "done", "failed", "periodic"

WORK = T.StructType([
    T.StructField(name, T.StringType() if name in ("watch", "coverage", "path") else T.LongType())
    for name in ("watch", "batch", "first_ms", "due_ms", "events", "paths", "coverage", "path", "path_ms")
])
_HEAD = (
    "number bigint, first_ms bigint, due_ms bigint, events bigint, paths bigint, full string, periodic boolean, "
    "active bigint, active_coverage string, seen_ms bigint"
)
_HEAD_NAMES = [part.split()[0] for part in _HEAD.split(",")]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Streams of this session started from now on keep their state in RocksDB, which `work_stream` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class WorkProcessor(StatefulProcessor):
    """State of a watch: a head of a few numbers, the open batch's paths, and the active ticket's paths until it is settled."""

    def __init__(self, policy: str, debounce_ms: int, max_paths: int | None, acknowledged: bool, forget_ms: int | None):
        self.policy, self.debounce_ms, self.max_paths = policy, debounce_ms, max_paths
        self.acknowledged, self.forget_ms = acknowledged, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", _HEAD)
        self.paths = handle.getMapState("paths", "path string", "ts_ms bigint")
        self.issued = handle.getMapState("issued", "path string", "ts_ms bigint")

    def close(self) -> None:
        pass

    # --- the rules of a watch ------------------------------------------------------------------------------------

    def _coverage(self, h: dict) -> str:
        if h["number"] == 1:
            return "full: bootstrap"
        if h["full"]:
            return h["full"]
        if self.max_paths is not None and h["paths"] > self.max_paths:
            return f"full: more than {self.max_paths} changes"
        if h["periodic"]:
            return "full: periodic"
        return f"full: evidence policy {self.policy}" if self.policy in FULL_VERIFICATION else "incremental"

    def _emit(self, h: dict, out: list) -> None:
        """The open batch becomes a ticket: one row per path, one without a path if it has none."""
        h["number"] += 1
        coverage = self._coverage(h)
        row = (h["number"], h["first_ms"], h["due_ms"], h["events"], h["paths"], coverage)
        found = [(k[0], v[0]) for k, v in self.paths.iterator()]
        out += [(*row, path, ts) for path, ts in sorted(found)] or [(*row, None, None)]
        if self.acknowledged:
            for path, ts in found:
                self.issued.updateValue((path,), (ts,))
            h["active"], h["active_coverage"] = h["number"], coverage
        self.paths.clear()
        h.update(first_ms=None, due_ms=None, events=0, paths=0, full=None, periodic=False)

    def _add(self, h: dict, path: str, ts: int, known: dict[str, int]) -> None:
        old = known.get(path)
        if old is None:
            old = self.paths.getValue((path,))[0] if self.paths.containsKey((path,)) else None
            h["paths"] += old is None
        if old is None or ts < old:
            self.paths.updateValue((path,), (ts,))
            old = ts
        known[path] = old

    def _requeue(self, h: dict, ts: int, known: dict[str, int]) -> None:
        """Failed work joins what is pending; a newer change's quiet period holds, else it is retried at once."""
        if h["active_coverage"].startswith("full: "):
            h["full"] = h["full"] or h["active_coverage"]
        for (path,), (first,) in self.issued.iterator():
            self._add(h, path, first, known)
        h["first_ms"] = ts if h["first_ms"] is None else h["first_ms"]
        h["due_ms"] = ts if h["due_ms"] is None else h["due_ms"]

    def _due(self, h: dict, now: int) -> bool:
        return h["due_ms"] is not None and h["due_ms"] <= now and h["active"] is None

    # --- what Spark calls ----------------------------------------------------------------------------------------

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        h = self._load()
        out: list = []
        known: dict[str, int] = {}  # paths of the open batch met in this call
        arrived = pd.concat(list(rows)).sort_values("ts_ms", kind="stable")
        for ts, kind, path, invalidation, ticket in zip(*(arrived[c] for c in ("ts_ms", "kind", "path", "invalidation", "ticket")), strict=True):
            ts = int(ts)
            if self._due(h, ts):
                self._emit(h, out)
                known = {}
            h["seen_ms"] = max(h["seen_ms"] or ts, ts)
            if kind in (DONE, FAILED):
                if h["active"] is None or pd.isna(ticket) or int(ticket) != h["active"]:
                    continue  # of a ticket that is settled already
                if kind == FAILED:
                    self._requeue(h, ts, known)
                self.issued.clear()
                h["active"] = h["active_coverage"] = None
            else:
                h["first_ms"] = ts if h["first_ms"] is None else h["first_ms"]
                if kind == PERIODIC:
                    h["periodic"], h["due_ms"] = True, ts
                else:
                    h["due_ms"], h["events"] = max(h["due_ms"] or 0, ts + self.debounce_ms), h["events"] + 1
                    if not pd.isna(invalidation):
                        h["full"] = f"full: {invalidation}"
                    else:
                        self._add(h, path, ts, known)
            if kind != CHANGE and self._due(h, ts):
                self._emit(h, out)
                known = {}
        self._save(h, timerValues)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        h, now, out = self._load(), timerValues.getCurrentWatermarkInMs(), []
        if self._due(h, now):
            self._emit(h, out)
        idle = h["due_ms"] is None and h["active"] is None
        if idle and self.forget_ms is not None and (h["seen_ms"] or 0) + self.forget_ms <= now:
            self.head.clear(), self.paths.clear(), self.issued.clear()
        else:
            self._save(h, timerValues)
        yield self._frame(key, out)

    def _load(self) -> dict:
        if self.head.exists():
            return dict(zip(_HEAD_NAMES, self.head.get(), strict=True))
        return dict(zip(_HEAD_NAMES, (0, None, None, 0, 0, None, False, None, None, None), strict=True))

    def _save(self, h: dict, timerValues) -> None:
        self.head.update(tuple(h[n] for n in _HEAD_NAMES))
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        soon = timerValues.getCurrentWatermarkInMs() + 1
        if h["due_ms"] is not None and h["active"] is None:
            self.handle.registerTimer(max(h["due_ms"], soon))
        elif self.forget_ms is not None and h["seen_ms"] is not None and h["active"] is None:
            self.handle.registerTimer(max(h["seen_ms"] + self.forget_ms, soon))

    @staticmethod
    def _frame(key, out: list) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=[f.name for f in WORK][1:]).astype(object)
        frame.insert(0, "watch", [key[0]] * len(out))
        for f in WORK:
            frame[f.name] = frame[f.name].astype("Int64" if isinstance(f.dataType, T.LongType) else object)
        return frame


def work_stream(
    changes: DataFrame, policy: str = "balanced", debounce_ms: int = DEBOUNCE_MS, max_paths: int | None = MAX_PATHS,
    delay: str = "10 seconds", acknowledged: bool = False, forget_ms: int | None = None,
) -> DataFrame:
    """Work batches of live change streams with all their paths (rows of WORK), each emitted once it stays quiet.

    `changes` streams watch, ts_ms, kind, path, invalidation and ticket; `kind` is CHANGE, PERIODIC (a full check is asked for,
    which never replaces a stronger reason), or DONE / FAILED for `ticket`, a batch number. If `acknowledged`, the next batch of
    a watch waits for the result of the last one, and a failed one's paths or reason join what is pending; otherwise batches
    count as done, and equal those of `watch.debounced_batches` and `watch.batch_paths`.

    A path costs one state entry, written when it is new; nothing grows with the length of the stream. An idle watch is
    forgotten `forget_ms` after its last row, if that is given; its next change is a bootstrap again. Call `keyed_state` first.
    """
    timed = watermarked(changes, delay).select(
        F.col("watch").cast("string").alias("watch"), "ts_ms", F.coalesce("kind", F.lit(CHANGE)).alias("kind"), "path", "invalidation",
        F.col("ticket").cast("bigint").alias("ticket"), "event_time",
    )
    made = WorkProcessor(policy, debounce_ms, max_paths, acknowledged, forget_ms)
    return timed.groupBy("watch").transformWithStateInPandas(made, WORK, "Append", "EventTime")
