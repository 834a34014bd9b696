"""File-change streams in batch form: raw event reduction, cursor continuity, debounced work batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import previous_value, running_total, spread_lookup

DEBOUNCE_MS = 2_000
# A limit on a batch's paths is the caller's wish; there is none by default.
MAX_PATHS = None
FULL_VERIFICATION = ["standard", "paranoid"]
# Raw flag column -> invalidation kind.
FLAG_KINDS = {
    "user_dropped": "user_dropped", "kernel_dropped": "kernel_dropped", "must_scan": "must_scan_subdirectories",
    "root_changed": "root_changed", "unmounted": "unmounted",
}


def device_path(path: Column) -> Column:
    """Without outer slashes, `./` prefix, or a lone dot."""
    trimmed = F.regexp_replace(path, "^/+|/+$", "")
    return F.when(trimmed == ".", F.lit("")).otherwise(F.regexp_replace(trimmed, r"^\./", ""))


def path_relation(root: Column, event: Column) -> Column:
    """struct(relation, path): descendant with its relative path, root, or outside."""
    r, e = device_path(root), device_path(event)
    below = F.when(r == "", e).otherwise(e.substr(F.length(r) + 2, F.length(e)))
    relation = (
        F.when(e == r, "root").when(r == "", "descendant")
        .when(F.startswith(e, F.concat(r, F.lit("/"))), F.when(below == "", "root").otherwise("descendant"))
        .otherwise("outside")
    )
    return F.struct(relation.alias("relation"), F.when(relation == "descendant", below).alias("path"))


def reduce_raw_events(events: DataFrame, seeds: DataFrame, slice_ms: int | None = None) -> DataFrame:
    """Raw watcher rows with epoch number, relation to the root, changed path and invalidations.

    `events`: stream, seq, ts_ms, event_id, device_path, wrapped, history_done and the flag columns.
    `seeds`: stream, root, event_id (the stored cursor); a stream without one begins at its first id, below the empty root.
    A wrapped or regressed id opens a new epoch.

    The running maximum of ids restarts at a reset, so a reset is a wrapped row or an id below the largest
    one since the last reset. Zero ids carry no position. The last positioned id before a row decides a plain regression: after
    a reset the cursor equals the row's id, and otherwise it is the largest id so far, which the previous positioned row reached
    unless it regressed itself and thereby became a reset. So two scans over range partitions of (stream, seq) do: the last
    positioned id, then the number of resets. A stream of any length is spread over tasks; `slice_ms` is no longer needed.
    """
    known = seeds.groupBy("stream").agg(F.max_by(F.struct("root", "event_id"), F.struct("event_id", "root")).alias("_seed"))
    e = spread_lookup(events, known, ["stream"]).withColumns({"root": F.coalesce("_seed.root", F.lit("")), "seed_id": F.col("_seed.event_id")})
    positioned = F.when(F.col("wrapped") | (F.col("event_id") != 0), F.col("event_id"))
    behind = F.coalesce(F.col("event_id") < F.coalesce("_before", "seed_id"), F.lit(False))
    marked = previous_value(e.drop("_seed"), ["stream"], ["seq"], positioned, "_before").withColumn(
        "reset", F.col("wrapped") | ((F.col("event_id") != 0) & behind)
    )
    counted = running_total(marked, ["stream"], ["seq"], F.col("reset").cast("bigint"), "_opened")
    relation = path_relation(F.col("root"), F.col("device_path"))
    kinds = [F.when(F.col("reset"), F.lit("event_ids_wrapped"))]
    for flag, kind in FLAG_KINDS.items():
        hit = F.col(flag)
        if flag == "must_scan":
            hit = hit & ~F.col("user_dropped") & ~F.col("kernel_dropped")
        kinds.append(F.when(hit, F.lit(kind)))
    live = ~F.col("history_done")
    kinds.append(F.when(live & (F.col("_rel.relation") == "root"), F.lit("whole_root_changed")))
    kinds.append(F.when(live & (F.col("_rel.relation") == "outside"), F.lit("path_outside_root")))
    return (
        counted.withColumn("_rel", relation)
        .select(
            "stream", "seq", "ts_ms", "event_id", (F.col("_opened") + F.col("reset").cast("bigint")).alias("epoch"),
            F.when(live, F.col("_rel.path")).alias("path"), F.array_compact(F.array(*kinds)).alias("invalidations"),
        )
    )


def safe_change(path: Column) -> Column:
    """Whether a changed path is a usable relative path."""
    return (
        (path != "") & ~F.startswith(path, F.lit("/")) & (F.instr(path, "\\") == 0) & (F.substring(path, 2, 1) != ":")
        & ~F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))
    )


def cursor_breaks(positions: DataFrame, slice_ms: int | None = None) -> DataFrame:
    """Positions (watch, stream, seq, ts_ms, journal, epoch, event_id) with `follows`: continues its predecessor.

    The predecessor comes from a scan over range partitions of (watch, stream, seq); `slice_ms` is no longer needed.
    """
    now = F.struct("journal", "epoch", "event_id")
    joined = previous_value(positions, ["watch", "stream"], ["seq"], now, "_old")
    follows = (
        F.col("_old.journal").eqNullSafe(F.col("journal")) & (F.col("_old.epoch") == F.col("epoch"))
        & (F.col("event_id") >= F.col("_old.event_id"))
    )
    return joined.withColumn("follows", F.col("_old").isNull() | F.coalesce(follows, F.lit(False))).drop("_old")


def _numbered(changes: DataFrame, watch: list[str], debounce_ms: int) -> DataFrame:
    """`changes` with the number of their work batch: a change opens one if it comes `debounce_ms` or more after the one before.

    Only distinct times are scanned, over range partitions of (watch, time), so no watch is sorted in one task.
    """
    times = previous_value(changes.select(*watch, "ts_ms").distinct(), watch, ["ts_ms"], F.col("ts_ms"), "_prev")
    opens = F.col("_prev").isNull() | (F.col("ts_ms") - F.col("_prev") >= debounce_ms)
    counted = running_total(times.withColumn("_opens", opens.cast("bigint")), watch, ["ts_ms"], F.col("_opens"), "_base")
    batches = counted.select(*watch, "ts_ms", (F.col("_base") + F.col("_opens")).alias("batch"))
    return spread_lookup(changes, batches, [*watch, "ts_ms"], "inner")


def batch_paths(changes: DataFrame, watch: list[str], debounce_ms: int = DEBOUNCE_MS, slice_ms: int | None = None) -> DataFrame:
    """(watch, batch, path, ts_ms): every changed path of a work batch once, with its first change."""
    numbered = _numbered(changes, watch, debounce_ms).where("invalidation is null")
    return numbered.groupBy(*watch, "batch", "path").agg(F.min("ts_ms").alias("ts_ms"))


def debounced_batches(
    changes: DataFrame, watch: list[str], policy: str = "balanced", debounce_ms: int = DEBOUNCE_MS, max_paths: int | None = MAX_PATHS,
    slice_ms: int | None = None,
) -> DataFrame:
    """Work batches: changes gathered until it stays quiet, with the coverage each batch needs.

    `changes` has ts_ms, path, and `invalidation` (null for plain changes). A batch is due `debounce_ms`
    after its last change; a change exactly at that deadline already belongs to the next one. The first
    batch of a watch is the bootstrap scan. No watch is sorted in one task, and `slice_ms` is no longer needed.
    """
    numbered = _numbered(changes, watch, debounce_ms)
    paths = numbered.where("invalidation is null").groupBy(*watch, "batch", "path").agg(F.min("ts_ms").alias("ts_ms"))
    sizes = paths.groupBy(*watch, "batch").agg(F.count(F.lit(1)).alias("paths"))
    spans = numbered.groupBy(*watch, "batch").agg(
        F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count(F.lit(1)).alias("events"),
        F.max_by("invalidation", F.when(F.col("invalidation").isNotNull(), F.struct("ts_ms", "invalidation"))).alias("invalidation"),
    )
    joined = spans.join(sizes, [*watch, "batch"], "left").withColumn("paths", F.coalesce("paths", F.lit(0)).cast("bigint"))
    return joined.select(
        *watch, "batch", "first_ms", (F.col("last_ms") + debounce_ms).alias("due_ms"), "events", "paths",
        coverage(F.col("batch") == 1, F.col("invalidation"), F.col("paths"), F.lit(policy), max_paths).alias("coverage"),
    )


def coverage(bootstrap: Column, invalidation: Column, paths: Column, policy: Column, max_paths: int | None = MAX_PATHS) -> Column:
    """What a work batch must scan: bootstrap, then latched full reasons, then policy, else only its paths."""
    crowded = F.lit(False) if max_paths is None else paths > max_paths
    return (
        F.when(bootstrap, "full: bootstrap")
        .when(invalidation.isNotNull(), F.concat(F.lit("full: "), invalidation))
        .when(crowded, F.lit(f"full: more than {max_paths} changes"))
        .when(policy.isin(FULL_VERIFICATION), F.concat(F.lit("full: evidence policy "), policy))
        .otherwise("incremental")
    )


def periodic_coverage(batches: DataFrame, watch: list[str], interval_ms: int) -> DataFrame:
    """Work batches with periodic verification: the first batch due in each interval of the clock scans everything.

    A request never replaces a stronger reason: batches that are full already, by a discontinuity or otherwise,
    keep theirs.
    """
    tick = F.floor(F.col("due_ms") / interval_ms)
    first = batches.groupBy(*watch, tick.alias("_tick")).agg(F.min("batch").alias("batch")).select(*watch, "batch", F.lit(True).alias("_first"))
    asked = F.coalesce("_first", F.lit(False)) & ~F.startswith("coverage", F.lit("full"))
    marked = batches.join(first, [*watch, "batch"], "left")
    return marked.withColumn("coverage", F.when(asked, "full: periodic").otherwise(F.col("coverage"))).select(*batches.columns)


def requeue(pending: DataFrame, failed: DataFrame) -> DataFrame:
    """Work of failed tickets joins what is still pending, once per path."""
    return pending.unionByName(failed, allowMissingColumns=True).dropDuplicates()
