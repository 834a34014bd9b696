"""Run history, retained runs, versions: what is latest, what may be dropped, what can be restored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import cut_lineage, ranked_in_group, running_total, spread_lookup, with_global_index
from .chains import greedy_kept

DAY_MS = 86_400_000
# Fixed values: (minimum gap in seconds, applies while younger than this many seconds).
STAGGER_STEPS = [(30, 3600), (3600, 86_400), (86_400, 30 * 86_400), (7 * 86_400, 365 * 86_400)]


# --- run records ------------------------------------------------------------------------------------------


def recent_runs(records: DataFrame, limit: int, job: str | None = None, order: str = "line_no") -> DataFrame:
    """Newest first: by index line, or by time for merged histories. A bounded top-k."""
    out = records if job is None else records.where(F.col("job_name") == job)
    return out.orderBy(F.desc(order)).limit(limit)


def latest_by_job(records: DataFrame) -> DataFrame:
    """The last executed run of every registered job; compare-only runs and unbound jobs are skipped."""
    kept = records.where((F.col("kind") != "compare") & F.col("job_id").isNotNull())
    fields = F.struct(*[c for c in records.columns if c != "job_id"])
    return kept.groupBy("job_id").agg(F.max_by(fields, F.col("line_no")).alias("r")).select("job_id", "r.*")


def merged_history(index: DataFrame, summaries: DataFrame) -> DataFrame:
    """The index plus summaries of runs it does not know: those never finished."""
    known = index.where("run_id is not null").select("run_id").distinct()
    return index.unionByName(summaries.join(known, "run_id", "left_anti"), allowMissingColumns=True)


def orphan_artifacts(artifacts: DataFrame, records: DataFrame, cutoff_ms: int) -> DataFrame:
    """Artifact folders (run_id, ts_ms) older than the cutoff that no record names."""
    live = records.where("run_id is not null").select("run_id").distinct()
    return artifacts.where(F.col("ts_ms") < cutoff_ms).join(live, "run_id", "left_anti")


def run_summaries(rows: DataFrame) -> DataFrame:
    """One record per run: the last row written. A start row alone reads as unfinished, all skipped."""
    started = (F.col("stage") == "start")
    out = rows.withColumns(
        {
            "finished": ~started,
            "done": F.when(started, 0).otherwise(F.col("done")).cast("bigint"),
            "skipped": F.when(started, F.col("planned")).otherwise(F.col("skipped")).cast("bigint"),
        }
    )
    fields = F.struct("finished", "done", "skipped", "ts_ms")
    return out.groupBy("run_id").agg(F.max_by(fields, F.struct(F.col("finished"), F.col("ts_ms"))).alias("r")).select("run_id", "r.*")


def run_tally(events: DataFrame) -> DataFrame:
    """Warnings are warn logs; errors are error logs and error events."""
    log = F.col("kind") == "log"
    return events.groupBy("run_id").agg(
        F.count_if(log & (F.col("level") == "warn")).alias("warnings"),
        F.count_if((log & (F.col("level") == "error")) | (F.col("kind") == "error")).alias("errors"),
    )


def outcome_ledger(items: DataFrame) -> DataFrame:
    """Per run: items done, kept, failed, cancelled, bytes and time, and the slowest item."""
    o = F.col("outcome")
    return items.groupBy("run_id").agg(
        F.count_if(o == "ok").alias("done"), F.count_if(o == "kept").alias("skipped"), F.count_if(o == "failed").alias("errors"),
        F.count_if(o == "cancelled").alias("cancelled"), F.sum(F.when(o == "ok", F.col("bytes")).otherwise(0)).cast("bigint").alias("bytes_done"),
        F.sum("ms").cast("bigint").alias("busy_ms"), F.max_by("path", F.struct("ms", "seq")).alias("slowest_path"),
    )


def fault_list(events: DataFrame, keep: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(total per run, distinct faults per run by first occurrence; `keep` limits them to the first). Walk errors are summarised elsewhere and ignored."""
    faults = events.where((F.col("kind") == "error") & (F.col("action") != "walk"))
    total = faults.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"))
    first = faults.groupBy("run_id", "path", "action", "message").agg(
        F.min("seq").alias("seq"), F.min_by("side", "seq").alias("side")
    )
    kept = ranked_in_group(first, ["run_id"], ["seq", "path", "action", "message"], "position")
    kept = kept if keep is None else kept.where(F.col("position") <= keep)
    return total, kept.select("run_id", "position", "path", "action", "side", "message", "seq")


# --- retention ------------------------------------------------------------------------------------------------


def stagger_removals(runs: DataFrame, groups: list[str], now_s: int) -> DataFrame:
    """(groups, at_s) of run seconds the thinning rule names for removal.

    Walking old to new, a run goes when it follows the last kept one by less than the step of its age, and
    anything past the last step's age goes at once. The walk is a chain over slots of a day (`chains.greedy_kept`), so no
    array or task holds a store.
    """
    oldest = STAGGER_STEPS[-1][1]
    counted = cut_lineage(runs.groupBy(*groups, "at_s").agg(F.count(F.lit(1)).alias("_n")))
    steps = " ".join(f"WHEN {now_s} - at_s < {end} THEN {gap}" for gap, end in STAGGER_STEPS)
    recent = counted.where(now_s - F.col("at_s") <= oldest)
    kept = greedy_kept(recent, groups, "at_s", F.expr(f"CASE {steps} ELSE {oldest} END"), width=86_400).withColumn("_kept", F.lit(True))
    judged = counted.join(kept, [*groups, "at_s"], "left")
    # Of several runs in one kept second, one is still named: only the first stands for the second.
    return judged.where(F.col("_kept").isNull() | (F.col("_n") > 1)).select(*groups, "at_s")


def retained_run_stats(files: DataFrame, groups: list[str]) -> DataFrame:
    """Files and bytes per retained run."""
    return files.groupBy(*groups, "run_id", "at_ms").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").cast("bigint").alias("bytes")
    )


def retention_plan(
    runs: DataFrame, groups: list[str], now_ms: int, keep_days: int = 30, max_bytes: int = 10 * 1024**3, staggered: bool = True
) -> DataFrame:
    """Runs of every store with `drop`: too old, thinned out, or over the size cap; the newest always stays.

    `runs` has groups, run_id, at_ms, bytes. Over the cap, the oldest surviving runs go first.
    """
    runs = cut_lineage(runs)  # read by the thinning, the totals and the running sums
    marked = runs.withColumns(
        {
            "at_s": F.floor(F.col("at_ms") / 1000).cast("bigint"),
            "_aged": F.lit(keep_days > 0) & (F.col("at_ms") < now_ms - keep_days * DAY_MS),
        }
    )
    if staggered:
        first = marked.groupBy(*groups, "at_s").agg(F.min(F.struct("at_ms", "run_id")).alias("_f"))
        thinned = stagger_removals(marked, groups, now_ms // 1000).join(first, [*groups, "at_s"]).select(
            *groups, F.col("_f.run_id").alias("run_id"), F.lit(True).alias("_t")
        )
        marked = marked.join(thinned, [*groups, "run_id"], "left").withColumn("_thin", F.coalesce("_t", F.lit(False))).drop("_t")
    else:
        marked = marked.withColumn("_thin", F.lit(False))
    doomed = F.col("_aged") | F.col("_thin")
    alive = F.when(doomed, F.lit(0).cast("bigint")).otherwise(F.col("bytes"))
    totals = marked.groupBy(*groups).agg(
        F.sum(alive).alias("_total"), F.max(F.struct("at_ms", "run_id"))["run_id"].alias("_newest")
    )
    placed = spread_lookup(running_total(marked, groups, ["at_ms", "run_id"], alive, "_before"), totals, groups, "inner")
    over = F.lit(max_bytes > 0) & (F.col("_total") - F.col("_before") > max_bytes)
    stays = F.col("run_id") == F.col("_newest")
    return placed.withColumn("drop", (doomed | over) & ~stays).select(*runs.columns, "drop")


def retention_totals(plan: DataFrame, groups: list[str]) -> DataFrame:
    return plan.groupBy(*groups).agg(
        F.count_if("drop").alias("runs_dropped"), F.sum(F.when(F.col("drop"), F.col("bytes")).otherwise(0)).cast("bigint").alias("bytes_freed"),
        F.count_if(~F.col("drop")).alias("runs_kept"),
    )


def log_retention(records: DataFrame, groups: list[str], now_ms: int, keep_days: int, max_total_mb: int) -> DataFrame:
    """Run-log records with `drop`: past the age limit, then over the size cap in file order.

    Only records that own detail files can be dropped for size. `records` has line_no, ts_ms, artifact_kind, bytes.
    """
    aged = F.lit(keep_days > 0) & (F.col("ts_ms") < now_ms - keep_days * DAY_MS)
    droppable = F.col("artifact_kind").isin("directory", "legacy_file")
    alive = F.when(aged, F.lit(0).cast("bigint")).otherwise(F.col("bytes"))
    freed = F.when(~aged & droppable, F.col("bytes")).otherwise(F.lit(0).cast("bigint"))
    totals = records.groupBy(*groups).agg(F.sum(alive).alias("_total"))
    placed = running_total(records, groups, ["line_no"], freed, "_freed").join(totals, groups)
    over = F.col("_total") - F.col("_freed") > max_total_mb * 1024 * 1024
    return placed.withColumn("drop", aged | (F.lit(max_total_mb > 0) & droppable & over)).drop("_total", "_freed")


def stale_versions(versions: DataFrame, groups: list[str], keep: int) -> DataFrame:
    """Versions beyond the newest `keep`; equal times keep the later index line."""
    newest = Window.partitionBy(*groups).orderBy(F.desc("ts_ms"), F.desc("line_no"))
    kept = versions.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep)
    return versions.join(kept.select(*groups, "line_no"), [*groups, "line_no"], "left_anti")


def version_index(entries: DataFrame) -> DataFrame:
    """Index row per version: operations, preserved files and their bytes."""
    return entries.groupBy("version_id").agg(
        F.count(F.lit(1)).alias("ops"), F.count_if("preserved").alias("preserved"),
        F.sum(F.when(F.col("preserved"), F.col("size")).otherwise(0)).cast("bigint").alias("bytes"),
    )


def duplicate_versions(index: DataFrame) -> DataFrame:
    return index.groupBy("version_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


# --- finding and restoring -----------------------------------------------------------------------------------


def find_retained(files: DataFrame, needle: str) -> DataFrame:
    """Retained files whose path contains the text, any case; order by `at_ms` descending to list newest first."""
    return files if not needle else files.where(F.contains(F.lower("path"), F.lit(needle.lower())))


def restore_plan(found: DataFrame, present: DataFrame, run_id: str | None = None) -> DataFrame:
    """The newest hit per path, with `restore` or `skip` (a file is already at the destination)."""
    hits = found if run_id is None else found.where(F.col("run_id") == run_id)
    newest = hits.groupBy("path").agg(
        F.max_by(F.struct("run_id", "at_ms", "size"), F.struct("at_ms", "run_id")).alias("r")
    ).select("path", "r.*")
    there = present.select("path", F.lit(True).alias("_there")).distinct()
    return newest.join(there, "path", "left").select(
        "path", "run_id", "at_ms", "size", F.when(F.col("_there"), "skip").otherwise("restore").alias("decision")
    )


def version_restore(manifest: DataFrame, current: DataFrame, version_id: str | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Entries of a version with their verdict. A patch needs the current content to equal its base digest."""
    entries = manifest if version_id is None else manifest.where(F.col("version_id") == version_id)
    if wanted is not None:
        entries = entries.join(wanted.select("path").distinct(), "path", "left_semi")
    now = current.select("path", F.col("digest").alias("current_digest"))
    verdict = (
        F.when(F.col("kind") == "whole", "restore")
        .when(F.col("current_digest").isNull(), "base missing")
        .when(F.col("current_digest") != F.col("base_digest"), "base changed")
        .otherwise("restore")
    )
    return entries.join(now, "path", "left").withColumn("verdict", verdict)


def latest_results(results: DataFrame) -> DataFrame:
    """The newest published compare result per (job, target, revision)."""
    fields = F.struct(*[c for c in results.columns if c not in ("job_id", "target_index", "revision")])
    return results.groupBy("job_id", "target_index", "revision").agg(
        F.max_by(fields, F.col("sequence")).alias("r")
    ).select("job_id", "target_index", "revision", "r.*")


def numbered_lines(df: DataFrame, order: list[Column], name: str = "line_no") -> DataFrame:
    """Give rows of a table the line numbers a file written in this order would have."""
    return with_global_index(df, order, name)
