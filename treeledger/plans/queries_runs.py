"""Registered queries over run history, retention, run events and file-change streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rows, text
from ..operators import history, progress, watch
from ..sources import runs
from . import fixtures as fx
from . import fixtures_runs as fr
from .registry import query

DAY = 86_400_000


def runs_sql(select, *more):
    return fx.with_sql(fr.RUNS_SQL, *more, select=select)


def events_sql(select, *more):
    return fx.with_sql(fr.EVENTS_SQL, *more, select=select)


@query("history_newest", runs_sql("SELECT line_no, job_name, ts_ms, kind FROM runs WHERE job_name = 'job-3' ORDER BY line_no DESC LIMIT 40"))
def history_newest(spark, sf):
    return history.recent_runs(fr.run_records(spark, sf), 40, "job-3").select("line_no", "job_name", "ts_ms", "kind")


@query(
    "latest_run_by_job",
    runs_sql("SELECT job_id, arg_max(run_id, line_no) AS run_id, max(line_no) AS line_no FROM runs WHERE kind <> 'compare' AND job_id IS NOT NULL GROUP BY job_id"),
)
def latest_run_by_job(spark, sf):
    return history.latest_by_job(fr.run_records(spark, sf)).select("job_id", "run_id", "line_no")


@query(
    "merged_history",
    runs_sql("SELECT run_id, ts_ms, finished FROM runs WHERE line_no % 6 <> 0 UNION ALL SELECT run_id, ts_ms, false FROM runs WHERE line_no % 6 = 0 AND line_no % 4 = 0"),
)
def merged_history(spark, sf):
    """The index lacks some runs whose summaries still lie around: those were interrupted."""
    r = fr.run_records(spark, sf).select("run_id", "ts_ms", "finished", "line_no")
    summaries = r.where("line_no % 4 = 0").withColumn("finished", F.lit(False))
    return history.merged_history(r.where("line_no % 6 <> 0"), summaries).select("run_id", "ts_ms", "finished")


@query(
    "orphan_artifacts",
    runs_sql(f"SELECT run_id, ts_ms FROM runs WHERE line_no % 5 = 0 AND ts_ms < {fr.NOW_MS - 30 * DAY}"),
)
def orphan_artifacts(spark, sf):
    r = fr.run_records(spark, sf)
    return history.orphan_artifacts(r.select("run_id", "ts_ms"), r.where("line_no % 5 <> 0"), fr.NOW_MS - 30 * DAY)


@query(
    "run_labels",
    runs_sql(
        """SELECT run_id, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S') || '  ' || job_name || '  ' ||
        CASE WHEN ops_found IS NOT NULL THEN 'compare · ' || ops_found || ' found' ELSE done || ' items' ||
          CASE WHEN errors > 0 THEN ' · ' || errors || ' errors' ELSE '' END || CASE WHEN warnings > 0 THEN ' · ' || warnings || ' warnings' ELSE '' END ||
          CASE WHEN NOT finished THEN ' · ⚠ interrupted' WHEN cancelled THEN ' · cancelled' ELSE '' END END AS label FROM runs"""
    ),
)
def run_labels(spark, sf):
    return fr.run_records(spark, sf).select("run_id", rows.run_label().alias("label"))


@query(
    "run_summaries",
    runs_sql("SELECT run_id, finished, CASE WHEN finished THEN done ELSE 0 END AS done, CASE WHEN finished THEN errors ELSE done + errors END AS skipped FROM runs"),
)
def run_summaries(spark, sf):
    """Start rows for every run, end rows for those that finished."""
    r = fr.run_records(spark, sf).select("run_id", "ts_ms", "done", "errors", "finished")
    start = r.select("run_id", "ts_ms", F.lit("start").alias("stage"), (F.col("done") + F.col("errors")).alias("planned"), F.lit(None).cast("bigint").alias("done"), F.lit(None).cast("bigint").alias("skipped"))
    end = r.where("finished").select("run_id", (F.col("ts_ms") + 1000).alias("ts_ms"), F.lit("end").alias("stage"), F.lit(None).cast("bigint").alias("planned"), "done", F.col("errors").alias("skipped"))
    return history.run_summaries(start.unionByName(end)).select("run_id", "finished", "done", "skipped")


@query(
    "log_retention",
    runs_sql(
        f"""SELECT line_no, job_name, aged OR (artifact_kind <> 'summary_only' AND total - freed > 3000000) AS dropped FROM (
          SELECT *, sum(CASE WHEN aged THEN 0 ELSE bytes END) OVER (PARTITION BY job_name) AS total,
            coalesce(sum(CASE WHEN NOT aged AND artifact_kind <> 'summary_only' THEN bytes ELSE 0 END) OVER (PARTITION BY job_name ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed
          FROM (SELECT *, ts_ms < {fr.NOW_MS - 300 * DAY} AS aged FROM runs))"""
    ).replace("3000000", str(3 * 1024 * 1024)),
)
def log_retention(spark, sf):
    made = history.log_retention(fr.run_records(spark, sf), ["job_name"], fr.NOW_MS, 300, 3)
    return made.select("line_no", "job_name", F.col("drop").alias("dropped"))


STORES = """
store_runs AS (SELECT store, run_id, at_ms, sum(size)::BIGINT AS bytes, count(*) AS files FROM kept GROUP BY ALL),
seconds AS (SELECT store, at_s, count(*) AS n, row_number() OVER (PARTITION BY store ORDER BY at_s) AS i FROM (
  SELECT store, at_ms // 1000 AS at_s FROM store_runs) WHERE {now} - at_s <= 31536000 GROUP BY store, at_s),
thin AS (
  SELECT store, i, at_s AS last, at_s, true AS keeps FROM seconds WHERE i = 1
  UNION ALL
  SELECT store, i, CASE WHEN k THEN at_s ELSE last END, at_s, k FROM (
    SELECT s.store, s.i, s.at_s, t.last, s.at_s - t.last >= CASE WHEN {now} - s.at_s < 3600 THEN 30 WHEN {now} - s.at_s < 86400 THEN 3600
      WHEN {now} - s.at_s < 2592000 THEN 86400 WHEN {now} - s.at_s < 31536000 THEN 604800 ELSE 31536000 END AS k
    FROM thin t JOIN seconds s ON s.store = t.store AND s.i = t.i + 1) q
),
named AS (SELECT r.*, NOT coalesce(t.keeps, false) OR count(*) OVER (PARTITION BY r.store, r.at_ms // 1000) > 1 AS named_second,
  row_number() OVER (PARTITION BY r.store, r.at_ms // 1000 ORDER BY r.at_ms, r.run_id) = 1 AS first_of_second, row_number() OVER (PARTITION BY r.store ORDER BY at_ms DESC, run_id DESC) = 1 AS newest
  FROM store_runs r LEFT JOIN thin t ON t.store = r.store AND t.at_s = r.at_ms // 1000),
judged AS (SELECT *, named_second AND first_of_second AS thinned FROM named)
""".format(now=fr.NOW_MS // 1000)


def files_sql(select, *more):
    return fx.with_sql(fr.FILES_SQL, *more, select=select)


def _store_runs(spark, sf):
    return history.retained_run_stats(fr.retained_files(spark, sf), ["store"])


@query("retained_run_stats", files_sql("SELECT store, run_id, at_ms, count(*) AS files, sum(size)::BIGINT AS bytes FROM kept GROUP BY store, run_id, at_ms"))
def retained_run_stats(spark, sf):
    return _store_runs(spark, sf)


@query("staggered_removals", files_sql("SELECT DISTINCT store, at_ms // 1000 AS at_s FROM judged WHERE named_second", STORES))
def staggered_removals(spark, sf):
    r = _store_runs(spark, sf).withColumn("at_s", F.floor(F.col("at_ms") / 1000).cast("bigint"))
    return history.stagger_removals(r, ["store"], fr.NOW_MS // 1000)


@query(
    "retention_plan",
    files_sql(
        f"""SELECT store, run_id, at_ms, bytes, (doomed OR total - before > 4000000) AND NOT newest AS dropped FROM (
          SELECT *, sum(CASE WHEN doomed THEN 0 ELSE bytes END) OVER (PARTITION BY store) AS total,
            coalesce(sum(CASE WHEN doomed THEN 0 ELSE bytes END) OVER (PARTITION BY store ORDER BY at_ms, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM (SELECT *, thinned OR at_ms < {fr.NOW_MS - 200 * DAY} AS doomed FROM judged))""",
        STORES,
    ),
)
def retention_plan(spark, sf):
    made = history.retention_plan(_store_runs(spark, sf), ["store"], fr.NOW_MS, keep_days=200, max_bytes=4_000_000)
    return made.select("store", "run_id", "at_ms", "bytes", F.col("drop").alias("dropped"))


@query(
    "retention_totals",
    files_sql(
        f"""SELECT store, count(*) FILTER (dropped) AS runs_dropped, coalesce(sum(bytes) FILTER (dropped), 0)::BIGINT AS bytes_freed, count(*) FILTER (NOT dropped) AS runs_kept FROM (
        SELECT store, bytes, (doomed OR total - before > 4000000) AND NOT newest AS dropped FROM (
          SELECT *, sum(CASE WHEN doomed THEN 0 ELSE bytes END) OVER (PARTITION BY store) AS total,
            coalesce(sum(CASE WHEN doomed THEN 0 ELSE bytes END) OVER (PARTITION BY store ORDER BY at_ms, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM (SELECT *, thinned OR at_ms < {fr.NOW_MS - 200 * DAY} AS doomed FROM judged))) GROUP BY store""",
        STORES,
    ),
)
def retention_totals(spark, sf):
    """What a retention run frees in every store."""
    made = history.retention_plan(_store_runs(spark, sf), ["store"], fr.NOW_MS, keep_days=200, max_bytes=4_000_000)
    return history.retention_totals(made, ["store"])


@query(
    "find_retained",
    files_sql("SELECT DISTINCT run_id, at_ms, path FROM kept WHERE lower(path) LIKE '%part/p12%'"),
)
def find_retained(spark, sf):
    return history.find_retained(fr.retained_files(spark, sf), "part/P12").select("run_id", "at_ms", "path").distinct()


@query(
    "restore_plan",
    files_sql(
        """SELECT path, arg_max(run_id, (at_ms, run_id)) AS run_id, max(at_ms) AS at_ms, CASE WHEN 'Part/P' || CAST(substr(path, 7) AS BIGINT) // 3 * 3 = path THEN 'skip' ELSE 'restore' END AS decision
        FROM kept GROUP BY path"""
    ),
)
def restore_plan(spark, sf):
    present = fx.table(spark, sf, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("Part/P"), F.col("p_partkey").cast("string")).alias("path"))
    return history.restore_plan(fr.retained_files(spark, sf), present).select("path", "run_id", "at_ms", "decision")


@query(
    "version_index",
    files_sql("SELECT run_id AS version_id, count(*) AS ops, count(*) FILTER (preserved) AS preserved, sum(CASE WHEN preserved THEN size ELSE 0 END)::BIGINT AS bytes FROM kept GROUP BY run_id"),
)
def version_index(spark, sf):
    return history.version_index(fr.retained_files(spark, sf).withColumnRenamed("run_id", "version_id"))


@query(
    "stale_versions",
    runs_sql("SELECT job_name, run_id, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY job_name ORDER BY ts_ms DESC, line_no DESC) AS n FROM runs) WHERE n > 20"),
)
def stale_versions(spark, sf):
    return history.stale_versions(fr.run_records(spark, sf), ["job_name"], 20).select("job_name", "run_id", "ts_ms")


@query(
    "version_restore",
    files_sql(
        """SELECT run_id, path, CASE WHEN flag = 'A' THEN 'restore' WHEN p.k IS NULL THEN 'base missing' WHEN p.k % 4 = 1 THEN 'base changed' ELSE 'restore' END AS verdict
        FROM kept k LEFT JOIN (SELECT p_partkey AS k FROM part WHERE p_partkey % 7 <> 0) p ON 'Part/P' || p.k = k.path"""
    ),
)
def version_restore(spark, sf):
    f = fr.retained_files(spark, sf)
    manifest = f.select("run_id", "path", F.when(F.col("flag") == "A", "whole").otherwise("patch").alias("kind"), F.lit("base").alias("base_digest"), F.col("run_id").alias("version_id"))
    now = fx.table(spark, sf, "part").where("p_partkey % 7 <> 0").select(
        F.concat(F.lit("Part/P"), F.col("p_partkey").cast("string")).alias("path"), F.when(F.col("p_partkey") % 4 == 1, "other").otherwise("base").alias("digest")
    )
    return history.version_restore(manifest, now).select("run_id", "path", "verdict")


@query(
    "latest_results",
    runs_sql("SELECT job_name AS job_id, line_no % 3 AS target_index, 'r' || line_no % 2 AS revision, max(line_no) AS sequence, arg_max(run_id, line_no) AS run_id FROM runs GROUP BY 1, 2, 3"),
)
def latest_results(spark, sf):
    r = fr.run_records(spark, sf).select(
        F.col("job_name").alias("job_id"), (F.col("line_no") % 3).alias("target_index"), F.concat(F.lit("r"), (F.col("line_no") % 2).cast("string")).alias("revision"),
        F.col("line_no").alias("sequence"), "run_id",
    )
    return history.latest_results(r)


@query(
    "record_migration",
    runs_sql(
        """SELECT run_id, CASE WHEN job_id IS NULL THEN 'legacy_unbound' ELSE 'registered' END AS binding, CASE WHEN job_id IS NOT NULL THEN 0::BIGINT END AS target_index,
        CASE WHEN kind = 'compare' AND line_no % 8 IN (0, 1) THEN NULL WHEN kind = 'compare' THEN 'summary_only' WHEN line_no % 8 = 0 THEN 'directory' WHEN line_no % 8 = 1 THEN 'legacy_file' ELSE 'unavailable' END AS artifacts,
        CASE WHEN kind = 'compare' AND line_no % 8 IN (0, 1) THEN 'compare record unexpectedly names detail artifacts' END AS fault
        FROM runs"""
    ),
)
def record_migration(spark, sf):
    r = fr.run_records(spark, sf)
    legacy = r.select(
        F.col("job_name").alias("job"), F.col("run_id").alias("record_id"), "ts_ms", "kind", "done", F.lit(0).alias("skipped"), "errors", "bytes",
        F.lit(1).alias("elapsed_ms"), "cancelled", "warnings", "ops_found", "finished",
        F.when(F.col("line_no") % 8 == 0, F.col("run_id")).alias("run_id"), F.when(F.col("line_no") % 8 == 1, F.lit("d.jsonl")).alias("detail"),
    )
    jobs = r.where("job_id is not null").select("job_name", "job_id").distinct()
    return runs.migrate_run_records(legacy, jobs).select(
        F.col("record_id").alias("run_id"), F.col("subject.binding.kind").alias("binding"), F.col("subject.target_index").alias("target_index"),
        F.col("artifacts.kind").alias("artifacts"), "fault",
    )


# --- events ----------------------------------------------------------------------------------------------------


@query(
    "run_tally",
    events_sql("SELECT run_id, count(*) FILTER (kind = 'log' AND level = 'warn') AS warnings, count(*) FILTER ((kind = 'log' AND level = 'error') OR kind = 'error') AS errors FROM ev GROUP BY run_id"),
)
def run_tally(spark, sf):
    return history.run_tally(fr.run_events(spark, sf))


@query(
    "outcome_ledger",
    events_sql(
        """SELECT run_id, count(*) FILTER (outcome = 'ok') AS done, count(*) FILTER (outcome = 'kept') AS skipped, count(*) FILTER (outcome = 'failed') AS errors,
        count(*) FILTER (outcome = 'cancelled') AS cancelled, coalesce(sum(bytes) FILTER (outcome = 'ok'), 0)::BIGINT AS bytes_done, sum(ms)::BIGINT AS busy_ms,
        arg_max(path, ms * 100000000 + seq) AS slowest_path FROM ev WHERE kind = 'item_result' GROUP BY run_id"""
    ),
)
def outcome_ledger(spark, sf):
    return history.outcome_ledger(fr.run_events(spark, sf).where("kind = 'item_result'"))


@query(
    "fault_list",
    events_sql(
        """SELECT * FROM (SELECT run_id, path, action, side, message, row_number() OVER (PARTITION BY run_id ORDER BY seq, path, action, message) AS position FROM (
          SELECT run_id, path, action, message, min(seq) AS seq, arg_min(side, seq) AS side FROM ev WHERE kind = 'error' AND action <> 'walk' GROUP BY run_id, path, action, message))"""
    ),
)
def fault_list(spark, sf):
    return history.fault_list(fr.run_events(spark, sf))[1].select("run_id", "position", "path", "action", "side", "message")


@query(
    "event_routing",
    events_sql(
        """SELECT run_id, artifact, count(*) AS lines FROM (SELECT run_id, unnest(CASE WHEN kind = 'progress' OR (kind = 'log' AND level = 'info') THEN [] WHEN kind = 'item_result' THEN ['items']
          WHEN kind IN ('error', 'log') THEN ['run', 'errors'] ELSE ['run'] END) AS artifact FROM ev) GROUP BY run_id, artifact"""
    ),
)
def event_routing(spark, sf):
    return runs.routed(fr.run_events(spark, sf), "warn").groupBy("run_id", "artifact").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "log_lines",
    events_sql(
        f"""SELECT seq, CASE WHEN seq % 50 = 7 OR kind = 'progress' OR (kind = 'phase_end' AND items_done IS NULL) THEN 0 ELSE ts_ms END AS ts_ms,
        CASE WHEN seq % 50 = 7 THEN 'info' WHEN kind = 'progress' OR (kind = 'phase_end' AND items_done IS NULL) THEN 'error' WHEN kind = 'log' THEN level WHEN kind = 'error' THEN 'error' WHEN kind = 'item_result' THEN CASE outcome WHEN 'failed' THEN 'error' WHEN 'ok' THEN 'info' ELSE 'warn' END
             WHEN kind = 'phase_end' AND status = 'failed' THEN 'error' ELSE 'info' END AS level,
        CASE WHEN seq % 50 = 7 THEN 'legacy' WHEN kind = 'progress' OR (kind = 'phase_end' AND items_done IS NULL) THEN 'parse' WHEN kind = 'log' THEN scope WHEN kind = 'error' THEN phase WHEN kind = 'item_result' THEN side WHEN kind IN ('paused', 'resumed') THEN 'control' ELSE 'phase' END AS scope,
        CASE WHEN seq % 50 = 7 THEN 'plain ' || seq WHEN kind = 'progress' THEN 'Malformed JSON log record: unsupported event kind or value ''progress'''
             WHEN kind = 'phase_end' AND items_done IS NULL THEN 'Malformed JSON log record: missing ''items_done''' WHEN kind = 'log' THEN message WHEN kind = 'error' THEN action || ' ' || path || ' (' || side || '): ' || message
             WHEN kind = 'item_result' THEN CASE outcome WHEN 'ok' THEN '✓ ok' WHEN 'failed' THEN '✗ failed' WHEN 'kept' THEN '⊘ kept' ELSE '■ not run' END || '  ' || action || ' ' || path || '  ' || {fx.human_sql('bytes')} || CASE WHEN ms > 0 THEN ' · ' || ms || 'ms' ELSE '' END
             WHEN kind = 'phase_start' THEN '▶ ' || phase || CASE WHEN label IS NOT NULL THEN '  ' || label ELSE '' END
             WHEN kind = 'totals' THEN 'Totals · ' || phase || ' · ' || items_total || ' items · ' || {fx.human_sql('bytes_total')}
             WHEN kind = 'phase_end' THEN CASE status WHEN 'completed' THEN '✓' WHEN 'failed' THEN '✕' ELSE '■' END || ' ' || phase || ' · ' || status
             WHEN kind = 'paused' THEN 'Paused' ELSE 'Resumed after ' || paused_ms // 60000 || ':' || lpad(CAST(paused_ms // 1000 % 60 AS VARCHAR), 2, '0') END AS message
        FROM ev"""
    ),
)
def log_lines(spark, sf):
    """Events written as JSON lines (some as plain text) and read back through the line normaliser."""
    e = fr.run_events(spark, sf)
    fields = [c for c in e.columns if c not in ("run_id", "seq")]
    body = F.to_json(F.struct(*fields, F.when(F.col("kind") == "totals", F.lit(True)).alias("reset")))
    line = F.when(F.col("seq") % 50 == 7, F.concat(F.lit("plain "), F.col("seq").cast("string"))).otherwise(body)
    return runs.parse_log_lines(e.select("seq", line.alias("line")), "run").select("seq", "ts_ms", "level", "scope", "message")


STAGES_SQL = """
st AS (SELECT * FROM ev WHERE kind IN ('phase_start', 'totals', 'progress', 'phase_end')),
facts AS (SELECT run_id, phase, max(seq) FILTER (kind = 'phase_start') AS s, max(seq) FILTER (kind = 'phase_end') AS e, arg_max(status, seq) FILTER (kind = 'phase_end') AS status,
  max(seq) FILTER (kind = 'phase_start' AND label IS NOT NULL) AS l, arg_max(label, seq) FILTER (kind = 'phase_start' AND label IS NOT NULL) AS label,
  max(seq) FILTER (kind = 'progress') AS p, max(seq) FILTER (kind IN ('phase_start', 'totals', 'phase_end')) AS any_set,
  max(seq) FILTER (kind IN ('phase_start', 'totals') OR (kind = 'phase_end' AND items_done IS NOT NULL)) AS idone_set
  FROM st GROUP BY run_id, phase)
"""


@query(
    "stage_states",
    events_sql(
        """SELECT f.run_id, f.phase,
        greatest(max(CASE WHEN seq = idone_set THEN CASE WHEN kind = 'phase_start' THEN 0 ELSE items_done END WHEN kind = 'progress' AND seq > coalesce(idone_set, -1) THEN items_done END), 0) AS items_done,
        greatest(max(CASE WHEN seq = any_set THEN items_total WHEN kind = 'progress' AND seq > coalesce(any_set, -1) THEN items_total END), 0) AS items_total,
        greatest(max(CASE WHEN seq = any_set THEN CASE WHEN kind = 'phase_start' THEN 0 ELSE bytes_done END WHEN kind = 'progress' AND seq > coalesce(any_set, -1) THEN bytes_done END), 0) AS bytes_done,
        greatest(max(CASE WHEN seq = any_set THEN bytes_total WHEN kind = 'progress' AND seq > coalesce(any_set, -1) THEN bytes_total END), 0) AS bytes_total,
        CASE WHEN p > coalesce(l, -1) THEN '' ELSE coalesce(any_value(f.label), '') END AS label,
        NOT coalesce(e > coalesce(s, -1), false) AS active, coalesce(e > coalesce(s, -1) AND any_value(f.status) = 'completed', false) AS done,
        coalesce(e > coalesce(s, -1) AND any_value(f.status) = 'failed', false) AS failed, coalesce(e > coalesce(s, -1) AND any_value(f.status) = 'cancelled', false) AS cancelled
        FROM facts f JOIN st ON st.run_id = f.run_id AND st.phase = f.phase GROUP BY f.run_id, f.phase, s, e, l, p, idone_set, any_set""",
        STAGES_SQL,
    ),
)
def stage_states(spark, sf):
    return progress.stage_states(fr.run_events(spark, sf), ["run_id"])


RATE_SQL = """
begun AS (SELECT run_id, min(ts_ms) AS t0 FROM ev GROUP BY run_id),
sample AS (SELECT e.*, e.ts_ms - b.t0 - coalesce((SELECT sum(r.paused_ms) FROM ev r WHERE r.run_id = e.run_id AND r.kind = 'resumed' AND r.ts_ms <= e.ts_ms), 0)::BIGINT AS active_ms
  FROM ev e JOIN begun b ON b.run_id = e.run_id WHERE e.kind = 'progress'),
latest AS (SELECT * FROM sample QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY active_ms DESC, seq DESC) = 1),
based AS (SELECT s.run_id, s.active_ms, s.bytes_done, s.items_done FROM sample s JOIN latest l ON l.run_id = s.run_id
  QUALIFY row_number() OVER (PARTITION BY s.run_id ORDER BY CASE WHEN s.active_ms <= l.active_ms - 86400000 THEN 0 ELSE 1 END,
    CASE WHEN s.active_ms <= l.active_ms - 86400000 THEN -s.active_ms ELSE s.active_ms END, CASE WHEN s.active_ms <= l.active_ms - 86400000 THEN -s.seq ELSE s.seq END) = 1),
rated AS (SELECT l.*, CASE WHEN l.active_ms - b.active_ms >= 200 THEN (l.bytes_done - b.bytes_done) * 1000 / (l.active_ms - b.active_ms) END AS bps,
  CASE WHEN l.active_ms - b.active_ms >= 200 THEN (l.items_done - b.items_done) * 1000 / (l.active_ms - b.active_ms) END AS ips FROM latest l JOIN based b ON b.run_id = l.run_id)
"""


@query(
    "progress_rates",
    events_sql(
        """SELECT run_id, active_ms, bytes_done, items_done, round(bps, 6) AS bytes_per_second, round(ips, 6) AS items_per_second,
        least(99.0, floor((bytes_done + items_done) * 100 / (bytes_total + items_total)))::DOUBLE AS percent,
        (items_done >= items_total AND bytes_done >= bytes_total) OR bytes_done >= bytes_total AS finalizing FROM rated""",
        RATE_SQL,
    ),
)
def progress_rates(spark, sf):
    samples = progress.progress_samples(fr.run_events(spark, sf), ["run_id"])
    rated = progress.latest_rate(samples, ["run_id"], 86_400_000)
    shown = progress.completion(F.lit(True), F.lit(False))
    return rated.select(
        "run_id", "active_ms", "bytes_done", "items_done", F.round("bytes_per_second", 6).alias("bytes_per_second"),
        F.round("items_per_second", 6).alias("items_per_second"), shown["percent"].alias("percent"), shown["finalizing"].alias("finalizing"),
    )


@query(
    "active_elapsed",
    events_sql(
        """SELECT run_id, min(ts_ms) AS started_ms, coalesce(sum(paused_ms), 0)::BIGINT AS paused_ms,
        greatest(0, 1706700000000 - min(ts_ms) - coalesce(sum(paused_ms), 0) - CASE WHEN max(ts_ms) FILTER (kind = 'paused') > coalesce(max(ts_ms) FILTER (kind = 'resumed'), 0)
          THEN 1706700000000 - max(ts_ms) FILTER (kind = 'paused') ELSE 0 END)::BIGINT AS active_ms FROM ev GROUP BY run_id"""
    ),
)
def active_elapsed(spark, sf):
    return progress.active_elapsed(fr.run_events(spark, sf), ["run_id"], fx.PLAN_MS)


@query(
    "progress_throttle",
    events_sql(
        """SELECT run_id, phase, ts_ms, seq FROM walk WHERE keeps""",
        """ticks AS (SELECT 'run-' || CAST(substr(run_id, 5) AS INT) % 5 AS run_id, phase, ts_ms // 5000 AS ts_ms, min(seq) AS seq FROM ev WHERE kind = 'progress' GROUP BY 1, 2, 3),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY run_id, phase ORDER BY ts_ms) AS i FROM ticks),
        walk AS (SELECT run_id, phase, ts_ms, seq, i, ts_ms AS last, true AS keeps FROM numbered WHERE i = 1
          UNION ALL SELECT n.run_id, n.phase, n.ts_ms, n.seq, n.i, CASE WHEN n.ts_ms - w.last >= 100 THEN n.ts_ms ELSE w.last END, n.ts_ms - w.last >= 100
          FROM walk w JOIN numbered n ON n.run_id = w.run_id AND n.phase = w.phase AND n.i = w.i + 1)""",
    ),
)
def progress_throttle(spark, sf):
    """Progress rows that survive the spacing rule, on a five-second clock."""
    e = fr.run_events(spark, sf).withColumns(
        {"ts_ms": F.floor(F.col("ts_ms") / 5000), "run_id": F.concat(F.lit("run-"), (F.substring("run_id", 5, 9).cast("int") % 5).cast("string"))}
    )
    return progress.throttled(e, ["run_id"])


@query(
    "change_batches",
    fx.with_sql(
        fr.CHANGES_SQL,
        """gaps AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY watch ORDER BY ts_ms) < 900 THEN 0 ELSE 1 END AS opens FROM changes),
        batches AS (SELECT *, sum(opens) OVER (PARTITION BY watch ORDER BY ts_ms RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS batch FROM gaps)""",
        select="""SELECT watch, CAST(batch AS BIGINT) AS batch, min(ts_ms) AS first_ms, max(ts_ms) + 900 AS due_ms, count(*) AS events, count(DISTINCT path) FILTER (invalidation IS NULL) AS paths,
        CASE WHEN batch = 1 THEN 'full: bootstrap' WHEN max(invalidation) IS NOT NULL THEN 'full: ' || max(invalidation) WHEN count(DISTINCT path) FILTER (invalidation IS NULL) > 8 THEN 'full: more than 8 changes' ELSE 'incremental' END AS coverage
        FROM batches GROUP BY watch, batch""",
    ),
)
def change_batches(spark, sf):
    """Changes gathered until it stays quiet for fifteen minutes (on a one-second clock)."""
    return watch.debounced_batches(fr.file_changes(spark, sf), ["watch"], debounce_ms=900, max_paths=8, slice_ms=36_000)


@query(
    "periodic_coverage",
    fx.with_sql(
        fr.CHANGES_SQL,
        """gaps AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY watch ORDER BY ts_ms) < 900 THEN 0 ELSE 1 END AS opens FROM changes),
        batches AS (SELECT *, sum(opens) OVER (PARTITION BY watch ORDER BY ts_ms RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS batch FROM gaps),
        due AS (SELECT watch, CAST(batch AS BIGINT) AS batch, max(ts_ms) + 900 AS due_ms, CASE WHEN batch = 1 THEN 'full: bootstrap' WHEN max(invalidation) IS NOT NULL THEN 'full: ' || max(invalidation) ELSE 'incremental' END AS coverage
          FROM batches GROUP BY watch, batch)""",
        select="""SELECT watch, batch, due_ms, CASE WHEN coverage = 'incremental' AND row_number() OVER (PARTITION BY watch, due_ms // 86400 ORDER BY batch) = 1 THEN 'full: periodic' ELSE coverage END AS coverage FROM due""",
    ),
)
def periodic_coverage(spark, sf):
    """Change batches without a limit on paths, with a full verification in each interval."""
    made = watch.debounced_batches(fr.file_changes(spark, sf), ["watch"], debounce_ms=900, slice_ms=36_000)
    return watch.periodic_coverage(made, ["watch"], 86_400).select("watch", "batch", "due_ms", "coverage")


@query(
    "change_batch_paths",
    fx.with_sql(
        fr.CHANGES_SQL,
        """gaps AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY watch ORDER BY ts_ms) < 900 THEN 0 ELSE 1 END AS opens FROM changes),
        batches AS (SELECT *, sum(opens) OVER (PARTITION BY watch ORDER BY ts_ms RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS batch FROM gaps)""",
        select="SELECT watch, CAST(batch AS BIGINT) AS batch, path, min(ts_ms) AS ts_ms FROM batches WHERE invalidation IS NULL GROUP BY watch, batch, path",
    ),
)
def change_batch_paths(spark, sf):
    """Every path of every work batch, whatever their number."""
    return watch.batch_paths(fr.file_changes(spark, sf), ["watch"], debounce_ms=900, slice_ms=36_000)


@query(
    "cursor_breaks",
    """WITH p AS (SELECT 'w' || user_id % 3 AS watch, 's' || user_id % 6 AS stream, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms,
      CASE WHEN event_id % 401 = 0 THEN NULL ELSE 'j' END AS journal, 'e' || event_id // 3000 AS epoch, CASE WHEN event_id % 91 = 0 THEN event_id - 40 ELSE event_id END AS event_id FROM events),
    l AS (SELECT *, lag(seq) OVER w AS ps, lag(journal) OVER w AS pj, lag(epoch) OVER w AS pe, lag(event_id) OVER w AS pi FROM p WINDOW w AS (PARTITION BY watch, stream ORDER BY seq))
    SELECT watch, stream, seq, ps IS NULL OR (pj IS NOT DISTINCT FROM journal AND pe = epoch AND event_id >= pi) AS follows FROM l""",
)
def cursor_breaks(spark, sf):
    i = F.col("event_id")
    p = fx.table(spark, sf, "events").select(
        F.concat(F.lit("w"), (F.col("user_id") % 3).cast("string")).alias("watch"), F.concat(F.lit("s"), (F.col("user_id") % 6).cast("string")).alias("stream"),
        i.alias("seq"), text.epoch_ms("ts").alias("ts_ms"), F.when(i % 401 == 0, None).otherwise(F.lit("j")).alias("journal"),
        F.concat(F.lit("e"), F.floor(i / 3000).cast("string")).alias("epoch"), F.when(i % 91 == 0, i - 40).otherwise(i).alias("event_id"),
    )
    return watch.cursor_breaks(p).select("watch", "stream", "seq", "follows")


@query(
    "raw_event_reduction",
    """WITH r AS (SELECT 's' || user_id % 4 AS stream, event_id AS seq, CASE WHEN event_id % 37 = 0 THEN 0 WHEN event_id % 211 = 0 THEN event_id - 150 ELSE event_id + 10 END AS eid,
        event_id % 997 = 5 AS wrapped, event_id % 1000 = 0 AS hist, user_id, event_id FROM events),
      c AS (SELECT *, last_value(CASE WHEN wrapped OR eid <> 0 THEN eid END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r),
      d AS (SELECT *, wrapped OR (eid <> 0 AND eid < coalesce(prev, 5)) AS reset FROM c)
    SELECT stream, seq, CAST(sum(reset::INT) OVER (PARTITION BY stream ORDER BY seq) AS BIGINT) AS epoch,
      CASE WHEN hist OR event_id % 53 = 0 OR event_id % 59 = 0 THEN NULL ELSE 'u' || user_id || '/f' || event_id % 40 END AS path,
      concat_ws(',', CASE WHEN reset THEN 'event_ids_wrapped' END, CASE WHEN event_id % 301 = 0 THEN 'user_dropped' END, CASE WHEN event_id % 307 = 0 THEN 'kernel_dropped' END,
        CASE WHEN event_id % 43 = 0 AND event_id % 301 <> 0 AND event_id % 307 <> 0 THEN 'must_scan_subdirectories' END, CASE WHEN event_id % 991 = 0 THEN 'root_changed' END, CASE WHEN event_id % 983 = 0 THEN 'unmounted' END,
        CASE WHEN NOT hist AND event_id % 53 = 0 THEN 'whole_root_changed' END, CASE WHEN NOT hist AND event_id % 53 <> 0 AND event_id % 59 = 0 THEN 'path_outside_root' END) AS invalidations FROM d""",
)
def raw_event_reduction(spark, sf):
    raw = fr.raw_watch_events(spark, sf)
    seeds = raw.select("stream").distinct().select("stream", F.lit("vol/root").alias("root"), F.lit(5).alias("event_id"))
    return watch.reduce_raw_events(raw, seeds).select("stream", "seq", "epoch", "path", F.array_join("invalidations", ",").alias("invalidations"))
