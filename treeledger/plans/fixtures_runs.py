"""Run records, run events, file changes and chunked files derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .fixtures import table

NOW_MS = 997_000_000_000  # 2001-08-05T08:26:40Z, just after the last order


def run_records(spark, sf) -> DataFrame:
    """One run per order: its job is the customer, its time the order date plus a fixed spread."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    job = F.col("o_custkey") % 50
    kind = F.when(F.col("o_orderpriority") == "5-LOW", "compare").otherwise("apply")
    return o.select(
        key.alias("line_no"), F.concat(F.lit("job-"), job.cast("string")).alias("job_name"),
        F.when(job % 7 != 0, F.concat(F.lit("id-"), job.cast("string"))).alias("job_id"), kind.alias("kind"),
        (text.epoch_ms("o_orderdate") + (key * 37 % 86_400) * 1000).alias("ts_ms"), F.round("o_totalprice").cast("bigint").alias("bytes"),
        (F.col("o_orderstatus") != "P").alias("finished"), F.concat(F.lit("run-"), key.cast("string")).alias("run_id"),
        (key % 3 == 0).alias("cancelled"), (key % 100).alias("done"), (key % 4).alias("errors"), (key % 5).alias("warnings"),
        F.when(kind == "compare", key % 77).alias("ops_found"),
        F.when(kind == "compare", "summary_only").when(key % 2 == 0, "directory").otherwise("legacy_file").alias("artifact_kind"),
    )


RUNS_SQL = """
runs AS (
  SELECT o_orderkey AS line_no, 'job-' || o_custkey % 50 AS job_name, CASE WHEN o_custkey % 50 % 7 <> 0 THEN 'id-' || o_custkey % 50 END AS job_id,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'compare' ELSE 'apply' END AS kind,
         epoch_us(o_orderdate) // 1000 + (o_orderkey * 37 % 86400) * 1000 AS ts_ms, CAST(round(o_totalprice) AS BIGINT) AS bytes,
         o_orderstatus <> 'P' AS finished, 'run-' || o_orderkey AS run_id, o_orderkey % 3 = 0 AS cancelled, o_orderkey % 100 AS done,
         o_orderkey % 4 AS errors, o_orderkey % 5 AS warnings,
         CASE WHEN o_orderpriority = '5-LOW' THEN o_orderkey % 77 END AS ops_found,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'summary_only' WHEN o_orderkey % 2 = 0 THEN 'directory' ELSE 'legacy_file' END AS artifact_kind
  FROM orders
)
"""


def run_events(spark, sf) -> DataFrame:
    """Run events: one run per user, kinds by event type and id."""
    e = table(spark, sf, "events")
    i = F.col("event_id")
    kind = (
        F.when(i % 40 == 0, "phase_start").when(i % 40 == 39, "phase_end").when(i % 40 == 20, "totals")
        .when(i % 97 == 1, "paused").when(i % 97 == 2, "resumed").when(F.col("event_type") == "error", "error")
        .when(F.col("event_type") == "purchase", "item_result").when(F.col("event_type") == "signup", "log").otherwise("progress")
    )
    e = e.select("*", kind.alias("kind"), text.epoch_ms("ts").alias("ms"), F.round(F.col("value") * 100).cast("bigint").alias("amount"))
    k = F.col("kind")
    counted = k.isin("phase_start", "totals", "progress", "phase_end")
    done = k.isin("totals", "progress", "phase_end")
    faulty = k.isin("error", "item_result")
    return e.select(
        F.concat(F.lit("run-"), (F.col("user_id") % 50).cast("string")).alias("run_id"), i.alias("seq"), "kind",
        F.when(counted | (k == "error"), F.concat(F.lit("phase-"), (i % 3).cast("string"))).alias("phase"), F.col("ms").alias("ts_ms"),
        F.when((k == "phase_start") & (i % 80 == 0), F.concat(F.lit("stage "), i.cast("string"))).alias("label"),
        F.when(done & ~((k == "phase_end") & (i % 80 == 39)), i % 1000).alias("items_done"), F.when(counted, 500 + i % 700).alias("items_total"),
        F.when(done, F.col("amount")).alias("bytes_done"), F.when(counted, F.col("amount") + 5000).alias("bytes_total"),
        F.when(faulty, F.concat(F.lit("dir/f"), (i % 13).cast("string"))).alias("path"),
        F.when(faulty, F.when(i % 11 == 0, "walk").otherwise("copy")).alias("action"), F.when(faulty, F.when(i % 2 == 0, "source").otherwise("target")).alias("side"),
        F.when(k == "log", F.element_at(F.array(F.lit("info"), F.lit("warn"), F.lit("error")), (i % 3 + 1).cast("int"))).alias("level"),
        F.when(k == "log", "scan").alias("scope"), F.when(k.isin("log", "error"), F.concat(F.lit("m"), (i % 5).cast("string"))).alias("message"),
        F.when(k == "item_result", F.element_at(F.array(F.lit("ok"), F.lit("ok"), F.lit("kept"), F.lit("failed"), F.lit("cancelled")), (i % 5 + 1).cast("int"))).alias("outcome"),
        F.when(k == "item_result", F.col("amount")).alias("bytes"), F.when(k == "item_result", i % 300).alias("ms"),
        F.when(k == "phase_end", F.element_at(F.array(F.lit("completed"), F.lit("failed"), F.lit("cancelled")), (F.col("user_id") % 3 + 1).cast("int"))).alias("status"),
        F.when(k == "resumed", i % 5000).alias("paused_ms"),
    )


EVENTS_SQL = """
raw_events AS (
  SELECT *, epoch_us(ts) // 1000 AS ms0, CAST(round(value * 100) AS BIGINT) AS amount,
    CASE WHEN event_id % 40 = 0 THEN 'phase_start' WHEN event_id % 40 = 39 THEN 'phase_end' WHEN event_id % 40 = 20 THEN 'totals'
         WHEN event_id % 97 = 1 THEN 'paused' WHEN event_id % 97 = 2 THEN 'resumed' WHEN event_type = 'error' THEN 'error'
         WHEN event_type = 'purchase' THEN 'item_result' WHEN event_type = 'signup' THEN 'log' ELSE 'progress' END AS kind
  FROM events
),
ev AS (
  SELECT 'run-' || user_id % 50 AS run_id, event_id AS seq, kind,
    CASE WHEN kind IN ('phase_start', 'totals', 'progress', 'phase_end', 'error') THEN 'phase-' || event_id % 3 END AS phase, ms0 AS ts_ms,
    CASE WHEN kind = 'phase_start' AND event_id % 80 = 0 THEN 'stage ' || event_id END AS label,
    CASE WHEN kind IN ('totals', 'progress') OR (kind = 'phase_end' AND event_id % 80 <> 39) THEN event_id % 1000 END AS items_done,
    CASE WHEN kind IN ('phase_start', 'totals', 'progress', 'phase_end') THEN 500 + event_id % 700 END AS items_total,
    CASE WHEN kind IN ('totals', 'progress', 'phase_end') THEN amount END AS bytes_done,
    CASE WHEN kind IN ('phase_start', 'totals', 'progress', 'phase_end') THEN amount + 5000 END AS bytes_total,
    CASE WHEN kind IN ('error', 'item_result') THEN 'dir/f' || event_id % 13 END AS path,
    CASE WHEN kind IN ('error', 'item_result') THEN CASE WHEN event_id % 11 = 0 THEN 'walk' ELSE 'copy' END END AS action,
    CASE WHEN kind IN ('error', 'item_result') THEN CASE WHEN event_id % 2 = 0 THEN 'source' ELSE 'target' END END AS side,
    CASE WHEN kind = 'log' THEN ['info', 'warn', 'error'][event_id % 3 + 1] END AS level, CASE WHEN kind = 'log' THEN 'scan' END AS scope,
    CASE WHEN kind IN ('log', 'error') THEN 'm' || event_id % 5 END AS message,
    CASE WHEN kind = 'item_result' THEN ['ok', 'ok', 'kept', 'failed', 'cancelled'][event_id % 5 + 1] END AS outcome,
    CASE WHEN kind = 'item_result' THEN amount END AS bytes, CASE WHEN kind = 'item_result' THEN event_id % 300 END AS ms,
    CASE WHEN kind = 'phase_end' THEN ['completed', 'failed', 'cancelled'][user_id % 3 + 1] END AS status,
    CASE WHEN kind = 'resumed' THEN event_id % 5000 END AS paused_ms
  FROM raw_events
)
"""


def retained_files(spark, sf) -> DataFrame:
    """Files kept by past runs: one per line item, the run is its order."""
    li = table(spark, sf, "lineitem")
    return li.select(
        (F.col("l_orderkey") % 40).alias("store"), F.col("l_orderkey").cast("string").alias("run_id"),
        (F.lit(NOW_MS) - F.col("l_orderkey") * 2_100_000 % (400 * 86_400_000) - 1).alias("at_ms"),
        F.concat(F.lit("Part/P"), F.col("l_partkey").cast("string")).alias("path"), F.round("l_extendedprice").cast("bigint").alias("size"),
        F.col("l_linenumber").alias("n"), (F.col("l_quantity") > 10).alias("preserved"), F.col("l_returnflag").alias("flag"),
    )


FILES_SQL = f"""
kept AS (
  SELECT l_orderkey % 40 AS store, CAST(l_orderkey AS VARCHAR) AS run_id, {NOW_MS} - l_orderkey * 2100000 % {400 * 86_400_000} - 1 AS at_ms,
         'Part/P' || l_partkey AS path, CAST(round(l_extendedprice) AS BIGINT) AS size, l_quantity > 10 AS preserved, l_returnflag AS flag
  FROM lineitem
)
"""


def file_changes(spark, sf) -> DataFrame:
    """Changed paths per watched root; time is compressed so that neighbours fall into one batch."""
    e = table(spark, sf, "events")
    return e.select(
        (F.col("user_id") % 5).alias("watch"), F.floor(text.epoch_ms("ts") / 1000).alias("ts_ms"),
        F.concat_ws("/", F.col("user_id").cast("string"), (F.col("event_id") % 40).cast("string")).alias("path"),
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 29 == 0), "kernel_dropped").alias("invalidation"),
    )


CHANGES_SQL = """
changes AS (
  SELECT user_id % 5 AS watch, epoch_us(ts) // 1000000 AS ts_ms, user_id || '/' || event_id % 40 AS path,
         CASE WHEN event_type = 'error' AND event_id % 29 = 0 THEN 'kernel_dropped' END AS invalidation
  FROM events
)
"""


def raw_watch_events(spark, sf) -> DataFrame:
    """Watcher rows: ids grow with the event, wrap or fall back now and then."""
    e = table(spark, sf, "events")
    i = F.col("event_id")
    return e.select(
        F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("stream"), i.alias("seq"), text.epoch_ms("ts").alias("ts_ms"),
        F.when(i % 37 == 0, 0).when(i % 211 == 0, i - 150).otherwise(i + 10).alias("event_id"),
        F.when(i % 53 == 0, "/vol/root/").when(i % 59 == 0, "/vol/other/x").otherwise(F.concat(F.lit("vol/root/u"), F.col("user_id").cast("string"), F.lit("/f"), (i % 40).cast("string"))).alias("device_path"),
        (i % 997 == 5).alias("wrapped"), (i % 1000 == 0).alias("history_done"), (i % 301 == 0).alias("user_dropped"),
        (i % 307 == 0).alias("kernel_dropped"), (i % 43 == 0).alias("must_scan"), (i % 991 == 0).alias("root_changed"), (i % 983 == 0).alias("unmounted"),
    )
