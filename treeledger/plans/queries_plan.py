"""Registered queries over plans: evidence, statistics, run scope, roll-ups, review and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rows, text
from ..operators import evidence, passes, stats, validate
from . import fixtures as fx
from .compare import compare, plan_header
from .registry import query


def effective(spark, sf):
    """The reviewed plan with reversals applied."""
    return rows.apply_reversals(fx.review_plan(spark, sf))


def plan_sql(select: str, *more: str) -> str:
    return fx.with_sql(fx.PLAN_SQL, *more, select=select)


@query(
    "row_rules",
    plan_sql(
        """SELECT op_index, side, action, size, mtime_ms, reason, result_type, owner, transfer, row_size, row_ms,
        CASE WHEN src_ms - dst_ms > 2000 THEN 's' WHEN dst_ms - src_ms > 2000 THEN 't' WHEN src_ms IS NOT NULL AND dst_ms IS NOT NULL THEN '' ELSE '' END AS newer,
        CASE WHEN action = 'copy' AND side = 'target' THEN path WHEN action = 'copy' THEN NULL
             WHEN action = 'move' AND side = 'target' THEN path WHEN action = 'move' THEN coalesce(from_path, path)
             WHEN action IN ('delete', 'delete_dir') AND side = 'target' THEN NULL ELSE path END AS source_path,
        CASE WHEN action = 'copy' AND side = 'target' THEN NULL WHEN action = 'copy' THEN path
             WHEN action = 'move' AND side = 'target' THEN coalesce(from_path, path) WHEN action = 'move' THEN path
             WHEN action IN ('delete', 'delete_dir') AND side = 'source' THEN NULL ELSE path END AS target_path,
        action NOT IN ('conflict', 'note') AS executable
        FROM own"""
    ),
)
def row_rules(spark, sf):
    side = rows.side_paths()
    return effective(spark, sf).select(
        "op_index", "side", "action", "size", "mtime_ms", "reason", rows.result_type().alias("result_type"),
        rows.owning_folder().alias("owner"), rows.transfer_bytes().alias("transfer"), rows.row_size().alias("row_size"),
        rows.row_modified().alias("row_ms"), rows.newer_side(2000).alias("newer"), side["source"].alias("source_path"),
        side["target"].alias("target_path"), rows.is_executable().alias("executable"),
    )


@query(
    "plan_stats",
    plan_sql(
        """SELECT side, count(*) FILTER (action = 'copy') AS copies, count(*) FILTER (action = 'update') AS updates,
        count(*) FILTER (action = 'delete') AS deletes, count(*) FILTER (action = 'delete_dir') AS delete_dirs,
        count(*) FILTER (action = 'move') AS moves,
        CAST(sum(CASE WHEN action IN ('copy', 'update') THEN coalesce(size, 0) ELSE 0 END) AS BIGINT) AS write_bytes,
        count(*) FILTER (action = 'conflict') AS conflicts FROM eff GROUP BY side"""
    ),
)
def plan_stats(spark, sf):
    return stats.side_stats(effective(spark, sf))


@query(
    "result_type_counts",
    plan_sql(
        """SELECT t.result_type, count(o.op_index) AS row_count
        FROM (SELECT unnest(['copy', 'update', 'move', 'delete', 'conflict', 'note']) AS result_type) t
        LEFT JOIN own o ON o.result_type = t.result_type GROUP BY t.result_type"""
    ),
)
def result_type_counts(spark, sf):
    return stats.count_by_result_type(effective(spark, sf))


@query(
    "delete_ratio_check",
    plan_sql(
        """SELECT 'warning' AS level, side || ': deletions planned: ' || d || ' of ' || n || ' entries (' ||
        CAST(round_even(d * 100.0 / n, 0) AS BIGINT) || '%), limit 10%. Look at the filters, the mounts and the order of the two sides before running it.' AS message
        FROM (SELECT side, count(*) FILTER (action = 'delete') AS d, (SELECT count(*) FROM orders) // (CASE side WHEN 'target' THEN 8 ELSE 200 END) AS n FROM eff GROUP BY side)
        WHERE d > 0 AND n > 0 AND d / n >= 0.1"""
    ),
)
def delete_ratio_check(spark, sf):
    n = fx.table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.floor(F.col("n") / k).alias("entries")) for s, k in (("target", 8), ("source", 200))])
    entries = n.select(F.explode(sides).alias("e")).select("e.*")
    return stats.delete_ratio_findings(
        stats.side_stats(effective(spark, sf)), entries, stats.Guards(max_delete_ratio=0.1)
    )


@query(
    "space_check",
    plan_sql(
        f"""SELECT CASE WHEN side = 'source' THEN 'warning' ELSE 'blocker' END AS level,
        CASE WHEN side = 'source' THEN 'source: free space unknown on /mnt/s'
        ELSE 'target: too little space on /mnt/t, writes take about ' || {fx.human_sql('w + w // 10')} || ' and a reserve of '
          || {fx.human_sql('w // 200')} || ', free are ' || {fx.human_sql('w')} END AS message
        FROM (SELECT side, sum(CASE WHEN action IN ('copy', 'update') THEN coalesce(size, 0) ELSE 0 END)::BIGINT AS w FROM eff GROUP BY side)"""
    ),
)
def space_check(spark, sf):
    """A target with exactly the planned bytes free, and a source that reports nothing."""
    per_side = stats.side_stats(effective(spark, sf))
    known = F.when(F.col("side") == "target", F.col("write_bytes"))
    capacity = per_side.select(
        "side", F.when(F.col("side") == "source", "/mnt/s").otherwise("/mnt/t").alias("display"),
        known.alias("available"), F.floor(known / 2).alias("total"),
    )
    return stats.space_findings(per_side, capacity, stats.Guards())


@query(
    "folder_rollup",
    plan_sql(
        """SELECT folder, sum(CASE WHEN folder = owner THEN 1 ELSE 0 END)::BIGINT AS direct_count,
        sum(CASE WHEN folder = owner THEN transfer ELSE 0 END)::BIGINT AS direct_transfer_bytes,
        sum(CASE WHEN folder = owner THEN deletion ELSE 0 END)::BIGINT AS direct_deletion_bytes,
        count(*) AS result_count, sum(transfer)::BIGINT AS transfer_bytes, sum(deletion)::BIGINT AS deletion_bytes,
        min(op_index) AS first_index, CASE WHEN folder = '' THEN 'Root Level' ELSE regexp_extract(folder, '[^/]*$') END AS label,
        (length(folder) - length(replace(folder, '/', '')))::INT AS depth
        FROM (SELECT *, unnest(CASE WHEN owner = '' THEN [''] ELSE list_transform(range(1, len(string_split(owner, '/')) + 1), lambda i: array_to_string(string_split(owner, '/')[1:i], '/')) END) AS folder FROM own)
        GROUP BY folder"""
    ),
)
def folder_rollup(spark, sf):
    return stats.folder_rollup(effective(spark, sf))


SCOPE = stats.ScopeFilter(
    result_types=("copy", "update", "delete"), search="F", folder="u7", minimum_mib=0.001, maximum_mib=0.2,
    modified_within_days=25.0, masks=("*/error/",),
)


@query(
    "run_scope",
    plan_sql(
        """SELECT op_index, action, path, row_size FROM own
        WHERE result_type IN ('copy', 'update', 'delete') AND (lower(path) LIKE '%f%' OR lower(reason) LIKE '%f%' OR lower(coalesce(from_path, '')) LIKE '%f%')
        AND (owner = 'u7' OR starts_with(owner, 'u7/')) AND row_size >= 0.001 * 1048576 AND row_size <= 0.2 * 1048576
        AND row_ms > 0 AND row_ms >= 1706700000000 - 25 * 86400000::BIGINT AND NOT upper(path) LIKE '%/ERROR/%'
        AND included AND action NOT IN ('conflict', 'note')"""
    ),
)
def run_scope(spark, sf):
    scoped = stats.in_scope(effective(spark, sf), SCOPE, fx.PLAN_MS)
    return stats.executable_in_scope(scoped).select("op_index", "action", "path", rows.row_size().alias("row_size"))


@query(
    "root_level_scope",
    plan_sql("SELECT op_index, side, action, path FROM own WHERE owner = ''"),
)
def root_level_scope(spark, sf):
    return stats.in_scope(effective(spark, sf), stats.ScopeFilter(folder=""), fx.PLAN_MS).select("op_index", "side", "action", "path")


@query(
    "review_totals",
    plan_sql(
        """SELECT count(*) FILTER (run AND action = 'copy') AS copy_count, count(*) FILTER (run AND action IN ('update', 'chmod')) AS update_count,
        count(*) FILTER (run AND action = 'move') AS move_count, count(*) FILTER (run AND action IN ('delete', 'delete_dir')) AS delete_count,
        coalesce(sum(transfer) FILTER (run), 0)::BIGINT AS transfer_bytes,
        coalesce(sum(coalesce(size, 0)) FILTER (run AND action IN ('delete', 'delete_dir')), 0)::BIGINT AS deletion_bytes,
        count(*) FILTER (run AND reversed) AS reversed_count,
        count(*) FILTER (included) - count(*) FILTER (run) AS checked_outside_scope,
        count(*) FILTER (run AND action = 'delete' AND side = 'target') AS target_deletes,
        count(*) FILTER (run AND action = 'delete' AND side = 'source') AS source_deletes,
        9000::BIGINT AS target_entries, 800::BIGINT AS source_entries
        FROM (SELECT *, included AND action NOT IN ('conflict', 'note') AND starts_with(path, 'u1') AS run FROM own)"""
    ),
)
def review_totals(spark, sf):
    run = F.col("included") & rows.is_executable() & F.startswith("path", F.lit("u1"))
    return stats.review_totals(effective(spark, sf), run, {"target": 9000, "source": 800})


@query(
    "flagged_deletions",
    plan_sql(
        """SELECT position, side, deletes, entries, CAST(floor(deletes * 100.0 / entries + 0.5) AS BIGINT) || '% of ' || side AS share FROM (
        SELECT 0 AS position, 'target' AS side, count(*) FILTER (action = 'delete' AND side = 'target' AND included) AS deletes, 3000::BIGINT AS entries FROM own
        UNION ALL SELECT 1, 'source', count(*) FILTER (action = 'delete' AND side = 'source' AND included), 800::BIGINT FROM own)
        WHERE deletes > 0 AND deletes / entries >= 0.05"""
    ),
)
def flagged_deletions(spark, sf):
    run = F.col("included") & rows.is_executable()
    totals = stats.review_totals(effective(spark, sf), run, {"target": 3000, "source": 800})
    return stats.flagged_deletion_sides(totals, 0.05)


@query(
    "selected_run_stats",
    plan_sql(
        """SELECT count(*) FILTER (action = 'copy') AS copy_count, count(*) FILTER (action IN ('update', 'chmod')) AS update_count,
        count(*) FILTER (action = 'move') AS move_count, count(*) FILTER (action IN ('delete', 'delete_dir')) AS delete_count,
        coalesce(sum(transfer), 0)::BIGINT AS transfer_bytes, count(*) FILTER (reversed) AS reversed_count
        FROM own WHERE included AND action NOT IN ('conflict', 'note')"""
    ),
)
def selected_run_stats(spark, sf):
    return stats.selected_run_stats(stats.executable_in_scope(effective(spark, sf)))


@query(
    "execution_order",
    plan_sql(
        """SELECT op_index, exec_class, row_number() OVER (ORDER BY exec_class,
          CASE WHEN action = 'delete_dir' THEN -(length(path) - length(replace(path, '/', ''))) ELSE 0 END, op_index) - 1 AS exec_index
        FROM (SELECT *, CASE action WHEN 'move' THEN 0 WHEN 'copy' THEN 1 WHEN 'update' THEN 2 WHEN 'chmod' THEN 3 WHEN 'delete' THEN 4 WHEN 'delete_dir' THEN 5 END AS exec_class FROM own)
        WHERE exec_class IS NOT NULL"""
    ),
)
def execution_order(spark, sf):
    return passes.execution_order(effective(spark, sf), delta=True).select("op_index", "exec_class", "exec_index")


@query(
    "review_export",
    plan_sql(
        """SELECT 1000000 - op_index AS position, CAST(included AS INT) AS included, action, side, path AS rel_path, CASE WHEN reversed THEN '' ELSE coalesce(from_path, '') END AS "from",
        CASE WHEN (action = 'copy' AND side = 'source') OR (action IN ('delete', 'delete_dir') AND side = 'target') THEN '' ELSE '/srv/a/' || CASE WHEN action = 'move' AND side = 'source' THEN from_path ELSE path END END AS source_path,
        CASE WHEN (action = 'copy' AND side = 'target') OR (action IN ('delete', 'delete_dir') AND side = 'source') THEN '' ELSE 'D:\\data\\' || replace(CASE WHEN action = 'move' AND side = 'target' THEN from_path ELSE path END, '/', '\\') END AS target_path,
        coalesce(CAST(src_size AS VARCHAR), '') AS src_size, coalesce(strftime(make_timestamp(src_ms // 1000 * 1000000), '%Y-%m-%dT%H:%M:%SZ'), '') AS src_mtime_utc,
        coalesce(CAST(dst_size AS VARCHAR), '') AS dst_size, coalesce(strftime(make_timestamp(dst_ms // 1000 * 1000000), '%Y-%m-%dT%H:%M:%SZ'), '') AS dst_mtime_utc, reason
        FROM own"""
    ),
)
def review_export(spark, sf):
    plan = fx.review_plan(spark, sf)
    wanted = plan.select((F.lit(1000000) - F.col("op_index")).alias("position"), "op_index", "reversed", "included")
    shown = evidence.presented_rows(plan.drop("reversed", "included"), wanted)
    return shown.select("position", *evidence.export_columns("/srv/a//", "D:\\data\\"))


@query(
    "reviewed_decisions",
    plan_sql(
        """SELECT op_index, side, action, path, size, reason FROM own WHERE included AND op_index % 7 < 4 AND action NOT IN ('conflict', 'note')"""
    ),
)
def reviewed_decisions(spark, sf):
    plan = fx.review_plan(spark, sf)
    chosen = plan.where(F.col("included") & (F.col("op_index") % 7 < 4)).select("op_index", "reversed")
    return evidence.decided_operations(plan.drop("reversed", "included"), chosen).select(
        "op_index", "side", "action", "path", "size", "reason"
    )


@query(
    "decision_faults",
    plan_sql(
        """SELECT d.op_index, CASE WHEN d.times > 1 THEN 'duplicate decision' WHEN p.op_index IS NULL THEN 'unknown row'
          WHEN p.action IN ('conflict', 'note') THEN 'reports are not executable'
          WHEN d.rev AND p.action NOT IN ('copy', 'delete', 'update') THEN 'row cannot be reversed' END AS fault
        FROM (SELECT op_index, count(*) AS times, bool_or(rev) AS rev FROM (
            SELECT CASE WHEN event_id % 100 = 3 THEN event_id + 100000000 WHEN event_id % 100 = 5 THEN event_id - 1 ELSE event_id END AS op_index, event_id % 6 = 0 AS rev FROM events)
          GROUP BY op_index) d
        LEFT JOIN full_plan p ON p.op_index = d.op_index
        WHERE d.times > 1 OR p.op_index IS NULL OR p.action IN ('conflict', 'note') OR (d.rev AND p.action NOT IN ('copy', 'delete', 'update'))"""
    ),
)
def decision_faults(spark, sf):
    i = F.col("event_id")
    decisions = fx.table(spark, sf, "events").select(
        F.when(i % 100 == 3, i + 100000000).when(i % 100 == 5, i - 1).otherwise(i).alias("op_index"),
        (i % 6 == 0).alias("reversed"),
    )
    return evidence.decision_faults(fx.review_plan(spark, sf).drop("reversed", "included"), decisions)


@query(
    "directory_outcomes",
    plan_sql(
        """SELECT w.folder, CASE WHEN coalesce(bool_and(l.deletable), true) THEN 'removed' ELSE 'kept' END AS outcome, count(l.path) AS leftover_count,
        CASE WHEN NOT bool_and(l.deletable) THEN array_to_string(list_sort(list(l.path))[1:5], ' | ') END AS samples
        FROM (SELECT DISTINCT path AS folder FROM eff WHERE action = 'delete_dir') w
        LEFT JOIN (SELECT path, op_index % 8 <> 2 AS deletable FROM eff WHERE action <> 'delete_dir' AND op_index % 11 = 0) l
          ON starts_with(l.path, w.folder || '/') GROUP BY w.folder"""
    ),
)
def directory_outcomes(spark, sf):
    plan = effective(spark, sf)
    left = plan.where((F.col("action") != "delete_dir") & (F.col("op_index") % 11 == 0)).select(
        "path", (F.col("op_index") % 8 != 2).alias("deletable")
    )
    return stats.directory_outcomes(plan.where("action = 'delete_dir'"), left)


@query(
    "scalar_formats",
    plan_sql(
        """SELECT op_index, regexp_replace(path, '/?[^/]*$', '') AS parent, base,
        (length(path) - length(replace(path, '/', '')))::INT AS depth,
        CASE WHEN amount < 1024 THEN amount || ' B' WHEN amount < 1048576 THEN round_even(amount / 1024.0, 1)::DECIMAL(18, 1) || ' KiB' ELSE round_even(amount / 1048576.0, 1)::DECIMAL(18, 1) || ' MiB' END AS human,
        printf('%.2f', amount / 1048576.0) || ' MiB/s' AS rate,
        strftime(make_timestamp(ms // 1000 * 1000000), '%Y%m%d-%H%M%S') AS stamp,
        CASE WHEN span // 3600000 > 0 THEN span // 3600000 || ':' || lpad(CAST(span // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(span // 1000 % 60 AS VARCHAR), 2, '0')
          ELSE span // 60000 || ':' || lpad(CAST(span // 1000 % 60 AS VARCHAR), 2, '0') END AS duration,
        CASE WHEN age < 60000 THEN 'just now' WHEN age < 3600000 THEN age // 60000 || ' min ago' WHEN age < 86400000 THEN age // 3600000 || ' h ago' ELSE age // 86400000 || ' d ago' END AS ago,
        CASE WHEN late // 60000 < 60 THEN late // 60000 || 'm ago' WHEN late // 60000 < 2880 THEN late // 3600000 || 'h ago' ELSE late // 86400000 || 'd ago' END AS age,
        regexp_replace(path, '[^/]*$', '') || left(base, length(base) - length(ext)) || '.sync-conflict-' || strftime(make_timestamp(ms // 1000 * 1000000), '%Y%m%d-%H%M%S') || '-nas-01' || ext AS kept
        FROM (SELECT *, regexp_extract(base, '^.+(\\.[^.]*)$', 1) AS ext, greatest(amount, 0) AS span, greatest(age, 0) AS late FROM (
          SELECT p.op_index, p.path, regexp_extract(p.path, '[^/]*$') AS base, e.ms, e.amount, 1706700000000 - e.ms AS age FROM plan p JOIN ev2 e ON e.event_id = p.op_index))"""
    ),
)
def scalar_formats(spark, sf):
    """Every format of every plan row: files, folders and root-level names, also of negative amounts and times ahead."""
    e = fx.table(spark, sf, "events").select(
        F.col("event_id").alias("op_index"), text.epoch_ms("ts").alias("ms"), F.round(F.col("value") * 1000).cast("bigint").alias("amount")
    )
    return fx.review_plan(spark, sf).select("op_index", "path").join(e, "op_index").select(
        "op_index", text.parent("path").alias("parent"), text.base_name("path").alias("base"), text.depth("path").alias("depth"),
        text.human_bytes("amount").alias("human"), text.human_rate("amount").alias("rate"), text.stamp_compact("ms").alias("stamp"),
        text.human_duration("amount").alias("duration"), text.relative_time("ms", fx.PLAN_MS).alias("ago"),
        text.relative_age("ms", fx.PLAN_MS).alias("age"), text.conflict_name("path", F.lit("nas.01"), F.col("ms")).alias("kept"),
    )


@query(
    "preflight_verdict",
    fx.with_sql(
        fx.BASE_SQL,
        fx.MIRROR_OPS_SQL,
        select="""SELECT level, message FROM (
          SELECT 'warning' AS level, 'source: 1 unread areas, not compared and not changed on either side: src3/en. Compare again once they can be read.' AS message
          UNION ALL SELECT 'warning', 'target: deletions planned: ' || d || ' of ' || n || ' entries (' || CAST(round_even(d * 100.0 / n, 0) AS BIGINT) || '%), limit 1%. Look at the filters, the mounts and the order of the two sides before running it.'
            FROM (SELECT (SELECT count(*) FROM ops WHERE action = 'delete') AS d, (SELECT count(*) FROM tgt_all) AS n) WHERE d / n >= 0.01
          UNION ALL SELECT 'blocker', 'target: too little space on /mnt/t, writes take about ' || need || ' and a reserve of 0 B, free are 0 B'
            FROM (SELECT """
        + fx.human_sql("w + w // 10")
        + """ AS need FROM (SELECT sum(size)::BIGINT AS w FROM ops WHERE action IN ('copy', 'update')))
          UNION ALL SELECT 'verdict', 'attended_ok=false unattended_ok=false')""",
    ),
)
def preflight_verdict(spark, sf):
    """All safety checks of a mirror plan, and whether it may run."""
    source, target, _ = fx.inventories(spark, sf)
    made = compare(source, target, "mirror")
    head = plan_header(made, fx.PLAN_MS)
    per_side = stats.side_stats(made.operations())
    entries = head.select(
        F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_entries").alias("entries")) for s in ("source", "target")])).alias("e")
    ).select("e.*")
    zero = F.lit(0).cast("bigint")
    capacity = per_side.select("side", F.lit("/mnt/t").alias("display"), zero.alias("available"), zero.alias("total"))
    guards = stats.Guards(max_delete_ratio=0.01)
    v = stats.verdict(
        [stats.scan_findings(head), stats.delete_ratio_findings(per_side, entries, guards), stats.space_findings(per_side, capacity, guards)]
    )
    listed = lambda c, level: F.transform(c, lambda m: F.struct(F.lit(level).alias("level"), m.alias("message")))
    outcome = F.concat(F.lit("attended_ok="), F.col("attended_ok").cast("string"), F.lit(" unattended_ok="), F.col("unattended_ok").cast("string"))
    every = F.concat(listed(F.col("blockers"), "blocker"), listed(F.col("warnings"), "warning"), F.array(F.struct(F.lit("verdict").alias("level"), outcome.alias("message"))))
    return v.select(F.explode(every).alias("f")).select("f.*")


@query(
    "header_attestation",
    fx.with_sql(
        fx.BASE_SQL,
        select="""SELECT 'stated value differs' AS rule, subject, detail FROM (
          SELECT 'target_entries' AS subject, (SELECT count(*) + 1 FROM tgt_all) || ' vs ' || (SELECT count(*) FROM tgt_all) AS detail
          UNION ALL SELECT 'source_unread_entries', '0 vs ' || ((SELECT count(*) FROM src_all) - (SELECT count(*) FROM src)))""",
    ),
)
def header_attestation(spark, sf):
    """A stored plan header with two wrong facts, checked against the header recomputed from both inventories."""
    source, target, _ = fx.inventories(spark, sf)
    actual = plan_header(compare(source, target, "enrich"), fx.PLAN_MS)
    stated = actual.withColumns({"target_entries": F.col("target_entries") + 1, "source_unread_entries": F.lit(0).cast("bigint")})
    return validate.attestation_faults(stated, actual)
