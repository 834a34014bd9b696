"""Registered comparison queries."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..cluster import checkpoint_dir
from ..operators import pages
from ..operators.compare import Options, Sides
from ..operators.evidence import (
    attach_evidence, escalation_suspects, escalation_verdicts, identical_page, identical_pages, identical_totals,
)
from ..operators.inventory import Inventory, refresh_archive
from . import fixtures as fx
from .compare import compare, plan_header
from .registry import ORACLES, query

PLAN = ["op_index", "side", "action", "path", "from_path", "size", "mtime_ms", "hash", "reason"]
OPS_SELECT = "SELECT side, action, path, from_path, size, mtime_ms, hash, reason FROM ops"
PLAN_SELECT = (
    f"SELECT row_number() OVER (ORDER BY {fx.RANK_SQL}, path) - 1 AS op_index, side, action, path, from_path, size, "
    "mtime_ms, hash, reason FROM ops"
)


def _shown(df):
    return df.withColumnRenamed("from", "from_path")


@query("mirror_plan", fx.with_sql(fx.BASE_SQL, fx.MIRROR_OPS_SQL, select=PLAN_SELECT))
def mirror_plan(spark, sf):
    source, target, _ = fx.inventories(spark, sf)
    return _shown(compare(source, target, "mirror").plan()).select(*PLAN)


@query("sync_archive_plan", fx.with_sql(fx.BASE_SQL, fx.SYNC_OPS_SQL, select=OPS_SELECT))
def sync_archive_plan(spark, sf):
    source, target, archive = fx.inventories(spark, sf)
    return _shown(compare(source, target, "sync", archive=archive).ops).select(*PLAN[1:])


DIRS_SQL = """
s_dirs AS (SELECT DISTINCT upper(array_to_string(string_split(path, '/')[1:i], '/')) AS key
  FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS i FROM src_all)),
t_dirs AS (SELECT upper(path) AS key, min(path) AS path FROM (
  SELECT DISTINCT array_to_string(string_split(path, '/')[1:i], '/') AS path
  FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS i FROM tgt_all))
  GROUP BY upper(path)),
gone_dirs AS (SELECT path FROM t_dirs WHERE key NOT IN (SELECT key FROM s_dirs)
  AND key <> 'SRC3/EN' AND NOT starts_with(key, 'SRC3/EN/') AND NOT starts_with('SRC3/EN', key || '/'))
"""


@query(
    "mirror_folders",
    fx.with_sql(
        fx.BASE_SQL.replace("doc_id % 17 <> 0", "doc_id % 17 <> 0 AND lang <> 'fr'").replace("SELECT doc_id, text,", "SELECT doc_id, text, lang,"),
        DIRS_SQL,
        fx.MIRROR_OPS_SQL,
        select="SELECT side, action, path, reason FROM ops UNION ALL SELECT 'target', 'delete_dir', path, 'dir-gone-from-source' FROM gone_dirs",
    ),
)
def mirror_folders(spark, sf):
    """A whole mirror plan with folders: one language is missing on the source, one folder is unread."""
    source, target, _ = fx.inventories(spark, sf, folders=True)
    kept = source.entries.where(~F.col("path").rlike("(^|/)fr(/|$)"))
    return compare(Inventory(kept, source.header, source.unread), target, "mirror").operations().select("side", "action", "path", "reason")


@query(
    "enrich_plan",
    fx.with_sql(
        fx.BASE_SQL,
        select="""SELECT 'target' AS side, 'conflict' AS action, tp AS path, NULL::BIGINT AS size, NULL::BIGINT AS mtime_ms, NULL::VARCHAR AS hash,
          'evidence-unavailable (content unreadable on one side)' AS reason FROM pair WHERE hs AND ht AND unreadable
        UNION ALL SELECT 'target', 'update', tp, ss, sm, sd, 'source-newer' FROM pair WHERE hs AND ht AND NOT unreadable AND NOT eq AND sm > tm + 2000
        UNION ALL SELECT 'target', 'copy', sp, ss, sm, sd, 'only-in-source' FROM pair WHERE hs AND NOT ht""",
    ),
)
def enrich_plan(spark, sf):
    source, target, _ = fx.inventories(spark, sf)
    return compare(source, target, "enrich").operations().select("side", "action", "path", "size", "mtime_ms", "hash", "reason")


NO_ARCHIVE_SQL = """
SELECT 'target' AS side, 'conflict' AS action, sp AS path, NULL::VARCHAR AS from_path, NULL::BIGINT AS size, NULL::BIGINT AS mtime_ms, NULL::VARCHAR AS hash,
  'evidence-unavailable (content unreadable on one side)' AS reason FROM pair WHERE hs AND ht AND unreadable
UNION ALL {differ}
UNION ALL SELECT 'target', 'note', a.sp, o.tp, a.ss, NULL, NULL, 'possible-move-needs-archive'
  FROM pair a JOIN (SELECT td, max_by(tp, key) AS tp FROM pair WHERE ht AND NOT hs AND tk = 'full' GROUP BY td) o ON o.td = a.sd WHERE a.hs AND NOT a.ht
UNION ALL SELECT 'target', 'copy', sp, NULL, ss, sm, sd, 'only-in-source' FROM pair WHERE hs AND NOT ht
UNION ALL SELECT 'source', 'copy', tp, NULL, ts, tm, td, 'only-in-target' FROM pair WHERE ht AND NOT hs
"""


@query(
    "sync_without_archive",
    fx.with_sql(
        fx.BASE_SQL,
        select=NO_ARCHIVE_SQL.format(
            differ="SELECT 'target', 'conflict', sp, NULL, NULL, NULL, NULL, 'differs-no-archive' FROM pair WHERE hs AND ht AND NOT unreadable AND NOT eq"
        ),
    ),
)
def sync_without_archive(spark, sf):
    source, target, _ = fx.inventories(spark, sf)
    return _shown(compare(source, target, "sync").operations()).select(*PLAN[1:])


@query(
    "archive_other_tier",
    fx.with_sql(
        fx.BASE_SQL,
        select=NO_ARCHIVE_SQL.format(
            differ="SELECT 'target', 'conflict', sp, NULL, NULL, NULL, NULL, 'differs-no-archive' FROM pair WHERE hs AND ht AND NOT unreadable AND NOT eq"
        ),
    ),
)
def archive_other_tier(spark, sf):
    """An archive of another evidence tier counts as none."""
    source, target, archive = fx.inventories(spark, sf)
    archive = replace(archive, header=replace(archive.header, evidence="sampled"))
    return _shown(compare(source, target, "sync", archive=archive).operations()).select(*PLAN[1:])


@query(
    "sync_newer_wins",
    fx.with_sql(
        fx.BASE_SQL,
        select=NO_ARCHIVE_SQL.format(
            differ="""SELECT CASE WHEN sm >= tm THEN 'target' ELSE 'source' END, 'update', CASE WHEN sm >= tm THEN tp ELSE sp END, NULL,
              CASE WHEN sm >= tm THEN ss ELSE ts END, CASE WHEN sm >= tm THEN sm ELSE tm END, CASE WHEN sm >= tm THEN sd ELSE td END, 'differs-newer-wins'
              FROM pair WHERE hs AND ht AND NOT unreadable AND NOT eq"""
        ),
    ),
)
def sync_newer_wins(spark, sf):
    source, target, _ = fx.inventories(spark, sf)
    return _shown(compare(source, target, "sync", resolve_newer=True).operations()).select(*PLAN[1:])


NOW_MS = 1_706_700_000_000


@query(
    "conflict_copies",
    fx.with_sql(
        fx.BASE_SQL,
        """won AS (
          SELECT *, sm > tm OR (sm = tm) AS s_wins FROM pair WHERE hs AND ht AND NOT unreadable AND NOT eq
        ),
        lost AS (
          SELECT CASE WHEN s_wins THEN 'target' ELSE 'source' END AS side, CASE WHEN s_wins THEN tp ELSE sp END AS lp,
            CASE WHEN s_wins THEN ts ELSE ss END AS ls, CASE WHEN s_wins THEN tm ELSE sm END AS lm, CASE WHEN s_wins THEN td ELSE sd END AS ld,
            CASE WHEN s_wins THEN ss ELSE ts END AS ws, CASE WHEN s_wins THEN sm ELSE tm END AS wm, CASE WHEN s_wins THEN sd ELSE td END AS wd,
            CASE WHEN s_wins THEN 'beta' ELSE 'alpha' END AS lh, sp FROM won
        )""",
        select=NO_ARCHIVE_SQL.format(
            differ="""SELECT 'target', 'note', sp, NULL, NULL, NULL, NULL, 'auto-resolved: differs-no-archive' FROM lost
        UNION ALL SELECT side, 'move', regexp_replace(lp, '\\.[^.]*$', '') || '.sync-conflict-20240131-112000-' || lh || regexp_extract(lp, '\\.[^.]*$'), lp, ls, lm, ld,
          'conflict-loser-kept-as-copy (differs-no-archive)' FROM lost
        UNION ALL SELECT side, 'update', lp, NULL, ws, wm, wd, 'conflict-resolved-newer-wins (loser kept as .sync-conflict copy)' FROM lost"""
        ),
    ),
)
def conflict_copies(spark, sf):
    """A whole plan in which conflicts are resolved by time, with the older content kept under a conflict name."""
    source, target, _ = fx.inventories(spark, sf)
    ops = compare(source, target, "sync", options=Options(conflict="copy"), now_ms=NOW_MS).operations()
    return _shown(ops).select(*PLAN[1:])


@query(
    "permission_changes",
    fx.with_sql(
        fx.BASE_SQL,
        select="""SELECT 'chmod' AS action, tp AS path, smode AS mode, 'mode-differs-master-wins (0644 -> 0600)' AS reason FROM pair
          WHERE hs AND ht AND eq AND smode <> tmode
        UNION ALL SELECT 'update', tp, smode, 'source-newer' FROM pair WHERE hs AND ht AND NOT unreadable AND NOT eq AND sm > tm + 2000
        UNION ALL SELECT 'copy', sp, smode, 'only-in-source' FROM pair WHERE hs AND NOT ht
        UNION ALL SELECT 'conflict', tp, NULL, 'evidence-unavailable (content unreadable on one side)' FROM pair WHERE hs AND ht AND unreadable""",
    ),
)
def permission_changes(spark, sf):
    source, target, _ = fx.inventories(spark, sf)
    ops = compare(source, target, "enrich", options=Options(sync_mode=True)).operations()
    return ops.select("action", "path", "mode", "reason")


@query(
    "case_collisions",
    fx.with_sql(
        fx.EXACT_SQL,
        select="""SELECT 'copy' AS action, sp AS path, 'only-in-source' AS reason FROM pair p
          WHERE hs AND NOT ht AND NOT EXISTS (SELECT 1 FROM tgt_all t WHERE upper(t.path) = upper(p.sp) AND t.path <> p.sp)
        UNION ALL SELECT 'conflict', p.sp, 'case-collision: writing ''' || p.sp || ''' meets the existing ''' || t.path ||
          ''' where case makes no difference; rename one or compare without case'
          FROM pair p JOIN tgt_all t ON upper(t.path) = upper(p.sp) AND t.path <> p.sp WHERE p.hs AND NOT p.ht
        UNION ALL SELECT 'conflict', tp, 'evidence-unavailable (content unreadable on one side)' FROM pair WHERE hs AND ht AND unreadable
        UNION ALL SELECT 'update', tp, 'source-newer' FROM pair WHERE hs AND ht AND NOT unreadable AND NOT eq AND sm > tm + 2000""",
    ),
)
def case_collisions(spark, sf):
    """A whole plan by case-sensitive keys: names that would land on a differently spelled existing file are refused."""
    source, target, _ = fx.inventories(spark, sf)
    return compare(source, target, "enrich", options=Options(case_insensitive=False)).operations().select("action", "path", "reason")


TWIN_SQL = """
twins AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY path) AS n FROM (
  SELECT path, upper(path) AS key FROM tgt_all UNION ALL SELECT upper(path), upper(path) FROM base WHERE doc_id % 10 = 3 AND doc_id % 23 <> 0))
"""


@query(
    "duplicate_twins",
    fx.with_sql(
        fx.BASE_SQL, TWIN_SQL,
        select="""SELECT 'target' AS side, 'note' AS action, path, 'duplicate-after-normalization (kept first; NFC/case twin)' AS reason FROM twins
          WHERE n > 1 AND key <> 'SRC3/EN' AND NOT starts_with(key, 'SRC3/EN/')""",
    ),
)
def duplicate_twins(spark, sf):
    """Every second spelling of one name on a case-insensitive target."""
    source, target, _ = fx.inventories(spark, sf)
    more = target.entries.unionByName(
        fx.base(spark, sf).where("doc_id % 10 = 3 and doc_id % 23 <> 0").select(F.upper("path").alias("path"), F.lit("file").alias("kind")), allowMissingColumns=True
    )
    ops = compare(source, Inventory(more, target.header), "enrich").operations()
    return ops.where(F.startswith("reason", F.lit("duplicate"))).select("side", "action", "path", "reason")


@query(
    "symlink_plan",
    """WITH c AS (SELECT 'links/' || conv_id || '/' || turn AS path, conv_id * 31 + turn AS i, role FROM conversations),
    s AS (SELECT path, 'to/' || role AS target FROM c WHERE i % 5 <> 0),
    t AS (SELECT path, 'to/' || CASE WHEN i % 3 = 0 THEN 'elsewhere' ELSE role END AS target FROM c WHERE i % 7 <> 0)
    SELECT CASE WHEN s.path IS NULL THEN 'source' ELSE 'target' END AS side, CASE WHEN s.path IS NOT NULL AND t.path IS NOT NULL THEN 'conflict' ELSE 'copy' END AS action,
      coalesce(s.path, t.path) AS path, coalesce(s.target, t.target) AS link,
      CASE WHEN s.path IS NULL THEN 'symlink-only-in-target' WHEN t.path IS NULL THEN 'symlink-only-in-source' ELSE 'symlink-differs' END AS reason
    FROM s FULL JOIN t ON s.path = t.path WHERE s.path IS NULL OR t.path IS NULL OR s.target <> t.target""",
)
def symlink_plan(spark, sf):
    source, target = fx.link_inventories(spark, sf)
    return compare(source, target, "sync").operations().select("side", "action", "path", "link", "reason")


@query(
    "metadata_compare",
    fx.with_sql(
        fx.BASE_SQL,
        select="""SELECT CASE WHEN b.doc_id % 19 = 0 THEN 'copy' ELSE 'update' END AS action, b.path, b.size,
          CASE WHEN b.doc_id % 19 = 0 THEN 'only-in-source' ELSE 'differs-master-wins' END AS reason FROM base b
          WHERE b.doc_id % 19 = 0 OR b.doc_id % 41 = 0 OR (b.doc_id % 5) * 900 > 2000""",
    ),
)
def metadata_compare(spark, sf):
    """Equality by size and the two-second window only."""
    source, target = fx.metadata_inventories(spark, sf)
    return compare(source, target, "mirror").operations().select("action", "path", "size", "reason")


@query(
    "coarse_time_compare",
    fx.with_sql(
        fx.BASE_SQL,
        select="""SELECT CASE WHEN b.doc_id % 19 = 0 THEN 'copy' ELSE 'update' END AS action, b.path, b.size,
          CASE WHEN b.doc_id % 19 = 0 THEN 'only-in-source' ELSE 'differs-master-wins' END AS reason FROM base b
          WHERE b.doc_id % 19 = 0 OR b.doc_id % 41 = 0""",
    ),
)
def coarse_time_compare(spark, sf):
    """A side that records whole minutes only: times within a minute are equal."""
    source, target = fx.metadata_inventories(spark, sf)
    target = replace(target, header=replace(target.header, mtime_precision_ms=60_000))
    return compare(source, target, "mirror").operations().select("action", "path", "size", "reason")


PAGES_SQL = """
p AS (SELECT page_id AS i, 'web/' || CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^https?:/+', '') ELSE regexp_replace(url, '/+', '/', 'g') END
        || CASE WHEN page_id % 4 = 0 THEN '?v=1' ELSE '' END || CASE WHEN page_id % 9 = 0 THEN '/con.txt' ELSE '' END AS path FROM pages),
named AS (SELECT coalesce(s.path, t.path) AS path, t.path IS NULL AS to_target, s.path IS NULL AS to_source, t.i % 5 = 0 AS differs FROM
  (SELECT upper(path) AS key, min(path) AS path FROM p WHERE i % 6 <> 0 GROUP BY upper(path)) s FULL JOIN
  (SELECT upper(path) AS key, min(path) AS path, min_by(i, path) AS i FROM p WHERE i % 3 <> 0 GROUP BY upper(path)) t ON s.key = t.key),
faulty AS (SELECT *,
  CASE WHEN path LIKE '%:%' THEN 'mangled' WHEN path LIKE '%?%' THEN 'rejected' WHEN path LIKE '%/con.txt' THEN 'unusable' END AS fault,
  CASE WHEN path LIKE '%:%' THEN 'mangled: ''' || regexp_extract(path, '[^/]*:[^/]*') || ''' names a stream of a file there, and no file of this name appears'
       WHEN path LIKE '%?%' THEN 'rejected: no file name there may hold ''?'' in ''' || regexp_extract(path, '[^/]*[?][^/]*') || ''''
       WHEN path LIKE '%/con.txt' THEN 'unusable: ''con.txt'' is the name of a device there, so programs fail to open or remove it' END AS why,
  CASE WHEN to_source THEN 'source' ELSE 'target' END AS side, CASE WHEN to_target OR to_source THEN 'copy' ELSE 'conflict' END AS action,
  CASE WHEN to_target THEN 'only-in-source' WHEN to_source THEN 'only-in-target' ELSE 'differs-no-archive' END AS reason
  FROM named WHERE to_target OR to_source OR differs),
hazard AS (SELECT *, coalesce(fault = 'mangled' OR (to_target AND fault IS NOT NULL), false) AS endangered FROM faulty),
held AS (SELECT 'source' AS side, p.path, upper(p.path) AS key, sha256(html) AS digest FROM p JOIN pages ON page_id = i WHERE i % 6 <> 0
  UNION ALL SELECT 'target', p.path, upper(p.path), sha256(html || CASE WHEN i % 5 = 0 THEN 'x' ELSE '' END) FROM p JOIN pages ON page_id = i WHERE i % 3 <> 0),
firsts AS (SELECT side, key, min(path) AS path, min_by(digest, path) AS digest FROM held GROUP BY side, key),
notes AS (SELECT side, path, 'duplicate-after-normalization (kept first; NFC/case twin)' AS reason
  FROM (SELECT *, row_number() OVER (PARTITION BY side, key ORDER BY path) AS n FROM held) WHERE n > 1
  UNION ALL SELECT 'target', a.path, 'possible-move-needs-archive' FROM firsts a WHERE a.side = 'source' AND a.key NOT IN (SELECT key FROM firsts WHERE side = 'target')
    AND a.digest IN (SELECT digest FROM firsts t WHERE t.side = 'target' AND t.key NOT IN (SELECT key FROM firsts WHERE side = 'source')))
"""


@query(
    "windows_name_rules",
    fx.with_sql(
        PAGES_SQL,
        select="""SELECT side, CASE WHEN endangered THEN 'conflict' ELSE action END AS action, path,
          CASE WHEN endangered THEN 'illegal-on-windows: ' || why || CASE WHEN to_source THEN ' (reading side)' ELSE ' (executing side)' END ELSE reason END AS reason
          FROM hazard UNION ALL SELECT side, 'note', path, reason FROM notes""",
    ),
)
def windows_name_rules(spark, sf):
    """Page addresses as file names on a Windows target: colons, question marks, device names."""
    source, target = fx.page_inventories(spark, sf, "windows")
    return compare(source, target, "sync").operations().select("side", "action", "path", "reason")


@query(
    "unknown_name_rules",
    fx.with_sql(
        PAGES_SQL,
        select="""SELECT side, action, path, reason FROM hazard UNION ALL
          SELECT side, 'note', path, 'name-risk-on-unknown-server: ' || why ||
            '; the naming rules of this root are unknown, so nothing is held back' FROM hazard WHERE endangered
          UNION ALL SELECT side, 'note', path, reason FROM notes""",
    ),
)
def unknown_name_rules(spark, sf):
    """The same against a server whose system is unknown: operations stay, a note is added."""
    source, target = fx.page_inventories(spark, sf, "unknown")
    return compare(source, target, "sync").operations().select("side", "action", "path", "reason")


@query(
    "plan_header",
    fx.with_sql(
        fx.BASE_SQL,
        select="""SELECT 'enrich' AS mode, (SELECT count(*) FROM pair WHERE (hs AND NOT ht) OR (hs AND ht AND (unreadable OR (NOT eq AND sm > tm + 2000)))) AS op_count,
          (SELECT count(*) FROM pair WHERE hs AND ht AND unreadable) AS conflict_count, (SELECT count(*) FROM src_all) AS source_entries,
          (SELECT count(*) FROM tgt_all) AS target_entries, (SELECT count(*) FROM src_all) - (SELECT count(*) FROM src) AS source_unread_entries,
          (SELECT count(*) FROM tgt_all) - (SELECT count(*) FROM tgt) AS target_unread_entries""",
    ),
)
def header_query(spark, sf):
    source, target, _ = fx.inventories(spark, sf)
    return plan_header(compare(source, target, "enrich"), NOW_MS).select(
        "mode", "op_count", "conflict_count", "source_entries", "target_entries", "source_unread_entries", "target_unread_entries"
    )


@query(
    "plan_evidence",
    fx.with_sql(
        fx.BASE_SQL, fx.MIRROR_OPS_SQL,
        select="""SELECT o.action, o.path, s.ss AS src_size, s.sm AS src_ms, t.ts AS dst_size, t.tm AS dst_ms FROM ops o
          LEFT JOIN pair s ON s.hs AND s.key = upper(o.path)
          LEFT JOIN pair t ON t.ht AND t.key = upper(CASE WHEN o.action = 'move' THEN o.from_path ELSE o.path END)""",
    ),
)
def plan_evidence(spark, sf):
    source, target, _ = fx.inventories(spark, sf)
    made = compare(source, target, "mirror")
    return attach_evidence(made.operations(), made.sides).select(
        "action", "path", F.col("src.size").alias("src_size"), F.col("src.mtime_ms").alias("src_ms"),
        F.col("dst.size").alias("dst_size"), F.col("dst.mtime_ms").alias("dst_ms"),
    )


@query(
    "identical_totals",
    fx.with_sql(fx.BASE_SQL, select="SELECT count(*) AS identical_count, sum(ss)::BIGINT AS identical_bytes FROM pair WHERE eq"),
)
def identical_counts(spark, sf):
    source, target, _ = fx.inventories(spark, sf)
    return identical_totals(Sides(source, target, Options()))


@query(
    "identical_page",
    fx.with_sql(
        fx.BASE_SQL,
        select="""SELECT sp AS path, ss AS size, sm AS source_mtime_ms, tm AS target_mtime_ms, abs(sm - tm) > 2000 AS mtime_outside_window
          FROM pair WHERE eq AND lower(sp) LIKE '%/en/%' ORDER BY key LIMIT 50 OFFSET 20""",
    ),
)
def identical_rows(spark, sf):
    source, target, _ = fx.inventories(spark, sf)
    return identical_page(Sides(source, target, Options()), "/EN/ ", 20, 50)[1]


@query("identical_page_index", ORACLES["identical_page"])
def identical_page_index(spark, sf):
    """The same page from the stored zone map: only the blocks that hold it are read."""
    source, target, _ = fx.inventories(spark, sf)
    folder = f"{checkpoint_dir(spark)}/pages-{uuid.uuid4()}"
    identical_pages(Sides(source, target, Options()), folder, "/EN/ ", block_rows=1000)
    return pages.page(spark, folder, 20, 50).drop("key", pages.PLACE)


@query(
    "escalation",
    fx.with_sql(
        fx.BASE_SQL,
        select="""SELECT 'target' AS side, 'update' AS action, path, size, mtime_ms, sha256(text) AS hash,
          'escalated: sampled digests equal, mtime differs, full hashes differ' AS reason FROM base
          WHERE size >= 4000 AND (doc_id % 31 = 0 OR doc_id % 37 = 0) AND doc_id % 2 = 0""",
    ),
)
def escalation(spark, sf):
    """Sampled digests agree but times do not: read both in full and decide again."""
    source, target = fx.sampled_inventories(spark, sf)
    suspects = escalation_suspects(source, target, 2000)
    b = fx.base(spark, sf)
    full = b.select(F.lit("source").alias("side"), "path", F.sha2("text", 256).alias("digest")).unionByName(
        b.select(F.lit("target").alias("side"), "path", F.sha2(F.concat("text", F.when(F.col("doc_id") % 2 == 0, "x").otherwise("")), 256).alias("digest"))
    )
    return escalation_verdicts(suspects, full, "mirror", 2000).select("side", "action", "path", "size", "mtime_ms", "hash", "reason")


@query(
    "archive_refresh",
    fx.with_sql(
        fx.BASE_SQL, fx.SYNC_OPS_SQL,
        select="""SELECT s.path, s.digest, CASE WHEN r.path IS NULL THEN '' WHEN r.digest = s.digest THEN coalesce(r.older, '')
            ELSE r.digest || CASE WHEN r.older IS NULL THEN '' ELSE ',' || r.older END END AS history
          FROM src_all s LEFT JOIN arc_all r ON r.path = s.path WHERE s.path NOT IN (SELECT path FROM ops WHERE action = 'conflict')""",
    ),
)
def archive_refresh(spark, sf):
    """The source scan becomes the next archive, without conflicted paths and with its digest history."""
    source, target, archive = fx.inventories(spark, sf)
    ops = compare(source, target, "sync", archive=archive).operations()
    fresh = refresh_archive(source.entries, ops, archive.entries)
    history = F.array_join(F.transform(F.coalesce("previous_identities", F.array()), lambda i: i["digest"]), ",")
    return fresh.select("path", F.col("identity.digest").alias("digest"), history.alias("history"))
