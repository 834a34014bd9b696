"""Measured evidence beside a plan: per-row sizes and times, identical files, escalation, reviewed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import with_global_index
from ..functions import rows, text
from ..schema import OP_COLUMNS
from . import pages
from .compare import Sides, identical_files
from .inventory import Inventory

ESCALATED = "escalated: sampled digests equal, mtime differs, full hashes differ"


def attach_evidence(ops: DataFrame, sides: Sides) -> DataFrame:
    """Add `src` and `dst` (size, mtime_ms) looked up under each side's own name, files before folders."""
    ci = sides.options.case_insensitive
    executes_there = (F.col("action") == "move") & (F.col("side") == "target")
    executes_here = (F.col("action") == "move") & (F.col("side") == "source")
    old = F.coalesce(F.col("from"), F.col("path"))
    named = ops.withColumns(
        {
            "_sn": F.when(executes_here, old).otherwise(F.col("path")),
            "_tn": F.when(executes_there, old).otherwise(F.col("path")),
        }
    )
    keyed = named.withColumns({"_sk": text.norm_key("_sn", ci), "_tk": text.norm_key("_tn", ci)})
    return (
        keyed.join(_lookup(sides, sides.source, keyed.select(F.col("_sk").alias("key")), "_sk", "src"), "_sk", "left")
        .join(_lookup(sides, sides.target, keyed.select(F.col("_tk").alias("key")), "_tk", "dst"), "_tk", "left")
        .drop("_sn", "_tn", "_sk", "_tk")
    )


def _lookup(sides: Sides, inventory: Inventory, keys: DataFrame, key: str, name: str) -> DataFrame:
    """key -> struct(size, mtime_ms) over files and directories of one side, for the plan's keys only."""
    both = sides.firsts(inventory, "e", ("file", "directory"), keys=keys.distinct())
    measured = F.struct(F.coalesce("e.size", F.lit(0)).cast("bigint").alias("size"), F.col("e.mtime_ms").alias("mtime_ms"))
    order = F.when(F.col("kind") == "file", 0).otherwise(1)
    return both.groupBy(F.col("key").alias(key)).agg(F.min_by(measured, order).alias(name))


def identical_totals(sides: Sides) -> DataFrame:
    return identical_files(sides).agg(
        F.count(F.lit(1)).alias("identical_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("identical_bytes")
    )


def identical_page(sides: Sides, search: str = "", offset: int = 0, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(total row, one page in key order).

    Rows are positioned by a distributed sort and the page is a range of positions, however deep. Without a
    limit the page is all rows from the offset on.
    """
    found = identical_files(sides)
    wanted = search.strip().lower()
    if wanted:
        found = found.where(F.contains(F.lower("path"), F.lit(wanted)))
    place = F.col("_place")
    placed = with_global_index(found, [F.col("key")], "_place")
    page = placed.where(place >= offset if limit is None else (place >= offset) & (place < offset + limit)).drop("key", "_place")
    return found.agg(F.count(F.lit(1)).alias("total")), page


def identical_pages(sides: Sides, path: str, search: str = "", block_rows: int = pages.BLOCK_ROWS) -> None:
    """Store all rows of `identical_page` once, for pages that read their blocks only: `pages.page` and `pages.total`."""
    found = identical_files(sides)
    wanted = search.strip().lower()
    if wanted:
        found = found.where(F.contains(F.lower("path"), F.lit(wanted)))
    pages.write_pages(found, ["key"], path, block_rows)


def escalation_suspects(source: Inventory, target: Inventory, window_ms: int) -> DataFrame:
    """Equal sampled digests whose times disagree; matched on the exact path."""
    s, t = (
        i.entries.where((F.col("kind") == "file") & (F.col("identity.kind") == "sampled")).select(
            "path", F.struct("size", "mtime_ms", F.col("identity.digest").alias("digest")).alias(n)
        )
        for i, n in ((source, "s"), (target, "t"))
    )
    return s.join(t, "path").where(
        (F.col("s.digest") == F.col("t.digest")) & (F.abs(F.col("s.mtime_ms") - F.col("t.mtime_ms")) > window_ms)
    )


def escalation_verdicts(suspects: DataFrame, full: DataFrame, mode: str, window_ms: int) -> DataFrame:
    """Operations for suspects whose whole-content digests differ. `full` is (side, path, digest)."""
    digest = lambda side: full.where(F.col("side") == side).select("path", F.col("digest").alias(f"{side}_digest"))
    judged = suspects.join(digest("source"), "path").join(digest("target"), "path")
    differs = judged.where(F.col("source_digest") != F.col("target_digest"))
    if mode == "enrich":
        differs = differs.where(F.col("s.mtime_ms") > F.col("t.mtime_ms") + window_ms)
    conflict = mode == "sync"
    return differs.select(
        F.lit("target").alias("side"), F.lit("conflict" if conflict else "update").alias("action"), "path",
        F.lit(None).cast("string").alias("from"), F.col("s.size").alias("size"), F.col("s.mtime_ms").alias("mtime_ms"),
        (F.lit(None).cast("string") if conflict else F.col("source_digest")).alias("hash"),
        F.lit(None).cast("string").alias("link"), F.lit(None).cast("int").alias("mode"), F.lit(ESCALATED).alias("reason"),
    )


def append_escalated(plan: DataFrame, escalated: DataFrame) -> DataFrame:
    """Escalated rows go behind the sorted plan, in path order, with the following positions."""
    start = plan.agg(F.coalesce(F.max("op_index") + 1, F.lit(0)).cast("bigint")).scalar()
    placed = with_global_index(escalated, [F.col("path")], "op_index").withColumn("op_index", F.col("op_index") + start)
    return plan.unionByName(placed.select(*plan.columns))


def upgrade_identities(entries: DataFrame, full: DataFrame) -> DataFrame:
    """Entries whose whole content was read carry the stronger identity from now on."""
    f = full.select("path", F.col("digest").alias("_d"))
    better = F.struct(F.lit("full").alias("kind"), F.col("_d").alias("digest"))
    out = entries.join(f, "path", "left")
    return out.withColumn("identity", F.when(F.col("_d").isNotNull(), better).otherwise(F.col("identity"))).select(*entries.columns)


# --- reviewed rows ---------------------------------------------------------------------------------------------


def decision_faults(plan: DataFrame, decisions: DataFrame) -> DataFrame:
    """(op_index, fault) for decisions (op_index, reversed) that cannot be applied; empty means accepted.

    `plan` carries op_index, the operation columns and src/dst. An empty decision set is itself a fault.
    """
    counted = decisions.groupBy("op_index").agg(
        F.count(F.lit(1)).alias("times"), F.bool_or("reversed").alias("reversed")
    )
    known = rows.effective_evidence(plan).select("op_index", "action", rows.can_reverse().alias("_can"))
    joined = counted.join(known, "op_index", "left")
    fault = (
        F.when(F.col("times") > 1, "duplicate decision")
        .when(F.col("action").isNull(), "unknown row")
        .when(~rows.is_executable(), "reports are not executable")
        .when(F.col("reversed") & ~F.col("_can"), "row cannot be reversed")
    )
    per_row = joined.withColumn("fault", fault).where("fault is not null").select("op_index", "fault")
    none = decisions.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit(None).cast("bigint").alias("op_index"), F.lit("no rows were selected").alias("fault")
    )
    return per_row.unionByName(none)


def decided_operations(plan: DataFrame, decisions: DataFrame) -> DataFrame:
    """The operations a reviewed decision set executes, in plan order positions."""
    chosen = plan.join(decisions.select("op_index", "reversed"), "op_index")
    return rows.apply_reversals(chosen).where(~F.col("reversal_refused") & rows.is_executable()).drop(
        "reversed", "reversal_refused"
    )


def presented_rows(plan: DataFrame, presentation: DataFrame) -> DataFrame:
    """Rows for an export in the requested order: presentation is (position, op_index, reversed, included)."""
    shown = plan.join(presentation, "op_index")
    return rows.apply_reversals(shown).drop("reversed")


def export_columns(source_root: str, target_root: str) -> list[Column]:
    """The twelve export columns, unquoted; absent values are empty text."""
    side = rows.side_paths()
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    full = lambda root, c: F.when(c.isNull(), F.lit("")).otherwise(text.join_display(F.lit(root), c))
    iso = lambda c: F.when(c > 0, text.stamp_iso(c)).otherwise(F.lit(""))
    safe = text.spreadsheet_safe
    return [
        F.col("included").cast("int").alias("included"), F.col("action"), F.col("side"),
        safe("path").alias("rel_path"), safe(F.coalesce(F.col("from"), F.lit(""))).alias("from"),
        safe(full(source_root, side["source"])).alias("source_path"),
        safe(full(target_root, side["target"])).alias("target_path"),
        blank(F.col("src.size")).alias("src_size"), iso(F.col("src.mtime_ms")).alias("src_mtime_utc"),
        blank(F.col("dst.size")).alias("dst_size"), iso(F.col("dst.mtime_ms")).alias("dst_mtime_utc"),
        safe("reason").alias("reason"),
    ]


def operation_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in ("op_index", *OP_COLUMNS) if c in df.columns])
