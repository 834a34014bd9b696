"""The whole comparison: decisions, passes, plan header, measured evidence, escalation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import cut_lineage
from ..operators import compare as cmp
from ..operators import passes
from ..operators.compare import Options, Sides
from ..operators.inventory import Inventory, archive_usable
from ..schema import OP_COLUMNS

MODES = ("mirror", "sync", "enrich")
PLAN_SCHEMA = 2


@dataclass
class Comparison:
    """A finished comparison. `ops` is unordered with emission columns; `plan()` adds plan positions."""

    sides: Sides
    mode: str
    ops: DataFrame

    def plan(self) -> DataFrame:
        return passes.indexed(self.ops)

    def operations(self) -> DataFrame:
        """Operation rows without positions, for aggregates that do not need the order."""
        return self.ops.select(*OP_COLUMNS)


def compare(
    source: Inventory,
    target: Inventory,
    mode: str,
    archive: Inventory | None = None,
    resolve_newer: bool = False,
    options: Options | None = None,
    now_ms: int = 0,
) -> Comparison:
    """Plan the operations that reconcile two inventories.

    mirror makes the target equal the source, enrich only adds and refreshes, sync works both ways and
    uses the archive (when given) to tell changes from deletions. Times are judged at the coarsest precision
    that either inventory records, and an archive of another evidence tier than the source is no archive.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    sides = Sides(source, target, (options or Options()).widened(source, target))
    if archive is not None and not archive_usable(archive.header, mode, source.header.evidence):
        archive = None
    decided = cut_lineage(decide(sides, mode, archive, resolve_newer))
    return planned(sides, mode, decided, archive is not None, now_ms)


def decide(sides: Sides, mode: str, archive: Inventory | None, resolve_newer: bool = False) -> DataFrame:
    """(kind, key, s, t, twins, verdict) of every key that is not settled. A key's verdict depends on its own rows only."""
    return cmp.decide_two_way(sides, archive, resolve_newer) if mode == "sync" else cmp.decide_one_way(sides, mode)


def planned(sides: Sides, mode: str, decided: DataFrame, with_archive: bool, now_ms: int = 0) -> Comparison:
    """The operations that stored decisions lead to, after all passes."""
    parts = cmp.plan_two_way(sides, decided, with_archive) if mode == "sync" else cmp.plan_one_way(sides, mode, decided)
    notes = cmp.duplicate_notes(sides, decided)
    ops = parts[0]
    for part in parts[1:] + ([notes] if notes is not None else []):
        ops = ops.unionByName(part)
    ops = passes.refuse_case_collisions(ops, sides)
    ops = passes.resolve_conflicts(ops, sides, now_ms)
    pruned = passes.prune_conflict_copies(sides)
    if pruned is not None:
        ops = ops.unionByName(pruned)
    ops = passes.check_name_rules(ops, sides.source.header.rules, sides.target.header.rules)
    return Comparison(sides, mode, ops)


def plan_header(result: Comparison, generated_at_ms: int) -> DataFrame:
    """One row of plan totals and scan facts, with per-side counts of suppressed entries."""
    s, t = result.sides.source, result.sides.target
    counts = result.ops.agg(
        F.count(F.lit(1)).alias("op_count"), F.count_if(F.col("action") == "conflict").alias("conflict_count")
    )
    lit = F.lit
    texts = lambda v: F.array(*[lit(x) for x in v]).cast("array<string>")

    def entries(inv):
        return inv.entries.agg(F.count(lit(1))).scalar()

    def suppressed(side):
        return result.sides.unread_entries(side).agg(F.count(lit(1))).scalar()

    def unread(inv):
        if inv.unread is None:
            return texts([])
        return inv.unread.agg(F.sort_array(F.collect_list("path"))).scalar()

    return counts.select(
        lit(PLAN_SCHEMA).cast("bigint").alias("schema"), lit("plan").alias("kind"), lit(result.mode).alias("mode"),
        lit(generated_at_ms).cast("bigint").alias("generated_at_ms"),
        lit(s.header.root).alias("source_root"), lit(s.header.host).alias("source_host"),
        lit(t.header.root).alias("target_root"), lit(t.header.host).alias("target_host"),
        "op_count", "conflict_count",
        entries(s).alias("source_entries"), entries(t).alias("target_entries"),
        lit(s.header.excluded_dirs + s.header.excluded_files).cast("bigint").alias("source_excluded"),
        lit(t.header.excluded_dirs + t.header.excluded_files).cast("bigint").alias("target_excluded"),
        lit(s.header.walk_errors).cast("bigint").alias("source_walk_errors"),
        lit(t.header.walk_errors).cast("bigint").alias("target_walk_errors"),
        texts(s.header.walk_err_samples).alias("source_walk_err_samples"),
        texts(t.header.walk_err_samples).alias("target_walk_err_samples"),
        lit(s.header.icloud_stubs).cast("bigint").alias("source_icloud_stubs"),
        lit(t.header.icloud_stubs).cast("bigint").alias("target_icloud_stubs"),
        texts(s.header.icloud_stub_samples).alias("source_icloud_stub_samples"),
        texts(t.header.icloud_stub_samples).alias("target_icloud_stub_samples"),
        unread(s).alias("source_unread_paths"), unread(t).alias("target_unread_paths"),
        suppressed("source").alias("source_unread_entries"), suppressed("target").alias("target_unread_entries"),
    )
