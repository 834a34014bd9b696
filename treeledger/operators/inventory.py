"""Inventories: keyed entries, unread areas, archive upkeep, scan accounting and cached state."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, cut_lineage
from ..functions import rows, text
from ..functions.masks import PathFilter, folded_path

GENERATIONS = 3
# Folder names a marker search never enters.
PRUNED_FOLDERS = [
    ".git", "node_modules", "target", "build", "dist", "__pycache__", ".venv", "venv", "worktrees",
    "$RECYCLE.BIN", "System Volume Information",
]


@dataclass
class Header:
    """Scalars of one inventory's header row."""

    root: str = "/"
    host: str = ""
    os: str = "linux"
    kind: str = "snapshot"
    evidence: str = "full"
    name_rules: str | None = None
    mtime_precision_ms: int = 0
    excluded_dirs: int = 0
    excluded_files: int = 0
    walk_errors: int = 0
    walk_err_samples: list[str] = field(default_factory=list)
    icloud_stubs: int = 0
    icloud_stub_samples: list[str] = field(default_factory=list)
    skipped_symlinks: int = 0
    dataless_files: int = 0

    @property
    def rules(self) -> str:
        return self.name_rules or ("windows" if self.os == "windows" else "posix")


@dataclass
class Inventory:
    """Entry rows, the header scalars, and the unread paths (a one-column frame `path`, or none).

    A `key` column stored with the entries is used if `keyed_for` names the case mode it was made in; a run
    in the other mode is refused. `unique_keys` says that no two entries of a kind
    share a key (a table saved with its twins resolved); the comparison then skips looking for twins, and
    tables bucketed on (kind, key) join without an exchange.
    """

    entries: DataFrame
    header: Header = field(default_factory=Header)
    unread: DataFrame | None = None
    unique_keys: bool = False
    keyed_for: bool | None = None

    def keyed(self, case_insensitive: bool, kinds: tuple[str, ...] | None = None) -> DataFrame:
        """Entries with their comparison key. The kind filter comes first, so it reaches the scan."""
        entries = self.entries if kinds is None else self.entries.where(F.col("kind").isin(*kinds))
        if "key" not in entries.columns:
            return text.with_key(entries, case_insensitive)
        if self.keyed_for is not None and self.keyed_for != case_insensitive:
            stored, asked = (("insensitive", "sensitive")[not x] for x in (self.keyed_for, case_insensitive))
            raise ValueError(f"the stored keys are case-{stored}; this comparison is case-{asked}")
        if self.keyed_for is None:
            return text.with_key(entries.drop("key"), case_insensitive)
        return entries


@dataclass
class UnreadScope:
    """Prefix keys of both sides' unread areas, with the depths that occur.

    While they are `small`, entries lose what they cover in broadcast joins, one per depth, without an exchange. Beyond that
    entries and prefixes are range-partitioned together, once whatever the depths, and swept in order.
    """

    prefixes: DataFrame | None
    depths: list[int]
    small: bool

    @classmethod
    def of(cls, inventories: list[Inventory], case_insensitive: bool) -> "UnreadScope":
        parts = [text.with_key(i.unread.select("path"), case_insensitive) for i in inventories if i.unread is not None]
        if not parts:
            return cls(None, [], True)
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        prefixes = both.select(F.col("key").alias("prefix")).distinct()
        prefixes = prefixes.withColumn("depth", text.depth("prefix"))
        seen = prefixes.groupBy("depth").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("prefix")).alias("bytes")
        ).collect()
        small = (
            sum(r["n"] for r in seen) <= BROADCAST_MAX_ROWS
            and sum(r["bytes"] for r in seen) <= BROADCAST_MAX_BYTES
        )
        return cls(prefixes if seen else None, sorted(r["depth"] for r in seen), small)

    def _side(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df

    def readable(self, keyed: DataFrame) -> DataFrame:
        """Entries outside every unread area. They are never multiplied by their depth, and a hot folder stays splittable."""
        if self.prefixes is None:
            return keyed
        return self._join(keyed, "left_anti") if self.small else swept(keyed, self.prefixes.select("prefix"), covered=False)

    def covered(self, keyed: DataFrame) -> DataFrame:
        """Entries at or under an unread area."""
        if self.prefixes is None:
            return keyed.limit(0)
        if not self.small:
            return swept(keyed, self.prefixes.select("prefix"), covered=True)
        flagged = keyed
        hit = F.lit(False)
        for d in self.depths:
            cut, mark = f"_cut{d}", f"_hit{d}"
            side = self.prefixes.where(F.col("depth") == d).select(
                F.col("prefix").alias(cut), F.lit(True).alias(mark)
            )
            flagged = flagged.withColumn(cut, text.prefix("key", d + 1)).join(self._side(side), cut, "left")
            hit = hit | F.coalesce(F.col(mark), F.lit(False))
        return flagged.where(hit).select(*keyed.columns)

    def _join(self, keyed: DataFrame, how: str) -> DataFrame:
        out = keyed
        for d in self.depths:
            cut = f"_cut{d}"
            side = self.prefixes.where(F.col("depth") == d).select(F.col("prefix").alias(cut))
            out = out.withColumn(cut, text.prefix("key", d + 1)).join(self._side(side), cut, how).drop(cut)
        return out

    def not_enclosing(self, keyed: DataFrame) -> DataFrame:
        """Directories with no unread path strictly below them."""
        if self.prefixes is None:
            return keyed
        above = self.prefixes.select(F.explode(text.ancestors("prefix")).alias("key")).distinct()
        return keyed.join(self._side(above), "key", "left_anti")


def outermost(prefixes: DataFrame) -> DataFrame:
    """The prefixes that lie below no other one; what they cover doesn't overlap."""
    inner = prefixes.select("prefix", F.explode(text.ancestors("prefix")).alias("_above"))
    nested = inner.join(prefixes.select(F.col("prefix").alias("_above")), "_above", "left_semi").select("prefix").distinct()
    return prefixes.join(nested, "prefix", "left_anti")


def swept(keyed: DataFrame, prefixes: DataFrame, covered: bool) -> DataFrame:
    """Entries at or under one of the prefixes if `covered`, else the others: one pass over keys in the order of their segments.

    In that order a folder's subtree follows it without a gap, so a prefix covers a run of rows whose end is found by
    bisection. A run may go on in later partitions: of each partition only its last prefix reaches the driver.
    """
    marks = outermost(prefixes.distinct()).select(F.col("prefix").alias("key"), F.lit(True).alias("_mark"))
    both = keyed.withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    order = [F.col("_order"), F.col("_mark").desc()]
    placed = both.withColumn("_order", F.split("key", "/")).repartitionByRange("_order").sortWithinPartitions(*order)
    placed = cut_lineage(placed).drop("_order")
    last = placed.where("_mark").groupBy(F.spark_partition_id().alias("part")).agg(
        F.max_by("key", F.split("key", "/")).alias("key")
    ).collect()
    carried = sorted((r["part"], r["key"]) for r in last)
    at = placed.columns.index("key")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        open_ = next((key for p, key in reversed(carried) if p < part), None)
        for batch in batches:
            keys, mark = batch.column(at), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            hit = np.zeros(batch.num_rows, bool)
            starts = np.flatnonzero(mark).tolist()
            for start, end in zip([0, *starts], [*starts, batch.num_rows], strict=True):
                if start < end and mark[start]:
                    open_ = keys[start].as_py()
                if open_ is not None:
                    low, high = start, end  # rows from `low` on may be past the run
                    while low < high:
                        mid = (low + high) // 2
                        key = keys[mid].as_py()
                        low, high = (mid + 1, high) if key == open_ or key.startswith(open_ + "/") else (low, mid)
                    hit[start:low] = True
            yield batch.filter(pa.array((hit == covered) & ~mark))

    return placed.mapInArrow(sweep, placed.schema).drop("_mark")


ENTRY_FIELDS = ["path", "size", "mtime_ms", "identity", "mode", "target"]


def entry_struct(extra: list[str] | None = None) -> Column:
    return F.struct(*ENTRY_FIELDS, *(extra or []))


def first_by_key(keyed: DataFrame, extra: list[str] | None = None, name: str = "entry") -> DataFrame:
    """(kind, key, entry, twins): the first entry in path order per kind and key, and how many share the key.

    An aggregate rather than a window: map tasks already reduce a key with very many twins to one row,
    and its output order is the order the comparison's merge join needs.
    """
    fields = entry_struct(extra)
    return keyed.groupBy("kind", "key").agg(
        F.min_by(fields, F.col("path")).alias(name), F.count(F.lit(1)).alias("twins")
    )


def later_twins(keyed: DataFrame, crowded: DataFrame | None = None) -> DataFrame:
    """Entries dropped by `first_by_key`: every twin but the first path of a (kind, key).

    `crowded` (kind, key, first path) may be passed when the comparison already found it.
    """
    if crowded is None:
        crowded = (
            keyed.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("first_path"))
            .where("_n > 1").drop("_n")
        )
    return keyed.join(crowded, ["kind", "key"]).where(F.col("path") != F.col("first_path")).drop("first_path")


def files_equal(a: str, b: str, window_ms: int) -> str:
    """SQL text: typed equality of two file structs; never true on missing or mixed evidence."""
    return f"""coalesce(CASE
        WHEN {a}.identity.kind = 'unreadable' OR {b}.identity.kind = 'unreadable' THEN false
        WHEN {a}.identity.kind = 'size_and_mtime' AND {b}.identity.kind = 'size_and_mtime'
            THEN {a}.size = {b}.size AND abs({a}.mtime_ms - {b}.mtime_ms) <= {int(window_ms)}
        WHEN {a}.identity.kind IN ('full', 'sampled') AND {b}.identity.kind IN ('full', 'sampled')
            THEN {a}.identity.kind = {b}.identity.kind AND {a}.identity.digest = {b}.identity.digest
        END, false)"""


def evidence_missing(a: str, b: str) -> str:
    """SQL text: one side's content could not be read."""
    return f"coalesce({a}.identity.kind = 'unreadable' OR {b}.identity.kind = 'unreadable', false)"


def generation_of(entry: str, record: str, window_ms: int) -> str:
    """SQL text: 0 = what the archive records, n = its n-th older identity, null = never seen."""
    return f"""CASE WHEN {record} IS NULL OR {entry} IS NULL THEN NULL
        WHEN {files_equal(entry, record, window_ms)} THEN 0
        ELSE nullif(array_position({record}.previous_identities, {entry}.identity), 0) END"""


# --- archive upkeep -------------------------------------------------------------------------------


def refresh_archive(fresh: DataFrame, ops: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """A fresh scan becomes the next archive: conflicted paths stay out, digest history rolls forward."""
    conflicted = ops.where(F.col("action") == "conflict").select("path").distinct()
    kept = fresh.join(conflicted, "path", "left_anti")
    return roll_generations(kept, previous) if previous is not None else kept


def roll_generations(fresh: DataFrame, previous: DataFrame) -> DataFrame:
    """Carry older identities per file: unchanged keeps its history, changed pushes the old digest."""
    old = previous.where(F.col("kind") == "file").select(
        "path", F.col("identity").alias("_old"), F.col("previous_identities").alias("_hist"), F.lit(True).alias("_known")
    )
    empty = F.slice(F.array("_old"), 1, 0)
    history = F.coalesce(F.col("_hist"), empty)
    old_is_digest = F.col("_old.kind").isin("full", "sampled")
    rolled = (
        F.when(old_is_digest & (F.col("_old") == F.col("identity")), history)
        .otherwise(F.slice(F.concat(F.when(old_is_digest, F.array("_old")).otherwise(empty), history), 1, GENERATIONS))
    )
    out = fresh.join(old, "path", "left")
    return out.withColumn(
        "previous_identities",
        F.when((F.col("kind") == "file") & F.col("_known"), rolled).otherwise(F.col("previous_identities")),
    ).select(*fresh.columns)


def archive_usable(archive: Header | None, mode: str, tier: str) -> bool:
    """An archive counts only for sync runs that judge on the same evidence tier."""
    return archive is not None and mode == "sync" and archive.evidence == tier


# --- scan state -------------------------------------------------------------------------------------


def correct_mtimes(observed: DataFrame, corrections: DataFrame) -> DataFrame:
    """Report the intended time where the raw on-disk time is still the recorded one; flag `matched`."""
    c = corrections.select("path", "ondisk_ms", "intended_ms")
    hit = F.coalesce(F.col("ondisk_ms") == F.col("mtime_ms"), F.lit(False))
    return (
        observed.join(c, "path", "left")
        .withColumns({"matched": hit, "mtime_ms": F.when(hit, F.col("intended_ms")).otherwise(F.col("mtime_ms"))})
        .drop("ondisk_ms", "intended_ms")
    )


def reuse_digests(observed: DataFrame, cache: DataFrame, sampled: bool) -> DataFrame:
    """Add `cached_digest`: usable when size, reported time and tier agree and the time was not corrected."""
    c = cache.select(
        "path", F.col("size").alias("_cs"), F.col("mtime_ms").alias("_cm"), F.col("identity").alias("_ci")
    )
    wants_sampled = F.lit(sampled) & (F.col("size") >= text.SAMPLE_MIN)
    usable = (
        ~F.col("matched")
        & (F.col("_cs") == F.col("size"))
        & (F.col("_cm") == F.col("mtime_ms"))
        & ((F.col("_ci.kind") == "sampled") == wants_sampled)
    )
    return (
        observed.join(c, "path", "left")
        .withColumn("cached_digest", F.when(usable, F.col("_ci.digest")))
        .drop("_cs", "_cm", "_ci")
    )


def effective_read_bytes(observed: DataFrame, sampled: bool) -> DataFrame:
    """Bytes a scan still has to read: three windows for large sampled files, else the whole file."""
    windows = F.least(F.lit(3 * text.SAMPLE_WINDOW).cast("bigint"), F.col("size"))
    need = F.when(F.lit(sampled) & (F.col("size") >= text.SAMPLE_MIN), windows).otherwise(F.col("size"))
    return observed.agg(
        F.sum(F.when(F.col("cached_digest").isNull(), need).otherwise(0)).alias("read_bytes"),
        F.count_if(F.col("cached_digest").isNull()).alias("files_to_read"),
    )


def _absent_but_filtered(df: DataFrame, keep: PathFilter) -> Column:
    return ~keep.passes_file()


def reconcile_cache(cache: DataFrame, observed: DataFrame, complete: bool, keep: PathFilter) -> DataFrame:
    """Next cache table: hashed files upsert, unhashed drop, absent rows stay only if filtered out or partial."""
    prior = folded_path(cache.select("path", "size", "mtime_ms", "identity"))
    prior = prior.withColumn("_stay", F.lit(not complete) | _absent_but_filtered(prior, keep))
    old = prior.select("path", F.struct("size", "mtime_ms", "identity").alias("_o"), "_stay")
    new = observed.where(F.col("kind") == "file").select(
        "path", F.struct("size", "mtime_ms", "identity").alias("_n")
    )
    hashed = F.col("_n.identity.kind").isin("full", "sampled")
    joined = old.join(new, "path", "full_outer")
    row = F.when(F.col("_n").isNotNull(), F.when(hashed, F.col("_n"))).when(F.col("_stay"), F.col("_o"))
    return joined.withColumn("_r", row).where(F.col("_r").isNotNull()).select("path", "_r.*")


def reconcile_corrections(
    corrections: DataFrame, observed: DataFrame, matched: DataFrame, complete: bool, keep: PathFilter
) -> DataFrame:
    """Keep a correction while its file is live and still matched; unobserved rows as in the cache."""
    seen = observed.groupBy("path").agg(F.max(F.col("kind") == "file").alias("_live"))
    hits = matched.select("path", F.lit(True).alias("_matched")).distinct()
    table = folded_path(corrections)
    joined = table.join(seen, "path", "left").join(hits, "path", "left")
    stay = F.when(
        F.col("_live").isNotNull(), F.col("_live") & F.coalesce(F.col("_matched"), F.lit(False))
    ).otherwise(F.lit(not complete) | ~keep.passes_file())
    return joined.where(stay).select(*corrections.columns)


# --- accounting ---------------------------------------------------------------------------------------


def scan_accounting(observed: DataFrame, keep: PathFilter) -> DataFrame:
    """One row: entries by kind, filtered counts, placeholders with up to five samples in path order."""
    flagged = folded_path(observed)
    flagged = flagged.withColumns(
        {
            "_file_ok": keep.passes_file(),
            "_dir_ok": keep.passes_directory()["enters"],
            "_stub": (F.col("kind") == "file") & rows.is_cloud_placeholder(),
        }
    )
    is_file, is_dir = F.col("kind") == "file", F.col("kind") == "directory"
    counts = flagged.agg(
        F.count_if(is_file & F.col("_file_ok") & ~F.col("_stub")).alias("files"),
        F.count_if(is_dir & F.col("_dir_ok")).alias("directories"),
        F.count_if(F.col("kind") == "symlink").alias("symlinks"),
        F.count_if(is_file & ~F.col("_file_ok")).alias("excluded_files"),
        F.count_if(is_dir & ~F.col("_dir_ok")).alias("excluded_dirs"),
        F.count_if(F.col("_stub") & F.col("_file_ok")).alias("placeholders"),
    )
    samples = (
        flagged.where(F.col("_stub") & F.col("_file_ok")).orderBy("path").limit(5)
        .agg(F.sort_array(F.collect_list("path")).alias("placeholder_samples"))
    )
    return counts.withColumn("placeholder_samples", samples.scalar())


def marked_folders(
    observed: DataFrame, marker: str, max_depth: int = 7, pruned: list[str] | None = None
) -> DataFrame:
    """Folders holding a marker file, not below a pruned folder name, sorted and distinct."""
    low = [p.lower() for p in (PRUNED_FOLDERS if pruned is None else pruned)]
    folder = text.parent("path")
    return (
        observed.where(
            (F.col("kind") == "file") & (text.base_name("path") == marker) & (text.depth("path") + 1 <= max_depth)
        )
        .where(~F.exists(F.split(folder, "/"), lambda s: F.lower(s).isin(low)))
        .select(folder.alias("path"))
        .distinct()
        .orderBy("path")
    )


def directories_of(files: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """Distinct folders above the given file paths."""
    extra = extra or []
    folders = files.select(text.parent("path").alias("path"), *extra).distinct().where(F.col("path") != "")
    names = [c for c in folders.columns if c != "path"]
    return folders.select(F.explode(text.self_and_ancestors("path")).alias("path"), *names).distinct()
