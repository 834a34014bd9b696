"""Rules that look at one planned operation: what it is, what it moves, how it reverses.

Operation columns are `side, action, path, from, size, mtime_ms, hash, link, mode, reason`; measured
evidence, when attached, is `src` and `dst`, each struct(size, mtime_ms) or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

# Action order inside a plan, and facet names.
ACTION_RANK = {
    "move": 0, "copy": 1, "update": 1, "chmod": 2, "delete": 3, "delete_dir": 4, "conflict": 5, "note": 5,
}
RESULT_TYPES = ["copy", "update", "move", "delete", "conflict", "note"]
EXECUTION_CLASSES = ["move", "copy", "delta_update", "chmod", "delete", "delete_dir"]
LEVEL_RANK = {"info": 0, "warn": 1, "error": 2}
# Preset -> hash, sampled, use_cache, escalate, verify_writes.
RIGOR = {
    "quick": (False, False, False, False, False),
    "fast": (True, True, True, True, False),
    "balanced": (True, True, True, True, True),
    "standard": (True, True, False, True, True),
    "paranoid": (True, False, False, False, True),
}
RIGOR_AXES = ["hash", "sampled", "use_cache", "escalate", "verify_writes"]


def _lookup(key: Column, table: dict, default=None) -> Column:
    """A fixed table as one map access: the key expression appears once in the generated code."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(pairs, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def action_rank(action: Column | str = "action") -> Column:
    return _lookup(F.col(action) if isinstance(action, str) else action, ACTION_RANK, 5)


def is_executable(action: Column | str = "action") -> Column:
    a = F.col(action) if isinstance(action, str) else action
    return ~a.isin("conflict", "note")


def result_type(action: Column | str = "action") -> Column:
    a = F.col(action) if isinstance(action, str) else action
    return F.when(a == "chmod", F.lit("update")).when(a == "delete_dir", F.lit("delete")).otherwise(a)


def level_at_least(level: Column | str, minimum: str) -> Column:
    lv = F.col(level) if isinstance(level, str) else level
    return _lookup(lv, LEVEL_RANK, 0) >= LEVEL_RANK[minimum]


def owning_folder(action: Column | str = "action", path: Column | str = "path") -> Column:
    a = F.col(action) if isinstance(action, str) else action
    p = F.col(path) if isinstance(path, str) else path
    return F.when(a == "delete_dir", p).otherwise(text.parent(p))


def in_folder(folder: str | None) -> Column:
    """Rows a folder scope keeps; the empty string keeps root-level rows only."""
    if folder is None:
        return F.lit(True)
    owner = owning_folder()
    if folder == "":
        return owner == ""
    return text.is_at_or_under(owner, F.lit(folder))


def effective_evidence(df: DataFrame) -> DataFrame:
    """Fill `src`/`dst` of copy rows whose evidence was left out because the row implies it."""
    own = F.struct(F.col("size").alias("size"), F.col("mtime_ms").alias("mtime_ms"))
    implied = (
        F.col("src").isNull() & F.col("dst").isNull()
        & (F.col("action") == "copy") & F.col("size").isNotNull() & F.col("mtime_ms").isNotNull()
    )
    return df.withColumns(
        {
            "src": F.when(implied & (F.col("side") == "target"), own).otherwise(F.col("src")),
            "dst": F.when(implied & (F.col("side") == "source"), own).otherwise(F.col("dst")),
        }
    )


def side_paths() -> Column:
    """struct(source, target): the name present on each side before the operation runs."""
    p = F.col("path")
    current = F.coalesce(F.col("from"), p)
    on_target = F.col("side") == "target"
    none = F.lit(None).cast("string")
    a = F.col("action")
    only = lambda here, there: F.struct(here.alias("source"), there.alias("target"))
    return (
        F.when((a == "copy") & on_target, only(p, none))
        .when(a == "copy", only(none, p))
        .when((a == "move") & on_target, only(p, current))
        .when(a == "move", only(current, p))
        .when(a.isin("delete", "delete_dir") & on_target, only(none, p))
        .when(a.isin("delete", "delete_dir"), only(p, none))
        .otherwise(only(p, p))
    )


def can_reverse() -> Column:
    origin = F.when(F.col("side") == "source", F.col("src")).otherwise(F.col("dst"))
    return F.col("action").isin("copy", "delete") | (
        (F.col("action") == "update") & (F.col("link").isNotNull() | origin.isNotNull())
    )


def _reversed_fields(flip: Column) -> dict[str, Column]:
    """What a reversal changes where `flip` holds: the other side acts, and only the new origin's size is kept."""
    a = F.col("action")
    origin = F.when(F.col("side") == "source", F.col("src.size")).otherwise(F.col("dst.size"))
    stays = lambda c: F.when(~flip, F.col(c))
    return {
        "side": F.when(flip, F.when(F.col("side") == "source", "target").otherwise("source")).otherwise(F.col("side")),
        "action": F.when(flip & (a == "copy"), "delete").when(flip & (a == "delete"), "copy").otherwise(a),
        "from": stays("from"),
        "size": F.when(flip & (a == "update"), F.when(F.col("link").isNull(), origin)).otherwise(F.col("size")),
        "mtime_ms": stays("mtime_ms"),
        "hash": stays("hash"),
        "link": F.when(~(flip & (a == "copy")), F.col("link")),
        "reason": F.when(flip, F.concat(F.lit("reversed("), F.col("reason"), F.lit(")"))).otherwise(F.col("reason")),
    }


def reversed_op() -> Column:
    """The operation struct after the user flips its direction; null where that is refused."""
    fields = {**{c: F.col(c) for c in ("side", "action", "path", "from", "size", "mtime_ms", "hash", "link", "mode", "reason")},
              **_reversed_fields(F.lit(True))}
    return F.when(can_reverse(), F.struct(*[c.alias(n) for n, c in fields.items()]))


def apply_reversals(df: DataFrame, flag: str = "reversed") -> DataFrame:
    """Replace flagged rows by their reversed form. Refused flags leave the row and set `reversal_refused`."""
    asked = F.coalesce(F.col(flag), F.lit(False))
    ready = effective_evidence(df).withColumn("_flip", asked & can_reverse())
    changed = _reversed_fields(F.col("_flip"))
    changed["reversal_refused"] = asked & ~F.col("_flip")
    return ready.withColumns(changed).drop("_flip")


def row_size() -> Column:
    zero = F.lit(0).cast("bigint")
    return F.greatest(
        F.coalesce(F.col("size"), zero), F.coalesce(F.col("src.size"), zero), F.coalesce(F.col("dst.size"), zero)
    )


def row_modified() -> Column:
    zero = F.lit(0).cast("bigint")
    return F.greatest(F.coalesce(F.col("src.mtime_ms"), zero), F.coalesce(F.col("dst.mtime_ms"), zero))


def transfer_bytes() -> Column:
    """Bytes a copy or update reads from its origin side; zero for everything else."""
    origin = F.when(F.col("side") == "target", F.col("src.size")).otherwise(F.col("dst.size"))
    return F.when(
        F.col("action").isin("copy", "update"),
        F.greatest(F.lit(0).cast("bigint"), F.coalesce(origin, F.col("size"), F.lit(0).cast("bigint"))),
    ).otherwise(F.lit(0).cast("bigint"))


def deletion_bytes() -> Column:
    return F.when(
        F.col("action").isin("delete", "delete_dir"),
        F.greatest(F.lit(0).cast("bigint"), F.coalesce(F.col("size"), F.lit(0).cast("bigint"))),
    ).otherwise(F.lit(0).cast("bigint"))


def newer_side(window_ms: int) -> Column:
    gap = F.col("src.mtime_ms") - F.col("dst.mtime_ms")
    return (
        F.when(gap > window_ms, F.lit("s")).when(-gap > window_ms, F.lit("t")).otherwise(F.lit(""))
    )


def is_cloud_placeholder(path: Column | str = "path") -> Column:
    return text.base_name(path).rlike(r"(?s)^\..+\.icloud$")


def execution_class(delta: bool = False) -> Column:
    """Order in which an executor runs the plan; null for reports. `delta` splits off content updates."""
    order = {**{name: i for i, name in enumerate(EXECUTION_CLASSES) if name != "delta_update"}, "update": 2 if delta else 1}
    placed = _lookup(F.col("action"), order)
    if not delta:
        return placed
    return F.when((F.col("action") == "update") & F.col("link").isNotNull(), 1).otherwise(placed)


def rigor_axes(preset: Column, overrides: dict[str, Column] | None = None) -> Column:
    """struct of the five evidence axes: the preset's value unless an override is given."""
    overrides = overrides or {}
    fields = []
    for i, axis in enumerate(RIGOR_AXES):
        value = _lookup(preset, {k: v[i] for k, v in RIGOR.items()}, RIGOR["standard"][i])
        fields.append((F.coalesce(overrides[axis], value) if axis in overrides else value).alias(axis))
    return F.struct(*fields)


def evidence_axes(axes: Column, evidence: Column) -> Column:
    """Apply an explicit evidence tier (none / sampled / full) on top of resolved axes."""
    given = evidence.isNotNull()
    return F.struct(
        F.when(given, evidence != "none").otherwise(axes["hash"]).alias("hash"),
        F.when(given, ~evidence.isin("none", "full")).otherwise(axes["sampled"]).alias("sampled"),
        axes["use_cache"].alias("use_cache"), axes["escalate"].alias("escalate"),
        axes["verify_writes"].alias("verify_writes"),
    )


def run_label() -> Column:
    """State text of a run record: compare results, counts, interruption."""
    stamp = text.stamp("ts_ms")
    plural = lambda c, word: F.when(
        F.coalesce(F.col(c), F.lit(0)) > 0, F.concat(F.lit(" · "), F.col(c).cast("string"), F.lit(word))
    ).otherwise(F.lit(""))
    state = (
        F.when(F.col("finished") == F.lit(False), F.lit(" · ⚠ interrupted"))
        .when(F.col("cancelled"), F.lit(" · cancelled"))
        .otherwise(F.lit(""))
    )
    lead = F.concat(stamp, F.lit("  "), F.col("job_name"), F.lit("  "))
    return F.when(
        F.col("ops_found").isNotNull(),
        F.concat(lead, F.lit("compare · "), F.col("ops_found").cast("string"), F.lit(" found")),
    ).otherwise(
        F.concat(
            lead, F.col("done").cast("string"), F.lit(" items"), plural("errors", " errors"),
            plural("warnings", " warnings"), state,
        )
    )
