"""Checks on tables: every broken rule becomes one row (rule, subject, detail); no rows means valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, text

TABLE_SCHEMA = 2
MUTATING = ["copy", "update", "move", "delete", "chmod"]


def _faults(df: DataFrame, checks: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """One pass: every (rule, broken, subject, detail) that applies to a row is emitted."""
    made = [
        F.when(broken, F.struct(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail")))
        for rule, broken, subject, detail in checks
    ]
    return df.select(F.explode(F.array_compact(F.array(*made))).alias("_f")).select("_f.*")


def snapshot_faults(header: DataFrame, entries: DataFrame) -> DataFrame:
    """Header and entry rules of a snapshot or archive table (one header row)."""
    nothing = F.lit("")
    actual = entries.agg(F.count(F.lit(1))).scalar()
    h = header.withColumn("_actual", actual)
    samples = lambda label, n, s: (
        f"{label} samples are inconsistent with their count", (F.size(s) > 5) | (F.size(s) > F.col(n)), F.lit(n), nothing
    )
    unread = F.col("unread_paths")
    ordered = F.forall(
        F.sequence(F.lit(1), F.greatest(F.size(unread), F.lit(1))),
        lambda i: (i == 1) | (F.try_element_at(unread, i - 1) < F.try_element_at(unread, i)),
    )
    head = _faults(
        h,
        [
            ("unsupported table schema", F.coalesce(F.col("schema") != TABLE_SCHEMA, F.lit(True)), F.col("kind"), F.col("schema")),
            ("declared entry count differs", F.col("entry_count") != F.col("_actual"), F.col("entry_count"), F.col("_actual")),
            samples("walk error", "walk_errors", "walk_err_samples"),
            samples("placeholder", "icloud_stubs", "icloud_stub_samples"),
            ("unread paths must be unique and sorted", ~ordered, F.array_join(unread, " "), nothing),
            (
                "storage note needs protocol and display root",
                F.col("vfs").isNotNull() & ((F.col("vfs.protocol") == "") | (F.col("vfs.display_root") == "")), F.col("kind"), nothing,
            ),
        ],
    )
    facts = header.select(F.col("kind").alias("_table"), F.col("evidence").alias("_tier"))
    return head.unionByName(entry_faults(entries, facts)).unionByName(duplicate_paths(entries))


def entry_faults(entries: DataFrame, facts: DataFrame) -> DataFrame:
    """Row rules; `facts` is one row of table kind and evidence tier."""
    tier, table = facts.select("_tier").scalar(), facts.select("_table").scalar()
    e = entries.withColumns({"_tier": tier, "_table": table})
    ik, is_file = F.col("identity.kind"), F.col("kind") == "file"
    tier_ok = (
        F.when(F.col("_tier") == "none", ik == "size_and_mtime")
        .when(F.col("_tier") == "sampled", ik.isin("sampled", "full", "unreadable"))
        .otherwise(ik.isin("full", "unreadable"))
    )
    older = F.coalesce("previous_identities", F.array().cast("array<struct<kind:string,digest:string>>"))
    p = F.col("path")
    return _faults(
        e,
        [
            ("unsafe path", text.path_fault("path").isNotNull(), p, text.path_fault("path")),
            ("identity does not fit the evidence tier", is_file & ~F.coalesce(tier_ok, F.lit(False)), p, ik),
            ("digest is not 64 lower-case hex", is_file & ik.isin("full", "sampled") & ~F.coalesce(text.is_digest("identity.digest"), F.lit(False)), p, F.col("identity.digest")),
            ("more than three older identities", is_file & (F.size(older) > 3), p, F.size(older)),
            ("snapshot entry carries archive history", is_file & (F.col("_table") == "snapshot") & (F.size(older) > 0), p, F.size(older)),
            ("archive history holds a non-digest", is_file & F.exists(older, lambda i: ~i["kind"].isin("full", "sampled")), p, F.lit("")),
            ("invalid permission bits", is_file & ((F.col("mode") < 0) | (F.col("mode") > 0o7777)), p, F.col("mode")),
            ("link target is empty or holds NUL", (F.col("kind") == "symlink") & ((F.coalesce("target", F.lit("")) == "") | (F.instr("target", "\0") > 0)), p, F.lit("")),
        ],
    )


def duplicate_paths(entries: DataFrame) -> DataFrame:
    return entries.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit("paths must be unique").alias("rule"), F.col("path").alias("subject"), F.col("n").cast("string").alias("detail")
    )


def plan_faults(ops: DataFrame, reserved: names.ReservedNames = names.RESERVED) -> DataFrame:
    """Paths, move evidence, and duplicate or overlapping mutations of executable operations."""
    run = ops.where(~F.col("action").isin("conflict", "note"))
    a, frm = F.col("action"), F.col("from")
    move = a == "move"
    p = F.col("path")
    body = text.digest_body("hash")
    has_from = move & frm.isNotNull()
    rows = _faults(
        run,
        [
            ("unsafe operation path", text.path_fault("path").isNotNull(), p, text.path_fault("path")),
            ("operation path is reserved", names.is_internal_path("path", reserved), p, F.lit("")),
            ("move is missing its source path", move & frm.isNull(), p, F.lit("")),
            ("unsafe move source path", has_from & text.path_fault("from").isNotNull(), frm, text.path_fault("from")),
            ("move source path is reserved", has_from & names.is_internal_path("from", reserved), frm, F.lit("")),
            ("move source and destination are identical", has_from & (frm == p), frm, F.lit("")),
            ("move has no source-size evidence", has_from & F.col("size").isNull(), frm, F.lit("")),
            (
                "move has no content, time or link evidence",
                has_from & F.col("hash").isNull() & F.col("mtime_ms").isNull() & F.col("link").isNull(), frm, F.lit(""),
            ),
            ("move has an invalid content digest", has_from & F.col("hash").isNotNull() & ~text.is_digest(body), frm, F.col("hash")),
            ("move carries both file and link evidence", has_from & F.col("link").isNotNull() & F.col("hash").isNotNull(), frm, F.lit("")),
        ],
    )
    mutations = run.where(a.isin(MUTATING)).groupBy("side", "path").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((a == "update") & frm.isNull()).alias("updates")
    )
    sources = run.where(has_from).groupBy("side", F.col("from").alias("path")).agg(F.count(F.lit(1)).alias("moves"))
    subject = F.concat_ws(":", "side", "path")
    twice = mutations.where("n > 1").select(
        F.lit("duplicate mutation").alias("rule"), subject.alias("subject"), F.col("n").cast("string").alias("detail")
    )
    moved_twice = sources.where("moves > 1").select(
        F.lit("duplicate move source").alias("rule"), subject.alias("subject"), F.col("moves").cast("string").alias("detail")
    )
    # One update may re-create the name a single move has just freed; anything else on that name is refused.
    overlap = sources.join(mutations, ["side", "path"]).where("not (moves = 1 and n = 1 and updates = 1)").select(
        F.lit("move source is also mutated").alias("rule"), subject.alias("subject"), F.col("n").cast("string").alias("detail")
    )
    return rows.unionByName(twice).unionByName(moved_twice).unionByName(overlap)


def name_rule_faults(ops: DataFrame, source_rules: str, target_rules: str) -> DataFrame:
    """Names that endanger a Windows root at execution time."""
    run = ops.where(~F.col("action").isin("conflict", "note"))
    on_target = F.col("side") == "target"
    executing = F.when(on_target, F.lit(target_rules)).otherwise(F.lit(source_rules))
    reading = F.when(on_target, F.lit(source_rules)).otherwise(F.lit(target_rules))
    named = run.select("side", "action", F.explode(F.array_compact(F.array("path", "from"))).alias("name"))
    judged = named.withColumn("_f", names.windows_fault("name")).where("_f is not null")
    h = names.hazards(F.col("_f.fault"), F.col("action"), executing, reading, "windows")
    where = F.when(h["executing"] & h["reading"], "executing and reading").when(h["executing"], "executing").otherwise("reading")
    return judged.where(h["executing"] | h["reading"]).select(
        F.concat(F.lit("unsafe on the "), where, F.lit(" root")).alias("rule"), F.col("name").alias("subject"), F.col("_f.reason").alias("detail")
    )


def attestation_faults(stated: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Header facts that differ from the values recomputed from both inventories; one row each."""
    common = [c for c in stated.columns if c in recomputed.columns]
    as_rows = lambda df, name: df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("fact"), F.col(c).cast("string").alias(name)) for c in common])).alias("_r")
    ).select("_r.*")
    both = as_rows(stated, "stated").join(as_rows(recomputed, "actual"), "fact")
    return both.where(~F.col("stated").eqNullSafe(F.col("actual"))).select(
        F.lit("stated value differs").alias("rule"), F.col("fact").alias("subject"),
        F.concat_ws(" vs ", F.coalesce("stated", F.lit("null")), F.coalesce("actual", F.lit("null"))).alias("detail"),
    )


def evidence_faults(plan: DataFrame, derived: DataFrame) -> DataFrame:
    """Retained per-row evidence that does not match what the inventories give."""
    d = derived.select("op_index", F.col("src").alias("_s"), F.col("dst").alias("_d"))
    joined = plan.join(d, "op_index", "left")
    wrong = ~(F.col("src").eqNullSafe(F.col("_s")) & F.col("dst").eqNullSafe(F.col("_d")))
    return joined.where(wrong).select(
        F.lit("retained evidence differs").alias("rule"), F.col("path").alias("subject"), F.col("op_index").cast("string").alias("detail")
    )


def set_disagreements(required: DataFrame, manifest: DataFrame, members: DataFrame) -> DataFrame:
    """Payload paths that plan, manifest and package members do not all name."""
    tag = lambda df, name: df.select("path").distinct().withColumn(name, F.lit(True))
    joined = tag(required, "p").join(tag(manifest, "m"), "path", "full_outer").join(tag(members, "t"), "path", "full_outer")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    fault = F.when(has("p") != has("m"), "plan and manifest disagree").when(has("m") != has("t"), "manifest and members disagree")
    detail = F.concat_ws(",", F.when(has("p"), "plan"), F.when(has("m"), "manifest"), F.when(has("t"), "members"))
    return joined.withColumn("rule", fault).where("rule is not null").select("rule", F.col("path").alias("subject"), detail.alias("detail"))


def package_faults(ops: DataFrame, manifest: DataFrame, members: DataFrame) -> DataFrame:
    """Package rules: target-only executable plan, unique payload, digests, kinds and sizes.

    `manifest`: path, size, hash, kind, base_hash, blob_hash, recipe (array of source, off, len).
    `members`: path, size of what the package really carries.
    """
    a = F.col("action")
    plan_rows = _faults(
        ops,
        [
            ("operation cannot execute on the target", (F.col("side") != "target") | a.isin("conflict", "note"), F.col("path"), a),
            ("unsafe path in package plan", text.path_fault("path").isNotNull(), F.col("path"), F.lit("")),
        ],
    )
    required = ops.where(a.isin("copy", "update") & F.col("link").isNull())
    asked_twice = required.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit("payload requested more than once").alias("rule"), F.col("path").alias("subject"), F.col("n").cast("string").alias("detail")
    )
    listed_twice = manifest.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit("manifest lists a payload twice").alias("rule"), F.col("path").alias("subject"), F.col("n").cast("string").alias("detail")
    )
    m = manifest.join(members.select("path", F.col("size").alias("_carried")), "path", "left")
    whole, delta = F.col("kind") == "whole", F.col("kind") == "delta"
    parts = [F.col(c).isNotNull() for c in ("base_hash", "blob_hash", "recipe")]
    any_part, all_parts = parts[0] | parts[1] | parts[2], parts[0] & parts[1] & parts[2]
    rebuilt = F.aggregate(F.coalesce("recipe", F.array().cast("array<struct<source:string,off:bigint,len:bigint>>")), F.lit(0).cast("bigint"), lambda acc, s: acc + s["len"])
    beyond = F.exists("recipe", lambda s: (s["source"] == "blob") & (s["off"] + s["len"] > F.col("_carried")))
    strange = F.exists("recipe", lambda s: ~s["source"].isin("base", "blob"))
    not_digest = lambda c: ~F.coalesce(text.is_digest(c), F.lit(False))
    p, blank = F.col("path"), F.lit("")
    payload = _faults(
        m,
        [
            ("hash is not a digest", not_digest("hash"), p, F.col("hash")),
            ("unknown payload kind", ~(whole | delta), p, F.col("kind")),
            ("whole payload carries delta-only fields", whole & any_part, p, blank),
            ("whole payload has another size", whole & ~any_part & (F.col("_carried") != F.col("size")), p, F.col("_carried")),
            ("delta payload is incomplete", delta & ~all_parts, p, blank),
            ("delta digest is malformed", delta & all_parts & (not_digest("base_hash") | not_digest("blob_hash")), p, blank),
            ("recipe reads beyond its blob", delta & all_parts & beyond, p, blank),
            ("recipe has an unknown source", delta & all_parts & strange, p, blank),
            ("recipe reconstructs another size", delta & all_parts & (rebuilt != F.col("size")), p, rebuilt),
        ],
    )
    out = plan_rows
    for part in (asked_twice, listed_twice, payload, set_disagreements(required, manifest, members)):
        out = out.unionByName(part)
    return out


def reviewable_subplan(ops: DataFrame) -> DataFrame:
    """What a package carries: executable rows of the target side."""
    return ops.where((F.col("side") == "target") & ~F.col("action").isin("conflict", "note"))


def header_counts(ops: DataFrame) -> DataFrame:
    return ops.agg(F.count(F.lit(1)).alias("op_count"), F.count_if(F.col("action") == "conflict").alias("conflict_count"))
