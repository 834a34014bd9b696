"""Run artifacts: reading log lines, normalising them, routing events to artifact files, record migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rows, text
from ..schema import EVENT, OP, RUN_RECORD

# Artifact kind -> file name inside a run folder.
ARTIFACTS = {
    "summary": "summary.json", "run": "run.jsonl", "errors": "errors.jsonl", "items": "items.jsonl", "plan": "plan.jsonl",
}
# A bucket of a batch with more lines than this is written by several tasks.
BUCKET_LINES, BUCKET_SALTS = 1_000_000, 16
INDEX_FILES = 8
OUTCOMES = {"ok": "✓ ok", "failed": "✗ failed", "kept": "⊘ kept", "cancelled": "■ not run"}


def read_artifact_lines(spark: SparkSession, root: str, artifact: str) -> DataFrame:
    """(run_id, line) of one artifact kind over all run folders, split by Spark as text."""
    lines = spark.read.option("pathGlobFilter", ARTIFACTS[artifact]).option("recursiveFileLookup", "true").text(root)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return lines.select(folder.alias("run_id"), F.col("value").alias("line"))


def artifact_lines(spark: SparkSession, root: str, run_id: str, artifact: str, max_lines: int) -> DataFrame:
    """The first lines of one run's artifact file, in file order."""
    lines = spark.read.text(f"{root}/{run_id}/{ARTIFACTS[artifact]}")
    # A large file is split; its blocks are in order of their begin, and a block's lines in the order they are read.
    placed = lines.select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    return placed.orderBy("_b", "_i").limit(max_lines).select("line")


def read_run_records(spark: SparkSession, path: str) -> DataFrame:
    """The run index: one record per line, other schema versions refused by `run_record_faults`."""
    return spark.read.schema(RUN_RECORD).option("mode", "PERMISSIVE").json(path)


def run_record_faults(records: DataFrame) -> DataFrame:
    fault = (
        F.when(F.col("schema").isNull() | (F.col("schema") != 2), "unsupported record schema")
        .when(~F.coalesce(F.col("record_id").rlike("^[0-9a-f]+$"), F.lit(False)), "record id is not lower-case hex")
        .when(F.col("subject.job_name").isNull(), "record has no job name")
        .when((F.col("kind") == "compare") & (F.col("artifacts.kind") != "summary_only"), "compare record names detail artifacts")
    )
    return records.withColumn("fault", fault).where("fault is not null")


def migrate_run_records(legacy: DataFrame, jobs: DataFrame) -> DataFrame:
    """Version-1 records to nested ones. Jobs (job_name, job_id) bind by name; contradictory records get `fault`."""
    compare = F.col("kind") == "compare"
    has_run, has_file = F.col("run_id").isNotNull(), F.col("detail").isNotNull()
    artifact = (
        F.when(has_run & ~compare, "directory").when(has_file & ~compare, "legacy_file")
        .when(~has_run & ~has_file & compare, "summary_only").when(~has_run & ~has_file, "unavailable")
    )
    fault = F.when(has_run & has_file, "names both a run directory and a flat detail file").when(
        compare & (has_run | has_file), "compare record unexpectedly names detail artifacts"
    )
    bound = F.col("job_id").isNotNull()
    return legacy.join(jobs, legacy["job"] == jobs["job_name"], "left").select(
        F.lit(2).cast("bigint").alias("schema"), "record_id", "ts_ms",
        F.struct(
            F.col("job").alias("job_name"),
            F.struct(F.when(bound, "registered").otherwise("legacy_unbound").alias("kind"), F.col("job_id")).alias("binding"),
            F.when(bound, F.lit(0).cast("bigint")).alias("target_index"),
        ).alias("subject"),
        "kind", "done", "skipped", "errors", "bytes", "elapsed_ms", "cancelled",
        F.struct(artifact.alias("kind"), F.when(artifact == "directory", F.col("run_id")).alias("run_id"),
                 F.when(artifact == "legacy_file", F.col("detail")).alias("file_name")).alias("artifacts"),
        "warnings", "ops_found", "finished", fault.alias("fault"),
    )


def event_routes(minimum_level: str = "info") -> Column:
    """Artifact files an event belongs to: progress nowhere, item results apart, errors and warnings twice."""
    kind = F.col("kind")
    return (
        F.when(kind == "progress", F.array().cast("array<string>"))
        .when((kind == "log") & ~rows.level_at_least("level", minimum_level), F.array().cast("array<string>"))
        .when(kind == "item_result", F.array(F.lit("items")))
        .when((kind == "error") | ((kind == "log") & rows.level_at_least("level", "warn")), F.array(F.lit("run"), F.lit("errors")))
        .otherwise(F.array(F.lit("run")))
    )


def routed(events: DataFrame, minimum_level: str = "info") -> DataFrame:
    """One row per event and artifact file."""
    return events.withColumn("artifact", F.explode(event_routes(minimum_level)))


def write_routed(events: DataFrame, root: str, minimum_level: str = "info") -> None:
    """Append events as JSON lines, one folder per run and artifact kind."""
    body = F.to_json(F.struct(*[c for c in events.columns if c != "run_id"]), {"ignoreNullFields": "true"})
    routed(events, minimum_level).select("run_id", "artifact", body.alias("value")).write.mode("append").partitionBy(
        "run_id", "artifact"
    ).text(root)


def write_routed_buckets(events: DataFrame, root: str, batch: int, buckets: int = 64, minimum_level: str = "info") -> None:
    """One batch of routed events as at most `buckets` files and their index, however many runs it holds.

    A bucket's file is sorted by run, artifact and position; the index names, for every artifact of the batch, how many lines
    it has. A batch that is written again replaces itself. `read_routed` finds an artifact through the index alone.
    """
    body = F.to_json(F.struct(*[c for c in events.columns if c != "run_id"]), {"ignoreNullFields": "true"})
    bucket = F.pmod(F.xxhash64("run_id", "artifact"), F.lit(buckets)).cast("int")
    lines = routed(events, minimum_level).select("run_id", "artifact", "seq", body.alias("value")).withColumn("bucket", bucket).persist()
    # Buckets are dealt with a salt, so that one run's flood is no single task; its lines meet again in one bucket folder.
    salt = F.pmod(F.xxhash64("seq", "value"), F.lit(BUCKET_SALTS))
    many = lines.groupBy("bucket").count().where(F.col("count") > BUCKET_LINES).select("bucket").withColumn("_wide", F.lit(True))
    dealt = lines.join(F.broadcast(many), "bucket", "left").withColumn("_salt", F.when(F.col("_wide"), salt).otherwise(0))
    sorted_ = dealt.repartition(buckets, "bucket", "_salt").sortWithinPartitions("bucket", "run_id", "artifact", "seq")
    sorted_.drop("_wide", "_salt").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/lines/batch={batch}")
    held = lines.groupBy("bucket", "run_id", "artifact").agg(F.count(F.lit(1)).alias("lines"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    held.repartition(INDEX_FILES, "bucket").sortWithinPartitions("bucket", "run_id", "artifact").write.mode("overwrite").parquet(f"{root}/index/batch={batch}")
    lines.unpersist()


def read_routed(spark: SparkSession, root: str, run_id: str, artifact: str, buckets: int = 64) -> DataFrame:
    """seq, value of one run's artifact, in order of seq; only the batches and the bucket that hold it are opened."""
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(run_id), F.lit(artifact)), F.lit(buckets)).cast("int")).first()[0]
    own = (F.col("bucket") == bucket) & (F.col("run_id") == run_id) & (F.col("artifact") == artifact)
    batches = [r["batch"] for r in spark.read.parquet(f"{root}/index").where(own).select("batch").distinct().collect()]
    schema = "run_id string, artifact string, seq bigint, value string"
    if not batches:
        return spark.createDataFrame([], schema).select("seq", "value")
    rows = spark.read.schema(schema).parquet(*[f"{root}/lines/batch={b}/bucket={bucket}" for b in sorted(batches)])
    return rows.where((F.col("run_id") == run_id) & (F.col("artifact") == artifact)).select("seq", "value").orderBy("seq", "value")


# --- log lines ----------------------------------------------------------------------------------------------


def parse_log_lines(lines: DataFrame, view: str, line: str = "line") -> DataFrame:
    """Any artifact line to (ts_ms, level, scope, message, search). `view` is run, errors, items or plan.

    Text that is not JSON becomes a legacy row; malformed or incomplete records become error rows.
    """
    fields = ["kind", "phase", "label", "path", "action", "side", "level", "scope", "message", "outcome", "status"]
    numbers = ["ts_ms", "items_total", "items_done", "bytes_total", "bytes_done", "bytes", "ms", "paused_ms", "done", "skipped", "errors", "elapsed_ms"]
    schema = ", ".join([f"{f} string" for f in fields] + [f"{n} bigint" for n in numbers] + ["cancelled boolean", "reset boolean", "op string", "_bad string"])
    raw = F.col(line)
    decoded = F.from_json(raw, schema, {"columnNameOfCorruptRecord": "_bad"})
    looks_json = raw.rlike(r"^\s*[\[{]")
    is_object = raw.rlike(r"^\s*\{")
    j = F.col("_j")
    need = lambda *names: _missing(j, names)
    kind = j["kind"]

    def row(level, scope, message, search=None, ts=None):
        m = message
        return F.struct(
            (j["ts_ms"] if ts is None else ts).cast("bigint").alias("ts_ms"), level.alias("level"), scope.alias("scope"),
            m.alias("message"), (m if search is None else search).alias("search"),
        )

    lit = F.lit
    event_missing = (
        F.when(kind == "log", need("level", "scope", "message")).when(kind == "error", need("phase", "action", "path", "side", "message"))
        .when(kind == "item_result", need("outcome", "action", "path", "side", "bytes", "ms"))
        .when(kind == "phase_start", need("phase", "items_total", "bytes_total"))
        .when(kind == "totals", need("phase", "items_total", "bytes_total", "items_done", "bytes_done", "reset"))
        .when(kind == "phase_end", need("phase", "status", "items_done", "items_total", "bytes_done", "bytes_total"))
        .when(kind == "resumed", need("paused_ms")).when(kind == "summary", need("done", "skipped", "errors", "bytes_done", "elapsed_ms", "paused_ms", "cancelled"))
    )
    outcome = None
    for k, v in OUTCOMES.items():
        outcome = F.when(j["outcome"] == k, lit(v)) if outcome is None else outcome.when(j["outcome"] == k, lit(v))
    n = lambda c: c.cast("string")
    error_text = F.concat(j["action"], lit(" "), j["path"], lit(" ("), j["side"], lit("): "), j["message"])
    item_text = F.concat(
        outcome, lit("  "), j["action"], lit(" "), j["path"], lit("  "), text.human_bytes(j["bytes"]),
        F.when(j["ms"] > 0, F.concat(lit(" · "), n(j["ms"]), lit("ms"))).otherwise(""),
    )
    mark = F.when(j["status"] == "completed", "✓").when(j["status"] == "cancelled", "■").when(j["status"] == "failed", "✕")
    summary_text = F.concat(
        lit("■ Done: "), n(j["done"]), lit(" run, "), n(j["skipped"]), lit(" skipped, "), n(j["errors"]), lit(" errors · "),
        text.human_bytes(j["bytes_done"]), lit(" · "), F.format_string("%.1f", j["elapsed_ms"] / 1000), lit("s"),
        F.when(j["cancelled"], " · cancelled").otherwise(""),
    )
    parsed = (
        F.when(
            (kind == "log") & j["level"].isin("info", "warn", "error"),
            row(j["level"], j["scope"], j["message"], F.concat(j["scope"], lit(" "), j["message"])),
        )
        .when(kind == "error", row(lit("error"), j["phase"], error_text))
        .when(
            (kind == "item_result") & outcome.isNotNull(),
            row(
                F.when(j["outcome"] == "failed", "error").when(j["outcome"] == "ok", "info").otherwise("warn"), j["side"],
                item_text, F.concat(j["path"], lit(" "), item_text),
            ),
        )
        .when(
            kind == "phase_start",
            row(lit("info"), lit("phase"), F.concat(lit("▶ "), j["phase"], F.when(F.coalesce(j["label"], lit("")) != "", F.concat(lit("  "), j["label"])).otherwise(""))),
        )
        .when(
            kind == "totals",
            row(lit("info"), lit("phase"), F.concat(lit("Totals · "), j["phase"], lit(" · "), n(j["items_total"]), lit(" items · "), text.human_bytes(j["bytes_total"]))),
        )
        .when(
            (kind == "phase_end") & mark.isNotNull(),
            row(F.when(j["status"] == "failed", "error").otherwise("info"), lit("phase"), F.concat(mark, lit(" "), j["phase"], lit(" · "), j["status"])),
        )
        .when(kind == "paused", row(lit("info"), lit("control"), lit("Paused")))
        .when(kind == "resumed", row(lit("info"), lit("control"), F.concat(lit("Resumed after "), text.human_duration(j["paused_ms"]))))
        .when(kind == "summary", row(F.when(j["errors"] > 0, "error").otherwise("info"), lit("final"), summary_text))
    )
    op = F.from_json(j["op"], OP)
    plan_text = F.concat(
        op["action"], lit("  "), op["path"], lit("  ("), op["side"], lit(")"),
        F.when(F.coalesce(op["reason"], lit("")) != "", F.concat(lit(" "), op["reason"])).otherwise(""),
    )
    plan_row = row(lit("info"), lit("plan"), plan_text, F.concat(plan_text, lit(" "), raw), F.coalesce(op["mtime_ms"], lit(0)))

    def failure(detail):
        m = F.concat(lit("Malformed JSON log record: "), detail)
        return row(lit("error"), lit("parse"), m, F.concat(m, lit(" "), raw), lit(0))

    legacy = row(lit("info"), lit("legacy"), raw, raw, lit(0))
    if view == "plan":
        absent = F.when(j["op"].isNull(), lit("missing 'op'")).otherwise(_missing(op, ("action", "path", "side")))
        body = F.when(absent.isNotNull(), failure(absent)).otherwise(plan_row)
    else:
        absent = F.coalesce(need("kind", "ts_ms"), event_missing)
        body = F.when(absent.isNotNull(), failure(absent)).when(parsed.isNotNull(), parsed).otherwise(
            failure(F.concat(lit("unsupported event kind or value '"), kind, lit("'")))
        )
    out = (
        F.when(~looks_json, legacy).when(~is_object, failure(lit("the record must be a JSON object")))
        .when(j["_bad"].isNotNull(), failure(lit("invalid JSON"))).otherwise(body)
    )
    keep = [c for c in lines.columns if c != line]
    return lines.withColumn("_j", decoded).select(*keep, out.alias("_r")).select(*keep, "_r.*")


def _missing(record: Column, names) -> Column:
    return F.coalesce(*[F.when(record[n].isNull(), F.lit(f"missing '{n}'")) for n in names], F.lit(None).cast("string"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event rows of artifact files as typed columns; unknown lines give null kinds."""
    return spark.read.schema(EVENT).json(path)
