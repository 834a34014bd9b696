"""Row types. One wide row per inventory entry; `kind` decides which columns are set."""

from __future__ import annotations

from pyspark.sql import types as T

IDENTITY = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("digest", T.StringType())]
)

ENTRY = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime_ms", T.LongType()),
        T.StructField("identity", IDENTITY),
        T.StructField("file_system_id", T.StringType()),
        T.StructField("mode", T.IntegerType()),
        T.StructField("previous_identities", T.ArrayType(IDENTITY)),
        T.StructField("target", T.StringType()),
    ]
)

VFS_NOTE = T.StructType(
    [
        T.StructField("protocol", T.StringType()),
        T.StructField("display_root", T.StringType()),
        T.StructField("mtime_precision_ms", T.LongType()),
        T.StructField("medium", T.StringType()),
        T.StructField("name_rules", T.StringType()),
        T.StructField("degraded", T.ArrayType(T.StringType())),
    ]
)

HEADER = T.StructType(
    [
        T.StructField("schema", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("root", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("os", T.StringType()),
        T.StructField("scanned_at_ms", T.LongType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("entry_count", T.LongType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("excluded_dirs", T.LongType()),
        T.StructField("excluded_files", T.LongType()),
        T.StructField("walk_errors", T.LongType()),
        T.StructField("walk_err_samples", T.ArrayType(T.StringType())),
        T.StructField("unread_paths", T.ArrayType(T.StringType())),
        T.StructField("icloud_stubs", T.LongType()),
        T.StructField("icloud_stub_samples", T.ArrayType(T.StringType())),
        T.StructField("skipped_symlinks", T.LongType()),
        T.StructField("dataless_files", T.LongType()),
        T.StructField("vfs", VFS_NOTE),
    ]
)

OP = T.StructType(
    [
        T.StructField("side", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("from", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime_ms", T.LongType()),
        T.StructField("hash", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("mode", T.IntegerType()),
        T.StructField("reason", T.StringType()),
    ]
)
OP_COLUMNS = OP.fieldNames()

PLAN_HEADER = T.StructType(
    [
        T.StructField("schema", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("generated_at_ms", T.LongType()),
        T.StructField("source_root", T.StringType()),
        T.StructField("source_host", T.StringType()),
        T.StructField("target_root", T.StringType()),
        T.StructField("target_host", T.StringType()),
        T.StructField("op_count", T.LongType()),
        T.StructField("conflict_count", T.LongType()),
        T.StructField("source_entries", T.LongType()),
        T.StructField("target_entries", T.LongType()),
        T.StructField("source_excluded", T.LongType()),
        T.StructField("target_excluded", T.LongType()),
        T.StructField("source_walk_errors", T.LongType()),
        T.StructField("target_walk_errors", T.LongType()),
        T.StructField("source_walk_err_samples", T.ArrayType(T.StringType())),
        T.StructField("target_walk_err_samples", T.ArrayType(T.StringType())),
        T.StructField("source_icloud_stubs", T.LongType()),
        T.StructField("target_icloud_stubs", T.LongType()),
        T.StructField("source_icloud_stub_samples", T.ArrayType(T.StringType())),
        T.StructField("target_icloud_stub_samples", T.ArrayType(T.StringType())),
        T.StructField("source_unread_paths", T.ArrayType(T.StringType())),
        T.StructField("target_unread_paths", T.ArrayType(T.StringType())),
        T.StructField("source_unread_entries", T.LongType()),
        T.StructField("target_unread_entries", T.LongType()),
    ]
)

SIDE_META = T.StructType(
    [T.StructField("size", T.LongType()), T.StructField("mtime_ms", T.LongType())]
)

EVENT = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("phase", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("items_done", T.LongType()),
        T.StructField("items_total", T.LongType()),
        T.StructField("bytes_done", T.LongType()),
        T.StructField("bytes_total", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("side", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("scope", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("ms", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("paused_ms", T.LongType()),
    ]
)

RUN_RECORD = T.StructType(
    [
        T.StructField("schema", T.LongType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField(
            "subject",
            T.StructType(
                [
                    T.StructField("job_name", T.StringType()),
                    T.StructField(
                        "binding",
                        T.StructType(
                            [T.StructField("kind", T.StringType()), T.StructField("job_id", T.StringType())]
                        ),
                    ),
                    T.StructField("target_index", T.LongType()),
                ]
            ),
        ),
        T.StructField("kind", T.StringType()),
        T.StructField("done", T.LongType()),
        T.StructField("skipped", T.LongType()),
        T.StructField("errors", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("elapsed_ms", T.LongType()),
        T.StructField("cancelled", T.BooleanType()),
        T.StructField(
            "artifacts",
            T.StructType(
                [
                    T.StructField("kind", T.StringType()),
                    T.StructField("run_id", T.StringType()),
                    T.StructField("file_name", T.StringType()),
                ]
            ),
        ),
        T.StructField("warnings", T.LongType()),
        T.StructField("ops_found", T.LongType()),
        T.StructField("finished", T.BooleanType()),
    ]
)
