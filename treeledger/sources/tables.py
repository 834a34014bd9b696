"""Inventory tables: JSON lines in and out, Parquet, scanning a file tree, migrating old archives."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.masks import PathFilter
from ..operators import inventory as inv
from ..operators.validate import TABLE_SCHEMA
from ..schema import ENTRY, HEADER, PLAN_HEADER
from .scan import base_matches, local_path, located, walk_tree

LEGACY_SCHEMA = 1
CASE_PROPERTY = "treeledger.case_insensitive"
# Bytes of a file that are held at once while it is hashed.
PIECE = 8 * 1024 * 1024


def _is_header(line: Column) -> Column:
    return F.get_json_object(line, "$.schema").isNotNull()


def read_table_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with `is_header`; works for a single file and for a folder of parts."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.select(F.col("value").alias("line"), _is_header(F.col("value")).alias("is_header"))


def read_header(spark: SparkSession, path: str) -> DataFrame:
    lines = read_table_lines(spark, path)
    return lines.where("is_header").select(F.from_json("line", HEADER).alias("h")).select("h.*")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entry rows of a snapshot or archive table. Identity kinds of the exchange format become full / sampled."""
    lines = read_table_lines(spark, path).where("not is_header")
    e = lines.select(F.from_json("line", ENTRY).alias("e")).select("e.*")
    return e.withColumns(
        {
            "identity": _short_identity(F.col("identity")),
            "previous_identities": F.transform("previous_identities", _short_identity),
        }
    )


def _short_identity(i: Column) -> Column:
    kind = F.regexp_replace(i["kind"], "^(full|sampled)_.*$", "$1")
    return F.when(i.isNotNull(), F.struct(kind.alias("kind"), i["digest"].alias("digest")))


def line_faults(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Lines that a strict reader refuses: blank, not JSON, unknown fields, wrong kind or schema."""
    lines = read_table_lines(spark, path)
    line = F.col("line")
    allowed = lambda names: F.array(*[F.lit(n) for n in names])
    unknown = lambda names: F.size(F.array_except(F.json_object_keys(line), allowed(names))) > 0
    schema, found = F.get_json_object(line, "$.schema"), F.get_json_object(line, "$.kind")
    remedy = "rebuild it with a fresh scan" if kind == "snapshot" else "run the archive migration"
    fault = (
        F.when(F.trim(line) == "", "empty line")
        .when(F.json_object_keys(line).isNull(), "invalid JSON")
        .when(F.col("is_header") & (schema != str(TABLE_SCHEMA)), F.concat(F.lit("schema "), schema, F.lit(f" is unsupported; {remedy}")))
        .when(F.col("is_header") & (found != kind), F.concat(F.lit(f"expected a {kind} table, found "), found))
        .when(F.col("is_header") & unknown(HEADER.fieldNames()), "unknown header field")
        .when(~F.col("is_header") & unknown(ENTRY.fieldNames()), "unknown entry field")
        .when(~F.col("is_header") & ~F.coalesce(found.isin("file", "directory", "symlink"), F.lit(False)), "unknown entry kind")
    )
    return lines.withColumn("fault", fault).where("fault is not null").select("fault", "line")


def read_inventory(spark: SparkSession, path: str, kind: str = "snapshot") -> inv.Inventory:
    """A table as an inventory. Only the one header row reaches the driver."""
    head = read_header(spark, path).drop("unread_paths")
    found = head.limit(2).collect()
    if len(found) != 1 or found[0]["schema"] != TABLE_SCHEMA or found[0]["kind"] != kind:
        raise ValueError(f"{path} is not a {kind} table of schema {TABLE_SCHEMA}")
    h = found[0]
    vfs = h["vfs"]
    header = inv.Header(
        root=h["root"], host=h["host"], os=h["os"], kind=h["kind"], evidence=h["evidence"],
        name_rules=vfs["name_rules"] if vfs else None, mtime_precision_ms=vfs["mtime_precision_ms"] or 0 if vfs else 0,
        excluded_dirs=h["excluded_dirs"] or 0, excluded_files=h["excluded_files"] or 0, walk_errors=h["walk_errors"] or 0,
        walk_err_samples=h["walk_err_samples"] or [], icloud_stubs=h["icloud_stubs"] or 0,
        icloud_stub_samples=h["icloud_stub_samples"] or [],
    )
    unread = read_header(spark, path).select(F.explode("unread_paths").alias("path"))
    return inv.Inventory(read_entries(spark, path), header, unread)


def write_table(header: DataFrame, entries: DataFrame, path: str) -> None:
    """JSON lines in path order: `path/header` holds the header row, `path/entries` the range-sorted parts."""
    _lines(header).write.text(f"{path}/header")
    fields = [F.col(c) for c in ENTRY.fieldNames() if c in entries.columns]
    ordered = entries.select(*fields).repartitionByRange("path").sortWithinPartitions("path")
    _lines(ordered).write.text(f"{path}/entries")


def _lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("value"))


def save_keyed(entries: DataFrame, path: str, case_insensitive: bool = True) -> None:
    """Parquet with the comparison key stored, range-partitioned and sorted by path for pruning.

    Read it as `Inventory(..., keyed_for=case_insensitive)`; without that the key is made anew.
    """
    keyed = text.with_key(entries, case_insensitive)
    keyed.repartitionByRange("path").sortWithinPartitions("path").write.parquet(path)


def save_bucketed(entries: DataFrame, table: str, buckets: int, case_insensitive: bool = True) -> DataFrame:
    """Save an inventory as a table bucketed and sorted on (kind, key), first spelling per key only.

    Two inventories saved with the same bucket count compare without any exchange. The dropped spellings
    are returned; they are what the comparison would have noted as twins.
    """
    keyed = text.with_key(entries, case_insensitive)
    names = entries.columns
    first = keyed.groupBy("kind", "key").agg(F.min_by(F.struct(*names), F.col("path")).alias("e")).select("kind", "key", *[F.col(f"e.{c}").alias(c) for c in names if c != "kind"])
    first.repartition(buckets, "kind", "key").write.mode("overwrite").bucketBy(buckets, "kind", "key").sortBy("kind", "key").format("parquet").saveAsTable(table)
    entries.sparkSession.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{CASE_PROPERTY}' = '{str(case_insensitive).lower()}')")
    return inv.later_twins(keyed)


def bucketed_inventory(spark: SparkSession, table: str, header: inv.Header | None = None) -> inv.Inventory:
    """An inventory saved by `save_bucketed`; the table's own property says which case mode its keys are in."""
    made = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}.get(CASE_PROPERTY)
    return inv.Inventory(spark.table(table), header or inv.Header(), unique_keys=True, keyed_for=made != "false")


# --- plans --------------------------------------------------------------------------------------------------


def write_plan(header: DataFrame, plan: DataFrame, path: str) -> None:
    """Plan as JSON lines, header first, rows in plan order."""
    _lines(header).write.text(f"{path}/header")
    rows = [c for c in ("op_index", "side", "action", "path", "from", "size", "mtime_ms", "hash", "link", "mode", "reason")]
    _lines(plan.select(*rows).repartitionByRange("op_index").sortWithinPartitions("op_index")).write.text(f"{path}/ops")


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """Operations with `op_index`: the stored one, or the line order of the file where none is stored."""
    from ..cluster import with_global_index
    from ..schema import OP

    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    numbered = lines.select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    ).where((F.trim("value") != "") & ~_is_header(F.col("value")))
    parsed = numbered.select(
        F.from_json("value", OP).alias("o"), F.get_json_object("value", "$.op_index").cast("bigint").alias("_stored"), "_file", "_block", "_line"
    )
    placed = with_global_index(parsed, [F.col("_stored"), F.col("_file"), F.col("_block"), F.col("_line")])
    return placed.select("op_index", "o.*")


def read_plan_header(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.where(_is_header(F.col("value"))).select(F.from_json("value", PLAN_HEADER).alias("h")).select("h.*")


def write_review_csv(rows: DataFrame, path: str) -> None:
    """Reviewed rows (twelve export columns plus `position`) as CSV lines with a byte-order mark.

    Text is quoted, numbers and times are bare. The header line is the row before the first position.
    """
    bare = {"included", "action", "side", "src_size", "src_mtime_utc", "dst_size", "dst_mtime_utc"}
    columns = [c for c in rows.columns if c != "position"]
    cells = [F.col(c).cast("string") if c in bare else _quoted(c) for c in columns]
    body = rows.select(F.col("position").cast("bigint").alias("position"), F.concat_ws(",", *cells).alias("value"))
    head = rows.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("position"), F.lit("\ufeff" + ",".join(columns)).alias("value"))
    head.unionByName(body).repartitionByRange("position").sortWithinPartitions("position").select("value").write.text(path)


def _quoted(c: str) -> Column:
    return F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))


# --- scanning ---------------------------------------------------------------------------------------------------


def list_tree(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, size, mtime_ms, location) of every file below a root, empty ones too. Content is not read, links aren't followed."""
    files = walk_tree(spark, root).entries.where("kind = 'file'")
    if pattern:
        files = files.where(base_matches(pattern))
    return located(files.select("path", "size", "mtime_ms"), root)


def scan_tree(
    spark: SparkSession, root: str, evidence: str = "full", keep: PathFilter | None = None, cache: DataFrame | None = None,
    corrections: DataFrame | None = None,
) -> DataFrame:
    """File rows of a tree at an evidence tier; `scan_inventory` has its folders, links and unread areas as well."""
    return _file_entries(walk_tree(spark, root, keep).entries, root, evidence, cache, corrections)


def scan_inventory(
    spark: SparkSession, root: str, evidence: str = "full", keep: PathFilter | None = None, cache: DataFrame | None = None,
    corrections: DataFrame | None = None, links: bool = True, **header,
) -> inv.Inventory:
    """The inventory of a tree: files at an evidence tier, folders, links, unread areas, and the counts in its header."""
    walk = walk_tree(spark, root, keep, links)
    others = walk.entries.where("kind <> 'file'")
    files = _file_entries(walk.entries, root, evidence, cache, corrections)
    counts = walk.accounting().first()
    head = inv.Header(
        root=root, evidence=evidence, excluded_dirs=counts["excluded_dirs"], excluded_files=counts["excluded_files"],
        walk_errors=counts["walk_errors"], walk_err_samples=list(counts["walk_err_samples"]), icloud_stubs=counts["placeholders"],
        icloud_stub_samples=list(counts["placeholder_samples"]), skipped_symlinks=counts["skipped_symlinks"],
        dataless_files=counts["dataless_files"], **header,
    )
    return inv.Inventory(files.unionByName(_as_entries(others)), head, walk.unread if counts["unread"] else None)


def _file_entries(
    entries: DataFrame, root: str, evidence: str, cache: DataFrame | None, corrections: DataFrame | None
) -> DataFrame:
    """Entry rows of a walk's files at an evidence tier (none, sampled, full).

    Names, sizes and times are listed first; filters, time corrections and the digest cache decide which
    files still have to be read. Only those are opened, in pieces by tasks, whatever their number and size;
    the sampled tier reads its three windows only. A file that can't be read is `unreadable`.
    """
    spark = entries.sparkSession
    found = located(entries.where("kind = 'file'"), root)
    none_yet = spark.createDataFrame([], "path string, ondisk_ms bigint, intended_ms bigint")
    found = inv.correct_mtimes(found, none_yet if corrections is None else corrections)
    sampled = evidence == "sampled"
    empty = spark.createDataFrame([], "path string, size bigint, mtime_ms bigint, identity struct<kind:string,digest:string>")
    found = inv.reuse_digests(found, empty if cache is None else cache, sampled)
    if evidence == "none":
        known = found.withColumn("identity", F.struct(F.lit("size_and_mtime").alias("kind"), F.lit(None).cast("string").alias("digest")))
        return _as_entries(known)
    hit_kind = F.when(F.lit(sampled) & (F.col("size") >= text.SAMPLE_MIN), "sampled").otherwise("full")
    hits = found.where("cached_digest is not null").withColumn("identity", F.struct(hit_kind.alias("kind"), F.col("cached_digest").alias("digest")))
    misses = found.where("cached_digest is null")
    unread = F.struct(F.lit("unreadable").alias("kind"), F.lit(None).cast("string").alias("digest"))
    hashed = hashed_files(misses, sampled).withColumn("identity", F.coalesce("_id", unread)).drop("_id")
    return _as_entries(hits).unionByName(_as_entries(hashed))


def hashed_files(files: DataFrame, sampled: bool = False, piece: int = PIECE) -> DataFrame:
    """`files` (with location and size) and `_id`, the typed digest of each one's content, null if it can't be read.

    A file is read as a stream of pieces, so its size has no limit. Locations are URIs that pyarrow's file systems open.
    """
    schema = T.StructType([*files.schema.fields, T.StructField("_id", T.StructType([T.StructField("kind", T.StringType()), T.StructField("digest", T.StringType())]))])
    kind = pa.struct([("kind", pa.string()), ("digest", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [stream_digest(x.as_py(), sampled, piece) for x in batch.column("location")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], schema.names)

    return files.repartition("location").mapInArrow(read, schema)


def stream_digest(location: str, sampled: bool = False, piece: int = PIECE) -> dict[str, str] | None:
    """The identity that `text.sampled_identity` or `text.full_digest` gives for the whole content."""
    try:
        system, path = fs.FileSystem.from_uri(quote(location, safe="/:"))
        digest = hashlib.sha256()
        with system.open_input_file(path) as f:
            size = f.size()
            if sampled and size >= text.SAMPLE_MIN:
                digest.update(size.to_bytes(8, "little"))
                for start in (0, size // 2, size - text.SAMPLE_WINDOW):
                    digest.update(f.read_at(text.SAMPLE_WINDOW, start))
                return {"kind": "sampled", "digest": digest.hexdigest()}
            while data := f.read(piece):
                digest.update(data)
            return {"kind": "full", "digest": digest.hexdigest()}
    except OSError:
        return None


def _as_entries(found: DataFrame) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    identity = F.col("identity") if "identity" in found.columns else none("struct<kind:string,digest:string>")
    return found.select(
        "kind", "path", "size", "mtime_ms", identity.alias("identity"), "file_system_id", "mode",
        none("array<struct<kind:string,digest:string>>").alias("previous_identities"), "target",
    )


# --- migration ---------------------------------------------------------------------------------------------------


def legacy_tier(entries: DataFrame, hashed: bool, declared: str | None) -> Column | str:
    """Evidence tier of a version-1 archive: declared, or inferred from its hashes (a one-row scalar)."""
    if declared is not None:
        return declared
    if not hashed:
        return "none"
    sampled = F.coalesce(F.bool_or(text.is_sampled("hash")), F.lit(False))
    return entries.agg(F.when(sampled, "sampled").otherwise("full").alias("t")).scalar()


def migrate_archive(entries: DataFrame, hashed: bool, declared: str | None = None) -> DataFrame:
    """Version-1 entry rows (path, kind, size, mtime_ms, hash, hash_failed, file_id, mode, link, prev) to the current shape.

    Adds `fault` for rows the current rules refuse; the tier is inferred over all rows.
    """
    tier = legacy_tier(entries, hashed, declared)
    e = entries.withColumn("_tier", F.lit(tier) if isinstance(tier, str) else tier)
    e = e.withColumn("kind", F.when(F.col("kind") == "dir", "directory").otherwise(F.col("kind")))
    only_files_have = (
        (F.col("size") != 0) | F.col("hash").isNotNull() | F.coalesce("hash_failed", F.lit(False))
        | F.col("file_id").isNotNull() | F.col("mode").isNotNull() | F.col("prev").isNotNull()
    )
    is_file, failed = F.col("kind") == "file", F.coalesce("hash_failed", F.lit(False))
    known = lambda h: F.struct(
        F.when(text.is_sampled(h), "sampled").otherwise("full").alias("kind"), text.digest_body(h).alias("digest")
    )
    bare = lambda kind: F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("digest"))
    identity = F.when(
        is_file, F.when(failed, bare("unreadable")).when(F.col("hash").isNotNull(), known(F.col("hash"))).otherwise(bare("size_and_mtime"))
    )
    fault = (
        F.when(text.path_fault("path").isNotNull(), text.path_fault("path"))
        .when(is_file & F.col("link").isNotNull(), "file entry carries a link target")
        .when(is_file & failed & F.col("hash").isNotNull(), "failed entry carries a hash")
        .when(is_file & F.col("hash").isNotNull() & ~text.is_digest(text.digest_body("hash")), "malformed digest")
        .when(is_file & (F.col("_tier") == "none") & F.col("hash").isNotNull(), "hash contradicts the evidence tier")
        .when(~is_file & only_files_have, "entry contains file-only fields")
        .when((F.col("kind") == "directory") & F.col("link").isNotNull(), "entry contains file-only fields")
        .when((F.col("kind") == "symlink") & F.col("link").isNull(), "symlink entry has no target")
    )
    return e.select(
        "kind", "path", F.when(is_file, F.col("size")).alias("size"), "mtime_ms", identity.alias("identity"),
        F.when(is_file, F.col("file_id")).alias("file_system_id"), F.when(is_file, F.col("mode")).alias("mode"),
        F.when(is_file, F.transform(F.coalesce("prev", F.array().cast("array<string>")), known)).alias("previous_identities"),
        F.when(F.col("kind") == "symlink", F.col("link")).alias("target"), F.col("_tier").alias("evidence"), fault.alias("fault"),
    )


# --- result store -----------------------------------------------------------------------------------------------


def append_result(result: DataFrame, path: str) -> None:
    """Append immutable compare results (job_id, target_index, revision, sequence, …), partitioned by job."""
    result.write.mode("append").partitionBy("job_id").parquet(path)


def next_sequence(spark: SparkSession, path: str, job_id: str) -> int:
    """The publication number after the newest one of a job; reads that job's partition only."""
    row = spark.read.parquet(path).where(F.col("job_id") == job_id).agg(F.max("sequence").alias("s")).first()
    return 1 if row["s"] is None else row["s"] + 1


def publish(result: DataFrame, path: str, job_id: str) -> int:
    """Append one job's compare results under a publication number of their own, and return it.

    The number is claimed by creating a file of that name, which only one writer can; a writer that finds it taken goes on
    with the next one. Each publication is a folder of its own, so that writers don't meet; a writer that dies after its claim
    leaves a number without results, which readers never see. A store is written by `publish` alone or `append_result` alone.
    """
    spark = result.sparkSession
    number = newest_claim(spark, path, job_id) + 1
    while not claim(spark, f"{_claims(path, job_id)}/{number:020d}"):
        number += 1
    result.drop("job_id", "sequence").write.parquet(f"{path.rstrip('/')}/job_id={quote(job_id, safe='')}/sequence={number}")
    return number


def _claims(path: str, job_id: str) -> str:
    # Outside the result folder's partitions: names with a leading underscore are not data.
    return f"{path.rstrip('/')}/_claims/{quote(job_id, safe='')}"


def newest_claim(spark: SparkSession, path: str, job_id: str) -> int:
    """The largest number that a writer of the job has claimed, 0 before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_claims(path, job_id))
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return 0
    names = (f.getPath().getName() for f in system.listStatus(folder))
    return max((int(n) for n in names if n.isdigit()), default=0)


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file unless it is there; of several writers, one is told True.

    Hadoop stores refuse to create over an existing file. The local file system is asked itself, as Hadoop's view of it looks
    first and creates then.
    """
    local = local_path(path)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            os.close(os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False).close()
    except Py4JJavaError as refused:
        if "AlreadyExists" in str(refused.java_exception):
            return False
        raise
    return True
