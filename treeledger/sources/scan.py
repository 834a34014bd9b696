"""Walking a file tree: folders are listed by tasks, one level of the tree per round; masks decide what is listed at all."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import cut_lineage
from ..functions import rows as row_rules
from ..functions import text
from ..functions.masks import PathFilter, folded_path

LISTED = (
    "kind string, path string, size bigint, mtime_ms bigint, mode int, file_system_id string, target string, "
    "dataless boolean, fault string"
)
#: Rows of a folder that are held at once.
BATCH = 4096
SAMPLES = 5
#: The flag of a file whose content isn't on this disk, on systems that have one.
DATALESS = 0x40000000
#: Folders of a round per task, at most; a round never has more tasks than TASKS times the cluster's cores.
TASKS = 4


@dataclass
class Walk:
    """What a walk found. `entries`: kind (file, directory, symlink), path, size, mtime_ms, mode, file_system_id, target,
    dataless. `unread`: paths whose content may well be there but can't be observed. `errors`: path and fault of entries that
    were listed and are gone, or whose name isn't Unicode. `left_out`: kind and path of what the masks leave out, folders
    counted once and not entered; links if they aren't wanted."""

    entries: DataFrame
    unread: DataFrame
    errors: DataFrame
    left_out: DataFrame

    def accounting(self) -> DataFrame:
        """One row of counts, with up to SAMPLES samples in path order."""
        stub = (F.col("kind") == "file") & row_rules.is_cloud_placeholder()
        kind, gone = F.col("kind"), F.col("why") == "masks"
        counts = self.entries.agg(
            *[F.count_if(kind == k).alias(n) for k, n in (("file", "files"), ("directory", "directories"), ("symlink", "symlinks"))],
            F.count_if("dataless").alias("dataless_files"), F.count_if(stub).alias("placeholders"),
        )
        left = self.left_out.agg(
            F.count_if(gone & (kind == "directory")).alias("excluded_dirs"), F.count_if(gone & (kind != "directory")).alias("excluded_files"),
            F.count_if(F.col("why") == "links").alias("skipped_symlinks"),
        )
        return (
            counts.crossJoin(F.broadcast(left))  # one row each
            .withColumn("walk_errors", self.errors.agg(F.count(F.lit(1))).scalar())
            .withColumn("unread", self.unread.agg(F.count(F.lit(1))).scalar())
            .withColumn("placeholder_samples", _samples(self.entries.where(stub & ~F.col("dataless")), F.col("path")))
            .withColumn("walk_err_samples", _samples(self.errors, F.concat_ws(": ", "path", "fault")))
        )


def _samples(found: DataFrame, shown: Column) -> Column:
    first = found.select(shown.alias("s")).orderBy("s").limit(SAMPLES)
    return first.agg(F.sort_array(F.collect_list("s")).alias("s")).scalar()


def local_path(root: str) -> str | None:
    """The path of a root that the tasks' own file system has; None for other stores."""
    parts = urlsplit(root)
    return root if not parts.scheme else unquote(parts.path) if parts.scheme == "file" else None


def _row(kind: str, path: str, fault: str | None = None, **more) -> dict:
    return {"kind": kind, "path": path, "fault": fault, **more}


def list_folder(root: str, folder: str) -> Iterator[dict]:
    """The rows of one folder; a folder that can't be listed is `unread`, one that is gone an `error`."""
    here = local_path(root)
    if here is None:
        yield from _list_store(root, folder)
        return
    try:
        with os.scandir(os.path.join(here, folder)) as found:
            for entry in found:
                yield _seen(entry, folder)
    except FileNotFoundError as gone:
        yield _row("error" if folder else "unread", folder, gone.strerror)
    except OSError as closed:
        yield _row("unread", folder, closed.strerror)


def _seen(entry: os.DirEntry, folder: str) -> dict:
    path = f"{folder}/{entry.name}" if folder else entry.name
    try:
        path.encode()
    except UnicodeEncodeError:
        return _row("error", path.encode(errors="replace").decode(), "the name is not valid Unicode")
    try:
        found = entry.stat(follow_symlinks=False)
        target = os.readlink(entry.path) if stat.S_ISLNK(found.st_mode) else None
    except FileNotFoundError as gone:
        return _row("error", path, gone.strerror)
    except OSError as closed:
        return _row("unread", path, closed.strerror)
    mtime = max(0, found.st_mtime_ns // 1_000_000)
    if stat.S_ISDIR(found.st_mode):
        return _row("directory", path, mtime_ms=mtime)
    if target is not None:
        return _row("symlink", path, mtime_ms=mtime, target=target.encode(errors="replace").decode())
    away = bool(getattr(found, "st_flags", 0) & DATALESS)
    return _row(
        "file", path, size=found.st_size, mtime_ms=mtime, mode=stat.S_IMODE(found.st_mode),
        file_system_id=f"{found.st_dev}:{found.st_ino}", dataless=away,
    )


def _list_store(root: str, folder: str) -> Iterator[dict]:
    """The same from a store that pyarrow opens; it has no links and no modes."""
    try:
        system, base = fs.FileSystem.from_uri(root)
        found = system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base))
    except FileNotFoundError as gone:
        yield _row("error" if folder else "unread", folder, str(gone))
        return
    except OSError as closed:
        yield _row("unread", folder, str(closed))
        return
    for x in found:
        path = f"{folder}/{x.base_name}" if folder else x.base_name
        mtime = max(0, x.mtime_ns // 1_000_000) if x.mtime_ns is not None else 0
        if x.type == fs.FileType.Directory:
            yield _row("directory", path, mtime_ms=mtime)
        else:
            yield _row("file", path, size=x.size, mtime_ms=mtime, dataless=False)


def list_folders(folders: DataFrame, root: str) -> DataFrame:
    """Rows (LISTED) of every folder in `folders` (path), in tasks; a folder's rows are passed on in batches, whatever their number."""
    schema = pa.schema([
        ("kind", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("mtime_ms", pa.int64()), ("mode", pa.int32()),
        ("file_system_id", pa.string()), ("target", pa.string()), ("dataless", pa.bool_()), ("fault", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for row in list_folder(root, folder):
                    held.append(row)
                    if len(held) >= BATCH:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
        yield pa.RecordBatch.from_pylist(held, schema)

    return folders.select("path").mapInArrow(run, LISTED)


def walk_tree(spark: SparkSession, root: str, keep: PathFilter | None = None, links: bool = True) -> Walk:
    """Everything below `root`: files (also empty ones), folders, links with their target's text, and what can't be read.

    `root` is a path or URI that all executors see. A round lists the folders that the round before found and the masks let
    it enter, dealt over tasks by path; the driver only learns how many there are. The rounds are as many as the tree is deep.
    Links are never followed. A root that can't be listed is an error: nothing could be told from it.
    """
    root = root.rstrip("/") or "/"
    frontier, number, rounds = spark.createDataFrame([("",)], "path string"), 1, []
    most = TASKS * spark.sparkContext.defaultParallelism
    while number:
        listed = folded_path(list_folders(frontier.repartition(min(number, most), "path"), root))
        if keep is None:
            file_ok, enters, descends = F.lit(True), F.lit(True), F.lit(True)
        else:
            enters, descends = (keep.passes_directory()[x] for x in ("enters", "descends"))
            file_ok = keep.passes_file()
        folder, link = F.col("kind") == "directory", F.col("kind") == "symlink"
        why = (
            F.when(folder & ~descends, "masks").when(folder & ~enters, "passed through").when(folder, None)
            .when(F.col("kind").isin("file", "symlink") & ~file_ok, "masks").when(link & F.lit(not links), "links")
            .when((F.col("kind") == "unread") & (F.col("path") != "") & ~file_ok & ~descends, "out of scope")
        )
        listed = cut_lineage(listed.withColumn("why", why).withColumn("enter", folder & descends).drop("folded"))
        if not rounds and (closed := listed.where("kind = 'unread' and path = ''").first()):
            raise OSError(f"can't list {root}: {closed['fault']}")
        rounds.append(listed)
        frontier = listed.where("enter").select("path")
        number = frontier.count()
    found = rounds[0]
    for later in rounds[1:]:
        found = found.unionByName(later)
    entries = found.where("why is null and kind in ('file', 'directory', 'symlink')").select(
        "kind", "path", "size", "mtime_ms", "mode", "file_system_id", "target", F.coalesce("dataless", F.lit(False)).alias("dataless")
    )
    return Walk(
        entries, found.where("why is null and kind = 'unread'").select("path"), found.where("kind = 'error'").select("path", "fault"),
        found.where("why in ('masks', 'links')").select("kind", "path", "why"),
    )


def located(files: DataFrame, root: str) -> DataFrame:
    """`files` and `location`, the URI-like name that `tables.hashed_files` opens."""
    here = local_path(root)
    base = root if here is None else "file://" + os.path.abspath(here)
    return files.withColumn("location", F.concat(F.lit(base.rstrip("/") + "/"), F.col("path")))


def base_matches(pattern: str) -> Column:
    """Whether the base name matches a glob of `*` and `?`."""
    import re

    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return text.base_name("path").rlike(rf"(?s)\A{body}\z")
