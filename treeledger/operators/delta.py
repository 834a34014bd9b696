"""Chunk tables and what they save: content-defined chunks, recipes, patches, reassembly, ordered digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import cut_lineage, running_total

MINIMUM, AVERAGE, MAXIMUM = 16 * 1024, 64 * 1024, 256 * 1024
_WINDOW = 32
# Bytes whose hashes are worked out at once.
_PIECE = 256 * 1024
# Chunks that a task passes on together.
_ROWS = 4096
_GEAR = np.random.default_rng(20240101).integers(0, 2**63, 256, dtype=np.uint64)


def candidates(data: bytes | memoryview, minimum: int, average: int, lead: int = 0) -> np.ndarray:
    """Offsets, after the first `lead` bytes, at which a hash of the last 32 bytes has its low bits clear; in pieces of bounded size."""
    mask = np.uint64((1 << max(1, int(average - minimum).bit_length() - 1)) - 1)
    out = []
    for begin in range(lead, len(data), _PIECE):
        back = min(_WINDOW - 1, begin)
        rolling = _GEAR[np.frombuffer(data, np.uint8, min(_PIECE, len(data) - begin) + back, begin - back)]
        width = 1  # bytes that a hash covers so far
        while width < min(_WINDOW, len(rolling)):
            rolling[width:] += rolling[:-width] << np.uint64(width)
            width *= 2
        out.append(np.flatnonzero((rolling[back:] >> np.uint64(16)) & mask == 0) + (begin - lead + 1))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def boundaries(data: bytes | memoryview, minimum: int, average: int, maximum: int) -> list[int]:
    """End offsets of content-defined chunks.

    A position ends a chunk when a hash of the last 32 bytes has its low bits clear, so an edit moves only
    nearby bounds. Chunks stay within [minimum, maximum]; the last one takes what is left.
    """
    n = len(data)
    if n <= minimum:
        return [n] if n else []
    found = candidates(data, minimum, average)
    ends, start = [], 0
    while n - start > minimum:
        at = np.searchsorted(found, start + minimum)
        limit = min(start + maximum, n)
        end = int(found[at]) if at < len(found) and found[at] <= limit else limit
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunk_table(
    files: DataFrame, keys: list[str], content: str, minimum: int = MINIMUM, average: int = AVERAGE, maximum: int = MAXIMUM
) -> DataFrame:
    """(keys, position, off, len, hash) of every chunk of every file, one file's content at a time.

    A task holds a batch of contents once, as it came, and some rows of the result. A null content has no chunk.
    """
    types = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, "position", "off", "len", "hash"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, int, str]] = []

            def out() -> pa.RecordBatch:
                at, *columns = zip(*rows, strict=True)
                own = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))]
                return pa.RecordBatch.from_arrays([*own, *(pa.array(c) for c in columns)], names)

            for i, value in enumerate(batch.column(len(keys))):
                if not value.is_valid:
                    continue
                data, start = memoryview(value.as_buffer()), 0
                for position, end in enumerate(boundaries(data, minimum, average, maximum)):
                    rows.append((i, position, start, end - start, hashlib.sha256(data[start:end]).hexdigest()))
                    start = end
                    if len(rows) == _ROWS:
                        yield out()
                        rows.clear()
            if rows:
                yield out()

    body = F.col(content).cast("binary")
    return files.select(*keys, body.alias("_content")).mapInArrow(cut, f"{types}, position bigint, off bigint, len bigint, hash string")


def delta_recipe(new: DataFrame, base: DataFrame, keys: list[str], minimum_size: int = 0) -> DataFrame:
    """Recipe steps of files that have a base; `minimum_size` leaves smaller files to be sent whole, if the caller wants that.

    A chunk found in the base (first one of its hash and length) is read from there, any other goes into
    the blob at a running offset. Files without a base are sent whole and have no steps.
    """
    sizes = new.groupBy(*keys).agg(F.sum("len").alias("_size"))
    has_base = base.select(*keys).distinct()
    large = sizes.where(F.col("_size") >= minimum_size).join(has_base, keys, "left_semi").select(*keys)
    chosen = new.join(large, keys, "left_semi")
    first = base.groupBy(*keys, "hash", "len").agg(F.min_by("off", "position").alias("base_off"))
    steps = chosen.join(first, [*keys, "hash", "len"], "left")
    is_blob = F.col("base_off").isNull()
    placed = running_total(steps, keys, ["position"], F.when(is_blob, F.col("len")).otherwise(0), "_blob")
    return placed.select(
        *keys, "position", F.when(is_blob, "blob").otherwise("base").alias("source"),
        F.coalesce("base_off", "_blob").alias("off"), "len", "hash",
    )


def delta_savings(recipe: DataFrame, keys: list[str]) -> DataFrame:
    blob = F.sum(F.when(F.col("source") == "blob", F.col("len")).otherwise(0))
    return recipe.groupBy(*keys).agg(
        F.sum("len").cast("bigint").alias("size"), blob.cast("bigint").alias("blob_bytes"), F.count(F.lit(1)).alias("steps")
    ).withColumn("saved", F.col("size") - F.col("blob_bytes"))


def patch_bytes(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes an in-place update rewrites: chunks not already at the same place.

    The existing side remembers only the last chunk of each hash.
    """
    last = existing.groupBy(*keys, "hash").agg(F.max_by(F.struct("off", "len"), F.col("position")).alias("_at"))
    same = (F.col("_at.off") == F.col("off")) & (F.col("_at.len") == F.col("len"))
    return new.join(last, [*keys, "hash"], "left").groupBy(*keys).agg(
        F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(F.col("len"))).cast("bigint").alias("written_bytes"),
        F.sum("len").cast("bigint").alias("size"),
    )


def recipe_faults(recipe: DataFrame, payload: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fault) where a recipe cannot rebuild its file.

    `payload` has size and blob_size per file, `base` has base_size. Steps must be of a known source and in
    bounds, blob ranges must follow each other without gaps, and lengths must add up.
    """
    blob = F.when(F.col("source") == "blob", F.col("len")).otherwise(0)
    placed = running_total(recipe, keys, ["position"], blob, "_expected")
    joined = placed.join(payload.select(*keys, "blob_size"), keys, "left").join(base.select(*keys, "base_size"), keys, "left")
    end = F.col("off") + F.col("len")
    step_fault = (
        F.when(~F.col("source").isin("base", "blob"), "unknown source")
        .when((F.col("source") == "blob") & (end > F.col("blob_size")), "reads beyond its blob")
        .when((F.col("source") == "base") & (end > F.col("base_size")), "reads beyond its base")
        .when((F.col("source") == "blob") & (F.col("off") != F.col("_expected")), "blob ranges are not contiguous")
    )
    per_step = joined.withColumn("fault", step_fault).where("fault is not null").groupBy(*keys).agg(
        F.min_by("fault", "position").alias("fault")
    )
    totals = recipe.groupBy(*keys).agg(F.sum("len").alias("_sum"))
    sizes = payload.join(totals, keys, "left").where(F.coalesce("_sum", F.lit(0)) != F.col("size")).select(
        *keys, F.lit("reconstructs a different size").alias("fault")
    )
    return per_step.unionByName(sizes)


def reassembled_digests(recipe: DataFrame, new_chunks: DataFrame, base_chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Digest over the ordered chunk digests of each file as its recipe rebuilds it, beside the original's.

    Whole files are never gathered; equal chunk sequences give equal digests.
    """
    parts = base_chunks.select(*keys, F.col("off"), F.col("len"), F.col("hash").alias("_base_hash"))
    rebuilt = recipe.join(parts, [*keys, "off", "len"], "left").select(
        *keys, "position", F.when(F.col("source") == "base", F.col("_base_hash")).otherwise(F.col("hash")).alias("hash")
    )
    wanted = new_chunks.join(recipe.select(*keys).distinct(), keys, "left_semi")
    got = ordered_digest(rebuilt, keys, "position", F.col("hash"), "rebuilt_digest")
    return got.join(ordered_digest(wanted, keys, "position", F.col("hash"), "original_digest"), keys, "full_outer")


def ordered_digest(df: DataFrame, groups: list[str], order: str, value: Column, name: str, bucket: int = 1024) -> DataFrame:
    """Digest of an ordered list per group, in levels: rows to buckets of fixed width, buckets to one digest.

    `order` must be a dense 0-based position, so a bucket holds a bounded number of rows and the number of
    buckets shrinks by its width at every level until each group has one row left. A group that is down to one row
    keeps its digest while others go on, so a digest depends on its own list only.
    """
    level = df.select(*groups, F.col(order).alias("_o"), F.sha2(value.cast("string"), 256).alias("_d"))
    first = True
    while True:
        rows = F.array_sort(F.collect_list(F.struct("_o", "_d")))
        whole = F.sha2(F.array_join(F.transform("_r", lambda r: r["_d"]), ""), 256)
        # Only a finished group has a first bucket of one row: any other list reaches its second position.
        digest = whole if first else F.when((F.size("_r") == 1) & (F.col("_b") == 0), F.col("_r")[0]["_d"]).otherwise(whole)
        level = cut_lineage(
            level.groupBy(*groups, F.floor(F.col("_o") / bucket).alias("_b")).agg(rows.alias("_r"))
            .select(*groups, F.col("_b").alias("_o"), digest.alias("_d"))
        )
        first = False
        if level.where("_o > 0").isEmpty():
            return level.select(*groups, F.col("_d").alias(name))


def plan_digest(plan: DataFrame, columns: list[str]) -> DataFrame:
    """One digest of a plan's rows in plan order."""
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return ordered_digest(plan.withColumn("_all", F.lit(0)), ["_all"], "op_index", row, "plan_digest").drop("_all")

