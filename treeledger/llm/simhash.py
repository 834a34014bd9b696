"""SimHash near-dedup (operator 8): fingerprints within a few bits found by vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, even_lookup, first_of_repeated, identified, pick
from .components import components, forest

#: Fingerprints of a shard, as aimed at when the tree over all of them is laid out.
SHARD_ROWS = 16_384
#: The tree is laid out on so many sampled fingerprints per shard, and at most this many in all (8 MB on the driver). Every
#: fingerprint is then placed; where the sample is coarse, shards are larger and split further by their own trees.
SAMPLE_PER_SHARD = 64
SAMPLE_MOST = 1 << 20
#: Up to so many fingerprints are compared directly.
LEAF_ROWS = 768
#: Words worked off at once.
PART_WORDS = 1 << 18


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text: A-Z lower-cased, words between ASCII blanks, shingles of `width` words hashed by XXH64.

    A bit is set if it is set in over half of the shingles' hashes, repeats counted. A shorter text is one shingle; a text
    without words has fingerprint zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, total, counts = xxhash.xxh64_intdigest, len(starts), np.zeros(64, np.int64)
    for at in range(0, total, PART_WORDS):
        part = [digest(line[i:j], 42) for i, j in zip(starts[at : at + PART_WORDS], ends[at : at + PART_WORDS], strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, also: tuple[str, ...] = ()) -> DataFrame:
    """key, fp (the fingerprint as a signed long) and the columns `also` of each row."""
    rows = pick(docs, key, text, *also).toDF("key", "text", *also)
    schema = T.StructType([rows.schema["key"], T.StructField("fp", T.LongType()), *[rows.schema[c] for c in also]])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *batch.columns[2:]], schema.names)

    return rows.mapInArrow(hashed, schema)


def split(points: np.ndarray, radius: int, tries: int = 6) -> tuple[np.uint64, int] | None:
    """A vantage point and a distance that part `points` best; None if the larger side would keep nearly all.

    The inner side also gets the outer points within `radius` of the border: by the triangle inequality, two points within
    `radius` of each other on different sides are then both inner.
    """
    best = None
    for vantage in points[:: max(1, len(points) // tries)][:tries]:
        count = np.bincount(np.bitwise_count(points ^ vantage), minlength=65 + radius)
        upto = np.cumsum(count)
        cost = np.maximum(upto[radius:], len(points) - upto[: len(upto) - radius])
        at = int(np.argmin(cost[:64]))
        if best is None or cost[at] < best[0]:
            best = (int(cost[at]), vantage, at)
    return (best[1], best[2]) if best and best[0] <= 0.9 * len(points) else None


def sides(points: np.ndarray, vantage: np.uint64, border: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the inner side, with the outer points near the border, and of the outer side."""
    far = np.bitwise_count(points ^ vantage)
    return far <= border + radius, far > border


def lay_out(sample: np.ndarray, depth: int, radius: int):
    """A tree of (vantage, border, inner, outer) nodes and None leaves."""
    if depth == 0 or len(sample) < 8 or (cut := split(sample, radius)) is None:
        return None
    far = np.bitwise_count(sample ^ cut[0])
    return (*cut, lay_out(sample[far <= cut[1]], depth - 1, radius), lay_out(sample[far > cut[1]], depth - 1, radius))


def place(points: np.ndarray, tree, radius: int, shard: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, points) for every leaf that points fall in or come near to."""
    if not len(points):
        return
    if tree is None:
        yield shard, points
        return
    vantage, border, inner, outer = tree
    near, beyond = sides(points, vantage, border, radius)
    yield from place(points[near], inner, radius, 2 * shard)
    yield from place(points[beyond], outer, radius, 2 * shard + 1)


def links(points: np.ndarray, radius: int) -> np.ndarray:
    """Rows (point, another) that connect exactly the points within `radius` bits of each other, one row per linked point.

    Distinct points, split by a vantage-point tree down to leaves that are compared directly, in blocks.
    """
    found: list[np.ndarray] = []

    def descend(own: np.ndarray) -> None:
        cut = split(own, radius) if len(own) > LEAF_ROWS else None
        if cut is not None:
            for side in sides(own, *cut, radius):
                descend(own[side])
            return
        step, near = max(1, (1 << 20) // max(1, len(own))), []
        root = np.arange(len(own))
        for at in range(0, len(own), step):
            i, j = np.nonzero(np.bitwise_count(own[at : at + step, None] ^ own[None, at:]) <= radius)
            keep = i < j
            near.append(np.stack((i[keep] + at, j[keep] + at)))
            if sum(x.shape[1] for x in near) > 1 << 21:  # a dense leaf: go on with what its links come to
                root, near = _merged(root, near), []
        root = _merged(root, near)
        moved = root != np.arange(len(own))
        found.append(np.stack((own[moved], own[root[moved]]), axis=1))

    descend(points)
    pairs = np.concatenate(found) if found else np.zeros((0, 2), points.dtype)
    nodes, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(-1, 2)
    root = forest(len(nodes), at[:, 0], at[:, 1])
    moved = root != np.arange(len(nodes))
    return np.stack((nodes[moved], nodes[root[moved]]), axis=1)


def _merged(root: np.ndarray, near: list[np.ndarray]) -> np.ndarray:
    a, b = np.concatenate(near, axis=1) if near else (np.zeros(0, np.int64),) * 2
    own = np.arange(len(root))
    return forest(len(root), np.concatenate((a, own)), np.concatenate((b, root)))


def linked(fps: DataFrame, radius: int = 2, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """fp, root for every fingerprint of `fps` (distinct longs) that links to another one; root names its component.

    A tree of vantage points over a bounded sample of fingerprints deals all of them to shards; those near a border go to both
    sides, so that every pair within `radius` bits meets in a shard. Shards return what connects their points, not the pairs.
    """
    number = fps.count()
    shards = max(1, -(-number // shard_rows))
    size = min(SAMPLE_MOST, SAMPLE_PER_SHARD * shards * 4)
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(size).collect()], np.int64).view(np.uint64)
    tree = lay_out(sample, (shards - 1).bit_length(), radius)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, points in place(batch.column(0).to_numpy().view(np.uint64), tree, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(points), shard)), pa.array(points.view(np.int64))], ["shard", "fp"])

    def connected(group: pa.Table) -> pa.Table:
        pairs = links(np.sort(group.column("fp").to_numpy().view(np.uint64)), radius).view(np.int64)
        return pa.table({"a": pairs[:, 0].copy(), "b": pairs[:, 1].copy()})

    edges = fps.mapInArrow(dealt, "shard long, fp long").groupBy("shard").applyInArrow(connected, "a long, b long")
    return components(edges).toDF("fp", "root")


def _grouped(docs: DataFrame, key: str, text: str, least: Column, radius: int = 2, width: int = 3, shard_rows: int = SHARD_ROWS, also: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored rows (key, fp, `also`, row), their points (fp, root), and root, least: the smallest `least` of each component."""
    rows = cut_lineage(fingerprints(docs, key, text, width, also).withColumn("row", F.monotonically_increasing_id()))
    points = cut_lineage(rows.groupBy("fp").agg(F.min(least).alias("least")))
    roots = cut_lineage(linked(points.select("fp"), radius, shard_rows))
    own = points.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return rows, own.select("fp", "root"), own.groupBy("root").agg(F.min("least").alias("least"))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2, width: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """key, row, fp and component_id (the smallest key reachable) of each row.

    Documents link if their fingerprints differ in at most `radius` bits, and reach each other over links. All pairs of
    different fingerprints are found exactly; equal fingerprints are one point whatever their number. Null and wordless texts
    have fingerprint zero and link like others. A null key is nobody's smallest key, unless all of a group are null. Repeated
    rows are rows of their own; further columns are ignored.
    """
    rows, own, least = _grouped(docs, key, text, F.col("key"), radius, width, shard_rows)
    named = even_lookup(own, least, ["root"]).select("fp", F.col("least").alias("component_id"))
    return even_lookup(rows, named, ["fp"])


def components_of(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`key`, fingerprint (16 hexadecimal digits) and component_id of each row of `docs`, as `near_groups` finds them."""
    found = near_groups(docs, key, text, **options)
    return found.select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stay, with all columns: of each group exactly one row, one with the group's smallest key.

    Rows are chosen, not keys: keys may be null or name several rows, in one group or in different ones. A null key is the
    largest. Of rows of a group that share the smallest key, the one with the smallest hash of all its columns stays.
    """
    names = docs.columns
    placed = identified(docs)
    k, t = (f"_c{names.index(c)}" for c in (key, text))
    best = F.struct(F.col("key").isNull().alias("none"), "key", "_id")
    rows, _, least = _grouped(placed, k, t, best, **options, also=("_id",))
    # Equal rows have equal fingerprints, so that an id belongs to one group.
    number = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("n"))
    stays = cut_lineage(least.select("least._id").join(number, "_id"))
    left = placed.join(stays.where("n = 1").select("_id"), "_id", "left_semi")
    repeated = stays.where("n > 1").select("_id")
    if not repeated.isEmpty():
        left = left.unionByName(first_of_repeated(placed, repeated))
    return left.drop("_id").toDF(*names)
