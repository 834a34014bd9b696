"""Content-defined chunks of files of any size: byte ranges are worked off side by side, their bounds joined by composition.

A range's candidate bounds depend on the 31 bytes before it only. Which of them become bounds depends on where the chunk that
is open at the range's begin started: somewhere in the `maximum` bytes before it. So a range is a map from the open chunk's
start at its begin to the open chunk's start at its end. Such a map is constant or a shift on a few stretches, maps of
neighbours compose into one of the same kind, and a tree of compositions gives every range the start that it really has.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..cluster import cut_lineage, running_total
from .delta import AVERAGE, MAXIMUM, MINIMUM, candidates

#: Bytes of a range, and ranges whose maps are composed by one task.
SPAN = 64 * 1024 * 1024
FAN = 64
LEAD = 31
#: Rows that a task passes on together, and rows with maps that it unfolds together.
AT_ONCE = 1024

# One stretch of a map: starts lo..hi go to `to` if that is set, else move by `shift`.
PIECES = "array<struct<lo:bigint,hi:bigint,to:bigint,shift:bigint>>"
Piece = tuple[int, int, int | None, int]


def range_map(found: np.ndarray, begin: int, end: int, minimum: int, maximum: int) -> list[Piece]:
    """The map of the range (begin, end]; `found` are its candidate bounds, ascending. At 0 only the start 0 can be open."""
    first = 0 if begin == 0 else begin - maximum + 1
    out, open_ = [], [(max(0, first), begin, None, 0)]
    while open_:
        lo, hi, to, shift = open_.pop()
        if to is not None:
            while (cut := next_bound(found, to, end, minimum, maximum)) is not None:
                to = cut
            out.append((lo, hi, to, 0))
            continue
        # Starts lo..hi stand at lo + shift..hi + shift; the first candidate that each may take splits them.
        at = lo
        while at <= hi:
            now = at + shift
            i = int(np.searchsorted(found, now + minimum))
            nearest = int(found[i]) if i < len(found) else None
            # Up to `last` the same candidate is the nearest one.
            last = hi if nearest is None else min(hi, nearest - minimum - shift)
            if nearest is not None and nearest <= now + maximum:
                open_.append((at, last, nearest, 0))
            else:
                if nearest is not None:  # too far for these, but not for those within reach of it
                    last = min(last, nearest - maximum - 1 - shift)
                forced = min(last, end - maximum - shift)
                if forced >= at:
                    last = forced
                    open_.append((at, last, None, shift + maximum))
                else:
                    out.append((at, last, None, shift))
            at = last + 1
    return joined(sorted(out, key=lambda p: p[0]))


def next_bound(found: np.ndarray, start: int, end: int, minimum: int, maximum: int) -> int | None:
    """The bound of the chunk that starts at `start`, None if it is beyond the range's end."""
    i = int(np.searchsorted(found, start + minimum))
    if i < len(found) and found[i] <= start + maximum:
        return int(found[i])
    return start + maximum if start + maximum <= end else None


def joined(pieces: list[Piece]) -> list[Piece]:
    """Neighbouring stretches that do the same are one."""
    out: list[Piece] = []
    for p in pieces:
        if out and out[-1][1] + 1 == p[0] and out[-1][2:] == p[2:]:
            out[-1] = (out[-1][0], *p[1:])
        else:
            out.append(p)
    return out


def apply(pieces: list[Piece], start: int) -> int:
    at = bisect_right(pieces, start, key=lambda p: p[0]) - 1
    lo, hi, to, shift = pieces[at]
    if not lo <= start <= hi:
        raise ValueError(f"no chunk can start at {start} here")
    return start + shift if to is None else to


def compose(first: list[Piece], then: list[Piece]) -> list[Piece]:
    """The map that applies `first`, then `then`."""
    out = []
    for lo, hi, to, shift in first:
        if to is not None:
            out.append((lo, hi, apply(then, to), 0))
            continue
        for a, b, target, more in then:
            x, y = max(lo, a - shift), min(hi, b - shift)
            if x <= y:
                out.append((x, y, target, 0 if target is not None else shift + more))
    return joined(sorted(out, key=lambda p: p[0]))


def cuts(found: np.ndarray, start: int, begin: int, end: int, minimum: int, maximum: int) -> list[int]:
    """The bounds in (begin, end] of the chunk open since `start` and of those after it."""
    out = []
    while (cut := next_bound(found, start, end, minimum, maximum)) is not None:
        out.append(cut)
        start = cut
    return out


# --- tables ------------------------------------------------------------------------------------------------------------------


def ranges_of(files: DataFrame, keys: list[str], size: str = "size", span: int = SPAN) -> DataFrame:
    """`files` with one row per range: number, begin, end. Empty files have none."""
    last = F.floor((F.col(size) - 1) / F.lit(span)).cast("bigint")
    spread = files.where(F.col(size) > 0).withColumn("number", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return spread.withColumn("begin", F.col("number") * span).withColumn("end", F.least(F.col("begin") + span, F.col(size)))


def _bytes(row: dict, begin: int, end: int) -> bytes | memoryview:
    """From the row's own `body`, which begins at `body_at`, or from the file at its `location`."""
    if row.get("location") is None:
        body = row["body"]
        return body[begin - row["body_at"] : end - row["body_at"]]
    system, path = fs.FileSystem.from_uri(quote(row["location"], safe="/:"))
    with system.open_input_file(path) as f:
        return f.read_at(end - begin, begin)


def _arrow(rows: DataFrame, run, schema: str) -> DataFrame:
    """`run` makes rows (dicts) of each row; large values are looked at one by one, where they lie."""
    kind = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for batch in batches:
            names = [n for n in batch.schema.names if n != "body"]
            body = batch.column("body") if "body" in batch.schema.names else None
            for i, values in enumerate(zip(*(batch.column(n).to_pylist() for n in names), strict=True)):
                row = dict(zip(names, values, strict=True))
                if body is not None:
                    row["body"] = memoryview(body[i].as_buffer())
                for made in run(row):
                    out.append(made)
                    if len(out) == AT_ONCE:
                        yield pa.RecordBatch.from_pylist(out, kind)
                        out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    return rows.mapInArrow(each, schema)


def _grouped(rows: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """`run` makes rows (dicts) of each group's rows, which are those of FAN neighbours of a file in the order of their numbers.

    Groups are small and very many: a task goes through its own in one stream.
    """
    kind = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    group = [*keys, "_group"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for at in range(0, b.num_rows, AT_ONCE) for r in b.slice(at, AT_ONCE).to_pylist())
        out = []
        for _, own in groupby(stream, key=lambda r: [r[k] for k in group]):
            out += run(own)
            if len(out) >= AT_ONCE:
                yield pa.RecordBatch.from_pylist(out, kind)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    return rows.repartition(*group).sortWithinPartitions(*group, "number").mapInArrow(each, schema)


def _types(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def range_maps(ranges: DataFrame, keys: list[str], minimum: int = MINIMUM, average: int = AVERAGE, maximum: int = MAXIMUM) -> DataFrame:
    """keys, number, begin, end, pieces: reads each range once, with the bytes before it that its hashes need."""

    def run(row: dict) -> Iterator[dict]:
        lead = min(LEAD, row["begin"])
        found = candidates(_bytes(row, row["begin"] - lead, row["end"]), minimum, average, lead) + row["begin"]
        pieces = range_map(found, row["begin"], row["end"], minimum, maximum)
        own = [dict(zip(("lo", "hi", "to", "shift"), p, strict=True)) for p in pieces]
        yield {**{k: row[k] for k in keys}, "number": row["number"], "begin": row["begin"], "end": row["end"], "pieces": own}

    return _arrow(ranges, run, f"{_types(ranges, keys)}, number bigint, begin bigint, end bigint, pieces {PIECES}")


def entries(maps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, number, start: where the chunk that is open at each range's begin started.

    FAN neighbours are composed into one map, level by level, until a file has one; then the starts come down the same tree.
    No task holds more than FAN maps, and a map of a range is a few stretches, however long the range.
    """
    levels = [cut_lineage(maps.select(*keys, "number", "pieces"))]
    types = _types(maps, keys)
    top = levels[0].agg(F.max("number")).first()[0]
    group = F.floor(F.col("number") / FAN).cast("bigint")

    def together(rows: Iterator[dict]) -> list[dict]:
        first = next(rows)
        whole = [_piece(p) for p in first["pieces"]]
        for r in rows:
            whole = compose(whole, [_piece(p) for p in r["pieces"]])
        own = [dict(zip(("lo", "hi", "to", "shift"), p, strict=True)) for p in whole]
        return [{**{k: first[k] for k in keys}, "number": first["_group"], "pieces": own}]

    def down(rows: Iterator[dict]) -> list[dict]:
        start, out = next(rows)["start"], []
        for r in rows:
            out.append({**{k: r[k] for k in keys}, "number": r["number"], "start": start})
            start = apply([_piece(p) for p in r["pieces"]], start)
        return out

    while top:
        levels.append(cut_lineage(_grouped(levels[-1].withColumn("_group", group), keys, together, f"{types}, number bigint, pieces {PIECES}")))
        top //= FAN
    starts = levels[-1].select(*keys, "number", F.lit(0).cast("bigint").alias("start"))
    for below in reversed(levels[:-1]):
        # The start that a group is given comes first among its members.
        given = starts.select(*keys, F.col("number").alias("_group"), F.lit(-1).cast("bigint").alias("number"), "start")
        members = below.withColumn("_group", group).unionByName(given, allowMissingColumns=True)
        starts = _grouped(members, keys, down, f"{types}, number bigint, start bigint")
    return starts


def _piece(p: dict) -> Piece:
    return p["lo"], p["hi"], p["to"], p["shift"]


def chunk_table_by_ranges(
    files: DataFrame, keys: list[str], size: str = "size", location: str | None = "location", content: str | None = None,
    minimum: int = MINIMUM, average: int = AVERAGE, maximum: int = MAXIMUM, span: int = SPAN,
) -> DataFrame:
    """(keys, position, off, len, hash) of every chunk, equal to `delta.chunk_table`, with one task per range of a file.

    The content is at `location` (a name that pyarrow's file systems open; each byte is read twice, once for the bounds and
    once for the digests) or in the binary column `content`. No value is longer than a range and a chunk. Keys name one file
    each and are not null. Empty files have no chunk.
    """
    if (location is None) == (content is None):
        raise ValueError("give either a location or a content")
    if content is not None:
        files = files.withColumn(content, F.col(content).cast("binary")).withColumn("_size", F.octet_length(content).cast("bigint"))
        size = "_size"
    ranges = ranges_of(files, keys, size, span)

    def with_bytes(rows: DataFrame, begin) -> DataFrame:
        if content is None:
            return rows.withColumn("location", F.col(location))
        body = F.substring(F.col(content), (begin + 1).cast("int"), (F.col("end") - begin).cast("int"))
        return rows.withColumn("body", body).withColumn("body_at", begin)

    own = [*keys, "number", "begin", "end"]
    source = ["location"] if content is None else ["body", "body_at"]
    maps = range_maps(with_bytes(ranges, F.greatest(F.col("begin") - LEAD, F.lit(0).cast("bigint"))).select(*own, *source), keys, minimum, average, maximum)
    known = entries(cut_lineage(maps), keys)
    if content is None:
        placed = ranges.join(known, [*keys, "number"])
    else:
        # A content meets its ranges' starts once, and not each of its ranges with the whole content.
        starts = known.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("number", "start"))).alias("_starts"))
        placed = ranges_of(files.join(starts, keys), keys, size, span).withColumn("start", F.get("_starts", F.col("number").cast("int"))["start"])
    placed = with_bytes(placed, F.least("start", F.greatest(F.col("begin") - LEAD, F.lit(0).cast("bigint"))))
    placed = placed.withColumn("_last", F.col("end") == F.col(size)).select(*own, "start", "_last", *source)

    def run(row: dict) -> Iterator[dict]:
        begin, end, start = row["begin"], row["end"], row["start"]
        lead = min(LEAD, begin)
        at = min(start, begin - lead)
        data = _bytes(row, at, end)
        found = candidates(data[begin - lead - at :], minimum, average, lead) + begin
        ends = cuts(found, start, begin, end, minimum, maximum)
        if row["_last"] and (ends[-1] if ends else start) < end:
            ends.append(end)
        for n, cut in enumerate(ends):
            digest = hashlib.sha256(memoryview(data)[start - at : cut - at]).hexdigest()
            yield {**{k: row[k] for k in keys}, "number": row["number"], "n": n, "off": start, "len": cut - start, "hash": digest}
            start = cut

    chunks = cut_lineage(_arrow(placed, run, f"{_types(files, keys)}, number bigint, n bigint, off bigint, len bigint, hash string"))
    counts = chunks.groupBy(*keys, "number").agg(F.count(F.lit(1)).alias("_n"))
    before = running_total(counts, keys, ["number"], F.col("_n"), "_before").drop("_n")
    return chunks.join(before, [*keys, "number"]).select(*keys, (F.col("_before") + F.col("n")).alias("position"), "off", "len", "hash")
