"""Greedy chains over ordered times: each kept time is the first that lies far enough after the last kept one.

A slot of time only needs the last kept time before it. Seen that way it is a map from one last kept time to another: a few
steps, and identity where the slot keeps nothing. Maps of neighbouring slots compose, so a tree of compositions tells
every slot where it begins, and no task ever holds a whole chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import cut_lineage

#: Neighbours whose maps are composed into one of the next level.
FAN = 256
NEVER = -(1 << 62)


class Slot:
    """The times of a slot, ascending, each with the gap it needs; pointers to the time that each one lets follow."""

    def __init__(self, at, gap):
        self.at = np.asarray(at, np.int64)
        # A time may follow every last kept one up to its limit; the first that may follow `x` is the first whose limit,
        # or that of one before it, reaches x.
        self.reach = np.maximum.accumulate(self.at - np.asarray(gap, np.int64))
        self.next = np.searchsorted(self.reach, self.at)

    def ends(self) -> np.ndarray:
        """For each time, the last one of the chain that it begins: pointers are doubled until they stand still."""
        n = len(self.at)
        here, jump = np.arange(n + 1), np.append(self.next, n)
        while (jump[:n] < n).any():
            here = np.where(jump < n, here[np.minimum(jump, n)], here)
            jump = jump[jump]
        return self.at[here[:n]]

    def steps(self, begin: int) -> tuple[np.ndarray, np.ndarray]:
        """(upto, to): a last kept time up to upto[i] becomes to[i], a larger one stays. Last kept times are below `begin`."""
        first = np.flatnonzero(np.concatenate(([True], self.reach[1:] > self.reach[:-1])))
        return within(self.reach[first], self.ends()[first], begin)

    def kept(self, last: int) -> np.ndarray:
        out, i = [], int(np.searchsorted(self.reach, last))
        while i < len(self.at):
            out.append(i)
            i = int(self.next[i])
        return self.at[out]


def within(upto: np.ndarray, to: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Only the steps that a last kept time below `begin` may take; of neighbours that lead to one time the later stands."""
    used = int(np.searchsorted(upto, begin - 1)) + 1
    upto, to = upto[:used], to[:used]
    stands = np.append(to[1:] != to[:-1], True) if len(to) else np.zeros(0, bool)
    return upto[stands], to[stands]


def after(upto: np.ndarray, to: np.ndarray, last):
    """Where last kept times end up."""
    at = np.searchsorted(upto, last)
    return np.where(at < len(upto), to[np.minimum(at, len(to) - 1)], last) if len(upto) else np.asarray(last)


def compose(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray], begin: int) -> tuple[np.ndarray, np.ndarray]:
    """`then` after `first`, for last kept times below `begin`, where `first` begins."""
    upto, to = first
    beyond = then[0] > (upto[-1] if len(upto) else NEVER)  # times that `first` leaves as they are
    return within(np.append(upto, then[0][beyond]), np.append(after(*then, to), then[1][beyond]), begin)


def _rows(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    upto, to = (batch.column(batch.schema.get_field_index(n)) for n in ("_upto", "_to"))
    ends = upto.offsets.to_numpy()
    flat = [x.values.to_numpy() for x in (upto, to)]
    return ((flat[0][a:b], flat[1][a:b]) for a, b in zip(ends, ends[1:], strict=False))


def _maps(done: list, keys: list[str], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of composed maps; the last of `keys` is their number."""
    made = {k: [d[0][i] for d in done] for i, k in enumerate(keys)}
    made |= {"_slot": made[keys[-1]], "_begin": [d[1] for d in done], "_upto": [d[2][0] for d in done], "_to": [d[2][1] for d in done]}
    return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in schema], schema.names)


def greedy_kept(times: DataFrame, groups: list[str], at: str, gap: Column, width: int, fan: int | None = None) -> DataFrame:
    """`groups` and `at` of the times that a walk from old to new keeps: the first of each group, then each time that lies
    `gap` (of its own, above 0) or more after the last kept one.

    A slot is `width` wide and holds each time once; whatever the number of slots of a group, a task holds a map or two, and
    a map has no more steps than there are times within the largest gap. Times are whole numbers and not null.
    """
    fan = fan or FAN
    once = times.groupBy(*groups, F.col(at).cast("bigint").alias("_at")).agg(F.max(gap.cast("bigint")).alias("_gap"))
    slot = F.floor(F.col("_at") / F.lit(width)).cast("bigint")
    rows = F.array_sort(F.collect_list(F.struct("_at", "_gap")))
    slots = cut_lineage(
        once.groupBy(*groups, slot.alias("_slot")).agg(rows.alias("_rows"))
        .select(*groups, "_slot", F.col("_rows._at").alias("_ats"), F.col("_rows._gap").alias("_gaps"))
    )
    types = ", ".join(f"`{g}` {slots.schema[g].dataType.simpleString()}" for g in groups)
    map_schema = f"{types}, _slot bigint, _begin bigint, _upto array<bigint>, _to array<bigint>"

    def maps(batches):
        for batch in batches:
            begins = batch["_slot"] * width
            made = [Slot(a, g).steps(b) for a, g, b in zip(batch["_ats"], batch["_gaps"], begins, strict=True)]
            yield batch[[*groups, "_slot"]].assign(_begin=begins, _upto=[m[0] for m in made], _to=[m[1] for m in made])

    levels = [cut_lineage(slots.mapInPandas(maps, map_schema))]
    keys = [*groups, "_above"]

    def runs(rows: DataFrame) -> DataFrame:
        """Members of a map of the level above follow each other, in order."""
        return rows.repartition(*keys).sortWithinPartitions(*keys, "_slot")

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, begin, whole = None, 0, None
        for batch in batches:
            done = []
            for key, first, steps in zip(_rows(batch, keys), _rows(batch, ["_begin"]), _steps(batch), strict=True):
                if key == here:
                    whole = compose(whole, steps, begin)
                    continue
                if here is not None:
                    done.append((here, begin, whole))
                here, begin, whole = key, first[0], steps
            yield _maps(done, keys, batch.schema)
        if here is not None:
            yield _maps([(here, begin, whole)], keys, batch.schema)

    above = F.floor(F.col("_slot") / F.lit(fan)).cast("bigint")
    while (levels[-1].groupBy(*groups).count().agg(F.max("count")).first()[0] or 1) > 1:
        members = runs(levels[-1].withColumn("_above", above))
        composed = members.mapInArrow(together, f"{map_schema}, _above bigint")
        levels.append(cut_lineage(composed.drop("_above")))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last = None, NEVER
        for batch in batches:
            lasts = []
            for key, start, steps in zip(_rows(batch, keys), _rows(batch, ["_last"]), _steps(batch), strict=True):
                if key != here:
                    here, last = key, start[0]
                lasts.append(last)
                last = int(after(*steps, last))
            own = [batch.column(batch.schema.get_field_index(n)) for n in [*groups, "_slot"]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(lasts, pa.int64())], [*groups, "_slot", "_last"])

    starts = levels[-1].select(*groups, "_slot", F.lit(NEVER).alias("_last"))
    for below in reversed(levels[:-1]):
        given = starts.withColumnRenamed("_slot", "_above").alias("u")
        members = below.withColumn("_above", above).alias("m")
        same = [F.col(f"m.{c}").eqNullSafe(F.col(f"u.{c}")) for c in keys]
        joined = members.join(given, same).select("m.*", "u._last")
        starts = runs(joined).mapInArrow(down, f"{types}, _slot bigint, _last bigint")

    @F.pandas_udf("array<bigint>")
    def kept(ats: pd.Series, gaps: pd.Series, lasts: pd.Series) -> pd.Series:
        return pd.Series([Slot(a, g).kept(x) for a, g, x in zip(ats, gaps, lasts, strict=True)])

    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"l.{c}")) for c in [*groups, "_slot"]]
    placed = slots.alias("s").join(starts.alias("l"), same).select("s.*", "l._last")
    return placed.select(*groups, F.explode(kept("_ats", "_gaps", "_last")).alias(at))
