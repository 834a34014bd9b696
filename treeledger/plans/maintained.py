"""A comparison kept up to date: change rows come in, and only keys in the buckets they fall into are decided again."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import cut_lineage
from ..functions import text
from ..operators.compare import Options, Sides
from ..operators.inventory import Header, Inventory, archive_usable
from ..schema import ENTRY
from .compare import Comparison, decide, planned

BUCKETS = 256
SIDES = ("source", "target")
STORED = T.StructType([*ENTRY.fields, T.StructField("key", T.StringType())])
CHANGE = T.StructType([T.StructField("side", T.StringType()), T.StructField("removed", T.BooleanType()), *ENTRY.fields])


@dataclass
class Maintained:
    """Both inventories and their undecided keys, stored below `root` by bucket of (kind, key).

    A verdict depends on its key's rows alone, so a change asks for its bucket's keys and no others: a round reads and writes
    the buckets that its changes fall into, whatever the size of the inventories. Every round writes its own folders and
    then one manifest that names, for each bucket, the round that wrote it; readers see whole rounds, and a round that is
    run again replaces itself. Headers, unread areas and the archive stay as they are from `start` on; begin anew for others.
    """

    spark: SparkSession
    root: str
    mode: str
    source: Header
    target: Header
    options: Options = field(default_factory=Options)
    resolve_newer: bool = False
    buckets: int = BUCKETS
    unread: dict[str, DataFrame] = field(default_factory=dict)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("kind", "key"), F.lit(self.buckets)).cast("int")

    # --- storage -------------------------------------------------------------------------------------------------

    def manifest(self, round_no: int) -> dict[str, dict[str, int]]:
        """table -> bucket -> the round that wrote it."""
        lines = self.spark.read.text(f"{self.root}/manifest/round={round_no}").collect()  # one line
        return json.loads(lines[0]["value"])

    def newest(self) -> int | None:
        """The last whole round, None before `start`."""
        try:
            found = self.spark.read.text(f"{self.root}/manifest").agg(F.max("round")).first()[0]
        except AnalysisException:
            return None
        return found

    def _write(self, rows: DataFrame, table: str, round_no: int) -> set[int]:
        path = f"{self.root}/{table}/round={round_no}"
        rows = rows.withColumn("bucket", self.bucket())
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        try:
            held = self.spark.read.parquet(path).select("bucket").distinct().collect()  # at most one row per bucket
        except AnalysisException:  # nothing was written
            return set()
        return {r["bucket"] for r in held}

    def _commit(self, manifest: dict[str, dict[str, int]], round_no: int) -> None:
        line = self.spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1)
        line.write.mode("overwrite").text(f"{self.root}/manifest/round={round_no}")

    def table(self, name: str, manifest: dict[str, dict[str, int]], schema: T.StructType, buckets: Iterable[int] | None = None) -> DataFrame:
        """The stored rows, of some buckets only if these are named."""
        own = manifest.get(name, {})
        wanted = own if buckets is None else [str(b) for b in buckets if str(b) in own]
        paths = [f"{self.root}/{name}/round={own[b]}/bucket={b}" for b in wanted]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _inventory(self, side: str, manifest: dict, buckets: Iterable[int] | None = None) -> Inventory:
        entries = self.table(side, manifest, STORED, buckets)
        return Inventory(entries, getattr(self, side), self.unread.get(side), keyed_for=self.options.case_insensitive)

    def _archive(self, manifest: dict, buckets: Iterable[int] | None = None) -> Inventory | None:
        if "archive" not in manifest:
            return None
        return Inventory(self.table("archive", manifest, STORED, buckets), Header(kind="archive"), keyed_for=self.options.case_insensitive)

    def _sides(self, source: Inventory, target: Inventory) -> Sides:
        return Sides(source, target, self.options.widened(source, target))

    def _keyed(self, entries: DataFrame) -> DataFrame:
        return text.with_key(entries.select(*ENTRY.fieldNames()), self.options.case_insensitive).select(*STORED.fieldNames())

    # --- rounds --------------------------------------------------------------------------------------------------

    @classmethod
    def start(cls, spark: SparkSession, root: str, source: Inventory, target: Inventory, mode: str, archive: Inventory | None = None, **more) -> Maintained:
        """Round 0: stores both inventories (and the archive, if it counts) and decides all keys once."""
        unread = {s: i.unread for s, i in (("source", source), ("target", target)) if i.unread is not None}
        self = cls(spark, root, mode, source.header, target.header, unread=unread, **more)
        if archive is not None and not archive_usable(archive.header, mode, source.header.evidence):
            archive = None
        tables = {"source": source.entries, "target": target.entries} | ({"archive": archive.entries} if archive is not None else {})
        manifest = {name: {str(b): 0 for b in self._write(self._keyed(rows), name, 0)} for name, rows in tables.items()}
        decided = decide(self._sides(*(self._inventory(s, manifest) for s in SIDES)), mode, self._archive(manifest), self.resolve_newer)
        manifest["decided"] = {str(b): 0 for b in self._write(decided, "decided", 0)}
        manifest["schema"] = json.loads(decided.schema.json())
        self._commit(manifest, 0)
        return self

    def apply(self, changes: DataFrame, round_no: int) -> list[int]:
        """One round of `changes`: side, removed, and an entry's columns; of several rows for one entry only one may be given.

        An entry is named by (kind, path); a removed one needs no other column. Returns the buckets that were decided again.
        """
        manifest = self.manifest(round_no - 1)
        rows = text.with_key(changes.select(*CHANGE.fieldNames()), self.options.case_insensitive).withColumn("bucket", self.bucket())
        rows = cut_lineage(rows)
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # at most `buckets` rows
        after = {k: dict(v) for k, v in manifest.items()}
        fresh = {}
        for side in SIDES:
            own = rows.where(F.col("side") == side)
            if own.isEmpty():
                fresh[side] = self._inventory(side, manifest, touched)
                continue
            kept = self.table(side, manifest, STORED, touched).join(own.select("kind", "path"), ["kind", "path"], "left_anti")
            now = kept.select(*STORED.fieldNames()).unionByName(own.where("not coalesce(removed, false)").select(*STORED.fieldNames()))
            self._note(after, side, touched, self._write(now, side, round_no), round_no)
            fresh[side] = self._inventory(side, after, touched)
        decided = decide(self._sides(fresh["source"], fresh["target"]), self.mode, self._archive(manifest, touched), self.resolve_newer)
        self._note(after, "decided", touched, self._write(decided, "decided", round_no), round_no)
        self._commit(after, round_no)
        return touched

    @staticmethod
    def _note(manifest: dict, table: str, touched: list[int], held: set[int], round_no: int) -> None:
        """The touched buckets are the new round's; those that it left empty are no one's."""
        manifest[table] = {b: r for b, r in manifest[table].items() if int(b) not in touched} | {str(b): round_no for b in held}

    def comparison(self, round_no: int | None = None, now_ms: int = 0) -> Comparison:
        """The plan as of a round, the newest by default, from the stored decisions: as `compare` would make it."""
        round_no = self.newest() if round_no is None else round_no
        manifest = self.manifest(round_no)
        schema = T.StructType.fromJson(manifest["schema"])
        sides = self._sides(*(self._inventory(s, manifest) for s in SIDES))
        return planned(sides, self.mode, self.table("decided", manifest, schema), "archive" in manifest, now_ms)

    def changed_decisions(self, round_no: int) -> DataFrame:
        """(kind, key, before, after): keys whose verdict the round changed; only its buckets are read."""
        manifest, old = self.manifest(round_no), self.manifest(round_no - 1)
        schema = T.StructType.fromJson(manifest["schema"])
        buckets = [int(b) for b in set(manifest["decided"]) | set(old["decided"]) if manifest["decided"].get(b) != old["decided"].get(b)]
        before, after = (self.table("decided", m, schema, buckets).select("kind", "key", F.col("verdict").alias(n)) for m, n in ((old, "before"), (manifest, "after")))
        return before.join(after, ["kind", "key"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def last_changes(rows: DataFrame, order: str) -> DataFrame:
    """The last of several changes of one entry, by `order`; in the tasks before the shuffle."""
    names = [c for c in CHANGE.fieldNames() if c not in ("side", "kind", "path")]
    return rows.groupBy("side", "kind", "path").agg(F.max_by(F.struct(*names), F.col(order)).alias("_c")).select("side", "kind", "path", "_c.*")


def changes_between(old: DataFrame, new: DataFrame, side: str) -> DataFrame:
    """Change rows that turn one version of an inventory's entries into another, for sources without a change feed."""
    names = [c for c in ENTRY.fieldNames() if c not in ("kind", "path")]
    a = old.select("kind", "path", F.struct(*names).alias("_a"))
    b = new.select("kind", "path", F.struct(*names).alias("_b"))
    both = a.join(b, ["kind", "path"], "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select(F.lit(side).alias("side"), F.col("_b").isNull().alias("removed"), "kind", "path", "_b.*").select(*CHANGE.fieldNames())
