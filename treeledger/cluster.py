"""Helpers that keep large plans well-behaved: lineage cuts, size-checked hints, global ordering."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A frame is hinted for broadcast only when it was counted and stays under both bounds.
BROADCAST_MAX_ROWS = 100_000
BROADCAST_MAX_BYTES = 8 * 1024 * 1024


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session. Only a local master, whose executors are the driver, may do without."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = local_scratch("checkpoints")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def local_scratch(name: str) -> str:
    """A folder of this process for local masters."""
    return os.path.join(os.environ.get("TMPDIR", "/tmp"), f"treeledger-{os.getpid()}", name)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later branches read the stored rows instead of recomputing them."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_global_index(df: DataFrame, order: list[Column], name: str = "op_index", stored: bool = False) -> DataFrame:
    """Dense 0-based position under `order` without a single-partition window.

    The rows are range-partitioned, sorted inside each partition and checkpointed, so the partition
    bounds sampled by the range exchange are fixed before the per-partition counts are taken. Only one
    count per partition reaches the driver. The input is checkpointed first unless it is `stored` already,
    because the range exchange reads it twice: once for its sample.
    """
    df = df if stored else cut_lineage(df)
    ordered = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = ordered.select(
        "*",
        F.spark_partition_id().alias("_part"),
        (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("_row"),
    )
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, running = [], 0
    for part in range(max(counts, default=-1) + 1):
        offsets.append(running)
        running += counts.get(part, 0)
    base = F.expr(f"element_at(array({', '.join(f'{o}L' for o in offsets or [0])}), _part + 1)")
    return placed.withColumn(name, base + F.col("_row")).drop("_part", "_row")


def _brought(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with what their group brings along into their partition; null names a group like any other value.

    `carried` has one row per partition at most, so it is small whatever the data.
    """
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    more = [F.col(f"r.{c}") for c in carried.columns if c not in keys]
    return rows.alias("l").join(F.broadcast(carried).alias("r"), same, "left").select("l.*", *more)


def running_total(
    df: DataFrame, groups: list[str], order: list[str], value: Column, name: str, stored: bool = False
) -> DataFrame:
    """Sum of `value` over the rows before each row of its group, exact even when one group holds most rows.

    A plain window would sort a hot group in one task. Here rows are range-partitioned on (group, order)
    and checkpointed; each partition sums locally, and a group that spans partitions gets the totals of
    its earlier partitions added. Only such groups have more than one (partition, group) total. The input is
    checkpointed first unless the caller already did (`stored`): the range exchange reads it twice.
    """
    df = df if stored else cut_lineage(df)
    cols = [F.col(c) for c in groups + order]
    placed = cut_lineage(
        df.withColumn("_rt_value", value).repartitionByRange(*cols).sortWithinPartitions(*cols)
    ).withColumn("_rt_part", F.spark_partition_id())
    here = Window.partitionBy("_rt_part", *groups).orderBy(*order)
    local = placed.withColumn(
        "_rt_local", F.coalesce(F.sum("_rt_value").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    totals = placed.groupBy("_rt_part", *groups).agg(F.sum("_rt_value").alias("_rt_n"))
    earlier = Window.partitionBy(*groups).orderBy("_rt_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("_rt_before", F.sum("_rt_n").over(earlier)).where("_rt_before <> 0").drop("_rt_n")
    # Only the first group of a partition can have begun in an earlier one: one row per partition at most.
    return (
        _brought(local, before, ["_rt_part", *groups])
        .withColumn(name, (F.col("_rt_local") + F.coalesce("_rt_before", F.lit(0))).cast("bigint"))
        .drop("_rt_part", "_rt_local", "_rt_before", "_rt_value")
    )


def previous_value(
    df: DataFrame, groups: list[str], order: list[str], value: Column, name: str, stored: bool = False
) -> DataFrame:
    """The last non-null `value` of the rows before each row of its group, null where there is none.

    Works like `running_total`: range partitions on (group, order), a local pass, and for each partition the value that its
    first group brings along from earlier ones. A group that holds most rows is spread over many tasks.
    """
    df = df if stored else cut_lineage(df)
    cols = [F.col(c) for c in groups + order]
    placed = cut_lineage(
        df.withColumn("_pv_value", value).repartitionByRange(*cols).sortWithinPartitions(*cols)
    ).withColumn("_pv_part", F.spark_partition_id())
    here = Window.partitionBy("_pv_part", *groups).orderBy(*order)
    local = F.last("_pv_value", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, -1))
    place = F.when(F.col("_pv_value").isNotNull(), F.struct(*order))
    ends = placed.groupBy("_pv_part", *groups).agg(F.max_by("_pv_value", place).alias("_pv_end"))
    earlier = Window.partitionBy(*groups).orderBy("_pv_part").rowsBetween(Window.unboundedPreceding, -1)
    brought = ends.withColumn("_pv_carry", F.last("_pv_end", ignorenulls=True).over(earlier)).where("_pv_carry is not null").drop("_pv_end")
    # Only the first group of a partition can have begun in an earlier one: one row per partition at most.
    return (
        _brought(placed.withColumn("_pv_local", local), brought, ["_pv_part", *groups])
        .withColumn(name, F.coalesce("_pv_local", "_pv_carry")).drop("_pv_part", "_pv_value", "_pv_local", "_pv_carry")
    )


def ranked_in_group(df: DataFrame, groups: list[str], order: list[str], name: str, stored: bool = False) -> DataFrame:
    """1-based rank inside each group, by `running_total` of ones."""
    return running_total(df, groups, order, F.lit(1), name, stored).withColumn(name, F.col(name) + 1)


def spread_lookup(rows: DataFrame, found: DataFrame, keys: list[str], how: str = "left", salts: int = 16) -> DataFrame:
    """Join of many `rows` with one `found` row per key, even when one key holds most of the rows.

    Rows are dealt by key and salt; `found` has each of its rows once per salt. An aggregate by key that
    follows combines per salt before it shuffles.
    """
    # The salt comes from the row's other values: recomputed tasks must deal rows alike.
    others = [c for c in rows.columns if c not in keys]
    salt = F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int") if others else F.lit(0)
    spread = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys] + [F.col("l._salt") == F.col("r._salt")]
    joined = rows.withColumn("_salt", salt).alias("l").join(spread, same, how)
    return joined.select("l.*", *[F.col(f"r.{c}") for c in found.columns if c not in keys]).drop("_salt")
