"""Pages of a large ordered table through a stored zone map: a page reads the blocks that hold it and no others."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import with_global_index

#: Rows of a block; a block is a file.
BLOCK_ROWS = 100_000
PLACE = "_place"


def write_pages(rows: DataFrame, order: list[str], path: str, block_rows: int = BLOCK_ROWS) -> None:
    """Store `rows` in the order of their columns `order`, in blocks, with one zone map row per block.

    The order must tell rows apart. Rows are range-partitioned once; ranges, not the driver, give every row its position.
    """
    placed = with_global_index(rows, [F.col(c) for c in order], PLACE)
    placed.write.mode("overwrite").option("maxRecordsPerFile", block_rows).parquet(f"{path}/rows")
    spark = rows.sparkSession
    zones = spark.read.schema(placed.schema).parquet(f"{path}/rows").groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min(PLACE).alias("first"), F.max(PLACE).alias("last"), F.count(F.lit(1)).alias("rows"),
        F.min(F.struct(*order)).alias("low"), F.max(F.struct(*order)).alias("high"),
    )
    zones.repartitionByRange("first").sortWithinPartitions("first").write.mode("overwrite").parquet(f"{path}/zones")
    kept = spark.createDataFrame([(placed.schema.json(),)], "schema string").coalesce(1)
    kept.write.mode("overwrite").parquet(f"{path}/schema")


def zones(spark: SparkSession, path: str) -> DataFrame:
    """file, first, last, rows, low and high (the order's columns) of every block."""
    return spark.read.parquet(f"{path}/zones")


def total(spark: SparkSession, path: str) -> DataFrame:
    """One row with the exact `total`; no block is read."""
    return zones(spark, path).agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("total"))


def _schema(spark: SparkSession, path: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(spark.read.parquet(f"{path}/schema").first()["schema"]))


def page(spark: SparkSession, path: str, offset: int, limit: int) -> DataFrame:
    """The rows at positions offset to offset + limit - 1, with their position. Only their blocks are opened."""
    schema = _schema(spark, path)
    held = zones(spark, path).where((F.col("last") >= offset) & (F.col("first") < offset + limit)).select("file")
    files = [r["file"] for r in held.collect()]  # limit / block_rows + 2 at most
    if not files:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*files)
    return rows.where((F.col(PLACE) >= offset) & (F.col(PLACE) < offset + limit))


def place_of(spark: SparkSession, path: str, **key) -> int:
    """The position of the first row that isn't below `key` (a value per column of the order): where a page from there begins."""
    low = F.struct(*[F.lit(v).alias(c) for c, v in key.items()])
    found = zones(spark, path).where(F.col("high") >= low).agg(F.min_by("file", "first"), F.min("first")).first()
    if found[0] is None:
        return total(spark, path).first()["total"]
    schema = _schema(spark, path)
    rows = spark.read.schema(schema).parquet(found[0])
    return rows.where(F.struct(*key) >= low).agg(F.min(PLACE)).first()[0]
