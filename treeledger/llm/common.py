"""What the corpus operators share: exact column picking, even joins, the contracts' words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import cut_lineage
from ..cluster import spread_lookup as even_lookup

__all__ = ["WORD", "cut_lineage", "documents", "even_lookup", "first_of_repeated", "identified", "lower_ascii", "pick", "salted", "sliced", "table"]

#: A word of the contracts: a run of characters that are neither a space nor one of the five ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact spelling; any further columns, also such as differ in case only, don't matter."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    at = [df.columns.index(n) for n in names]
    placed = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return placed.select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, names, strict=True)])


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows: what a part's Python objects take is all that a task holds beside the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def identified(docs: DataFrame) -> DataFrame:
    """`docs` with columns _c0, _c1, ... and _id: 128 bits that equal rows share and different rows don't.

    Keys may be null or repeated, and ids of stored rows don't hold for a frame that is read again: rows are told apart by all
    their columns. Maps can't be hashed and don't count.
    """
    placed = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    own = [c for c, kind in placed.dtypes if "map<" not in kind and "variant" not in kind]
    none = [F.col(c).isNull() for c in own]  # hashes pass over nulls
    return placed.withColumn("_id", F.struct(F.xxhash64(F.lit(1), *none, *own).alias("a"), F.xxhash64(F.lit(2), *none, *own).alias("b")))


def salted(placed: DataFrame, ids: DataFrame, how: str, salts: int = 16) -> DataFrame:
    """Semi or anti join of `identified` rows with unique ids, for rows of which very many are equal: these go by the task that
    reads them, as nothing else tells them apart."""
    spread = ids.select("_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    return placed.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts))).join(spread, ["_id", "_salt"], how).drop("_salt")


def first_of_repeated(placed: DataFrame, ids: DataFrame) -> DataFrame:
    """One row, with _id, for each of the unique `ids`; equal rows are combined in the tasks before the shuffle."""
    columns = [c for c in placed.columns if c != "_id"]
    found = salted(placed, ids, "left_semi").groupBy("_id").agg(F.first(F.struct(*columns)).alias("_row"))
    return found.select("_id", *[F.col("_row")[c].alias(c) for c in columns])
