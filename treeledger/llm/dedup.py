"""Exact dedup (operator 6) by recipes of content-defined chunks, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, even_lookup, lower_ascii, pick

#: A chunk ends at the first blank after 1,024 characters that stands between certain letters, so that equal passages are
#: cut alike wherever they stand; after 8,192 characters it ends anyhow.
CHUNK = r"(?s).{1024,8192}?[aeioulmz.]\s(?=[a-dmos-v])|.{1,8192}"


def chunks(normalised: Column) -> Column:
    return F.regexp_extract_all(normalised, F.lit(CHUNK), F.lit(0))


def exact_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", fingerprint=F.xxhash64, keep: list[str] | None = None
) -> DataFrame:
    """`key`, keep_id, group_size, kept and text_sha256 for each row; equal texts (A-Z lower-cased) are one group.

    Each text becomes the ordered list of its chunks' identifiers, its recipe. A chunk's identifier is its 64-bit
    fingerprint, verified against the distinct chunks themselves: a fingerprint of two different chunks is found by grouping
    the chunks, and recipes that use one are told apart by their texts. Texts are grouped by recipe: only short lists move, and
    each distinct chunk moves once per task. Counting happens before the shuffle and rows meet their group by key and salt, so
    a text of a third of all rows is no hot task.

    Of equal texts the row with the largest key stays (a null key is smallest); of rows that also share the key, exactly one.
    Null counts as empty, and empty texts are one group. Columns named in `keep` are passed on.
    """
    extra = [c for c in keep or [] if c not in (key, text)]
    source = pick(docs, key, text, *extra)
    normal = lower_ascii(F.col(text))
    recipe = F.transform(chunks(normal), lambda c: fingerprint(c))
    rows = cut_lineage(
        source.select(
            F.struct(*([F.col(c) for c in extra] or [F.lit(0)])).alias("extra"), F.col(key).alias("key"),
            F.sha2(normal.cast("binary"), 256).alias("text_sha256"), recipe.alias("recipe"), F.lit("").alias("refined"),
        ).withColumn("row", F.monotonically_increasing_id())
    )
    distinct = pick(docs, text).select(F.explode(chunks(normal)).alias("chunk")).distinct()
    shared = distinct.groupBy(fingerprint(F.col("chunk")).alias("id")).count().where("count > 1").select("id")
    if not shared.isEmpty():  # 64 bits hardly ever collide; then the texts of the affected groups decide
        rows = _refined(rows, pick(docs, key, text, *extra), shared, normal, recipe, key, extra)
    groups = (
        rows.groupBy("recipe", "refined")
        .agg(F.max(F.struct("key", "row")).alias("stays"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )
    placed = even_lookup(rows, groups, ["recipe", "refined"])
    return placed.select(
        F.col("key").alias(key),
        F.when(F.col("stays").isNull(), F.col("key")).otherwise(F.col("stays.key")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("stays.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256", *[F.col(f"extra.{c}").alias(c) for c in extra],
    )


def _refined(rows, docs, shared, normal, recipe, key, extra) -> DataFrame:
    """Rows whose recipe holds a shared fingerprint get their text as a second grouping key."""
    unclear = cut_lineage(
        rows.groupBy("recipe").count().where("count > 1").select("recipe", F.explode("recipe").alias("id"))
        .join(shared, "id", "left_semi").select("recipe").distinct()
    )
    again = docs.select(
        F.struct(*([F.col(c) for c in extra] or [F.lit(0)])).alias("extra"), F.col(key).alias("key"),
        F.sha2(normal.cast("binary"), 256).alias("text_sha256"), recipe.alias("recipe"), normal.alias("refined"),
    )
    return cut_lineage(
        rows.drop("row").join(unclear, "recipe", "left_anti").select(*again.columns)
        .unionByName(again.join(unclear, "recipe", "left_semi").select(*again.columns))
        .withColumn("row", F.monotonically_increasing_id())
    )


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns, as `exact_groups` decides.

    Only keys and digests of the rows that go are joined with the texts.
    """
    groups = cut_lineage(exact_groups(docs, key, text))
    goes = groups.where("not kept").where(~F.col(key).eqNullSafe(F.col("keep_id"))).select(F.col(key).alias("_k"), F.col("text_sha256").alias("_d")).distinct()
    repeated = not groups.where("not kept").where(F.col(key).eqNullSafe(F.col("keep_id"))).isEmpty()
    names = docs.columns
    placed = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    k, t = F.col(f"_c{names.index(key)}"), F.col(f"_c{names.index(text)}")
    marked = placed.withColumn("_digest", F.sha2(lower_ascii(t).cast("binary"), 256))
    left = marked.join(goes, k.eqNullSafe(F.col("_k")) & (F.col("_digest") == F.col("_d")), "left_anti")
    if repeated:  # rows that share key and text: one of them stays
        same = Window.partitionBy(k, "_digest").orderBy(F.xxhash64(*placed.columns))
        left = left.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    return left.drop("_digest").toDF(*names)
