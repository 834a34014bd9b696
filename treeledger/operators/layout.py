"""Display order of a plan: sorted rows, optionally grouped into a folder tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import cut_lineage, with_global_index
from ..functions import rows, text

# Sort key -> (value kind, how a folder folds its rows).
SORT_KEYS = {
    "s.path": ("text", "dir"), "t.path": ("text", "dir"), "action": ("num", "min"), "s.size": ("num", "sum"),
    "s.mtime": ("num", "max"), "t.size": ("num", "sum"), "t.mtime": ("num", "max"), "reason": ("text", "min"),
}


def sort_value(key: str) -> tuple[Column, Column]:
    """(missing, value) of a row under a sort key."""
    side = rows.side_paths()
    value = {
        "s.path": F.lower(side["source"]), "t.path": F.lower(side["target"]), "action": rows.action_rank().cast("bigint"),
        "s.size": F.col("src.size"), "s.mtime": F.col("src.mtime_ms"), "t.size": F.col("dst.size"),
        "t.mtime": F.col("dst.mtime_ms"), "reason": F.lower("reason"),
    }[key]
    return F.when(value.isNull(), 1).otherwise(0), value


def sorted_plan(plan: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Flat display order: missing values last in both directions, ties by plan position."""
    missing, value = sort_value(key)
    placed = rows.effective_evidence(plan).withColumns({"_missing": missing, "_value": value})
    direction = F.col("_value").desc_nulls_last() if descending else F.col("_value").asc_nulls_last()
    return with_global_index(placed, [F.col("_missing"), direction, F.col("op_index")], "display_index").drop("_missing", "_value")


def _folder_elements(owned: DataFrame, key: str | None, sign: int) -> DataFrame:
    """folder -> the struct by which it sorts among its siblings: (missing, value, first plan row).

    Text values become the position of the text among the distinct ones, so a direction is a sign.
    """
    kind, fold = SORT_KEYS[key] if key else ("num", None)
    aggregates = [F.min("op_index").alias("first_index"), F.count(F.lit(1)).alias("count"),
                  F.count_if(rows.is_executable()).alias("executable_count"), F.sum(F.coalesce("size", F.lit(0))).cast("bigint").alias("bytes")]
    if fold in ("min", "max", "sum"):
        aggregates.append(getattr(F, fold)("_value").alias("_fold"))
    own = owned.groupBy("owner").agg(*aggregates)
    spread = own.withColumn("folder", F.explode(F.when(F.col("owner") == "", F.array(F.lit(""))).otherwise(text.self_and_ancestors("owner"))))
    again = [F.min("first_index").alias("first_index"), F.sum("count").alias("count"), F.sum("executable_count").alias("executable_count"), F.sum("bytes").alias("bytes")]
    if fold in ("min", "max", "sum"):
        again.append(getattr(F, fold)("_fold").alias("_fold"))
    folders = spread.groupBy("folder").agg(*again)
    if fold == "dir":
        folders = folders.withColumn("_fold", F.when(F.col("folder") == "", F.lit("")).otherwise(F.lower(text.base_name("folder"))))
    if fold is None:
        missing, number = F.lit(0), F.lit(0).cast("bigint")
    elif kind == "num":
        missing, number = F.when(F.col("_fold").isNull(), 1).otherwise(0), F.coalesce("_fold", F.lit(0)).cast("bigint") * sign
    else:
        distinct = with_global_index(folders.select(F.col("_fold").alias("_text")).where("_text is not null").distinct(), [F.col("_text")], "_rank")
        folders = folders.join(distinct, folders["_fold"] == distinct["_text"], "left")
        missing, number = F.when(F.col("_fold").isNull(), 1).otherwise(0), F.coalesce("_rank", F.lit(0)) * sign
    element = F.struct(missing.alias("missing"), number.alias("number"), F.col("first_index").alias("first"))
    return folders.select("folder", element.alias("element"), "first_index", "count", "executable_count", "bytes")


def grouped_plan(plan: DataFrame, key: str | None = None, descending: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with `display_index`, folder tree).

    A folder shows its own rows first, then its subfolders. Each folder's place is the array of its
    ancestors' sort structs, so one distributed sort on (array, row value, plan position) is the whole tree
    walk: a shorter array sorts before its extensions. The tree has, per folder, counts, bytes, the first
    plan row and the range [start, end) its subtree occupies.
    """
    sign = -1 if descending else 1
    ready = rows.effective_evidence(plan).withColumn("owner", rows.owning_folder())
    if key:
        missing, value = sort_value(key)
        ready = ready.withColumns({"_missing": missing, "_value": value})
    ready = cut_lineage(ready)
    folders = cut_lineage(_folder_elements(ready, key, sign))
    owners = ready.select("owner").distinct().select(
        "owner", F.posexplode(F.when(F.col("owner") == "", F.array(F.lit(""))).otherwise(text.self_and_ancestors("owner"))).alias("level", "folder")
    )
    # One array per owning folder, as long as the folder is deep.
    places = owners.join(folders.select("folder", "element"), "folder").groupBy("owner").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("level", "element"))), lambda x: x["element"]).alias("_place")
    )
    placed = ready.join(places, "owner")
    order = [F.col("_place")]
    if key:
        order += [F.col("_missing"), F.col("_value").desc_nulls_last() if descending else F.col("_value").asc_nulls_last()]
    indexed = with_global_index(placed, [*order, F.col("op_index")], "display_index")
    shown = indexed.drop("_place", "_missing", "_value")
    starts = (
        shown.groupBy("owner").agg(F.min("display_index").alias("_start"))
        .select("_start", F.explode(F.when(F.col("owner") == "", F.array(F.lit(""))).otherwise(text.self_and_ancestors("owner"))).alias("folder"))
        .groupBy("folder").agg(F.min("_start").alias("start"))
    )
    tree = folders.join(starts, "folder").select(
        "folder", text.depth("folder").alias("depth"), "first_index", "count", "executable_count", "bytes", "start",
        (F.col("start") + F.col("count")).alias("end"),
    )
    return shown, tree
