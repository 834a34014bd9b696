"""Pairing added and deleted files of equal content into moves.

Rule: inside one (flow, digest, size) bucket the adds act in key order, and each takes the first
remaining deleted file with the same parent, else the first with the same name, else the first.

Buckets split by shape:
* one add or one delete: plain joins with a `min_by`, whatever the size of the other side;
* several on both sides, within `BUCKET_LIMIT` rows: one grouped pandas pass per bucket;
* larger: rounds of distributed proposals. Because all deleted files rank the adds alike (by key
  order), the greedy result is the only stable assignment, so proposing in any order reaches it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import cut_lineage, ranked_in_group, spread_lookup
from ..functions import text

# A grouped pass holds one bucket: at this many short rows, some tens of megabytes.
BUCKET_LIMIT = 100_000
BUCKET = ["flow", "digest", "size"]
PAIRS = "flow string, digest string, size bigint, add_key string, del_key string, candidates bigint"


def eligible(candidates: DataFrame) -> DataFrame:
    """Files that may take part: whole-content digest, not empty, not a kept conflict copy."""
    return candidates.where(
        (F.col("file.identity.kind") == "full") & (F.col("file.size") > 0) & ~text.is_conflict_copy("file.path")
    ).select(
        "flow", F.col("file.identity.digest").alias("digest"), F.col("file.size").alias("size"), "key",
        text.parent("file.path").alias("parent"), text.base_name("file.path").alias("name"),
    )


def pair_moves(adds: DataFrame, dels: DataFrame, limit: int = BUCKET_LIMIT) -> DataFrame:
    """Pairs (flow, digest, size, add_key, del_key, candidates). Inputs carry flow, key and a `file` struct."""
    a, d = eligible(adds), eligible(dels)
    na = a.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("na"))
    nd = d.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("nd"))
    buckets = cut_lineage(na.join(nd, BUCKET))
    shapes = {
        r["shape"]
        for r in buckets.groupBy(
            F.when(F.col("nd") == 1, "one_del").when(F.col("na") == 1, "one_add")
            .when(F.col("na") + F.col("nd") <= limit, "few").otherwise("many").alias("shape")
        ).count().collect()
    }
    parts = []
    if "one_del" in shapes:
        parts.append(_one_delete(a, d, buckets.where("nd = 1")))
    if "one_add" in shapes:
        parts.append(_one_add(a, d, buckets.where("na = 1 and nd > 1")))
    crowded = (F.col("na") > 1) & (F.col("nd") > 1)
    if "few" in shapes:
        parts.append(_few(a, d, buckets.where(crowded & (F.col("na") + F.col("nd") <= limit))))
    if "many" in shapes:
        parts.append(_many(a, d, buckets.where(crowded & (F.col("na") + F.col("nd") > limit))))
    if not parts:
        return adds.sparkSession.createDataFrame([], PAIRS)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _one_delete(a: DataFrame, d: DataFrame, buckets: DataFrame) -> DataFrame:
    first = spread_lookup(a, buckets.select(*BUCKET), BUCKET, "inner").groupBy(*BUCKET).agg(F.min("key").alias("add_key"))
    only = d.join(buckets, BUCKET, "left_semi").select(*BUCKET, F.col("key").alias("del_key"))
    return first.join(only, BUCKET).select(*BUCKET, "add_key", "del_key", F.lit(1).cast("bigint").alias("candidates"))


def _preference(parent: Column, name: Column) -> Column:
    return (
        F.when(F.col("parent") == parent, 0).when(F.col("name") == name, 1).otherwise(2)
    )


def _one_add(a: DataFrame, d: DataFrame, buckets: DataFrame) -> DataFrame:
    only = a.join(buckets, BUCKET).select(  # one row per bucket
        *BUCKET, "nd", F.col("key").alias("add_key"), F.col("parent").alias("ap"), F.col("name").alias("an")
    )
    best = F.min_by(F.col("key"), F.struct(_preference(F.col("ap"), F.col("an")), F.col("key")))
    return spread_lookup(d, only, BUCKET, "inner").groupBy(*BUCKET, "add_key", "nd").agg(best.alias("del_key")).select(
        *BUCKET, "add_key", "del_key", F.col("nd").alias("candidates")
    )


def _few(a: DataFrame, d: DataFrame, buckets: DataFrame) -> DataFrame:
    rows = a.withColumn("is_add", F.lit(True)).unionByName(d.withColumn("is_add", F.lit(False)))
    return rows.join(buckets.select(*BUCKET), BUCKET, "left_semi").groupBy(*BUCKET).applyInPandas(greedy_bucket, PAIRS)


def greedy_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """One bounded bucket. Keys sort by their UTF-8 bytes, as Spark orders strings."""
    rows = rows.iloc[rows["key"].str.encode("utf-8").argsort(kind="stable")]
    adds, dels = rows[rows["is_add"]], rows[~rows["is_add"]]
    left = dict.fromkeys(dels["key"])
    queues: dict[tuple[str, str], list[str]] = {}
    for key, parent, name in zip(dels["key"], dels["parent"], dels["name"]):
        queues.setdefault(("parent", parent), []).append(key)
        queues.setdefault(("name", name), []).append(key)
    for q in queues.values():
        q.reverse()
    everything = list(left)[::-1]
    out = []
    for key, parent, name in zip(adds["key"], adds["parent"], adds["name"]):
        if not left:
            break
        for queue in (queues.get(("parent", parent)), queues.get(("name", name)), everything):
            while queue and queue[-1] not in left:
                queue.pop()
            if queue:
                out.append((key, queue[-1], len(left)))
                del left[queue[-1]]
                break
    pairs = pd.DataFrame(out, columns=["add_key", "del_key", "candidates"])
    for c in reversed(BUCKET):
        pairs.insert(0, c, rows[c].iloc[0])
    return pairs


# --- large buckets ------------------------------------------------------------------------------------

_LIST = ["flow", "digest", "size", "stage", "wants"]


def _many(a: DataFrame, d: DataFrame, buckets: DataFrame) -> DataFrame:
    """Proposal rounds over the large buckets. No bucket is ever gathered into one task.

    Each add walks three lists: files with its parent, files with its name, all files. In a round the
    j-th asking add of a list (in key order) proposes to the j-th file that would still accept the list's
    first free add; adds after that one which hold files through the same list ask again with it, so a
    file lost to another list shifts the whole list at once. That is exact up to the first position whose
    holder outranks the proposer; the rest wait for the next round. An add past the end of its list moves
    to its next list.
    """
    ranked = ranked_in_group(spread_lookup(a, buckets, BUCKET, "inner"), BUCKET, ["key"], "turn")
    free = cut_lineage(
        ranked.where(F.col("turn") <= F.col("nd")).select(
            *BUCKET, "nd", F.col("key").alias("add_key"), "parent", "name", "turn", F.lit(1).alias("stage")
        )
    )
    files = d.join(buckets.select(*BUCKET), BUCKET, "left_semi").select(*BUCKET, F.col("key").alias("del_key"), "parent", "name")
    lists = cut_lineage(
        files.select(
            *BUCKET, "del_key",
            F.explode(
                F.array(
                    F.struct(F.lit(1).alias("stage"), F.col("parent").alias("wants")),
                    F.struct(F.lit(2).alias("stage"), F.col("name").alias("wants")),
                    F.struct(F.lit(3).alias("stage"), F.lit("").alias("wants")),
                )
            ).alias("_l"),
        ).select(*BUCKET, "del_key", "_l.*")
    )
    carried = [*BUCKET, "nd", "add_key", "parent", "name", "turn", "stage"]
    held = free.limit(0).select(*carried, F.lit("").alias("del_key"))
    wants = F.when(F.col("stage") == 1, F.col("parent")).when(F.col("stage") == 2, F.col("name")).otherwise(F.lit(""))
    while not free.isEmpty():
        asking = free.withColumn("wants", wants)
        earliest = asking.groupBy(*_LIST).agg(F.min("turn").alias("_first"))
        # Later holders of the same list give way: they can only move down it, and do so in this round.
        listed = cut_lineage(
            spread_lookup(held.withColumn("wants", wants), earliest, _LIST)
            .withColumn("_yields", F.coalesce(F.col("turn") > F.col("_first"), F.lit(False))).drop("_first")
        )
        held = listed.where("not _yields").select(*carried, "del_key")
        pool = asking.unionByName(listed.where("_yields").select(*asking.columns))
        asking = ranked_in_group(pool, _LIST, ["turn"], "j")
        holders = held.select(*BUCKET, "del_key", F.col("turn").alias("holder"))
        open_files = (
            spread_lookup(lists, earliest, _LIST, "inner")
            .join(holders, [*BUCKET, "del_key"], "left")
            .where(F.col("holder").isNull() | (F.col("holder") > F.col("_first")))
            .select(*_LIST, "del_key", "holder")
        )
        offered = ranked_in_group(open_files, _LIST, ["del_key"], "j")
        matched = asking.join(offered, [*_LIST, "j"], "left")
        blocked = matched.where(F.col("holder") <= F.col("turn")).groupBy(*_LIST).agg(F.min("j").alias("_stop"))
        judged = cut_lineage(spread_lookup(matched, blocked, _LIST))
        accepted = judged.where(
            F.col("del_key").isNotNull() & (F.col("_stop").isNull() | (F.col("j") < F.col("_stop")))
        ).select(*carried, "del_key")
        waiting = judged.where(F.col("del_key").isNotNull() & (F.col("j") >= F.col("_stop"))).select(*carried)
        moved_on = judged.where(F.col("del_key").isNull()).withColumn("stage", F.col("stage") + 1).select(*carried)
        claims = held.unionByName(accepted)
        best = claims.groupBy(*BUCKET, "del_key").agg(F.min("turn").alias("_best"))
        settled = cut_lineage(claims.join(best, [*BUCKET, "del_key"]))
        held = settled.where(F.col("turn") == F.col("_best")).select(*carried, "del_key")
        beaten = settled.where(F.col("turn") > F.col("_best")).select(*carried)
        free = cut_lineage(waiting.unionByName(moved_on).unionByName(beaten))
    return held.select(
        *BUCKET, "add_key", "del_key", (F.col("nd") - F.col("turn") + 1).alias("candidates")
    )
