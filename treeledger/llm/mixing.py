"""Mixing sources to target weights (operator 4) by a multivariate-hypergeometric splitting tree, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import ranked_in_group, running_total, with_global_index
from .common import WORD, cut_lineage, even_lookup, first_of_repeated, identified, salted

#: Words of a block, and blocks of an output shard at most.
BLOCK_WORDS = 1 << 16
SHARD_BLOCKS = 64
#: Draws are inverted within so many standard deviations of their mean; what lies beyond weighs less than 1e-20.
DEVIATIONS = 10
LARGE = 8


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, rank, source_size and target of each source of (source, size).

    Sources by code point, null last, take the weights in turn and share `share` times all sizes. A target stops at `most`
    times its source's size; what is over is shared again by weight among the others until none is above. Only the two sums of
    a round reach the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    totals = with_global_index(totals.withColumn("last", F.col("source").isNull()), [F.col("last"), F.col("source")], "rank").drop("last")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    totals = cut_lineage(totals.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))))
    top = F.col("source_size") * F.lit(float(most))
    wanted = share * (totals.agg(F.sum("source_size")).first()[0] or 0)
    unit = float("-inf")  # words a weight of 1 gets
    while True:
        full = top < F.col("weight") * F.lit(unit)
        fixed, open_ = totals.agg(F.sum(F.when(full, top).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not open_:
            break
        shared = (wanted - fixed) / open_
        if shared <= unit:
            break
        unit = shared
    unit = unit if unit > 0 else 0.0
    return totals.withColumn("target", F.least(top, F.col("weight") * F.lit(unit))).drop("weight")


def allocate(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, **shares) -> DataFrame:
    """One row per document: key, id, size, source, rank, source_size, target, at, copies.

    `id` tells rows apart whose keys are null or repeated; equal rows share it. Each source's documents stand in a
    pseudo-random order that depends on seed, key, size and, for documents alike in these, id only. Whole passes over the
    source come first. The rest of the target takes documents of the order while they fit whole: large ones (over 1 / LARGE of
    the rest) first, since the others can fill up what these leave, and last the one document whose size is nearest to what is
    still open, if that comes nearer. `at` is the number of words before the document in the order. Null texts and texts without words have size 0 and are never drawn.
    """
    missing = [n for n in (key, text, source) if n not in docs.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    k, t, s = (F.col(f"_c{docs.columns.index(c)}") for c in (key, text, source))
    sizes = cut_lineage(
        identified(docs).select(
            k.alias("key"), F.col("_id").alias("id"), s.alias("source"),
            F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        ).withColumn("row", F.monotonically_increasing_id())
    )
    targets = cut_lineage(source_targets(sizes.select("source", "size"), **shares))
    order = F.xxhash64(F.lit(seed), F.col("key"), F.col("size"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rows = even_lookup(sizes, targets, ["source"]).withColumn("order", order).withColumn("passes", passes)
    rows = rows.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("small", F.col("size") * LARGE <= F.col("rest"))
    placed = running_total(rows, ["rank", "small"], ["order", "key", "id", "row"], F.col("size"), "at")
    fits = F.col("at") + F.col("size") <= F.col("rest")
    large = placed.where("not small").groupBy("rank").agg(F.max(F.when(fits, F.col("at") + F.col("size"))).alias("given"), F.sum("size").alias("ahead"))
    placed = even_lookup(placed, large, ["rank"]).fillna(0, ["given", "ahead"])
    part = F.when(F.col("small"), F.col("at") + F.col("size") <= F.col("rest") - F.col("given")).otherwise(fits)
    placed = cut_lineage(placed.withColumn("part", part).withColumn("at", F.when(F.col("small"), F.col("ahead") + F.col("at")).otherwise(F.col("at"))))
    left = placed.groupBy("rank").agg((F.max("rest") - F.sum(F.when(F.col("part"), F.col("size")).otherwise(0))).alias("gap"))
    open_ = even_lookup(placed.where("not part and size > 0").select("rank", "size", "order", "id", "row"), left, ["rank"])
    off = F.abs(F.col("size") - F.col("gap"))
    last = open_.where(off < F.col("gap")).groupBy("rank").agg(F.min(F.struct(off.alias("off"), "order", "id", "row")).alias("best"))
    placed = placed.join(last.select(F.col("best.row").alias("row"), F.lit(True).alias("last")), "row", "left")
    extra = (F.col("part") | F.coalesce("last", F.lit(False))).cast("int")
    copies = F.when(F.col("size") > 0, F.col("passes") + extra).otherwise(0).cast("int")
    return cut_lineage(placed.withColumn("copies", copies).select("key", "id", "source", "size", "row", "rank", "source_size", "target", "at", "copies"))


def shard_quotas(blocks: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """shard, rank, quota: how many of each source's `blocks` (rank, quota) every shard gets.

    The root holds all quotas. At each level a node's left child gets half of the node's blocks, how many of each source being
    a draw without replacement (one hypergeometric draw per source, given those before), and the right child gets the rest.
    The leaves' quotas add up to the sources' quotas exactly. Nodes are rows; every four levels they are dealt out anew and
    stored. A node's row holds one number per source.
    """
    depth = max(0, (shards - 1).bit_length())
    node = blocks.groupBy().agg(F.array_sort(F.collect_list(F.struct("rank", "quota"))).alias("all")).select(
        F.lit(0).cast("bigint").alias("node"), F.col("all.rank").alias("ranks"), F.col("all.quota").alias("quotas")
    )
    for level in range(depth):
        if level % 4 == 0 and level:
            node = cut_lineage(node.repartition("node"))
        total = F.aggregate("quotas", F.lit(0).cast("bigint"), lambda a, q: a + q)
        node = node.withColumn("total", total)
        start = F.struct(F.col("total").alias("pool"), F.floor(F.col("total") / 2).alias("open"), F.lit(0).alias("i"), F.array().cast("array<bigint>").alias("taken"))

        def draw(state: Column, quota: Column) -> Column:
            bits = F.xxhash64(F.lit(seed), F.lit(level), F.col("node"), state["i"])  # noqa: B023  used up before the next level
            uniform = (bits.bitwiseAND(F.lit((1 << 53) - 1)) + F.lit(0.5)) / F.lit(float(1 << 53))
            return let(hypergeometric(state["pool"], quota, state["open"], uniform), lambda k: F.struct((state["pool"] - quota).alias("pool"), (state["open"] - k).alias("open"), (state["i"] + 1).alias("i"), F.concat(state["taken"], F.array(k)).alias("taken")))

        node = node.withColumn("left", F.aggregate("quotas", start, draw, lambda s: s["taken"]))
        right = F.zip_with("quotas", "left", lambda q, k: q - k)
        sides = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas")))
        node = node.select("ranks", F.explode(sides).alias("side")).select("side.node", "ranks", "side.quotas")
    pairs = F.arrays_zip(F.col("ranks").alias("rank"), F.col("quotas").alias("quota"))
    return node.select(F.col("node").alias("shard"), F.explode(pairs).alias("p")).select("shard", "p.rank", "p.quota").where("quota > 0")


def let(value: Column, body) -> Column:
    """`body` of a value that is worked out once; otherwise each mention would be an expression of its own."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series nine factors up, which keeps the error below 1e-12; the factors are divided out again."""

    def series(m: Column) -> Column:
        x = m + 10.0
        above = m + 1.0
        for i in range(2, 10):
            above = above * (m + float(i))
        return (x - 0.5) * F.ln(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) - F.ln(above)

    return let(n.cast("double"), series)


def hypergeometric(pool: Column, good: Column, draws: Column, uniform: Column) -> Column:
    """Successes among `draws` from `pool` items of which `good` count, by inversion of `uniform` in (0, 1)."""
    n, k, m = pool.cast("double"), good.cast("double"), draws.cast("double")
    mean = F.when(n > 0, m * k / n).otherwise(0.0)
    spread = F.when(n > 1, F.sqrt(F.greatest(m * k / n * (1 - k / n) * (n - m) / (n - 1), F.lit(0.0)))).otherwise(0.0)

    def bounds(s: Column) -> Column:
        reach = DEVIATIONS * s["spread"] + 10
        low = F.greatest(F.lit(0), s["m"] - (s["n"] - s["k"]), F.floor(s["mean"] - reach))
        high = F.least(s["k"], s["m"], F.ceil(s["mean"] + reach))
        return let(F.struct(s["n"].alias("n"), s["k"].alias("k"), s["m"].alias("m"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high")), invert)

    def invert(s: Column) -> Column:
        choose = lambda a, b: log_factorial(a) - log_factorial(b) - log_factorial(a - b)
        first = F.exp(choose(s["k"], s["low"]) + choose(s["n"] - s["k"], s["m"] - s["low"]) - choose(s["n"], s["m"]))
        start = let(first, lambda x: F.struct(s["low"].alias("pick"), x.alias("mass"), x.alias("sum")))

        def step(t: Column, j: Column) -> Column:
            """From j - 1 to j successes, unless the sum is there already."""
            i = j - 1
            mass = t["mass"] * (s["k"] - i) * (s["m"] - i) / ((i + 1) * (s["n"] - s["k"] - s["m"] + i + 1))
            return F.when(t["sum"] >= uniform, t).otherwise(let(mass, lambda x: F.struct(j.alias("pick"), x.alias("mass"), (t["sum"] + x).alias("sum"))))

        steps = F.when(s["high"] > s["low"], F.sequence(s["low"] + 1, s["high"])).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(steps, start, step, lambda t: t["pick"])

    return let(F.struct(n.alias("n"), k.alias("k"), m.alias("m"), mean.alias("mean"), spread.alias("spread")), bounds)


def mix(allocated: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 7) -> DataFrame:
    """The mix, one row per taken copy: the columns of `allocated` with copy, block, shard and order.

    The words a source gives stand in a row: its passes one after another, each in the source's order. They are cut into
    blocks; the splitting tree deals the blocks' numbers to the shards, and each shard draws its number from the source's
    permuted blocks, disjoint from the other shards' draws. Inside a shard, `order` shuffles the rows. Reruns agree.
    """
    copies = allocated.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    copies = copies.withColumn("block", F.floor((F.col("copy") * F.col("source_size") + F.col("at")) / block_words))
    quotas = cut_lineage(copies.groupBy("rank").agg((F.max("block") + 1).alias("quota")))
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    shards = 1
    while shards * shard_blocks < total:
        shards *= 2
    dealt = running_total(cut_lineage(shard_quotas(quotas, shards, seed)), ["rank"], ["shard"], F.col("quota"), "begin", stored=True)
    dealt = dealt.select("shard", "rank", F.explode(F.sequence(F.col("begin") + 1, F.col("begin") + F.col("quota"))).alias("place"))
    blocks = quotas.select("rank", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("quota") - 1)).alias("block"))
    blocks = ranked_in_group(blocks.withColumn("_h", F.xxhash64(F.lit(seed), "rank", "block")), ["rank"], ["_h", "block"], "place").drop("_h")
    homes = blocks.join(dealt, ["rank", "place"]).drop("place")
    return copies.join(homes, ["rank", "block"]).withColumn("order", F.xxhash64(F.lit(seed), "shard", "key", "id", "size", "copy"))


def taken(allocated: DataFrame, mixed: DataFrame) -> DataFrame:
    """`allocated` with `taken`: the words of each document in the mix, repeats counted."""
    same = [c for c in allocated.columns]
    both = allocated.withColumn("_w", F.lit(0).cast("bigint")).unionByName(mixed.select(*same, F.col("size").alias("_w")))
    return both.groupBy("row").agg(*[F.first(c).alias(c) for c in same if c != "row"], F.sum("_w").alias("taken"))


def shuffled(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix with the documents' own columns, a shard's rows together and in the shard's order: what is written for training.

    Every row of `mixed` gives one row, whatever the keys: it meets its document by `id`, and of equal rows of `docs` one
    stands for all. `docs` has the columns that `allocate` saw.
    """
    placed = identified(docs)
    drawn = mixed.select(F.col("id").alias("_id"), "row", "shard", "order")
    repeated = cut_lineage(placed.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id"))
    if repeated.isEmpty():
        joined = placed.join(drawn, "_id")
    else:
        joined = salted(placed, repeated, "left_anti").join(drawn, "_id")
        again = even_lookup(drawn, first_of_repeated(placed, repeated), ["_id"], "inner")
        joined = joined.unionByName(again)
    rows = joined.repartition("shard").sortWithinPartitions("shard", "order")
    return rows.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
