"""Merkle manifest of a dataset (operator 13): nested-interval labels, containment joins by level, siblings by interval difference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import ranked_in_group, with_global_index
from .common import cut_lineage, pick

#: Children of a node. Levels are worked off in bands: a band's subtree has at most WIDTH ** BAND nodes at its bottom.
WIDTH, BAND = 3, 3
REACH = WIDTH**BAND

LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<left:string,right:string>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' UTF-8 bytes, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """`-` for null, else the value's length in bytes, a colon, and the value; so no two lists of values read alike."""
    shown = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def leaf_digest(fields: list[Column]) -> Column:
    return digest(*[framed(f) for f in fields])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _parents(nodes: Column) -> Column:
    """The nodes above an ordered array of nodes: each covers the interval of WIDTH neighbours, the last one of what is left."""
    runs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / WIDTH).cast("int")), lambda i: F.slice(nodes, i * WIDTH + 1, WIDTH)
    )
    return F.transform(
        runs,
        lambda run: F.struct(
            run[0]["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"),
            digest(F.array_join(F.transform(run, lambda x: x["digest"]), "")).alias("digest"),
        ),
    )


def _bands(leaves: DataFrame, group: str, most: int) -> list[DataFrame]:
    """Subtrees, lowest band first. `leaves`: `group`, `size` (leaves of the group) and `node`: a struct of lo, hi, digest and more.

    Row: group, size, bucket, levels (arrays of nodes, lowest first), count (nodes of the whole group at the band's bottom).
    A subtree's nodes are neighbours under one ancestor, so grouping by bucket never gathers more than REACH of them.
    """
    made, nodes, reach = [], leaves, 1
    while True:
        bucket = F.floor(F.col("node.lo") / F.lit(reach * REACH)).cast("bigint")
        grouped = nodes.groupBy(group, "size", bucket.alias("bucket")).agg(
            F.array_sort(F.collect_list("node"), lambda a, b: F.signum(a["lo"] - b["lo"]).cast("int")).alias("bottom")
        )
        tree = _let(
            _parents(F.col("bottom")),
            lambda b: _let(_parents(b), lambda c: F.struct(b.alias("l1"), c.alias("l2"), _parents(c).alias("l3"))),
        )
        grouped = cut_lineage(
            grouped.withColumn("tree", tree).select(
                group, "size", "bucket", F.col("bottom").alias("l0"), "tree.l1", "tree.l2", "tree.l3",
                F.ceil(F.col("size") / F.lit(reach)).cast("bigint").alias("count"),
            )
        )
        made.append(grouped)
        reach *= REACH
        if most <= reach:
            return made
        nodes = grouped.where(F.col("count") > REACH).select(group, "size", F.col("l3")[0].alias("node"))


def _band_top(column: str = "digest") -> Column:
    """A finished group's topmost node: of the first level that has one node."""
    return (
        F.when(F.col("count") == 1, F.col("l0")[0][column]).when(F.col("count") <= WIDTH, F.col("l1")[0][column])
        .when(F.col("count") <= WIDTH**2, F.col("l2")[0][column]).otherwise(F.col("l3")[0][column])
    )


def _steps(x: Column, reach: int) -> Column:
    """Siblings of the node over `x.lo` at each level of its band: the parent's interval without the node's own.

    What ends at or before the position is a left sibling, what begins after it a right one. A level of one node has no step.
    """
    out = []
    for j, level in enumerate(["l0", "l1", "l2"]):
        wide = F.lit(reach * WIDTH ** (j + 1))
        own = F.floor(x["lo"] / wide)
        joined = lambda test: F.array_join(F.transform(F.filter(F.col(level), test), lambda s: s["digest"]), "")  # noqa: E731, B023
        step = F.struct(
            joined(lambda s: (F.floor(s["lo"] / wide) == own) & (s["hi"] <= x["lo"])).alias("left"),  # noqa: B023
            joined(lambda s: (F.floor(s["lo"] / wide) == own) & (s["lo"] > x["lo"])).alias("right"),  # noqa: B023
        )
        out.append(F.when(F.col("count") > WIDTH**j, F.array(step)).otherwise(F.array().cast(f"array<{STEP}>")))
    return F.concat(*out)


def _paths(bands: list[DataFrame], group: str, above: DataFrame | None) -> DataFrame:
    """`group`, `node` (a leaf's struct), steps from the leaf upwards, subroot, root. Bands are joined from the top down.

    A subtree meets the one node that contains it: both carry the bucket of that node's level, and its interval covers the
    subtree's. These are joins of one row with one row; no group's name is a key alone, so a large group is no hot key.
    `above` (group, up, root) continues the steps of a group's top; it meets the topmost subtree of each group only.
    """
    found = None
    for b in range(len(bands) - 1, -1, -1):
        reach = REACH**b
        band = bands[b].withColumn("ends", F.col("count") <= REACH)
        if above is not None:
            top = band.where("ends").select(group, "bucket", _band_top().alias("subroot")).join(above, group)
        else:
            top = band.where("ends").select(
                group, "bucket", _band_top().alias("subroot"), F.array().cast(f"array<{STEP}>").alias("up"), _band_top().alias("root")
            )
        higher = top
        if found is not None:
            higher = top.unionByName(
                found.select(
                    group, F.floor(F.col("node.lo") / F.lit(reach * REACH)).cast("bigint").alias("bucket"), "subroot",
                    F.col("steps").alias("up"), "root",
                )
            )
        joined = band.join(higher, [group, "bucket"]).withColumn("node", F.explode("l0"))
        found = joined.select(group, "node", F.concat(_steps(F.col("node"), reach), "up").alias("steps"), "subroot", "root")
        if b:
            found = cut_lineage(found)
    return found


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = LEAF_FIELDS, changed: Callable[[dict[str, Column]], dict[str, Column]] | None = None) -> DataFrame:
    """`key`, leaf, subroot, root, steps, proof_sha256, folded_root and verified of each row of `docs`.

    A row is a leaf; the leaves of a `group` ascend by key and form a tree in which WIDTH neighbours have one parent; the
    groups' tops form a tree of their own, in the order of their names. `steps` are the siblings to the left and right on
    each level up to the root, as a verifier needs them; `proof_sha256` is their digest. `changed` gives values of the fields
    as they are found later: the root is folded from the leaf of these and the original siblings, and `verified` compares it.

    Rows get their position in the group by range partitions, so a group of any size is spread; a node carries the interval
    of positions that it covers. BAND levels are built per shuffle, from subtrees of at most WIDTH ** BAND nodes, and
    each shuffle moves a 27th of the one before.

    Null and empty fields are told apart, a null group is a group of its own and comes first, null keys come first in their
    group. Rows of one key go by their leaf; equal rows have equal leaves and places beside each other. Whole texts count,
    however long; they are read once and only digests move. An empty table has an empty result; further columns don't count.
    """
    names = list(dict.fromkeys([key, group, *fields]))
    rows = pick(docs, *names).toDF(*[f"f{i}" for i in range(len(names))])
    value = {n: F.col(f"f{i}") for i, n in enumerate(names)}
    later = {**value, **(changed(value) if changed else {})}
    stored = cut_lineage(
        rows.select(
            # Null sorts before every name, and equality with it holds.
            F.when(value[group].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value[group].cast("string"))).alias("g"),
            value[key].alias("key"), leaf_digest([value[n] for n in fields]).alias("leaf"),
            leaf_digest([later[n] for n in fields]).alias("found"),
        )
    )
    placed = ranked_in_group(stored, ["g"], ["key", "leaf", "found"], "place", stored=True)
    sizes = cut_lineage(placed.groupBy("g").agg(F.max("place").alias("size")))
    most = sizes.agg(F.max("size")).first()[0] or 1
    lo = F.col("place") - 1
    node = F.struct(
        lo.alias("lo"), F.col("place").alias("hi"), F.col("leaf").alias("digest"), "key",
        F.when(F.col("found") != F.col("leaf"), F.col("found")).alias("found"),
    )
    # A group's size reaches its rows by key and salt: the group may hold most of them.
    salts = 32
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    leaves = placed.withColumn("salt", F.pmod(F.floor(lo / REACH), F.lit(salts)).cast("int")).join(salted, ["g", "salt"]).select("g", "size", node.alias("node"))
    bands = _bands(leaves, "g", most)

    tops = None
    for band in bands:
        own = band.where(F.col("count") <= REACH).select("g", _band_top().alias("digest"))
        tops = own if tops is None else tops.unionByName(own)
    listed = with_global_index(tops, [F.col("g")], "lo")
    number = sizes.count()
    sources = listed.select(
        F.lit(0).alias("all"), F.lit(number).cast("bigint").alias("size"),
        F.struct("lo", (F.col("lo") + 1).alias("hi"), "digest", "g").alias("node"),
    )
    above = _paths(_bands(sources, "all", max(1, number)), "all", None).select(F.col("node.g").alias("g"), F.col("steps").alias("up"), "root")
    paths = _paths(bands, "g", cut_lineage(above))

    fold = F.aggregate("steps", F.coalesce("node.found", "node.digest"), lambda acc, s: digest(s["left"], acc, s["right"]))
    sides = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    return paths.select(
        F.col("node.key").alias(key), F.col("node.digest").alias("leaf"), "subroot", "root", "steps",
        digest(sides).alias("proof_sha256"), fold.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def without_newlines(value: dict[str, Column], key: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """The contract's tampering: texts whose key's unsigned CRC-32 is even lose their newlines; a null key's text stays."""
    hit = F.pmod(F.crc32(value[key].cast("string").cast("binary")), F.lit(2)) == 0
    return {text: F.when(hit, F.replace(value[text], F.lit("\n"), F.lit(""))).otherwise(value[text])}
