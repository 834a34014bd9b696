"""Registered queries over masks, inventories, layout, chunk tables and table checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import masks, names, rows, text
from ..operators import chunk_ranges, delta, inventory, layout, validate
from ..sources import tables
from . import fixtures as fx

from .queries_plan import effective, plan_sql
from .registry import query


def base_sql(select, *more):
    return fx.with_sql(fx.BASE_SQL, *more, select=select)


# --- masks -------------------------------------------------------------------------------------------------

FILTER = masks.PathFilter(
    includes=["src1*/", "/src2/*", "*/doc-7?.txt"], excludes=["*/fr/", "*/doc-1*5.txt:", "!*/fr/doc-2*", "/src15/"], deletables=["*/es/", "*/doc-*9.txt"]
)
UP = "upper(path)"
PAR = "upper(regexp_replace(path, '/?[^/]*$', ''))"


@query(
    "path_filter",
    base_sql(
        f"""SELECT path, (regexp_full_match({UP}, '.*/FR/DOC-2.*') OR regexp_full_match({PAR}, '(.*/)?FR/DOC-2.*') OR NOT (
            regexp_full_match({PAR}, '(.*/)?FR(/.*)?') OR regexp_full_match({UP}, '(.*/)?DOC-1.*5[.]TXT') OR regexp_full_match({PAR}, 'SRC15(/.*)?')))
          AND (regexp_full_match({PAR}, 'SRC1.*') OR regexp_full_match({PAR}, 'SRC2(/.*)?') OR regexp_full_match({UP}, '(.*/)?DOC-7[^/][.]TXT')) AS passes,
        regexp_full_match({PAR}, '(.*/)?ES(/.*)?') OR regexp_full_match({UP}, '(.*/)?DOC-.*9[.]TXT') AS deletable FROM base"""
    ),
)
def path_filter(spark, sf):
    files = masks.folded_path(fx.base(spark, sf).select("path"))
    return files.select("path", FILTER.passes_file().alias("passes"), FILTER.is_deletable().alias("deletable"))


@query(
    "directory_filter",
    base_sql(
        """SELECT path, NOT excluded AND included AS enters, CASE WHEN excluded THEN true ELSE included OR regexp_full_match(upper(path), '.*') END AS descends FROM (
          SELECT path, regexp_full_match(upper(path), '(.*/)?FR(/.*)?') OR regexp_full_match(upper(path), 'SRC15(/.*)?') AS excluded,
            regexp_full_match(upper(path), 'SRC1.*') OR regexp_full_match(upper(path), 'SRC2(/.*)?') AS included
          FROM (SELECT DISTINCT unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS path FROM base))"""
    ),
)
def directory_filter(spark, sf):
    folders = masks.folded_path(inventory.directories_of(fx.base(spark, sf)))
    return folders.select("path", FILTER.passes_directory().alias("d")).select("path", "d.enters", "d.descends")


@query(
    "mask_preview",
    base_sql("SELECT path, starts_with(path, 'src1/') OR regexp_full_match(path, '.*/en/doc-1[^/]*[.]txt') AS hit FROM base"),
)
def mask_preview(spark, sf):
    files = masks.folded_path(fx.base(spark, sf).select("path"), clean=True)
    return files.select("path", masks.mask_hits(["/src1/", "*\\EN\\doc-1*.TXT:", "  "]).alias("hit"))


@query(
    "junk_presets",
    base_sql("SELECT path FROM base WHERE doc_id % 4 <> 1"),
)
def junk_presets(spark, sf):
    """Every fourth file lies where a preset of the default lists drops it."""
    b = fx.base(spark, sf)
    i = F.col("doc_id")
    placed = b.select(
        F.when(i % 16 == 1, F.concat(F.lit("$Recycle.Bin/"), F.col("path"))).when(i % 16 == 5, F.concat(F.col("path"), F.lit("/.ds_store")))
        .when(i % 16 == 9, F.concat(F.lit("recycler/"), F.col("path"))).when(i % 16 == 13, F.concat(F.lit("x/._"), i.cast("string")))
        .otherwise(F.col("path")).alias("path")
    )
    keep = masks.PathFilter(excludes=masks.expand_presets(masks.DEFAULT_PRESETS))
    return masks.folded_path(placed).where(keep.passes_file()).select("path")


# --- inventory ------------------------------------------------------------------------------------------------


@query(
    "scan_accounting",
    base_sql(
        """SELECT (SELECT count(*) FROM base WHERE NOT path LIKE '%/fr/%' AND doc_id % 50 <> 7) AS files, (SELECT count(*) FROM base WHERE path LIKE '%/fr/%') AS excluded_files,
        (SELECT count(*) FROM base WHERE doc_id % 50 = 7 AND NOT path LIKE '%/fr/%') AS placeholders,
        (SELECT string_agg(p, ' | ' ORDER BY p) FROM (SELECT regexp_replace(path, '/doc-', '/.doc-') || '.icloud' AS p FROM base WHERE doc_id % 50 = 7 AND NOT path LIKE '%/fr/%' ORDER BY p LIMIT 5)) AS samples"""
    ),
)
def scan_accounting(spark, sf):
    stub = F.concat(F.regexp_replace("path", "/doc-", "/.doc-"), F.lit(".icloud"))
    files = fx.base(spark, sf).select(F.lit("file").alias("kind"), F.when(F.col("doc_id") % 50 == 7, stub).otherwise(F.col("path")).alias("path"))
    made = inventory.scan_accounting(files, masks.PathFilter(excludes=["*/fr/"]))
    return made.select("files", "excluded_files", "placeholders", F.array_join("placeholder_samples", " | ").alias("samples"))


@query(
    "marked_folders",
    base_sql("SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path FROM base WHERE doc_id % 21 = 0 AND NOT path LIKE '%/fr/%'"),
)
def marked_folders(spark, sf):
    here = F.regexp_replace("path", "/[^/]*$", "")
    marker = F.when(F.col("doc_id") % 21 == 0, F.concat(here, F.lit("/.sync-here"))).otherwise(F.col("path"))
    files = fx.base(spark, sf).select(F.lit("file").alias("kind"), marker.alias("path"))
    return inventory.marked_folders(files, ".sync-here", pruned=["FR"])


def _scan(spark, sf):
    """Observed files (raw times), their time corrections, and the digest cache of the previous scan."""
    b = fx.base(spark, sf)
    i = F.col("doc_id")
    observed = b.where(i % 23 != 0).select(
        "path", F.lit("file").alias("kind"), "size", F.col("mtime_ms"), F.struct(F.when(i % 31 == 0, "unreadable").otherwise("full").alias("kind"), F.when(i % 31 != 0, F.sha2("text", 256)).alias("digest")).alias("identity"), "doc_id"
    )
    corrections = b.where(i % 9 == 0).select("path", (F.col("mtime_ms") + F.when(i % 18 == 0, 1).otherwise(0)).alias("ondisk_ms"), F.lit(77).cast("bigint").alias("intended_ms"))
    cache = b.where(i % 5 != 0).select(
        "path", (F.col("size") + F.when(i % 8 == 0, 1).otherwise(0)).alias("size"), "mtime_ms",
        F.struct(F.when(i % 13 == 0, "sampled").otherwise("full").alias("kind"), F.sha2("text", 256).alias("digest")).alias("identity"),
    )
    return observed, corrections, cache


@query(
    "digest_reuse",
    base_sql(
        """SELECT path, CASE WHEN doc_id % 9 = 0 AND doc_id % 18 <> 0 THEN 77 ELSE mtime_ms END AS mtime_ms, doc_id % 9 = 0 AND doc_id % 18 <> 0 AS matched,
        CASE WHEN NOT (doc_id % 9 = 0 AND doc_id % 18 <> 0) AND doc_id % 5 <> 0 AND doc_id % 8 <> 0 AND doc_id % 13 <> 0 THEN sha256(text) END AS cached_digest FROM base WHERE doc_id % 23 <> 0"""
    ),
)
def digest_reuse(spark, sf):
    observed, corrections, cache = _scan(spark, sf)
    fixed = inventory.correct_mtimes(observed, corrections)
    return inventory.reuse_digests(fixed, cache, sampled=False).select("path", "mtime_ms", "matched", "cached_digest")


@query(
    "effective_read_bytes",
    base_sql(
        """SELECT sum(CASE WHEN hit THEN 0 WHEN big >= 4194304 THEN 786432 ELSE big END)::BIGINT AS read_bytes, count(*) FILTER (NOT hit) AS files_to_read FROM (
        SELECT size * 1000 AS big, NOT (doc_id % 9 = 0 AND doc_id % 18 <> 0) AND doc_id % 5 <> 0 AND doc_id % 8 <> 0 AND ((size * 1000 >= 4194304) = (doc_id % 13 = 0)) AS hit FROM base WHERE doc_id % 23 <> 0)"""
    ),
)
def effective_read_bytes(spark, sf):
    observed, corrections, cache = _scan(spark, sf)
    big = lambda df: df.withColumn("size", F.col("size") * 1000)
    cache = cache.join(fx.base(spark, sf).select("path", F.col("size").alias("s")), "path").withColumn(
        "size", F.when(F.col("size") == F.col("s"), F.col("s") * 1000).otherwise(-1)
    ).drop("s")
    fixed = inventory.correct_mtimes(big(observed), corrections)
    return inventory.effective_read_bytes(inventory.reuse_digests(fixed, cache, sampled=True), sampled=True)


@query(
    "cache_reconcile",
    base_sql(
        """SELECT path, size, mtime_ms, 'full' AS kind FROM base WHERE doc_id % 23 <> 0 AND doc_id % 31 <> 0
        UNION ALL SELECT path, size + CASE WHEN doc_id % 8 = 0 THEN 1 ELSE 0 END, mtime_ms, CASE WHEN doc_id % 13 = 0 THEN 'sampled' ELSE 'full' END
        FROM base WHERE doc_id % 23 = 0 AND doc_id % 5 <> 0 AND path LIKE '%/de/%'"""
    ),
)
def cache_reconcile(spark, sf):
    observed, _, cache = _scan(spark, sf)
    made = inventory.reconcile_cache(cache, observed, True, masks.PathFilter(excludes=["*/de/"]))
    return made.select("path", "size", "mtime_ms", F.col("identity.kind").alias("kind"))


@query(
    "correction_reconcile",
    base_sql(
        """SELECT path, mtime_ms + CASE WHEN doc_id % 18 = 0 THEN 1 ELSE 0 END AS ondisk_ms FROM base WHERE doc_id % 9 = 0
        AND CASE WHEN doc_id % 23 <> 0 THEN doc_id % 18 <> 0 ELSE path LIKE '%/de/%' END"""
    ),
)
def correction_reconcile(spark, sf):
    observed, corrections, _ = _scan(spark, sf)
    matched = inventory.correct_mtimes(observed, corrections).where("matched").select("path")
    made = inventory.reconcile_corrections(corrections, observed, matched, True, masks.PathFilter(excludes=["*/de/"]))
    return made.select("path", "ondisk_ms")


@query(
    "sampled_digests",
    base_sql(
        """SELECT doc_id, CASE WHEN n < 4000 THEN 'full' ELSE 'sampled' END AS kind, CASE WHEN n < 4000 THEN sha256(b) ELSE sha256(
          unhex(string_agg_le) || b[1:300] || b[n // 2 + 1:n // 2 + 300] || b[n - 299:n]) END AS digest FROM (
        SELECT doc_id, encode(text) AS b, strlen(text) AS n, array_to_string(list_transform(range(0, 8), lambda i: lpad(hex((strlen(text) >> (8 * i)) & 255), 2, '0')), '') AS string_agg_le FROM base)"""
    ),
)
def sampled_digests(spark, sf):
    body = fx.base(spark, sf).select("doc_id", F.col("text").cast("binary").alias("b"))
    return body.select("doc_id", text.sampled_identity("b", window=300, minimum=4000).alias("i")).select("doc_id", "i.kind", "i.digest")


# --- layout ---------------------------------------------------------------------------------------------------


@query(
    "sorted_plan",
    plan_sql(
        """SELECT op_index, row_number() OVER (ORDER BY CASE WHEN dst_size IS NULL THEN 1 ELSE 0 END, dst_size DESC, op_index) - 1 AS display_index FROM own"""
    ),
)
def sorted_plan(spark, sf):
    return layout.sorted_plan(effective(spark, sf), "t.size", descending=True).select("op_index", "display_index")


TREE = """
parts AS (SELECT *, CASE WHEN owner = '' THEN [''] ELSE list_transform(range(1, len(string_split(owner, '/')) + 1), lambda i: array_to_string(string_split(owner, '/')[1:i], '/')) END AS line FROM own),
folds AS (SELECT folder, sum({value}) AS v, min(op_index) AS f, count(*) AS n, count(*) FILTER (action NOT IN ('conflict', 'note')) AS x, sum(coalesce(size, 0))::BIGINT AS bytes
  FROM (SELECT *, unnest(line) AS folder FROM parts) GROUP BY folder),
elem AS (SELECT folder, {{'m': CASE WHEN v IS NULL THEN 1 ELSE 0 END, 'v': CAST(-coalesce(v, 0) AS BIGINT), 'f': f}} AS e, f, n, x, bytes FROM folds),
places AS (SELECT owner, list(e.e ORDER BY len(string_split(l, '/'))) AS place FROM (SELECT DISTINCT owner, unnest(line) AS l FROM parts) o JOIN elem e ON e.folder = o.l GROUP BY owner),
shown AS (SELECT p.op_index, p.line, row_number() OVER (ORDER BY place, CASE WHEN {value} IS NULL THEN 1 ELSE 0 END, {value} DESC, p.op_index) - 1 AS display_index FROM parts p JOIN places q ON q.owner = p.owner)
""".format(value="src_size")


@query("grouped_rows", plan_sql("SELECT op_index, display_index FROM shown", TREE))
def grouped_rows(spark, sf):
    return layout.grouped_plan(effective(spark, sf), "s.size", descending=True)[0].select("op_index", "display_index")


@query(
    "grouped_folders",
    plan_sql(
        """SELECT e.folder, (length(e.folder) - length(replace(e.folder, '/', '')))::INT AS depth, e.f AS first_index, e.n AS count, e.x AS executable_count, e.bytes,
        s.start, s.start + e.n AS "end" FROM elem e JOIN (SELECT unnest(line) AS folder, min(display_index) AS start FROM shown GROUP BY 1) s ON s.folder = e.folder""",
        TREE,
    ),
)
def grouped_folders(spark, sf):
    return layout.grouped_plan(effective(spark, sf), "s.size", descending=True)[1]


# --- chunks and deltas ---------------------------------------------------------------------------------------------

SIZES = dict(minimum=256, average=1024, maximum=4096)


def _versions(spark, sf):
    """Chunks of every document (base) and of the same document with a line inserted in the middle (new)."""
    b = fx.base(spark, sf).select("doc_id", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), half), F.lit("\n-- edited --\n"), F.col("text").substr(half + 1, F.length("text")))
    new = b.where("doc_id % 3 <> 0").select("doc_id", edited.alias("text"))
    cut = lambda df: delta.chunk_table(df, ["doc_id"], "text", **SIZES)
    return cut(new), cut(b.where("doc_id % 4 <> 0"))


@query("chunk_table")
def chunk_table(spark, sf):
    """Boundaries depend on content, so there is no SQL form; tests compare with a byte-by-byte model."""
    return delta.chunk_table(fx.base(spark, sf).select("doc_id", "text"), ["doc_id"], "text", **SIZES)


@query(
    "chunk_coverage",
    base_sql("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, true AS contiguous FROM base WHERE strlen(text) > 0"),
)
def chunk_coverage(spark, sf):
    """Chunk lengths add up to each text's bytes, and every offset is the sum of the lengths before it."""
    from ..cluster import running_total

    chunks = running_total(chunk_table(spark, sf), ["doc_id"], ["position"], F.col("len"), "expected")
    return chunks.groupBy("doc_id").agg(F.sum("len").alias("size"), F.bool_and(F.col("expected") == F.col("off")).alias("contiguous"))


@query(
    "chunk_range_coverage",
    base_sql("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, true AS contiguous, true AS as_whole FROM base WHERE strlen(text) > 0"),
)
def chunk_range_coverage(spark, sf):
    """The same when ranges of 1,000 bytes are worked off side by side; each chunk is also one of the whole text's."""
    from ..cluster import running_total

    kinds = {"minimum": 256, "average": 1024, "maximum": 4096}
    base = fx.base(spark, sf).select("doc_id", F.col("text").cast("binary").alias("content"))
    made = chunk_ranges.chunk_table_by_ranges(base, ["doc_id"], location=None, content="content", span=1000, **kinds)
    chunks = running_total(made, ["doc_id"], ["position"], F.col("len"), "expected")
    whole = delta.chunk_table(base, ["doc_id"], "content", **kinds).withColumn("found", F.lit(True))
    both = chunks.join(whole, ["doc_id", "position", "off", "len", "hash"], "left")
    return both.groupBy("doc_id").agg(
        F.sum("len").alias("size"), F.bool_and(F.col("expected") == F.col("off")).alias("contiguous"),
        F.bool_and(F.coalesce("found", F.lit(False))).alias("as_whole"),
    )


@query(
    "recipe_check",
    base_sql("SELECT doc_id, true AS sound FROM base WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0 AND strlen(text) > 0"),
)
def recipe_check(spark, sf):
    """Every recipe must rebuild its file: steps in bounds, sizes and ordered chunk digests equal."""
    new, base = _versions(spark, sf)
    recipe = delta.delta_recipe(new, base, ["doc_id"])
    saved = delta.delta_savings(recipe, ["doc_id"])
    payload = saved.select("doc_id", "size", F.col("blob_bytes").alias("blob_size"))
    bases = base.groupBy("doc_id").agg(F.sum("len").alias("base_size"))
    faults = delta.recipe_faults(recipe, payload, bases, ["doc_id"])
    digests = delta.reassembled_digests(recipe, new, base, ["doc_id"])
    same = F.col("rebuilt_digest").eqNullSafe(F.col("original_digest"))
    return digests.join(faults, "doc_id", "left").select("doc_id", (same & F.col("fault").isNull()).alias("sound"))


PIECES = """
piece AS (SELECT doc_id, i - 1 AS position, (i - 1) * 700 AS off, CAST(length(substr(text, (i - 1) * 700 + 1, 700)) AS BIGINT) AS len, sha256(substr(text, (i - 1) * 700 + 1, 700)) AS hash
  FROM (SELECT doc_id, text, unnest(range(1, CAST((length(text) + 699) // 700 AS BIGINT) + 1)) AS i FROM base)),
fresh AS (SELECT doc_id, position, off, len, CASE WHEN (doc_id + position) % 4 = 0 THEN sha256(hash) ELSE hash END AS hash FROM piece)
"""


def _pieces(spark, sf):
    """Fixed-width pieces of every text, and a version where every fourth one changed."""
    b = fx.base(spark, sf)
    n = F.floor((F.length("text") + 699) / 700).cast("int")
    piece = b.where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("position"))
    body = F.col("text").substr(F.col("position") * 700 + 1, F.lit(700))
    base = piece.select("doc_id", F.col("position").cast("bigint").alias("position"), (F.col("position") * 700).cast("bigint").alias("off"), F.length(body).cast("bigint").alias("len"), F.sha2(body, 256).alias("hash"))
    changed = (F.col("doc_id") + F.col("position")) % 4 == 0
    return base.withColumn("hash", F.when(changed, F.sha2("hash", 256)).otherwise(F.col("hash"))), base


@query(
    "delta_recipe",
    base_sql(
        """SELECT f.doc_id, f.position, CASE WHEN b.off IS NULL THEN 'blob' ELSE 'base' END AS source, f.len,
        coalesce(b.off, sum(CASE WHEN b.off IS NULL THEN f.len ELSE 0 END) OVER (PARTITION BY f.doc_id ORDER BY f.position) - f.len)::BIGINT AS off
        FROM fresh f LEFT JOIN (SELECT doc_id, hash, len, arg_min(off, position) AS off FROM piece GROUP BY doc_id, hash, len) b ON b.doc_id = f.doc_id AND b.hash = f.hash AND b.len = f.len""",
        PIECES,
    ),
)
def delta_recipe(spark, sf):
    new, base = _pieces(spark, sf)
    return delta.delta_recipe(new, base, ["doc_id"]).select("doc_id", "position", "source", "len", "off")


@query(
    "delta_savings",
    base_sql(
        """SELECT f.doc_id, sum(f.len)::BIGINT AS size, sum(CASE WHEN b.doc_id IS NULL THEN f.len ELSE 0 END)::BIGINT AS blob_bytes, count(*) AS steps,
        sum(CASE WHEN b.doc_id IS NULL THEN 0 ELSE f.len END)::BIGINT AS saved
        FROM fresh f LEFT JOIN (SELECT DISTINCT doc_id, hash, len FROM piece) b ON b.doc_id = f.doc_id AND b.hash = f.hash AND b.len = f.len GROUP BY f.doc_id""",
        PIECES,
    ),
)
def delta_savings(spark, sf):
    new, base = _pieces(spark, sf)
    return delta.delta_savings(delta.delta_recipe(new, base, ["doc_id"]), ["doc_id"])


@query(
    "patch_bytes",
    base_sql(
        """SELECT f.doc_id, sum(CASE WHEN b.off = f.off AND b.len = f.len THEN 0 ELSE f.len END)::BIGINT AS written_bytes, sum(f.len)::BIGINT AS size
        FROM fresh f LEFT JOIN (SELECT doc_id, hash, arg_max(off, position) AS off, arg_max(len, position) AS len FROM piece GROUP BY doc_id, hash) b ON b.doc_id = f.doc_id AND b.hash = f.hash GROUP BY f.doc_id""",
        PIECES,
    ),
)
def patch_bytes(spark, sf):
    new, base = _pieces(spark, sf)
    return delta.patch_bytes(new, base, ["doc_id"])


@query(
    "ordered_digests",
    base_sql(
        "SELECT doc_id, d AS digest FROM lv WHERE n = 1",
        PIECES,
        """lv(doc_id, level, o, d, n) AS (
          SELECT doc_id, 1, position // 8, sha256(string_agg(sha256(hash), '' ORDER BY position)), any_value(n + 7) // 8
          FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM piece) GROUP BY doc_id, position // 8
          UNION ALL
          SELECT doc_id, level + 1, o // 8, sha256(string_agg(d, '' ORDER BY o)), (n + 7) // 8 FROM lv WHERE n > 1 GROUP BY doc_id, level, o // 8, n
        )""",
    ),
)
def ordered_digests(spark, sf):
    base = _pieces(spark, sf)[1]
    return delta.ordered_digest(base, ["doc_id"], "position", F.col("hash"), "digest", bucket=8)


@query("plan_digest")
def plan_digest(spark, sf):
    plan = effective(spark, sf)
    return delta.plan_digest(plan, ["side", "action", "path", "from", "size", "mtime_ms", "hash", "link", "mode", "reason"])


# --- checks ------------------------------------------------------------------------------------------------------


@query(
    "entry_checks",
    base_sql(
        """SELECT rule, count(*) AS n FROM (
          SELECT 'identity does not fit the evidence tier' AS rule FROM base WHERE doc_id % 10 = 1
          UNION ALL SELECT 'digest is not 64 lower-case hex' FROM base WHERE doc_id % 10 = 2
          UNION ALL SELECT 'more than three older identities' FROM base WHERE doc_id % 10 = 3
          UNION ALL SELECT 'snapshot entry carries archive history' FROM base WHERE doc_id % 10 IN (3, 4)
          UNION ALL SELECT 'archive history holds a non-digest' FROM base WHERE doc_id % 10 = 4
          UNION ALL SELECT 'invalid permission bits' FROM base WHERE doc_id % 10 = 5
          UNION ALL SELECT 'unsafe path' FROM base WHERE doc_id % 10 = 6
          UNION ALL SELECT 'paths must be unique' FROM base WHERE doc_id % 10 = 7) GROUP BY rule
        UNION ALL SELECT 'declared entry count differs', 1 UNION ALL SELECT 'walk error samples are inconsistent with their count', 1"""
    ),
)
def entry_checks(spark, sf):
    b = fx.base(spark, sf)
    i = F.col("doc_id") % 10
    older = lambda n, kind: F.array(*[F.struct(F.lit(kind).alias("kind"), F.sha2("text", 256).alias("digest"))] * n)
    e = b.select(
        F.lit("file").alias("kind"), F.when(i == 6, F.concat(F.lit("../"), F.col("path"))).otherwise(F.col("path")).alias("path"), "size", "mtime_ms",
        F.struct(F.when(i == 1, "sampled").otherwise("full").alias("kind"), F.when(i == 2, F.upper(F.sha2("text", 256))).otherwise(F.sha2("text", 256)).alias("digest")).alias("identity"),
        F.lit(None).cast("string").alias("file_system_id"), F.when(i == 5, 5000).otherwise(420).alias("mode"),
        F.when(i == 3, older(4, "full")).when(i == 4, older(1, "size_and_mtime")).alias("previous_identities"), F.lit(None).cast("string").alias("target"), "doc_id",
    )
    entries = e.drop("doc_id").unionByName(e.where("doc_id % 10 = 7").drop("doc_id"))
    header = spark.range(1).select(
        F.lit(2).cast("bigint").alias("schema"), F.lit("snapshot").alias("kind"), F.lit(-1).cast("bigint").alias("entry_count"), F.lit("full").alias("evidence"),
        F.lit(0).alias("walk_errors"), F.array(F.lit("a")).alias("walk_err_samples"), F.lit(0).alias("icloud_stubs"), F.array().cast("array<string>").alias("icloud_stub_samples"),
        F.array(F.lit("a"), F.lit("b")).alias("unread_paths"), F.lit(None).cast("struct<protocol:string,display_root:string>").alias("vfs"),
    )
    return validate.snapshot_faults(header, entries).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    "plan_checks",
    plan_sql(
        """SELECT rule, subject, detail FROM (
          SELECT 'duplicate mutation' AS rule, side || ':' || path AS subject, CAST(count(*) AS VARCHAR) AS detail FROM bad WHERE action IN ('copy', 'update', 'move', 'delete', 'chmod') GROUP BY side, path HAVING count(*) > 1
          UNION ALL SELECT 'duplicate move source', side || ':' || from_path, CAST(count(*) AS VARCHAR) FROM bad WHERE action = 'move' GROUP BY side, from_path HAVING count(*) > 1
          UNION ALL SELECT 'move has no content, time or link evidence', from_path, '' FROM bad WHERE action = 'move'
          UNION ALL SELECT 'move source is also mutated', m.side || ':' || m.path, CAST(m.n AS VARCHAR) FROM (SELECT side, path, count(*) AS n, count(*) FILTER (action = 'update' AND from_path IS NULL) AS u FROM bad WHERE action IN ('copy', 'update', 'move', 'delete', 'chmod') GROUP BY side, path) m
            JOIN (SELECT side, from_path, count(*) AS k FROM bad WHERE action = 'move' GROUP BY side, from_path) s ON s.side = m.side AND s.from_path = m.path WHERE NOT (k = 1 AND n = 1 AND u = 1))""",
        """bad AS (SELECT side, action, CASE WHEN op_index % 90 IN (20, 28) THEN 'same/' || op_index // 90 WHEN op_index % 90 IN (47, 29) THEN 'freed/' || op_index // 90 ELSE path END AS path,
          CASE WHEN action = 'move' AND op_index % 90 = 27 THEN 'freed/' || op_index // 90 WHEN action = 'move' AND op_index % 90 IN (36, 45) THEN 'twice/' || op_index // 180 ELSE from_path END AS from_path FROM plan)""",
    ),
)
def plan_checks(spark, sf):
    """A plan with doubled writes, doubled move sources, and names freed and written again."""
    p = fx.review_plan(spark, sf)
    i = F.col("op_index")
    at = lambda prefix, k: F.concat(F.lit(prefix), F.floor(i / k).cast("string"))
    is_move = F.col("action") == "move"
    bad = p.withColumns(
        {
            "path": F.when((i % 90).isin(20, 28), at("same/", 90)).when((i % 90).isin(47, 29), at("freed/", 90)).otherwise(F.col("path")),
            "from": F.when(is_move & (i % 90 == 27), at("freed/", 90)).when(is_move & (i % 90).isin(36, 45), at("twice/", 180)).otherwise(F.col("from")),
        }
    )
    return validate.plan_faults(bad)


@query(
    "package_sets",
    base_sql(
        """SELECT CASE WHEN p <> m THEN 'plan and manifest disagree' ELSE 'manifest and members disagree' END AS rule, path AS subject,
        concat_ws(',', CASE WHEN p THEN 'plan' END, CASE WHEN m THEN 'manifest' END, CASE WHEN t THEN 'members' END) AS detail
        FROM (SELECT path, doc_id % 7 <> 0 AS p, doc_id % 11 <> 0 AS m, doc_id % 13 <> 0 AS t FROM base) WHERE (p OR m OR t) AND (p <> m OR m <> t)"""
    ),
)
def package_sets(spark, sf):
    b = fx.base(spark, sf)
    return validate.set_disagreements(b.where("doc_id % 7 <> 0"), b.where("doc_id % 11 <> 0"), b.where("doc_id % 13 <> 0"))


@query(
    "package_checks",
    base_sql(
        """SELECT rule, count(*) AS n FROM (
          SELECT CASE doc_id % 12 WHEN 1 THEN 'whole payload has another size' WHEN 2 THEN 'whole payload carries delta-only fields' WHEN 3 THEN 'hash is not a digest'
            WHEN 4 THEN 'delta payload is incomplete' WHEN 5 THEN 'recipe reads beyond its blob' WHEN 6 THEN 'recipe reconstructs another size' WHEN 7 THEN 'unknown payload kind'
            WHEN 8 THEN 'operation cannot execute on the target' WHEN 9 THEN 'manifest lists a payload twice' END AS rule FROM base) WHERE rule IS NOT NULL GROUP BY rule"""
    ),
)
def package_checks(spark, sf):
    b = fx.base(spark, sf).withColumns({"k": F.col("doc_id") % 12, "digest": F.sha2("text", 256)})
    k = F.col("k")
    ops = b.select(F.when(k == 8, "source").otherwise("target").alias("side"), F.lit("copy").alias("action"), "path", F.lit(None).cast("string").alias("from"), F.lit(None).cast("string").alias("link"))
    step = lambda source, off, n: F.array(F.struct(F.lit(source).alias("source"), F.lit(off).cast("bigint").alias("off"), n.cast("bigint").alias("len")))
    is_delta = k.isin(4, 5, 6, 10)
    manifest = b.select(
        "path", "size", F.when(k == 3, "zz").otherwise(F.col("digest")).alias("hash"),
        F.when(is_delta, "delta").when(k == 7, "patch").otherwise("whole").alias("kind"),
        F.when(is_delta | (k == 2), F.col("digest")).alias("base_hash"), F.when(is_delta & (k != 4), F.col("digest")).alias("blob_hash"),
        F.when(k == 5, step("blob", 1, F.col("size"))).when(k == 6, step("base", 0, F.col("size") + 1)).when(is_delta, step("blob", 0, F.col("size"))).alias("recipe"), "k",
    )
    manifest = manifest.unionByName(manifest.where("k = 9"))
    members = b.select("path", (F.col("size") + F.when(k == 1, 1).otherwise(0)).alias("size"))
    faults = validate.package_faults(ops, manifest.drop("k"), members)
    return faults.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    "reviewable_subplan",
    plan_sql("SELECT count(*) AS op_count, 0::BIGINT AS conflict_count FROM eff WHERE side = 'target' AND action NOT IN ('conflict', 'note')"),
)
def reviewable_subplan(spark, sf):
    return validate.header_counts(validate.reviewable_subplan(effective(spark, sf)))


@query(
    "windows_faults",
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'mangled' WHEN strpos(url, ':') > 0 THEN 'mangled' END AS fault FROM pages""",
)
def windows_faults(spark, sf):
    p = fx.table(spark, sf, "pages")
    name = F.concat(F.when(F.col("page_id") % 5 == 0, F.lit("dir. /")).otherwise(""), F.regexp_replace("url", "/+", "/"))
    return p.select("page_id", names.windows_fault(name)["fault"].alias("fault"))


@query(
    "archive_migration",
    base_sql(
        """SELECT path, 'sampled' AS evidence, CASE WHEN doc_id % 6 = 1 THEN 'unreadable' WHEN doc_id % 6 = 2 THEN 'sampled' WHEN doc_id % 6 = 3 THEN 'size_and_mtime' ELSE 'full' END AS kind,
        CASE WHEN doc_id % 6 IN (1, 3) THEN NULL ELSE sha256(text) END AS digest, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END AS older FROM base"""
    ),
)
def archive_migration(spark, sf):
    b = fx.base(spark, sf)
    i = F.col("doc_id") % 6
    d = F.sha2("text", 256)
    old = b.select(
        "path", F.lit("file").alias("kind"), "size", "mtime_ms", F.when(i == 2, F.concat(F.lit("~"), d)).when(~i.isin(1, 3), d).alias("hash"),
        F.when(i == 1, True).alias("hash_failed"), F.lit(None).cast("string").alias("file_id"), F.lit(420).alias("mode"), F.lit(None).cast("string").alias("link"),
        F.when(F.col("doc_id") % 4 == 0, F.array(d, F.concat(F.lit("~"), d))).alias("prev"),
    )
    made = tables.migrate_archive(old, hashed=True)
    return made.select("path", "evidence", F.col("identity.kind").alias("kind"), F.col("identity.digest").alias("digest"), F.size("previous_identities").alias("older"))


@query(
    "rigor_axes",
    """SELECT o_orderkey AS job, preset, CASE WHEN o_orderkey % 3 = 0 THEN true ELSE preset <> 'quick' END AS hash, preset IN ('fast', 'balanced', 'standard') AS sampled,
      CASE WHEN o_orderkey % 4 = 0 THEN false ELSE preset IN ('fast', 'balanced') END AS use_cache, preset IN ('fast', 'balanced', 'standard') AS escalate, preset IN ('balanced', 'standard', 'paranoid') AS verify_writes
      FROM (SELECT o_orderkey, ['quick', 'fast', 'balanced', 'standard', 'paranoid'][o_orderkey % 5 + 1] AS preset FROM orders)""",
)
def rigor_axes(spark, sf):
    presets = F.array(*[F.lit(p) for p in rows.RIGOR])
    o = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), F.element_at(presets, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("preset"))
    overrides = {"hash": F.when(F.col("job") % 3 == 0, True), "use_cache": F.when(F.col("job") % 4 == 0, False)}
    return o.select("job", "preset", rows.rigor_axes(F.col("preset"), overrides).alias("a")).select("job", "preset", "a.*")


