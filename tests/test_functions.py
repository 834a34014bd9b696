"""Scalar functions, masks and log lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from treeledger.functions import masks, names, rows, text
from treeledger.sources.runs import parse_log_lines


def column(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_keys(spark):
    got = column(spark, ["A/b.TXT", "caf\u00e9", "cafe\u0301", "", "\u6df7\u5408Case", None], text.norm_key("v").alias("u"), text.norm_key("v", False).alias("e"))
    assert got == [("A/B.TXT", "A/b.TXT"), ("CAF\u00c9", "caf\u00e9"), ("CAF\u00c9", "caf\u00e9"), ("", ""), ("\u6df7\u5408CASE", "\u6df7\u5408Case"), (None, None)]


def test_paths(spark):
    got = column(spark, ["a/b/c.tar.gz", "top", ".hidden", "x/.git"], text.parent("v"), text.base_name("v"), text.split_ext(text.base_name("v"))["ext"], text.depth("v"))
    assert got == [("a/b", "c.tar.gz", ".gz", 2), ("", "top", "", 0), ("", ".hidden", "", 0), ("x", ".git", "", 1)]
    faults = column(spark, ["a/b", "", "a\\b", "C:x", "/a", "a//b", "a/../b", "./a"], text.path_fault("v"), text.path_fault("v", "directory"), text.path_fault("v", "name"))
    assert [bool(f[0]) for f in faults] == [False] + [True] * 7
    assert faults[1][1] is None and faults[0][2] == "a directory entry must contain exactly one segment"
    shown = column(spark, ["//srv/share//", "C:\\root\\\\", "/r"], text.join_display("v", F.lit("a/b")))
    assert [s[0] for s in shown] == ["//srv/share/a/b", "C:\\root\\a\\b", "/r/a/b"]


def test_formats(spark):
    sizes = ["0", "938", "1024", "2304", "2816", "1610612736", "1099511627776", "2251799813685248"]
    assert [r[0] for r in column(spark, sizes, text.human_bytes(F.col("v").cast("bigint")))] == [
        "0 B", "938 B", "1.0 KiB", "2.2 KiB", "2.8 KiB", "1.5 GiB", "1.0 TiB", "2048.0 TiB"
    ]
    stamps = column(spark, ["0", "951782400000", "-1000"], text.stamp_compact(F.col("v").cast("bigint")), text.stamp_iso(F.col("v").cast("bigint")))
    assert stamps == [("19700101-000000", "1970-01-01T00:00:00Z"), ("20000229-000000", "2000-02-29T00:00:00Z"), ("19691231-235959", "1969-12-31T23:59:59Z")]
    assert column(spark, ["3723000", "65000"], text.human_duration(F.col("v").cast("bigint"))) == [("1:02:03",), ("1:05",)]
    assert column(spark, ["=1", "a\"b", "-x"], text.csv_quoted("v")) == [('"\'=1"',), ('"a""b"',), ('"\'-x"',)]
    assert column(spark, ["~" + "a" * 64, "A" * 64], text.is_digest(text.digest_body("v")), text.is_sampled("v")) == [(True, True), (False, False)]


def test_windows_faults(spark):
    values = ["ok/x", "a./b", "a /b", "r:1", "q?.txt", "x/CON.txt", "x/com9", "tab\t", "lpt10"]
    got = [r[0] for r in column(spark, values, names.windows_fault("v")["fault"])]
    assert got == [None, "mangled", "mangled", "mangled", "rejected", "unusable", "unusable", "rejected", None]


def model_match(path, mask, with_children):
    """Byte-by-byte reading of the mask rules: after a star, the next character must be found again."""
    def go(p, m):
        while True:
            if not m:
                return not p or (with_children and p[0] == "/")
            if m[0] == "?":
                if not p or p[0] == "/":
                    return False
            elif m[0] == "*":
                m = m.lstrip("*")
                if not m:
                    return True
                want, m = m[0], m[1:]
                return any((c != "/" if want == "?" else c == want) and go(p[i + 1:], m) for i, c in enumerate(p))
            elif not p or p[0] != m[0]:
                return False
            p, m = p[1:], m[1:]
    return go(path, mask)


def test_mask_regex_equals_model():
    rng = random.Random(5)
    for _ in range(20_000):
        mask = "".join(rng.choice("AB/*?") for _ in range(rng.randrange(1, 7)))
        path = "".join(rng.choice("AB/") for _ in range(rng.randrange(0, 8)))
        for children in (False, True):
            regex = r"(?s)\A(?:" + masks._regex(mask, children) + r")\Z"
            assert bool(re.match(regex, path)) == model_match(path, mask, children), (path, mask, children)


def test_filters(spark):
    keep = masks.PathFilter(excludes=["*/node_modules/", "*.log", "!*/keep.log", "/build/*"], deletables=["*/.DS_Store"])
    values = ["a/b.txt", "x/node_modules/y.js", "z.LOG", "q/keep.log", "build/out", "src/build/out", "a/.treeledger.tmp.1", ".treeledger/x", "a/.ds_store"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, path string").coalesce(1)
    got = masks.folded_path(df).orderBy("i").select(keep.passes_file(), keep.is_deletable()).collect()
    assert [r[0] for r in got] == [True, False, False, True, False, True, False, False, True]
    assert [r[1] for r in got] == [False] * 6 + [True, False, True]


def test_presets():
    assert masks.preset_ids([" Dev ", "none", ""]) == ["Dev"]
    with pytest.raises(ValueError, match="unknown junk preset 'nope'"):
        masks.preset_ids(["nope"])
    assert masks.expand_presets(["office", "WINDOWS"])[:2] == ["*/System Volume Information/", "*/$RECYCLE.BIN/"]
    assert masks.same_line("*\\thumbs.DB ", "*/Thumbs.db")
    every = [masks.folded_line(m) for p in masks.JUNK_PRESETS.values() for m in p]
    assert len(every) == len(set(every))


def test_reversal(spark):
    schema = "side string, action string, path string, `from` string, size bigint, mtime_ms bigint, hash string, link string, mode int, reason string, src struct<size:bigint,mtime_ms:bigint>, dst struct<size:bigint,mtime_ms:bigint>"
    plan = spark.createDataFrame(
        [
            ("target", "copy", "a", None, 5, 1, "h", None, None, "r", None, None), ("target", "update", "b", None, 5, 1, "h", None, 420, "r", (5, 1), (9, 2)),
            ("target", "update", "c", None, 5, 1, "h", None, None, "r", (5, 1), None), ("source", "delete", "d", None, 5, None, None, None, None, "r", None, None),
            ("target", "move", "e", "f", 5, 1, "h", None, None, "r", None, None), ("target", "update", "l", None, None, None, None, "x", None, "r", None, None),
        ],
        schema,
    ).coalesce(1).withColumn("reversed", F.lit(True))
    got = {r["path"]: r for r in rows.apply_reversals(plan).collect()}
    assert (got["a"]["action"], got["a"]["side"], got["a"]["size"], got["a"]["hash"], got["a"]["src"]["size"]) == ("delete", "source", 5, None, 5)
    assert (got["b"]["side"], got["b"]["size"], got["b"]["mode"], got["b"]["reason"]) == ("source", 9, 420, "reversed(r)")
    assert got["c"]["reversal_refused"] and got["e"]["reversal_refused"] and not got["b"]["reversal_refused"]
    assert (got["d"]["action"], got["d"]["side"]) == ("copy", "target")
    assert (got["l"]["side"], got["l"]["link"], got["l"]["size"]) == ("source", "x", None)


def test_log_lines(spark):
    lines = [
        "plain text", "{broken", "[1]", '{"kind":"log","ts_ms":5,"level":"warn","scope":"s","message":"m"}', '{"kind":"log","ts_ms":5}',
        '{"kind":"nope","ts_ms":1}', '{"kind":"summary","ts_ms":9,"done":1,"skipped":2,"errors":3,"bytes_done":2304,"elapsed_ms":1500,"paused_ms":0,"cancelled":true}',
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, line string").coalesce(1)
    got = [(r["level"], r["scope"], r["message"]) for r in parse_log_lines(df, "run").orderBy("i").collect()]
    assert got[0] == ("info", "legacy", "plain text")
    assert got[1][:2] == ("error", "parse") and got[2][2].endswith("must be a JSON object")
    assert got[3] == ("warn", "s", "m") and got[4][2] == "Malformed JSON log record: missing 'level'"
    assert got[5][1] == "parse" and got[6] == ("error", "final", "\u25a0 Done: 1 run, 2 skipped, 3 errors \u00b7 2.2 KiB \u00b7 1.5s \u00b7 cancelled")
    plan = spark.createDataFrame([(0, '{"op":{"side":"target","action":"copy","path":"a","reason":"why"}}'), (1, '{"op":{"side":"target"}}')], "i int, line string").coalesce(1)
    got = [r["message"] for r in parse_log_lines(plan, "plan").orderBy("i").collect()]
    assert got == ["copy  a  (target) why", "Malformed JSON log record: missing 'action'"]
