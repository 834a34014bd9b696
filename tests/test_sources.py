"""Round trips of tables and plans, strict line checks, scanning a real tree, exports, run artifacts."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tests.helpers import file, folder, inventory, link, shown
from treeledger.functions.masks import PathFilter
from treeledger.operators import evidence
from treeledger.plans.compare import compare, plan_header
from treeledger.sources import runs, tables


def header_row(kind="snapshot", **more):
    base = dict(
        schema=2, kind=kind, root="/r", host="h", os="linux", scanned_at_ms=1, duration_ms=1, entry_count=2, evidence="full", excluded_dirs=0,
        excluded_files=0, walk_errors=0, walk_err_samples=[], unread_paths=["un"], icloud_stubs=0, icloud_stub_samples=[], skipped_symlinks=0,
        dataless_files=0, vfs=None,
    )
    return {**base, **more}


def test_reads_exchange_lines(spark, tmp_path):
    digest = "a" * 64
    lines = [
        json.dumps(header_row(vfs=dict(protocol="ftp", display_root="ftp://x", mtime_precision_ms=60000, medium="unknown", name_rules="windows", degraded=[]))),
        json.dumps(dict(kind="file", path="a.txt", size=3, mtime_ms=5, identity=dict(kind="full_hash", digest=digest), file_system_id=None, mode=420, previous_identities=[])),
        json.dumps(dict(kind="symlink", path="l", mtime_ms=5, target="a.txt")),
    ]
    path = tmp_path / "snap.jsonl"
    path.write_text("\n".join(lines) + "\n")
    inv = tables.read_inventory(spark, str(path))
    assert inv.header.rules == "windows" and inv.header.mtime_precision_ms == 60000
    assert [r["path"] for r in inv.unread.collect()] == ["un"]
    rows = {r["path"]: r for r in inv.entries.collect()}
    assert rows["a.txt"]["identity"].asDict() == {"kind": "full", "digest": digest} and rows["l"]["target"] == "a.txt"
    assert tables.line_faults(spark, str(path), "snapshot").count() == 0
    with pytest.raises(ValueError):
        tables.read_inventory(spark, str(path), "archive")
    path.write_text("\n".join([json.dumps(header_row(schema=1)), "", json.dumps(dict(kind="file", path="x", extra=1)), "{oops", json.dumps(dict(kind="pipe", path="y"))]) + "\n")
    faults = sorted(r["fault"] for r in tables.line_faults(spark, str(path), "snapshot").collect())
    assert faults == ["empty line", "invalid JSON", "schema 1 is unsupported; rebuild it with a fresh scan", "unknown entry field", "unknown entry kind"]


def test_table_and_plan_round_trip(spark, tmp_path):
    source = inventory(spark, file("b/2", "2"), file("a/1", "1", mode=0o644), folder("a"), link("z", "a/1"))
    head = spark.createDataFrame([json.dumps(header_row(kind="archive"))], "string").select(F.from_json("value", tables.HEADER).alias("h")).select("h.*")
    out = str(tmp_path / "table")
    tables.write_table(head, source.entries, out)
    back = tables.read_inventory(spark, out, "archive")
    assert sorted(back.entries.collect(), key=lambda r: r["path"]) == sorted(source.entries.select(*back.entries.columns).collect(), key=lambda r: r["path"])
    made = compare(source, inventory(spark, file("a/1", "x"), file("old", "2")), "mirror")
    plan = made.plan()
    tables.write_plan(plan_header(made, 7), plan, str(tmp_path / "plan"))
    again = tables.read_plan(spark, str(tmp_path / "plan"))
    assert again.orderBy("op_index").collect() == plan.select(*again.columns).orderBy("op_index").collect()
    assert tables.read_plan_header(spark, str(tmp_path / "plan")).first()["op_count"] == len(shown(made))


def test_plan_lines_without_positions_keep_file_order(spark, tmp_path):
    path = tmp_path / "plan.jsonl"
    ops = [dict(side="target", action="copy", path=f"p{9 - i}", reason="r") for i in range(5)]
    path.write_text("\n".join([json.dumps(dict(schema=2, kind="plan"))] + [json.dumps(o) for o in ops[:3]] + [""] + [json.dumps(o) for o in ops[3:]]))
    rows = tables.read_plan(spark, str(path)).orderBy("op_index").collect()
    assert [(r["op_index"], r["path"]) for r in rows] == [(i, f"p{9 - i}") for i in range(5)]


def test_scan_reuses_the_cache_and_filters(spark, tmp_path):
    root = tmp_path / "tree"
    for name, body in {"a.txt": b"one", "d/b.txt": b"two", "d/skip.log": b"no", "big.bin": b"z" * 9}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
        os.utime(root / name, (1_700_000_000, 1_700_000_000))
    keep = PathFilter(excludes=["*.log"])
    first = tables.scan_tree(spark, str(root), "full", keep)
    got = {r["path"]: (r["size"], r["mtime_ms"], r["identity"]["kind"], r["identity"]["digest"]) for r in first.collect()}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {
        "a.txt": (3, 1_700_000_000_000, "full", digest(b"one")), "d/b.txt": (3, 1_700_000_000_000, "full", digest(b"two")),
        "big.bin": (9, 1_700_000_000_000, "full", digest(b"z" * 9)),
    }
    (root / "a.txt").write_bytes(b"changed")
    cache = first.select("path", "size", "mtime_ms", "identity").withColumn(
        "identity", F.when(F.col("path") == "d/b.txt", F.struct(F.lit("full").alias("kind"), F.lit("cached").alias("digest"))).otherwise(F.col("identity"))
    )
    again = {r["path"]: r["identity"]["digest"] for r in tables.scan_tree(spark, str(root), "full", keep, cache).collect()}
    assert again == {"a.txt": digest(b"changed"), "d/b.txt": "cached", "big.bin": digest(b"z" * 9)}
    none = tables.scan_tree(spark, str(root), "none").select("identity.kind").distinct().collect()
    assert [r["kind"] for r in none] == ["size_and_mtime"]


def test_review_csv(spark, tmp_path):
    made = compare(inventory(spark, file("=a,\"b\"", "1", mtime=951_782_400_000)), inventory(spark, file("gone", "2")), "mirror")
    plan = evidence.attach_evidence(made.plan(), made.sides)
    wanted = spark.createDataFrame([(0, 1, False, True), (1, 0, False, False)], "position int, op_index bigint, reversed boolean, included boolean")
    rows = evidence.presented_rows(plan, wanted).select("position", *evidence.export_columns("/s", "/t"))
    out = str(tmp_path / "csv")
    tables.write_review_csv(rows, out)
    lines = [r["value"] for r in spark.read.text(out).select("value", F.col("_metadata.file_path").alias("f")).orderBy("f").collect()]
    first = sorted(p for p in os.listdir(out) if p.startswith("part"))[0]
    with open(os.path.join(out, first), "rb") as f:
        assert f.read(3) == b"\xef\xbb\xbf"
    assert lines == [
        "included,action,side,rel_path,from,source_path,target_path,src_size,src_mtime_utc,dst_size,dst_mtime_utc,reason",
        '1,delete,target,"gone","","","/t/gone",,,10,,"gone-from-source"',
        '0,copy,target,"\'=a,""b""","","/s/=a,""b""","",10,2000-02-29T00:00:00Z,,,"only-in-source"',
    ]


def test_run_artifacts(spark, tmp_path):
    events = spark.createDataFrame(
        [("r1", 1, "log", "info", None), ("r1", 2, "log", "warn", None), ("r1", 3, "progress", None, None), ("r2", 4, "item_result", None, "ok"), ("r2", 5, "error", None, None)],
        "run_id string, seq bigint, kind string, level string, outcome string",
    )
    runs.write_routed(events, str(tmp_path / "out"), "warn")
    got = spark.read.text(str(tmp_path / "out")).groupBy("run_id", "artifact").count().collect()
    assert {(r["run_id"], r["artifact"], r["count"]) for r in got} == {("r1", "run", 1), ("r1", "errors", 1), ("r2", "items", 1), ("r2", "run", 1), ("r2", "errors", 1)}
    folder_ = tmp_path / "logs" / "r9"
    folder_.mkdir(parents=True)
    (folder_ / "run.jsonl").write_text("l1\nl2\nl3\n")
    (folder_ / "items.jsonl").write_text("i1\n")
    assert [r["line"] for r in runs.artifact_lines(spark, str(tmp_path / "logs"), "r9", "run", 2).collect()] == ["l1", "l2"]
    assert {tuple(r) for r in runs.read_artifact_lines(spark, str(tmp_path / "logs"), "items").collect()} == {("r9", "i1")}


def test_result_store(spark, tmp_path):
    path = str(tmp_path / "store")
    row = lambda job, seq: spark.createDataFrame([(job, 0, "r", seq)], "job_id string, target_index int, revision string, sequence bigint")
    for seq in (1, 2):
        tables.append_result(row("j", seq), path)
    tables.append_result(row("k", 7), path)
    assert tables.next_sequence(spark, path, "j") == 3 and tables.next_sequence(spark, path, "none") == 1


def test_bucketed_inventories_compare_without_an_exchange(spark, tmp_path):
    from treeledger.operators.compare import Options, Sides

    names = []
    for i, rows in enumerate([[file("a", "1"), file("B", "2"), file("b", "3")], [file("A", "1"), file("c", "4")]]):
        names.append(f"bucketed_{os.getpid()}_{i}")
        dropped = tables.save_bucketed(inventory(spark, *rows).entries, names[-1], 2)
        assert [r["path"] for r in dropped.collect()] == ([] if i else ["b"])
    try:
        source, target = (tables.bucketed_inventory(spark, n) for n in names)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = Sides(source, target, Options()).joined(("file", "symlink"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
        assert [(r[0], r[2]) for r in shown(compare(source, target, "mirror"))] == [("copy", "B"), ("delete", "c")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")
