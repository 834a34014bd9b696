"""Escalation, evidence checks, SQL functions, and the registered queries' bookkeeping."""

from pyspark.sql import functions as F

from tests.helpers import file, folder, inventory
from treeledger.functions.register import register_masks, register_sql
from treeledger.operators import evidence, validate
from treeledger.plans import ORACLES, QUERIES
from treeledger.plans.compare import compare


def test_escalated_rows_follow_the_sorted_plan(spark):
    source = inventory(spark, file("z", "same", kind="sampled", mtime=9000), file("a", "same", kind="sampled", mtime=9000), file("new", "n"), file("in", "s", kind="sampled", mtime=1))
    target = inventory(spark, file("z", "same", kind="sampled", mtime=1), file("a", "same", kind="sampled", mtime=1), file("in", "s", kind="sampled", mtime=2000))
    plan = compare(source, target, "mirror").plan()
    suspects = evidence.escalation_suspects(source, target, 2000)
    assert sorted(r["path"] for r in suspects.collect()) == ["a", "z"]
    full = spark.createDataFrame([("source", "a", "1"), ("target", "a", "2"), ("source", "z", "3"), ("target", "z", "4")], "side string, path string, digest string")
    for mode, action in (("mirror", "update"), ("sync", "conflict"), ("enrich", "update")):
        made = evidence.escalation_verdicts(suspects, full, mode, 2000)
        assert [r["action"] for r in made.collect()] == [action] * 2
    made = evidence.escalation_verdicts(suspects, full, "mirror", 2000)
    rows = evidence.append_escalated(plan, made).orderBy("op_index").collect()
    assert [(r["op_index"], r["path"], r["hash"]) for r in rows] == [(0, "new", "n"), (1, "a", "1"), (2, "z", "3")]
    better = evidence.upgrade_identities(source.entries, full.where("side = 'source'"))
    kinds = {r["path"]: (r["identity"]["kind"], r["identity"]["digest"]) for r in better.collect()}
    assert kinds["a"] == ("full", "1") and kinds["in"] == ("sampled", "s")


def test_evidence_uses_each_sides_own_name(spark):
    source = inventory(spark, file("n/a", "m", size=7, mtime=3), folder("n"))
    target = inventory(spark, file("o/a", "m", size=7, mtime=5), folder("o"))
    made = compare(source, target, "mirror")
    plan = evidence.attach_evidence(made.plan(), made.sides)
    rows = {r["action"]: r for r in plan.collect()}
    assert (rows["move"]["src"]["mtime_ms"], rows["move"]["dst"]["mtime_ms"]) == (3, 5)
    assert rows["delete_dir"]["src"] is None and rows["delete_dir"]["dst"]["size"] == 0
    assert validate.evidence_faults(plan, plan).count() == 0
    wrong = plan.withColumn("src", F.lit(None).cast("struct<size:bigint,mtime_ms:bigint>"))
    assert [r["subject"] for r in validate.evidence_faults(wrong, plan).collect()] == ["n/a"]


def test_sql_functions(spark):
    assert "norm_key" in register_sql(spark)
    register_masks(spark, "is_junk", ["*/node_modules/", "*.tmp"])
    row = spark.sql(
        "SELECT norm_key(p) AS k, path_parent(p) AS d, path_name(p) AS b, path_depth(p) AS n, windows_name_fault(p) AS f, is_junk(p) AS j, is_conflict_copy(p) AS c "
        "FROM VALUES ('x/café:1.TMP') AS t(p)"
    ).first()
    assert tuple(row) == ("X/CAFÉ:1.TMP", "x", "café:1.TMP", 1, "mangled", True, False)
    assert spark.sql("SELECT windows_name_fault('a/con.txt') AS f, windows_name_fault('ok') AS g, is_junk('a/node_modules/b') AS j").first() == ("unusable", None, True)


def test_every_sql_counterpart_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) - len(ORACLES) <= 5
