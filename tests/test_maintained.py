"""A maintained comparison equals a full one after every round, and a round touches its changes' buckets only."""

import random

import pytest

from treeledger.operators.compare import Options
from treeledger.operators.inventory import Header, Inventory
from treeledger.plans.compare import compare
from treeledger.plans.maintained import CHANGE, Maintained, changes_between, last_changes
from treeledger.schema import ENTRY
from treeledger.streaming import events as st
from tests.helpers import file, folder, inventory, link, shown


def some(r, names):
    rows = {}
    for n in names:
        kind = r.random()
        rows[n] = link(n, r.choice("xy")) if kind < 0.1 else folder(n) if kind < 0.2 else file(n, r.choice("abcdef"), r.choice([0, 5]), r.choice([0, 50_000]))
    return rows


def changed(r, rows, names):
    """Some entries go, some come, some differ."""
    out = dict(rows)
    for n in r.sample(names, 6):
        if r.random() < 0.4:
            out.pop(n, None)
        else:
            out[n] = some(r, [n])[n]
    return out


def frame_of(spark, rows):
    return spark.createDataFrame(list(rows.values()), ENTRY).coalesce(1)


@pytest.mark.parametrize("mode,with_archive", [("mirror", False), ("sync", True)])
def test_rounds_equal_full_comparisons(spark, tmp_path, mode, with_archive):
    r = random.Random(len(mode))
    names = [f"{d}/{n}" for d in ("a", "A", "b/c") for n in [*"mnopqrs", "N"]]  # two spellings fold onto one key
    source, target = some(r, names), some(r, r.sample(names, 18))
    archive = inventory(spark, *some(r, names).values(), kind="archive") if with_archive else None
    options = Options(sync_mode=mode == "sync")
    heads = {"source": Header(host="s"), "target": Header(host="t")}
    make = lambda rows, side: Inventory(frame_of(spark, rows), heads[side], spark.createDataFrame([("b/c/q",)], "path string") if side == "target" else None)
    kept = Maintained.start(spark, str(tmp_path / "m"), make(source, "source"), make(target, "target"), mode, archive, options=options, buckets=8)
    want = lambda: shown(compare(make(source, "source"), make(target, "target"), mode, archive, options=options))
    for round_no in (1, 2):
        new = (changed(r, source, names), changed(r, target, names) if round_no != 2 else target)
        feed = [changes_between(frame_of(spark, a), frame_of(spark, b), side) for side, a, b in zip(("source", "target"), (source, target), new, strict=True)]
        source, target = new
        before = kept.manifest(round_no - 1)
        touched = kept.apply(feed[0].unionByName(feed[1]), round_no)
        after = kept.manifest(round_no)
        for table in ("source", "target", "decided"):
            assert {b for b in set(before[table]) | set(after[table]) if before[table].get(b) != after[table].get(b)} <= {str(b) for b in touched}
        assert shown(kept.comparison()) == want()
        old, now = ({(x.kind, x.key): x.verdict for x in kept.table("decided", m, kept.comparison().sides and _schema(m)).collect()} for m in (before, after))
        assert {(x.kind, x.key): (x.before, x.after) for x in kept.changed_decisions(round_no).collect()} == {
            k: (old.get(k), now.get(k)) for k in set(old) | set(now) if old.get(k) != now.get(k)
        }
    assert kept.newest() == 2
    assert Maintained(spark, str(tmp_path / "none"), mode, *heads.values()).newest() is None


def _schema(manifest):
    from pyspark.sql import types as T

    return T.StructType.fromJson(manifest["schema"])


def test_a_round_of_few_changes_is_small(spark, tmp_path):
    """One change among 3,000 entries in 64 buckets rewrites one bucket; run again, the round replaces itself."""
    rows = {f"f{i}": file(f"f{i}", str(i % 50)) for i in range(3_000)}
    side = lambda: Inventory(frame_of(spark, rows), Header())
    kept = Maintained.start(spark, str(tmp_path / "m"), side(), side(), "mirror", buckets=64)
    assert kept.comparison().ops.isEmpty()
    change = spark.createDataFrame([("source", False, *file("f7", "new"))], CHANGE)
    assert len(kept.apply(change, 1)) == len(kept.apply(change, 1)) == 1
    assert [(a, p) for a, _, p, *_ in shown(kept.comparison())] == [("update", "f7")]
    written = spark.read.parquet(f"{tmp_path}/m/source/round=1").count()
    assert 1 <= written < 200
    gone = spark.createDataFrame([("target", True, "file", p, *[None] * 7) for p in ("f7", "f8")], CHANGE)
    kept.apply(gone, 2)
    assert sorted((a, p) for a, _, p, *_ in shown(kept.comparison())) == [("copy", "f7"), ("copy", "f8")]
    assert [(a, p) for a, _, p, *_ in shown(kept.comparison(1))] == [("update", "f7")]


def test_stream_of_changes(spark, tmp_path):
    rows = {f"f{i}": file(f"f{i}", str(i)) for i in range(40)}
    kept = Maintained.start(spark, str(tmp_path / "m"), Inventory(frame_of(spark, rows), Header()), Inventory(frame_of(spark, rows), Header()), "mirror", buckets=4)
    feed = [[(1, "source", False, *file("f1", "x")), (2, "source", False, *file("f1", "y"))], [(3, "target", True, *file("f2"))]]
    kind = "ts_ms bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CHANGE)
    folder_ = str(tmp_path / "feed")
    for part in feed:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(folder_)
    changes = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder_)
    query = st.compare_rounds(changes, kept, str(tmp_path / "stats"), str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert kept.newest() == 2
    assert sorted((a, p) for a, _, p, *_ in shown(kept.comparison())) == [("copy", "f2"), ("update", "f1")]
    assert spark.read.parquet(str(tmp_path / "stats")).select("round").distinct().count() == 2
    both = last_changes(spark.createDataFrame(feed[0], kind), "ts_ms").collect()
    assert [x.identity.digest for x in both] == ["y"]
