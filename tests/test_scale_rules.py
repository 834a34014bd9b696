"""Rules that keep results the same at every size: streamed files, stored keys, hot keys, checkpoints, periodic scans."""

import hashlib
import inspect
import os

import pytest
from pyspark.sql import functions as F

from treeledger import cluster
from treeledger.functions import text
from treeledger.operators import passes, watch
from treeledger.operators.inventory import Inventory
from treeledger.sources import tables


def test_files_are_hashed_in_pieces_like_whole_values(spark, tmp_path):
    data = {"a b%20ü.bin": os.urandom(10_007), "small": b"1", "large": os.urandom(text.SAMPLE_MIN + 11)}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    listed = tables.list_tree(spark, str(tmp_path))
    for sampled in (False, True):
        got = {r["path"]: r["_id"] for r in tables.hashed_files(listed, sampled, piece=1000).collect()}
        assert set(got) == set(data)
        for name, content in data.items():
            value = F.lit(bytearray(content))
            want = spark.range(1).select(text.sampled_identity(value) if sampled else F.struct(F.lit("full").alias("kind"), text.full_digest(value).alias("digest"))).first()[0]
            assert tuple(got[name]) == tuple(want), (name, sampled)
    assert got["small"]["digest"] == hashlib.sha256(b"1").hexdigest()
    assert tables.stream_digest((tmp_path / "gone").as_uri()) is None


def test_stored_keys_of_the_other_case_mode_are_refused(spark, tmp_path):
    entries = spark.createDataFrame([("file", "A/b", 1)], "kind string, path string, size bigint")
    tables.save_keyed(entries, str(tmp_path / "keyed"), case_insensitive=True)
    stored = spark.read.parquet(str(tmp_path / "keyed"))
    assert [r["key"] for r in Inventory(stored, keyed_for=True).keyed(True).collect()] == ["A/B"]
    with pytest.raises(ValueError, match="case-sensitive"):
        Inventory(stored, keyed_for=True).keyed(False)
    assert [r["key"] for r in Inventory(stored).keyed(False).collect()] == ["A/b"]


def test_spread_lookup_equals_a_join_with_a_hot_and_a_null_key(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else None if i % 2 else str(i), i) for i in range(500)], "k string, v int")
    found = spark.createDataFrame([("hot", 1), (None, 2), ("0", 3)], "k string, w int")
    got = sorted(map(str, map(tuple, cluster.spread_lookup(rows, found, ["k"]).select("k", "v", "w").collect())))
    known = {"hot": 1, None: 2, "0": 3}
    assert got == sorted(str((r.k, r.v, known.get(r.k))) for r in rows.collect())
    assert cluster.spread_lookup(rows, found, ["k"], "inner").count() == sum(r.k in known for r in rows.collect())


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        cluster.checkpoint_dir(Session())


def test_no_limit_on_paths_by_default():
    for function in (watch.debounced_batches, watch.coverage):
        assert inspect.signature(function).parameters["max_paths"].default is None


def test_periodic_requests_replace_nothing_stronger(spark):
    rows = [("w", 1, 100, "full: bootstrap"), ("w", 2, 150, "incremental"), ("w", 3, 1100, "incremental"), ("w", 4, 1200, "incremental"), ("w", 5, 2100, "full: dropped"), ("w", 6, 2200, "incremental")]
    batches = spark.createDataFrame(rows, "watch string, batch bigint, due_ms bigint, coverage string")
    got = {r["batch"]: r["coverage"] for r in watch.periodic_coverage(batches, ["watch"], 1000).collect()}
    assert got == {1: "full: bootstrap", 2: "incremental", 3: "full: periodic", 4: "incremental", 5: "full: dropped", 6: "incremental"}


def test_all_members_of_a_name_collision_are_listed(spark):
    names = ["".join(c.upper() if i >> k & 1 else c for k, c in enumerate("abcdefgh")) for i in range(256)]
    rows = [("copy", "target", n, None) for n in names] + [("move", "target", "alone", "x"), ("delete", "target", "ALONE", None), ("copy", "source", "abcdefgh", None)]
    got = passes.collision_members(spark.createDataFrame(rows, "action string, side string, path string, from string")).collect()
    assert sorted(r["path"] for r in got) == sorted(names) and {r["side"] for r in got} == {"target"}
