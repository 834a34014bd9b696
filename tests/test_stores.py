"""Stored pages, publication numbers of concurrent writers, and the bucketed sink."""

import glob
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from treeledger.operators import evidence, pages
from treeledger.operators.compare import Options, Sides
from treeledger.sources import runs, tables
from tests.helpers import file, inventory


def test_a_deep_page_reads_its_blocks_only(spark, tmp_path):
    n, path = 30_000, str(tmp_path / "p")
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.col("id").alias("v"))
    pages.write_pages(rows, ["k"], path, block_rows=100)
    assert pages.total(spark, path).first()["total"] == n
    for offset, limit in ((0, 10), (12_345, 50), (29_990, 50), (40_000, 5)):
        got = pages.page(spark, path, offset, limit)
        assert sorted(x.k for x in got.collect()) == list(range(offset, min(offset + limit, n)))
        opened = got.inputFiles()
        assert len(opened) <= 2 and spark.read.parquet(*opened).count() <= 200 if opened else offset >= n
    zones = pages.zones(spark, path)
    assert zones.agg(F.max("rows")).first()[0] == 100 and zones.count() >= n / 100
    assert [pages.place_of(spark, path, k=k) for k in (0, 17_001, n)] == [0, 17_001, n]
    empty = str(tmp_path / "e")
    pages.write_pages(rows.limit(0), ["k"], empty)
    assert pages.total(spark, empty).first()["total"] == 0 and pages.page(spark, empty, 0, 5).collect() == []


def test_pages_equal_the_sorted_ones(spark, tmp_path):
    both = [[file(f"d/{i:03}", str(i % 3 if i % 5 else side), mtime=i * 1000 * side) for i in range(80)] for side in (1, 2)]
    sides = Sides(*(inventory(spark, *x) for x in both), Options())
    for search in ("", " D/01 "):
        path = str(tmp_path / f"p{len(search)}")
        evidence.identical_pages(sides, path, search, block_rows=7)
        count, page = evidence.identical_page(sides, search, 5, 20)
        got = pages.page(spark, path, 5, 20).orderBy(pages.PLACE).drop("key", pages.PLACE)
        assert sorted(map(str, got.collect())) == sorted(map(str, page.collect()))
        assert pages.total(spark, path).first() == count.first()


def test_sixteen_writers_get_sixteen_numbers(spark, tmp_path):
    path = str(tmp_path / "results")
    result = spark.createDataFrame([(0, 1)], "target_index int, revision int")
    with ThreadPoolExecutor(16) as pool:
        got = list(pool.map(lambda i: tables.publish(result, path, "job/1"), range(16)))
    assert sorted(got) == list(range(1, 17))
    stored = spark.read.parquet(path)
    assert sorted(x.sequence for x in stored.collect()) == list(range(1, 17)) and {x.job_id for x in stored.collect()} == {"job/1"}
    assert tables.publish(result, path, "other") == 1 and tables.newest_claim(spark, path, "job/1") == 16
    assert not tables.claim(spark, f"{tables._claims(path, 'other')}/{1:020d}")
    uri = (tmp_path / "results").as_uri()
    assert tables.publish(result, uri, "other") == 2 and tables.next_sequence(spark, path, "other") == 3


@pytest.mark.parametrize("runs_", [3, 400])
def test_files_of_a_batch_do_not_grow_with_its_runs(spark, tmp_path, monkeypatch, runs_):
    root = str(tmp_path / "logs")
    kinds = [("log", "info", None), ("log", "warn", None), ("progress", None, None), ("item_result", None, "ok"), ("error", None, None)]
    monkeypatch.setattr(runs, "BUCKET_LINES", 50)
    rows = [(f"r{i % runs_}", i, *kinds[i % 5]) for i in range(2_000)]
    events = spark.createDataFrame(rows, "run_id string, seq bigint, kind string, level string, outcome string")
    for batch in (0, 1, 1):
        runs.write_routed_buckets(events.where(F.col("seq") % 2 == batch), root, batch, buckets=4)
    assert len(glob.glob(f"{root}/lines/*/*/*.parquet")) <= 2 * 4 * runs.BUCKET_SALTS and len(glob.glob(f"{root}/index/*/*.parquet")) <= 2 * runs.INDEX_FILES
    want = {}
    for run, seq, kind, level, _ in rows:
        names = [] if kind == "progress" else ["items"] if kind == "item_result" else ["run", "errors"] if kind == "error" or level == "warn" else ["run"]
        for name in names:
            want.setdefault((run, name), []).append(seq)
    for key in [("r0", "run"), ("r1", "errors"), ("r2", "items")]:
        got = runs.read_routed(spark, root, *key, buckets=4)
        assert [x.seq for x in got.collect()] == want.get(key, [])
    assert runs.read_routed(spark, root, "none", "run", buckets=4).collect() == []
    assert spark.read.parquet(f"{root}/index").agg(F.sum("lines")).first()[0] == sum(map(len, want.values()))
