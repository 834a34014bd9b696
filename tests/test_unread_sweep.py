"""Unread areas found by one sweep equal those found by a join per depth."""

import random

import pytest

from treeledger.operators import inventory as inv
from treeledger.plans.compare import compare
from tests.helpers import file, inventory, shown


def paths(r, n, most=6):
    names = ["a", "b", "a b", "a.", "a-", "ab", "A\x01", "é", "z"]
    return ["/".join(r.choice(names) for _ in range(r.randint(1, most))) for _ in range(n)]


def covers(prefixes, key):
    return any(key == p or key.startswith(p + "/") for p in prefixes)


@pytest.mark.parametrize("seed,count", [(1, 0), (1, 1), (2, 8), (3, 200), (4, 2_000)])
def test_sweep_equals_the_rule(spark, seed, count):
    r = random.Random(seed)
    keys = sorted(set(paths(r, 3_000))) + ["a"] * 3
    prefixes = sorted(set(paths(r, count, 5)))
    rows = spark.createDataFrame([(k, i, (k, i)) for i, k in enumerate(keys)], "key string, n int, more struct<k:string,i:int>")
    table = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        inside = inv.swept(rows, table, True).collect()
        outside = inv.swept(rows, table, False).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert sorted(x.key for x in inside) == sorted(k for k in keys if covers(prefixes, k))
    assert sorted(x.n for x in inside + outside) == list(range(len(keys)))
    assert all(tuple(x.more) == (x.key, x.n) for x in inside + outside)
    assert {x.prefix for x in inv.outermost(table).collect()} == {p for p in prefixes if not covers([q for q in prefixes if q != p], p)}


def test_plans_are_alike_on_both_ways(spark, monkeypatch):
    r = random.Random(9)
    both = [[file(p, str(r.randint(0, 9)), mtime=r.randint(0, 9) * 10_000) for p in sorted(set(paths(r, 150, 4)))] for _ in range(2)]
    unread = sorted(set(paths(r, 12, 3)))
    sides = [inventory(spark, *rows, unread=unread[i::2]) for i, rows in enumerate(both)]
    joins = shown(compare(*sides, "mirror"))
    monkeypatch.setattr(inv, "BROADCAST_MAX_ROWS", 0)
    assert shown(compare(*sides, "mirror")) == joins
