"""Move pairing against the ordered brute force, for small and for distributed buckets."""

import random

import pytest

from tests.helpers import file, greedy_pairs, inventory, shown
from treeledger.operators import moves
from treeledger.plans.compare import compare

SCHEMA = "flow string, key string, file struct<path:string,size:bigint,identity:struct<kind:string,digest:string>>"


def _frame(spark, paths, digest):
    return spark.createDataFrame(
        [("target", p, (p, 10, ("full", d))) for p, d in zip(paths, digest)], SCHEMA
    ).coalesce(2)


def _random_paths(rng, n, folders, names):
    paths = set()
    while len(paths) < n:
        paths.add(f"{rng.choice(folders)}/{rng.choice(names)}{rng.choice(['', rng.randrange(99)])}")
    return sorted(paths)


def _expected(adds, dels):
    split = lambda p: (p, p.rsplit("/", 1)[0], p.rsplit("/", 1)[1])
    return sorted(greedy_pairs([split(p) for p in adds], [split(p) for p in dels]))


@pytest.mark.parametrize("limit", [4096, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_pairing_equals_ordered_greedy(spark, limit, seed):
    rng = random.Random(seed)
    folders, names = ["a", "b", "c", "d/e"], ["x", "y", "z", "w"]
    adds = _random_paths(rng, rng.randrange(6, 16), folders, names)
    dels = _random_paths(rng, rng.randrange(6, 16), folders[1:] + ["q"], names)
    made = moves.pair_moves(_frame(spark, adds, ["m"] * 99), _frame(spark, dels, ["m"] * 99), limit)
    got = sorted((r["add_key"], r["del_key"], r["candidates"]) for r in made.collect())
    assert got == _expected(adds, dels)


def test_several_shapes_together(spark):
    adds = ["a/1", "a/2", "n/x", "p/one", "k/r", "k/s"]
    da = ["two", "two", "single", "manyd", "both", "both"]
    dels = ["b/1", "n/old", "q/z", "p/two", "c/one", "k/s", "z/r"]
    dd = ["two", "single", "manyd", "manyd", "manyd", "both", "both"]
    made = moves.pair_moves(_frame(spark, adds, da), _frame(spark, dels, dd))
    got = sorted((r["add_key"], r["del_key"], r["candidates"]) for r in made.collect())
    want = []
    for d in set(da):
        want += _expected([a for a, x in zip(adds, da) if x == d], [a for a, x in zip(dels, dd) if x == d])
    assert got == sorted(want)


def test_rename_in_place_and_ambiguity(spark):
    source = inventory(spark, file("a/new.txt", "m"), file("keep", "k"))
    target = inventory(spark, file("a/old.txt", "m"), file("b/copy.txt", "m"), file("keep", "k"))
    assert shown(compare(source, target, "mirror")) == [
        ("move", "target", "a/new.txt", "a/old.txt", "rename-detected-by-hash (ambiguous: 2 identical candidates)"),
        ("delete", "target", "b/copy.txt", None, "gone-from-source"),
    ]


def test_empty_files_sampled_files_and_conflict_copies_never_pair(spark):
    kept = "old.sync-conflict-20240101-000000-h.txt"
    source = inventory(spark, file("n0", "e", size=0), file("n1", "s", kind="sampled"), file("n2", "c"))
    target = inventory(spark, file("o0", "e", size=0), file("o1", "s", kind="sampled"), file(kept, "c"))
    actions = [r[0] for r in shown(compare(source, target, "mirror"))]
    assert actions == ["copy"] * 3 + ["delete"] * 3
