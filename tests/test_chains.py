"""Greedy chains by composed slots equal the walk from old to new."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeledger.operators import chains


def walk(times, gap_of):
    kept = []
    for t in sorted(set(times)):
        if not kept or t - kept[-1] >= gap_of(t):
            kept.append(t)
    return kept


GAPS = {"even": lambda t: 100, "older less": lambda t: 500 if t < 3_000 else 70 if t < 9_000 else 9, "odd": lambda t: 1 + t * 7919 % 400, "wide": lambda t: 5_000}


@pytest.mark.parametrize("name", list(GAPS))
def test_slots_and_their_compositions(name):
    r = random.Random(3)
    for width in (50, 1_000):
        times = sorted({r.randint(0, 15_000) for _ in range(1_200)} | set(range(4_000, 4_400)))
        want = walk(times, GAPS[name])
        slots = {}
        for t in times:
            slots.setdefault(t // width, []).append(t)
        last, got, made = chains.NEVER, [], []
        for s, own in sorted(slots.items()):
            slot = chains.Slot(own, [GAPS[name](t) for t in own])
            kept = slot.kept(last)
            steps = slot.steps(s * width)
            assert int(chains.after(*steps, last)) == (kept[-1] if len(kept) else last)
            got += kept.tolist()
            last = int(chains.after(*steps, last))
            made.append((s * width, steps))
        assert got == want
        begin, whole = made[5]
        for _, steps in made[6:30]:
            whole = chains.compose(whole, steps, begin)
        for start in [chains.NEVER, *range(begin - 700, begin)]:
            at = start
            for _, steps in made[5:30]:
                at = int(chains.after(*steps, at))
            assert int(chains.after(*whole, start)) == at
        assert len(whole[0]) <= max(map(GAPS[name], times)) + 1 and (np.diff(whole[0]) > 0).all()


def test_tables_of_many_groups(spark):
    """One group has nine tenths of the rows; a null is a group as well; slots are far apart or next to each other."""
    r = random.Random(5)
    rows = [("hot", r.randint(0, 40_000)) for _ in range(9_000)] + [(g, r.choice([0, 10**9]) + r.randint(0, 30_000)) for g in ("a", None) for _ in range(400)]
    df = spark.createDataFrame([*rows, ("one", 7)], "g string, t bigint")
    gap = lambda t: 300 if t < 20_000 else 45
    got = {}
    for x in chains.greedy_kept(df, ["g"], "t", F.expr("CASE WHEN t < 20000 THEN 300 ELSE 45 END"), width=500, fan=4).collect():
        got.setdefault(x.g, []).append(x.t)
    groups = {g for g, _ in rows} | {"one"}
    assert set(got) == groups
    for g in groups:
        assert sorted(got[g]) == walk([t for k, t in [*rows, ("one", 7)] if k == g], gap)
    assert chains.greedy_kept(df.limit(0), ["g"], "t", F.lit(5), width=10).collect() == []
