"""Chunks found range by range equal those of whole files."""

import random
import tracemalloc

import numpy as np
import pytest

from treeledger.operators import chunk_ranges as cr
from treeledger.operators import delta


def contents():
    r = random.Random(6)
    even = bytes(50_000)  # no candidate at all: every bound is forced
    return {
        "empty": b"", "one": b"x", "short": np.random.default_rng(4).bytes(40), "even": even, "random": np.random.default_rng(1).bytes(60_000),
        "mixed": np.random.default_rng(2).bytes(9_000) + even[:7_000] + np.random.default_rng(3).bytes(20_011),
        "words": " ".join(r.choice("alpha beta gamma delta".split()) for _ in range(9_000)).encode(),
    }


def want(sizes):
    out = []
    for name, data in contents().items():
        start = 0
        for position, end in enumerate(delta.boundaries(data, *sizes)):
            out.append((name, position, start, end - start, delta.hashlib.sha256(data[start:end]).hexdigest()))
            start = end
    return sorted(out)


@pytest.mark.parametrize("span", [37, 500, 2_048, 10_000, 1 << 20])
def test_bounds_by_composition_equal_the_greedy_ones(span):
    for sizes in ((64, 256, 1024), (16, 64, 65), (100, 1000, 2500), (1, 2, 4)):
        minimum, average, maximum = sizes
        for data in contents().values():
            start, found = 0, []
            for begin in range(0, len(data), span):
                end = min(begin + span, len(data))
                lead = min(cr.LEAD, begin)
                own = delta.candidates(data[begin - lead : end], minimum, average, lead) + begin
                pieces = cr.range_map(own, begin, end, minimum, maximum)
                assert [p[0] for p in pieces][1:] == [p[1] + 1 for p in pieces][:-1]
                ends = cr.cuts(own, start, begin, end, minimum, maximum)
                found += ends
                assert cr.apply(pieces, start) == (ends[-1] if ends else start)
                start = cr.apply(pieces, start)
            if data and (not found or found[-1] < len(data)):
                found.append(len(data))
            assert found == delta.boundaries(data, *sizes)
        if span < 100:
            break  # very many ranges; one setting will do


def test_composition_is_application_twice():
    data = contents()["mixed"]
    maps = []
    for begin in range(0, 8_000, 1_000):
        lead = min(cr.LEAD, begin)
        own = delta.candidates(data[begin - lead : begin + 1_000], 16, 64, lead) + begin
        maps.append(cr.range_map(own, begin, begin + 1_000, 16, 900))
    whole = maps[3]
    for m in maps[4:]:
        whole = cr.compose(whole, m)
    for start in range(3_000 - 899, 3_001):
        at = start
        for m in maps[3:]:
            at = cr.apply(m, at)
        assert cr.apply(whole, start) == at
    assert len(whole) <= len(maps[3])


@pytest.mark.parametrize("span,fan", [(1_500, 3), (1 << 20, 64)])
def test_tables_of_files_and_values(spark, tmp_path, monkeypatch, span, fan):
    monkeypatch.setattr(cr, "FAN", fan)
    sizes = (64, 256, 1024)
    for name, data in contents().items():
        (tmp_path / name).write_bytes(data)
    rows = [(name, len(data), (tmp_path / name).as_uri(), bytearray(data)) for name, data in contents().items()]
    files = spark.createDataFrame(rows, "name string, size bigint, location string, content binary")
    kinds = dict(zip(("minimum", "average", "maximum"), sizes, strict=True))
    stored = cr.chunk_table_by_ranges(files.drop("content"), ["name"], span=span, **kinds)
    assert sorted(map(tuple, stored.collect())) == want(sizes)
    if fan == 3:
        held = cr.chunk_table_by_ranges(files, ["name"], location=None, content="content", span=span, **kinds)
        assert sorted(map(tuple, held.collect())) == want(sizes)
        whole = delta.chunk_table(files, ["name"], "content", *sizes)
        assert sorted(map(tuple, whole.collect())) == want(sizes)


def test_no_files(spark):
    files = spark.createDataFrame([], "name string, size bigint, location string")
    assert cr.chunk_table_by_ranges(files, ["name"]).collect() == []


def test_contents_meet_their_starts_before_they_are_cut_into_ranges(spark, monkeypatch):
    """Joined afterwards, each range would take its whole content through the shuffle."""
    plans, cut = [], cr.cut_lineage
    monkeypatch.setattr(cr, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    files = spark.createDataFrame([(name, bytearray(data)) for name, data in contents().items()], "name string, content binary")
    cr.chunk_table_by_ranges(files, ["name"], location=None, content="content", minimum=64, average=256, maximum=1024, span=1500).count()
    joined = [p for p in plans if "Join" in p and "Generate" in p]
    assert joined and all(p.index("Generate") < p.index("Join") for p in joined)


def test_hashes_take_little_memory_beside_the_content(spark):
    data = np.random.default_rng(7).bytes(8 << 20)
    tracemalloc.start()
    delta.candidates(data, 16, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
    files = spark.createDataFrame([("a", bytearray(b"x" * 100)), ("b", None)], "name string, content binary")
    assert [(r.name, r.len) for r in delta.chunk_table(files, ["name"], "content").collect()] == [("a", 100)]
