"""Exact dedup, source mixing, SimHash near-dedup and components."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from treeledger.llm import dedup, mixing, simhash
from treeledger.llm.components import components, forest

from .helpers import frame, lowered, odd_rows


def groups_of(rows):
    groups = defaultdict(list)
    for k, t, *_ in rows:
        groups[lowered(t)].append(k)
    return groups


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, weak):
    """With a weak fingerprint, different chunks share identifiers, and the texts must tell recipes apart."""
    rows = odd_rows()
    own = (lambda c: F.pmod(F.xxhash64(c), F.lit(3))) if weak else F.xxhash64
    got = dedup.exact_groups(frame(spark, rows), fingerprint=own).collect()
    groups = groups_of(rows)
    want = []
    for k, t, *_ in rows:
        keys = groups[lowered(t)]
        want.append((k, max((x for x in keys if x is not None), default=None), len(keys), hashlib.sha256(lowered(t).encode()).hexdigest()))
    assert sorted(map(str, ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got))) == sorted(map(str, want))
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert dedup.exact_groups(frame(spark, [])).collect() == []


def test_without_copies_keeps_columns_and_one_row_of_each_text(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    left = dedup.without_copies(docs)
    assert left.columns == docs.columns
    assert sorted(lowered(r.text) for r in left.collect()) == sorted(groups_of(rows))


def filled(weights, sizes, share=1.5, most=2.0):
    """Targets by sharing again and again, as the rule is worded."""
    total, targets, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while True:
        rest = total - sum(most * sizes[i] for i in range(len(sizes)) if i not in open_)
        weight = sum(weights[i] for i in open_)
        above = {i for i in open_ if weight and rest * weights[i] / weight > most * sizes[i]}
        if not above:
            return [rest * weights[i] / weight if i in open_ else most * sizes[i] for i in range(len(sizes))]
        open_ -= above


def test_mix(spark):
    r = random.Random(6)
    rows = [*odd_rows(), *[(1000 + i, "w " * r.randint(1, 60), "en", r.choice("abcdef"), 1, "", "", "") for i in range(600)]]
    docs = frame(spark, rows)
    allocated = mixing.allocate(docs)
    mixed = mixing.mix(allocated, block_words=50, shard_blocks=16)
    got = mixing.taken(allocated, mixed).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for row in got:
        size[row.source] += row.size
        assert row.taken in (0, row.size, 2 * row.size)
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    want = dict(zip(names, filled([(5, 2, 1)[i % 3] for i in range(len(names))], [size[s] for s in names]), strict=True))
    for s in names:
        own = [x for x in got if x.source == s]
        assert own[0].source_size == size[s] and own[0].target == pytest.approx(want[s])
        assert abs(sum(x.taken for x in own) - want[s]) <= 5
    # Every block is in one shard, shards have like numbers of blocks, and another run gives the same.
    blocks = mixed.select("rank", "block", "shard").distinct().collect()
    assert len({(b["rank"], b.block) for b in blocks}) == len(blocks)
    again = mixing.mix(mixing.allocate(docs.repartition(5)), block_words=50, shard_blocks=16)
    order = lambda df: sorted(map(str, df.select("key", "size", "copy", "shard", "order").collect()))
    assert order(mixed) == order(again)
    assert mixing.mix(mixing.allocate(frame(spark, []))).collect() == []
    rows_of_mix = mixing.shuffled(docs.where("doc_id >= 1000"), mixed.where("key >= 1000"))
    assert rows_of_mix.columns == docs.columns and rows_of_mix.count() == mixed.where("key >= 1000").count()


def test_splitting_tree_keeps_quotas_and_follows_the_hypergeometric(spark):
    quotas = spark.createDataFrame([(0, 300), (1, 100), (2, 1), (3, 20)], "rank int, quota long")
    got = mixing.shard_quotas(quotas, 32).collect()
    by_rank, by_shard = defaultdict(int), defaultdict(int)
    for row in got:
        by_rank[row["rank"]] += row.quota
        by_shard[row.shard] += row.quota
    assert by_rank == {0: 300, 1: 100, 2: 1, 3: 20} and max(by_shard.values()) - min(by_shard.values()) <= 1
    draws = spark.range(20_000).select(
        mixing.hypergeometric(F.lit(50), F.lit(20), F.lit(10), (F.col("id") + 0.5) / 20_000).alias("k")
    ).groupBy("k").count().collect()
    from math import comb

    for row in draws:
        assert row["count"] / 20_000 == pytest.approx(comb(20, row.k) * comb(30, 10 - row.k) / comb(50, 10), abs=2e-4)
    assert spark.range(1).select(mixing.log_factorial(F.lit(20)).alias("x")).first().x == pytest.approx(42.3356164607535, abs=1e-9)


def slow_fingerprint(text):
    words = lowered(text).replace("\n", " ").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, radius=2):
    root = {p: p for p in points}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in points:
        for b in points:
            if a < b and (a ^ b).bit_count() <= radius:
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {p: top(p) for p in points}


def test_simhash_of_rows(spark):
    rows = odd_rows()
    got = simhash.components_of(frame(spark, rows)).collect()
    fps = [slow_fingerprint(t) for _, t, *_ in rows]
    root = brute_components(set(fps))
    least = defaultdict(list)
    for (k, *_), f in zip(rows, fps, strict=True):
        least[root[f]].append(k)
    want = [(k, f"{f:016x}", min((x for x in least[root[f]] if x is not None), default=None)) for (k, *_), f in zip(rows, fps, strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert simhash.components_of(frame(spark, [])).collect() == []
    left = simhash.one_of_each(frame(spark, rows).where("doc_id is not null"))
    assert left.count() == len(root) - (1 if root[slow_fingerprint("no key")] == slow_fingerprint("no key") else 0)


def test_rows_stay_and_mix_by_row_when_keys_are_null_or_repeated(spark):
    """Per group one row, per row of the mix one row, whatever the keys name."""
    r = random.Random(21)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(12))
    x, y, twice, alike = text(), text(), text(), text()
    rows = [(None, text()) for _ in range(30)] + [(5, x), (7, x), (3, y), (5, y), (5, y), (None, x)]
    rows += [(i % 4 + 20, text()) for i in range(20)] + [(None, twice)] * 9 + [(40, alike)] * 7
    docs = frame(spark, [(k, t, "en", r.choice("ab"), 1, "", "", "") if t not in (twice, alike) else (k, t, "en", "a", 1, "", "", "") for k, t in rows])
    fps = {t: slow_fingerprint(t) for _, t in rows}
    root = brute_components(set(fps.values()))
    groups = defaultdict(list)
    for k, t in rows:
        groups[root[fps[t]]].append(k)
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    got = sorted((root[fps[d.text]], str(d.doc_id)) for d in left.collect())
    assert got == sorted((g, str(min((k for k in ks if k is not None), default=None))) for g, ks in groups.items())
    mixed = mixing.mix(mixing.allocate(docs), block_words=50, shard_blocks=16)
    assert max(d["copies"] for d in mixed.select("copies").collect()) == 2
    wanted = defaultdict(int)
    for d in mixed.select("key", "size", "source").collect():
        wanted[d.key, d.size, d.source] += 1
    found, texts = defaultdict(int), defaultdict(int)
    for d in mixing.shuffled(docs, mixed).collect():
        found[d.doc_id, len(d.text.split()), d.source] += 1
        texts[d.text] += 1
    assert found == wanted
    assert all(n <= 2 * sum(t == u for _, u in rows) for t, n in texts.items()) and len(texts) > 40


def clustered(seed, n):
    r, out = random.Random(seed), set()
    while len(out) < n:
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 2, 30])):
            out.add(x)
            x ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
    return sorted(out)


def test_vantage_point_trees_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_ROWS", 16)
    points = clustered(7, 1500)
    own = np.array(points, np.uint64)
    want = brute_components(points)
    pairs = simhash.links(own, 2)
    at = {p: i for i, p in enumerate(points)}
    root = forest(len(points), np.array([at[int(a)] for a, _ in pairs], int), np.array([at[int(b)] for _, b in pairs], int))
    assert {p: points[root[i]] for i, p in enumerate(points)} == want
    fps = spark.createDataFrame([(int(x),) for x in own.view(np.int64)], "fp long").repartition(3)
    found = {r.fp & (2**64 - 1): r.root & (2**64 - 1) for r in simhash.linked(fps, 2, shard_rows=200).collect()}
    ours, theirs = defaultdict(set), defaultdict(set)
    for p in points:
        ours[found.get(p, p)].add(p)
        theirs[want[p]].add(p)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
