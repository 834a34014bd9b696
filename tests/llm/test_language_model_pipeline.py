"""The Pitman-Yor language model and the pipeline."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from treeledger.llm import language_model as lm
from treeledger.llm import queries, simhash
from treeledger.llm.bpe import coder

from .helpers import frame, odd_rows

SF = "/root/testdata/sf0.001"


def test_stirling_numbers_count_seatings():
    """Against the probability of t tables for c customers of a Pitman-Yor process, by running the process."""
    strength, discount, c = 1.0, 0.4, 6
    stirling = np.exp(lm.log_stirling(discount)[c, 1 : c + 1])
    chance = {1: 1.0}
    for seated in range(1, c):
        after: dict[int, float] = {}
        for t, p in chance.items():
            new = (strength + discount * t) / (strength + seated)
            after[t + 1] = after.get(t + 1, 0) + p * new
            after[t] = after.get(t, 0) + p * (1 - new)
        chance = after
    total = math.prod(strength + i for i in range(1, c))
    rising = [math.prod(strength + discount * j for j in range(1, t)) for t in range(1, c + 1)]
    assert [stirling[t - 1] * rising[t - 1] / total for t in range(1, c + 1)] == pytest.approx([chance[t] for t in range(1, c + 1)])


def test_parts_of_a_round_share_the_stirling_numbers():
    assert lm.log_stirling(0.35) is lm.log_stirling(0.35)


def test_seating_follows_its_conditional():
    n, c, prior, others = 40_000, 5, 0.3, 7.0
    rng = np.random.default_rng(1)
    stirling = lm.log_stirling(0.5)
    got = lm.seat(np.full(n, c), np.full(n, prior), np.full(n, others), 1.0, 0.5, stirling, rng)
    weight = [math.exp(stirling[c, t]) * math.prod((1 + 0.5 * (others + j)) * prior for j in range(t)) for t in range(1, c + 1)]
    want = [w / sum(weight) for w in weight]
    assert [np.mean(got == t) for t in range(1, c + 1)] == pytest.approx(want, abs=0.01)
    many = lm.seat(np.array([1, 0, 5000]), np.full(3, 0.01), np.full(3, 50.0), 1.0, 0.5, stirling, rng)
    assert many[0] == 1 and many[1] == 0 and 1 <= many[2] <= 5000


def conditional(count, prior, others, strength, discount):
    """The exact weights of 1 to count tables, from the recursion over customers alone."""
    row = np.full(count + 1, -np.inf)
    row[0] = 0.0
    t = np.arange(1, count + 1)
    with np.errstate(divide="ignore"):
        for c in range(count):
            row[1:] = np.logaddexp(row[:-1], np.log(np.maximum(c - discount * t, 0)) + row[1:])
            row[0] = -np.inf
    log = row[1:] + np.cumsum(np.log((strength + discount * (others + t - 1)) * prior))
    weight = np.exp(log - log.max())
    return weight / weight.sum()


@pytest.mark.parametrize(
    "count,prior,others,discount",
    [(49, 1 / 369_036, 450_000, 0.7), (1000, 1 / 369_036, 450_000, 0.7), (200, 0.01, 500, 0.7), (200, 0.3, 2000, 0.2), (1000, 0.02, 30_000, 0.9), (300, 0.2, 30_000, 0.9), (5000, 0.01, 500, 0.5), (6000, 0.05, 4000, 0.7)],
)
def test_many_customers_follow_the_same_conditional(count, prior, others, discount):
    """Tabled, past the table's width, and past its counts: shares, mean and variance are the exact ones."""
    n = 4000
    got = lm.seat(np.full(n, count), np.full(n, prior), np.full(n, float(others)), 1.0, discount, lm.log_stirling(discount), np.random.default_rng(2))
    want = conditional(count, prior, others, 1.0, discount)
    t = np.arange(1, count + 1)
    mean = (want * t).sum()
    spread = math.sqrt((want * (t - mean) ** 2).sum())
    assert abs(got.mean() - mean) < 5 * spread / math.sqrt(n) + 1e-9
    assert got.std() == pytest.approx(spread, rel=0.1, abs=0.02)
    likely = t[want > 0.05]
    for k in likely:
        assert abs((got == k).mean() - want[k - 1]) < 5 * math.sqrt(want[k - 1] / n)


def test_integrated_stirling_numbers_equal_the_recursion():
    for discount in (0.1, 0.5, 0.9):
        table = lm.log_stirling(discount, 1000)
        for c in (49, 300, 1000):
            t = np.array([1, 2, 7, 30, 48])
            assert lm.log_stirling_at(np.full(5, c), t, discount) == pytest.approx(table[c, t], abs=5e-6)
            t = np.arange(1, min(c, lm.WIDE) + 1)
            assert lm.Curves(np.array([c]), discount)(np.zeros(len(t), int), t) == pytest.approx(table[c, t], abs=1e-3)
    assert lm.log_stirling_at(np.array([10**9]), np.array([1]), 0.5)[0] == pytest.approx(math.lgamma(10**9 - 0.5) - math.lgamma(0.5), rel=1e-9)


def test_scores_against_brute_force(spark, monkeypatch):
    """Base scores and counts are exact, whatever the parts and chunks."""
    monkeypatch.setattr(lm, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(lm, "PART_TOKENS", 300)
    r = random.Random(12)
    names = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(r.choice(names[: 3 + i % 27]) for _ in range(r.randint(0, 40))), "en", "a", 1, "", "", "") for i in range(120)]
    rows = [*odd_rows(), *[(1000 + row[0], *row[1:]) for row in rows]]
    trained = Counter(w for k, t, *_ in rows if k is None or zlib.crc32(str(k).encode()) % 7 != 2 for w in lm.tokens(t))
    got = lm.score(frame(spark, rows), lm.Plan(share=1e-9)).collect()
    n, v = sum(trained.values()), len(trained)
    want = []
    for k, t, *_ in rows:
        own = lm.tokens(t)
        want.append((str(k), len(own), sum(trained[w] > 0 for w in own), n, round(sum(math.log10((trained[w] + 1) / (n + v + 1)) for w in own), 6)))
    assert sorted((str(x.doc_id), x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == sorted(want)
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 7 == 2) for x in got)
    assert all(x.score < 0 and math.isfinite(x.score) for x in got)


def test_words_are_split_and_counted_a_batch_at_a_time(spark, monkeypatch):
    """The tasks cut no text by itself, and find the same words in every odd case, however few are held at once."""
    rows = [*odd_rows(), (200, "A\x0bb\x0c\x1cc\u0085d\u00a0e \u0130\u212a \x00 a", "en", "a", 1, "", "", "")]
    trained = Counter(w for k, t, *_ in rows for w in lm.tokens(t))
    texts = [t for _, t, *_ in rows]
    words, sizes = lm.split(pa.array(["x", *texts, "y"]).slice(1, len(texts)))
    assert words.to_pylist() == [w for t in texts for w in lm.tokens(t)[:-1]] and sizes.tolist() == [len(lm.tokens(t)) - 1 for t in texts]

    def alone(text):
        raise AssertionError("a text by itself")

    monkeypatch.setattr(lm, "tokens", alone)
    monkeypatch.setattr(lm, "COUNTED", 50)
    monkeypatch.setattr(lm, "HELD", 20)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 2000)
    assert {bytes(x.word): x.n for x in lm.word_counts(frame(spark, rows)).collect()} == trained
    assert sum(x.n_tokens for x in lm.score(frame(spark, rows)).collect()) == sum(trained.values())


def test_probabilities_add_up_to_one():
    """Over the vocabulary and the unknown word, in a context and in the root, with the samples' own totals."""
    r = random.Random(13)
    words = [f"w{i}".encode() for i in range(40)]
    contexts = {w: i + 1 for i, w in enumerate(words[:6])}
    texts = [[r.choice(words[: r.randint(2, 40)]) for _ in range(30)] + [lm.END] for _ in range(60)]
    names = sorted({w for t in texts for w in t})
    at = {w: i for i, w in enumerate(names)}
    chunk = lm.Chunk(names, np.array([at[w] for t in texts for w in t], np.int32), np.array([31] * 60), np.array([False] * 60))
    plan, v = lm.Plan(), len(names)
    before = Counter(t[i - 1] if i else None for t in texts for i in range(31))
    seen = np.array([before[None], *(before[w] for w in contexts)], float)
    asked = [(0, lm.unpack(x)) for _, x in lm.requests(chunk, contexts, 1)]
    part = lm.Part(asked, len(seen))
    assert part.count.sum() == 60 * 31 and part.pairs.sum() + part.alone.sum() == 60 * 31
    shared = lm.Totals(seen[None, :] ** 0.8, np.array([500.0]), np.array([float(v)]), np.zeros(4))
    states = [*part.sample(shared, v, plan, [1])]
    totals = part.totals(states)
    low = high = plan.discount
    for s, (tables, diners, standing) in enumerate(states):
        prior = lm.root_chance(diners, standing, totals.customers[s], totals.tables[s], v, plan.strength, high)
        unknown = (plan.strength + high * totals.tables[s]) / (v + 1) / (plan.strength + totals.customers[s])
        assert prior.sum() + unknown == pytest.approx(1)
        for u in range(len(seen)):
            own = part.context == u
            back = plan.strength + low * totals.contexts[s][u]
            chance = back * prior
            chance[part.word[own]] += part.pairs[own] - low * tables[own]
            assert (chance.sum() + back * unknown) / (plan.strength + seen[u]) == pytest.approx(1)


def test_rare_words_have_contexts_of_their_own():
    """Over three parts that tell each other: in every rare word's context probabilities add up to 1 and follow its pairs."""
    r = random.Random(14)
    words = [f"w{i}".encode() for i in range(24)]
    contexts, parts, plan = {words[0]: 1}, 3, lm.Plan()
    texts = [[w for i in r.choices(range(1, 12), k=8) for w in (words[2 * i], words[2 * i + 1])] + [words[0], lm.END] for _ in range(60)]
    asked = [[u] for u in words] + [[u, w] for u in words for w in [*words, lm.END, b"new"]]
    names = sorted({w for t in [*texts, *asked] for w in t})
    at = {w: i for i, w in enumerate(names)}
    chunk = lm.Chunk(names, np.array([at[w] for t in [*texts, *asked] for w in t], np.int32), np.array([len(t) for t in [*texts, *asked]]), np.array([False] * len(texts) + [True] * len(asked)))
    n, v = sum(map(len, texts)), len({w for t in texts for w in t})
    seen = np.array([60.0, 60.0])
    made = {p: lm.Part([(0, lm.unpack(x))], 2, contexts, parts) for p, x in lm.requests(chunk, contexts, parts)}
    assert sum(x.pairs.sum() + x.hosted.sum() for x in made.values()) == n
    shared = lm.Totals(seen[None, :] ** 0.8, np.array([500.0]), np.array([float(v)]), np.zeros(4))
    states = {p: [*x.sample(shared, v, plan, [1, p])] for p, x in made.items()}
    flats = lambda: lm.Totals.of(sum(x.totals(states[p]).flat() for p, x in made.items()), 2)
    for turn in (2, 3):
        shared, rows = flats(), [m for p, x in made.items() for m in x.messages(states[p], p)]
        met = {p: [] for p in made}
        for _, q, _, known in (m for m in rows if m[2] == lm.KNOWN):
            for p, x in lm.meet([(source, lm.unpack(m)) for slot, source, kind, m in rows if kind == lm.ASK and slot == q], lm.unpack(known)):
                met[q if p < 0 else p].append((p if p < 0 else q, x))
        # What a rare word gets is what all parts serve of it.
        for p, x in made.items():
            served = [sum(int(states[q][0].hosted[y.dish == 2 + y.others.index(w)].sum()) for q, y in made.items() if w in y.others) for w in x.rare_names]
            assert x.met(met[p], p, plan.samples).guests[0].tolist() == served
        before, states = shared, {p: [*x.sample(shared, v, plan, [turn, p], x.met(met[p], p, plan.samples))] for p, x in made.items()}
    answers = {p: lm.unpack(next(x.answers(lm.unpack(x.seated(states[p]))))[1]) for p, x in made.items()}
    *_, found = lm.log_scores(chunk, contexts, parts, answers, n, v, flats(), seen, plan, before.discounts())
    found = dict(zip(map(tuple, asked), found[len(texts) :].tolist(), strict=True))
    for i, u in enumerate(words):
        chance = {w: 10 ** (found[u, w] - found[u,]) for w in [*words, lm.END, b"new"] if w != words[1]}  # not in training either
        assert sum(chance.values()) == pytest.approx(1, abs=1e-6)
        if i > 1 and i % 2 == 0:
            assert chance[words[i + 1]] > 0.8


def test_scores_hardly_depend_on_which_words_are_common(spark, monkeypatch):
    """A large share leaves the start of a text as the only common context; all the others are rare words'."""
    monkeypatch.setattr(lm, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(lm, "PART_TOKENS", 2000)
    r = random.Random(15)
    rows = [(i, " ".join(f"a{k} b{k}" for k in r.choices(range(40), k=20)), "en", "a", 1, "", "", "") for i in range(200)]
    totals = [sum(x.score for x in lm.score(frame(spark, rows), lm.Plan(share=share)).collect()) for share in (0.5, 1e-9)]
    assert totals[0] == pytest.approx(totals[1], rel=0.02)


def test_model_beats_the_base_on_held_out_texts_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = lm.score(docs).collect()
    held = [x for x in got if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)
    again = lm.score(docs.repartition(5)).collect()
    assert sorted((x.doc_id, round(x.score, 6)) for x in got) == sorted((x.doc_id, round(x.score, 6)) for x in again)
    assert lm.score(frame(spark, [])).collect() == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = [r.doc_id for r in out.collect()]
        kept.append(rows)
        docs = spark.createDataFrame(out.collect(), docs.schema)
    good, unique, apart, mixed = kept
    assert sum(k not in good for k, q in labels.items() if q) <= 2
    low = lambda k: texts[k].encode().lower()
    assert sorted(unique) == sorted({low(k): k for k in sorted(good)}.values())
    prints = {k: simhash.fingerprint(texts[k]) for k in unique}
    assert all((prints[a] ^ prints[b]).bit_count() > 2 for a in apart for b in apart if a < b)
    assert set(mixed) <= set(apart) and max(Counter(mixed).values()) <= 2
    size = lambda ks: sum(len(texts[k].split()) for k in ks)
    assert size(mixed) == pytest.approx(1.5 * size(apart), rel=0.05)
    got = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        own = coder(f.read(), public_tokenizers.PATTERN)
    assert Counter(r.doc_id for r in got) == Counter(mixed)
    for r in got:
        ids = own.encode(texts[r.doc_id])
        assert (r.n_tokens, r.decoded_sha256) == (len(ids), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == Counter(mixed)


def test_coders_remember_a_bounded_part_of_many_words():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        own = coder(f.read(), public_tokenizers.PATTERN)
    texts = [" ".join(f"w{i:x}" for i in range(at, at + 4000)) for at in range(0, 400_000, 4000)]
    assert [x[2] for x in own.digests(texts)] == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    assert len(own.lines) + len(own.old[0]) < 300_000


def test_a_coder_holds_the_words_of_few_texts_at_once():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        own = coder(f.read(), public_tokenizers.PATTERN)
    texts = ["ab cd " * 8000 for _ in range(40)]
    [*own.digests(texts[:1])]
    tracemalloc.start()
    found = {x[2] for x in own.digests(texts)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {hashlib.sha256(texts[0].encode()).hexdigest()} and peak < 10 << 20


def test_python_stages_of_the_pipeline_get_batches_of_bounded_bytes(spark):
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 600) AS text", "'en' AS lang", "'a' AS source", "1 AS n_chars").coalesce(1)
    sizes = lambda: docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
    try:
        for at in (0, 2, 4):
            spark.conf.unset(bound)
            assert max(sizes()).n > 2 * corpus_pipeline.BATCH_BYTES
            corpus_pipeline.STAGES[at][1](spark, docs.limit(2), SF)
            got = [x.n for x in sizes()]
            assert max(got) < 1.1 * corpus_pipeline.BATCH_BYTES and sum(got) > 2 * corpus_pipeline.BATCH_BYTES
    finally:
        spark.conf.unset(bound)


def test_every_operator_has_one_query():
    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 14)] == [1] * 13
