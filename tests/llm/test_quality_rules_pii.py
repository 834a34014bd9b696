"""The co-trained classifier, risk-controlled rules and personal data."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeledger.llm import pii, quality, rules

from .helpers import frame, odd_rows, some_text

LABELS = "doc_id long, quality int, toxic int"


def mixed_quality(n, seed=8):
    """Poor texts shout or repeat themselves, and come more often from one source."""
    r, rows, labels = random.Random(seed), [], []
    for i in range(n):
        good = r.random() < 0.75
        text = some_text(r, r.randint(60, 120))
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split()) if r.random() < 0.5 else "same words here " * 30
        source = r.choice(["a", "b"]) if good or r.random() < 0.3 else "junk"
        rows.append((i, text, "en", source, len(text), "", "", ""))
        if r.random() < 0.6:
            labels.append((i, int(good), 0))
    truth = {row[0]: not ("!!" in row[1] or row[1].startswith("same")) for row in rows}
    return rows, labels, truth


def test_classifier_tells_held_out_documents(spark):
    rows, labels, truth = mixed_quality(900)
    docs = frame(spark, rows)
    table = spark.createDataFrame(labels + labels[:3] + [(None, 1, 0), (5000, 1, 0), (1, None, 0)], LABELS)
    plan = quality.Plan(labelled=250)
    model = quality.fitted(docs, table, plan)
    got = {r.doc_id: r for r in quality.scored(docs, model, plan).collect()}
    assert sum(got[k].kept == truth[k] for k in truth) / len(truth) > 0.97
    assert sum(not got[k].kept for k in truth if truth[k]) / sum(truth.values()) < 0.02
    assert all(0 <= x <= 1 for r in got.values() for x in (r.text_score, r.meta_score, r.score))
    kept = quality.good_only(docs, table, plan)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept}
    again = {r.doc_id: r.score for r in quality.scored(docs, quality.fitted(docs, table, plan), plan).collect()}
    assert again == {k: r.score for k, r in got.items()}


def test_views_exchange_labels(spark):
    """A few labels don't tell most poor words; the metadata view's sure documents teach them to the text view."""
    r, rows, truth = random.Random(9), [], {}
    poor, fine = [f"spam{i}" for i in range(60)], [f"word{i}" for i in range(200)]
    for i in range(700):
        good = r.random() < 0.6
        source = ("a" if good else "junk") if r.random() < 0.9 else "mixed"
        words = [r.choice(fine if good or r.random() < 0.8 else poor) for _ in range(60)]
        rows.append((i, " ".join(words) + ".", "en", source, 1, "", "", ""))
        truth[i] = good
    docs, known = frame(spark, rows), list(range(48))
    labels = spark.createDataFrame([(k, int(truth[k]), 0) for k in known], LABELS)
    wrong = {}
    for rounds in (0, 3):
        plan = quality.Plan(rounds=rounds, confident=0.9, labelled=48)
        scorer = quality.Scorer(quality.fitted(docs, labels, plan))
        seen = [(scorer(t, (lang, "mixed")), truth[k]) for k, t, lang, *_ in rows if k not in known]
        wrong[rounds] = sum((text >= 0.5) != good for (text, _, _), good in seen)
    assert wrong[3] < 0.7 * wrong[0], wrong


def test_exchange_sums_equal_those_of_single_documents(spark):
    rows = mixed_quality(120)[0]
    stored = quality.features(frame(spark, rows).select("text", "lang", "source"))
    r = np.random.default_rng(4)
    weights = [r.normal(size=quality.TEXT_DIMS + 1) * 0.1, r.normal(size=2 * quality.NUMBERS + quality.NAME_DIMS + 1)]
    scales, mean, std = [(1.0, 0.1), (0.7, -0.2)], np.zeros(quality.NUMBERS), np.ones(quality.NUMBERS) * 2
    plan = quality.Plan(confident=0.6)
    got = quality.exchanged(stored, plan)(weights, scales, mean, std)
    want = [np.zeros_like(g) for g in got]
    for _, t, lang, source, *_ in rows:
        views = [quality.text_rows([t])[0], quality.meta_rows([quality.metadata(t, (lang, source))], mean, std)[0]]
        for k in (0, 1):
            z = float((views[k][1] * weights[k][views[k][0]]).sum() + weights[k][-1])
            p = 1 / (1 + math.exp(-(scales[k][0] * z + scales[k][1])))
            if max(p, 1 - p) >= plan.confident:
                c = int(p >= plan.confident)
                np.add.at(want[1 - k][c], views[1 - k][0], views[1 - k][1] * quality.GRAIN)
                want[1 - k][c, -1] += 1
    for g, w in zip(got, want, strict=True):
        assert w[:, -1].sum() > 0 and (g[:, -1] == w[:, -1]).all() and np.allclose(g, w, atol=200)


def test_repeated_keys_give_one_model(spark):
    rows, labels, _ = mixed_quality(300)
    twice = rows + [(k, "another text " * 20, *rest) for k, _, *rest in rows[:50]]
    table = spark.createDataFrame(labels, LABELS)
    plan = quality.Plan(labelled=100)
    a, b = (quality.fitted(frame(spark, x), table, plan) for x in (twice, twice[::-1]))
    assert (a.text == b.text).all() and (a.meta == b.meta).all() and a.views == b.views


def test_classifier_without_labels_or_rows(spark):
    docs = frame(spark, odd_rows())
    none = spark.createDataFrame([], LABELS)
    got = quality.scored(docs, quality.fitted(docs, none)).collect()
    assert len(got) == len(odd_rows()) and all(r.kept and r.score == 1.0 for r in got)
    assert quality.good_only(docs, none).count() == len(odd_rows())
    model = quality.fitted(frame(spark, mixed_quality(300)[0]), spark.createDataFrame(mixed_quality(300)[1], LABELS), quality.Plan(labelled=200))
    assert len(quality.scored(docs, model).collect()) == len(odd_rows())
    assert quality.scored(frame(spark, []), model).collect() == []


def base_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_rule_base_equals_brute_force(spark):
    rows = [*odd_rows(), (300, "a b c a b c d\na b\na b\n\n\n $$ <x>", "de", "a", 1, "", "", ""), (301, "x x x x", "fr", "a", 1, "", "", ""), (302, "a b", "fr", "a", 1, "", "", "")]
    got = rules.judged(frame(spark, rows), spark.createDataFrame([], LABELS)).collect()
    assert sorted(str(tuple(r)[:7]) for r in got) == sorted(str((k, *base_of(t))) for k, t, *_ in rows)
    assert all(r.kept == (not r.base_failed) for r in got)
    assert rules.judged(frame(spark, []), spark.createDataFrame([], LABELS)).collect() == []


def test_binomial_p_values(spark):
    for x, n, p in ((0, 10, 0.02), (3, 200, 0.02), (40, 3000, 0.02), (5, 5, 0.5)):
        want = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1))
        got = spark.range(1).select(rules.at_most(F.lit(x).cast("bigint"), F.lit(n).cast("bigint"), p).alias("p")).first().p
        assert got == pytest.approx(want, rel=1e-9)


def test_cutoffs_are_certified_and_reject_poor_documents(spark):
    r, rows, labels = random.Random(10), [], []
    for i in range(3000):
        good = r.random() < 0.7
        text = " ".join(f"w{r.randrange(10**6)}" for _ in range(60)) + ("" if good else " $$$" * 12)
        rows.append((i, text, "en" if i % 50 else "de", "a", 1, "", "", ""))
        labels.append((i, int(good), 0))
    docs, table = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    got = {x.doc_id: x for x in rules.judged(docs, table).collect()}
    good = {k: bool(q) for k, q, _ in labels}
    english = [k for k in good if k % 50]
    assert sum(not got[k].kept for k in english if good[k]) / sum(good[k] for k in english) <= 0.02
    assert all(not got[k].kept and got[k].broken == "symbols" for k in english if not good[k])
    assert all(got[k].kept for k in good if k % 50 == 0)  # too few German labels to certify anything
    # Labels that say nothing about the symbols give no cutoff.
    noise = spark.createDataFrame([(k, r.randint(0, 1), 0) for k in good], LABELS)
    assert all(x.kept for x in rules.judged(docs, noise).collect())


def test_doubled_words_are_rejected(spark):
    """w w x x y y has no repeated three-word window."""
    r, rows, labels = random.Random(14), [], []
    for i in range(2000):
        good = r.random() < 0.7
        own = r.sample(range(10**6), 60)
        rows.append((i, " ".join(f"w{x}" if good else f"w{x} w{x}" for x in own), "en", "a", 1, "", "", ""))
        labels.append((i, int(good), 0))
    got = {x.doc_id: x for x in rules.judged(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    assert all(got[k].kept == bool(q) and got[k].broken == (None if q else "stutter") for k, q, _ in labels)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}
            if fits[kind]():
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    r = random.Random(1)
    parts = ["a", "@", ".", "1", "4", "0", "-", " ", "+", "%", "2", "b.c", "é", "4111111111111111", "(", "255"]
    for _ in range(30_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        assert pii.base_spans(text) == slow_spans(text)
    for text in ("1" * 200_000, "a" * 200_000 + "@", "@" * 100_000, "+1" * 50_000, "1." * 100_000):
        pii.base_spans(text)  # linear


def test_terms_that_reveal_an_entity(spark):
    r = random.Random(11)
    common = lambda n: " ".join(r.choice(["of", "the", "and", "in", "to"]) for _ in range(n))
    texts = [f"{common(12)} Zorblatt of the {common(1)} mail me at zor@blatt.example {common(12)}" for _ in range(3)]
    texts += [common(30) for _ in range(200)] + ["the only 10.0.0.1 address here", None, ""]
    rows = [(i, t, "en", "a", 1, "", "", "") for i, t in enumerate(texts)]
    docs = frame(spark, rows)
    got = {x.doc_id: x for x in pii.personal_data(docs).collect()}
    for i, t in enumerate(texts):
        spans = slow_spans(t or "")
        assert got[i].base_sha256 == pii.digest(spans)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(s[0] == k for s in spans) for k in pii.KINDS)
    for i in range(3):
        terms = [texts[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in got[i].spans.split(",")) if k == "term"]
        # Words that occur near this address only give it away; common ones don't, nor do those that met it once.
        assert "Zorblatt" in terms and {"mail", "me", "at"} <= set(terms) and not {"of", "the", "and"} & set(terms)
    assert all(got[i].n_term == 0 for i in range(3, len(texts)))
    clean = {x.doc_id: x.text for x in pii.sanitised(docs, plan=pii.Disclosure(removal=2.0)).collect()}
    assert "zor@blatt" not in clean[0] and "<email>" in clean[0] and "<name>" in clean[0] and "Zorblatt" not in clean[0]
    assert clean[10] == texts[10] and clean[204] is None
    assert len(pii.personal_data(frame(spark, odd_rows())).collect()) == len(odd_rows())
    assert pii.personal_data(frame(spark, [])).collect() == []


def test_terms_far_from_the_entity_and_in_other_texts(spark):
    """A name 40 words from the address discloses it, and is marked wherever it stands, also where the address is not."""
    filler = "of the and in to " * 8
    texts = [f"Zorblatt {filler} write to zor@blatt.example {filler} Zorblatt"] * 4 + [f"{filler} Zorblatt {filler}"] + [filler] * 400
    got = {x.doc_id: x for x in pii.personal_data(frame(spark, [(i, t, "en", "a", 1, "", "", "") for i, t in enumerate(texts)])).collect()}
    for i in range(5):
        places = sorted((m.start(), m.end()) for m in re.finditer("Zorblatt", texts[i]))
        terms = [(int(a), int(b)) for k, a, b in (s.split(":") for s in got[i].spans.split(",")) if k == "term"]
        assert set(places) <= set(terms) and all(texts[i][a:b] in ("Zorblatt", "write") for a, b in terms)
    assert all(got[i].n_term == 0 for i in range(5, len(texts)))
