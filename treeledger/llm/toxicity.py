"""Toxicity (operator 11): multiple-instance learning; sentences are scored, a noisy-or of them is fitted to documents' labels."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, pick

WORD = re.compile(r"\w+")
#: A sentence ends here. Splitting is linear in the text, whatever stands in it.
BORDER = re.compile(r"[.!?\n]+")
#: Beginnings of longer words that are terms of their own, in characters: words built on one stem share them.
STEMS = range(4, 9)
#: Entries that a task keeps, of counts not yet passed on and of words whose weight it knows.
REMEMBERED = 1 << 18
CLEAR = 30.0
#: A word's terms say much the same: each begins with this part of its log-odds.
SHARE = 3.0


@dataclass(frozen=True)
class Plan:
    """labelled: labelled rows to fit on, at most (the smallest by hash of their key). terms: of these rows, at most so many
    terms get a weight; a term needs `support` toxic documents and a log-likelihood ratio of `strength` against chance.
    offending: sentence probability from which a sentence counts as one that offends."""

    labelled: int = 20_000
    terms: int = 1 << 14
    support: int = 3
    strength: float = 10.0
    steps: int = 400
    rate: float = 0.05
    decay: float = 2e-4
    offending: float = 0.3
    seed: int = 11


@dataclass
class Model:
    """Weights of terms, the log-odds of a sentence without any, and those that a document is toxic for no sentence's sake.
    Without both classes among the labels there are no weights, and `prior`, the share of toxic labels, is every score."""

    weights: dict[str, float] = field(default_factory=dict)
    sentence: float = -CLEAR
    leak: float = -CLEAR
    prior: float | None = None


def terms(word: str) -> list[str]:
    """A word's terms: itself and, marked, its beginnings."""
    low = word.lower()
    return ["=" + low, *["^" + low[:k] for k in STEMS if len(low) > k]]


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the sentences that have a word, without blanks at either side."""
    begin = 0
    for border in [*BORDER.finditer(text), None]:
        end = border.start() if border else len(text)
        part = text[begin:end]
        if WORD.search(part):
            yield begin + len(part) - len(part.lstrip()), end - len(part) + len(part.rstrip())
        begin = border.end() if border else end


def sample(docs: DataFrame, labels: DataFrame, plan: Plan = Plan(), key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """order, text, y of the rows to fit on. A key of several labels takes the majority, 1 on a tie; null keys and labels are
    left out; labels without a document count towards the bound. Rows that share a key each count."""
    order = F.xxhash64(F.lit(plan.seed), F.col("key"))
    known = pick(labels, key, label).toDF("key", "y").where("key is not null and y is not null").groupBy("key")
    chosen = known.agg((F.avg("y") >= 0.5).cast("int").alias("y")).withColumn("order", order).orderBy("order", "key").limit(plan.labelled)
    rows = pick(docs, key, text).toDF("key", "text")
    return rows.join(F.broadcast(chosen), "key").select("order", F.coalesce("text", F.lit("")).alias("text"), "y")  # plan.labelled rows


def chosen_terms(rows: DataFrame, plan: Plan) -> dict[str, float]:
    """The terms that toxic documents hold more often than chance would have it, the clearest first, with their log-odds."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[Counter[str]] = [Counter(), Counter()]

        def out() -> pa.RecordBatch:
            names = sorted(set(found[0]) | set(found[1]))
            made = [pa.array(names, pa.string()), *[pa.array([c[n] for n in names], pa.int64()) for c in found]]
            found[0].clear(), found[1].clear()
            return pa.RecordBatch.from_arrays(made, ["term", "clean", "toxic"])

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found[y].update({t for w in set(WORD.findall(text.as_py())) for t in terms(w)})
                if len(found[0]) + len(found[1]) > REMEMBERED:
                    yield out()
        yield out()

    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("toxic")).first()
    n, toxic = sizes["n"], sizes["toxic"]
    if not 0 < toxic < n:
        return {}
    a, b = F.col("toxic"), F.col("clean")
    share = (a + b) / F.lit(float(n))
    part: list[Column] = []
    for seen, of in ((a, float(toxic)), (b, float(n - toxic))):
        for got, expected in ((seen, share * of), (F.lit(of) - seen, (1 - share) * of)):
            part.append(F.when(got > 0, got * F.log(got / expected)).otherwise(0.0))
    counts = rows.select("text", "y").mapInArrow(counted, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((a + 0.5) / (toxic + 1.0)) - F.log((b + 0.5) / (n - toxic + 1.0))
    clear = counts.where((a >= plan.support) & (a / toxic > b / (n - toxic))).select("term", F.round(2 * sum(part, F.lit(0.0)), 6).alias("strength"), odds.alias("odds"))
    best = clear.where(F.col("strength") >= plan.strength).orderBy(F.desc("strength"), "term").limit(plan.terms).collect()
    return {r["term"]: r["odds"] for r in best}


def bags(rows: DataFrame, known: dict[str, float]) -> DataFrame:
    """order, y, plain (sentences without a known term), times, sizes and terms of each row.

    A sentence is the bag of its known terms' numbers; a document's equal sentences are one pattern, met `times` times. The
    patterns' terms stand one after another, `sizes` of them each.
    """
    number = {t: i for i, t in enumerate(known)}
    schema = "order long, y int, plain int, times array<int>, sizes array<int>, terms array<int>"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, lists = [], ([], [], [])
            for value in batch.column(1):
                text, found = value.as_py(), Counter()
                for a, b in sentences(text):
                    found[tuple(sorted(number[t] for w in WORD.findall(text, a, b) for t in terms(w) if t in number))] += 1
                plain.append(found.pop((), 0))
                patterns = sorted(found.items())
                own = ([n for _, n in patterns], [len(p) for p, _ in patterns], [t for p, _ in patterns for t in p])
                for out, x in zip(lists, own, strict=True):
                    out.append(x)
            columns = [batch.column(0), batch.column(2), pa.array(plain, pa.int32()), *[pa.array(x, pa.list_(pa.int32())) for x in lists]]
            yield pa.RecordBatch.from_arrays(columns, ["order", "y", "plain", "times", "sizes", "terms"])

    return rows.select("order", "text", "y").mapInArrow(made, schema)


def train(found: pa.Table, start: np.ndarray, plan: Plan = Plan()) -> tuple[np.ndarray, float, float]:
    """Weights, sentence and leak log-odds that fit P(toxic) = 1 - (1 - leak) * product of (1 - p(sentence)) to `bags`' labels.

    With A = -log(1 - P), the sum of softplus(log-odds) over a document's sentences and its leak, the log-likelihood's slope
    in A is (1 - y) - y * (1 - P) / P, and A's slope in a sentence's log-odds is that sentence's probability. Weights begin at
    `start` and are drawn towards it: a toxic document full of well-known words says little about the others in it.
    """
    dims, n = len(start), found.num_rows
    flat = {c: pc.list_flatten(found.column(c)).to_numpy() for c in ("times", "sizes", "terms")}
    y, plain, times = (x.astype(float) for x in (found.column("y").to_numpy(), found.column("plain").to_numpy(), flat["times"]))
    doc = np.repeat(np.arange(n), pc.list_value_length(found.column("times")).to_numpy())
    row, term, patterns = np.repeat(np.arange(len(times)), flat["sizes"]), flat["terms"], len(times)
    per = max(1.0, float(plain.sum() + times.sum()) / n)
    # The last two entries are the sentence's and the leak's log-odds.
    w = np.append(start, [math.log(0.05 / per), math.log(0.01)])
    m, v = np.zeros(dims + 2), np.zeros(dims + 2)
    for t in range(1, plan.steps + 1):
        z = np.clip(np.bincount(row, w[term], patterns) + w[dims], -CLEAR, CLEAR)
        p, p0, leak = (1 / (1 + np.exp(-np.clip(x, -CLEAR, CLEAR))) for x in (z, w[dims], w[dims + 1]))
        a = np.bincount(doc, times * np.logaddexp(0, z), n) + plain * np.logaddexp(0, w[dims]) + np.logaddexp(0, w[dims + 1])
        clean = np.exp(-a)
        slope = ((1 - y) - y * clean / np.maximum(1 - clean, 1e-12)) / n
        g = slope[doc] * times * p
        grad = np.append(np.bincount(term, g[row], dims), [g.sum() + (slope * plain).sum() * p0, slope.sum() * leak])
        grad[:dims] += plan.decay * (w[:dims] - start)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= plan.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:dims], float(w[dims]), float(w[dims + 1])


def fitted(docs: DataFrame, labels: DataFrame, plan: Plan = Plan(), key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model of the sampled rows. Words are counted and sentences made into bags where the texts are; the driver gets the
    terms and, of each sampled row, its distinct sentences with a known term as numbers. Reruns give the same model."""
    rows = cut_lineage(sample(docs, labels, plan, key, text, label))
    known = chosen_terms(rows, plan)
    if not known:
        share = rows.agg(F.avg("y")).first()[0]
        return Model(prior=float(share or 0.0))
    found = bags(rows, known).toArrow()
    # In one order whatever the tasks did, so that sums agree: rows of equal hash have one key, and go by what they hold.
    keys = zip(*(found.column(c).to_pylist() for c in ("order", "plain")), map(str, found.column("terms").to_pylist()), strict=True)
    found = found.take(pa.array([i for _, i in sorted((k, i) for i, k in enumerate(keys))], pa.int64()))
    weights, sentence, leak = train(found, np.array(list(known.values())) / SHARE, plan)
    return Model(dict(zip(known, weights.tolist(), strict=True)), sentence, leak)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}
        self.quiet = float(np.logaddexp(0, model.sentence))

    def weights(self, words: list[str]) -> list[float]:
        try:
            return list(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > REMEMBERED:
                self.known = {}
            for word in set(words).difference(self.known):
                self.known[word] = sum(self.model.weights.get(t, 0.0) for t in terms(word))
            return list(map(self.known.__getitem__, words))

    def spans(self, text: str) -> Iterator[tuple[int, int, float]]:
        """Start, end and log-odds of each sentence."""
        for a, b in sentences(text):
            yield a, b, min(CLEAR, max(-CLEAR, sum(self.weights(WORD.findall(text, a, b))) + self.model.sentence))

    def __call__(self, text: str, offending: float) -> tuple[float, int, int, int | None, int | None, float]:
        """The document's probability, its sentences, those that offend, and the worst one's start, end and probability."""
        if self.model.prior is not None:
            return self.model.prior, sum(1 for _ in sentences(text)), 0, None, None, 0.0
        a, n, offends, worst = float(np.logaddexp(0, self.model.leak)), 0, 0, (None, None, -math.inf)
        if not any(self.weights(WORD.findall(text))):  # no known term: all sentences are alike
            n = sum(1 for part in BORDER.split(text) if WORD.search(part))
            if n:
                worst = (*next(sentences(text)), self.model.sentence)
            a += n * self.quiet
        else:
            for start, end, z in self.spans(text):
                a, n = a + math.log1p(math.exp(z)), n + 1
                offends += 1 / (1 + math.exp(-z)) >= offending
                if z > worst[2]:
                    worst = (start, end, z)
        return -math.expm1(-a), n, offends, worst[0], worst[1], 1 / (1 + math.exp(-worst[2])) if n else 0.0


def scored(docs: DataFrame, model: Model, plan: Plan = Plan(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, score, n_sentences, n_offending, worst_start, worst_end, worst_score of each row of `docs`, in one pass.

    Only the text decides. Null and empty texts have no sentence: their score is the model's leak, their worst span null. Whole
    texts count, however long; the first of equally bad sentences is the worst one. Equal rows score alike, an empty table
    gives an empty result, further columns don't count. Without both classes among the labels every score is their share of
    toxic ones, 0 without labels.
    """
    rows = pick(docs, key, text).select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    kinds = [("score", pa.float64()), ("n_sentences", pa.int64()), ("n_offending", pa.int64()), ("worst_start", pa.int64()), ("worst_end", pa.int64()), ("worst_score", pa.float64())]
    schema = T.StructType([rows.schema["key"], *[T.StructField(n, T.DoubleType() if k == pa.float64() else T.LongType()) for n, k in kinds]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer(t.as_py(), plan.offending) for t in batch.column(1)]
            columns = [pa.array([f[i] for f in found], k) for i, (_, k) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", *[n for n, _ in kinds]])

    return rows.mapInArrow(score, schema).withColumnRenamed("key", key)


def offending(docs: DataFrame, model: Model, plan: Plan = Plan(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, start, end (code points, end exclusive), score and sentence: each sentence that offends. Odd rows are as `scored`
    treats them; without weights there is no such sentence."""
    rows = pick(docs, key, text).select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["key"], *T.StructType.fromDDL("start long, end long, score double, sentence string")])
    names = [f.name for f in schema]

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            at, found = [], []
            for i, value in enumerate(batch.column(1) if model.prior is None else ()):
                text = value.as_py()
                if any(scorer.weights(WORD.findall(text))):
                    for start, end, z in scorer.spans(text):
                        if (p := 1 / (1 + math.exp(-z))) >= plan.offending:
                            at.append(i), found.append((start, end, p, text[start:end]))
            columns = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names)

    return rows.mapInArrow(located, schema).withColumnRenamed("key", key)
