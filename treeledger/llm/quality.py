"""Quality classifier (operator 2): co-training of a text view and a page-metadata view."""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, pick, sliced

#: Dimensions of the hashed text view, and of the hashed names (language, source) of the metadata view.
TEXT_DIMS, NAME_DIMS = 1 << 15, 1 << 8
NUMBERS = 9
#: Words whose weight a task remembers; past it they are forgotten and worked out anew.
REMEMBERED = 1 << 16
SIGNS = "!?.,:;*$%&#|<>()[]{}\"'~^_=+-/\\"
CLEAR = 12.0  # logits are held within this


@dataclass(frozen=True)
class Plan:
    """labelled: labelled rows to fit on (the smallest by hash), at most; all other documents take part in the exchange. rounds:
    exchanges. confident: probability from which a view passes a pseudo-label on. holdout: share of the labelled sample that
    calibrates. threshold: to keep."""

    labelled: int = 4000
    rounds: int = 4
    confident: float = 0.97
    holdout: float = 0.25
    threshold: float = 0.5
    seed: int = 5


def slots(word: str) -> tuple[int, int]:
    """The text view's two dimensions for a word: of the word itself, and of its case with the signs at its end."""
    bare = word.rstrip(SIGNS)
    case = "U" if bare.isupper() else "l" if bare.islower() else "T" if bare.istitle() else "0" if bare.isdigit() else "-"
    shape = case + word[len(bare) :][:8]
    low = word.lower().encode("utf-8", "surrogatepass")
    return zlib.crc32(low) % (TEXT_DIMS - 1), zlib.crc32(b"\0" + shape.encode("utf-8", "surrogatepass")) % (TEXT_DIMS - 1)


def metadata(text: str, names: tuple[str | None, ...]) -> tuple[list[float], list[int]]:
    """The metadata view: numbers about length and layout, and the dimensions of the page's names."""
    lines = text.split("\n")
    filled = [x for x in lines if x.strip()]
    lengths = [len(x) for x in filled] or [0]
    mean = sum(lengths) / len(lengths)
    ends = sum(x.rstrip()[-1] in ".!?:;\"'" for x in filled)
    n = max(1, len(filled))
    numbers = [
        math.log1p(len(text)), math.log1p(len(lines)), math.log1p(mean), math.log1p(max(lengths)),
        math.log1p(sum((x - mean) ** 2 for x in lengths) / len(lengths)), 1 - len(set(filled)) / n, ends / n,
        1 - len(filled) / len(lines), sum(len(x) < 40 for x in filled) / n,
    ]
    return numbers, [zlib.crc32(f"{i}:{x}".encode("utf-8", "surrogatepass")) % NAME_DIMS for i, x in enumerate(names)]


def again(words: list[str]) -> int:
    """Words that repeat the one before; they count in the text view's last dimension."""
    return sum(map(operator.eq, words, words[1:]))


class Sparse:
    """Rows of (index, value) pairs, as a logistic regression needs them."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], dims: int):
        self.dims, self.n = dims, len(rows)
        self.row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows]) if rows else np.zeros(0, np.int64)
        self.index = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int64)
        self.value = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)

    def score(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.index], self.n) + w[-1]

    def fit(self, y: np.ndarray, weight: np.ndarray, steps: int = 60, rate: float = 0.2, decay: float = 1e-4) -> np.ndarray:
        """Weights and, last, the intercept; Adam over all rows with a weight."""
        w, m, v = np.zeros(self.dims + 1), np.zeros(self.dims + 1), np.zeros(self.dims + 1)
        used = weight[self.row] > 0
        row, index, value, total = self.row[used], self.index[used], self.value[used], weight.sum()
        for t in range(1, steps + 1):
            z = np.bincount(row, value * w[index], self.n) + w[-1]
            error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
            g = np.append(np.bincount(index, value * error[row], self.dims), error.sum()) + decay * np.append(w[:-1], 0)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return w


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn a view's scores into log-odds on the holdout."""
    spread = float(z.std()) or 1.0
    rows = [(np.array([0]), np.array([x])) for x in z / spread]
    w = Sparse(rows, 1).fit(y, np.ones(len(y)), steps=400, rate=0.05, decay=1e-3)
    return max(0.0, float(w[0])) / spread, float(w[1])


def balanced(y: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Weights that let both classes count alike."""
    out = np.zeros(len(y))
    for side in (0, 1):
        own = on & (y == side)
        if own.any():
            out[own] = 0.5 / own.sum()
    return out


@dataclass
class Model:
    """Fitted weights; `combine` has the weights of the views' log-odds and an intercept. Without both classes, only `prior`."""

    text: np.ndarray | None
    meta: np.ndarray | None
    mean: np.ndarray | None
    std: np.ndarray | None
    views: tuple[tuple[float, float], tuple[float, float]] | None
    combine: np.ndarray | None
    prior: float


def text_rows(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for words in map(str.split, texts):
        counts, sums = Counter(words), {TEXT_DIMS - 1: float(again(words))}
        for word, n in counts.items():
            for slot in slots(word):
                sums[slot] = sums.get(slot, 0.0) + n
        total = max(1, len(words))
        out.append((np.fromiter(sums, np.int64, len(sums)), np.fromiter(sums.values(), float, len(sums)) * (10 / total)))
    return out


def meta_rows(pages: list[tuple[list[float], list[int]]], mean: np.ndarray, std: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Standard scores, their squares, and the names."""
    out = []
    for numbers, names in pages:
        z = np.clip((np.array(numbers) - mean) / std, -4, 4)
        index = np.concatenate((np.arange(2 * NUMBERS), 2 * NUMBERS + np.array(names, np.int64)))
        out.append((index, np.concatenate((z, z * z, np.ones(len(names))))))
    return out


#: Sums of features are kept in whole numbers of this fraction, so that they agree whatever the tasks and their order.
GRAIN = 1 << 20
SLOTS = 16

Exchange = Callable[[list[np.ndarray], list[tuple[float, float]], np.ndarray, np.ndarray], list[np.ndarray]]


def centroids(sums: np.ndarray, dims: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The mean feature vector of each class that has documents, as rows; `sums` has a class per row, its count last."""
    out = []
    for row in sums:
        index = np.flatnonzero(row[:dims])
        out.append((index, row[index] / (GRAIN * max(1, row[dims]))))
    return out


def train(rows: list[tuple[str, tuple, float]], plan: Plan, exchange: Exchange | None = None) -> Model:
    """Fits on labelled (text, names, label) rows, in the order given.

    `exchange` gives, for both views' weights and calibrations, what each view gets from the other: per class the sum of its
    own features over all unlabelled documents that the other view is sure of, and their number. They join the fit as their
    mean, which weighs as much as the class's labelled rows, or less where the documents are fewer than those.
    """
    y = np.array([float(r[2]) for r in rows])
    prior = float(y.mean()) if len(y) else 1.0
    held = np.arange(1, len(y) + 1) % max(2, round(1 / plan.holdout)) == 0
    if any(not (part & (y == side)).any() for part in (~held, held) for side in (0, 1)):
        return Model(None, None, None, None, None, None, prior)
    pages = [metadata(t, n) for t, n, _ in rows]
    numbers = np.array([p[0] for p in pages])
    mean, std = numbers.mean(axis=0), numbers.std(axis=0) + 1e-6
    dims = (TEXT_DIMS, 2 * NUMBERS + NAME_DIMS)
    own = (text_rows([t for t, _, _ in rows]), meta_rows(pages, mean, std))
    views = [Sparse(x, d) for x, d in zip(own, dims, strict=True)]
    base = [balanced(y, ~held) for _ in views]
    weights = [x.fit(y, b) for x, b in zip(views, base, strict=True)]
    scales: list[tuple[float, float]] = []
    for turn in range(plan.rounds + 1):
        scales = [calibrated(x.score(w)[held], y[held]) for x, w in zip(views, weights, strict=True)]
        if turn == plan.rounds or exchange is None:
            break
        for k, sums in enumerate(exchange(weights, scales, mean, std)):
            given = sums[:, -1]
            share = np.array([min(given[c], (~held & (y == c)).sum()) / ((~held & (y == c)).sum() + min(given[c], (~held & (y == c)).sum())) for c in (0, 1)])
            both = Sparse([*own[k], *centroids(sums, dims[k])], dims[k])
            weight = np.concatenate((base[k] * (1 - share[y.astype(int)]), 0.5 * share))
            weights[k] = both.fit(np.concatenate((y, [0.0, 1.0])), weight)
    scores = [x.score(w) for x, w in zip(views, weights, strict=True)]
    odds = [np.clip(a * z + b, -CLEAR, CLEAR) for z, (a, b) in zip(scores, scales, strict=True)]
    both = [(np.array([0, 1]), np.array([u, v])) for u, v in zip(odds[0][held], odds[1][held], strict=True)]
    combine = Sparse(both, 2).fit(y[held], np.ones(int(held.sum())), steps=400, rate=0.05, decay=1e-3)
    combine[:2] = np.maximum(combine[:2], 0)
    return Model(*weights, mean, std, tuple(scales), combine, prior)


def features(rows: DataFrame) -> DataFrame:
    """index, value (the text view), numbers and names (the metadata view) of each of the rows (text and names)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            index, value, numbers, names = [], [], [], []
            named = zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True) if batch.num_columns > 1 else iter(lambda: (), 1)
            for text, own in zip(batch.column(0), named, strict=batch.num_columns > 1):
                text = text.as_py()
                (i, v), = text_rows([text])
                n, slots_ = metadata(text, own)
                index.append(i.astype("<u2").tobytes())
                value.append(v.astype("<f4").tobytes())
                numbers.append(np.array(n, "<f8").tobytes())
                names.append(np.array(slots_, "<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (index, value, numbers, names)], ["index", "value", "numbers", "names"])

    return rows.mapInArrow(run, "index binary, value binary, numbers binary, names binary")


def exchanged(stored: DataFrame, plan: Plan) -> Exchange:
    """The exchange over stored `features`: a task sums up the features of the documents that a view is sure of, Spark adds
    the tasks' sums, and four vectors reach the driver whatever the number of documents."""
    sizes = (TEXT_DIMS, 2 * NUMBERS + NAME_DIMS)

    def run_with(weights, scales, mean, std):
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros((2, d + 1), np.int64) for d in sizes]
            for batch in sliced(batches):
                text = [(np.frombuffer(i, "<u2").astype(np.int64), np.frombuffer(v, "<f4").astype(float)) for i, v in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True)]
                pages = [(np.frombuffer(n, "<f8"), np.frombuffer(s, "<u2").astype(np.int64)) for n, s in zip(*(batch.column(c).to_pylist() for c in (2, 3)), strict=True)]
                views = [Sparse(text, sizes[0]), Sparse(meta_rows(pages, mean, std), sizes[1])]
                for k in (0, 1):
                    slope, shift = scales[k]
                    p = 1 / (1 + np.exp(-np.clip(slope * views[k].score(weights[k]) + shift, -30, 30)))
                    other = views[1 - k]
                    for c, sure in enumerate((p <= 1 - plan.confident, p >= plan.confident)):
                        on = sure[other.row]
                        np.add.at(total[1 - k][c], other.index[on], np.rint(other.value[on] * GRAIN).astype(np.int64))
                        total[1 - k][c, -1] += int(sure.sum())
            flat = np.concatenate([t.ravel() for t in total])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SLOTS], pa.int32()), pa.array([flat.tobytes()], pa.binary())], ["slot", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for data in batch.column(1):
                    own = np.frombuffer(data.as_py(), np.int64)
                    total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "sums"])

        kind = "slot int, sums binary"
        found = stored.mapInArrow(sums, kind).repartition(SLOTS, "slot").mapInArrow(add, kind).collect()  # SLOTS rows at most
        flat = sum((np.frombuffer(bytes(r["sums"]), np.int64) for r in found), np.zeros(sum(2 * (d + 1) for d in sizes), np.int64))
        cut = 2 * (sizes[0] + 1)
        return [flat[:cut].reshape(2, -1).astype(float), flat[cut:].reshape(2, -1).astype(float)]

    return run_with


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def __call__(self, text: str, names: tuple) -> tuple[float, float, float]:
        """Calibrated probabilities of the text view, of the metadata view and of both combined."""
        m = self.model
        if m.text is None:
            return (m.prior,) * 3
        words = text.split()
        try:
            total = sum(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > REMEMBERED:
                self.known = {}
            for word in set(words).difference(self.known):
                a, b = slots(word)
                self.known[word] = float(m.text[a] + m.text[b])
            total = sum(map(self.known.__getitem__, words))
        total += again(words) * float(m.text[TEXT_DIMS - 1])
        z = total * 10 / max(1, len(words)) + m.text[-1]
        (index, value), = meta_rows([metadata(text, names)], m.mean, m.std)
        odds = [z, float((value * m.meta[index]).sum() + m.meta[-1])]
        odds = [min(CLEAR, max(-CLEAR, a * x + b)) for x, (a, b) in zip(odds, m.views, strict=True)]
        odds.append(float(m.combine[0] * odds[0] + m.combine[1] * odds[1] + m.combine[2]))
        return tuple(1 / (1 + math.exp(-x)) for x in odds)


def fitted(docs: DataFrame, labels: DataFrame, plan: Plan = Plan(), key: str = "doc_id", text: str = "text", names: tuple[str, ...] = ("lang", "source"), label: str = "quality") -> Model:
    """A model fitted on at most `plan.labelled` labelled documents, the smallest by hash of their key, and on what both views
    teach each other about all other documents of `docs`, in `plan.rounds` rounds.

    Documents of several labels take the majority, 1 on a tie; null labels and null keys are left out. Of documents that share
    a labelled key the one with the smallest hash of its values is fitted on; all others count as unlabelled. Texts are read
    once for their features, which are stored; the rounds read these. Whole texts count, however long.
    """
    known = pick(labels, key, label).toDF("key", "y").where("key is not null and y is not null").groupBy("key").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    order = [F.xxhash64(F.lit(plan.seed), "key"), F.col("key")]
    rows = pick(docs, key, text, *names).toDF("key", "text", *[f"n{i}" for i in range(len(names))])
    rows = rows.withColumns({"text": F.coalesce("text", F.lit("")), **{f"n{i}": F.col(f"n{i}").cast("string") for i in range(len(names))}})
    keys = pick(docs, key).toDF("key").where("key is not null").distinct()
    chosen = cut_lineage(keys.join(known, "key").orderBy(*order).limit(plan.labelled))
    sample = rows.join(F.broadcast(chosen), "key")  # at most plan.labelled keys
    values = F.struct(*[c for c in sample.columns if c not in ("key", "y")])
    first = sample.groupBy("key", "y").agg(F.min_by(values, F.struct(F.xxhash64(values), values)).alias("v")).select("key", "y", "v.*")
    found = sorted(first.collect(), key=lambda r: (zlib.crc32(str(r["key"]).encode()), str(r["key"])))
    data = [(r["text"], tuple(r[f"n{i}"] for i in range(len(names))), r["y"]) for r in found]
    if len({y for *_, y in data}) < 2:
        return train(data, plan)
    others = rows.join(F.broadcast(chosen.select("key")), "key", "left_anti").drop("key")
    return train(data, plan, exchanged(cut_lineage(features(others)), plan))


def scored(docs: DataFrame, model: Model, plan: Plan = Plan(), key: str = "doc_id", text: str = "text", names: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """`key`, text_score, meta_score, score (probabilities of good quality) and kept of each row of `docs`, in one pass.

    Whole texts count, null as empty; names may be null. Without both classes among the sampled labels nothing can be told
    apart: then all scores are the share of good labels, 1 without labels, and every row is kept. Equal rows score alike.
    """
    rows = pick(docs, key, text, *names)
    rows = rows.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"), *[F.col(n).cast("string").alias(f"n{i}") for i, n in enumerate(names)])
    columns = ["text_score", "meta_score", "score"]
    schema = T.StructType([rows.schema["key"], *[T.StructField(c, T.DoubleType()) for c in columns]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in sliced(batches):
            named = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True) if names else iter(lambda: (), 1)
            found = np.array([scorer(t.as_py(), n) for t, n in zip(batch.column(1), named, strict=bool(names))]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, i].copy()) for i in range(3)]], ["key", *columns])

    kept = F.lit(True) if model.text is None else F.col("score") >= plan.threshold
    return rows.mapInArrow(score, schema).select(F.col("key").alias(key), *columns, kept.alias("kept"))


def good_only(docs: DataFrame, labels: DataFrame, plan: Plan = Plan(), key: str = "doc_id", text: str = "text", names: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of `docs` that the classifier keeps, with all columns. Rows are scored where they are read: nothing is joined."""
    model = fitted(docs, labels, plan, key, text, names)
    if model.text is None:
        return docs
    at = [docs.columns.index(c) for c in (text, *names)]
    placed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in sliced(batches):
            seen = zip(*(batch.column(i).to_pylist() for i in at), strict=True)
            on = [scorer(t or "", tuple(None if n is None else str(n) for n in own))[2] >= plan.threshold for t, *own in seen]
            yield batch.filter(pa.array(on, pa.bool_()))

    return placed.mapInArrow(keep, placed.schema).toDF(*docs.columns)
