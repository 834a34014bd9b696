"""LM scoring (operator 9): a hierarchical Pitman-Yor model whose seating is sampled by Gibbs, in parts of the vocabulary.

The root restaurant's dishes are words; its base is uniform. The start of a text and every training word have a context
restaurant with the root as its parent: each of its tables is a customer of the root. Common words hold a fixed share of the
training tokens, so their number has a bound (1 / share) whatever the corpus: their restaurants' dishes lie with the parts of
the vocabulary that own the dishes, and their totals go through the driver. Any other word's restaurant, small by that share,
lies whole with the part that owns the word.

A dish's seating is summed up in its number of tables. A sweep draws it from its full conditional given all other tables; parts
of the vocabulary are swept side by side and see the other parts' totals as of the round before. A restaurant that lies whole
in a part is drawn given a gamma variable that stands for its total, which leaves its dishes independent of each other.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import repeat
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut_lineage, pick, sliced

END = b""  # no word is empty
START = 0  # the context at the beginning of a text, and the number of the end as a dish
#: Bytes of text in a chunk, the unit in which texts ask for their words' predictions.
CHUNK_BYTES = 8 << 20
#: Training tokens that a part of the vocabulary stands for, on average.
PART_TOKENS = 2_000_000
#: Words that a counting task holds before it passes them on, and tokens that it counts at once.
HELD, COUNTED = 1 << 19, 1 << 20
#: Stirling numbers are tabled for counts up to NEAR and tables up to WIDE; others are integrated.
NEAR, WIDE = 4096, 96
#: Counts up to this use as much of the table as they have customers; larger ones its whole width.
EXACT = 48
#: Nodes of the integral, its scale against the count, and the points on which a wide draw is tabled.
NODES, SCALE, GRID = 60, 1.0, 4096
#: Weights worked out together.
AT_ONCE = 1 << 16
#: Points of a stretch at which a count's Stirling numbers are integrated; between them they are a polynomial.
POINTS, STRETCH = 24, 32.0
STRETCHES = 16  # 32 ** 16 is more than any count
REMEMBERED = 1 << 15
#: Log-weights this far below the mode's are left out, and the mass of a tail that may be.
FAR_BELOW, TAIL = 40.0, 1e-12
TOTALS_ROWS = 16
MOST_TASKS = 20_000
#: Tables next to which a dish's own don't count: its weights then grow by a constant factor with each of them.
VERY_MANY = 1e9
#: Rows that a round leaves: totals, asks after other parts' words, what is known of a part's own words, seatings.
TOTALS, ASK, KNOWN, SEATED = range(4)
ROWS = "slot long, source long, kind int, packed binary"


@dataclass(frozen=True)
class Plan:
    """share: of the training tokens that makes a word common. rounds: exchanges of totals before the samples are drawn.
    burn, samples: sweeps in a round. strength: of both levels; discounts start here and are estimated from the counts."""

    share: float = 1e-5
    rounds: int = 1
    burn: int = 2
    samples: int = 3
    strength: float = 1.0
    discount: float = 0.7
    modulus: int = 7
    residue: int = 2
    seed: int = 11


def tokens(text: str | None) -> list[bytes]:
    """A-Z lower-cased words between ASCII blanks, then the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of `tokens`, without the ends, of all texts one after another, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten().cast(pa.large_binary())
    filled = pc.not_equal(pc.binary_length(words), 0)
    ends = np.concatenate(([0], np.cumsum(filled.to_numpy(zero_copy_only=False))))[lists.offsets.to_numpy()]
    return words.filter(filled), np.diff(ends)


def binary(words: list[bytes] | pa.Array) -> pa.Array:
    return words if isinstance(words, pa.Array) else pa.array(words, pa.large_binary())


def joined(words: pa.Array, cuts: np.ndarray) -> list[bytes]:
    """The words between the cuts, each time in lines."""
    lists = pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), words)
    return pc.binary_join(lists, pa.scalar(b"\n", pa.large_binary())).to_pylist()


def lines(data: bytes) -> pa.Array:
    return pc.split_pattern(binary([data]), "\n").flatten()


def numbered(lists: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct words of all lists, ascending, and each list's places among them."""
    if not lists:
        return binary([]), []
    found = pa.concat_arrays(lists).dictionary_encode()
    order = pc.array_sort_indices(found.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return found.dictionary.take(order), np.split(place[found.indices.to_numpy()], np.cumsum([len(x) for x in lists])[:-1])


def number_of(words: pa.Array, numbers: dict[bytes, int]) -> np.ndarray:
    """The words' numbers, -1 for those that have none."""
    at = pc.fill_null(pc.index_in(words, binary([*numbers])), -1).to_numpy()
    return np.array([*numbers.values(), -1], np.int64)[at]


def pack(**arrays) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, protocol=5))


def narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on in the fewest bytes that hold them all."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def unpack(data: bytes) -> dict:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))  # noqa: S301  written by `pack` only


# --- seating -----------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4)  # a worker's parts of a round have the same two
def log_stirling(discount: float, most: int = NEAR) -> np.ndarray:
    """log S[c, t]: the ways, weighed by the discount, in which c customers share t tables; c up to `most`, t up to WIDE."""
    out = np.full((most + 1, WIDE + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, WIDE + 1)
    with np.errstate(divide="ignore"):
        for c in range(most):
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], np.log(np.maximum(c - discount * t, 0)) + out[c, 1:])
    out.flags.writeable = False
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0, by Stirling's series from x + 8 on."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3) * ((x + 4) * (x + 5) * (x + 6) * (x + 7)))


def log_stirling_at(count: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """The same at single points, for any count, by a contour integral; `tables` need not be whole.

    S(n, t) = n! / (t! * d ** t) * [x ** n] (1 - (1 - x) ** d) ** t. With x = 1 - s the coefficient is an integral of
    (1 - s ** d) ** t * (1 - s) ** -(n + 1) around the cut s <= 0, taken on a parabola through the saddle point; the nodes
    are spaced so that all scales are met.
    """
    n, t = (np.asarray(x, float).ravel()[:, None] for x in np.broadcast_arrays(count, tables))
    low, high = np.full(n.shape, -700.0), np.full(n.shape, -1e-12)  # the saddle's logarithm is between them
    ratio = np.log(t * discount) - np.log(n + 1)
    for _ in range(34):  # to 1e-7; the integral hardly depends on the place
        mid = (low + high) / 2
        above = ratio + (discount - 1) * mid + np.log1p(-np.exp(mid)) > np.log(-np.expm1(discount * mid))
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    mu = np.minimum(np.maximum(np.exp(low), SCALE / (n + 1)), 1 - 1e-9)
    u = np.linspace(0, 4.5, NODES)[None, :]
    width = 1 / np.sqrt(mu * (n + 1))
    z = 1 + 1j * width * np.sinh(u)
    a = t * np.log1p(-np.exp(discount * (np.log(mu) + 2 * np.log(z))))
    b = -(n + 1) * np.log1p(-mu * z * z)
    top = t * np.log1p(-(mu**discount)) - (n + 1) * np.log1p(-mu)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        # Where the contour isn't held by the saddle, the part that integrates to zero is taken out beforehand.
        free = (mu <= SCALE / (n + 1) * (1 + 1e-9))[:, 0]
        value = np.exp(np.where(free[:, None], b, a + b) - top)
        value[free] *= np.expm1(a[free])
        value *= 2 * mu * z * width * np.cosh(u)
        value[:, 0] *= 0.5
        total = np.log(value.sum(axis=1).real * (u[0, 1] - u[0, 0]) / np.pi)
        n, t = n[:, 0], t[:, 0]
        found = log_gamma(n + 1) - log_gamma(t + 1) - t * math.log(discount) + total + top[:, 0]
    # Next to as many tables as customers the integral has too little left; there, pairs of customers share tables.
    near = np.maximum(n - t, 0)
    pairs = near * np.log((1 - discount) * n * (n - 1) / 2) - log_gamma(near + 1)
    return np.where((near < 1e-9) | ~np.isfinite(found), pairs, found)


class Curves:
    """log S(count, t) of some counts: polynomials in log t, one for each stretch in which t grows by the factor STRETCH, of what
    is left once the ways to cut a row of `count` in t runs are taken off.

    A stretch's polynomial is made when it is first asked for; past REMEMBERED all are forgotten.
    """

    known: ClassVar[dict[tuple[float, float, int], np.ndarray]] = {}
    at: ClassVar[np.ndarray] = (np.cos(np.pi * (np.arange(POINTS) + 0.5) / POINTS) + 1) / 2

    def __init__(self, counts: np.ndarray, discount: float):
        self.counts, self.discount = counts.astype(float), discount
        self.tops = log_gamma(self.counts)
        #: Polynomials in columns, and the column of each dish's stretches; -1 where none was asked for.
        self.weights, self.column = np.empty((POINTS, 0)), np.full((len(counts), STRETCHES), -1, np.int32)
        k = np.arange(POINTS)
        self.basis = np.cos(np.pi * np.outer(k, k + 0.5) / POINTS) * (2 / POINTS)
        self.basis[0] *= 0.5

    def _learn(self, keys: list[tuple[float, float, int]]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for i in range(0, len(keys), 64):
            n = np.repeat(np.array([c for _, c, _ in keys[i : i + 64]]), POINTS)
            low = np.repeat(np.array([STRETCH**j for _, _, j in keys[i : i + 64]], float), POINTS)
            t = low * np.exp(np.tile(self.at, len(n) // POINTS) * np.log(np.minimum(STRETCH, n / low)))
            values = (log_stirling_at(n, t, self.discount) - self.runs(n, t)).reshape(-1, POINTS)
            self.known.update(zip(keys[i : i + 64], values @ self.basis.T, strict=True))

    @staticmethod
    def runs(n: np.ndarray, t: np.ndarray) -> np.ndarray:
        return log_gamma(n) - log_gamma(t) - log_gamma(np.maximum(n - t, 0) + 1)

    def __call__(self, dish: np.ndarray, t: np.ndarray) -> np.ndarray:
        n, t = np.broadcast_arrays(self.counts[dish], np.asarray(t, float))
        part = np.floor(np.log(t) / math.log(STRETCH) + 1e-12).astype(np.int64)
        part = np.where((part > 0) & (STRETCH ** part.astype(float) >= n), part - 1, part)
        if (missing := self.column[dish, part] < 0).any():
            codes = np.unique((np.broadcast_to(dish, t.shape) * STRETCHES + part)[missing])
            keys = [(self.discount, c, j) for c, j in zip(self.counts[codes // STRETCHES].tolist(), (codes % STRETCHES).tolist(), strict=True)]
            self._learn([k for k in dict.fromkeys(keys) if k not in self.known])
            self.column.ravel()[codes] = self.weights.shape[1] + np.arange(len(codes))
            self.weights = np.concatenate((self.weights, np.array([self.known[k] for k in keys]).T), axis=1)
        w, which = self.weights, self.column[dish, part]
        low = STRETCH ** part.astype(float)
        x = 2 * np.log(t / low) / np.log(np.minimum(STRETCH, n / low)) - 1
        after = last = np.zeros(len(t))
        for k in range(POINTS - 1, 0, -1):
            after, last = last, w[k][which] + 2 * x * last - after
        return w[0][which] + x * last - after + self.tops[dish] - log_gamma(t) - log_gamma(np.maximum(n - t, 0) + 1)


def seat(count: np.ndarray, prior: np.ndarray, others: np.ndarray, strength: float, discount: float, stirling: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish with `count` customers, drawn from their full conditional, whatever the count.

    `prior` is the parent's probability of the dish and `others` the tables of its restaurant. t tables weigh
    S(count, t) * prod(strength + discount * (others + j), j < t) * prior ** t, which is log-concave in t: past the table's
    width the weights fall at least as fast as at its end, and a dish goes by the integral unless that tail is below TAIL.
    """
    tables = np.minimum(count, 1)
    alike = len(others) > 0 and others.min() == others.max()
    rest = [np.flatnonzero(count > NEAR)]
    few = np.flatnonzero((count > 1) & (count <= EXACT))
    few = few[ordered(count[few])]
    ends = np.searchsorted(count[few], np.arange(2, EXACT + 2))
    groups = [(c, few[a:b]) for c, a, b in zip(range(2, EXACT + 1), ends, ends[1:], strict=False) if a < b]
    for c, own in [*groups, (WIDE, np.flatnonzero((count > EXACT) & (count <= NEAR)))]:
        t = np.arange(c)
        for at in range(0, len(own), 1 << 14):
            some = own[at : at + (1 << 14)]
            grow = np.log(strength + discount * (others[some[:1] if alike else some, None] + t))
            weight = np.cumsum(grow, axis=1) + np.log(prior[some, None]) * (t + 1) + stirling[count[some], 1 : c + 1]
            weight = np.exp(weight - weight.max(axis=1, keepdims=True))
            if c == WIDE:
                ends = np.maximum(weight[:, -1], 1e-300) / np.maximum(weight[:, -2], 1e-300)
                short = (count[some] > WIDE) & ((ends >= 1) | (weight[:, -1] * ends / np.maximum(1 - ends, 1e-300) > TAIL))
                rest.append(some[short])
            weight = np.cumsum(weight, axis=1)
            tables[some] = 1 + (weight < rng.random((len(some), 1)) * weight[:, -1:]).sum(axis=1)
    far = np.concatenate(rest)
    if len(far):
        curves = Curves(count[far], discount)
        tables[far] = _seat_far(count[far], prior[far], others[far], curves, strength, discount, rng)
    return tables


def _seat_far(count: np.ndarray, prior: np.ndarray, others: np.ndarray, curves: Curves, strength: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Draws from the same conditional with integrated Stirling numbers: the mode by bisection, then all weights that matter.

    Where these are more than GRID, their logarithm is interpolated between GRID points, smooth as it is.
    """
    base = (strength + discount * others) / discount
    gamma, slope = log_gamma(base), math.log(discount) + np.log(prior)

    def weigh(dish, t: np.ndarray) -> np.ndarray:
        return curves(dish, t) + log_gamma(base[dish] + t) - gamma[dish] + t * slope[dish]

    every = np.arange(len(count))
    low, high = np.ones(len(count), np.int64), count.astype(np.int64)
    while (on := every[low < high]).size:
        mid = (low[on] + high[on]) // 2
        after, here = np.split(weigh(np.tile(on, 2), np.concatenate((mid + 1, mid))), 2)
        up = after > here
        low[on], high[on] = np.where(up, mid + 1, low[on]), np.where(up, high[on], mid)
    mode, best = low, weigh(every, low)
    ends = []
    for side, limit in ((-1, np.ones(len(count), np.int64)), (1, count.astype(np.int64))):
        end, step = mode.copy(), np.ones(len(count), np.int64)
        on = every[end != limit]
        while on.size:
            end[on] = np.clip(mode[on] + side * step[on], 1, count[on])
            step[on] *= 2
            on = on[(end[on] != limit[on]) & (weigh(on, end[on]) > best[on] - FAR_BELOW)]
        ends.append(end)
    out = np.empty(len(count), np.int64)
    low, high = ends
    sizes = high - low + 1
    for i in np.flatnonzero(sizes > GRID):
        t = np.arange(low[i], high[i] + 1)
        points = np.unique(np.linspace(low[i], high[i], GRID).astype(np.int64))
        weight = np.cumsum(np.exp(np.interp(t, points, weigh(np.full(len(points), i), points) - best[i])))
        out[i] = t[np.searchsorted(weight, rng.random() * weight[-1], side="right").clip(0, len(t) - 1)]
    few = np.flatnonzero(sizes <= GRID)
    for own in np.split(few, np.flatnonzero(np.diff(np.cumsum(sizes[few]) // AT_ONCE)) + 1):
        # All dishes' weights in one row; a draw is a place in its dish's stretch of their running sum.
        dish, starts = np.repeat(own, sizes[own]), np.cumsum(sizes[own]) - sizes[own]
        t = np.arange(len(dish)) - np.repeat(starts, sizes[own]) + low[dish]
        total = np.concatenate(([0.0], np.cumsum(np.exp(weigh(dish, t) - best[dish]))))
        first, last = total[starts], total[starts + sizes[own]]
        at = np.searchsorted(total, first + rng.random(len(own)) * (last - first), side="right") - 1
        out[own] = low[own] + np.clip(at - starts, 0, sizes[own] - 1)
    return out


@dataclass
class Totals:
    """What parts of the vocabulary share: per sample the tables of each common context, the root's customers and tables; counts
    of dishes with one and two customers on both levels; of the common words in the root, per sample, customers, tables, and
    the customers that come from the contexts of other words. `rest` is a first guess of another word's chance."""

    contexts: np.ndarray  # samples x contexts
    customers: np.ndarray  # samples
    tables: np.ndarray  # samples
    ones: np.ndarray  # contexts' ones and twos, the root's ones and twos
    common: np.ndarray | None = None  # 3 x samples x contexts
    rest: float = 1e-3

    def flat(self) -> np.ndarray:
        return np.concatenate((self.contexts.ravel(), self.common.ravel(), self.customers, self.tables, self.ones)).astype(np.int64)

    @staticmethod
    def of(flat: np.ndarray, contexts: int) -> Totals:
        n = (len(flat) - 4) // (4 * contexts + 2)
        own, common, rest = np.split(flat.astype(float), (n * contexts, 4 * n * contexts))
        return Totals(own.reshape(n, contexts), rest[:n], rest[n:-4], rest[-4:], common.reshape(3, n, contexts))

    def discounts(self, least: float = 0.1, most: float = 0.85) -> tuple[float, float]:
        """Of contexts and root, by the ratio of dishes with one customer to those with one or two."""
        a, b, c, d = self.ones
        return tuple(min(most, max(least, x / (x + 2 * y))) if x + y else 0.7 for x, y in ((a, b), (c, d)))


@dataclass
class Seats:
    """A sample: tables of each pair, customers and tables of each word in the root, tables of each hosted pair."""

    tables: np.ndarray
    diners: np.ndarray
    standing: np.ndarray
    hosted: np.ndarray

    def __iter__(self) -> Iterator[np.ndarray]:
        return iter((self.tables, self.diners, self.standing))


@dataclass
class Met:
    """What a part is told by others, each per sample: customers that its own rare words get from other words' contexts, and
    customers and tables in the root of the rare words that it hosts."""

    guests: np.ndarray
    diners: np.ndarray
    standing: np.ndarray


class Part:
    """One part of the vocabulary: all its words' counts in training, the dishes of its rare words' contexts, and which chunk
    asked for what.

    A pair is a word of the part in a common context. A hosted pair is a dish in the context of a rare word of the part; the
    dish is a common word's number, or `contexts` and the place of a rare word, of whatever part, in `others`.
    """

    def __init__(self, asked: list[tuple[int, dict]], contexts: int, numbers: dict[bytes, int] | None = None, parts: int = 1):
        names, self.words = numbered([lines(x["words"]) for _, x in asked])
        self.chunks = [c for c, _ in asked]
        every = np.concatenate(self.words) if asked else np.zeros(0, np.int64)

        def added(place: np.ndarray, name: str, size: int) -> np.ndarray:
            return np.bincount(place, np.concatenate([x[name] for _, x in asked]) if asked else None, size).astype(np.int64)

        self.count, self.alone = added(every, "count", len(names)), added(every, "alone", len(names))
        keys = [w[np.cumsum(x["steps"], dtype=np.int64)] * contexts + x["context"] for w, (_, x) in zip(self.words, asked, strict=True)]
        pairs, self.place = distinct(np.concatenate(keys) if keys else np.zeros(0, np.int64))
        self.sizes = [len(k) for k in keys]
        self.pairs = added(self.place, "pairs", len(pairs))
        self.word, self.context = pairs // max(1, contexts), pairs % max(1, contexts)
        self.contexts = contexts

        self.other_names, places = numbered([lines(x["others"]) if x["others"] else binary([]) for _, x in asked])
        width, keys = contexts + len(self.other_names), []
        for own, w, (_, x) in zip(places, self.words, asked, strict=True):
            dish = np.cumsum(x["dishes"], dtype=np.int64)
            rare = dish >= contexts
            dish[rare] = contexts + own[dish[rare] - contexts]
            keys.append(w[x["hosts"]] * width + dish)
        pairs, self.hosted_place = distinct(np.concatenate(keys) if keys else np.zeros(0, np.int64))
        self.hosted_sizes = [len(k) for k in keys]
        self.hosted = added(self.hosted_place, "hosted", len(pairs))
        self.host, self.dish = pairs // max(1, width), pairs % max(1, width)

        numbers = numbers or {}
        number = number_of(names, numbers)
        if len(names) and names[0].as_py() == END and numbers:
            number[0] = START
        self.common = np.flatnonzero(number >= 0)
        self.number = number[self.common]
        self.rare = np.flatnonzero((number < 0) & (self.count > 0))  # no training, no customers
        self.names = names
        self.parts = parts

    @property
    def others(self) -> list[bytes]:
        return self.other_names.to_pylist()

    @property
    def rare_names(self) -> list[bytes]:
        return self.names.take(pa.array(self.rare)).to_pylist()

    @cached_property
    def most(self) -> np.ndarray:
        """The most customers that each rare dish has in one context here; the chance of those with several is wanted."""
        on = self.dish >= self.contexts
        dish, hosted = self.dish[on] - self.contexts, self.hosted[on]
        size = len(self.other_names)
        return np.where(np.bincount(dish, hosted > 1, size) > 0, 2, np.bincount(dish, hosted > 0, size) > 0)

    @cached_property
    def asks(self) -> list[tuple[int, np.ndarray]]:
        """Rare dishes with customers, by the part that owns them."""
        asks = np.flatnonzero(self.most > 0)
        order, cuts = by_part(part_of(self.other_names.take(pa.array(asks)), self.parts), self.parts)
        return [(p, asks[order[cuts[p] : cuts[p + 1]]]) for p in np.flatnonzero(np.diff(cuts)).tolist()]

    def _diners(self, tables: np.ndarray, shared: Totals, met: Met | None, s: int) -> np.ndarray:
        """Each word's customers in the root: its tables in common contexts, and those in the contexts of rare words."""
        own = np.bincount(self.word, tables, len(self.count)).astype(np.int64)
        if met is None:
            return own + np.ceil(self.alone**0.8).astype(np.int64)
        own[self.common] += shared.common[2][s][self.number].astype(np.int64)
        own[self.rare] += met.guests[s]
        return own

    def _chances(self, dishes: np.ndarray, shared: Totals, met: Met | None, s: int, vocabulary: int, plan: Plan, discount: float) -> np.ndarray:
        """The root's probability of dishes of hosted pairs, as of the round before."""
        if shared.common is None:
            return np.full(len(dishes), shared.rest)
        diners, standing = shared.common[0][s], shared.common[1][s]
        if met is not None:
            diners, standing = np.concatenate((diners, met.diners[s])), np.concatenate((standing, met.standing[s]))
        common = dishes < len(diners)
        at = np.where(common, dishes, 0)
        return np.where(common, root_chance(diners[at], standing[at], shared.customers[s], shared.tables[s], vocabulary, plan.strength, discount), shared.rest)

    def sample(self, shared: Totals, vocabulary: int, plan: Plan, seed: list[int], met: Met | None = None) -> Iterator[Seats]:
        """Seatings, `samples` times after `burn` sweeps. Without `met` the other parts' share is guessed."""
        rng = np.random.default_rng(seed)
        low, high = shared.discounts() if shared.ones.any() else (plan.discount,) * 2
        inner, outer = log_stirling(low), log_stirling(high)
        tables, hosted = np.minimum(self.pairs, 1), np.minimum(self.hosted, 1)
        several = np.flatnonzero(self.hosted > 1)
        hosts, at = np.unique(self.host[several], return_inverse=True)
        for turn in range(plan.burn + plan.samples):
            s = turn % len(shared.customers)
            others, customers, root = shared.contexts[s], shared.customers[s], shared.tables[s]
            diners = self._diners(tables, shared, met, s)
            standing = seat(diners, np.full(len(diners), 1 / (vocabulary + 1)), np.full(len(diners), root), plan.strength, high, outer, rng)
            prior = root_chance(diners, standing, customers, root, vocabulary, plan.strength, high)
            tables = seat(self.pairs, prior[self.word], others[self.context], plan.strength, low, inner, rng)
            if len(several):
                # Given x ~ Gamma(strength / low + all tables of the context), t tables weigh S(count, t) * (low * x * prior) ** t.
                x = rng.gamma(plan.strength / low + np.bincount(self.host, hosted, len(self.count))[hosts])
                chance = self._chances(self.dish[several], shared, met, s, vocabulary, plan, high)
                hosted = hosted.copy()
                hosted[several] = seat(self.hosted[several], x[at] * chance / VERY_MANY, np.full(len(several), VERY_MANY), plan.strength, low, inner, rng)
            if turn >= plan.burn:
                diners = self._diners(tables, shared, met, s)
                standing = seat(diners, np.full(len(diners), 1 / (vocabulary + 1)), np.full(len(diners), root), plan.strength, high, outer, rng)
                yield Seats(tables, diners, standing, hosted)

    def totals(self, states) -> Totals:
        states = [*states]
        both = [np.bincount(self.context, x.tables, self.contexts) for x in states]
        ones = [((self.pairs == k).sum() + (self.hosted == k).sum()) for k in (1, 2)] + [sum(int((x.diners == k).sum()) for x in states) for k in (1, 2)]
        common = np.zeros((3, len(states), self.contexts))
        known = self.dish < self.contexts
        for s, x in enumerate(states):
            common[0, s, self.number], common[1, s, self.number] = x.diners[self.common], x.standing[self.common]
            common[2, s] = np.bincount(self.dish[known], x.hosted[known], self.contexts)
        sums = [np.array([y.sum() for y in z], float) for z in ([x.diners for x in states], [x.standing for x in states])]
        return Totals(np.array(both), *sums, np.array(ones, float), common)

    def messages(self, states: list[Seats], number: int) -> Iterator[tuple[int, int, int, bytes]]:
        """For other parts: the tables at which rare words of theirs are served here. For those who ask: the own rare words."""
        rare = self.dish >= self.contexts
        served = np.array([np.bincount(self.dish[rare] - self.contexts, x.hosted[rare], len(self.other_names)) for x in states]).astype(np.int64)
        cuts = np.cumsum([0, *(len(own) for _, own in self.asks)])
        names = joined(self.other_names.take(pa.array(np.concatenate([own for _, own in self.asks]))), cuts) if self.asks else []
        for (p, own), words in zip(self.asks, names, strict=True):
            yield p, number, ASK, pack(words=words, wanted=self.most[own] > 1, served=narrow(served[:, own]))
        if len(self.rare):
            diners, standing = (narrow(np.array([y[self.rare] for y in z])) for z in ([x.diners for x in states], [x.standing for x in states]))
            yield number, number, KNOWN, pack(words=joined(self.names.take(pa.array(self.rare)), np.array([0, len(self.rare)]))[0], diners=diners, standing=standing)

    def met(self, answers: list[tuple[int, dict]], number: int, samples: int) -> Met:
        """From the rows of `meet`."""
        got = dict(answers)
        guests = got[-1]["guests"].astype(np.int64) if -1 in got else np.zeros((samples, len(self.rare)), np.int64)
        diners, standing = (np.zeros((samples, len(self.other_names))) for _ in range(2))
        for p, own in self.asks:
            if p in got:
                own = own[self.most[own] > 1]
                diners[:, own], standing[:, own] = got[p]["diners"], got[p]["standing"]
        return Met(guests, diners, standing)

    def seated(self, states: list[Seats]) -> bytes:
        """What the predictions need of the samples."""
        return pack(
            tables=narrow(sum(x.tables for x in states)), hosted=narrow(sum(x.hosted for x in states)),
            diners=narrow(np.array([x.diners for x in states])), standing=narrow(np.array([x.standing for x in states])),
            held=narrow(np.array([np.bincount(self.host, x.hosted, len(self.count)) for x in states]).astype(np.int64)),
        )

    def answers(self, seated: dict) -> Iterator[tuple[int, bytes]]:
        """For each chunk, of its words: count, customers and tables in the root and tables of the own context, per sample; of
        its pairs and hosted pairs: customers and tables, the latter over all samples."""
        a = b = 0
        for chunk, own, size, more in zip(self.chunks, self.words, self.sizes, self.hosted_sizes, strict=True):
            near, far = self.place[a : a + size], self.hosted_place[b : b + more]
            a, b = a + size, b + more
            yield chunk, pack(
                count=narrow(self.count[own]), **{name: narrow(seated[name][:, own]) for name in ("diners", "standing", "held")},
                pairs=narrow(np.concatenate((self.pairs[near], self.hosted[far]))), tables=narrow(np.concatenate((seated["tables"][near], seated["hosted"][far]))),
            )


def meet(asks: list[tuple[int, dict]], known: dict) -> Iterator[tuple[int, dict]]:
    """A part's rare words meet those who ask after them: (-1, the customers that the words get from all who ask), and for each
    who asks the customers and tables of the words that it wants."""
    names, lists = lines(known["words"]), [lines(x["words"]) for _, x in asks]
    guests = np.zeros((len(known["diners"]), len(names)), np.int64)
    every = pc.index_in(pa.concat_arrays(lists), names).to_numpy() if lists else np.zeros(0, np.int64)
    for (source, x), at in zip(asks, np.split(every, np.cumsum([len(own) for own in lists])[:-1]), strict=False):
        guests[:, at] += x["served"]
        at = at[x["wanted"]]
        yield source, {"diners": known["diners"][:, at], "standing": known["standing"][:, at]}
    yield -1, {"guests": narrow(guests)}


def root_chance(diners, standing, customers: float, tables: float, vocabulary: int, strength: float, discount: float) -> np.ndarray:
    """The root's probability of each word: uniform over the vocabulary and one unknown word where nothing is known."""
    return (diners - discount * standing + (strength + discount * tables) / (vocabulary + 1)) / (strength + customers)


# --- chunks ------------------------------------------------------------------------------------------------------------------


@dataclass
class Chunk:
    """Texts as numbers of their distinct words (sorted), one text after another."""

    words: list[bytes] | pa.Array
    stream: np.ndarray
    lengths: np.ndarray
    held: np.ndarray

    def pairs(self, number: np.ndarray, common: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (word, context) keys, sorted, and each token's place among them. A context is a common word's number, or
        past these the number in the chunk of another word."""
        n = len(self.words)
        of_word = np.where(number < 0, common + np.arange(n), number)
        before = np.concatenate(([START], of_word[self.stream[:-1]])) if len(self.stream) else np.zeros(0, np.int64)
        begins = np.concatenate(([0], np.cumsum(self.lengths)[:-1])).astype(np.int64) if len(self.lengths) else np.zeros(0, np.int64)
        before[begins] = START
        return distinct(self.stream.astype(np.int64) * (common + n) + before)

    def parts(self, parts: int) -> np.ndarray:
        """The part of the vocabulary that each word belongs to."""
        return part_of(binary(self.words), parts)


def part_of(words: pa.Array, parts: int) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh64_intdigest, words.to_numpy(zero_copy_only=False), repeat(7)), np.uint64, len(words)) % np.uint64(parts)).astype(np.int64)


def ordered(values: np.ndarray) -> np.ndarray:
    """The stable order of whole numbers from 0 on, 16 bits at a time: each pass is a counting sort."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    most, shift = int(values.max(initial=0)) >> 16, 16
    while most:
        order = order[np.argsort((values[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        most, shift = most >> 16, shift + 16
    return order


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, ascending, and each one's place among them."""
    order = ordered(values)
    found = values[order]
    new = np.concatenate(([True], found[1:] != found[:-1])) if len(found) else np.zeros(0, bool)
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(new) - 1
    return found[new], place


def by_part(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their parts, and where each part begins and ends there."""
    order = ordered(part.astype(np.int64))
    return order, np.concatenate(([0], np.cumsum(np.bincount(part.astype(np.int64), minlength=parts))))


class Dealt:
    """A chunk's words and pairs by the part that they go to: pairs in common contexts to the word's, others to the context's."""

    def __init__(self, chunk: Chunk, contexts: dict[bytes, int], parts: int):
        words = binary(chunk.words)
        self.common, n = len(contexts) + 1, len(words)
        self.number = number_of(words, contexts)
        self.keys, self.place = chunk.pairs(self.number, self.common)
        self.word, self.context = self.keys // (self.common + n), self.keys % (self.common + n)
        if n and words[0].as_py() == END:
            self.number[0] = START
        self.part = chunk.parts(parts)
        far = self.context >= self.common
        target = self.part[np.where(far, self.context - self.common, self.word)]
        kind = np.where(far, np.where(self.number[self.word] < 0, 2, 1), 0)
        (self.by_word, self.word_cuts), (self.by_pair, self.pair_cuts) = by_part(self.part, parts), by_part(target * 3 + kind, 3 * parts)

    def words_of(self, p: int) -> np.ndarray:
        return self.by_word[self.word_cuts[p] : self.word_cuts[p + 1]]

    def pairs_of(self, p: int) -> list[np.ndarray]:
        """In common contexts; in others: of common words, of rare words."""
        return [self.by_pair[self.pair_cuts[i] : self.pair_cuts[i + 1]] for i in range(3 * p, 3 * p + 3)]


def requests(chunk: Chunk, contexts: dict[bytes, int], parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, what the chunk counts and asks there): words, their training counts, those in rare words' contexts, pairs, and the
    pairs in the contexts of the part's rare words."""
    dealt = Dealt(chunk, contexts, parts)
    train = np.repeat(~chunk.held, chunk.lengths)
    n, word, context, common = len(chunk.words), dealt.word, dealt.context, dealt.common
    count = np.bincount(chunk.stream[train], minlength=n)
    seen = np.bincount(dealt.place[train], minlength=len(dealt.keys))
    far = context >= common
    alone = np.bincount(word[far], seen[far], n).astype(np.int64)
    names = binary(chunk.words)
    words = joined(names.take(pa.array(dealt.by_word)), dealt.word_cuts)
    rank = np.empty(n, np.int64)
    rank[dealt.by_word] = np.arange(n) - np.repeat(dealt.word_cuts[:-1], np.diff(dealt.word_cuts))
    for p in np.unique(dealt.part).tolist():
        own, (near, known, rare) = dealt.words_of(p), dealt.pairs_of(p)
        others, at = distinct(word[rare])
        dishes, hosted = np.concatenate((dealt.number[word[known]], common + at)), np.concatenate((known, rare))
        yield p, pack(
            words=words[p], count=narrow(count[own]), alone=narrow(alone[own]),
            steps=narrow(np.diff(rank[word[near]], prepend=0)), context=narrow(context[near]), pairs=narrow(seen[near]),
            others=joined(names.take(pa.array(others)), np.array([0, len(others)]))[0], dishes=narrow(np.diff(dishes, prepend=0)), hosts=narrow(rank[context[hosted] - common]), hosted=narrow(seen[hosted]),
        )


def log_scores(
    chunk: Chunk, contexts: dict[bytes, int], parts: int, answers: dict[int, dict], train_tokens: int, vocabulary: int,
    totals: Totals, seen: np.ndarray, plan: Plan, discounts: tuple[float, float],
):
    """Per text: tokens, known tokens, base score and the model's score, by the samples' averaged predictive probabilities.

    `seen` are the common contexts' customers; those of another word's context are its own count. A context without any leaves
    the word to the root. The samples' own totals make the probabilities add up to 1.
    """
    low, high = discounts
    dealt, n, samples = Dealt(chunk, contexts, parts), len(chunk.words), len(totals.customers)
    count, root, held = np.zeros(n), np.zeros((samples, n)), np.zeros((samples, n))
    customers, tables = np.zeros(len(dealt.keys)), np.zeros(len(dealt.keys))
    for p, x in answers.items():
        own, pairs = dealt.words_of(p), np.concatenate(dealt.pairs_of(p))
        count[own], held[:, own] = x["count"], x["held"]
        for s in range(samples):
            root[s, own] = root_chance(x["diners"][s].astype(float), x["standing"][s], totals.customers[s], totals.tables[s], vocabulary, plan.strength, high)
        customers[pairs], tables[pairs] = x["pairs"], x["tables"]
    chance = samples * customers - low * tables
    for s in range(samples):
        chance += (plan.strength + low * np.concatenate((totals.contexts[s], held[s])))[dealt.context] * root[s][dealt.word]
    own = np.log10(chance / (samples * (plan.strength + np.concatenate((seen, count))[dealt.context])))[dealt.place]
    base = np.log10((count + 1) / (train_tokens + vocabulary + 1))[chunk.stream]
    known = (count > 0)[chunk.stream]
    begins = np.concatenate(([0], np.cumsum(chunk.lengths)[:-1])).astype(np.int64)
    return chunk.lengths, np.add.reduceat(known.astype(np.int64), begins), np.add.reduceat(base, begins), np.add.reduceat(own, begins)


def word_counts(rows: DataFrame) -> DataFrame:
    """word (binary; the end is empty), n: over the rows' texts, counted in the tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, numbers, waiting, texts, size = binary([]), np.zeros(0, np.int64), [], 0, 0

        def add() -> None:
            nonlocal words, numbers, waiting, size
            found = pa.concat_arrays([words, *waiting]).dictionary_encode()
            at = found.indices.to_numpy()
            numbers = np.bincount(at[len(words) :], minlength=len(found.dictionary)) + np.bincount(at[: len(words)], numbers, len(found.dictionary)).astype(np.int64)
            words, waiting, size = found.dictionary, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.array(numbers, pa.int64())], ["word", "n"])

        for batch in sliced(batches):
            own, lengths = split(batch.column(0))
            waiting.append(own)
            texts, size = texts + len(lengths), size + len(own)
            if size >= COUNTED:
                add()
                if len(words) > HELD:
                    yield out()
                    words, numbers = binary([]), numbers[:0]
        add()
        yield out()
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([texts], pa.int64())], ["word", "n"])

    return rows.select("text").mapInArrow(count, "word binary, n long").where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


def chunked(rows: DataFrame, contexts: dict[bytes, int], parts: int) -> DataFrame:
    """slot, chunk, keys, packed: each chunk's texts (slot -1 - chunk) and its requests to the parts (slot: the part)."""
    schema = T.StructType([
        T.StructField("slot", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("keys", T.ArrayType(rows.schema["key"].dataType)),
        T.StructField("packed", T.BinaryType()),
    ])
    kind = pa.list_(to_arrow_type(rows.schema["key"].dataType))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        keys, words, lengths, held, size = [], [], [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            names, (found,) = numbered([pa.concat_arrays(words)])
            names, sizes = pa.concat_arrays([binary([END]), names]), np.concatenate(lengths)
            stream = np.zeros(len(found) + len(sizes), np.int32)  # the end, where no word is
            stream[np.arange(len(found)) + np.repeat(np.arange(len(sizes)), sizes)] = found + 1
            chunk = Chunk(names, stream, sizes + 1, np.concatenate(held))
            rest = [*requests(chunk, contexts, parts)]
            own = pack(words=joined(names, np.array([0, len(names)]))[0], stream=narrow(chunk.stream), lengths=narrow(chunk.lengths), held=chunk.held)
            yield pa.RecordBatch.from_arrays([pa.array([-1 - number], pa.int64()), pa.array([number], pa.int64()), pa.ListArray.from_arrays([0, len(sizes)], pa.concat_arrays(keys)).cast(kind), pa.array([own], pa.binary())], schema.names)
            for at in range(0, len(rest), 32):
                some = rest[at : at + 32]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.int64()), pa.array([number] * len(some), pa.int64()), pa.array([None] * len(some), kind), pa.array([x for _, x in some], pa.binary())], schema.names)

        for batch in sliced(batches):
            own, sizes = split(batch.column(1))
            ends, at = np.cumsum(sizes), 0
            while at < len(sizes):
                # The texts up to the one that fills the chunk.
                room = np.cumsum(sizes[at:] + 1) * 6 + size
                end = min(at + int(np.searchsorted(room, CHUNK_BYTES)) + 1, len(sizes))
                words.append(own.slice(ends[at] - sizes[at], ends[end - 1] - ends[at] + sizes[at]))
                lengths.append(sizes[at:end])
                keys.append(batch.column(0).slice(at, end - at))
                held.append(batch.column(2).slice(at, end - at).to_numpy(zero_copy_only=False).astype(bool))
                size, at = int(room[end - at - 1]), end
                if size >= CHUNK_BYTES:
                    yield from out()
                    number += 1
                    keys, words, lengths, held, size = [], [], [], [], 0
        if keys:
            yield from out()

    return rows.select("key", "text", "held").mapInArrow(build, schema)


def score(docs: DataFrame, plan: Plan = Plan(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; see the module for the model.

    Rows whose crc32 of the key as text leaves `plan.residue` are held out; the others train. Texts are turned into chunks of
    word numbers; a chunk sends its counts and questions to parts of the vocabulary, the parts sample the seating and send back
    the seatings of what was asked. Only the common words (at most 1 / share) and totals per common word pass through the
    driver; rare words that are served in other rare words' contexts meet these by a shuffle between rounds. base_score is the add-one unigram score of the same tokens.

    Null texts count as empty: one token, the end. A null key counts as the text "" and trains. Repeated rows count each time.
    Without training rows all words are unknown and the model is uniform; an empty table gives an empty result.
    """
    rows = pick(docs, key, text).toDF("key", "text")
    crc = F.crc32(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary"))
    rows = rows.withColumn("held", F.pmod(crc, F.lit(plan.modulus)) == plan.residue)
    counts = cut_lineage(word_counts(rows.where("not held")))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    common = counts.where((F.col("n") >= F.greatest(F.lit(2.0), F.lit(n * plan.share))) & (F.octet_length("word") > 0)).collect()
    common = sorted((bytes(r["word"]), r["n"]) for r in common)  # at most 1 / share
    contexts = {w: i + 1 for i, (w, _) in enumerate(common)}
    starts = counts.where(F.octet_length("word") == 0).first()
    seen = np.array([starts["n"] if starts else 0, *(c for _, c in common)], float)
    parts = max(1, -(-n // PART_TOKENS))
    # Dealt to the parts once and stored: the rounds then shuffle what the parts tell each other only.
    stored = _stored(chunked(rows, contexts, parts).repartition(min(parts, MOST_TASKS), "slot").sortWithinPartitions("slot", "chunk"))
    asked, texts = stored.where("slot >= 0").select("slot", "chunk", "packed"), stored.where("slot < 0")

    first = np.ceil(np.minimum(seen, np.maximum(1.0, seen**0.8)))
    rare = max(0.0, n - seen.sum())
    guess = np.array([first, np.minimum(first, 1), np.zeros(len(seen))])[:, None]
    shared = Totals(first[None, :], np.array([first.sum() + n / 2]), np.array([float(v)]), np.zeros(4), guess, max(1.0, rare) / max(1, n) / max(1, v - len(seen)))
    made = None
    for turn in range(plan.rounds + 1):
        told = None if made is None else _told(made)
        made = cut_lineage(_round(asked, told, shared, contexts, parts, v, plan, turn))
        shared, before = _totals(made, len(seen), plan), shared
    discounts = before.discounts() if before.ones.any() else (plan.discount,) * 2

    def gather(requests: pa.Table, seated: pa.Table) -> pa.Table:
        number, part = _part(requests, contexts, parts)
        chunk, packed = zip(*part.answers(unpack(seated.column("packed")[0].as_py())), strict=True)
        return pa.table([pa.array([-1 - c for c in chunk], pa.int64()), pa.array([number] * len(chunk), pa.int32()), pa.array(packed, pa.binary())], ["slot", "part", "packed"])

    answered = asked.groupBy("slot").cogroup(made.where(F.col("kind") == SEATED).groupBy("slot")).applyInArrow(gather, "slot long, part int, packed binary")
    schema = T.StructType([
        rows.schema["key"], T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])

    def finish(own: pa.Table, answers: pa.Table) -> pa.Table:
        x = unpack(own.column("packed")[0].as_py())
        chunk = Chunk(lines(x["words"]), x["stream"].astype(np.int32), x["lengths"].astype(np.int64), x["held"])
        got = {p: unpack(a) for p, a in zip(answers.column("part").to_pylist(), answers.column("packed").to_pylist(), strict=True)}
        lengths, known, base, found = log_scores(chunk, contexts, parts, got, n, v, shared, seen, plan, discounts)
        keys = own.column("keys").combine_chunks().flatten()
        return pa.table([keys, pa.array(chunk.held), pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), n)), pa.array(base), pa.array(found)], names=schema.names)

    return texts.select("slot", "keys", "packed").groupBy("slot").cogroup(answered.groupBy("slot")).applyInArrow(finish, schema).withColumnRenamed("key", key)


def _stored(dealt: DataFrame) -> DataFrame:
    """`cut_lineage` of dealt rows that is known to be dealt: a checkpoint of an adaptive plan forgets it."""
    conf, name = dealt.sparkSession.conf, "spark.sql.adaptive.enabled"
    adaptive = conf.get(name)
    conf.set(name, "false")
    try:
        return cut_lineage(dealt.select("*"))
    finally:
        conf.set(name, adaptive)


def _part(requests: pa.Table, contexts: dict[bytes, int], parts: int) -> tuple[int, Part]:
    """The part of a slot's rows, which may come in any order."""
    rows = sorted(zip(requests.column("chunk").to_pylist(), requests.column("packed").to_pylist(), strict=True))
    return requests.column("slot")[0].as_py(), Part([(chunk, unpack(packed)) for chunk, packed in rows], len(contexts) + 1, contexts, parts)


def _made(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["slot", "source", "kind", "packed"])


def _round(asked: DataFrame, told: DataFrame | None, shared: Totals, contexts: dict[bytes, int], parts: int, vocabulary: int, plan: Plan, turn: int) -> DataFrame:
    """Every part sweeps with the totals it is given: their own totals, and messages or, after the last round, the seatings."""

    def sweep(requests: pa.Table, answers: pa.Table | None = None) -> pa.Table:
        number, part = _part(requests, contexts, parts)
        met = None
        if answers is not None:
            got = zip(answers.column("source").to_pylist(), answers.column("packed").to_pylist(), strict=True)
            met = part.met([(source, unpack(x)) for source, x in got], number, len(shared.customers))
        states = [*part.sample(shared, vocabulary, plan, [plan.seed, turn, number], met)]
        out = [(number % TOTALS_ROWS, number, TOTALS, pack(totals=narrow(part.totals(states).flat())))]
        if turn < plan.rounds:
            out += part.messages(states, number)
        else:
            out.append((number, number, SEATED, part.seated(states)))
        return _made(out)

    if told is None:
        return asked.groupBy("slot").applyInArrow(lambda requests: sweep(requests), ROWS)
    return asked.groupBy("slot").cogroup(told.groupBy("slot")).applyInArrow(lambda requests, answers: sweep(requests, answers), ROWS)


def _told(made: DataFrame) -> DataFrame:
    """What the parts are told of the round before, see `meet`."""

    def run(rows: pa.Table) -> pa.Table:
        got = [*zip(*(rows.column(name).to_pylist() for name in ("slot", "source", "kind", "packed")), strict=True)]
        number, asks = got[0][0], [(p, unpack(x)) for _, p, kind, x in got if kind == ASK]
        return _made([(number if p < 0 else p, p if p < 0 else number, KNOWN, pack(**x)) for *_, kind, own in got if kind == KNOWN for p, x in meet(asks, unpack(own))])

    return made.where(F.col("kind").isin(ASK, KNOWN)).groupBy("slot").applyInArrow(run, ROWS)


def _totals(made: DataFrame, contexts: int, plan: Plan) -> Totals:
    """The parts' totals, added up in tasks, then by the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = unpack(data.as_py())["totals"].astype(np.int64)
                sums[slot] = sums[slot] + own if slot in sums else own
        yield pa.RecordBatch.from_arrays([pa.array([pack(totals=x) for x in sums.values()], pa.binary())], ["totals"])

    found = made.where(F.col("kind") == TOTALS).select("slot", "packed").repartition(TOTALS_ROWS, "slot").mapInArrow(add, "totals binary").collect()
    # All are whole numbers, so that sums, and with them reruns, agree whatever their order.
    flat = sum((unpack(bytes(r["totals"]))["totals"] for r in found), np.zeros(plan.samples * (4 * contexts + 2) + 4, np.int64))
    return Totals.of(flat, contexts)
