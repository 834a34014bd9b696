"""Byte-level BPE encoding and decoding (operator 3): ranked merges folded over the bytes of distinct words."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import pick, sliced

#: The rank map is a literal array of small maps, found by hash: one map's keys would be searched one after another.
BUCKETS = 1 << 14
#: Words of a generation. A Python worker remembers two: when the young one is full, the old one's words that were not met
#: again are forgotten, and folded anew if they come back. A word takes about 0.2 KB; workers keep theirs for later tasks.
REMEMBERED = 3 << 15
#: Characters of texts whose words are learnt together, and new words from which on they are folded together. All words of a
#: group are held as strings at once; those remembered lie between them, so that a worker keeps about what its largest group took.
GROUP_CHARS, MANY = 1 << 18, 64
#: Rows of an Arrow batch whose texts are Python strings at once.
PART_ROWS = 128
#: Longer words are folded with a heap. Words, or characters of a text, worked off at once.
LONG_WORD = 48
PART_WORDS = 1 << 18
NONE = 1 << 62


def parse_ranks(vocabulary: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file's content: a base64 token and its rank in each line."""
    lines = (line.split() for line in vocabulary.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in lines}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal array<map<string, int>> by the tokens' hexadecimal digits. Its size is the vocabulary's.

    Catalyst folds the text to a literal once for each place where it stands, so it is to be bound by `let`.
    """
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        buckets[xxhash.xxh64_intdigest(token, 42) % BUCKETS][token.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,int>>")


def ranked(table: Column, piece: Column) -> Column:
    """The rank of a piece (binary), null if it is no token."""
    return F.try_element_at(F.get(table, F.pmod(F.xxhash64(piece), F.lit(BUCKETS)).cast("int")), F.hex(piece))


def let(value: Column, body) -> Column:
    """`body` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def merged(table: Column, word: Column) -> Column:
    """The tokens (array<binary>) of a non-empty word (binary): merges folded by rank, the leftmost of equal ranks first.

    The state holds the pieces so far and the rank of each neighbouring pair. A step joins the best pair and ranks the two
    pairs that change; when no pair has a rank, further steps change nothing.
    """
    size = F.octet_length(word)
    single = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(word, i, F.lit(1)))
    pairs = F.when(size > 1, F.transform(F.sequence(F.lit(1), size - 1), lambda i: ranked(table, F.substring(word, i, F.lit(2))))).otherwise(F.array().cast("array<int>"))
    start = F.struct(single.alias("parts"), pairs.alias("ranks"))

    def step(state: Column, _: Column) -> Column:
        def join(best: Column) -> Column:
            def at_pair(p: Column) -> Column:
                at, piece = p["at"], p["piece"]
                n = F.size(state["parts"])
                left = F.when(at > 1, ranked(table, F.concat(F.get(state["parts"], at - 2), piece)))
                right = F.when(at + 1 < n, ranked(table, F.concat(piece, F.get(state["parts"], at + 1))))
                parts = F.concat(F.slice(state["parts"], F.lit(1), at - 1), F.array(piece), F.slice(state["parts"], at + 2, n))
                ranks = F.concat(
                    F.slice(state["ranks"], F.lit(1), F.greatest(at - 2, F.lit(0))),
                    F.when(at > 1, F.array(left)).otherwise(F.array().cast("array<int>")),
                    F.when(at + 1 < n, F.array(right)).otherwise(F.array().cast("array<int>")),
                    F.slice(state["ranks"], at + 2, n),
                )
                return F.struct(parts.alias("parts"), ranks.alias("ranks"))

            at = F.array_position(state["ranks"], best).cast("int")
            return let(at, lambda a: let(F.struct(a.alias("at"), F.concat(F.get(state["parts"], a - 1), F.get(state["parts"], a)).alias("piece")), at_pair))

        return let(F.array_min(state["ranks"]), lambda best: F.when(best.isNull(), state).otherwise(join(best)))

    rounds = F.when(size > 1, F.sequence(F.lit(2), size)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, start, step, lambda s: s["parts"])


def encoded(ranks: dict[bytes, int], word: Column) -> Column:
    """The ids (array<int>) of a non-empty word (binary). A word that is a token is that token."""

    def ids(table: Column) -> Column:
        whole = ranked(table, word)
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(merged(table, word), lambda p: ranked(table, p)))

    return let(rank_map(ranks), ids)


def encoded_words(words: DataFrame, ranks: dict[bytes, int], word: str = "word") -> DataFrame:
    """`word` and ids of each distinct word of a table, by the fold above: for dictionaries, all in DataFrame functions.

    Null and empty words have no ids.
    """
    binary = F.col(word).cast("binary")
    ids = F.when(F.octet_length(word) > 0, encoded(ranks, binary)).otherwise(F.array().cast("array<int>"))
    return words.select(word).distinct().select(word, ids.alias("ids"))


def stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at `starts`, one run after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Folder:
    """Folds many words at once: in each round every word merges its pair of lowest rank, the leftmost of equal ranks.

    Words are runs of ids in one array. A pair's rank is the id of the merged token, found in a sorted table of all pairs of
    tokens that make up a token.
    """

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        """The ids of non-empty words."""
        ids, sizes = self.runs(words)
        return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if words else []

    def runs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of non-empty words, one word after another, and how many each has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        number = np.arange(len(words))  # of the words that still merge
        of = np.repeat(number, lengths)
        rank = np.full(len(ids), NONE)  # of the pair that begins here
        inner = np.flatnonzero(of[1:] == of[:-1])
        rank[inner] = self.rank(ids[inner], ids[inner + 1])
        if not len(self.keys):
            return ids, lengths
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # numbers, sizes and ids of the words done in a round
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(ids)))
            done = best == NONE
            if done.any():
                stays = np.repeat(~done, sizes)
                found.append((number[done], sizes[done], ids[~stays]))
                ids, rank, number = ids[stays], rank[stays], number[~done]
                best, sizes = best[~done], sizes[~done]
                of = np.repeat(np.arange(len(number)), sizes)
                if not len(ids):
                    break
            at = np.flatnonzero(rank == best[of])
            at = at[np.concatenate(([True], of[at[1:]] != of[at[:-1]]))]  # each word's leftmost
            ids[at] = best
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            at = at - np.arange(len(at))  # one piece of each earlier word is gone
            ids, rank, of = ids[stays], rank[stays], of[stays]
            for left in (at, at[at > 0] - 1):
                right = np.minimum(left + 1, len(ids) - 1)
                paired = (right > left) & (of[left] == of[right])
                rank[left] = np.where(paired, self.rank(ids[left], ids[right]), NONE)
        if not found:
            return ids, lengths
        number, sizes, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(number)
        return ids[stretches((np.cumsum(sizes) - sizes)[order], sizes[order])], sizes[order]


class Lines(dict):
    """Words by the number of their line of ids: a word that is new gets the next number and waits for its ids."""

    def __init__(self):
        self.new: list[str] = []
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words, one word after another, and how many each has."""
        sizes = self.ends[numbers + 1] - self.ends[numbers]
        return self.ids[stretches(self.ends[numbers], sizes)], sizes

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
        self.ids, self.new = np.concatenate((self.ids, ids.astype(np.int32))), []


class Coder:
    """Encodes texts word by word; a word's ids are folded once and remembered."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.ranks = parse_ranks(vocabulary)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        #: Each id in decimal and a comma.
        self.shown = np.array([f"{rank}," for rank in range(max(self.tokens) + 1)], "S")
        self.words = regex.compile(pattern)
        self.folder = Folder(self.ranks)
        self.lines = Lines()
        self.old: tuple[Lines] = (Lines(),)

    def fold(self, word: bytes) -> list[int]:
        """The ids of a word: the pair of lowest rank is merged until no pair has a rank, the leftmost of equal ranks first."""
        ranks = self.ranks
        if (whole := ranks.get(word)) is not None:
            return [whole]
        if len(word) > LONG_WORD:
            return self._fold_long(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        pairs = [ranks.get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
        while pairs and (best := min(pairs)) != NONE:
            at = pairs.index(best)
            parts[at : at + 2] = [piece := parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = ranks.get(piece + parts[at + 1], NONE)
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + piece, NONE)
        return [ranks[p] for p in parts]

    def _fold_long(self, word: bytes) -> list[int]:
        """The same with a heap of pairs and linked pieces, for words of any length."""
        ranks, n = self.ranks, len(word)
        end, before = [*range(1, n + 1)], [*range(-1, n - 1)]  # of the piece that begins at a place; 0 once it is merged
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2], NONE)) != NONE]
        heapify(heap)
        while heap:
            _, i, j = heappop(heap)
            k = end[i]
            if not k or k >= n or end[k] != j:
                continue  # one of the two is merged already
            end[i], end[k] = j, 0
            if j < n:
                before[j] = i
                if (r := ranks.get(word[i : end[j]], NONE)) != NONE:
                    heappush(heap, (r, i, end[j]))
            if i and (r := ranks.get(word[before[i] : j], NONE)) != NONE:
                heappush(heap, (r, before[i], j))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one word after another, and how many each has. What the old generation knows of them is taken over."""
        if len(self.lines) > REMEMBERED:
            self.old, self.lines = (self.lines,), Lines()
        numbers = np.fromiter(map(self.lines.__getitem__, words), np.int64, len(words))
        if self.lines.new:
            self.lines.add(*self._learnt(self.lines.new))
        return self.lines.of(numbers)

    def _learnt(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known = np.fromiter((self.old[0].get(w, -1) for w in new), np.int64, len(new))
        fresh = np.flatnonzero(known < 0)
        raw = [new[i].encode("utf-8", "surrogatepass") for i in fresh.tolist()]
        whole = np.fromiter((self.ranks.get(w, -1) for w in raw), np.int64, len(raw))
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        short = (whole < 0) & (lengths <= LONG_WORD)
        if short.sum() < MANY:  # few words are folded one by one: rounds over arrays pay off for many
            short[:] = False
        alone = np.flatnonzero((whole < 0) & ~short)
        single = [self.fold(raw[i]) for i in alone.tolist()]
        old, one = np.flatnonzero(known >= 0), np.flatnonzero(whole >= 0)
        some = [
            (old, *self.old[0].of(known[old])),
            (fresh[one], whole[one], np.ones(len(one), np.int64)),
            (fresh[short], *self.folder.runs([raw[i] for i in np.flatnonzero(short).tolist()])),
            (fresh[alone], np.array([x for ids in single for x in ids], np.int64), np.array([len(ids) for ids in single], np.int64)),
        ]
        sizes = np.empty(len(new), np.int64)
        for at, _, own in some:
            sizes[at] = own
        starts = np.cumsum(sizes) - sizes
        out = np.empty(sizes.sum(), np.int64)
        for at, ids, own in some:
            out[stretches(starts[at], own)] = ids
        return out, sizes

    def parts(self, text: str) -> Iterator[list[str]]:
        """The text's words, in lists of up to PART_WORDS where it is long."""
        if len(text) <= PART_WORDS:
            parts = iter([self.words.findall(text)])
        else:
            found = self.words.finditer(text)
            parts = iter(lambda: [m[0] for m in islice(found, PART_WORDS)], [])
        return (words for words in parts if words)

    def encode(self, text: str) -> list[int]:
        return [i for words in self.parts(text) for i in self.ids(words)[0].tolist()]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text: number of ids, digest of the ids, digest of the bytes that they decode to."""
        at = 0
        while at < len(texts):
            group, chars = [], 0
            while at < len(texts) and (not group or chars + len(texts[at]) <= GROUP_CHARS):
                group.append(texts[at])
                chars, at = chars + len(texts[at]), at + 1
            if len(group[0]) > PART_WORDS:  # it comes alone, and part by part
                yield self._digest(self.ids(words)[0] for words in self.parts(group[0]))
                continue
            found = [self.words.findall(t) for t in group]
            ids, sizes = self.ids([*chain.from_iterable(found)])
            ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0, *map(len, found)])].tolist()
            for a, b in pairwise(ends):
                yield self._digest([ids[a:b]] if b > a else [])

    def _digest(self, parts: Iterable[np.ndarray]) -> tuple[int, str, str]:
        n, digest, decoded, last = 0, hashlib.sha256(), hashlib.sha256(), b""
        for ids in parts:
            line = self.shown[ids].view(np.uint8)
            line = line[line != 0].tobytes()
            digest.update(last + line[:-1])
            decoded.update(self.decode(ids.tolist()))
            n, last = n + len(ids), b","
        return n, digest.hexdigest(), decoded.hexdigest()


@lru_cache(maxsize=2)
def coder(vocabulary: bytes, pattern: str) -> Coder:
    """One coder per Python worker: what it has learnt serves the worker's later tasks."""
    return Coder(vocabulary, pattern)


def _mapped(docs: DataFrame, vocabulary: str, pattern: str, key: str, source: str, columns: list[T.StructField], rows_of) -> DataFrame:
    with open(vocabulary, "rb") as f:
        payload = f.read()
    rows = pick(docs, key, source).toDF("key", "value")
    schema = T.StructType([rows.schema["key"], *columns])
    names = [c.name for c in columns]
    types = [to_arrow_type(c.dataType) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(payload, pattern)
        for batch in sliced(batches, PART_ROWS):
            out = [*zip(*rows_of(own, batch.column(1).to_pylist()), strict=True)] or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], ["key", *names])

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def encode(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and ids (array<int>) of each row; null counts as empty."""
    ids = T.StructField("ids", T.ArrayType(T.IntegerType()))
    return _mapped(docs, vocabulary, pattern, key, text, [ids], lambda c, texts: ((c.encode(t or ""),) for t in texts))


def decode(rows: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """`key` and data (binary): the concatenated bytes of the ids; null counts as no ids."""
    data = T.StructField("data", T.BinaryType())
    return _mapped(rows, vocabulary, pattern, key, ids, [data], lambda c, lists: ((c.decode(x or []),) for x in lists))


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_tokens, ids_sha256 and decoded_sha256 of each row: its text's ids, and the bytes that they decode to.

    Each match of `pattern` is encoded separately, without special tokens: the ranked merges are folded over the bytes of each
    distinct word once per Python worker, up to a bound on what is remembered, and texts look their words up. Decoding
    concatenates the ids' bytes. One pass without a shuffle; the vocabulary file (about 1 MB) goes along with the tasks.

    Null counts as empty and has no tokens. Long texts are worked off in parts, long words by a heap. Equal rows give equal
    rows; further columns are ignored.
    """
    columns = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(docs, vocabulary, pattern, key, text, columns, lambda c, texts: c.digests([t or "" for t in texts]))
