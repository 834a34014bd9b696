"""Token counts (operator 10): batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick

#: Pieces given to the library at once, in characters, so that calls cost alike whatever the texts' lengths.
BATCH_CHARS = 1 << 18
#: Longer texts are worked off in parts of about this many characters.
PART_CHARS = 1 << 20
#: Counts remembered by a Python worker. Past it they are forgotten and counted anew.
REMEMBERED = 1 << 19
DOUBLE_BLANK = re.compile(r"\s\s")
#: A single space between two characters that are not blanks. Byte-level pre-tokenizers begin a match there, whatever
#: stands on either side, so counts of the two sides add up.
SAFE = re.compile(r"(?<=\S) (?=\S)")


class Counter:
    """Token counts of whole texts as sums over pieces cut at safe boundaries; equal pieces are encoded once."""

    def __init__(self, payload: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(payload)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # Special strings with a blank inside, or that take blanks beside them along, would span a boundary.
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.whole = any(re.search(r"\s", a.content) or a.lstrip or a.rstrip or a.single_word for a in added)
        self.known: dict[str, int] = {"": 0}

    def learn(self, pieces: Iterable[str]) -> None:
        batch, chars = [], 0
        for piece in pieces:
            batch.append(piece)
            chars += len(piece) + 16
            if chars >= BATCH_CHARS:
                self._encode(batch)
                batch, chars = [], 0
        if batch:
            self._encode(batch)

    def _encode(self, batch: list[str]) -> None:
        encoded = self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)
        self.known.update(zip(batch, map(len, encoded), strict=True))

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Parts of the text as lists of pieces; each piece but a text's first begins with its space."""
        if self.whole:
            yield [text]
            return
        begin = 0
        while begin < len(text):
            end = len(text)
            if end - begin > PART_CHARS and (cut := SAFE.search(text, begin + PART_CHARS)):
                end = cut.start()
            part = text[begin:end]
            if DOUBLE_BLANK.search(part):
                at = [0, *(m.start() for m in SAFE.finditer(part)), len(part)]
                yield [part[a:b] for a, b in zip(at, at[1:], strict=False)]
            else:
                first, *rest = part.split(" ")
                yield [first, *map(" ".__add__, rest)]
            begin = end

    def count(self, texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            total = 0
            for part in self.pieces(text):
                try:
                    total += sum(map(self.known.__getitem__, part))
                except KeyError:
                    if len(self.known) > REMEMBERED:
                        self.known = {"": 0}
                    self.learn(sorted(set(part).difference(self.known)))
                    total += sum(map(self.known.__getitem__, part))
            out.append(total)
        return out


@lru_cache(maxsize=2)
def counter(payload: bytes) -> Counter:
    return Counter(payload)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_bytes, n_tokens and over_limit (more than `limit` tokens) of each row of `docs`, in one pass without a shuffle.

    `tokenizer` is a tokenizers JSON file, read once by the driver (a few MB, whatever the data). No begin, end or padding
    tokens are added and nothing is truncated; special strings in a text count as the library counts them by default.

    Nulls and empty texts have 0 bytes and 0 tokens; the key may be null. Long texts are worked off in parts. Equal rows give
    equal rows, empty tables an empty result, further columns are ignored.
    """
    with open(tokenizer, "rb") as f:
        payload = f.read()
    rows = pick(docs, key, text).select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["key"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            n_bytes = pa.compute.binary_length(texts).cast(pa.int64())
            n_tokens = pa.array(counter(payload).count(texts.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n_tokens], ["key", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(lengths, schema)
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
