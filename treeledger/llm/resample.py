"""Importance resampling towards a target (operator 12): bytes translated and split, chained CRC-32 for n-grams, counters reduced."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import with_global_index
from .common import cut_lineage, pick

#: A-Z become a-z; a-z, 0-9 and all bytes of other characters stay; every other byte is a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Longer texts are worked off in parts of about so many bytes, cut between words.
PART = 1 << 20
BUCKETS, WIDTH = 10_000, 2


def buckets_of(text: str | None, width: int = WIDTH, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of the text's runs of 1 to `width` words, part by part.

    A run's CRC-32 continues the one of the run without its last word, so no run is ever put together.
    """
    data = (text or "").encode("utf-8", "surrogatepass").translate(TABLE)
    open_runs: list[list[int]] = [[] for _ in range(width)]  # per length: the checksums of runs that end at the last word
    begin = 0
    while begin < len(data):
        end = len(data)
        if end - begin > PART and (cut := data.find(b" ", begin + PART)) >= 0:
            end = cut
        words = data[begin:end].split()
        begin = end
        if not words:
            continue
        found = list(map(zlib.crc32, words))
        out, tails = [found], list(map(b" ".__add__, words))
        for length in range(2, width + 1):
            # The shorter runs, also the one that ended the part before; each grows by the word after it.
            shorter = open_runs[length - 2] + out[-1]
            out.append(list(map(zlib.crc32, tails[len(words) - len(shorter) + 1 :], shorter[:-1])))
        open_runs = [runs[-1:] for runs in out]
        yield np.fromiter((c for part in out for c in part), np.uint32, sum(map(len, out))) % buckets


def bucket_counts(docs: DataFrame, text: str = "text", width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n of all texts: a task reduces its texts in one counter of at most `buckets` entries, Spark adds the tasks'."""
    rows = pick(docs, text).toDF("text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for value in batch.column(0):
                for part in buckets_of(value.as_py(), width, buckets):
                    total.update(part.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["bucket", "n"])

    return rows.mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", width: int = WIDTH, buckets: int = BUCKETS) -> list[int]:
    """Per bucket, 1,000 times the log of how much likelier the target is to fall into it, floored; counts are smoothed by one.

    At most `buckets` rows of counts reach the driver, whatever the size of either table.
    """
    s, t = ({r["bucket"]: r["n"] for r in bucket_counts(x, c, width, buckets).collect()} for x, c in ((docs, text), (target, target_text)))
    all_s, all_t = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    return [math.floor(1000 * math.log((t.get(b, 0) + 1.0) * all_s / ((s.get(b, 0) + 1.0) * all_t))) for b in range(buckets)]


def weighed(docs: DataFrame, gain: list[int], seed: int = 7, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """`key`, n_features, n_words, weight and score of each row: weight is the floored mean of its features' gains, score adds
    Gumbel noise drawn from the seed and the key, so that the highest scores are a draw without replacement."""
    rows = pick(docs, key, text).select(F.col(key).alias("key"), F.col(text).alias("text"), F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8).alias("h"))
    columns = ["n_features", "n_words", "weight", "score"]
    schema = T.StructType([rows.schema["key"], *[T.StructField(c, T.LongType()) for c in columns]])
    table, buckets = np.array(gain, np.int64), len(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, h in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                n = total = 0
                for part in buckets_of(value.as_py(), width, buckets):
                    n, total = n + len(part), total + int(table[part].sum())
                # n features of w words: w + (w - 1) + ... down to runs of the whole width
                words = next((w for w in range(1, width) if sum(range(1, w + 1)) == n), (n + sum(range(width))) // width) if n else 0
                weight = total // n if n else 0
                out.append((n, words, weight, weight + math.floor(-1000 * math.log(-math.log((int(h, 16) + 0.5) / 4294967296)))))
            found = np.array(out, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, i].copy()) for i in range(4)]], ["key", *columns])

    return rows.mapInArrow(score, schema).withColumnRenamed("key", key)


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least: int = 20, seed: int = 7, key: str = "doc_id", text: str = "text", target_text: str = "text", width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """`key`, n_features, n_words, weight, score and rank (1, 2, ... of the documents drawn, else null) of each row of `docs`.

    Features are runs of 1 to `width` words, hashed to `buckets`. Of the documents with at least `least` words, `percent` of
    100 are drawn, floored, by highest score; ties go to the smaller key, null keys last. Ranks come from range partitions,
    so no task sees all rows.

    Null and empty texts have no features, weight 0, and are never drawn if `least` is above 0. Very long texts count whole, in
    parts. Rows that share their key are each weighed and drawn with the same noise; a null key counts as empty in it. An
    empty target table gives gains that prefer rare buckets; an empty `docs` an empty result. Further columns don't count.
    """
    gain = gains(docs, target, text, target_text, width, buckets)
    rows = cut_lineage(weighed(docs, gain, seed, key, text, width))
    fit = F.col("n_words") >= least
    number = rows.where(fit).count() * percent // 100
    order = [fit.desc(), F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    listed = with_global_index(rows, order, "_at", stored=True)
    return listed.withColumn("rank", F.when(fit & (F.col("_at") < number), F.col("_at") + 1)).drop("_at")
