"""The corpus pipeline: documents in, encoded training documents out.

Low quality goes, then exact copies, then near copies; what is left is mixed to the sources' target weights and encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from treeledger.cluster import cut_lineage
from treeledger.llm.bpe import encode_decode
from treeledger.llm.dedup import without_copies
from treeledger.llm.mixing import allocate, mix, shuffled
from treeledger.llm.quality import good_only
from treeledger.llm.simhash import one_of_each

#: Bytes of an Arrow batch. An executor and its Python worker each hold a batch of whole texts and keep that memory for later
#: tasks; by rows alone (10,000) a batch has 35 MB, or twice that while it grows.
BATCH_BYTES = 4 << 20

#: The classifier, the fingerprints and the mix have no SQL form.
ORACLE_SQL = None


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at BATCH_BYTES; results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; it is fitted on a bounded sample of `docs` and the labels."""
    small_batches(spark)
    return good_only(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that reach each other over SimHash links, the one with the smallest id."""
    small_batches(spark)
    return one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document stands in it as often as its source's target wants, shard by shard in shuffled order."""
    return shuffled(docs, mix(allocate(docs)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of the mix."""
    small_batches(spark)
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing sources", source_mix),
    ("byte-level bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`. What a stage keeps is stored before the next one reads it, several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
