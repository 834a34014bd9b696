"""Registered queries of the corpus operators, with SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .bpe import encode_decode
from .common import documents, table
from .counts import token_counts
from .dedup import exact_groups
from .language_model import score
from .licenses import license_scan
from .manifest import manifest, without_newlines
from .mixing import allocate, mix, taken
from .pii import personal_data
from .quality import fitted, scored
from .resample import resampled
from .rules import judged
from .simhash import components_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels")))


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_decode(documents(spark, sf_dir), vocabulary, public_tokenizers.PATTERN)


@query
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    allocated = allocate(documents(spark, sf_dir))
    mixed = taken(allocated, mix(allocated))
    return mixed.select(F.col("key").alias("doc_id"), "source", "size", "source_size", "target", "taken")


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


ORACLES["op6_exact_dedup"] = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


@query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(documents(spark, sf_dir))


@query
def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = toxicity.fitted(docs, labels.where(~held))
    found = toxicity.scored(docs, model)
    return found.withColumn("held_out", held).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampled(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 in SQL: the table of the reversed polynomial by its rule, and a fold over the bytes of a hex string.
SQL_CRC = """crc AS MATERIALIZED (
  SELECT list(list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS step
  FROM range(256) r(i)
)"""


def sql_crc(text: str) -> str:
    digit = "(instr('0123456789ABCDEF', substr(hex({0}), {1}, 1)) - 1)"
    byte = f"({digit.format(text, '2 * i + 1')} * 16 + {digit.format(text, '2 * i + 2')})::UBIGINT"
    return (
        f"xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(strlen({text})), lambda i: {byte})), "
        "lambda c, b: xor(c >> 8, step[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)"
    )


ORACLES["op12_resample"] = f"""
WITH {SQL_CRC}, texts AS (
  SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark
), split AS (
  SELECT side, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts
), runs AS (
  SELECT side, row, unnest(words) AS f FROM split
  UNION ALL
  SELECT side, row, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM split WHERE len(words) > 1
), hashed AS (
  SELECT f, ({sql_crc("f")} % 10000)::BIGINT AS bucket FROM (SELECT DISTINCT f FROM runs), crc
), placed AS (SELECT side, row, bucket FROM runs JOIN hashed USING (f)),
sums AS (SELECT count(*) FILTER (side = 'd') AS s_all, count(*) FILTER (side = 't') AS t_all FROM placed),
gains AS (
  SELECT bucket, floor(1000 * ln((count(*) FILTER (side = 't') + 1)::DOUBLE * (any_value(s_all) + 10000)::DOUBLE
    / ((count(*) FILTER (side = 'd') + 1)::DOUBLE * (any_value(t_all) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM placed, sums GROUP BY bucket
), weighed AS (
  SELECT row, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row
), noisy AS (
  SELECT row, doc_id, len(words) AS n_words, list_reduce(list_concat([0::BIGINT], list_transform(range(1, 9),
    lambda i: (instr('0123456789abcdef', substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), i, 1)) - 1)::BIGINT)), lambda a, b: a * 16 + b) AS h
  FROM split WHERE side = 'd'
), scored AS (
  SELECT doc_id, n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM noisy LEFT JOIN weighed USING (row)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST, weight DESC, n_features DESC) AS spot,
    count(*) FILTER (n_words >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND spot <= 25 * n // 100 THEN spot END AS rank FROM ranked
"""


@query
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir), changed=without_newlines).drop("steps")


def sql_framed(text: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars")]
    return " || ".join([*parts, f"coalesce(strlen({text})::VARCHAR || ':' || {text}, '-')"])


SQL_LEVELS = """
  SELECT {of}, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY {of}, level, i // 3, n
"""
# One step per level, of a leaf's own group first, then of the groups' tops; `high` puts the latter above.
ORACLES["op13_manifest"] = f"""
WITH RECURSIVE {SQL_CRC}, found AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, sha256({sql_framed("text")}) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {sql_crc("doc_id::VARCHAR")} % 2 = 0 THEN sha256({sql_framed("replace(text, chr(10), '')")})
      ELSE sha256({sql_framed("text")}) END AS later
  FROM documents, crc
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, later) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM found
), nodes(g, level, i, h, n) AS (
  SELECT g, 0::BIGINT, place, leaf, n FROM leaves UNION ALL {SQL_LEVELS.format(name="nodes", of="g")}
), tops AS (
  SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), high(g, level, i, h, n) AS (
  SELECT '', 0::BIGINT, place, h, n FROM tops UNION ALL {SQL_LEVELS.format(name="high", of="g")}
), steps AS (
  SELECT g, place, level, string_agg(h, '' ORDER BY i) FILTER (i < own) AS l, string_agg(h, '' ORDER BY i) FILTER (i > own) AS r FROM (
    SELECT x.g, x.place, s.level, s.i, s.h, x.place // pow(3, s.level)::BIGINT AS own
    FROM leaves x JOIN nodes s ON s.g = x.g AND s.n > 1 AND s.i // 3 = x.place // pow(3, s.level + 1)::BIGINT
    UNION ALL
    SELECT x.g, x.place, 1000 + s.level, s.i, s.h, t.place // pow(3, s.level)::BIGINT
    FROM leaves x JOIN tops t ON t.g = x.g JOIN high s ON s.n > 1 AND s.i // 3 = t.place // pow(3, s.level + 1)::BIGINT
  ) GROUP BY g, place, level
), chains AS (
  SELECT g, place, list(struct_pack(l := coalesce(l, ''), r := coalesce(r, '')) ORDER BY level) AS chain,
    sha256(string_agg(coalesce(l, '') || coalesce(r, ''), '' ORDER BY level)) AS proof FROM steps GROUP BY g, place
), folded(g, place, done, acc, chain) AS (
  SELECT g, place, 0, later, chain FROM leaves LEFT JOIN chains USING (g, place)
  UNION ALL
  SELECT g, place, done + 1, sha256(chain[done + 1].l || acc || chain[done + 1].r), chain FROM folded WHERE done < len(chain)
)
SELECT x.doc_id, x.leaf, t.h AS subroot, z.h AS root, coalesce(c.proof, sha256('')) AS proof_sha256, f.acc AS folded_root, f.acc = z.h AS verified
FROM leaves x JOIN tops t ON t.g = x.g JOIN high z ON z.n = 1 LEFT JOIN chains c ON c.g = x.g AND c.place = x.place
JOIN folded f ON f.g = x.g AND f.place = x.place AND f.done = coalesce(len(f.chain), 0)
"""
