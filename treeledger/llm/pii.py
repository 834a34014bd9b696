"""Personal data (operator 7): patterns, and terms that reveal what the patterns protect."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, even_lookup, pick

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^ \t-\r]+")
#: Words whose document counts a task holds before it passes them on.
HELD = 1 << 19
#: Bits of the filter that keeps words which disclose nothing out of a join: 1 MB whatever the corpus. Full, it only keeps less out.
FILTER_BITS = 1 << 23

Span = tuple[str, int, int]


@dataclass(frozen=True)
class Disclosure:
    """support: documents in which term and entity must meet. ratio: the share of an entity's information that a term may give
    away; from `removal` on it is removed, below generalised."""

    support: int = 2
    ratio: float = 0.8
    removal: float = 0.95


def emails(text: str) -> Iterator[Span]:
    """Every match lies around an @; its local part goes back to the last @ or match at most, so the search is linear."""
    end, at = 0, text.find("@")
    while at >= 0:
        before = text[end:at]
        local = len(before) - len(before.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if local else None
        if found:
            yield "email", at - local, found.end()
        end = found.end() if found else at + 1
        at = text.find("@", end)


def luhn(digits: str) -> bool:
    double = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    own = [int(d) for d in reversed(digits)]
    return (sum(own[::2]) + sum(double[d] for d in own[1::2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start; code points, end exclusive. Matches that fail their check are dropped."""
    out = list(emails(text)) if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(m[0].count, "0123456789")) <= 15]
    return out


def entity(kind: str, value: str) -> str:
    """One name for all spellings of a protected value."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else ''.join(c for c in value if c.isdigit())}"


def free_words(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """The words of a whole text that touch no base span: what can be a term."""
    words = [m.span() for m in TOKEN.finditer(text)]
    if not spans:
        return words
    starts = [s for s, _ in words]
    free = [True] * len(words)
    for _, start, end in spans:
        for i in range(max(0, bisect_right(starts, start) - 1), bisect_left(starts, end)):
            free[i] = free[i] and words[i][1] <= start
    return [w for w, on in zip(words, free, strict=True) if on]


def filter_bit(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode(), 5) % FILTER_BITS


def filter_of(terms: DataFrame) -> np.ndarray:
    """A bitmap with the bit of each term set."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([filter_bit(t.as_py()) for t in batch.column(0)], pa.int32())], ["bit"])

    found = terms.select("term").mapInArrow(bits, "bit int").distinct().toArrow().column("bit").to_numpy()
    out = np.zeros(FILTER_BITS, bool)
    out[found] = True
    return np.packbits(out, bitorder="little")


def document_counts(docs: DataFrame, text: str) -> DataFrame:
    """term, n: the number of rows whose text has the lower-cased word; counted in the tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

        for batch in batches:
            for t in batch.column(0):
                seen.update(set(TOKEN.findall(t.as_py().lower())))
                if len(seen) > HELD:
                    yield out()
                    seen.clear()
        yield out()

    texts = pick(docs, text).select(F.coalesce(text, F.lit("")).alias("text"))
    return texts.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", plan: Disclosure = Disclosure()) -> DataFrame:
    """key, base (spans array), terms (array of start, end, ratio) for each row of `docs`.

    A protected entity is a value that the base patterns find. A term (a lower-cased word of a text with the entity, however far
    from it) discloses it if pointwise mutual information over the corpus's documents, divided by the entity's information
    content, reaches `plan.ratio`: PMI / IC = 1 + log p(entity | term) / -log p(entity). Terms that meet the entity in fewer than
    `plan.support` documents are no evidence. Counts cover whole texts of all documents, and a disclosing term is marked wherever
    it stands, also in texts without the entity, with the highest of its ratios.

    Null texts count as empty and have no spans; repeated rows count as documents of their own; further columns are ignored.
    """
    rows = pick(docs, key, text).toDF("key", "text")
    telling = disclosing(docs, text, plan)
    known = filter_of(telling)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    near = T.StructType([T.StructField("term", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([rows.schema["key"], T.StructField("base", T.ArrayType(span)), T.StructField("near", T.ArrayType(near))])
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    nears = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        any_known, bitmap = bool(known.any()), known.tobytes()
        held: dict[str, bool] = {}

        def maybe(term: str) -> bool:
            if term not in held:
                if len(held) > HELD:
                    held.clear()
                bit = filter_bit(term)
                held[term] = bool(bitmap[bit >> 3] >> (bit & 7) & 1)
            return held[term]

        for batch in batches:
            base, near = [], []
            for t in batch.column(1):
                own = t.as_py() or ""
                spans = base_spans(own)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                words = ((own[s:e].lower(), s, e) for s, e in free_words(own, spans)) if any_known else ()
                near.append([{"term": w, "start": s, "end": e} for w, s, e in words if maybe(w)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kinds), pa.array(near, nears)], ["key", "base", "near"])

    found = cut_lineage(rows.mapInArrow(scan, schema).withColumn("row", F.monotonically_increasing_id()))
    near = found.select("row", F.explode("near").alias("x")).select("row", "x.*")
    hits = even_lookup(near, telling, ["term"], "inner")
    terms = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "ratio"))).alias("terms"))
    none = F.array().cast(terms.schema["terms"].dataType)
    return found.drop("near").join(terms, "row", "left").withColumn("terms", F.coalesce("terms", none))


def disclosing(docs: DataFrame, text: str = "text", plan: Disclosure = Disclosure()) -> DataFrame:
    """term, ratio: the terms that disclose an entity, with their highest ratio; see `find`."""
    texts = pick(docs, text).toDF("text")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.string())
        for batch in batches:
            entities, terms = [], []
            for t in batch.column(0):
                own = t.as_py() or ""
                if spans := base_spans(own):
                    entities.append(sorted({entity(k, own[s:e]) for k, s, e in spans}))
                    terms.append(sorted({own[s:e].lower() for s, e in free_words(own, spans)}))
            yield pa.RecordBatch.from_arrays([pa.array(entities, kind), pa.array(terms, kind)], ["entities", "terms"])

    total = texts.count()
    met = cut_lineage(texts.mapInArrow(meet, "entities array<string>, terms array<string>").withColumn("row", F.monotonically_increasing_id()))
    own = met.select("row", F.explode("entities").alias("entity"))
    # An entity of fewer documents than `support` meets no term that often: leaving it out here changes nothing.
    entities = cut_lineage(own.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= plan.support))
    rated = even_lookup(own, entities.select("entity", F.lit(True).alias("on")), ["entity"], "inner").groupBy("row").agg(F.collect_list("entity").alias("entities"))
    pairs = met.select("row", "terms").join(rated, "row").select("entities", F.explode("terms").alias("term"))
    pairs = pairs.select("term", F.explode("entities").alias("entity")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"))
    counts = document_counts(docs, text).withColumnRenamed("n", "n_term")
    weighed = pairs.where(F.col("both") >= plan.support).join(entities, "entity").join(counts, "term")
    information = -F.ln(F.col("n_entity") / F.lit(float(max(1, total))))
    ratio = F.when(information > 0, 1 + F.ln(F.col("both") / F.col("n_term")) / information)
    return cut_lineage(weighed.withColumn("ratio", ratio).where(F.col("ratio") >= plan.ratio).groupBy("term").agg(F.max("ratio").alias("ratio")))


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", plan: Disclosure = Disclosure()) -> DataFrame:
    """`key`, the number of base spans by kind, base_sha256 and spans of each row, as `find` has them.

    A span is written kind:start:end; `base_sha256` is the digest of the base spans, and `spans` has them by kind, then the
    disclosing terms by start.
    """
    found = find(docs, key, text, plan)
    base = F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    terms = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"]))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(kinds) - F.size(F.array_remove(kinds, k)) for k in KINDS]
    counts = [n.cast("bigint").alias(f"n_{k}") for n, k in zip(counts, KINDS, strict=True)]
    return found.select(
        F.col("key").alias(key), *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, terms), ",").alias("spans"), F.size("terms").cast("bigint").alias("n_term"),
    )


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text", plan: Disclosure = Disclosure()) -> DataFrame:
    """`key` and the text without personal data: base spans become their kind, disclosing terms a placeholder for their sort
    (number, name, word), or nothing from `plan.removal` on. Keys must name one row each."""
    found = find(docs, key, text, plan).select("key", "base", "terms")
    rows = pick(docs, key, text).toDF("key", "text").join(found, "key")
    schema = T.StructType([rows.schema["key"], T.StructField("text", T.StringType())])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [rewritten(r["text"], r["base"], r["terms"], plan.removal) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return rows.mapInArrow(clean, schema).toDF(key, text)


def rewritten(text: str | None, base: list[dict], terms: list[dict], removal: float) -> str | None:
    if text is None:
        return None
    cuts = [(s["start"], s["end"], f"<{s['kind']}>") for s in base]
    for s in terms:
        word = text[s["start"] : s["end"]]
        sort = "number" if DIGIT.search(word) else "name" if word[:1].isupper() else "word"
        cuts.append((s["start"], s["end"], "" if s["ratio"] >= removal else f"<{sort}>"))
    out, at = [], 0
    for start, end, put in sorted(cuts, key=lambda c: (c[0], -c[1])):
        if start >= at:
            out += [text[at:start], put]
        at = max(at, end)
    return "".join(out) + text[at:]


def digest(spans: list[Span]) -> str:
    """base_sha256 of spans, for tests and callers outside Spark."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
