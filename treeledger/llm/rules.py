"""Quality rules (operator 5) with risk-controlled cutoffs, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, WORD, cut_lineage, pick

SYMBOLS = "#*$%&|<>"
#: What is measured of a text, each a share that is large in poor texts: symbols to word characters, repeated lines to lines
#: with words, words in repeated three-word windows, words equal to the word before, words ending in two exclamation marks,
#: capital letters (A-Z) to word characters.
MEASURES = ("symbols", "dup_lines", "repeats", "stutter", "shouts", "capitals")


@dataclass(frozen=True)
class Risk:
    """reject: the share of good documents that a rule may reject in a stratum. fault: the chance, over all rules, cutoffs and
    strata together, that any certified cutoff breaks this. grid: cutoffs tried, rising. languages: strata of their own; all
    other languages are one more, so their number is fixed. bands: word counts that part a language's strata. fit: one in so
    many labelled documents is not in the holdout and decides whether a rule is of use."""

    reject: float = 0.02
    fault: float = 0.05
    grid: tuple[float, ...] = (0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.45, 0.6, 0.8)
    languages: tuple[str, ...] = ("en", "de", "fr", "es")
    bands: tuple[int, ...] = ()
    fit: int = 4

    @property
    def level(self) -> float:
        """Of one rule in one stratum. Its cutoffs are tried in a fixed order up to the first failure, which costs nothing."""
        return self.fault / (len(MEASURES) * (len(self.languages) + 1) * (len(self.bands) + 1))


def bound(value: Column, body) -> Column:
    """`body` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more, the first one included.

    Windows whose hashes are all different are different: most texts end there. Otherwise windows are sorted with their
    positions, by hash and then by their words; neighbours that are equal repeat, and a word counts if it stands in one of them.
    """
    size = F.size(words)
    places = F.when(size > 3, F.sequence(F.lit(0), size - 3)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def decided(h: Column) -> Column:
        keyed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), F.slice(words, i + 1, 3).alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bound(keyed, _covered))

    return bound(hashes, decided)


def _covered(keyed: Column) -> Column:
    """Words under the sorted windows that equal a neighbour."""
    n = F.size(keyed)
    same = lambda a, b: (a["h"] == b["h"]) & (a["w"] == b["w"])
    hit = F.filter(keyed, lambda x, j: ((j > 0) & same(x, F.get(keyed, j - 1))) | ((j + 1 < n) & same(x, F.get(keyed, j + 1))))

    def total(at: Column) -> Column:
        steps = F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda x, y: F.least(F.lit(3), x - y))
        return F.when(F.size(at) > 0, F.aggregate(steps, F.lit(3), lambda s, x: s + x)).otherwise(0)

    return bound(F.array_sort(F.transform(hit, lambda x: x["i"])), total)


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """key, lang, the base columns of the contract and counts behind the measures, for each row; null texts have no words."""
    rows = pick(docs, key, text, language).select(F.col(key).alias("key"), F.col(language).cast("string").alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    rows = rows.withColumn("words", words).withColumn("lines", lines)
    without = lambda signs: F.length("text") - F.length(F.translate("text", signs, ""))
    return rows.select(
        "key", "lang",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        without(SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("bigint").alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size(F.filter("words", lambda w, i: (i > 0) & (w == F.get("words", i - 1)))).cast("bigint").alias("n_stutter"),
        F.regexp_count("text", F.lit(r"!!(?=[\x20\x09-\x0D]|$)")).cast("bigint").alias("n_shouts"),
        without(UPPER).cast("bigint").alias("n_capitals"),
    )


def shares(rows: DataFrame) -> DataFrame:
    """`rows` with the measures as an array, in the order of MEASURES, and the stratum's parts."""
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return rows.withColumn("shares", F.array(
        part("n_symbols", "word_chars"), part("n_dup_lines", "n_lines"), part("n_repeat_words", "n_words"),
        part("n_stutter", "n_words"), part("n_shouts", "n_words"), part("n_capitals", "word_chars"),
    ))


def stratum(plan: Risk) -> Column:
    """A small whole number: language among those listed, and band of word counts."""
    language = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in plan.languages]), F.col("lang")), F.lit(0))
    band = sum(((F.col("n_words") >= b).cast("int") for b in plan.bands), F.lit(0))
    return (language * (len(plan.bands) + 1) + band).cast("int")


def at_most(successes: Column, trials: Column, chance: float) -> Column:
    """P(X <= successes) for X binomial: the exact p-value against "the risk is above `chance`"."""
    odds = chance / (1 - chance)
    first = trials * F.log1p(F.lit(-chance))
    start = F.struct(first.alias("log"), F.exp(first).alias("sum"))

    def step(s: Column, k: Column) -> Column:
        log = s["log"] + F.ln((trials - k + 1) / k * odds)
        return F.struct(log.alias("log"), (s["sum"] + F.exp(log)).alias("sum"))

    steps = F.when(successes > 0, F.sequence(F.lit(1).cast("bigint"), successes)).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.lit(1.0), F.aggregate(steps, start, step, lambda s: s["sum"]))


def cutoffs(rows: DataFrame, labels: DataFrame, plan: Risk = Risk(), key: str = "doc_id", label: str = "quality") -> DataFrame:
    """stratum and best: by measure, the certified cutoff (null where there is none).

    The holdout's good documents certify. From the highest cutoff down, each is tested by its exact binomial p-value against
    "it rejects more than `plan.reject` of the good ones"; the first p-value above `plan.level` ends the walk (fixed-sequence
    testing), and `plan.level` shares the allowed fault among rules and strata (Bonferroni). Of the certified cutoffs, the
    lowest stands that rejects poor documents over twice as often as good ones outside the holdout.
    """
    known = pick(labels, key, label).toDF("key", "y").where("key is not null and y is not null").groupBy("key").agg((F.avg("y") >= 0.5).alias("good"))
    held = F.pmod(F.xxhash64(F.lit("holdout"), "key"), F.lit(plan.fit)) != 0
    seen = shares(rows).join(known, "key").select(stratum(plan).alias("stratum"), "good", held.alias("held"), F.posexplode("shares").alias("measure", "share"))
    tell = {"rejected": F.col("held") & F.col("good"), "good": ~F.col("held") & F.col("good"), "poor": ~F.col("held") & ~F.col("good")}
    counted = seen.groupBy("stratum", "measure").agg(
        *[F.sum(on.cast("bigint")).alias(f"all_{n}") for n, on in tell.items()],
        *[F.sum((on & (F.col("share") > c)).cast("bigint")).alias(f"{n}{i}") for n, on in tell.items() for i, c in enumerate(plan.grid)],
    )
    tried = []
    for i, c in reversed([*enumerate(plan.grid)]):
        rejected, good, poor = (F.col(f"{n}{i}") for n in tell)
        # Where more are rejected than the share allows, the p-value is about one half or more: it needs no sum.
        possible = (rejected <= F.col("all_rejected") * plan.reject) & (F.col("all_rejected") > 0)
        p = F.when(possible, at_most(F.when(possible, rejected).otherwise(0), F.col("all_rejected"), plan.reject)).otherwise(1.0)
        useful = (poor > 0) & (poor * F.greatest("all_good", F.lit(1)) > 2 * good * F.greatest("all_poor", F.lit(1)))
        tried.append(F.struct(F.lit(float(c)).alias("cut"), p.alias("p"), useful.alias("useful")))
    start = F.struct(F.lit(True).alias("on"), F.lit(None).cast("double").alias("cut"))

    def walk(s: Column, t: Column) -> Column:
        on = s["on"] & (t["p"] <= plan.level)
        return F.struct(on.alias("on"), F.when(on & t["useful"], t["cut"]).otherwise(s["cut"]).alias("cut"))

    best = counted.select("stratum", "measure", F.aggregate(F.array(*tried), start, walk, lambda s: s["cut"]).alias("cut"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("measure", "cut"))).alias("best"))


def judged(docs: DataFrame, labels: DataFrame, plan: Risk = Risk(), key: str = "doc_id", text: str = "text", language: str = "lang", label: str = "quality") -> DataFrame:
    """`key`, the base columns, base_failed, kept, stratum and the first rule broken, for each row of `docs`.

    A row is kept unless its base fails or one of its measures is above its stratum's certified cutoff. Strata without enough
    labelled documents certify nothing, and only the base rules hold there; so without labels. Null keys meet no label.
    Null languages belong to the stratum of unlisted ones. Equal rows are judged alike.
    """
    rows = cut_lineage(measured(docs, key, text, language))
    chosen = cutoffs(rows, pick(labels, key, label), plan, key, label)
    marked = shares(rows).withColumn("stratum", stratum(plan))
    # One row per stratum, and Risk fixes how many strata there are.
    joined = marked.join(F.broadcast(chosen), "stratum", "left")
    above = [F.col("shares")[i] > F.try_element_at("best", F.lit(i)) for i in range(len(MEASURES))]
    broken = F.coalesce(*[F.when(F.coalesce(a, F.lit(False)), F.lit(m)) for a, m in zip(above, MEASURES, strict=True)])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & broken.isNull()).alias("kept"), "stratum", broken.alias("broken"),
    )
