"""Reducing run events: active time, rates, completion, phase states and throttled progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import cut_lineage, running_total, spread_lookup
from ..functions import text
from .chains import greedy_kept

WINDOW_MS = 60_000
SHORTEST_MS = 200
SPACING_MS = 100
COUNTERS = ["items_done", "items_total", "bytes_done", "bytes_total"]


def active_elapsed(events: DataFrame, run: list[str], now_ms: int) -> DataFrame:
    """Per run: wall time since its first event, less finished pauses and a pause still open at `now_ms`."""
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("ts_ms")))
    facts = events.groupBy(*run).agg(
        F.min("ts_ms").alias("started_ms"), F.sum(F.when(F.col("kind") == "resumed", F.col("paused_ms")).otherwise(0)).alias("paused_ms"),
        last("paused").alias("_p"), last("resumed").alias("_r"),
    )
    open_pause = F.when(F.col("_p").isNotNull() & (F.col("_r").isNull() | (F.col("_r") < F.col("_p"))), now_ms - F.col("_p")).otherwise(0)
    active = F.greatest(F.lit(0), now_ms - F.col("started_ms") - F.col("paused_ms") - open_pause)
    return facts.select(*run, "started_ms", F.col("paused_ms").cast("bigint").alias("paused_ms"), active.cast("bigint").alias("active_ms"))


def progress_samples(events: DataFrame, run: list[str]) -> DataFrame:
    """Progress rows with `active_ms`: time since the run started without the pauses before the row.

    Pauses and rows are scanned together over range partitions of (run, time), so neither a run's pauses nor its rows are
    gathered; a pause that ends at a row's time counts as before it.
    """
    begun = events.groupBy(*run).agg(F.min("ts_ms").alias("_start"))
    wanted = events.where(F.col("kind").isin("progress", "resumed")).withColumn("_row", (F.col("kind") == "progress").cast("int"))
    pause = F.when(F.col("_row") == 0, F.coalesce("paused_ms", F.lit(0))).otherwise(0).cast("bigint")
    placed = running_total(wanted, run, ["ts_ms", "_row", "seq"], pause, "_paused").where("_row = 1")
    started = spread_lookup(placed, begun, run)
    return started.withColumn("active_ms", (F.col("ts_ms") - F.col("_start") - F.col("_paused")).cast("bigint")).drop("_start", "_paused", "_row")


def latest_rate(samples: DataFrame, run: list[str], window_ms: int = WINDOW_MS) -> DataFrame:
    """Per run: its latest counters and their rate over the trailing window of active time.

    The baseline is the last sample at least `window_ms` older, else the first; spans under 200 ms have no
    rate. Two aggregates, so a run with very many samples is reduced in its map tasks.
    """
    at = F.struct("active_ms", "seq")
    value = F.struct("active_ms", "bytes_done", "items_done")
    ends = samples.groupBy(*run).agg(
        F.max_by(F.struct("active_ms", *COUNTERS, "phase"), at).alias("_last"), F.min_by(value, at).alias("_first"),
    )
    older = spread_lookup(samples, ends.select(*run, F.col("_last.active_ms").alias("_until")), run, "inner").where(
        F.col("active_ms") <= F.col("_until") - window_ms
    ).groupBy(*run).agg(F.max_by(value, at).alias("_old"))
    joined = ends.join(older, run, "left").withColumn("_base", F.coalesce("_old", "_first"))
    span = F.col("_last.active_ms") - F.col("_base.active_ms")
    rate = lambda c: F.when(span >= SHORTEST_MS, (F.col(f"_last.{c}") - F.col(f"_base.{c}")) * 1000 / span)
    return joined.select(
        *run, "_last.*", rate("bytes_done").alias("bytes_per_second"), rate("items_done").alias("items_per_second")
    )


def completion(running: Column, finished_ok: Column) -> dict[str, Column]:
    """percent, finalizing, remaining text. Needs bytes/items done and total, and the rates."""
    done_b, total_b, done_i, total_i = (F.col(c) for c in ("bytes_done", "bytes_total", "items_done", "items_total"))
    work = total_b + total_i
    raw = F.greatest(F.lit(0.0), (done_b + done_i) * 100 / work)
    percent = (
        F.when(finished_ok, F.lit(100.0)).when(work <= 0, F.lit(0.0))
        .when(running, F.least(F.lit(99.0), F.floor(raw).cast("double"))).otherwise(F.least(F.lit(100.0), raw))
    )
    exhausted = (work > 0) & ((total_i == 0) | (done_i >= total_i)) & ((total_b == 0) | (done_b >= total_b))
    finalizing = exhausted | ((total_b > 0) & (done_b >= total_b))

    def left(total, done, rate):
        time = text.human_duration(F.greatest(F.lit(0), total - done) / rate * 1000)
        return F.concat(time, F.lit(" remaining"))

    remaining = (
        F.when(~running, F.lit("—")).when(finalizing, F.lit("Finalizing…"))
        .when((total_b > 0) & (F.col("bytes_per_second") > 1), left(total_b, done_b, F.col("bytes_per_second")))
        .when((total_i > 0) & (F.col("items_per_second") > 0.01), left(total_i, done_i, F.col("items_per_second")))
        .otherwise(F.lit("Estimating…"))
    )
    return {"percent": percent, "finalizing": finalizing, "remaining": remaining}


def stage_states(events: DataFrame, run: list[str]) -> DataFrame:
    """The state of every phase after all its events; phases do not influence each other.

    A start resets the counters, totals replace them, an end fixes those it names, progress only raises
    them. So each counter is the larger of its last set value and the progress after that point.
    """
    e = events.where(F.col("kind").isin("phase_start", "totals", "progress", "phase_end") & F.col("phase").isNotNull())
    kind, keys = F.col("kind"), [*run, "phase"]

    def set_value(c):
        given = F.coalesce(F.col(c), F.lit(0).cast("bigint"))
        started = F.lit(0).cast("bigint") if c.endswith("_done") else given
        return F.when(kind == "phase_start", started).when(kind == "totals", given).when(kind == "phase_end", F.col(c))

    seq_if = lambda cond: F.when(cond, F.col("seq"))
    aggregates = []
    for c in COUNTERS:
        sets = seq_if(set_value(c).isNotNull())
        aggregates += [F.max(sets).alias(f"_at_{c}"), F.max_by(set_value(c), sets).alias(f"_set_{c}")]
    labelled = seq_if((kind == "phase_start") & F.col("label").isNotNull())
    ends = seq_if(kind == "phase_end")
    facts = e.groupBy(*keys).agg(
        *aggregates, F.max(seq_if(kind == "phase_start")).alias("_start"), F.max(ends).alias("_end"),
        F.max_by("status", ends).alias("_status"), F.max(labelled).alias("_labelled"), F.max_by("label", labelled).alias("_label"),
        F.max(seq_if(kind == "progress")).alias("_progress"),
    )
    raised = (
        spread_lookup(e.where(kind == "progress"), facts.select(*keys, *[f"_at_{c}" for c in COUNTERS]), keys, "inner").groupBy(*keys)
        .agg(*[
            F.max(F.when(F.col("seq") > F.coalesce(F.col(f"_at_{c}"), F.lit(-1)), F.col(c))).alias(f"_up_{c}") for c in COUNTERS
        ])
    )
    ended = F.col("_end").isNotNull() & (F.col("_start").isNull() | (F.col("_end") > F.col("_start")))
    cleared = F.col("_progress") > F.coalesce(F.col("_labelled"), F.lit(-1))
    state = lambda s: F.coalesce(ended & (F.col("_status") == s), F.lit(False))
    return facts.join(raised, keys, "left").select(
        *keys, *[F.greatest(F.col(f"_set_{c}"), F.col(f"_up_{c}"), F.lit(0)).cast("bigint").alias(c) for c in COUNTERS],
        F.when(cleared, F.lit("")).otherwise(F.coalesce("_label", F.lit(""))).alias("label"),
        (~ended).alias("active"), state("completed").alias("done"), state("failed").alias("failed"), state("cancelled").alias("cancelled"),
    )


# --- throttling ---------------------------------------------------------------------------------------------


def throttled(events: DataFrame, run: list[str], spacing_ms: int = SPACING_MS) -> DataFrame:
    """Progress rows an observer keeps: each at least `spacing_ms` after the last kept one of its phase.

    The choice is a chain over ordered times (`chains.greedy_kept`): slots of time are composed in a tree, so no phase is
    ever gathered, and the rows of a slot are bounded by its width.
    """
    keys = [*run, "phase"]
    rows = cut_lineage(events.where(F.col("kind") == "progress").groupBy(*keys, "ts_ms").agg(F.min("seq").alias("seq")))
    kept = greedy_kept(rows, keys, "ts_ms", F.lit(spacing_ms), width=600 * spacing_ms).alias("k")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in [*keys, "ts_ms"]]
    return rows.alias("r").join(kept, same, "left_semi").select(*keys, "ts_ms", "seq")
