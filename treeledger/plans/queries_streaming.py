"""Registered streaming queries: the events table is read as a stream, processed to its end, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..cluster import checkpoint_dir
from ..streaming import events as st
from . import fixtures_runs as fr
from .queries_runs import events_sql
from .registry import ORACLES, query


PARTS = 5


class _Streamed:
    """Stands in for a session whose `read.parquet` gives streams, so that fixtures serve both.

    The table is first written in several parts, one after another in time, and each is a micro-batch.
    """

    def __init__(self, spark):
        self.spark, self.read = spark, self

    def parquet(self, path):
        table = self.spark.read.parquet(path)
        folder = f"{checkpoint_dir(self.spark)}/stream-{uuid.uuid4()}/arrivals"
        # Ranges of the table, written by many tasks each; one job after another, so that their files differ in age.
        first, last = table.agg(F.min("event_id"), F.max("event_id")).first()
        first, last = first or 0, last or 0
        size = (last - first) // PARTS + 1
        for part in range(PARTS):
            arrived = table.where((F.col("event_id") - first).between(part * size, (part + 1) * size - 1))
            arrived.write.mode("append").parquet(folder)
        return self.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, table.rdd.getNumPartitions())).parquet(folder)


def _finish(spark, updates, keys):
    """Run an update-mode stream to the end of its input and give the newest row per key."""
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4()}"
    started = st.update_table(updates, f"{folder}/table", f"{folder}/state").trigger(availableNow=True).start()
    started.awaitTermination()
    return st.latest_rows(spark, f"{folder}/table", keys)


@query(
    "stream_run_counters",
    events_sql(
        """SELECT run_id, count(*) FILTER (kind = 'log' AND level = 'warn') AS warnings, count(*) FILTER ((kind = 'log' AND level = 'error') OR kind = 'error') AS errors,
        count(*) FILTER (outcome = 'ok') AS done, count(*) FILTER (outcome = 'kept') AS skipped, count(*) FILTER (outcome = 'failed') AS failed,
        count(*) FILTER (outcome = 'cancelled') AS cancelled, coalesce(sum(bytes) FILTER (outcome = 'ok'), 0)::BIGINT AS bytes_done FROM ev GROUP BY run_id"""
    ),
)
def stream_run_counters(spark, sf):
    return _finish(spark, st.run_counters(fr.run_events(_Streamed(spark), sf)), ["run_id"])


@query("stream_stage_states", ORACLES["stage_states"])
def stream_stage_states(spark, sf):
    return _finish(spark, st.stage_stream(fr.run_events(_Streamed(spark), sf)), ["run_id", "phase"])


@query(
    "stream_event_routing",
    events_sql(
        """SELECT run_id, artifact, count(*) AS lines FROM (SELECT run_id, unnest(CASE WHEN kind = 'progress' THEN [] WHEN kind = 'item_result' THEN ['items']
          WHEN kind = 'error' OR (kind = 'log' AND level <> 'info') THEN ['run', 'errors'] ELSE ['run'] END) AS artifact FROM ev) GROUP BY run_id, artifact"""
    ),
)
def stream_event_routing(spark, sf):
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4()}"
    writer = st.route_stream(fr.run_events(_Streamed(spark), sf), f"{folder}/logs", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.text(f"{folder}/logs").groupBy("run_id", "artifact").agg(F.count(F.lit(1)).alias("lines"))


@query("stream_routed_buckets", ORACLES["stream_event_routing"])
def stream_routed_buckets(spark, sf):
    """The routed stream in buckets with an index: what the index says, where the stored lines say the same."""
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4()}"
    writer = st.route_stream_buckets(fr.run_events(_Streamed(spark), sf), f"{folder}/logs", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    keys = ["run_id", "artifact"]
    index = spark.read.parquet(f"{folder}/logs/index").groupBy(*keys).agg(F.sum("lines").alias("lines"))
    stored = spark.read.parquet(f"{folder}/logs/lines").groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"))
    return index.join(stored, [*keys, "lines"])
