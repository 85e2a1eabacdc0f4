"""Streaming queries: each drains the files at hand and returns what the sink got."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.scratch import scratch
from ..sources.views import with_views
from ..streaming import clips
from .registry import query, rounded

_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@query("SELECT event_id, round(1.0 / value, 9) AS disparity FROM events WHERE value > 5 AND value < 400")
def stream_clip_ingest(spark, sf_dir):
    """One pass of the stateless sample pipeline over the files of a folder."""
    out = scratch(spark, "ingest")
    stream = clips.read_stream(spark, f"{sf_dir}/events.parquet*", _SCHEMA)
    kept = clips.select_valid(stream, 5.0, 400.0).select("event_id", F.round("disparity", 9).alias("disparity"))
    clips.run_once(kept, f"{out}/checkpoint", f"{out}/table")
    return spark.read.schema(kept.schema).parquet(f"{out}/table")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_cache_sink(spark, sf_dir):
    """An idempotent cache sink, fed twice with the same keys."""
    out = scratch(spark, "cache")
    latest = spark.read.schema(_SCHEMA).parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    latest.write.parquet(f"{out}/in")
    stream = clips.read_stream(spark, f"{out}/in", "user_id bigint, event_id bigint")
    for i in range(2):
        clips.cache_sink(stream, f"{out}/checkpoint{i}", f"{out}/table", ["user_id"])
    return spark.read.schema("user_id bigint, event_id bigint").parquet(f"{out}/table")


@query("SELECT user_id, count(*) // 8 AS clips, count(*) AS frames FROM events GROUP BY user_id")
def stream_stateful_cursor(spark, sf_dir):
    """Clips emitted per scene, with the position as state."""
    place = scratch(spark, "cursor")
    stream = clips.read_stream(spark, f"{sf_dir}/events.parquet*", _SCHEMA).select("user_id", "event_id")
    out = clips.clip_cursor(stream, "user_id", 8)
    clips.update_sink(out, f"{place}/checkpoint", f"{place}/table")
    return spark.read.schema(out.schema).parquet(f"{place}/table").groupBy("user_id").agg(F.max("clips").alias("clips"), F.max("frames").alias("frames"))
