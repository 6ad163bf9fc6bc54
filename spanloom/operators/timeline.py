"""Where spans and their events lie within a trace."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import events_array
from .ranks import join_aggregate
from .traces import trace_header

NARROWEST_BAR = 0.005  # fixed value: bars of very short spans stay visible


def waterfall(spans: DataFrame) -> DataFrame:
    """Offset and width of each span as shares of its trace's wall clock.

    The bounds come from an aggregation joined back, not from a window: the
    aggregate shrinks before the shuffle, and adaptive execution can split the
    rows of a very large trace in the join, where a window would sort them in
    one task.
    """
    bounds = trace_header(spans).select("trace_id", "min_start", "wall_clock_ns")
    relative = F.col("start_time_unix_nano") - F.col("min_start")
    wall = F.col("wall_clock_ns")
    offset = F.greatest(F.lit(0.0), F.least(F.lit(1.0), relative / wall))
    width = F.greatest(
        F.lit(NARROWEST_BAR), F.least(F.lit(1.0) - F.col("offset_ratio"), F.col("duration_ns") / wall)
    )
    return (
        join_aggregate(
            spans.select("trace_id", "span_id", "start_time_unix_nano", "duration_ns"), bounds, ["trace_id"]
        )
        .select("*", relative.alias("relative_start_ns"), offset.alias("offset_ratio"))
        .select(
            "trace_id",
            "span_id",
            "relative_start_ns",
            "offset_ratio",
            width.alias("width_ratio"),
            (F.col("offset_ratio") * 100).alias("offset_percent"),
            (width * 100).alias("width_percent"),
        )
    )


def event_timeline(spans: DataFrame) -> DataFrame:
    """One row per span event, its time relative to the span's start."""
    return spans.select(
        "trace_id",
        "span_id",
        "start_time_unix_nano",
        F.posexplode(events_array("events_json")).alias("event_index", "_event"),
    ).select(
        "trace_id",
        "span_id",
        F.col("event_index").cast("bigint").alias("event_index"),
        F.col("_event.name").alias("event_name"),
        (F.col("_event.time_unix_nano") - F.col("start_time_unix_nano")).alias("relative_time_ns"),
        F.col("_event.attributes").alias("attributes_json"),
    )
