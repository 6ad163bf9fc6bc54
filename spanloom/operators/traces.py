"""Trace list, trace detail and the summaries shown around them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import duration_label, status_badge
from ..functions.times import day_of
from ..schema import SPAN
from .filters import all_of, checked_limit, equals, is_error, scoped


def _service_set():
    # collect_set skips NULLs, and its partial buffers hold each name once
    return F.sort_array(F.array_remove(F.collect_set("service_name"), ""))


def trace_summaries(spans: DataFrame) -> DataFrame:
    """One row per trace, unsorted."""
    return spans.groupBy("trace_id").agg(
        F.min("start_time_unix_nano").alias("start_time_unix_nano"),
        F.max("end_time_unix_nano").alias("end_time_unix_nano"),
        (F.max("end_time_unix_nano") - F.min("start_time_unix_nano")).alias("wall_clock_duration_ns"),
        F.sum("duration_ns").alias("aggregate_span_duration_ns"),
        F.count(F.lit(1)).alias("span_count"),
        F.max("service_name").alias("service_name"),
        _service_set().alias("services"),
        F.max("project_id").alias("project_id"),
        F.count_if(is_error()).alias("error_count"),
    )


def trace_list(spans: DataFrame, project_id=None, service=None, limit=100) -> DataFrame:
    """The most recently started traces.

    First the listed traces are found from ids and start times alone, with
    fixed-width aggregation buffers. Only their spans are then summarised: none
    of them starts before the earliest listed trace, so the bound on the start
    time reaches the Parquet scan and skips almost all of a lake; with the lake's
    start_date among the columns (lake_spans(..., keep_day=True)) it prunes the
    folders of earlier days as well. The list of ids is broadcast; limit bounds
    it to 1000.
    """
    limit = checked_limit(limit)
    rows = scoped(spans, project_id, service)
    listed = (
        rows.groupBy("trace_id")
        .agg(F.min("start_time_unix_nano").alias("_started"))
        .orderBy(F.desc("_started"), "trace_id")
        .limit(limit)
    )
    earliest = listed.agg(F.min("_started")).scalar()
    recent = rows.where(F.col("start_time_unix_nano") >= earliest)
    if "start_date" in rows.columns:
        recent = recent.where(F.col("start_date") >= listed.agg(day_of(F.min("_started"))).scalar())
    return (
        trace_summaries(recent.join(F.broadcast(listed.select("trace_id")), "trace_id", "left_semi"))
        .orderBy(F.desc("start_time_unix_nano"), "trace_id")
        .limit(limit)
    )


def between(spans: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """Spans that start from `since` to before `until`, in nanoseconds; days are compared as well where the rows have them, which prunes folders."""
    start = F.col("start_time_unix_nano")
    limits = [None if since is None else start >= F.lit(since), None if until is None else start < F.lit(until)]
    if "start_date" in spans.columns:
        day = F.col("start_date")
        limits += [None if since is None else day >= day_of(F.lit(since)), None if until is None else day <= day_of(F.lit(until))]
    return spans.where(all_of(*limits))


def trace_detail(spans: DataFrame, trace_id: str, project_id=None, since: int | None = None, until: int | None = None) -> DataFrame:
    """All spans of one trace by start time, or those that start within a time range; no rows when there is no such trace."""
    # the id is compared even when empty: spans may carry an empty trace id
    return (
        between(spans, since, until)
        .where(all_of(F.col("trace_id") == F.lit(trace_id), equals("project_id", project_id)))
        .select(*SPAN.fieldNames())
        .orderBy("start_time_unix_nano", "span_id")
    )


def trace_header(spans: DataFrame) -> DataFrame:
    """Bounds and totals per trace as the trace screen shows them.

    The wall clock is at least one nanosecond here, so that it can divide.
    """
    return spans.groupBy("trace_id").agg(
        F.min("start_time_unix_nano").alias("min_start"),
        F.max("end_time_unix_nano").alias("max_end"),
        F.greatest(
            F.max("end_time_unix_nano") - F.min("start_time_unix_nano"), F.lit(1).cast("bigint")
        ).alias("wall_clock_ns"),
        F.sum("duration_ns").alias("aggregate_ns"),
        F.count_if(is_error()).alias("error_count"),
        _service_set().alias("services"),
    )


def trace_rows(traces: DataFrame) -> DataFrame:
    """Display columns of listed traces."""
    return traces.select(
        "trace_id",
        F.when(F.col("trace_id") == "", "(missing trace id)").otherwise(F.col("trace_id")).alias("trace_label"),
        F.when(F.size("services") > 0, F.col("services"))
        .otherwise(F.array(F.coalesce("service_name", F.lit("unknown"))))
        .alias("service_labels"),
        "span_count",
        duration_label(F.coalesce("wall_clock_duration_ns", "aggregate_span_duration_ns")).alias("duration"),
        status_badge(F.coalesce("error_count", F.lit(0))).alias("status"),
    )


def dashboard_totals(traces: DataFrame) -> DataFrame:
    """Totals over the listed traces."""
    return traces.agg(
        F.count(F.lit(1)).alias("trace_count"),
        F.coalesce(F.sum("span_count"), F.lit(0)).alias("total_spans"),
        F.coalesce(F.sum("error_count"), F.lit(0)).alias("total_errors"),
    )


def trace_verification(expected: DataFrame, spans: DataFrame) -> DataFrame:
    """Flag each expected trace id by whether any of its spans has arrived."""
    asked = spans.select("trace_id").join(expected.select("trace_id"), "trace_id", "left_semi")
    found = asked.distinct().withColumn("_found", F.lit(True))
    return expected.join(found, "trace_id", "left").select(
        *expected.columns, F.col("_found").isNotNull().alias("verified")
    )
