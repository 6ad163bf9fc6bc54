"""Summaries that lie beside the commits of the lake, and reads that open them in place of spans.

    <lake>/summaries/part=<id>/traces/start_date=<day>/bucket=<n>/   parts of traces, sorted by trace
    <lake>/summaries/part=<id>/sketches/                             sketches per day, project and model
    <lake>/covered/                                                  which part holds which commit

`summarise` covers commits that have no summaries yet, `compact_and_summarise` after a compaction. A part counts once `covered` names it, so what a crash leaves behind is never read.
Commits that are not covered, the latest micro-batches as a rule, are summarised from their
spans when asked: results are the same, whatever is covered.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import day_of
from ..operators.filters import checked_limit, scoped
from ..operators.summaries import bucket_of, models_of_sketches, sketch_parts, summaries_of_parts, totals_of_sketches, trace_parts
from ..operators.traces import trace_detail
from .lake import _appended, _commit_rows, compact, live_commits

_COVERED = "part string, commit string"
_TRACES = "trace_id string, project_id string, service_name string, commit string, first_start long, last_end long, duration_ns long, span_count long, error_count long, start_date date, bucket int"
_SKETCHES = (
    "commit string, start_date date, project_id string, model string, span_count long, llm_count long, input_tokens long, "
    "output_tokens long, duration_ns decimal(38,0), error_count long, latencies binary, traces binary"
)
#: Traces looked at beyond those asked for; when too few of these are certain the window of days widens.
MORE = 200


def covered(spark: SparkSession, lake: str) -> dict[str, str]:
    """Part by commit, of the live commits that have summaries."""
    rows = _appended(spark, f"{lake}/covered", _COVERED).collect()
    return {row.commit: row.part for row in rows}


def _spans_of(spark: SparkSession, lake: str, commits: list[str]) -> DataFrame:
    return _commit_rows(spark, lake, commits)


def summarise(spark: SparkSession, lake: str) -> int:
    """Write the summaries of live commits that have none. Returns how many commits these are. One at a time per lake."""
    known = covered(spark, lake)
    todo = [name for name in live_commits(spark, lake) if name not in known]
    if not todo:
        return 0
    part, spans = uuid.uuid4().hex, _spans_of(spark, lake, todo)
    path = f"{lake}/summaries/part={part}"
    traces = trace_parts(spans).repartition("start_date", "bucket").sortWithinPartitions("start_date", "bucket", "trace_id")
    traces.write.partitionBy("start_date", "bucket").option("compression", "zstd").parquet(f"{path}/traces")
    sketch_parts(spans).coalesce(1).write.option("compression", "zstd").parquet(f"{path}/sketches")
    spark.createDataFrame([(part, name) for name in todo], _COVERED).coalesce(1).write.mode("append").parquet(f"{lake}/covered")
    return len(todo)


def compact_and_summarise(spark: SparkSession, lake: str, **options) -> int:
    """A compaction, and summaries of what it leaves. Returns the rows rewritten."""
    rows = compact(spark, lake, **options)
    summarise(spark, lake)
    return rows


def _stored(spark: SparkSession, lake: str, kind: str, schema: str, known: dict[str, str], live: list[str]) -> DataFrame:
    """Rows of the parts of live commits."""
    folders = sorted({known[name] for name in live if name in known})
    if not folders:
        return spark.createDataFrame([], schema)
    every = None
    for part in folders:  # compaction keeps them few
        path = f"{lake}/summaries/part={part}/{kind}"
        rows = spark.read.schema(schema).option("basePath", path).parquet(path)
        every = rows if every is None else every.unionByName(rows)
    names = spark.createDataFrame([(name,) for name in live], "commit string")
    return every.join(names, "commit", "left_semi")


def lake_trace_parts(spark: SparkSession, lake: str, first_day: date | None = None, last_day: date | None = None, trace_ids: list[str] | None = None) -> DataFrame:
    """Parts of traces, of these days and ids only if given: stored ones by folder, those of commits without summaries from their spans."""
    known, live = covered(spark, lake), live_commits(spark, lake)
    stored = _stored(spark, lake, "traces", _TRACES, known, live)
    fresh = _spans_of(spark, lake, [name for name in live if name not in known])

    def asked(rows):
        for day, inside in ((first_day, F.col("start_date") >= F.lit(first_day)), (last_day, F.col("start_date") <= F.lit(last_day))):
            rows = rows if day is None else rows.where(inside)
        return rows if trace_ids is None else rows.where(F.col("trace_id").isin(trace_ids))

    if trace_ids is not None and trace_ids:
        ids = spark.createDataFrame([(i,) for i in trace_ids], "id string")
        wanted = [row.bucket for row in ids.select(bucket_of("id").alias("bucket")).distinct().collect()]
        stored = stored.where(F.col("bucket").isin(wanted))
    columns = [field.split()[0] for field in _TRACES.split(", ")]
    return asked(stored).select(*columns).unionByName(trace_parts(asked(fresh)).select(*columns))


def lake_sketches(spark: SparkSession, lake: str, project_id: str | None = None) -> DataFrame:
    known, live = covered(spark, lake), live_commits(spark, lake)
    stored = _stored(spark, lake, "sketches", _SKETCHES, known, live)
    fresh = [name for name in live if name not in known]
    if fresh:
        stored = stored.unionByName(sketch_parts(_spans_of(spark, lake, fresh)))
    return scoped(stored, project_id)


def lake_models(spark: SparkSession, lake: str, project_id: str | None = None) -> DataFrame:
    """model_analytics without reading spans of covered commits."""
    return models_of_sketches(lake_sketches(spark, lake, project_id))


def lake_totals(spark: SparkSession, lake: str, project_id: str | None = None) -> DataFrame:
    """Spans, errors, distinct traces and latency percentiles without reading spans of covered commits."""
    return totals_of_sketches(lake_sketches(spark, lake, project_id))


def lake_trace(spark: SparkSession, lake: str, trace_id: str, project_id: str | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    """trace_detail that opens the days of this trace alone, in the commits that hold it; commits without summaries are looked through."""
    known, live = covered(spark, lake), live_commits(spark, lake)
    day = lambda nanos: None if nanos is None else spark.range(1).select(day_of(F.lit(nanos))).first()[0]
    stored = _stored(spark, lake, "traces", _TRACES, known, live).where((F.col("bucket") == bucket_of(F.lit(trace_id))) & (F.col("trace_id") == F.lit(trace_id)))
    for bound, inside in ((since, lambda d: F.col("start_date") >= F.lit(d)), (until, lambda d: F.col("start_date") <= F.lit(d))):
        if bound is not None:
            stored = stored.where(inside(day(bound)))
    places = [f"commit={row.commit}/start_date={row.start_date}" for row in scoped(stored, project_id).select("commit", "start_date").distinct().collect()]
    places += [f"commit={name}" for name in live if name not in known]
    root = f"{lake}/spans"
    if not places:
        return trace_detail(_commit_rows(spark, lake, []), trace_id)
    rows = spark.read.schema(_commit_rows(spark, lake, []).schema).option("basePath", root).parquet(*[f"{root}/{place}" for place in sorted(places)])
    return trace_detail(rows, trace_id, project_id, since, until)


def recent_traces(spark: SparkSession, lake: str, project_id: str | None = None, service: str | None = None, limit: int = 100) -> DataFrame:
    """trace_list from the parts of traces, reading days from the newest until enough traces are certain.

    A trace is certain when it has no part (of the project and service asked for) before the days read: then its start is known, and every
    trace not seen starts earlier. Only the traces at the head of the list are looked
    up in older days. The window of days doubles until `limit` are certain or all days are read.
    """
    limit = checked_limit(limit)
    days = [row.start_date for row in lake_trace_parts(spark, lake).select("start_date").distinct().orderBy(F.desc("start_date")).collect()]
    window = 1
    while days:
        first = days[min(window, len(days)) - 1]
        parts = scoped(lake_trace_parts(spark, lake, first_day=first), project_id, service)
        seen = parts.groupBy("trace_id").agg(F.min("first_start").alias("start")).orderBy(F.desc("start"), "trace_id").limit(limit + MORE)
        ids = [row.trace_id for row in seen.select("trace_id").collect()]
        older = set()
        if window < len(days) and ids:
            before = scoped(lake_trace_parts(spark, lake, last_day=days[window], trace_ids=ids), project_id, service)
            older = {row.trace_id for row in before.select("trace_id").distinct().collect()}
        certain = [i for i in ids if i not in older][:limit]
        if len(certain) == limit or window >= len(days):
            return summaries_of_parts(parts.where(F.col("trace_id").isin(certain))).orderBy(F.desc("start_time_unix_nano"), "trace_id").limit(limit)
        window *= 2
    return summaries_of_parts(lake_trace_parts(spark, lake)).limit(0)
