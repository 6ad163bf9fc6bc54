"""Queries on a lake as it is run: late segments, states of segments, and answers from stored summaries."""

from pyspark.sql import functions as F

from ..operators import segments
from ..operators.summaries import DISTINCT_ERROR, RANK_ERROR
from ..session import scratch_path
from ..sources import lake as lakes
from ..sources import parts
from ..sources.wal import list_segments
from ..streaming.materialize import materialize_available, upkeep
from .catalog import query
from .derived_wal import encode_exports, write_segments
from .inputs import event_spans, event_spans_sql
from .trace_queries import _SUMMARY, _TOP, TRACE_ID

SPANS = f"WITH {event_spans_sql()}"


def _two_visits(spark, sf):
    """A folder of segments that is read twice. Before the first visit a third of the segments has not come and another
    third has only its first 100 records; the segments' names say nothing of that.
    """
    records = encode_exports(event_spans(spark, sf, keep_event_id=True), "event_id")
    files = records.select("source_file").distinct()
    turn = F.crc32("source_file") % 3
    first = records.where(turn != 0).where((turn == 1) | (F.col("position") % 2500 < 100))
    wal, lake = write_segments(first, "visits"), scratch_path(spark, "lake")
    materialize_available(spark, wal, lake)
    write_segments(records, "visits", wal)
    materialize_available(spark, wal, lake)
    return wal, lake, files


@query("late_segments", f"{SPANS} SELECT source_file, count(*) AS span_count, count(DISTINCT span_id) AS distinct_spans, true AS is_fully_read FROM spans GROUP BY source_file")
def _(spark, sf):
    wal, lake, _ = _two_visits(spark, sf)
    progress = segments.segment_progress(list_segments(spark, wal), lakes.read_offsets(spark, lake), lakes.corruptions(spark, lake))
    stored = lakes.committed_spans(spark, lake).groupBy("source_file").agg(F.count(F.lit(1)).alias("span_count"), F.count_distinct("span_id").alias("distinct_spans"))
    read = progress.select(F.col("filename").alias("source_file"), "is_fully_read")
    return stored.join(read, "source_file").select("source_file", "span_count", "distinct_spans", "is_fully_read")


_STATES_SQL = f"""{SPANS}, names AS (SELECT DISTINCT source_file AS filename FROM spans),
    keyed AS (SELECT *, try_cast(regexp_extract(filename, '^wal-(\\d+)-(\\d+)\\.wal$', 1) AS bigint) AS a,
      try_cast(regexp_extract(filename, '^wal-(\\d+)-(\\d+)\\.wal$', 2) AS bigint) AS b FROM names),
    ranked AS (SELECT *, row_number() OVER (ORDER BY coalesce(a, 0) DESC, coalesce(b, 0) DESC, filename DESC) AS age FROM keyed)"""


@query(
    "segment_states",
    f"""{_STATES_SQL}, damage AS (SELECT DISTINCT source_file AS filename FROM spans WHERE event_id % 97 = 5)
    SELECT filename, CASE WHEN filename IN (SELECT filename FROM damage) THEN 'QUARANTINED' WHEN age = 1 THEN 'ACTIVE'
      WHEN age % 2 = 0 THEN 'DELETED' ELSE 'MATERIALIZED' END AS status FROM ranked""",
)
def _(spark, sf):
    """What runs logged, after every other segment that could go went."""
    records = encode_exports(event_spans(spark, sf, keep_event_id=True), "event_id")
    # damage in whole segments of an event that the SQL can name
    damaged = records.withColumn("fault", F.when(F.col("position") % 97 == 5, "crc"))
    wal, lake = write_segments(damaged, "states"), scratch_path(spark, "lake")
    materialize_available(spark, wal, lake)
    progress = segments.segment_progress(list_segments(spark, wal), lakes.read_offsets(spark, lake), lakes.corruptions(spark, lake))
    ordered = sorted(progress.collect(), key=lambda r: (r.seg_nanos, r.seg_seq, r.filename), reverse=True)
    lakes._remove(spark, [f"{wal}/{r.filename}" for age, r in enumerate(ordered, 1) if r.is_deletable and age % 2 == 0])
    upkeep(spark, wal, lake)
    return segments.segment_lifecycle(lakes.segment_changes(spark, lake)).select("filename", "status")


def _summarised_lake(spark, sf):
    """Two commits with summaries, one without."""
    lake = scratch_path(spark, "lake")
    spans = event_spans(spark, sf, keep_event_id=True)
    for part in range(3):
        lakes.append_spans(spans.where(F.col("event_id") % 3 == part).drop("event_id"), lake, f"batch-{part:012d}")
        if part == 1:
            parts.compact_and_summarise(spark, lake)
    return lake


@query("lake_recent_traces", f"{SPANS} {_SUMMARY} {_TOP} 100")
def _(spark, sf):
    return parts.recent_traces(spark, _summarised_lake(spark, sf))


@query("lake_recent_traces_of_service", f"{SPANS} {_SUMMARY} WHERE project_id = 'proj-1' AND service_name = 'svc-2' {_TOP} 20")
def _(spark, sf):
    return parts.recent_traces(spark, _summarised_lake(spark, sf), "proj-1", "svc-2", 20)


@query("lake_trace_lookup", f"{SPANS} SELECT * EXCLUDE (event_id) FROM spans WHERE trace_id = '{TRACE_ID}' ORDER BY start_time_unix_nano, span_id")
def _(spark, sf):
    return parts.lake_trace(spark, _summarised_lake(spark, sf), TRACE_ID)


_RANGE_SQL = f"""bounds AS (SELECT min(start_time_unix_nano) AS low, max(start_time_unix_nano) AS high FROM spans WHERE trace_id = '{TRACE_ID}')"""


@query(
    "lake_trace_in_range",
    f"""{SPANS}, {_RANGE_SQL} SELECT spans.* EXCLUDE (event_id) FROM spans, bounds WHERE trace_id = '{TRACE_ID}'
    AND start_time_unix_nano >= low + (high - low) // 4 AND start_time_unix_nano < low + (high - low) // 4 * 3 ORDER BY start_time_unix_nano, span_id""",
)
def _(spark, sf):
    lake = _summarised_lake(spark, sf)
    low, high = parts.lake_trace(spark, lake, TRACE_ID).agg(F.min("start_time_unix_nano"), F.max("start_time_unix_nano")).first()
    return parts.lake_trace(spark, lake, TRACE_ID, since=low + (high - low) // 4, until=low + (high - low) // 4 * 3)


@query(
    "lake_model_sketches",
    f"""{SPANS}, asked AS (SELECT *, json_extract_string(attributes_json, '$."gen_ai.request.model"') AS model FROM spans)
    SELECT model, count(*) AS request_count, count(*) FILTER (status_code = 2) AS error_count, cast(sum(duration_ns) AS double) / count(*) / 1e6 AS avg_latency_ms,
      true AS p95_within_bound FROM asked WHERE model IS NOT NULL GROUP BY model""",
)
def _(spark, sf):
    """The rank of the sketch's percentile among the latencies lies within the sketch's error."""
    lake = _summarised_lake(spark, sf)
    models = parts.lake_models(spark, lake)
    spans = lakes.lake_spans(spark, lake).select(F.col("gen_ai_model").alias("model"), "duration_ns").where("model IS NOT NULL")
    ranked = spans.join(models.select("model", "p95_latency_ms"), "model").groupBy("model").agg(
        (F.count_if(F.col("duration_ns") / F.lit(1e6) < F.col("p95_latency_ms")) / F.count(F.lit(1))).alias("low"),
        (F.count_if(F.col("duration_ns") / F.lit(1e6) <= F.col("p95_latency_ms")) / F.count(F.lit(1))).alias("high"),
    )
    within = (F.col("low") <= 0.95 + RANK_ERROR) & (F.col("high") >= 0.95 - RANK_ERROR)
    return models.join(ranked, "model").select("model", "request_count", "error_count", "avg_latency_ms", within.alias("p95_within_bound"))


@query(
    "lake_sketch_totals",
    f"""{SPANS} SELECT count(*) AS span_count, count(*) FILTER (status_code = 2) AS error_count, true AS traces_within_bound, true AS percentiles_within_bound FROM spans""",
)
def _(spark, sf):
    lake = _summarised_lake(spark, sf)
    totals = parts.lake_totals(spark, lake)
    spans = lakes.lake_spans(spark, lake).select("trace_id", "duration_ns")
    names = {"p50_ns": 0.5, "p95_ns": 0.95, "p99_ns": 0.99}
    held = spans.crossJoin(F.broadcast(totals)).groupBy("span_count", "error_count", "distinct_traces").agg(
        F.count_distinct("trace_id").alias("n_traces"),
        *[(F.count_if(F.col("duration_ns") < F.col(n)) / F.count(F.lit(1))).alias(f"below_{n}") for n in names],
        *[(F.count_if(F.col("duration_ns") <= F.col(n)) / F.count(F.lit(1))).alias(f"upto_{n}") for n in names],
    )
    within = F.lit(True)
    for n, p in names.items():
        within = within & (F.col(f"below_{n}") <= p + RANK_ERROR) & (F.col(f"upto_{n}") >= p - RANK_ERROR)
    near = F.abs(F.col("distinct_traces") - F.col("n_traces")) <= F.col("n_traces") * DISTINCT_ERROR
    return held.select("span_count", "error_count", near.alias("traces_within_bound"), within.alias("percentiles_within_bound"))
