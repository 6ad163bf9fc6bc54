"""Queries on segments, decoding, the lake, its status, and ingest validation."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..functions.times import day_of
from ..operators import ingest, lakefiles, segments
from ..session import scratch_path
from ..sources import lake as lakes
from ..sources.otlp import decode_exports, inspect_exports, normalize_spans
from ..sources.wal import list_segments, read_wal
from ..streaming.materialize import materialize_available, system_status
from .catalog import query
from .derived_wal import encode_exports, encode_grouped_exports, write_segments
from .inputs import PROJECT_KEYS, event_spans, event_spans_sql, nested_spans, nested_spans_sql, table

SPANS = f"WITH {event_spans_sql()}"

# --- segments ---------------------------------------------------------------

# Text records: their bytes are known to SQL, so offsets can be checked.
_RECORDS = {
    "source_file": "concat('wal-', cast(1 + event_id {d} 500 AS {s}), '-', cast(event_id {d} 500 % 3 AS {s}), '.wal')",
    "position": "event_id % 500",
    "body": "concat(event_type, ' ', props, ' ', cast(event_id AS {s}))",
    # one fault in some of the segments, none of them in the first record
    "fault": (
        "CASE WHEN event_id % 500 <> 100 + event_id {d} 500 THEN NULL "
        "WHEN event_id {d} 500 % 5 = 0 THEN 'crc' WHEN event_id {d} 500 % 5 = 1 THEN 'zero' "
        "WHEN event_id {d} 500 % 5 = 2 THEN 'long' WHEN event_id {d} 500 % 5 = 3 THEN 'cut' END"
    ),
}


def _records(dialect):
    return ", ".join(
        f"{text.format(d=dialect[0], s=dialect[1])} AS {name}" for name, text in _RECORDS.items()
    )


_FRAMES = f"""WITH records AS (SELECT {_records(('//', 'varchar'))} FROM events),
    placed AS (SELECT *, 8 + octet_length(encode(body)) AS size,
      coalesce(cast(sum(8 + octet_length(encode(body))) OVER (PARTITION BY source_file ORDER BY position
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bigint), 0) AS source_offset,
      count(fault) OVER (PARTITION BY source_file ORDER BY position) AS faults FROM records)"""


def _text_segments(spark, sf, faulty):
    records = table(spark, sf, "events").selectExpr(
        *[f"{text.format(d='div', s='string')} AS {name}" for name, text in _RECORDS.items()]
    )
    records = records.withColumn("payload", F.col("body").cast("binary"))
    return write_segments(records if faulty else records.drop("fault"), "segments")


@query(
    "wal_frames",
    f"{_FRAMES} SELECT source_file, source_offset, source_offset + size AS end_offset, body FROM placed",
)
def _(spark, sf):
    frames = read_wal(spark, _text_segments(spark, sf, faulty=False))
    return frames.select("source_file", "source_offset", "end_offset", F.col("payload").cast("string").alias("body"))


@query(
    "wal_frames_before_damage",
    f"{_FRAMES} SELECT source_file, source_offset, source_offset + size AS end_offset, body FROM placed WHERE faults = 0",
)
def _(spark, sf):
    frames = read_wal(spark, _text_segments(spark, sf, faulty=True), strict=True)
    return frames.where("corrupt_reason IS NULL").select(
        "source_file", "source_offset", "end_offset", F.col("payload").cast("string").alias("body")
    )


@query(
    "wal_corruptions",
    f"""{_FRAMES} SELECT source_file, source_offset, CASE fault WHEN 'crc' THEN 'WAL checksum mismatch'
      WHEN 'zero' THEN 'invalid zero-length record' WHEN 'long' THEN 'oversized WAL record'
      ELSE 'truncated WAL payload' END AS reason FROM placed WHERE faults = 1 AND fault IS NOT NULL""",
)
def _(spark, sf):
    frames = read_wal(spark, _text_segments(spark, sf, faulty=True), strict=True)
    return frames.where("corrupt_reason IS NOT NULL").select(
        "source_file", "source_offset", F.substring_index("corrupt_reason", ":", 1).alias("reason")
    )


_SEGMENTS = """segments AS (SELECT source_file AS filename, 100 * (max(source_offset) // 100 + 1) AS size_bytes
      FROM spans GROUP BY source_file),
    keyed AS (SELECT *, coalesce(try_cast(regexp_extract(filename, '^wal-(\\d+)-(\\d+)\\.wal$', 1) AS bigint), 0) AS seg_nanos,
      coalesce(try_cast(regexp_extract(filename, '^wal-(\\d+)-(\\d+)\\.wal$', 2) AS bigint), 0) AS seg_seq FROM segments),
    ordered AS (SELECT *, row_number() OVER (ORDER BY seg_nanos DESC, seg_seq DESC, filename DESC) = 1 AS is_active FROM keyed),
    offsets AS (SELECT filename AS source_file, CASE WHEN is_active THEN size_bytes // 200 * 100 ELSE size_bytes END AS max_offset FROM ordered),
    corruptions AS (SELECT row_number() OVER (ORDER BY source_file, source_offset, span_id) AS id, source_file, source_offset,
      'WAL checksum mismatch' AS reason FROM spans WHERE status_code = 2 AND source_offset % 50000 = 0)"""


def _segment_files(spark, sf):
    return (
        event_spans(spark, sf)
        .groupBy(F.col("source_file").alias("filename"))
        .agg((F.call_function("div", F.max("source_offset"), F.lit(100)) * 100 + 100).alias("size_bytes"))
    )


def _offsets(spark, sf):
    half = F.call_function("div", F.col("size_bytes"), F.lit(200)) * 100
    return segments.ordered_segments(_segment_files(spark, sf)).select(
        F.col("filename").alias("source_file"),
        F.when(F.col("is_active"), half).otherwise(F.col("size_bytes")).alias("max_offset"),
    )


def _corruptions(spark, sf):
    return (
        event_spans(spark, sf)
        .where("status_code = 2 AND source_offset % 50000 = 0")
        .select("source_file", "source_offset", "span_id", F.lit("WAL checksum mismatch").alias("reason"))
    )


@query(
    "wal_segments",
    f"""{SPANS}, {_SEGMENTS} SELECT o.filename, size_bytes, seg_nanos, seg_seq, is_active, max_offset AS read_bytes,
      max_offset >= size_bytes AS is_fully_read,
      EXISTS (SELECT 1 FROM corruptions c WHERE c.source_file = o.filename) AS is_quarantined,
      max_offset >= size_bytes AND NOT is_active
        AND NOT EXISTS (SELECT 1 FROM corruptions c WHERE c.source_file = o.filename) AS is_deletable
    FROM ordered o JOIN offsets f ON f.source_file = o.filename""",
)
def _(spark, sf):
    return segments.segment_progress(_segment_files(spark, sf), _offsets(spark, sf), _corruptions(spark, sf))


@query(
    "wal_pending",
    f"""{SPANS}, {_SEGMENTS} SELECT o.filename, max_offset AS start_offset, size_bytes
    FROM ordered o JOIN offsets f ON f.source_file = o.filename
    WHERE size_bytes > max_offset AND NOT EXISTS (SELECT 1 FROM corruptions c WHERE c.source_file = o.filename)""",
)
def _(spark, sf):
    return segments.pending_segments(_segment_files(spark, sf), _offsets(spark, sf), _corruptions(spark, sf))


@query(
    "wal_offsets",
    f"""{SPANS}, {_SEGMENTS}, progress AS (SELECT source_file, max(source_offset) + 100 AS max_offset FROM spans
      WHERE status_code = 1 GROUP BY source_file)
    SELECT source_file, max(max_offset) AS max_offset
    FROM (SELECT source_file, max_offset // 2 AS max_offset FROM offsets UNION ALL SELECT * FROM progress) GROUP BY source_file""",
)
def _(spark, sf):
    known = _offsets(spark, sf).withColumn("max_offset", F.call_function("div", F.col("max_offset"), F.lit(2)))
    progress = (
        event_spans(spark, sf)
        .where("status_code = 1")
        .groupBy("source_file")
        .agg((F.max("source_offset") + 100).alias("max_offset"))
    )
    return segments.merged_offsets(known, progress)


@query(
    "segment_lifecycle",
    f"""{SPANS}, changes AS (SELECT source_file AS filename,
        CASE WHEN source_offset % 3 = 0 THEN 'SEALED' WHEN source_offset % 3 = 1 THEN 'DELETED' ELSE 'QUARANTINED' END AS status,
        source_offset AS bytes_size, event_id AS sequence FROM spans WHERE status_code = 2)
    SELECT filename, arg_max(status, sequence) AS status, arg_max(bytes_size, sequence) AS bytes_size FROM changes GROUP BY filename""",
)
def _(spark, sf):
    changes = event_spans(spark, sf, keep_event_id=True).where("status_code = 2").selectExpr(
        "source_file AS filename",
        "CASE WHEN source_offset % 3 = 0 THEN 'SEALED' WHEN source_offset % 3 = 1 THEN 'DELETED' ELSE 'QUARANTINED' END AS status",
        "source_offset AS bytes_size",
        "event_id AS sequence",
    )
    return segments.segment_lifecycle(changes)


@query("dedupe_replay", f"{SPANS} SELECT * EXCLUDE (event_id) FROM spans")
def _(spark, sf):
    spans = event_spans(spark, sf)
    return segments.dedupe_replay(spans.unionByName(spans.where("source_offset >= 100000")))


# --- decoding ---------------------------------------------------------------

_DECODED_COLUMNS = """trace_id, span_id, nullif(parent_span_id, '') AS parent_span_id, name, kind,
      nullif(service_name, '') AS service_name, project_id, start_time_unix_nano, end_time_unix_nano, duration_ns,
      status_code, status_message, scope_name, scope_version, trace_state, flags, resource_attributes_json,
      attributes_json, events_json, links_json, dropped_attributes_count, dropped_events_count,
      dropped_links_count, source_file"""


def export_segments(spark, sf):
    return write_segments(encode_exports(event_spans(spark, sf, keep_event_id=True), "event_id"), "exports")


@query("normalize_spans", f"{SPANS} SELECT {_DECODED_COLUMNS} FROM spans")
def _(spark, sf):
    # offsets depend on encoded sizes, which plain SQL cannot tell
    return normalize_spans(read_wal(spark, export_segments(spark, sf))).drop("source_offset")


@query("normalize_nested", f"{SPANS}, {nested_spans_sql()} SELECT {_DECODED_COLUMNS} FROM nested")
def _(spark, sf):
    """Exports of several resources, scopes and spans; key lists, bytes, unset and repeated keys; projects at all four places."""
    records = encode_grouped_exports(nested_spans(spark, sf), "event_id", 7)
    return normalize_spans(read_wal(spark, write_segments(records, "nested")), PROJECT_KEYS).drop("source_offset")


@query(
    "otlp_decode",
    f"""{SPANS} SELECT source_file, nullif(service_name, '') AS service_name, project_id, resource_attributes_json,
      count(*) AS export_count, count(*) AS resource_count, count(*) AS span_count,
      cast(sum(length(attributes_json)) AS bigint) AS attribute_chars
    FROM spans GROUP BY ALL""",
)
def _(spark, sf):
    decoded = decode_exports(read_wal(spark, export_segments(spark, sf)))
    resource = decoded.select("source_file", "source_offset", F.explode("resource_spans").alias("r"))
    scopes = resource.select("*", F.explode("r.scope_spans").alias("s"))
    return scopes.groupBy("source_file", "r.service_name", "r.project_id", "r.resource_attributes_json").agg(
        F.count_distinct("source_offset").alias("export_count"),
        F.count(F.lit(1)).alias("resource_count"),
        F.sum(F.size("s.spans")).alias("span_count"),
        F.sum(
            F.aggregate("s.spans", F.lit(0).cast("bigint"), lambda n, p: n + F.length(p["attributes_json"]))
        ).alias("attribute_chars"),
    )


# --- lake -------------------------------------------------------------------


@query("materialize", f"{SPANS} SELECT {_DECODED_COLUMNS} FROM spans")
def _(spark, sf):
    wal, lake = export_segments(spark, sf), scratch_path(spark, "lake")
    materialize_available(spark, wal, lake)
    return lakes.committed_spans(spark, lake).drop("source_offset")


def _lake_of_three(spark, sf):
    lake = scratch_path(spark, "lake")
    spans = event_spans(spark, sf, keep_event_id=True)
    for part in range(3):
        rows = spans.where(F.col("event_id") % 3 == part).drop("event_id")
        lakes.append_spans(rows, lake, f"batch-{part:012d}")
    # written but never published: must stay invisible
    lakes.write_commit(spans.where("event_id % 5 = 0").drop("event_id"), lake, "batch-unfinished", spread=True)
    return lake


@query("committed_spans", f"{SPANS} SELECT * EXCLUDE (event_id) FROM spans")
def _(spark, sf):
    return lakes.committed_spans(spark, _lake_of_three(spark, sf))


@query(
    "compact",
    f"""{SPANS}, days AS (SELECT cast(make_timestamp(start_time_unix_nano // 1000) AS date) AS start_date, count(*) AS span_count,
      count(DISTINCT trace_id) AS trace_count, cast(sum(duration_ns) AS bigint) AS duration_ns FROM spans GROUP BY 1)
    SELECT *, (SELECT count(*) FROM spans) AS rows_rewritten, 1 AS live_commits FROM days""",
)
def _(spark, sf):
    lake = _lake_of_three(spark, sf)
    rewritten = lakes.compact(spark, lake)
    manifest = lakefiles.current_manifest(lakes.manifest_log(spark, lake))
    live = manifest.where("status = 'COMMITTED'").count()
    return (
        lakes.committed_spans(spark, lake)
        .groupBy(day_of("start_time_unix_nano").alias("start_date"))
        .agg(
            F.count(F.lit(1)).alias("span_count"),
            F.count_distinct("trace_id").alias("trace_count"),
            F.sum("duration_ns").alias("duration_ns"),
        )
        .withColumns({"rows_rewritten": F.lit(rewritten).cast("bigint"), "live_commits": F.lit(live)})
    )


# Listing and manifest of a lake with one file per day: the first three days are
# compacted, some days left a temporary, an uncommitted or a lost file behind.
_DAY = "cast(timestamp_micros(start_time_unix_nano div 1000) AS date)"
_DAY_SQL = "cast(make_timestamp(start_time_unix_nano // 1000) AS date)"
_FILES_SQL = f"""days AS (SELECT {_DAY_SQL} AS day, count(*) AS n FROM spans GROUP BY 1),
    listing AS (
      SELECT concat('spans-', cast(day AS varchar), '.parquet') AS filename, n * 100 AS size_bytes, false AS is_tmp FROM days
      UNION ALL SELECT concat('tmp-', cast(day AS varchar), '.parquet.tmp'), 100, true FROM days WHERE day(day) % 10 = 0
      UNION ALL SELECT concat('spans-', cast(day AS varchar), '-retry.parquet'), 200, false FROM days WHERE day(day) % 6 = 0),
    manifest AS (
      SELECT concat('spans-', cast(day AS varchar), '.parquet') AS filename, n AS record_count,
        CASE WHEN day(day) <= 3 THEN 'COMPACTED' ELSE 'COMMITTED' END AS status FROM days
      UNION ALL SELECT concat('spans-', cast(day AS varchar), '-lost.parquet'), n, 'COMMITTED' FROM days WHERE day(day) % 7 = 0)"""


def _days(spark, sf):
    return event_spans(spark, sf).groupBy(F.expr(_DAY).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def _listing(spark, sf):
    days = _days(spark, sf)
    names = [
        ("concat('spans-', cast(day AS string), '.parquet')", "n * 100", "false", "true"),
        ("concat('tmp-', cast(day AS string), '.parquet.tmp')", "100L", "true", "day(day) % 10 = 0"),
        ("concat('spans-', cast(day AS string), '-retry.parquet')", "200L", "false", "day(day) % 6 = 0"),
    ]
    entries = F.array(*[
        F.when(F.expr(when), F.struct(F.expr(name).alias("filename"), F.expr(size).alias("size_bytes"), F.expr(tmp).alias("is_tmp")))
        for name, size, tmp, when in names
    ])
    return days.select(F.inline(F.array_compact(entries)))


def _manifest(spark, sf):
    """As an append-only log: days that are compacted now were committed before."""
    rows = _days(spark, sf)
    entry = lambda suffix, status, version: F.struct(
        F.concat(F.lit("spans-"), F.col("day").cast("string"), F.lit(f"{suffix}.parquet")).alias("filename"),
        F.col("n").alias("record_count"), F.lit(status).alias("status"), F.lit(version).alias("version"),
    )
    log = rows.select(F.inline(F.array_compact(F.array(
        entry("", "COMMITTED", 1),
        F.when(F.day("day") <= 3, entry("", "COMPACTED", 2)),
        F.when(F.day("day") % 7 == 0, entry("-lost", "COMMITTED", 1)),
    ))))
    return lakefiles.current_manifest(log)


@query(
    "committed_files",
    f"""{SPANS}, {_FILES_SQL} SELECT filename, record_count, status FROM manifest m
    WHERE status = 'COMMITTED' AND EXISTS (SELECT 1 FROM listing l WHERE l.filename = m.filename)""",
)
def _(spark, sf):
    return lakefiles.committed_files(_manifest(spark, sf), _listing(spark, sf))


@query(
    "orphan_files",
    f"""{SPANS}, {_FILES_SQL} SELECT filename, CASE WHEN is_tmp THEN 'temporary' ELSE 'not committed' END AS reason
    FROM listing l WHERE is_tmp OR NOT EXISTS
      (SELECT 1 FROM manifest m WHERE m.filename = l.filename AND status = 'COMMITTED')""",
)
def _(spark, sf):
    return lakefiles.orphan_files(_manifest(spark, sf), _listing(spark, sf))


@query(
    "compaction_plan",
    f"""{SPANS}, {_FILES_SQL} SELECT filename, record_count FROM manifest m
    WHERE status = 'COMMITTED' AND EXISTS (SELECT 1 FROM listing l WHERE l.filename = m.filename)
    ORDER BY filename LIMIT 20""",
)
def _(spark, sf):
    return lakefiles.compaction_plan(_manifest(spark, sf), _listing(spark, sf))


def _projects(spark, sf):
    return (
        event_spans(spark, sf)
        .where("project_id IS NOT NULL")
        .groupBy(F.col("project_id").alias("id"))
        .agg(F.min("start_time_unix_nano").alias("created_at"))
        .withColumn("name", F.concat(F.lit("Project "), F.col("id")))
    )


@query(
    "projects",
    f"""{SPANS} SELECT project_id AS id, min(start_time_unix_nano) AS created_at, concat('Project ', project_id) AS name
    FROM spans WHERE project_id IS NOT NULL GROUP BY project_id ORDER BY created_at, id""",
)
def _(spark, sf):
    return lakefiles.projects_by_age(_projects(spark, sf))


@query(
    "storage_status",
    f"""{SPANS}, {_SEGMENTS}, {_FILES_SQL}, live AS (SELECT * FROM listing l WHERE EXISTS
      (SELECT 1 FROM manifest m WHERE m.filename = l.filename AND status = 'COMMITTED'))
    SELECT CASE WHEN (SELECT count(*) FROM corruptions) = 0 THEN 'healthy' ELSE 'degraded' END AS status,
      (SELECT count(*) FROM segments) AS segment_count,
      (SELECT cast(sum(size_bytes) AS bigint) FROM segments) AS wal_bytes,
      (SELECT count(*) FROM segments s JOIN offsets f ON f.source_file = s.filename WHERE max_offset >= size_bytes) AS fully_materialized_segments,
      (SELECT count(*) FROM live) AS file_count,
      (SELECT cast(sum(size_bytes) AS bigint) FROM live) AS parquet_bytes,
      (SELECT count(*) FROM corruptions) AS total_corruption_events,
      (SELECT count(DISTINCT project_id) FROM spans) AS projects_count""",
)
def _(spark, sf):
    return lakefiles.storage_status(
        _segment_files(spark, sf), _offsets(spark, sf), _listing(spark, sf),
        _manifest(spark, sf), _corruptions(spark, sf), _projects(spark, sf),
    )


# A run over damaged exports: segment by segment a checksum fails at one event in 97,
# what comes after it in the segment is lost.
_DAMAGE_SQL = """placed AS (SELECT *, min(event_id) FILTER (event_id % 97 = 5) OVER (PARTITION BY source_file) AS bad FROM spans),
    sound AS (SELECT * FROM placed WHERE bad IS NULL OR event_id < bad),
    damage AS (SELECT DISTINCT source_file FROM placed WHERE bad IS NOT NULL)"""


def _damaged_lake(spark, sf):
    """Segments with damage and the lake that a run over them leaves."""
    records = encode_exports(event_spans(spark, sf, keep_event_id=True), "event_id")
    faulty = records.withColumn("fault", F.when(F.col("position") % 97 == 5, "crc"))
    wal, lake = write_segments(faulty, "damaged"), scratch_path(spark, "lake")
    materialize_available(spark, wal, lake)
    return wal, lake


@query(
    "recent_corruptions",
    f"""{SPANS}, {_DAMAGE_SQL} SELECT source_file, 'WAL checksum mismatch' AS reason, true AS ends_segment
    FROM damage ORDER BY source_file LIMIT 10""",
)
def _(spark, sf):
    _, lake = _damaged_lake(spark, sf)
    return lakefiles.recent_corruptions(lakes.corruptions(spark, lake)).select(
        "source_file", F.substring_index("reason", ":", 1).alias("reason"), "ends_segment"
    )


@query(
    "lake_quarantine",
    f"{SPANS}, {_DAMAGE_SQL} SELECT source_file AS filename, 'QUARANTINED' AS status FROM damage",
)
def _(spark, sf):
    _, lake = _damaged_lake(spark, sf)
    return segments.segment_lifecycle(lakes.quarantined_segments(spark, lake)).select("filename", "status")


@query(
    "lake_segments",
    f"""{SPANS}, {_DAMAGE_SQL}, files AS (SELECT DISTINCT source_file FROM spans),
    keyed AS (SELECT source_file, coalesce(try_cast(regexp_extract(source_file, '^wal-(\\d+)-(\\d+)\\.wal$', 1) AS bigint), 0) AS a,
      coalesce(try_cast(regexp_extract(source_file, '^wal-(\\d+)-(\\d+)\\.wal$', 2) AS bigint), 0) AS b FROM files)
    SELECT source_file AS filename, row_number() OVER (ORDER BY a DESC, b DESC, source_file DESC) = 1 AS is_active, true AS is_fully_read,
      source_file IN (SELECT source_file FROM damage) AS is_quarantined FROM keyed""",
)
def _(spark, sf):
    wal, lake = _damaged_lake(spark, sf)
    progress = segments.segment_progress(list_segments(spark, wal), lakes.read_offsets(spark, lake), lakes.corruptions(spark, lake))
    return progress.select("filename", "is_active", "is_fully_read", "is_quarantined")


@query(
    "lake_orphans",
    f"""{SPANS}, names AS (SELECT 'batch-unfinished' AS filename UNION ALL SELECT concat('batch-', lpad(cast(part AS varchar), 12, '0')) FROM range(3) r(part))
    SELECT filename, 'not committed' AS reason FROM names WHERE (SELECT count(*) FROM spans) > 0""",
)
def _(spark, sf):
    # after a compaction nothing but its own commit is live
    lake = _lake_of_three(spark, sf)
    lakes.compact(spark, lake)
    manifest = lakefiles.current_manifest(lakes.manifest_log(spark, lake))
    return lakefiles.orphan_files(manifest, lakes.list_commits(spark, lake), before=datetime.now(timezone.utc))


@query(
    "system_status",
    f"""{SPANS}, {_DAMAGE_SQL} SELECT CASE WHEN (SELECT count(*) FROM damage) = 0 THEN 'healthy' ELSE 'degraded' END AS status,
      (SELECT count(DISTINCT source_file) FROM spans) AS segment_count,
      (SELECT count(DISTINCT source_file) FROM spans) AS fully_materialized_segments, 1::bigint AS file_count,
      (SELECT count(*) FROM damage) AS total_corruption_events, (SELECT count(DISTINCT project_id) FROM sound) AS projects_count,
      (SELECT least(count(*), 10) FROM damage) AS listed_events""",
)
def _(spark, sf):
    wal, lake = _damaged_lake(spark, sf)
    return system_status(spark, wal, lake).select(
        "status", "segment_count", "fully_materialized_segments", "file_count", "total_corruption_events", "projects_count",
        F.size("latest_corruptions").cast("bigint").alias("listed_events"),
    )


# --- ingest -----------------------------------------------------------------

# Raw exports: every event once, a fault of its own chosen by event_id % 10.
_FAULTS = {
    "method": "CASE WHEN event_id % 10 = 1 THEN 'GET' WHEN event_id % 10 = 2 THEN 'PUT' ELSE 'POST' END",
    "path": "CASE WHEN event_id % 10 = 1 THEN '/healthz' WHEN event_id % 10 = 3 THEN '/v1/metrics' ELSE '/v1/traces' END",
    "content_type": (
        "CASE WHEN event_id % 10 = 4 THEN 'application/json' WHEN event_id % 10 = 0 THEN 'application/x-protobuf; charset=utf-8' "
        "WHEN event_id % 20 = 15 THEN NULL ELSE 'application/x-protobuf' END"
    ),
    "authorization": "CASE WHEN event_id % 10 = 5 THEN 'Bearer wrong' WHEN event_id % 10 = 8 THEN NULL WHEN event_id % 10 = 9 THEN 's3cret' ELSE 'Bearer s3cret' END",
    "api_key": "CASE WHEN event_id % 20 = 8 THEN 's3cret' END",
}
_FAULT_COLUMNS = ", ".join(f'{v} AS "{k}"' for k, v in _FAULTS.items())
_OUTCOME_SQL = f"""{SPANS}, raw AS (SELECT event_id, {_FAULT_COLUMNS} FROM spans),
    judged AS (SELECT event_id, method, path, CASE
      WHEN method = 'GET' AND path = '/healthz' THEN 'health'
      WHEN method <> 'POST' OR path <> '/v1/traces' THEN 'not found'
      WHEN NOT (coalesce("authorization" IN ('Bearer s3cret', 's3cret'), false) OR coalesce(api_key = 's3cret', false)) THEN 'unauthorized'
      WHEN coalesce(split_part(content_type, ';', 1), '') <> 'application/x-protobuf' THEN 'unsupported media type'
      WHEN event_id % 10 = 6 THEN 'empty body'
      WHEN event_id % 10 = 7 THEN 'malformed export'
      ELSE 'accepted' END AS outcome FROM raw)"""


def _validated(spark, sf):
    spans = event_spans(spark, sf, keep_event_id=True)
    bodies = encode_exports(spans, "event_id").selectExpr("position AS event_id", "payload")
    raw = bodies.selectExpr(
        "event_id",
        *[f"{v} AS {k}" for k, v in _FAULTS.items()],
        "CASE WHEN event_id % 10 = 6 THEN cast('' AS binary) "
        "WHEN event_id % 10 = 7 THEN cast('this is no export' AS binary) ELSE payload END AS body",
    )
    judged = inspect_exports(raw.withColumn("body_size", F.octet_length("body")))
    return ingest.ingest_validate(judged, auth_token="s3cret")


@query("ingest_validate", f"{_OUTCOME_SQL} SELECT event_id, method, path, outcome FROM judged")
def _(spark, sf):
    return _validated(spark, sf).select("event_id", "method", "path", "outcome")


@query(
    "ingest_stats",
    f"""{_OUTCOME_SQL} SELECT count(*) FILTER (outcome = 'accepted') AS accepted_requests,
      count(*) FILTER (outcome = 'accepted') AS accepted_resource_spans,
      count(*) FILTER (outcome = 'accepted') AS accepted_spans,
      count(*) FILTER (outcome NOT IN ('accepted', 'health')) AS rejected_requests FROM judged""",
)
def _(spark, sf):
    return ingest.ingest_stats(_validated(spark, sf))
