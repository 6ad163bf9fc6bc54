"""Column layouts shared by the sources, the lake and the operators."""

from pyspark.sql import types as T


def _fields(*specs):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in specs])


_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()

# One row per span. Times are nanoseconds since the epoch and stay BIGINT,
# because a Spark timestamp only resolves microseconds.
SPAN = _fields(
    ("trace_id", _S, False),
    ("span_id", _S, False),
    ("parent_span_id", _S, True),
    ("name", _S, False),
    ("kind", _I, False),
    ("service_name", _S, True),
    ("project_id", _S, True),
    ("start_time_unix_nano", _L, False),
    ("end_time_unix_nano", _L, False),
    ("duration_ns", _L, False),
    ("status_code", _I, False),
    ("status_message", _S, True),
    ("scope_name", _S, True),
    ("scope_version", _S, True),
    ("trace_state", _S, True),
    ("flags", _L, True),
    ("resource_attributes_json", _S, False),
    ("attributes_json", _S, False),
    ("events_json", _S, False),
    ("links_json", _S, False),
    ("dropped_attributes_count", _L, False),
    ("dropped_events_count", _L, False),
    ("dropped_links_count", _L, False),
    ("source_file", _S, False),
    ("source_offset", _L, False),
)

# One row per record of a write-ahead log segment, or one row for the damage
# that ended the segment (then payload is NULL and corrupt_reason is set).
FRAME = _fields(
    ("source_file", _S, False),
    ("source_offset", _L, False),
    ("end_offset", _L, True),
    ("payload", T.BinaryType(), True),
    ("corrupt_reason", _S, True),
)

CORRUPTION = _fields(
    ("source_file", _S, False),
    ("source_offset", _L, False),
    ("reason", _S, False),
    ("ends_segment", T.BooleanType(), False),
    ("batch_id", _L, True),
    ("detected_at", T.TimestampType(), True),
)

# How far a batch read a segment; the greatest value of a segment counts.
READ_MARK = _fields(
    ("batch_id", _L, False),
    ("source_file", _S, False),
    ("end_offset", _L, False),
)

# Append-only log of what became of segments; the latest row of a name is its state.
SEGMENT_CHANGE = _fields(
    ("filename", _S, False),
    ("status", _S, False),
    ("bytes_size", _L, True),
    ("sequence", _L, False),
    ("changed_at", T.TimestampType(), True),
)

# Failures of a followed stream, one row for each time it ended.
STREAM_FAILURE = _fields(
    ("failed_at", T.TimestampType(), False),
    ("batch_id", _L, True),
    ("attempt", _I, False),
    ("message", _S, True),
    ("gave_up", T.BooleanType(), False),
)

# Append-only log of the lake; the latest row of a file name is its state.
MANIFEST = _fields(
    ("filename", _S, False),
    ("record_count", _L, False),
    ("status", _S, False),
    ("version", _L, False),
    ("committed_at", T.TimestampType(), True),
)

STATUS_ERROR = 2  # the only status code that means failure
