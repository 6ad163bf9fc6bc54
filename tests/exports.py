"""Builders of export payloads, log records and span rows for the tests."""

import struct
import zlib

from spanloom.schema import SPAN
from spanloom.sources.otlp import message_types

KINDS = message_types()


def attribute(value):
    made = KINDS["AnyValue"]()
    if value is None:
        return made
    if isinstance(value, bool):
        made.bool_value = value
    elif isinstance(value, int):
        made.int_value = value
    elif isinstance(value, float):
        made.double_value = value
    elif isinstance(value, bytes):
        made.bytes_value = value
    elif isinstance(value, list):
        made.array_value.SetInParent()
        made.array_value.values.extend([attribute(v) for v in value])
    elif isinstance(value, dict):
        made.kvlist_value.SetInParent()
        for k, v in value.items():
            made.kvlist_value.values.add(key=k).value.CopyFrom(attribute(v))
    else:
        made.string_value = value
    return made


def put(target, attributes):
    pairs = attributes.items() if isinstance(attributes, dict) else attributes
    for key, value in pairs:
        target.add(key=key).value.CopyFrom(attribute(value))


def span(trace=b"\xab" * 16, span_id=b"\x01" * 8, start=10, end=20, parent=b"", attributes=(), **fields):
    made = KINDS["Span"](
        trace_id=trace, span_id=span_id, parent_span_id=parent,
        start_time_unix_nano=start, end_time_unix_nano=end, **fields,
    )
    put(made.attributes, attributes)
    return made


def export(*spans, resource=(), scope=""):
    request = KINDS["ExportTraceServiceRequest"]()
    made = request.resource_spans.add()
    put(made.resource.attributes, resource)
    inner = made.scope_spans.add()
    inner.scope.name = scope
    inner.spans.extend(spans)
    return request.SerializeToString()


def record(payload):
    return struct.pack("<II", len(payload), zlib.crc32(payload)) + payload


def one_span(i, **kw):
    return export(span(span_id=bytes([0, 0, 0, 0, 0, 0, i // 256, i % 256]), **kw), resource={"service.name": "api"})


def write(folder, name, *records):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(b"".join(records))


_DEFAULTS = {
    "parent_span_id": None, "name": "work", "kind": 1, "service_name": None, "project_id": None,
    "start_time_unix_nano": 0, "end_time_unix_nano": 1, "status_code": 0, "status_message": None,
    "scope_name": None, "scope_version": None, "trace_state": None, "flags": 0,
    "resource_attributes_json": "{}", "attributes_json": "{}", "events_json": "[]", "links_json": "[]",
    "dropped_attributes_count": 0, "dropped_events_count": 0, "dropped_links_count": 0,
    "source_file": "wal-1-0.wal", "source_offset": 0,
}
SHORT = {"start": "start_time_unix_nano", "end": "end_time_unix_nano", "parent": "parent_span_id",
         "service": "service_name", "project": "project_id", "status": "status_code"}


def spans_frame(spark, rows):
    """DataFrame of spans from dicts with trace, span and any other columns."""
    full = []
    for row in rows:
        row = {SHORT.get(k, k): v for k, v in row.items()}
        whole = {**_DEFAULTS, "trace_id": row.pop("trace", "t"), "span_id": row.pop("span"), **row}
        whole.setdefault("duration_ns", max(0, whole["end_time_unix_nano"] - whole["start_time_unix_nano"]))
        full.append(tuple(whole[f] for f in SPAN.fieldNames()))
    return spark.createDataFrame(full, SPAN)
