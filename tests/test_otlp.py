"""Decoding and flattening of exports."""

import json

from exports import KINDS, attribute, export, put, span

from spanloom.sources.otlp import inspect_exports, normalize_spans
from spanloom.schema import SPAN


def normalized(spark, *payloads, **options):
    frames = spark.createDataFrame(
        [("wal-1-0.wal", i, bytearray(p), None) for i, p in enumerate(payloads)],
        "source_file string, source_offset bigint, payload binary, corrupt_reason string",
    ).coalesce(1)
    return normalize_spans(frames, **options)


def test_sample_span(spark):
    payload = export(
        span(parent=b"\xef" * 8, attributes={"gen_ai.usage.input_tokens": 100}, name="chat", kind=3),
        resource={"service.name": "api", "project.id": "p1"},
        scope="lib",
    )
    frame = normalized(spark, payload)
    assert frame.columns == SPAN.fieldNames()
    row = frame.collect()[0]
    assert (row.trace_id, row.span_id, row.parent_span_id) == ("ab" * 16, "01" * 8, "ef" * 8)
    assert (row.duration_ns, row.kind, row.service_name, row.project_id) == (10, 3, "api", "p1")
    assert (row.scope_name, row.scope_version, row.status_message, row.trace_state) == ("lib", None, None, None)
    assert json.loads(row.attributes_json) == {"gen_ai.usage.input_tokens": 100}
    assert row.events_json == row.links_json == "[]"
    assert row.resource_attributes_json == '{"project.id": "p1", "service.name": "api"}'


def test_attribute_values(spark):
    values = {
        "z": "text", "i": -5, "b": True, "f": 1.5, "y": b"\x00\xff", "none": None,
        "list": [1, "two", [False, None]], "map": {"inner": {"deep": 2**60}}, "nan": float("nan"),
        "inf": float("-inf"), "uni": "é\n\"",
    }
    row = normalized(spark, export(span(attributes=values))).collect()[0]
    assert json.loads(row.attributes_json) == {
        **values, "y": "00ff", "none": "", "list": [1, "two", [False, ""]], "nan": "NaN", "inf": "-Infinity",
    }
    assert list(json.loads(row.attributes_json)) == sorted(values)


def test_last_of_equal_keys_wins(spark):
    row = normalized(spark, export(span(attributes=[("k", 1), ("k", 2)]))).collect()[0]
    assert json.loads(row.attributes_json) == {"k": 2}


def test_events_and_links(spark):
    made = span()
    put(made.events.add(name="e", time_unix_nano=12, dropped_attributes_count=3).attributes, {"a": 1})
    made.links.add(trace_id=b"\x01" * 16, span_id=b"\x02" * 8, trace_state="s", flags=1)
    row = normalized(spark, export(made)).collect()[0]
    assert json.loads(row.events_json) == [
        {"name": "e", "time_unix_nano": 12, "attributes": {"a": 1}, "dropped_attributes_count": 3}
    ]
    assert json.loads(row.links_json) == [
        {"trace_id": "01" * 16, "span_id": "02" * 8, "trace_state": "s", "attributes": {},
         "dropped_attributes_count": 0, "flags": 1}
    ]


def test_project_precedence(spark):
    keys = ("project.id", "vendor.project_id")
    cases = [
        ({"project.id": "a", "vendor.project_id": "b"}, {"project.id": "c"}, "a"),
        ({"project.id": "", "vendor.project_id": "b"}, {"project.id": "c"}, "b"),
        ({}, {"project.id": "c", "vendor.project_id": "d"}, "c"),
        ({}, {"vendor.project_id": "d"}, "d"),
        ({"project.id": 0}, {}, None),
        ({"project.id": 7}, {}, "7"),
    ]
    payloads = [export(span(attributes=own), resource=shared) for own, shared, _ in cases]
    rows = normalized(spark, *payloads, project_keys=keys).orderBy("source_offset").collect()
    assert [r.project_id for r in rows] == [c[2] for c in cases]


def test_negative_duration_and_empty_levels(spark):
    request = KINDS["ExportTraceServiceRequest"]()
    request.resource_spans.add()
    request.resource_spans.add().scope_spans.add()
    rows = normalized(spark, export(span(start=50, end=20)), request.SerializeToString(), b"").collect()
    assert [(r.duration_ns, r.end_time_unix_nano) for r in rows] == [(0, 20)]


def test_malformed_export_leaves_the_others(spark):
    from spanloom.sources.otlp import decode_exports

    late = span(span_id=b"\x09" * 8, start=2**63)
    payloads = [export(span()), b"\xff\xff\xff", export(span(span_id=b"\x03" * 8)), export(span(span_id=b"\x04" * 8), late)]
    assert {r.span_id for r in normalized(spark, *payloads).collect()} == {"01" * 8, "03" * 8}
    frames = spark.createDataFrame(
        [("f", i, bytearray(p), None) for i, p in enumerate(payloads)],
        "source_file string, source_offset bigint, payload binary, corrupt_reason string",
    ).coalesce(1)
    bad = decode_exports(frames).where("corrupt_reason IS NOT NULL").orderBy("source_offset").collect()
    assert [r.source_offset for r in bad] == [1, 3]
    assert all(r.corrupt_reason.startswith("malformed OTLP export") for r in bad)


def test_inspection(spark):
    bodies = spark.createDataFrame(
        [(1, bytearray(export(span(), span()))), (2, bytearray(b"\xff\xff")), (3, bytearray(b""))], "id int, body binary"
    )
    rows = inspect_exports(bodies).orderBy("id").collect()
    assert [(r.decodable, r.n_resource_spans, r.n_spans) for r in rows] == [(True, 1, 2), (False, 0, 0), (True, 0, 0)]


def test_attribute_builder_keeps_types():
    assert attribute(True).WhichOneof("value") == "bool_value"
