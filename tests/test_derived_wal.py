"""Exports made for the queries on segments."""

import pyarrow as pa

from spanloom.plans import derived_wal
from spanloom.sources.otlp import message_types


def _rows(count):
    return [
        {
            "source_file": "wal-1-0.wal", "position": n, "trace_id": f"{n:032x}", "span_id": f"{n + 1:016x}", "parent_span_id": None, "name": "n", "kind": 1,
            "start_time_unix_nano": n, "end_time_unix_nano": n + 1, "status_code": 0, "status_message": None, "scope_name": "s", "scope_version": "1",
            "resource_attributes_json": f'{{"service.name": "svc-{n % 3}"}}', "attributes_json": '{"a": {"b": [1, true, 2.5]}, "raw.x": "ff", "unset.y": ""}',
            "events_json": '[{"attributes": {"k": "v"}, "name": "e", "time_unix_nano": 5}]', "links_json": "[]",
        }
        for n in range(count)
    ]


def test_few_rows_are_python_objects_at_once():
    rows = _rows(1200)
    made = list(derived_wal._encode(iter([pa.RecordBatch.from_pylist(rows)])))
    grouped = [{"source_file": "wal-1-0.wal", "position": n, "rows": [row]} for n, row in enumerate(rows)]
    made_of_groups = list(derived_wal._encode_groups(iter([pa.RecordBatch.from_pylist(grouped)])))
    Request = message_types()["ExportTraceServiceRequest"]
    for batches, level in ((made, 0), (made_of_groups, 1)):
        assert [b.num_rows for b in batches] == [500, 500, 200]
        assert [p for b in batches for p in b.column("position").to_pylist()] == list(range(1200))
        for n, payload in enumerate(p for b in batches for p in b.column("payload").to_pylist()):
            resource = Request.FromString(payload).resource_spans[level]
            assert resource.resource.attributes[0].value.string_value == f"svc-{n % 3}"
            span = resource.scope_spans[level].spans[0]
            assert span.start_time_unix_nano == n and [a.key for a in span.attributes] == ["a", "raw.x", "unset.y"]
            assert span.events[0].attributes[0].value.string_value == "v"


def test_equal_attributes_are_parsed_once(monkeypatch):
    rows = _rows(1200)
    for n, row in enumerate(rows):
        row["attributes_json"] = f'{{"k": {n % 2}}}'
    parsed, loads = [], derived_wal.json.loads
    monkeypatch.setattr(derived_wal.json, "loads", lambda text: parsed.append(text) or loads(text))
    made = list(derived_wal._encode(iter([pa.RecordBatch.from_pylist(rows)])))
    Request = message_types()["ExportTraceServiceRequest"]
    spans = [Request.FromString(p).resource_spans[0].scope_spans[0].spans[0] for b in made for p in b.column("payload").to_pylist()]
    assert [s.attributes[0].value.int_value for s in spans] == [n % 2 for n in range(1200)]
    assert all(len(s.attributes) == 1 and s.events[0].time_unix_nano == 5 for s in spans)
    # two forms of attributes, three resources, the events of every row
    assert len([t for t in parsed if t.startswith("{")]) == 5 and len(parsed) == 1205
