"""OTLP trace exports: decoding payloads and flattening them to span rows.

Python only turns protobuf bytes into nested Arrow columns; flattening, id
formatting, durations and NULL rules are Spark expressions on those columns.
"""

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import AccumulatorParam
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.attributes import non_empty
from ..schema import SPAN

# Field names and numbers of the public OTLP trace protocol.
# Types: s string, y bytes, b bool, i int64, d double, u uint32, q fixed64,
# w fixed32, e enum (read as int32), a leading * repeats, other names are messages.
PROTOCOL = {
    "ExportTraceServiceRequest": {"resource_spans": (1, "*ResourceSpans")},
    "ResourceSpans": {"resource": (1, "Resource"), "scope_spans": (2, "*ScopeSpans"), "schema_url": (3, "s")},
    "Resource": {"attributes": (1, "*KeyValue"), "dropped_attributes_count": (2, "u")},
    "ScopeSpans": {"scope": (1, "InstrumentationScope"), "spans": (2, "*Span"), "schema_url": (3, "s")},
    "InstrumentationScope": {
        "name": (1, "s"),
        "version": (2, "s"),
        "attributes": (3, "*KeyValue"),
        "dropped_attributes_count": (4, "u"),
    },
    "Span": {
        "trace_id": (1, "y"),
        "span_id": (2, "y"),
        "trace_state": (3, "s"),
        "parent_span_id": (4, "y"),
        "name": (5, "s"),
        "kind": (6, "e"),
        "start_time_unix_nano": (7, "q"),
        "end_time_unix_nano": (8, "q"),
        "attributes": (9, "*KeyValue"),
        "dropped_attributes_count": (10, "u"),
        "events": (11, "*Event"),
        "dropped_events_count": (12, "u"),
        "links": (13, "*Link"),
        "dropped_links_count": (14, "u"),
        "status": (15, "Status"),
        "flags": (16, "w"),
    },
    "Event": {
        "time_unix_nano": (1, "q"),
        "name": (2, "s"),
        "attributes": (3, "*KeyValue"),
        "dropped_attributes_count": (4, "u"),
    },
    "Link": {
        "trace_id": (1, "y"),
        "span_id": (2, "y"),
        "trace_state": (3, "s"),
        "attributes": (4, "*KeyValue"),
        "dropped_attributes_count": (5, "u"),
        "flags": (6, "w"),
    },
    "Status": {"message": (2, "s"), "code": (3, "e")},
    "KeyValue": {"key": (1, "s"), "value": (2, "AnyValue")},
    "AnyValue": {
        "string_value": (1, "s"),
        "bool_value": (2, "b"),
        "int_value": (3, "i"),
        "double_value": (4, "d"),
        "array_value": (5, "ArrayValue"),
        "kvlist_value": (6, "KeyValueList"),
        "bytes_value": (7, "y"),
    },
    "ArrayValue": {"values": (1, "*AnyValue")},
    "KeyValueList": {"values": (1, "*KeyValue")},
}

_SPAN_FIELDS = [
    ("trace_id", "binary", pa.binary()),
    ("span_id", "binary", pa.binary()),
    ("parent_span_id", "binary", pa.binary()),
    ("name", "string", pa.string()),
    ("kind", "int", pa.int32()),
    ("project_id", "string", pa.string()),
    ("start_time_unix_nano", "bigint", pa.int64()),
    ("end_time_unix_nano", "bigint", pa.int64()),
    ("status_code", "int", pa.int32()),
    ("status_message", "string", pa.string()),
    ("trace_state", "string", pa.string()),
    ("flags", "bigint", pa.int64()),
    ("attributes_json", "string", pa.string()),
    ("events_json", "string", pa.string()),
    ("links_json", "string", pa.string()),
    ("dropped_attributes_count", "bigint", pa.int64()),
    ("dropped_events_count", "bigint", pa.int64()),
    ("dropped_links_count", "bigint", pa.int64()),
]
_SPAN_TYPE = ",".join(f"{n}:{t}" for n, t, _ in _SPAN_FIELDS)
DECODED = (
    "source_file string, source_offset bigint, corrupt_reason string, resource_spans array<struct<"
    "resource_attributes_json:string,service_name:string,project_id:string,scope_spans:array<struct<"
    f"scope_name:string,scope_version:string,spans:array<struct<{_SPAN_TYPE}>>>>>>"
)
_LAST_NANO = 2**63 - 1
_BATCH_SPANS = 10_000
_REMEMBERED = 10_000


def message_types() -> dict:
    """Message classes of PROTOCOL, made at run time. Built once per task."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    kinds = descriptor_pb2.FieldDescriptorProto
    scalar = {
        "s": kinds.TYPE_STRING, "y": kinds.TYPE_BYTES, "b": kinds.TYPE_BOOL, "i": kinds.TYPE_INT64,
        "d": kinds.TYPE_DOUBLE, "u": kinds.TYPE_UINT32, "q": kinds.TYPE_FIXED64, "w": kinds.TYPE_FIXED32,
        "e": kinds.TYPE_INT32,
    }
    file = descriptor_pb2.FileDescriptorProto(name="trace_export.proto", package="t", syntax="proto3")
    for message_name, fields in PROTOCOL.items():
        message = file.message_type.add(name=message_name)
        one_of = message_name == "AnyValue"
        if one_of:
            message.oneof_decl.add(name="value")
        for name, (number, kind) in fields.items():
            base = kind.lstrip("*")
            added = message.field.add(
                name=name, number=number,
                label=kinds.LABEL_REPEATED if kind.startswith("*") else kinds.LABEL_OPTIONAL,
                type=scalar.get(base, kinds.TYPE_MESSAGE),
            )
            if base not in scalar:
                added.type_name = f".t.{base}"
            if one_of:
                added.oneof_index = 0
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return {n: message_factory.GetMessageClass(pool.FindMessageTypeByName(f"t.{n}")) for n in PROTOCOL}


def _json_writers():
    """(attributes, label): JSON text of a KeyValue list, and the text of one value in it.

    The text goes straight from message to JSON, keys sorted, the last of equal
    keys kept. Keys come from a small vocabulary, so their quoted form is kept.
    """
    quote, quoted = json.dumps, {}

    def number(value):
        if math.isfinite(value):
            return repr(value)
        # JSON has no literal for these, so they become text
        return '"NaN"' if math.isnan(value) else '"Infinity"' if value > 0 else '"-Infinity"'

    def text(value):
        kind = value.WhichOneof("value")
        return writers[kind](getattr(value, kind)) if kind else '""'

    def key(name):
        if name not in quoted:
            if len(quoted) >= _REMEMBERED:
                quoted.clear()
            quoted[name] = quote(name)
        return quoted[name]

    def attributes(pairs):
        if not pairs:
            return "{}"
        found = {pair.key: pair.value for pair in pairs}
        names = sorted(found) if len(found) > 1 else found
        return "{" + ", ".join([f"{key(n)}: {text(found[n])}" for n in names]) + "}"

    writers = {
        "string_value": quote,
        "bool_value": lambda value: "true" if value else "false",
        "int_value": str,
        "double_value": number,
        "bytes_value": lambda value: f'"{value.hex()}"',
        "array_value": lambda array: "[" + ", ".join([text(v) for v in array.values]) + "]",
        "kvlist_value": lambda pairs: attributes(pairs.values),
    }

    def label(pairs, wanted):
        """Text of the first wanted key with a value that is neither empty, zero nor false."""
        found = {pair.key: pair.value for pair in pairs if pair.key in wanted}
        for name in wanted:
            if name in found:
                kind = found[name].WhichOneof("value")
                value = getattr(found[name], kind) if kind else ""
                if kind in ("array_value", "kvlist_value"):
                    value = text(found[name]) if value.values else ""
                if value:
                    return value.hex() if kind == "bytes_value" else str(value)
        return None

    return attributes, label


class _Exports:
    """Rows of each level and the list offsets over them, as nested Arrow columns."""

    def __init__(self):
        self.records, self.resources, self.scopes, self.spans = [], [], [], []
        # one offset per finished list: spans of scopes, scopes of resources, resources of records
        self.span_ends, self.scope_ends, self.resource_ends = [0], [0], [0]

    def levels(self):
        return self.resources, self.scopes, self.spans, self.span_ends, self.scope_ends

    def mark(self):
        return tuple(map(len, self.levels()))

    def undo(self, mark):
        for rows, length in zip(self.levels(), mark):
            del rows[length:]

    def end_record(self, source_file, source_offset, reason):
        self.records.append((source_file, source_offset, reason))
        self.resource_ends.append(len(self.resources))

    def batch(self) -> pa.RecordBatch:
        def arrays(rows, types):
            columns = zip(*rows) if rows else [[]] * len(types)
            return [pa.array(c, t) for c, t in zip(columns, types)]

        def lists(ends, values):
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

        text = pa.string()
        spans = pa.StructArray.from_arrays(
            arrays(self.spans, [t for _, _, t in _SPAN_FIELDS]), [n for n, _, _ in _SPAN_FIELDS]
        )
        scopes = pa.StructArray.from_arrays(
            [*arrays(self.scopes, [text] * 2), lists(self.span_ends, spans)],
            ["scope_name", "scope_version", "spans"],
        )
        resources = pa.StructArray.from_arrays(
            [*arrays(self.resources, [text] * 3), lists(self.scope_ends, scopes)],
            ["resource_attributes_json", "service_name", "project_id", "scope_spans"],
        )
        return pa.record_batch(
            [*arrays(self.records, [text, pa.int64(), text]), lists(self.resource_ends, resources)],
            ["source_file", "source_offset", "corrupt_reason", "resource_spans"],
        )


def _decoder(project_keys, reached=None):
    """Task function for mapInArrow: frames in, nested exports out.

    reached, an accumulator of MaxPerName, learns the end of the last whole frame of each segment.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from google.protobuf.message import DecodeError

        Request = message_types()["ExportTraceServiceRequest"]
        attributes, label = _json_writers()
        quote = json.dumps

        def event(e):
            return (
                f'{{"attributes": {attributes(e.attributes)}, '
                f'"dropped_attributes_count": {e.dropped_attributes_count}, '
                f'"name": {quote(e.name)}, "time_unix_nano": {e.time_unix_nano}}}'
            )

        def link(k):
            return (
                f'{{"attributes": {attributes(k.attributes)}, '
                f'"dropped_attributes_count": {k.dropped_attributes_count}, "flags": {k.flags}, '
                f'"span_id": "{k.span_id.hex()}", "trace_id": "{k.trace_id.hex()}", '
                f'"trace_state": {quote(k.trace_state)}}}'
            )

        def listed(items, write):
            return "[" + ", ".join([write(i) for i in items]) + "]" if items else "[]"

        known = {}  # few resources send most exports

        def resource_row(resource):
            key = resource.SerializeToString()
            if key not in known:
                if len(known) >= _REMEMBERED:
                    known.clear()
                shared = resource.attributes
                known[key] = attributes(shared), label(shared, ("service.name",)), label(shared, project_keys)
            return known[key]

        def span_row(s):
            own = s.attributes
            start, end = s.start_time_unix_nano, s.end_time_unix_nano
            if start > _LAST_NANO or end > _LAST_NANO:
                raise OverflowError("span time beyond 63 bits")
            return (
                s.trace_id, s.span_id, s.parent_span_id, s.name, s.kind, label(own, project_keys),
                start, end, s.status.code, s.status.message, s.trace_state, s.flags,
                attributes(own), listed(s.events, event), listed(s.links, link),
                s.dropped_attributes_count, s.dropped_events_count, s.dropped_links_count,
            )

        def add(out, request):
            for resource in request.resource_spans:
                for scope in resource.scope_spans:
                    out.spans.extend(map(span_row, scope.spans))
                    out.scopes.append((scope.scope.name, scope.scope.version))
                    out.span_ends.append(len(out.spans))
                out.resources.append(resource_row(resource.resource))
                out.scope_ends.append(len(out.scopes))

        out, ends = _Exports(), {}
        for batch in batches:
            if reached is not None:
                for name, end in zip(batch.column("source_file").to_pylist(), batch.column("end_offset").to_pylist()):
                    if end is not None:
                        ends[name] = max(end, ends.get(name, 0))
            columns = [batch.column(n) for n in ("source_file", "source_offset", "payload", "corrupt_reason")]
            for source_file, source_offset, payload, reason in zip(*[c.to_pylist() for c in columns]):
                if reason is None:
                    mark = out.mark()
                    try:
                        add(out, Request.FromString(payload))
                    except (DecodeError, OverflowError) as error:
                        out.undo(mark)
                        reason = f"malformed OTLP export: {error}"
                out.end_record(source_file, source_offset, reason)
                if len(out.spans) >= _BATCH_SPANS or len(out.records) >= _BATCH_SPANS:
                    yield out.batch()
                    out = _Exports()
        if out.records:
            yield out.batch()
        if reached is not None:
            reached.add(ends)

    return decode


class MaxPerName(AccumulatorParam):
    """The greatest value for each name. Tasks that ran twice change nothing."""

    def zero(self, value):
        return {}

    def addInPlace(self, one, other):
        for name, value in other.items():
            one[name] = max(value, one.get(name, 0))
        return one


def decode_exports(frames: DataFrame, project_keys=("project.id",), reached=None) -> DataFrame:
    """Nested resource/scope/span columns of each export.

    frames has source_file, source_offset, payload and corrupt_reason; damaged
    frames pass through. A payload that is no export gets a corrupt_reason of
    its own; its frame was whole, so the frames after it stay valid.

    project_keys are the attributes that may name a span's project, in order.
    A deployment whose clients write a key of their own adds it here. reached is an
    accumulator that learns how far each segment was decoded.
    """
    columns = ["source_file", "source_offset", "payload", "corrupt_reason", *(["end_offset"] if reached is not None else [])]
    return frames.select(*columns).mapInArrow(_decoder(tuple(project_keys), reached), DECODED)


def flatten_exports(decoded: DataFrame) -> DataFrame:
    """One row per span in the canonical layout. Empty levels yield no rows."""
    where = ["source_file", "source_offset"]
    resources = decoded.select(*where, F.explode("resource_spans").alias("r"))
    scopes = resources.select(
        *where, "r.resource_attributes_json", "r.service_name", F.col("r.project_id").alias("shared_project"),
        F.explode("r.scope_spans").alias("s"),
    )
    spans = scopes.select(
        *where, "resource_attributes_json", "service_name", "shared_project",
        "s.scope_name", "s.scope_version", F.explode("s.spans").alias("p"),
    )
    span = lambda name: F.col(f"p.{name}")
    text_id = lambda name: F.lower(F.hex(span(name)))
    computed = {
        "trace_id": text_id("trace_id"),
        "span_id": text_id("span_id"),
        "parent_span_id": non_empty(text_id("parent_span_id")),
        "service_name": F.col("service_name"),
        "project_id": F.coalesce(span("project_id"), "shared_project"),
        "duration_ns": F.greatest(
            span("end_time_unix_nano") - span("start_time_unix_nano"), F.lit(0).cast("bigint")
        ),
        "status_message": non_empty(span("status_message")),
        "scope_name": non_empty(F.col("scope_name")),
        "scope_version": non_empty(F.col("scope_version")),
        "trace_state": non_empty(span("trace_state")),
        "resource_attributes_json": F.col("resource_attributes_json"),
        "source_file": F.col("source_file"),
        "source_offset": F.col("source_offset"),
    }
    return spans.select(*[computed.get(n, span(n)).alias(n) for n in SPAN.fieldNames()])


def normalize_spans(frames: DataFrame, project_keys=("project.id",)) -> DataFrame:
    """Frames of the write-ahead log to span rows."""
    return flatten_exports(decode_exports(frames, project_keys))


def inspect_exports(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Add decodable, n_resource_spans and n_spans to raw export bodies."""
    names = bodies.columns

    def inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from google.protobuf.message import DecodeError

        Request = message_types()["ExportTraceServiceRequest"]

        def counts(payload):
            try:
                resources = Request.FromString(payload or b"").resource_spans
            except DecodeError:
                return False, 0, 0
            return True, len(resources), sum(len(s.spans) for r in resources for s in r.scope_spans)

        for batch in batches:
            found = [counts(p) for p in batch.column(body).to_pylist()]
            kinds = [pa.bool_(), pa.int64(), pa.int64()]
            added = [pa.array(c, t) for c, t in zip(zip(*found), kinds)] if found else [pa.array([], t) for t in kinds]
            yield pa.record_batch([*batch.columns, *added], [*names, "decodable", "n_resource_spans", "n_spans"])

    layout = T.StructType(list(bodies.schema.fields))
    layout = layout.add("decodable", T.BooleanType()).add("n_resource_spans", T.LongType()).add("n_spans", T.LongType())
    return bodies.mapInArrow(inspect, layout)
