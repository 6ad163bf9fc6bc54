"""Segments derived from the tables, for the queries that read segments.

Spark encodes table rows as export payloads, frames them and writes one file
per segment into the shared scratch folder. This stands in for the gateway that
would have written them; the engine itself never writes segments.
"""

import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import local_path, scratch_path
from ..sources.otlp import message_types


#: Prefixes of keys whose values are encoded in a way that JSON has no word for.
AS_BYTES, TWICE, UNSET = "raw.", "twice.", "unset."


#: Rows, or groups of a few rows, that are Python objects at once; and resources, and attributes of spans, kept as messages.
_SLICE, _REMEMBERED = 500, 10_000


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _SLICE):
            yield batch.slice(start, _SLICE)


def _values(column: pa.Array) -> list:
    """The values of a column as to_pylist gives them, by way of an array of objects where that is the same."""
    if column.null_count and not pa.types.is_string(column.type):
        return column.to_pylist()
    return column.to_numpy(zero_copy_only=False).tolist()


def _writers(kinds):
    """(span, resource): fill a span message from a row, and a resource from JSON text."""

    def put(made, value):
        if isinstance(value, bool):
            made.bool_value = value
        elif isinstance(value, int):
            made.int_value = value
        elif isinstance(value, float):
            made.double_value = value
        elif isinstance(value, list):
            values = made.array_value.values
            for v in value:
                put(values.add(), v)
        elif isinstance(value, dict):
            made.kvlist_value.SetInParent()
            for key, inner in value.items():
                put(made.kvlist_value.values.add(key=key).value, inner)
        elif isinstance(value, bytes):
            made.bytes_value = value
        else:
            made.string_value = value

    def pairs(target, found):
        for key, value in found.items():
            if key.startswith(UNSET):
                target.add(key=key).value.SetInParent()
                continue
            if key.startswith(TWICE):
                put(target.add(key=key).value, "the first of two")
            put(target.add(key=key).value, bytes.fromhex(value) if key.startswith(AS_BYTES) else value)

    def remembered(kind):
        """A function that gives a message of this kind with the attributes of a JSON text, and nothing else."""
        made, known = kinds[kind], {}

        def message(text):
            found = known.get(text)
            if found is None:
                if len(known) >= _REMEMBERED:
                    known.clear()
                found = known[text] = made()
                pairs(found.attributes, json.loads(text))
            return found

        return message

    # few resources send most exports, and many spans have the same attributes
    shared, own = remembered("Resource"), remembered("Span")

    def resource(target, text):
        target.CopyFrom(shared(text))

    def fill(span, row):
        span.MergeFrom(own(row["attributes_json"]))
        span.trace_id, span.span_id = bytes.fromhex(row["trace_id"]), bytes.fromhex(row["span_id"])
        span.parent_span_id = bytes.fromhex(row["parent_span_id"] or "")
        span.name, span.kind = row["name"], row["kind"]
        span.start_time_unix_nano, span.end_time_unix_nano = row["start_time_unix_nano"], row["end_time_unix_nano"]
        span.status.code, span.status.message = row["status_code"], row["status_message"] or ""
        for e in json.loads(row["events_json"]):
            added = span.events.add(name=e["name"], time_unix_nano=e["time_unix_nano"])
            pairs(added.attributes, e["attributes"])
        for k in json.loads(row["links_json"]) if row["links_json"] != "[]" else ():
            added = span.links.add(
                trace_id=bytes.fromhex(k["trace_id"]), span_id=bytes.fromhex(k["span_id"]), flags=k["flags"]
            )
            pairs(added.attributes, k["attributes"])

    return fill, resource


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = message_types()
    Request = kinds["ExportTraceServiceRequest"]
    fill, resource = _writers(kinds)

    def payload(row):
        request = Request()
        made = request.resource_spans.add()
        resource(made.resource, row["resource_attributes_json"])
        scope = made.scope_spans.add()
        scope.scope.name, scope.scope.version = row["scope_name"], row["scope_version"]
        fill(scope.spans.add(), row)
        return request.SerializeToString()

    for batch in _sliced(batches):
        rows = zip(*[_values(batch.column(n)) for n in _ENCODED])
        yield pa.record_batch(
            [batch.column("source_file"), batch.column("position"), pa.array([payload(dict(zip(_ENCODED, row))) for row in rows], pa.binary())],
            ["source_file", "position", "payload"],
        )


#: What messages are made of.
_ENCODED = [
    "source_file", "trace_id", "span_id", "parent_span_id", "name", "kind", "start_time_unix_nano", "end_time_unix_nano", "status_code", "status_message",
    "scope_name", "scope_version", "resource_attributes_json", "attributes_json", "events_json", "links_json",
]


def encode_exports(spans: DataFrame, position: str) -> DataFrame:
    """One export per span: source_file, position in the segment, payload."""
    # a small table is one scan task; encoding is worth spreading
    spread = spans.select(*_ENCODED, spans[position].alias("position")).repartition("trace_id")
    return spread.mapInArrow(
        _encode, "source_file string, position bigint, payload binary"
    )


def _encode_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = message_types()
    Request = kinds["ExportTraceServiceRequest"]
    fill, resource = _writers(kinds)

    def payload(rows):
        request, resources, scopes = Request(), {}, {}
        request.resource_spans.add()  # levels without content
        for row in sorted(rows, key=lambda r: r["span_id"]):
            shared = row["resource_attributes_json"]
            if shared not in resources:
                resources[shared] = request.resource_spans.add()
                resource(resources[shared].resource, shared)
                resources[shared].scope_spans.add()
            named = shared, row["scope_name"], row["scope_version"]
            if named not in scopes:
                scopes[named] = resources[shared].scope_spans.add()
                scopes[named].scope.name, scopes[named].scope.version = named[1:]
            fill(scopes[named].spans.add(), row)
        return request.SerializeToString()

    for batch in _sliced(batches):
        yield pa.record_batch(
            [batch.column("source_file"), batch.column("position"), pa.array([payload(rows) for rows in batch.column("rows").to_pylist()], pa.binary())],
            ["source_file", "position", "payload"],
        )


def encode_grouped_exports(spans: DataFrame, position: str, size: int) -> DataFrame:
    """One export for each `size` positions: several resources, scopes and spans, and levels without any."""
    number = F.call_function("div", F.col(position), F.lit(size)).alias("position")
    grouped = spans.groupBy("source_file", number).agg(F.collect_list(F.struct(*_ENCODED[1:])).alias("rows"))
    return grouped.mapInArrow(_encode_groups, "source_file string, position bigint, payload binary")


def write_segments(records: DataFrame, label: str, folder: str | None = None) -> str:
    """Write a segment per source_file, into a new folder or over those of a given one; returns the folder.

    records has source_file, position, payload and optionally fault: 'crc' spoils
    the checksum, 'zero' writes an empty record, 'long' claims too great a
    length, 'cut' ends the segment within the payload.
    """
    spark = records.sparkSession
    folder = folder or scratch_path(spark, label)
    target = local_path(folder).replace("s3a://", "s3://", 1)
    with_fault = "fault" in records.columns

    def frame(payload, fault):
        length, crc = len(payload), zlib.crc32(payload)
        if fault == "zero":
            return struct.pack("<II", 0, 0)
        if fault == "crc":
            crc ^= 1
        if fault == "long":
            length = 2**31
        return struct.pack("<II", length, crc) + (payload[: length // 2] if fault == "cut" else payload)

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        faults = table.column("fault").to_pylist() if with_fault else [None] * table.num_rows
        parts = []
        for payload, fault in zip(table.column("payload").to_pylist(), faults):
            parts.append(frame(payload, fault))
            if fault == "cut":
                break
        name = table.column("source_file")[0].as_py()
        files, root = arrow_fs.FileSystem.from_uri(target)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/{name}") as out:
            out.write(b"".join(parts))
        return pa.table({"source_file": [name], "size_bytes": pa.array([sum(map(len, parts))], pa.int64())})

    columns = ["source_file", "position", "payload", *(["fault"] if with_fault else [])]
    # a segment is a bounded piece: the derived names cut the table into runs of fixed length
    records.select(*columns).groupBy("source_file").applyInArrow(
        write, "source_file string, size_bytes bigint"
    ).write.format("noop").mode("overwrite").save()
    return folder
