"""Write-ahead log segments as a Spark data source, batch and streaming.

A segment is a file of records: u32 length, u32 CRC-32 (both little endian),
payload. Segments are append-only; the newest is still being written, all
others are sealed. Reading a segment stops at its first damaged record.

One segment is read by one task: record bounds follow only from the lengths
before them. The writer rotates segments at a fixed size, so this is a bounded
piece of work, and memory stays bounded whatever the size, because records
stream through in small Arrow batches. Many small segments share a task.
"""

import io
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import dataset
from pyarrow import fs as arrow_fs
from pyarrow import parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schema import FRAME
from ..session import local_path

MAX_RECORD_BYTES = 64 * 1024 * 1024
SPLIT_BYTES = 128 * 1024 * 1024
_SMALLEST_SPLIT = 1024 * 1024
_BATCH_BYTES, _BATCH_ROWS = 8 * 1024 * 1024, 10_000
_HEADER, _HEADER_BYTES = "<II", 8
#: Late segments that one batch takes up.
LATE = 100
_ARROW = pa.schema([
    ("source_file", pa.string()),
    ("source_offset", pa.int64()),
    ("end_offset", pa.int64()),
    ("payload", pa.binary()),
    ("corrupt_reason", pa.string()),
])


def segment_order(name: str) -> tuple[int, int, str]:
    """Writing order: time, then sequence number, then name."""
    parts = re.fullmatch(r"wal-(\d+)(?:-(\d+))?\.wal", name)
    if not parts:
        return 0, 0, name
    first, second = parts.groups()
    return (int(first), int(second), name) if second else (0, int(first), name)


@dataclass
class Piece:
    """Bytes start..stop of one segment; an open tail may end in a half record."""

    name: str
    start: int
    stop: int
    open_tail: bool = False


@dataclass
class SegmentTask(InputPartition):
    pieces: list[Piece] = field(default_factory=list)


def _file_system(path: str):
    return arrow_fs.FileSystem.from_uri(local_path(path).replace("s3a://", "s3://", 1))


class ReadMarks:
    """How far each segment was read, from a table of (source_file, end_offset) in the shared folder."""

    def __init__(self, path: str):
        self.fs, self.path = _file_system(path)

    def load(self) -> dict[str, int]:
        if self.fs.get_file_info(self.path).type == arrow_fs.FileType.NotFound:
            return {}
        rows = dataset.dataset(self.path, filesystem=self.fs, format="parquet").to_table(columns=["source_file", "end_offset"])
        most = rows.group_by("source_file").aggregate([("end_offset", "max")])
        return dict(zip(most.column("source_file").to_pylist(), most.column("end_offset_max").to_pylist()))

    def write(self, folder: str, batch_id: int, ends: dict[str, int]) -> None:
        """One file that appears as a whole, in a folder of its own."""
        names = sorted(ends)
        rows = pa.table({
            "batch_id": pa.array([batch_id] * len(names), pa.int64()), "source_file": pa.array(names, pa.string()), "end_offset": pa.array([ends[n] for n in names], pa.int64()),
        })
        self.fs.create_dir(f"{self.path}/{folder}", recursive=True)
        unseen, seen = f"{self.path}/{folder}/_marks.parquet", f"{self.path}/{folder}/marks.parquet"
        with self.fs.open_output_stream(unseen) as out:
            parquet.write_table(rows, out)
        self.fs.move(unseen, seen)


class _Folder:
    """The segment folder on whatever file system its URI names."""

    def __init__(self, options):
        options = {k.lower(): v for k, v in options.items()}
        self.fs, self.root = _file_system(options["path"])
        self.max_record = int(options.get("maxrecordbytes", MAX_RECORD_BYTES))
        self.strict = str(options.get("strict", "false")).lower() == "true"
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.parallelism = int(options.get("parallelism", 1))
        self.batch_bytes = int(options.get("maxbytesperbatch", 0))
        self.marks = ReadMarks(options["markspath"]) if options.get("markspath") else None

    def segments(self) -> list[tuple[str, int]]:
        """(name, size) in writing order."""
        found = self.fs.get_file_info(arrow_fs.FileSelector(self.root, allow_not_found=True))
        names = [(f.base_name, f.size) for f in found if f.is_file and f.base_name.endswith(".wal")]
        return sorted(names, key=lambda s: segment_order(s[0]))

    def open(self, name: str, at: int):
        raw = self.fs.open_input_file(f"{self.root}/{name}")
        handle = io.BufferedReader(raw, 1 << 20)
        handle.seek(at)
        return handle

    def tasks(self, pieces: list[Piece]) -> list[SegmentTask]:
        """Pack pieces so that tasks are even and none is tiny."""
        total = sum(p.stop - p.start for p in pieces)
        # two tasks per core even out segments of different density
        target = min(self.split, max(_SMALLEST_SPLIT, total // max(2 * self.parallelism, 1)))
        tasks, filled = [], target
        for piece in pieces:
            if filled >= target:
                tasks.append(SegmentTask([]))
                filled = 0
            tasks[-1].pieces.append(piece)
            filled += piece.stop - piece.start
        return tasks

    def last_boundary(self, name: str, start: int, size: int) -> int:
        """End of the last whole record, from the headers alone.

        At a header that no writer produces the answer is the full size, so that
        a task gets to see and report the damage.
        """
        at = start
        with self.open(name, start) as handle:
            while at + _HEADER_BYTES <= size:
                length, _ = struct.unpack(_HEADER, handle.read(_HEADER_BYTES))
                if not 0 < length <= self.max_record:
                    return size
                if at + _HEADER_BYTES + length > size:
                    break
                at = handle.seek(length, io.SEEK_CUR)
        return at

    def records(self, piece: Piece) -> Iterator[tuple]:
        # fixed values: the reasons of damage
        at = piece.start
        with self.open(piece.name, at) as handle:
            while at < piece.stop:
                room = piece.stop - at
                header = handle.read(min(_HEADER_BYTES, room))
                reason, payload = None, None
                if len(header) < _HEADER_BYTES:
                    if piece.open_tail:
                        return
                    reason = f"truncated WAL header: {len(header)} of {_HEADER_BYTES} bytes"
                else:
                    length, wanted = struct.unpack(_HEADER, header)
                    if length == 0:
                        reason = "invalid zero-length record"
                    elif length > self.max_record:
                        reason = f"oversized WAL record: {length} bytes, limit {self.max_record}"
                    else:
                        payload = handle.read(min(length, room - _HEADER_BYTES))
                        if len(payload) < length:
                            if piece.open_tail:
                                return
                            reason = f"truncated WAL payload: {len(payload)} of {length} bytes"
                        elif (actual := zlib.crc32(payload)) != wanted:
                            reason = f"WAL checksum mismatch: expected 0x{wanted:08x}, got 0x{actual:08x}"
                if reason:
                    yield piece.name, at, None, None, reason
                    return
                end = at + _HEADER_BYTES + length
                yield piece.name, at, end, payload, None
                at = end

    def batches(self, task: SegmentTask) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for piece in task.pieces:
            for row in self.records(piece):
                rows.append(row)
                held += len(row[3] or b"")
                if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class WalReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        folder = _Folder(self.options)
        segments = folder.segments()
        # a half record at the end of the newest segment is not there yet
        pieces = [
            Piece(name, 0, size, open_tail=not folder.strict and i == len(segments) - 1)
            for i, (name, size) in enumerate(segments)
            if size
        ]
        return folder.tasks(pieces) or [SegmentTask([])]

    def read(self, partition):
        return _Folder(self.options).batches(partition)


def read_through(offset: dict, name: str, size: int) -> int:
    """How many bytes of a segment an offset counts, late ones aside."""
    if offset.get("through") and segment_order(name) <= segment_order(offset["through"]):
        return size
    return offset.get("open", {}).get(name, 0)


def _place(offset: dict) -> tuple:
    """For telling which of two offsets is further."""
    through = segment_order(offset["through"]) if offset.get("through") else (-1, -1, "")
    return through, sorted((segment_order(n), at) for n, at in offset.get("open", {}).items())


class WalStreamReader(DataSourceStreamReader):
    """An offset is a name, a position and a few exceptions, however many segments there are.

    `through` names the last segment in writing order up to which all are read:
    segments are sealed in that order, as a rule. `open` holds the position in the
    newest one, up to its last whole record, which the driver finds by hopping over the
    headers that are new since the last poll. `late` holds what else the batch reads:
    bytes from and to of segments at or before `through` that were listed later or
    have grown since, LATE of them at most; others wait for the next batch. A late segment
    may still be on its way, so it is read up to its last whole record as well. What lies at or
    before `since`, where the reader stood when it made the offset, is read as late or not at all.

    The engine does not tell a restarted reader where it stands. What was read is
    looked up in the table in marksPath, which the batches write before they are
    done; a batch that has to be repeated is named by the engine itself. Without
    the table (in a lake from before it) all that is listed first counts as read
    once the first offset covers it.

    With maxBytesPerBatch an offset moves ahead by whole segments until so many
    bytes are new.
    """

    def __init__(self, options):
        self.options = options
        self.last: dict | None = None
        self.marks: dict[str, int] = {}

    def initialOffset(self):
        return {"through": "", "open": {}, "late": {}, "since": ""}

    def _begin(self, folder, segments) -> None:
        """Where the batches before ended, by the table: all before the newest segment that was read count as passed."""
        if self.last is not None:
            return
        self.last = self.initialOffset()
        self.marks = folder.marks.load() if folder.marks else {}
        begun = [i for i, (name, _) in enumerate(segments) if self.marks.get(name)]
        if begun:
            newest = segments[begun[-1]][0]
            before = segments[begun[-1] - 1][0] if begun[-1] else ""
            self.last = self.initialOffset() | {"through": before, "open": {newest: self.marks[newest]}}

    def latestOffset(self):
        folder = _Folder(self.options)
        segments = folder.segments()
        self._begin(folder, segments)
        late, taken = self._late(folder, segments)
        end = self._end(folder, segments, taken) | {"late": late, "since": self.last["through"]}
        if not late and _place(end) == _place(self.last):
            return self.last
        passed = self.last["through"]
        for name, size in segments:
            if not passed or segment_order(name) > segment_order(passed):
                self._mark(name, read_through(end, name, size))
        for name, (_, stop) in late.items():
            self._mark(name, stop)
        self.last = end
        return end

    def _mark(self, name: str, at: int) -> None:
        if at > self.marks.get(name, 0):
            self.marks[name] = at

    def _late(self, folder, segments) -> tuple[dict, int]:
        through, late, taken = self.last["through"], {}, 0
        for name, size in segments if through else ():
            if segment_order(name) > segment_order(through):
                break
            had = self.marks.get(name, 0)
            if size > had and len(late) < LATE and not (folder.batch_bytes and taken >= folder.batch_bytes):
                stop = folder.last_boundary(name, had, size)
                if stop > had:
                    late[name] = [had, stop]
                    taken += stop - had
        return late, taken

    def _end(self, folder, segments, taken: int) -> dict:
        through, opened, limit = self.last["through"], self.last["open"], folder.batch_bytes
        after = [s for s in segments if not through or segment_order(s[0]) > segment_order(through)]

        def so_far():
            return {name: at for name, at in opened.items() if not through or segment_order(name) > segment_order(through)}

        for name, size in after[:-1]:  # sealed, in writing order
            if limit and taken >= limit:
                return {"through": through, "open": so_far()}
            taken += size - opened.get(name, 0)
            through = name
        position = so_far()
        for name, size in after[-1:]:
            before = min(opened.get(name, 0), size)
            if size > before and not (limit and taken >= limit):
                before = size if folder.strict else folder.last_boundary(name, before, size)
            if before:
                position[name] = before
        return {"through": through, "open": position}

    def partitions(self, start, end):
        folder = _Folder(self.options)
        segments = folder.segments()
        self._begin(folder, segments)
        since = end.get("since")
        pieces = [
            Piece(name, read_through(start, name, size), read_through(end, name, size))
            for name, size in segments
            if not since or segment_order(name) > segment_order(since)
        ]
        pieces = [p for p in pieces if p.stop > p.start] + [Piece(name, *bounds, open_tail=True) for name, bounds in end.get("late", {}).items()]
        for piece in pieces:
            self._mark(piece.name, piece.stop)
        if _place(end) > _place(self.last):  # a batch from before the restart
            self.last = end
        return folder.tasks(pieces) or [SegmentTask([])]

    def read(self, partition):
        return _Folder(self.options).batches(partition)

    def commit(self, end):
        pass


class WalSource(DataSource):
    @classmethod
    def name(cls):
        return "wal"

    def schema(self):
        return FRAME

    def reader(self, schema):
        return WalReader(dict(self.options))

    def streamReader(self, schema):
        return WalStreamReader(dict(self.options))


def _options(spark: SparkSession, path: str, max_record_bytes: int, strict: bool) -> dict:
    spark.dataSource.register(WalSource)
    return {
        "path": path,
        "maxRecordBytes": max_record_bytes,
        "strict": strict,
        "parallelism": spark.sparkContext.defaultParallelism,
    }


def read_wal(
    spark: SparkSession, path: str, max_record_bytes: int = MAX_RECORD_BYTES, strict: bool = False
) -> DataFrame:
    """All records of a segment folder, and one row for each damaged segment.

    strict also reports a half-written record at the end of the newest segment.
    """
    return spark.read.format("wal").options(**_options(spark, path, max_record_bytes, strict)).load()


def stream_wal(
    spark: SparkSession,
    path: str,
    max_record_bytes: int = MAX_RECORD_BYTES,
    strict: bool = False,
    max_bytes_per_batch: int = 0,
    marks_path: str = "",
) -> DataFrame:
    """The same as an unbounded stream that follows the folder.

    max_bytes_per_batch bounds a micro-batch, to whole segments. marks_path names the table
    of (source_file, end_offset) in which the batches note how far they read.
    """
    options = _options(spark, path, max_record_bytes, strict)
    options |= {"maxBytesPerBatch": max_bytes_per_batch, "marksPath": marks_path}
    return spark.readStream.format("wal").options(**options).load()


def list_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segment files and their sizes. The contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.wal")
        .load(path)
        .select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"))
    )
