"""The span lake: Parquet commits, a manifest that decides what is visible.

    <lake>/spans/commit=<name>/start_date=<day>/*.parquet
    <lake>/manifest/slot=<hour>/     append-only log of commit states, a file an entry
    <lake>/manifest_base/roll=<n>/   states rolled up, and the names of the entries they hold
    <lake>/corruptions/batch_id=<n>/ damage found while reading segments
    <lake>/offsets/                  how far each batch read its segments
    <lake>/segments/                 log of what became of segments
    <lake>/failures/                 failures of the stream

A commit is written first and named in the manifest afterwards, in one file
that Spark's output committer puts in place with a rename. Readers take their
list of commits from the manifest, so unfinished or replaced commits are never
seen, and open the folders of these commits alone.
"""

import time
import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.genai import with_promoted
from ..functions.times import day_of
from ..operators.clustering import cuts_of, z_place
from ..operators.lakefiles import COMMITTED, COMPACTED, compaction_plan, current_manifest
from ..operators.segments import changed_segments, highest_offsets, segment_lifecycle, segment_progress, segment_states
from ..schema import CORRUPTION, MANIFEST, READ_MARK, SEGMENT_CHANGE, SPAN, STREAM_FAILURE
from .wal import ReadMarks

TARGET_FILE_BYTES = 256 * 1024 * 1024
#: Rows of a file, which one task sorts: well compressed spans take many times their file's size there.
FILE_ROWS = 500_000
_LAKE = T.StructType(SPAN.fields + [
    T.StructField("gen_ai_model", T.StringType()),
    T.StructField("gen_ai_system", T.StringType()),
    T.StructField("gen_ai_input_tokens", T.LongType()),
    T.StructField("gen_ai_output_tokens", T.LongType()),
])
# A rolled-up row is either a state or the name of an entry that the states hold.
_ROLLED = T.StructType([T.StructField(f.name, f.dataType) for f in MANIFEST.fields] + [
    T.StructField("entry", T.StringType()), T.StructField("roll", T.LongType()),
])
#: Columns by which compaction clusters within a day.
CLUSTERED = ["project_id", "service_name", "trace_id"]
#: Entries beside the roll-up from which a new one is made.
ROLL_ENTRIES = 64
_LAYOUT = T.StructType(_LAKE.fields + [
    T.StructField("commit", T.StringType()), T.StructField("start_date", T.DateType()),
])


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet folder, or no rows while nothing has been written to it."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _slot(now: datetime) -> str:
    return f"{now:%Y-%m-%dT%H}"


def _entries(spark: SparkSession, lake: str) -> DataFrame:
    """Rows of the manifest log with the file they stand in, as of now."""
    log = _table(spark, f"{lake}/manifest", MANIFEST)
    return log.withColumn("path", F.input_file_name()).withColumn("entry", F.element_at(F.split("path", "/"), -1))


def _newest_base(spark: SparkSession, lake: str) -> tuple[int, DataFrame]:
    bases = _table(spark, f"{lake}/manifest_base", _ROLLED)
    newest = bases.agg(F.max("roll")).first()[0] or 0
    return newest, bases.where(F.col("roll") == newest)


def _beside(entries: DataFrame, base: DataFrame) -> DataFrame:
    """Entries that the roll-up does not hold, by name: when they were written does not matter."""
    return entries.join(base.where("entry IS NOT NULL").select("entry"), "entry", "left_anti")


def manifest_log(spark: SparkSession, lake: str) -> DataFrame:
    """Commit states of the newest roll-up and of every entry that it does not hold.

    The roll-up is read first: an entry file is only removed after two roll-ups hold it.
    """
    _, base = _newest_base(spark, lake)
    states = base.where("entry IS NULL").select(*MANIFEST.fieldNames())
    return states.unionByName(_beside(_entries(spark, lake), base).select(*MANIFEST.fieldNames()))


def roll_manifest(spark: SparkSession, lake: str, at_least: int = ROLL_ENTRIES) -> bool:
    """Gather the entries in one file, so that reading the manifest does not open one
    small file per micro-batch ever written. True if a roll-up was made.

    The roll-up names the entries it holds, so an entry that appears late, under
    whatever hour, is read beside it. States of replaced commits that cannot be
    replayed are dropped (compactions, and batches before the last one), and entry
    files that the roll-up before held as well are removed. Like compaction, one
    at a time per lake: a second one with the same number fails.
    """
    roll, base = _newest_base(spark, lake)
    entries = _entries(spark, lake)
    beside = _beside(entries, base)
    if beside.select("entry").distinct().count() < at_least:
        return False
    every = base.where("entry IS NULL").select(*MANIFEST.fieldNames()).unionByName(beside.select(*MANIFEST.fieldNames()))
    latest = every.groupBy("filename").agg(F.max_by(F.struct(*MANIFEST.fieldNames()), "version").alias("_last")).select("_last.*")
    batch = F.col("filename").startswith("batch-")
    last_batch = latest.where(batch).agg(F.max("filename")).first()[0]
    gone = (F.col("status") == COMPACTED) & (F.col("filename").startswith("compacted-") | (batch & (F.col("filename") < F.lit(last_batch))))
    states = latest.where(~F.coalesce(gone, F.lit(False))).withColumn("entry", F.lit(None).cast("string"))
    held = entries.select("entry").distinct()
    rows = states.unionByName(held, allowMissingColumns=True)
    # what may go once the new roll-up stands: held before, so held twice
    twice = entries.join(base.where("entry IS NOT NULL").select("entry"), "entry", "left_semi").select("path").distinct()
    removable = [row.path for row in twice.collect()]
    # one file, so it appears as a whole
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{lake}/manifest_base/roll={roll + 1}")
    _remove(spark, removable + ([f"{lake}/manifest_base/roll={roll - 1}"] if roll > 1 else []))
    return True


def _remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete files or folders on whatever file system their names say."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        target = hadoop(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def corruptions(spark: SparkSession, lake: str) -> DataFrame:
    return _table(spark, f"{lake}/corruptions", CORRUPTION)


def _appended(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a folder of folders, whatever their names."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_marks(spark: SparkSession, lake: str) -> DataFrame:
    """batch_id, source_file, end_offset as the batches wrote them."""
    return _appended(spark, marks_path(lake), READ_MARK)


def marks_path(lake: str) -> str:
    return f"{lake}/offsets"


def read_offsets(spark: SparkSession, lake: str) -> DataFrame:
    """source_file, max_offset: the high-water mark of each segment, also when nothing runs."""
    return highest_offsets(read_marks(spark, lake).select("source_file", F.col("end_offset").alias("max_offset")))


def write_marks(spark: SparkSession, lake: str, batch_id: int, ends: dict[str, int]) -> None:
    """Note how far a batch read its segments; a batch that is repeated overwrites its own note.

    The driver has the few rows, and the reader of segments opens the same file system, so no job is run for them.
    """
    if ends:
        ReadMarks(marks_path(lake)).write(f"batch-{batch_id:012d}", batch_id, ends)


def fold_marks(spark: SparkSession, lake: str) -> None:
    """One file in place of the notes of many batches. Only the greatest mark of a segment counts,
    so notes that were folded and not yet removed change nothing. For the one who writes the notes."""
    marks = read_marks(spark, lake).withColumn("folder", F.regexp_extract(F.input_file_name(), r"/offsets/([^/]+)/[^/]+$", 1))
    folders = [row.folder for row in marks.select("folder").distinct().collect()]
    if len(folders) > 1:
        most = marks.groupBy("source_file").agg(F.max("batch_id").alias("batch_id"), F.max("end_offset").alias("end_offset"))
        most.select(*READ_MARK.fieldNames()).coalesce(1).write.parquet(f"{marks_path(lake)}/folded-{uuid.uuid4().hex}")
        _remove(spark, [f"{marks_path(lake)}/{folder}" for folder in folders])


def segment_changes(spark: SparkSession, lake: str) -> DataFrame:
    """The log of what became of segments."""
    return _appended(spark, f"{lake}/segments", SEGMENT_CHANGE)


def log_segment_changes(spark: SparkSession, lake: str, files: DataFrame) -> None:
    """Append the segments whose state is not the logged one: files has filename and size_bytes of those that exist.

    Each input has a row per segment, or a few; as one partition they are joined in one task without any shuffle.
    """
    offsets = highest_offsets(read_marks(spark, lake).coalesce(1).select("source_file", F.col("end_offset").alias("max_offset")))
    damaged = corruptions(spark, lake).coalesce(1).where("ends_segment")
    now = segment_states(segment_progress(files.coalesce(1), offsets, damaged))
    changed = changed_segments(segment_lifecycle(segment_changes(spark, lake).coalesce(1)), now)
    stamped = changed.select("*", F.lit(time.time_ns()).alias("sequence"), F.current_timestamp().alias("changed_at"))
    stamped.write.mode("append").parquet(f"{lake}/segments")


def stream_failures(spark: SparkSession, lake: str) -> DataFrame:
    """Failures of the followed stream, as the supervisor noted them."""
    return _appended(spark, f"{lake}/failures", STREAM_FAILURE)


def note_failure(spark: SparkSession, lake: str, batch_id: int | None, attempt: int, message: str, gave_up: bool) -> None:
    row = (datetime.now(timezone.utc), batch_id, attempt, message[:4000], gave_up)
    spark.createDataFrame([row], STREAM_FAILURE).coalesce(1).write.mode("append").parquet(f"{lake}/failures")


def quarantined_segments(spark: SparkSession, lake: str) -> DataFrame:
    """Lifecycle changes of damaged segments: filename, status, bytes_size (what is sound), sequence."""
    return corruptions(spark, lake).where("ends_segment").select(
        F.col("source_file").alias("filename"), F.lit("QUARANTINED").alias("status"),
        F.col("source_offset").alias("bytes_size"), F.col("batch_id").alias("sequence"),
    )


def _data_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """filename (of the commit), size_bytes, modified_at, is_tmp by the Parquet files below these folders."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", True)
        .load(paths)
    )
    return (
        files.select(F.regexp_extract("path", r"/commit=([^/]+)/", 1).alias("filename"), "length", "modificationTime")
        .groupBy("filename")
        .agg(F.sum("length").alias("size_bytes"), F.max("modificationTime").alias("modified_at"))
        .withColumn("is_tmp", F.lit(False))
    )


def list_commits(spark: SparkSession, lake: str) -> DataFrame:
    """Commits that exist as files: filename, size_bytes, modified_at, is_tmp. Contents are not read.

    A commit with an output folder of unfinished tasks is listed once more as
    temporary, with the time of that folder.
    """
    whole = _data_files(spark, [f"{lake}/spans"])
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{lake}/spans/commit=*/_temporary")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    unfinished = [
        (f"{f.getPath().getParent().getName().removeprefix('commit=')}/_temporary", 0, datetime.fromtimestamp(f.getModificationTime() / 1000, timezone.utc), True)
        for f in found
    ]
    return whole.unionByName(spark.createDataFrame(unfinished, "filename string, size_bytes bigint, modified_at timestamp, is_tmp boolean"))


def _append_manifest(spark: SparkSession, lake: str, entries: list[tuple[str, int, str]]) -> None:
    version, now = time.time_ns(), datetime.now(timezone.utc)
    rows = [(name, count, status, version, now) for name, count, status in entries]
    # one partition, so one file: the entries become visible together
    log = f"{lake}/manifest/slot={_slot(now)}"
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(log)


def is_committed(spark: SparkSession, lake: str, name: str) -> bool:
    """True once the manifest has named the commit, also after a compaction."""
    named = F.col("filename") == name
    if not _table(spark, f"{lake}/manifest", MANIFEST).where(named).isEmpty():
        return True
    bases = _table(spark, f"{lake}/manifest_base", _ROLLED).where(named)
    return not bases.isEmpty()


def _bounded_tasks(spans: DataFrame) -> DataFrame:
    """The same rows in tasks of about FILE_ROWS rows at most, few days in each; as they are if they are no more than that.

    Rows have numbers by day, and within a day by the hash of their ids; a task takes a run of numbers. So a day of any size
    and a trace of any size spread over tasks, and the files are few. Rows are counted by day first (metadata: a folder each).
    """
    day = F.coalesce(F.unix_date(day_of("start_time_unix_nano")), F.lit(-1))
    sizes = {row.day: row.n for row in spans.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    if total <= FILE_ROWS:
        return spans
    tasks = max(-(-total // FILE_ROWS), spans.sparkSession.sparkContext.defaultParallelism)
    numbers, before = [], 0
    for key in sorted(sizes):
        numbers += [F.lit(key), F.struct(F.lit(before).cast("bigint").alias("first"), F.lit(sizes[key]).cast("bigint").alias("n"))]
        before += sizes[key]
    of_day = F.element_at(F.create_map(*numbers), day)
    number = of_day["first"] + F.pmod(F.xxhash64("trace_id", "span_id", "source_file", "source_offset"), of_day["n"])
    # a day that was not there when rows were counted goes to the first task
    task = F.coalesce(F.call_function("div", number * tasks, F.lit(total)).cast("int"), F.lit(0))
    return spans.withColumn("_task", task).repartitionById(tasks, "_task").drop("_task")


def write_commit(spans: DataFrame, lake: str, name: str, max_records_per_file: int = 0, spread: bool = False) -> int:
    """Write span files of a commit without making them visible. Returns the rows.

    They are counted as they are written: the write is the last stage of its job, where
    Spark takes the numbers of one successful attempt of each task.

    Rows stay in the tasks that produced them and are only sorted there: a
    micro-batch is not worth a shuffle, compaction clusters later. Its tasks read
    segments, which are bounded; where tasks may have any number of rows, spread
    deals them out before. The model request values are parsed out of the JSON
    once, here, and kept as columns.
    """
    path = f"{lake}/spans/commit={name}"
    counted = Observation(f"rows-{uuid.uuid4().hex}")
    (
        with_promoted(_bounded_tasks(spans) if spread else spans)
        .observe(counted, F.count(F.lit(1)).alias("rows"))
        .withColumn("start_date", day_of("start_time_unix_nano"))
        .sortWithinPartitions("start_date", "trace_id")
        .write.mode("overwrite")
        .partitionBy("start_date")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", max_records_per_file)
        .option("parquet.bloom.filter.enabled#trace_id", "true")
        .option("parquet.bloom.filter.expected.ndv#trace_id", "100000")
        .parquet(path)
    )
    return counted.get["rows"]


def publish(spark: SparkSession, lake: str, name: str, rows: int) -> None:
    _append_manifest(spark, lake, [(name, rows, COMMITTED)])


def append_spans(spans: DataFrame, lake: str, name: str, max_records_per_file: int = 0) -> int:
    """Write and publish a commit; a name that is already published is left alone."""
    spark = spans.sparkSession
    if is_committed(spark, lake, name):
        return 0
    rows = write_commit(spans, lake, name, max_records_per_file, spread=True)
    if rows:
        publish(spark, lake, name, rows)
    return rows


def _commit_rows(spark: SparkSession, lake: str, names: list[str]) -> DataFrame:
    """Rows of the named commits; no other folder is listed."""
    if not names:
        return spark.createDataFrame([], _LAYOUT)
    root = f"{lake}/spans"
    return spark.read.schema(_LAYOUT).option("basePath", root).parquet(*[f"{root}/commit={name}" for name in sorted(names)])


def live_commits(spark: SparkSession, lake: str) -> list[str]:
    """Names of the commits that count now. Metadata: compaction keeps the list short."""
    live = current_manifest(manifest_log(spark, lake)).where(F.col("status") == COMMITTED)
    return sorted(row.filename for row in live.select("filename").collect())


def lake_spans(
    spark: SparkSession, lake: str, first_day: str | None = None, last_day: str | None = None, keep_day: bool = False
) -> DataFrame:
    """Everything the manifest commits: the canonical columns and the kept request values
    (keep_day: and start_date, by which folders are pruned).

    The list of commits is fixed when this is called, so a query sees one state
    of the lake. It is metadata: compaction keeps it short. With days given,
    folders of other days are not read.
    """
    rows = _commit_rows(spark, lake, live_commits(spark, lake))
    day = F.col("start_date")
    if first_day:
        rows = rows.where(day >= F.lit(first_day).cast("date"))
    if last_day:
        rows = rows.where(day <= F.lit(last_day).cast("date"))
    return rows.select(*_LAKE.fieldNames(), *(["start_date"] if keep_day else []))


def committed_spans(spark: SparkSession, lake: str) -> DataFrame:
    """The canonical span columns of everything the manifest commits."""
    return lake_spans(spark, lake).select(*SPAN.fieldNames())


def compact(spark: SparkSession, lake: str, max_files: int = 20, target_bytes: int = TARGET_FILE_BYTES) -> int:
    """Merge the first small commits by name into one. Returns the rows rewritten.

    Commits of half the target size and more stay as they are; only folders of live commits are listed.
    The new commit is range-partitioned by day and, within a day, along a curve through project,
    service and trace, so its files are narrow in each of the three and a filter on any of them skips
    most. A file has the target size or FILE_ROWS rows, whichever is less. One manifest append swaps old for new. Run one compaction at a time per lake.
    """
    manifest = current_manifest(manifest_log(spark, lake))
    live = live_commits(spark, lake)
    if not live:
        return 0
    listing = _data_files(spark, [f"{lake}/spans/commit={name}" for name in live])
    chosen = compaction_plan(manifest, listing, max_files, below_bytes=target_bytes // 2).join(listing, "filename").collect()
    if len(chosen) < 2:
        return 0
    names = [row.filename for row in chosen]
    total = sum(row.record_count for row in chosen)
    files = max(1, -(-sum(row.size_bytes for row in chosen) // target_bytes), -(-total // FILE_ROWS))
    rows = _commit_rows(spark, lake, names)
    if files > 1:
        rows = rows.withColumn("_place", z_place(cuts_of(rows, CLUSTERED, total)))
    else:
        rows = rows.withColumn("_place", F.lit(0))
    # trace, start and span id as well, so that one cell, or a very large trace, spreads over files
    order = ["start_date", "_place", "trace_id", "start_time_unix_nano", "span_id"]
    merged = rows.repartitionByRange(files, *order)
    name = f"compacted-{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    count = write_commit(merged.select(*_LAKE.fieldNames()), lake, name)
    _append_manifest(spark, lake, [(name, count, COMMITTED), *[(n, 0, COMPACTED) for n in names]])
    roll_manifest(spark, lake)
    return count
