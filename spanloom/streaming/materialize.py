"""Segments to span lake as one Structured Streaming query."""

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lakefiles import current_manifest, recent_corruptions, storage_status
from ..sources import lake as lakes
from ..sources.otlp import MaxPerName, decode_exports, flatten_exports
from ..sources.wal import LATE, MAX_RECORD_BYTES, list_segments, stream_wal

POLL = {"processingTime": "2 seconds"}
DRAIN = {"availableNow": True}
_MALFORMED = "malformed"


#: Batches after which their notes are folded and the state of segments is logged.
UPKEEP_BATCHES = 64


def _batch_writer(wal: str, lake: str, max_records_per_file: int, project_keys, written: list[int]):
    """foreachBatch function. Order of effects: data, damage, how far the segments
    are read, then the manifest entry that makes the batch visible; the checkpoint
    follows after that. Only the first batch of a run can be a replay: if the
    manifest has it already it is skipped, otherwise it overwrites its own
    leftovers. Damaged segments are looked up when the run begins and whenever a
    batch has found new ones."""
    begun, damaged = False, None

    def write(batch: DataFrame, batch_id: int) -> None:
        nonlocal begun, damaged
        spark = batch.sparkSession
        name = f"batch-{batch_id:012d}"
        replayed = not begun and lakes.is_committed(spark, lake, name)
        begun = True
        if damaged is None:
            known = lakes.corruptions(spark, lake).where("ends_segment").select("source_file")
            damaged = () if known.isEmpty() else known
        if replayed:
            return
        # damage found by an earlier batch ends the segment for good
        frames = batch.join(damaged, "source_file", "left_anti") if isinstance(damaged, DataFrame) else batch
        reached = spark.sparkContext.accumulator({}, MaxPerName())
        decoded = decode_exports(frames, project_keys, reached)
        seen = Observation(f"damage-{name}")
        watched = decoded.observe(seen, F.count("corrupt_reason").alias("damaged"))
        rows = lakes.write_commit(flatten_exports(watched), lake, name, max_records_per_file)
        ends = dict(reached.value)
        if seen.get["damaged"]:
            damaged = None
            events = (
                decode_exports(frames, project_keys).where(F.col("corrupt_reason").isNotNull())
                .select(
                    "source_file",
                    "source_offset",
                    F.col("corrupt_reason").alias("reason"),
                    (~F.col("corrupt_reason").startswith(_MALFORMED)).alias("ends_segment"),
                    F.current_timestamp().alias("detected_at"),
                )
            )
            path = f"{lake}/corruptions/batch_id={batch_id}"
            events.write.mode("overwrite").parquet(path)
            # what follows the damage is never read, so the segment is done with as it is now
            ended = spark.read.schema(events.schema).parquet(path).where("ends_segment").select(F.col("source_file").alias("filename"))
            ends |= {row.filename: row.size_bytes for row in list_segments(spark, wal).join(ended, "filename", "left_semi").collect()}
        lakes.write_marks(spark, lake, batch_id, ends)
        if rows:
            lakes.publish(spark, lake, name, rows)
            written.append(rows)
        if batch_id % UPKEEP_BATCHES == UPKEEP_BATCHES - 1:
            upkeep(spark, wal, lake)

    return write


def upkeep(spark: SparkSession, wal: str, lake: str) -> None:
    """Fold the batches' notes and log what became of the segments."""
    lakes.fold_marks(spark, lake)
    lakes.log_segment_changes(spark, lake, list_segments(spark, wal))


def materialize(
    spark: SparkSession,
    wal_path: str,
    lake: str,
    trigger: dict | None = None,
    max_records_per_file: int = 0,
    max_record_bytes: int = MAX_RECORD_BYTES,
    strict: bool = False,
    project_keys=("project.id",),
    max_bytes_per_batch: int = 0,
    written: list[int] | None = None,
) -> StreamingQuery:
    """Start to follow the segments and append their spans to the lake.

    The default trigger polls every two seconds; DRAIN reads what is there, or
    one batch of max_bytes_per_batch, and stops. Memory does not depend on the
    batch size, but what a failed driver has to do again does. The checkpoint
    lies in the lake, since both belong together.
    """
    writer = _batch_writer(wal_path, lake, max_records_per_file, tuple(project_keys), [] if written is None else written)
    return (
        stream_wal(spark, wal_path, max_record_bytes, strict, max_bytes_per_batch, lakes.marks_path(lake))
        .writeStream.foreachBatch(writer)
        .option("checkpointLocation", f"{lake}/_checkpoint")
        .trigger(**(trigger or POLL))
        .start()
    )


def materialize_available(spark: SparkSession, wal_path: str, lake: str, **options) -> int:
    """Read everything that is there, wait for it, and return the spans written.

    With max_bytes_per_batch the segments are read in runs of one batch each, so
    a failed driver repeats one batch at most. A batch takes up LATE late segments
    at most: one that did so is followed by another run as well.
    """
    written: list[int] = []
    while True:
        query = materialize(spark, wal_path, lake, trigger=DRAIN, written=written, **options)
        query.awaitTermination()
        progress = query.lastProgress
        if not (progress and progress.numInputRows):
            break
        late = json.loads(progress.json)["sources"][0]["endOffset"].get("late", {})
        if not options.get("max_bytes_per_batch") and len(late) < LATE:
            break
    if written:
        lakes.log_segment_changes(spark, lake, list_segments(spark, wal_path))
    return sum(written)


def system_status(spark: SparkSession, wal_path: str, lake: str) -> DataFrame:
    """storage_status of a deployment: one row, with the latest ten damage events."""
    projects = lakes.committed_spans(spark, lake).where("project_id IS NOT NULL").select("project_id").distinct()
    damage = lakes.corruptions(spark, lake)
    state = storage_status(
        list_segments(spark, wal_path), lakes.read_offsets(spark, lake), lakes.list_commits(spark, lake),
        current_manifest(lakes.manifest_log(spark, lake)), damage, projects,
    )
    event = F.struct(F.col("detected_at"), F.col("batch_id"), F.col("source_file"), F.col("source_offset"), F.col("reason"))
    latest = recent_corruptions(damage).agg(F.collect_list(event).alias("latest_corruptions"))
    return state.withColumn("_one", F.lit(1)).join(latest.withColumn("_one", F.lit(1)), "_one").drop("_one")
