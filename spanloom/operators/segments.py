"""Bookkeeping of write-ahead log segments as tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# States of a segment.
ACTIVE, SEALED, MATERIALIZED, DELETED, QUARANTINED = "ACTIVE", "SEALED", "MATERIALIZED", "DELETED", "QUARANTINED"

# The names a gateway gives its segments.
_NANOS_AND_SEQUENCE = r"^wal-(\d+)-(\d+)\.wal$"
_NUMBER_ONLY = r"^wal-(\d+)\.wal$"


def _number(pattern: str, group: int):
    return F.regexp_extract("filename", pattern, group).try_cast("bigint")


def ordered_segments(files: DataFrame) -> DataFrame:
    """Segments with their place in writing order; the last one is active.

    files has filename and size_bytes. Names of other forms sort first.
    """
    keyed = files.withColumns({
        "seg_nanos": F.coalesce(_number(_NANOS_AND_SEQUENCE, 1), F.lit(0)).cast("bigint"),
        "seg_seq": F.coalesce(
            _number(_NANOS_AND_SEQUENCE, 2), _number(_NUMBER_ONLY, 1), F.lit(0)
        ).cast("bigint"),
    })
    newest = keyed.agg(F.max(F.struct("seg_nanos", "seg_seq", "filename")).getField("filename"))
    return keyed.withColumn("is_active", F.col("filename") == newest.scalar())


def segment_progress(files: DataFrame, offsets: DataFrame, corruptions: DataFrame) -> DataFrame:
    """Segments with how far they are read and whether they could be deleted.

    A segment is deletable when it is sealed, read to its end and not damaged.
    Fully read follows from offset and size, so it also holds for a segment
    that was read while it was still active.
    """
    read = offsets.select(F.col("source_file").alias("filename"), F.col("max_offset").alias("read_bytes"))
    damaged = corruptions.select(F.col("source_file").alias("filename")).distinct().withColumn("_bad", F.lit(True))
    return (
        ordered_segments(files)
        .join(read, "filename", "left")
        .join(damaged, "filename", "left")
        .withColumn("read_bytes", F.coalesce("read_bytes", F.lit(0)))
        .withColumn("is_quarantined", F.col("_bad").isNotNull())
        .withColumn("is_fully_read", F.col("read_bytes") >= F.col("size_bytes"))
        .withColumn("is_deletable", F.col("is_fully_read") & ~F.col("is_active") & ~F.col("is_quarantined"))
        .select(
            "filename", "size_bytes", "seg_nanos", "seg_seq", "is_active",
            "read_bytes", "is_fully_read", "is_quarantined", "is_deletable",
        )
    )


def pending_segments(files: DataFrame, offsets: DataFrame, corruptions: DataFrame) -> DataFrame:
    """What a next run has to read: undamaged segments that grew past their offset."""
    read = offsets.select(F.col("source_file").alias("filename"), "max_offset")
    damaged = corruptions.select(F.col("source_file").alias("filename"))
    return (
        files.join(damaged, "filename", "left_anti")
        .join(read, "filename", "left")
        .withColumn("start_offset", F.coalesce("max_offset", F.lit(0)))
        .where(F.col("size_bytes") > F.col("start_offset"))
        .select("filename", "start_offset", "size_bytes")
    )


def highest_offsets(offsets: DataFrame) -> DataFrame:
    """High-water mark per segment from any number of notes on it."""
    return offsets.groupBy("source_file").agg(F.max("max_offset").alias("max_offset"))


def merged_offsets(known: DataFrame, progress: DataFrame) -> DataFrame:
    """High-water mark per segment; replayed progress never moves it back."""
    columns = ("source_file", "max_offset")
    return highest_offsets(known.select(*columns).unionByName(progress.select(*columns)))


def segment_states(progress: DataFrame) -> DataFrame:
    """filename, status, bytes_size of the segments that exist: quarantined, else active, materialized (sealed and read), or sealed."""
    status = (
        F.when(F.col("is_quarantined"), QUARANTINED)
        .when(F.col("is_active"), ACTIVE)
        .when(F.col("is_fully_read"), MATERIALIZED)
        .otherwise(SEALED)
    )
    return progress.select("filename", status.alias("status"), F.col("size_bytes").alias("bytes_size"))


def changed_segments(known: DataFrame, states: DataFrame) -> DataFrame:
    """Changes of state since the known ones; a segment that exists no more is deleted."""
    before = known.select(F.col("filename"), F.col("status").alias("was"), F.col("bytes_size").alias("size_before"))
    both = states.join(before, "filename", "full_outer")
    status = F.coalesce("status", F.lit(DELETED))
    return both.where(~status.eqNullSafe(F.col("was"))).select("filename", status.alias("status"), F.coalesce("bytes_size", "size_before").alias("bytes_size"))


def segment_lifecycle(changes: DataFrame) -> DataFrame:
    """Current status per segment from a log of changes; the latest one counts.

    changes has filename, status, bytes_size and a sequence number.
    """
    return (
        changes.groupBy("filename")
        .agg(F.max_by(F.struct("status", "bytes_size"), "sequence").alias("_last"))
        .select("filename", "_last.status", "_last.bytes_size")
    )


def dedupe_replay(spans: DataFrame) -> DataFrame:
    """One row per span of a log record, however often the record was replayed."""
    return spans.dropDuplicates(["source_file", "source_offset", "span_id"])
