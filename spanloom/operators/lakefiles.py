"""Decisions about the files of the span lake, and its status report."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMMITTED, COMPACTED = "COMMITTED", "COMPACTED"


def current_manifest(log: DataFrame) -> DataFrame:
    """State of each file from the append-only log; the latest row counts."""
    return (
        log.groupBy("filename")
        .agg(F.max_by(F.struct("record_count", "status"), "version").alias("_last"))
        .select("filename", "_last.record_count", "_last.status")
    )


def committed_files(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Files that the manifest commits and that exist."""
    return manifest.where(F.col("status") == COMMITTED).join(
        listing.select("filename"), "filename", "left_semi"
    )


def orphan_files(manifest: DataFrame, listing: DataFrame, before=None) -> DataFrame:
    """Files to remove: leftovers of unfinished writes, and data files that are
    not committed (any more).

    A file is written before the manifest names it. With `before`, a time well in
    the past, only files not modified since are judged; whoever removes files
    without it has to know that nobody writes.
    """
    if before is not None:
        listing = listing.where(F.col("modified_at") < F.lit(before))
    committed = manifest.where(F.col("status") == COMMITTED)
    temporary = listing.where("is_tmp").select("filename", F.lit("temporary").alias("reason"))
    stray = (
        listing.where(~F.col("is_tmp"))
        .join(committed, "filename", "left_anti")
        .select("filename", F.lit("not committed").alias("reason"))
    )
    return temporary.unionByName(stray)


def compaction_plan(
    manifest: DataFrame, listing: DataFrame, max_files: int = 20, below_bytes: int | None = None
) -> DataFrame:
    """The files the next compaction merges: the first ones by name, if there
    are at least two. With below_bytes, only smaller files."""
    if below_bytes is not None:
        listing = listing.where(F.col("size_bytes") < below_bytes)
    files = committed_files(manifest, listing).select("filename", "record_count")
    enough = files.agg(F.count(F.lit(1)) > 1).scalar()
    return files.where(enough).orderBy("filename").limit(max_files)


def recent_corruptions(corruptions: DataFrame, limit: int = 10) -> DataFrame:
    """The latest corruption events: by time, then batch, then place."""
    return corruptions.orderBy(F.desc("detected_at"), F.desc("batch_id"), "source_file", "source_offset").limit(limit)


def projects_by_age(projects: DataFrame) -> DataFrame:
    return projects.orderBy("created_at", "id")


def storage_status(
    segments: DataFrame,
    offsets: DataFrame,
    listing: DataFrame,
    manifest: DataFrame,
    corruptions: DataFrame,
    projects: DataFrame,
) -> DataFrame:
    """One row on the health of segments, lake files, damage and projects."""
    count = F.count(F.lit(1))
    sizes = segments.join(
        offsets.select(F.col("source_file").alias("filename"), "max_offset"), "filename", "left"
    )
    live = listing.where(~F.col("is_tmp")).join(manifest.where(F.col("status") == COMMITTED), "filename", "left_semi")
    parts = [
        sizes.agg(
            count.alias("segment_count"),
            F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("wal_bytes"),
            F.count_if(F.col("max_offset") >= F.col("size_bytes")).alias("fully_materialized_segments"),
        ),
        live.agg(count.alias("file_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("parquet_bytes")),
        corruptions.agg(count.alias("total_corruption_events")),
        projects.agg(count.alias("projects_count")),
    ]
    # each part is one row with columns of its own; lay them over each other
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns]).select(
        F.when(F.col("total_corruption_events") == 0, "healthy").otherwise("degraded").alias("status"),
        "*",
    )
