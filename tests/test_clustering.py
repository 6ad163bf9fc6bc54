"""Files of a compacted lake are narrow in project, service and trace."""

from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from spanloom.operators.clustering import cuts_of, z_place
from spanloom.plans.inputs import event_spans
from spanloom.sources import lake as lakes

SMALL = "/root/testdata/sf0.001"


def test_place_on_the_curve(spark):
    rows = spark.createDataFrame([(i, str(i % 4), None if i % 5 == 0 else f"{i:03d}") for i in range(200)], "n long, a string, b string")
    cuts = cuts_of(rows, ["a", "b"], 200, bits=2)
    placed = rows.select("a", "b", z_place(cuts, bits=2).alias("z")).collect()
    assert len(cuts["a"]) == len(cuts["b"]) == 3
    for r in placed:
        ranks = [sum(c <= v for c in cuts[k]) if (v := r[k]) is not None else 0 for k in ("a", "b")]
        assert r.z == sum(((ranks[i] >> bit) & 1) << (2 * bit + 1 - i) for bit in range(2) for i in range(2))
    empty = cuts_of(rows.limit(0), ["a"], 0)
    assert empty == {"a": []} and rows.select(z_place(empty).alias("z")).distinct().collect()[0].z == 0


def test_filters_skip_files(spark, tmp_path):
    lake = str(tmp_path / "lake")
    # one day, so that days do not part the files
    spans = event_spans(spark, SMALL).withColumn("start_time_unix_nano", F.col("start_time_unix_nano") % 10**12)
    spans = spans.unionByName(spans.withColumn("trace_id", F.md5("span_id")))
    for part in range(16):
        lakes.append_spans(spans.where(f"pmod(hash(span_id), 16) = {part}").coalesce(1), lake, f"batch-{part:012d}")
    before = spans.count()
    largest = lakes.list_commits(spark, lake).agg(F.max("size_bytes")).first()[0]
    assert lakes.compact(spark, lake, target_bytes=2 * largest + 2) == before
    files = [pq.ParquetFile(f) for f in Path(lake, "spans").glob("commit=compacted-*/*/*.parquet")]
    assert len(files) >= 6

    def met(column, value):
        place = files[0].schema_arrow.names.index(column)
        stats = [f.metadata.row_group(0).column(place).statistics for f in files]
        return sum(s.has_min_max and s.min <= value <= s.max for s in stats)

    trace = spans.select(F.max("trace_id")).first()[0]
    assert met("trace_id", trace) <= len(files) / 2
    assert met("project_id", "proj-1") < len(files) and met("project_id", "proj-0") <= 3 * len(files) / 4
    assert sorted(map(tuple, lakes.committed_spans(spark, lake).select("span_id", "trace_id").collect())) == sorted(map(tuple, spans.select("span_id", "trace_id").collect()))


def test_compaction_lists_live_commits_only(spark, tmp_path, monkeypatch):
    lake = str(tmp_path / "lake")
    spans = event_spans(spark, SMALL)
    for part in range(3):
        lakes.append_spans(spans.where(f"kind % 3 = {part}"), lake, f"batch-{part:012d}")
    lakes.write_commit(spans, lake, "batch-dead")
    listed, data_files = [], lakes._data_files
    monkeypatch.setattr(lakes, "_data_files", lambda s, paths: listed.extend(paths) or data_files(s, paths))
    assert lakes.compact(spark, lake) == spans.count()
    assert sorted(p.rsplit("=", 1)[1] for p in listed) == [f"batch-{n:012d}" for n in range(3)]


def test_a_task_of_a_compaction_has_bounded_rows(spark, tmp_path, monkeypatch):
    lake = str(tmp_path / "lake")
    spans = event_spans(spark, SMALL).withColumn("start_time_unix_nano", F.col("start_time_unix_nano") % 10**12)
    for part in range(2):
        lakes.append_spans(spans.where(f"kind % 2 = {part}"), lake, f"batch-{part:012d}")
    total = spans.count()
    monkeypatch.setattr(lakes, "FILE_ROWS", total // 4, raising=False)
    assert lakes.compact(spark, lake) == total
    rows = [pq.ParquetFile(f).metadata.num_rows for f in Path(lake, "spans").glob("commit=compacted-*/*/*.parquet")]
    assert sum(rows) == total and max(rows) < total / 2
    assert lakes.committed_spans(spark, lake).select("span_id").distinct().count() == total


def test_a_task_of_a_commit_has_bounded_rows(spark, tmp_path, monkeypatch):
    lake = str(tmp_path / "lake")
    # all in one task; a day with nearly all rows, most of them one trace, and some without a start
    nanos = F.when(F.col("source_offset") % 1000 == 0, F.col("start_time_unix_nano")).when(F.col("kind") > 0, F.lit(5))
    spans = event_spans(spark, SMALL).withColumns({"start_time_unix_nano": nanos, "trace_id": F.when(F.col("status_code") == 0, "a").otherwise(F.col("trace_id"))}).coalesce(1)
    total = spans.count()
    monkeypatch.setattr(lakes, "FILE_ROWS", total // 20)
    assert lakes.append_spans(spans, lake, "batch-000000000000") == total
    files = [pq.ParquetFile(f).metadata.num_rows for f in Path(lake, "spans").glob("commit=*/*/*.parquet")]
    days = len(list(Path(lake, "spans").glob("commit=*/*")))
    assert sum(files) == total and max(files) <= total / 10 and len(files) <= 20 + 1 + days
    assert lakes.committed_spans(spark, lake).exceptAll(spans.select(lakes.SPAN.fieldNames())).isEmpty()
