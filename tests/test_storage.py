"""Ingest validation, segment bookkeeping and lake decisions on small tables."""

import pytest
from pyspark.sql import Observation

from spanloom.operators import ingest, lakefiles, segments

PROTOBUF = "application/x-protobuf"
EXPORTS = [
    # method, path, content type, size, decodable, authorization, key, outcome with a token
    ("POST", "/v1/traces", PROTOBUF, 10, True, "Bearer t", None, "accepted"),
    ("POST", "/v1/traces", PROTOBUF + "; x=y", 10, True, "t", None, "accepted"),
    ("POST", "/v1/traces", PROTOBUF, 10, True, None, "t", "accepted"),
    ("POST", "/v1/traces", PROTOBUF, 10, True, "Bearer other", "t", "accepted"),
    ("POST", "/v1/traces", PROTOBUF, 10, True, None, None, "unauthorized"),
    ("POST", "/v1/traces", PROTOBUF, 10, True, "Bearer u", "u", "unauthorized"),
    ("POST", "/v1/traces", "application/json", 10, True, "Bearer t", None, "unsupported media type"),
    ("POST", "/v1/traces", None, 10, True, "Bearer t", None, "unsupported media type"),
    ("POST", "/v1/traces", " " + PROTOBUF, 10, True, "Bearer t", None, "unsupported media type"),
    ("POST", "/v1/traces", PROTOBUF, 10, False, "Bearer t", None, "malformed export"),
    ("POST", "/v1/traces", PROTOBUF, 0, True, "Bearer t", None, "empty body"),
    ("POST", "/v1/traces", PROTOBUF, 5000, False, None, None, "too large"),
    ("POST", "/v1/logs", "text/plain", 10, False, None, None, "not found"),
    ("PUT", "/v1/traces", PROTOBUF, 10, True, "Bearer t", None, "not found"),
    ("GET", "/healthz", None, 0, False, None, None, "health"),
    ("POST", "/healthz", None, 0, False, None, None, "not found"),
]


@pytest.fixture
def exports(spark):
    return spark.createDataFrame(
        [(i, *e[:7], 2, 3) for i, e in enumerate(EXPORTS)],
        "i int, method string, path string, content_type string, body_size bigint, decodable boolean, "
        "authorization string, api_key string, n_resource_spans bigint, n_spans bigint",
    )


def test_first_failing_check_decides(exports):
    rows = ingest.ingest_validate(exports, auth_token="t", max_body_bytes=4096).orderBy("i").collect()
    assert [r.outcome for r in rows] == [e[7] for e in EXPORTS]
    open_rows = ingest.ingest_validate(exports, max_body_bytes=4096).orderBy("i").collect()
    assert [r.outcome for r in open_rows][4:6] == ["accepted", "accepted"]


def test_counters_also_on_the_side(exports):
    validated = ingest.ingest_validate(exports, auth_token="t", max_body_bytes=4096)
    counters = ingest.ingest_stats(validated).collect()[0].asDict()
    assert counters == {
        "accepted_requests": 4, "accepted_resource_spans": 8, "accepted_spans": 12, "rejected_requests": 11,
    }
    seen = Observation()
    assert ingest.watch_ingest(validated, seen).where("outcome = 'accepted'").count() == 4
    assert seen.get == counters


def test_empty_ingest(exports):
    none = ingest.ingest_stats(ingest.ingest_validate(exports.where("false"))).collect()[0]
    assert tuple(none) == (0, 0, 0, 0)


@pytest.fixture
def tables(spark):
    files = spark.createDataFrame(
        [("wal-5-0.wal", 100), ("wal-5-1.wal", 100), ("wal-7.wal", 50), ("odd.wal", 10), ("wal-6-0.wal", 80)],
        "filename string, size_bytes bigint",
    )
    offsets = spark.createDataFrame(
        [("wal-5-0.wal", 100), ("wal-5-1.wal", 100), ("wal-7.wal", 20), ("wal-6-0.wal", 80)],
        "source_file string, max_offset bigint",
    )
    damage = spark.createDataFrame([("wal-5-1.wal", 40, "x")], "source_file string, offset bigint, reason string")
    return files, offsets, damage


def test_segment_progress(tables):
    rows = {r.filename: r for r in segments.segment_progress(*tables).collect()}
    assert [n for n, r in rows.items() if r.is_active] == ["wal-6-0.wal"]
    assert {n for n, r in rows.items() if r.is_deletable} == {"wal-5-0.wal"}
    assert {n for n, r in rows.items() if r.is_fully_read} == {"wal-5-0.wal", "wal-5-1.wal", "wal-6-0.wal"}
    assert (rows["wal-7.wal"].seg_nanos, rows["wal-7.wal"].seg_seq, rows["odd.wal"].seg_seq) == (0, 7, 0)


def test_pending_segments(tables):
    rows = {tuple(r) for r in segments.pending_segments(*tables).collect()}
    assert rows == {("wal-7.wal", 20, 50), ("odd.wal", 0, 10)}


def test_offsets_never_move_back(spark, tables):
    progress = spark.createDataFrame([("wal-7.wal", 10), ("wal-6-0.wal", 90), ("new.wal", 5)], "source_file string, max_offset bigint")
    rows = {tuple(r) for r in segments.merged_offsets(tables[1], progress).collect()}
    assert {("wal-7.wal", 20), ("wal-6-0.wal", 90), ("new.wal", 5)} <= rows and len(rows) == 5


@pytest.fixture
def lake_tables(spark):
    listing = spark.createDataFrame(
        [("a", 10, False), ("b", 20, False), ("stray", 5, False), ("c.tmp", 1, True)],
        "filename string, size_bytes bigint, is_tmp boolean",
    )
    log = spark.createDataFrame(
        [("a", 1, "COMMITTED", 1), ("b", 2, "COMMITTED", 2), ("lost", 3, "COMMITTED", 3), ("stray", 4, "COMMITTED", 1),
         ("stray", 0, "COMPACTED", 4)],
        "filename string, record_count bigint, status string, version bigint",
    )
    return lakefiles.current_manifest(log), listing


def test_lake_decisions(lake_tables):
    manifest, listing = lake_tables
    assert {r.filename for r in lakefiles.committed_files(manifest, listing).collect()} == {"a", "b"}
    assert {tuple(r) for r in lakefiles.orphan_files(manifest, listing).collect()} == {
        ("c.tmp", "temporary"), ("stray", "not committed"),
    }
    assert [r.filename for r in lakefiles.compaction_plan(manifest, listing).collect()] == ["a", "b"]
    assert [r.filename for r in lakefiles.compaction_plan(manifest, listing, 1).collect()] == ["a"]
    assert lakefiles.compaction_plan(manifest, listing.where("filename = 'a'")).count() == 0


def test_storage_status(spark, tables, lake_tables):
    files, offsets, damage = tables
    manifest, listing = lake_tables
    projects = spark.createDataFrame([("p", 1)], "id string, created_at bigint")
    row = lakefiles.storage_status(files, offsets, listing, manifest, damage, projects).collect()[0].asDict()
    assert row == {
        "status": "degraded", "segment_count": 5, "wal_bytes": 340, "fully_materialized_segments": 3, "file_count": 2,
        "parquet_bytes": 30, "total_corruption_events": 1, "projects_count": 1,
    }
    calm = lakefiles.storage_status(files, offsets, listing, manifest, damage.where("false"), projects)
    assert calm.collect()[0].status == "healthy"


def test_approximate_traces(spark):
    from exports import spans_frame
    from spanloom.operators.analytics import overview

    spans = spans_frame(spark, [{"trace": f"t{i % 7}", "span": str(i)} for i in range(50)])
    exact, near = overview(spans).collect()[0], overview(spans, approximate_traces=True).collect()[0]
    assert exact == near and exact.total_traces == 7
