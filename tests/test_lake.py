"""Materialisation, resumption, damage, manifest visibility and compaction."""

import os
import struct
import threading
import time
from datetime import datetime, timedelta, timezone

import pytest
from exports import one_span, record, span, export, write

from spanloom.operators.lakefiles import current_manifest, orphan_files
from spanloom.sources import lake as lakes
from spanloom.streaming.materialize import materialize, materialize_available


@pytest.fixture
def place(tmp_path):
    return tmp_path / "wal", str(tmp_path / "lake")


def ids(spark, lake):
    return sorted(r.span_id for r in lakes.committed_spans(spark, lake).select("span_id").collect())


def test_second_run_adds_nothing(spark, place):
    wal, lake = place
    write(wal, "wal-1-0.wal", *[record(one_span(i)) for i in range(5)])
    assert materialize_available(spark, str(wal), lake) == 5
    assert materialize_available(spark, str(wal), lake) == 0
    assert len(ids(spark, lake)) == 5


def test_growing_segment_is_resumed(spark, place):
    wal, lake = place
    whole, late = record(one_span(1)), record(one_span(2))
    write(wal, "wal-1-0.wal", whole, late[:7])
    assert materialize_available(spark, str(wal), lake) == 1
    write(wal, "wal-1-0.wal", whole, late, record(one_span(3)))
    write(wal, "wal-2-0.wal", record(one_span(4)))
    assert materialize_available(spark, str(wal), lake) == 3
    assert len(set(ids(spark, lake))) == 4 and lakes.corruptions(spark, lake).isEmpty()


def test_damage_quarantines_the_segment(spark, place):
    wal, lake = place
    good = record(one_span(1))
    bad = struct.pack("<II", 3, 1) + b"bad"
    write(wal, "wal-1-0.wal", good, bad)
    assert materialize_available(spark, str(wal), lake) == 1
    event = lakes.corruptions(spark, lake).collect()
    assert [(e.source_file, e.source_offset, e.ends_segment) for e in event] == [("wal-1-0.wal", len(good), True)]
    # what is appended to a damaged segment is never read, other segments are
    write(wal, "wal-1-0.wal", good, bad, record(one_span(2)))
    write(wal, "wal-2-0.wal", record(one_span(3)))
    assert materialize_available(spark, str(wal), lake) == 1
    assert lakes.corruptions(spark, lake).count() == 1
    assert [int(i, 16) for i in ids(spark, lake)] == [1, 3]


def test_malformed_export_is_an_event_and_not_the_end(spark, place):
    wal, lake = place
    write(wal, "wal-1-0.wal", record(one_span(1)), record(b"\xff\xff\xff"), record(one_span(2)))
    assert materialize_available(spark, str(wal), lake) == 2
    assert [e.ends_segment for e in lakes.corruptions(spark, lake).collect()] == [False]


def test_bounded_files(spark, place):
    wal, lake = place
    write(wal, "wal-1-0.wal", *[record(one_span(i)) for i in range(10)])
    assert materialize_available(spark, str(wal), lake, max_records_per_file=3) == 10
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{lake}/spans")
    assert files.count() == 4


def test_empty_lake(spark, place):
    _, lake = place
    assert lakes.committed_spans(spark, lake).count() == 0
    assert lakes.compact(spark, lake) == 0


def _grow(spark, place, runs, per_run):
    wal, lake = place
    for run in range(runs):
        write(wal, f"wal-{run + 1}-0.wal", *[record(one_span(run * per_run + i)) for i in range(per_run)])
        materialize_available(spark, str(wal), lake)
    return lake


@pytest.mark.parametrize("runs, per_run", [(3, 2), (4, 5)])
def test_compaction(spark, place, runs, per_run):
    lake = _grow(spark, place, runs, per_run)
    before = ids(spark, lake)
    assert lakes.compact(spark, lake) == runs * per_run
    state = current_manifest(lakes.manifest_log(spark, lake)).collect()
    assert sorted(r.status for r in state) == ["COMMITTED"] + ["COMPACTED"] * runs
    assert ids(spark, lake) == before
    assert lakes.compact(spark, lake) == 0


def test_unpublished_commit_stays_invisible(spark, place):
    lake = _grow(spark, place, 1, 3)
    spans = lakes.committed_spans(spark, lake)
    lakes.write_commit(spans, lake, "batch-crashed")
    assert len(ids(spark, lake)) == 3
    assert lakes.append_spans(spans, lake, "batch-000000000000") == 0  # a replay


def test_replay_after_a_crash_before_publishing(spark, place, monkeypatch):
    wal, lake = place
    write(wal, "wal-1-0.wal", record(one_span(1)))

    def crash(*_):
        raise RuntimeError("lost the driver")

    with monkeypatch.context() as patch:
        patch.setattr(lakes, "publish", crash)
        with pytest.raises(Exception, match="lost the driver"):
            materialize_available(spark, str(wal), lake)
    assert ids(spark, lake) == []
    assert materialize_available(spark, str(wal), lake) == 1
    assert len(ids(spark, lake)) == 1


def test_days_prune_folders(spark, place):
    wal, lake = place
    day = 86_400 * 10**9
    write(wal, "wal-1-0.wal", *[record(one_span(i, start=i * day, end=i * day + 5)) for i in range(3)])
    materialize_available(spark, str(wal), lake)
    rows = lakes.lake_spans(spark, lake, "1970-01-02", "1970-01-02")
    assert rows.count() == 1
    plan = rows._jdf.queryExecution().toString()
    assert "start_date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_polling_follows_a_writer(spark, place):
    wal, lake = place
    wal.mkdir()

    def writer():
        with open(wal / "wal-1-0.wal", "ab") as out:
            for i in range(6):
                data = record(one_span(i))
                out.write(data[:5])
                out.flush()
                time.sleep(0.15)
                out.write(data[5:])
                out.flush()

    query = materialize(spark, str(wal), lake, trigger={"processingTime": "200 milliseconds"})
    thread = threading.Thread(target=writer)
    thread.start()
    thread.join()
    deadline = time.time() + 40
    while time.time() < deadline and len(ids(spark, lake)) < 6:
        time.sleep(0.3)
    query.processAllAvailable()
    offsets = lakes.read_offsets(spark, lake).collect()
    query.stop()
    assert len(ids(spark, lake)) == len(set(ids(spark, lake))) == 6
    assert offsets[0].max_offset == (wal / "wal-1-0.wal").stat().st_size
    assert lakes.corruptions(spark, lake).isEmpty()


def test_wall_clock_end_to_end(spark, place):
    from spanloom.operators.traces import trace_detail, trace_list

    wal, lake = place
    write(wal, "wal-1-0.wal", record(export(span(start=100, end=250), resource={"service.name": "api"})))
    materialize_available(spark, str(wal), lake)
    spans = lakes.committed_spans(spark, lake)
    assert trace_list(spans).collect()[0].wall_clock_duration_ns == 150
    assert trace_detail(spans, "ab" * 16).count() == 1
    assert trace_detail(spans, "nope").count() == 0


def test_lake_analytics_read_no_json(spark, place):
    from spanloom.operators.analytics import model_analytics, overview

    wal, lake = place
    asked = {"gen_ai.request.model": "m", "gen_ai.usage.input_tokens": "12.5", "gen_ai.usage.output_tokens": 7}
    write(wal, "wal-1-0.wal", record(one_span(1, attributes=asked)), record(one_span(2)))
    materialize_available(spark, str(wal), lake)
    kept, plain = lakes.lake_spans(spark, lake), lakes.committed_spans(spark, lake)
    for report in (overview, model_analytics):
        assert report(kept).collect() == report(plain).collect()
        plan = report(kept)._jdf.queryExecution().toString()
        assert "attributes_json" not in plan.split("== Physical Plan ==")[1]
    assert overview(kept).collect()[0].total_tokens == 20


def test_bounded_batches_resume(spark, place, monkeypatch):
    wal, lake = place
    for n in range(5):
        write(wal, f"wal-{n + 1}-0.wal", *[record(one_span(n * 4 + i)) for i in range(4)])
    size = (wal / "wal-1-0.wal").stat().st_size
    calls = []
    publish = lakes.publish

    def crash_once(*args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("lost the driver")
        publish(*args)

    with monkeypatch.context() as patch:
        patch.setattr(lakes, "publish", crash_once)
        with pytest.raises(Exception, match="lost the driver"):
            materialize_available(spark, str(wal), lake, max_bytes_per_batch=size + 1)
    assert len(ids(spark, lake)) == 8  # the first batch holds two segments
    assert materialize_available(spark, str(wal), lake, max_bytes_per_batch=size + 1) == 12
    assert len(ids(spark, lake)) == len(set(ids(spark, lake))) == 20
    write(wal, "wal-6-0.wal", record(one_span(99)), record(one_span(100))[:9])
    assert materialize_available(spark, str(wal), lake, max_bytes_per_batch=size + 1) == 1
    # runs with and without a bound take turns
    write(wal, "wal-7-0.wal", record(one_span(101)), record(one_span(102)))
    write(wal, "wal-6-0.wal", record(one_span(99)), record(one_span(100)))
    assert materialize_available(spark, str(wal), lake) == 3
    write(wal, "wal-8-0.wal", record(one_span(103)))
    assert materialize_available(spark, str(wal), lake, max_bytes_per_batch=1) == 1
    assert len(ids(spark, lake)) == len(set(ids(spark, lake))) == 25


def _states(spark, lake):
    return {tuple(r) for r in current_manifest(lakes.manifest_log(spark, lake)).collect()}


def test_manifest_is_rolled_up(spark, place):
    lake = _grow(spark, place, 3, 2)
    wal = place[0]
    lakes.compact(spark, lake, max_files=2)
    before = _states(spark, lake)
    assert not lakes.roll_manifest(spark, lake)  # too few entries to be worth it
    for _ in range(3):
        lakes.roll_manifest(spark, lake, at_least=1)
        # the first two batches are compacted and can't be replayed, the last one stays known
        assert _states(spark, lake) == {r for r in before if r[0].startswith("compacted") or r[0] == f"batch-{2:012d}"}
        assert len(ids(spark, lake)) == 6
        lakes.append_spans(lakes.committed_spans(spark, lake).limit(0), lake, "nothing")
    write(wal, "wal-9-0.wal", record(one_span(77)))
    assert materialize_available(spark, str(wal), lake) == 1
    assert len(ids(spark, lake)) == 7
    assert lakes.is_committed(spark, lake, f"batch-{2:012d}")


@pytest.mark.parametrize("rolls", [1, 2, 3])
def test_an_entry_that_appears_late_is_kept(spark, place, monkeypatch, rolls):
    """Its hour is long past, and roll-ups were made, before the entry lands."""
    lake = _grow(spark, place, 2, 2)
    spans = lakes.committed_spans(spark, lake)
    rows = lakes.write_commit(spans, lake, "late")
    for _ in range(rolls):
        lakes.roll_manifest(spark, lake, at_least=0)
    monkeypatch.setattr(lakes, "_slot", lambda at: "2001-01-01T00")
    lakes.publish(spark, lake, "late", rows)
    assert len(ids(spark, lake)) == 8 and lakes.is_committed(spark, lake, "late")
    listing = lakes.list_commits(spark, lake)
    assert orphan_files(current_manifest(lakes.manifest_log(spark, lake)), listing).isEmpty()
    assert lakes.roll_manifest(spark, lake, at_least=1)
    assert len(ids(spark, lake)) == 8


def test_rolled_entries_are_removed_when_held_twice(spark, place):
    from pathlib import Path

    lake = _grow(spark, place, 3, 1)
    entries = lambda: len(list(Path(lake, "manifest").rglob("part-*.parquet")))
    assert entries() == 3
    lakes.roll_manifest(spark, lake, at_least=1)
    assert entries() == 3  # a reader may still hold the list of before
    lakes.roll_manifest(spark, lake, at_least=0)
    assert entries() == 0 and len(ids(spark, lake)) == 3
    lakes.roll_manifest(spark, lake, at_least=0)
    assert lakes.manifest_log(spark, lake).count() == 3 and len(list(Path(lake, "manifest_base").iterdir())) == 2


def test_orphans_wait_for_the_grace_time(spark, place):
    lake = _grow(spark, place, 1, 3)
    lakes.write_commit(lakes.committed_spans(spark, lake), lake, "batch-being-written")
    os.makedirs(f"{lake}/spans/commit=batch-crashed/_temporary/0")
    manifest, listing = current_manifest(lakes.manifest_log(spark, lake)), lakes.list_commits(spark, lake)
    now = datetime.now(timezone.utc)
    assert orphan_files(manifest, listing, before=now - timedelta(hours=1)).isEmpty()
    later = {tuple(r) for r in orphan_files(manifest, listing, before=now + timedelta(hours=1)).collect()}
    assert later == {("batch-being-written", "not committed"), ("batch-crashed/_temporary", "temporary")}


def test_only_live_commits_are_listed(spark, place):
    lake = _grow(spark, place, 2, 2)
    lakes.write_commit(lakes.committed_spans(spark, lake), lake, "dead")
    files = lakes.lake_spans(spark, lake).inputFiles()
    assert len(files) == 2 and not any("commit=dead" in f for f in files)
    lakes.compact(spark, lake)
    assert all("commit=compacted-" in f for f in lakes.lake_spans(spark, lake).inputFiles())


def test_large_commits_are_not_compacted_again(spark, place):
    lake = _grow(spark, place, 3, 2)
    assert lakes.compact(spark, lake) == 6
    write(place[0], "wal-8-0.wal", record(one_span(80)))
    materialize_available(spark, str(place[0]), lake)
    assert lakes.compact(spark, lake, target_bytes=2) == 0
    assert lakes.compact(spark, lake) == 7


def test_status_of_a_real_lake(spark, place):
    from spanloom.operators.lakefiles import recent_corruptions
    from spanloom.streaming.materialize import system_status

    wal, lake = place
    wal.mkdir()
    assert lakes.read_offsets(spark, lake).isEmpty()
    good = record(one_span(1))
    write(wal, "wal-1-0.wal", good, struct.pack("<II", 3, 1) + b"bad")
    materialize_available(spark, str(wal), lake)
    write(wal, "wal-2-0.wal", record(one_span(2)), record(one_span(3))[:4])
    materialize_available(spark, str(wal), lake)
    assert {tuple(r) for r in lakes.read_offsets(spark, lake).collect()} == {("wal-1-0.wal", len(good) + 11), ("wal-2-0.wal", len(record(one_span(2))))}
    state = system_status(spark, str(wal), lake).first()
    assert (state.status, state.segment_count, state.fully_materialized_segments, state.file_count, state.total_corruption_events) == ("degraded", 2, 1, 2, 1)
    assert [(e.source_file, e.source_offset) for e in state.latest_corruptions] == [("wal-1-0.wal", len(good))]
    assert recent_corruptions(lakes.corruptions(spark, lake)).count() == 1
    assert [tuple(r) for r in lakes.quarantined_segments(spark, lake).drop("sequence").collect()] == [("wal-1-0.wal", "QUARANTINED", len(good))]


def test_offset_does_not_grow_with_the_segments(tmp_path):
    import json

    from spanloom.sources.wal import WalStreamReader

    sizes = []
    for count in (10, 1000):
        folder = tmp_path / str(count)
        write(folder, "wal-000001-0.wal", record(one_span(1)))
        for n in range(2, count + 1):
            (folder / f"wal-{n:06d}-0.wal").write_bytes((folder / "wal-000001-0.wal").read_bytes())
        reader = WalStreamReader({"path": str(folder)})
        end = reader.latestOffset()
        sizes.append(len(json.dumps(end)))
        assert sum(len(t.pieces) for t in reader.partitions(reader.initialOffset(), end)) == count
        assert reader.partitions(end, reader.latestOffset())[0].pieces == []
    assert sizes[0] == sizes[1] and max(sizes) < 120
