"""Late segments, states of segments, and streams that fail."""

import time

import pytest
from exports import one_span, record, write

from spanloom.operators.segments import segment_lifecycle, segment_progress
from spanloom.sources import lake as lakes
from spanloom.sources.wal import LATE, WalStreamReader, list_segments
from spanloom.streaming import materialize as streams
from spanloom.streaming.materialize import DRAIN, materialize_available
from spanloom.streaming.supervise import supervise


@pytest.fixture
def place(tmp_path):
    return tmp_path / "wal", str(tmp_path / "lake")


def ids(spark, lake):
    return sorted(int(r.span_id, 16) for r in lakes.committed_spans(spark, lake).select("span_id").collect())


def progress(spark, wal, lake):
    rows = segment_progress(list_segments(spark, str(wal)), lakes.read_offsets(spark, lake), lakes.corruptions(spark, lake)).collect()
    return {r.filename: r for r in rows}


@pytest.mark.parametrize("bound", [0, 1])
def test_late_and_late_growing_segments_are_read(spark, place, bound):
    wal, lake = place
    options = {"max_bytes_per_batch": bound}
    for n in (100, 200, 300):
        write(wal, f"wal-{n}-0.wal", record(one_span(n)))
    assert materialize_available(spark, str(wal), lake, **options) == 3
    # a segment of an earlier name, two records more in the first one, and half a record in another
    write(wal, "wal-150-9.wal", *[record(one_span(n)) for n in (151, 152, 153, 154)])
    write(wal, "wal-100-0.wal", *[record(one_span(n)) for n in (100, 101, 102)])
    write(wal, "wal-200-0.wal", record(one_span(200)), record(one_span(201))[:9])
    before = progress(spark, wal, lake)
    assert not any(before[f"wal-{n}.wal"].is_deletable for n in ("150-9", "100-0", "200-0"))
    assert materialize_available(spark, str(wal), lake, **options) == 6
    assert ids(spark, lake) == [100, 101, 102, 151, 152, 153, 154, 200, 300] and lakes.corruptions(spark, lake).isEmpty()
    after = progress(spark, wal, lake)
    assert [n for n, r in sorted(after.items()) if r.is_deletable] == ["wal-100-0.wal", "wal-150-9.wal"]
    # the half record completes
    write(wal, "wal-200-0.wal", record(one_span(200)), record(one_span(201)))
    assert materialize_available(spark, str(wal), lake, **options) == 1
    assert materialize_available(spark, str(wal), lake, **options) == 0
    assert ids(spark, lake).count(201) == 1 and progress(spark, wal, lake)["wal-200-0.wal"].is_deletable


def test_a_restart_after_segments_that_come_before_all_others(spark, place):
    """The checkpoint knows of no segment before the first one; the table shows that an earlier one has come."""
    wal, lake = place
    write(wal, "wal-200-0.wal", record(one_span(2)))
    assert materialize_available(spark, str(wal), lake) == 1
    for n in (100, 150, 300, 400):
        write(wal, f"wal-{n}-0.wal", record(one_span(n)))
    assert materialize_available(spark, str(wal), lake) == 4
    assert materialize_available(spark, str(wal), lake) == 0
    assert ids(spark, lake) == [2, 100, 150, 300, 400]


def test_late_segments_while_the_stream_runs(tmp_path):
    """One reader, no table: what it has handed out it does not hand out again."""
    for n in (1, 2, 3):
        write(tmp_path, f"wal-{n}0-0.wal", record(one_span(n)))
    reader = WalStreamReader({"path": str(tmp_path)})
    start, got = reader.initialOffset(), []

    def step():
        nonlocal start
        end = reader.latestOffset()
        got.append(sorted((p.name, p.start, p.stop) for t in reader.partitions(start, end) for p in t.pieces) if end != start else [])
        start = end

    size = (tmp_path / "wal-10-0.wal").stat().st_size
    step()
    step()
    write(tmp_path, "wal-15-0.wal", record(one_span(9)))
    write(tmp_path, "wal-10-0.wal", record(one_span(1)), record(one_span(8)))
    step()
    write(tmp_path, "wal-25-0.wal", record(one_span(7)))  # before the newest, after the last sealed one
    step()
    write(tmp_path, "wal-30-0.wal", record(one_span(3)), record(one_span(6)))
    step()
    step()
    assert got[0] == [(f"wal-{n}0-0.wal", 0, size) for n in (1, 2, 3)] and got[1] == [] and got[5] == []
    assert got[2] == [("wal-10-0.wal", size, 2 * size), ("wal-15-0.wal", 0, size)]
    assert got[3] == [("wal-25-0.wal", 0, size)] and got[4] == [("wal-30-0.wal", size, 2 * size)]


def test_more_late_segments_than_an_offset_holds(tmp_path, monkeypatch):
    from spanloom.sources import wal as source

    monkeypatch.setattr(source, "LATE", 3)
    write(tmp_path, "wal-900-0.wal", record(one_span(1)))
    write(tmp_path, "wal-901-0.wal", record(one_span(2)))
    reader = WalStreamReader({"path": str(tmp_path)})
    start = reader.latestOffset()
    for n in range(7):
        write(tmp_path, f"wal-{n + 1}-0.wal", record(one_span(n)))
    seen = []
    for _ in range(3):
        end = reader.latestOffset()
        assert end != start
        pieces = [p.name for t in reader.partitions(start, end) for p in t.pieces]
        assert len(pieces) <= 3
        seen += pieces
        start = end
    assert len(seen) == len(set(seen)) == 7 and reader.latestOffset() == start


def test_a_drain_takes_up_all_late_segments(spark, place):
    wal, lake = place
    for n in (900, 901):
        write(wal, f"wal-{n}-0.wal", record(one_span(n)))
    assert materialize_available(spark, str(wal), lake) == 2
    for n in range(LATE + 3):
        write(wal, f"wal-{n + 1}-0.wal", record(one_span(n)))
    assert materialize_available(spark, str(wal), lake) == LATE + 3
    assert ids(spark, lake) == [*range(LATE + 3), 900, 901]


def test_notes_are_folded(spark, place):
    wal, lake = place
    for n in range(3):
        write(wal, f"wal-{n + 1}-0.wal", record(one_span(n)))
        materialize_available(spark, str(wal), lake)
    before = {tuple(r) for r in lakes.read_offsets(spark, lake).collect()}
    for _ in range(2):
        lakes.fold_marks(spark, lake)
        assert {tuple(r) for r in lakes.read_offsets(spark, lake).collect()} == before
        assert lakes.read_marks(spark, lake).count() == 3
    write(wal, "wal-4-0.wal", record(one_span(4)))
    write(wal, "wal-1-0.wal", record(one_span(0)), record(one_span(5)))
    assert materialize_available(spark, str(wal), lake) == 2
    assert ids(spark, lake) == [0, 1, 2, 4, 5]


def test_states_of_segments(spark, place):
    wal, lake = place
    write(wal, "wal-1-0.wal", record(one_span(1)))
    write(wal, "wal-2-0.wal", record(one_span(2)), b"\x03\x00\x00\x00\x01\x00\x00\x00bad")
    write(wal, "wal-3-0.wal", record(one_span(3)))
    materialize_available(spark, str(wal), lake)

    def states():
        return {r.filename: r.status for r in segment_lifecycle(lakes.segment_changes(spark, lake)).collect()}

    assert states() == {"wal-1-0.wal": "MATERIALIZED", "wal-2-0.wal": "QUARANTINED", "wal-3-0.wal": "ACTIVE"}
    (wal / "wal-1-0.wal").unlink()
    write(wal, "wal-4-0.wal", record(one_span(4)))
    materialize_available(spark, str(wal), lake)
    assert states() == {"wal-1-0.wal": "DELETED", "wal-2-0.wal": "QUARANTINED", "wal-3-0.wal": "MATERIALIZED", "wal-4-0.wal": "ACTIVE"}
    # a log of changes: each once, though the last run wrote again
    assert sorted((r.filename, r.status) for r in lakes.segment_changes(spark, lake).collect()) == [
        ("wal-1-0.wal", "DELETED"), ("wal-1-0.wal", "MATERIALIZED"), ("wal-2-0.wal", "QUARANTINED"),
        ("wal-3-0.wal", "ACTIVE"), ("wal-3-0.wal", "MATERIALIZED"), ("wal-4-0.wal", "ACTIVE"),
    ]


def _failing(monkeypatch, times):
    """The write of a batch fails so often."""
    calls, write_commit = [], lakes.write_commit

    def write(*args):
        calls.append(args)
        if len(calls) <= times:
            raise RuntimeError("the store is away")
        return write_commit(*args)

    monkeypatch.setattr(streams.lakes, "write_commit", write)
    return calls


def test_a_stream_that_fails_twice_still_drains(spark, place, monkeypatch):
    wal, lake = place
    write(wal, "wal-1-0.wal", *[record(one_span(n)) for n in range(3)])
    _failing(monkeypatch, 2)
    supervise(spark, str(wal), lake, first_wait=0.01, trigger=DRAIN).run()
    assert ids(spark, lake) == [0, 1, 2]
    rows = lakes.stream_failures(spark, lake).orderBy("failed_at").collect()
    assert [(r.attempt, r.gave_up) for r in rows] == [(1, False), (2, False)]
    assert all("the store is away" in r.message for r in rows)


def test_a_poison_batch_is_given_up(spark, place, monkeypatch):
    wal, lake = place
    write(wal, "wal-1-0.wal", record(one_span(1)))
    calls = _failing(monkeypatch, 99)
    with pytest.raises(Exception, match="the store is away"):
        supervise(spark, str(wal), lake, restarts=2, first_wait=0.01, trigger=DRAIN).run()
    rows = lakes.stream_failures(spark, lake).orderBy("failed_at").collect()
    assert [(r.attempt, r.gave_up) for r in rows] == [(1, False), (2, False), (3, True)] and len(calls) == 3


def test_following_goes_on_after_a_failure(spark, place, monkeypatch):
    """In the background; batches that got through start the count anew."""
    wal, lake = place
    write(wal, "wal-1-0.wal", record(one_span(1)))
    calls = _failing(monkeypatch, 1)
    followed = supervise(spark, str(wal), lake, restarts=1, first_wait=0.01, trigger={"processingTime": "100 milliseconds"}).start()

    def until(wanted):
        ends = time.time() + 60
        while time.time() < ends and ids(spark, lake) != wanted:
            time.sleep(0.2)
        assert ids(spark, lake) == wanted

    until([1])
    calls.clear()  # the next write fails again, once
    write(wal, "wal-2-0.wal", record(one_span(2)))
    until([1, 2])
    followed.stop()
    assert followed.given_up is None
    assert [(r.attempt, r.gave_up) for r in lakes.stream_failures(spark, lake).collect()] == [(1, False)] * 2
