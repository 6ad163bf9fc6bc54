"""Framing of segments: damage, tails, order, and random bytes."""

import random
import struct

import pytest
from exports import record, write
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.sources.wal import Piece, _Folder, list_segments, read_wal, segment_order


def frames(spark, folder, **options):
    rows = read_wal(spark, str(folder), **options).orderBy("source_file", "source_offset").collect()
    good = [(r.source_file, r.source_offset, bytes(r.payload)) for r in rows if r.corrupt_reason is None]
    bad = [(r.source_file, r.source_offset, r.corrupt_reason) for r in rows if r.corrupt_reason]
    return good, bad


@pytest.mark.parametrize(
    "data, limit, reason",
    [
        (struct.pack("<II", 0, 0), 1024, "invalid zero-length record"),
        (struct.pack("<II", 2048, 7), 1024, "oversized WAL record"),
        (b"\x05\x00", 1024, "truncated WAL header"),
        (struct.pack("<II", 50, 7) + b"x" * 10, 1024, "truncated WAL payload"),
        (struct.pack("<II", 4, 0xDEADBEEF) + b"data", 1024, "WAL checksum mismatch"),
    ],
)
def test_damage_kinds(spark, tmp_path, data, limit, reason):
    write(tmp_path, "wal-1-0.wal", data)
    good, bad = frames(spark, tmp_path, max_record_bytes=limit, strict=True)
    assert good == [] and len(bad) == 1
    assert bad[0][1] == 0 and bad[0][2].startswith(reason)


def test_prefix_stays_and_rest_of_segment_is_dropped(spark, tmp_path):
    first, second = record(b"first"), record(b"second one")
    write(tmp_path, "wal-1-0.wal", first, second, struct.pack("<II", 3, 1) + b"bad", record(b"never"))
    write(tmp_path, "wal-2-0.wal", record(b"other"))
    good, bad = frames(spark, tmp_path)
    assert [g[2] for g in good] == [b"first", b"second one", b"other"]
    assert [(b[0], b[1]) for b in bad] == [("wal-1-0.wal", len(first) + len(second))]


def test_open_tail_is_damage_only_in_sealed_segments(spark, tmp_path):
    half = record(b"half written")[:-3]
    write(tmp_path, "wal-1-0.wal", record(b"a"), half)
    assert frames(spark, tmp_path) == ([("wal-1-0.wal", 0, b"a")], [])
    assert len(frames(spark, tmp_path, strict=True)[1]) == 1
    write(tmp_path, "wal-2-0.wal", record(b"b"))
    good, bad = frames(spark, tmp_path)
    assert len(good) == 2 and bad[0][2].startswith("truncated WAL payload")


def test_segment_order():
    names = ["wal-9.wal", "x.wal", "wal-20-1.wal", "wal-3-10.wal", "wal-20-0.wal", "wal-10.wal"]
    assert sorted(names, key=segment_order) == [
        "x.wal", "wal-9.wal", "wal-10.wal", "wal-3-10.wal", "wal-20-0.wal", "wal-20-1.wal",
    ]


def test_empty_folder_and_listing(spark, tmp_path):
    assert frames(spark, tmp_path) == ([], [])
    write(tmp_path, "wal-1-0.wal", record(b"abc"))
    (tmp_path / "notes.txt").write_text("no segment")
    assert [tuple(r) for r in list_segments(spark, str(tmp_path)).collect()] == [("wal-1-0.wal", 11)]


def test_many_small_segments_share_tasks(tmp_path):
    folder = _Folder({"path": str(tmp_path), "splitBytes": "100", "parallelism": "1"})
    tasks = folder.tasks([Piece(f"wal-{i}.wal", 0, 60) for i in range(10)])
    assert [len(t.pieces) for t in tasks] == [2] * 5


@settings(max_examples=150, deadline=None)
@given(
    payloads=st.lists(st.binary(min_size=1, max_size=60), min_size=1, max_size=8),
    cut=st.integers(0, 10_000),
    flip=st.integers(0, 10_000),
    seed=st.integers(0, 1000),
)
def test_random_damage_keeps_exactly_the_prefix(tmp_path_factory, payloads, cut, flip, seed):
    folder_path = tmp_path_factory.mktemp("wal")
    whole = [record(p) for p in payloads]
    data = bytearray(b"".join(whole))
    ends = [sum(map(len, whole[: i + 1])) for i in range(len(whole))]
    mode = random.Random(seed).choice(["cut", "flip"])
    folder = _Folder({"path": str(folder_path), "maxRecordBytes": "1000"})
    if mode == "cut":
        size = cut % (len(data) + 1)
        del data[size:]
        intact = sum(e <= size for e in ends)
        clean = size in (0, *ends)
    else:
        at = flip % len(data)
        data[at] ^= 0xFF
        intact, clean = sum(e <= at for e in ends), False
    (folder_path / "wal-1-0.wal").write_bytes(data)
    rows = list(folder.records(Piece("wal-1-0.wal", 0, len(data))))
    good = [r for r in rows if r[4] is None]
    assert [r[3] for r in good] == payloads[:intact]
    assert (len(rows) == len(good)) == clean
    if mode == "cut":
        open_rows = list(folder.records(Piece("wal-1-0.wal", 0, len(data), open_tail=True)))
        assert [r[3] for r in open_rows] == payloads[:intact] and all(r[4] is None for r in open_rows)
        assert folder.last_boundary("wal-1-0.wal", 0, len(data)) == ([0, *ends][intact])
