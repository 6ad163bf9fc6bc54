"""Packing by minimum bin slack: each window takes the set of remaining lengths that comes closest to its capacity.

Texts are cut at every `capacity` ids, so whole windows fill themselves and only
one rest per document, shorter than a window, has to be placed. Rests of equal
length are alike, so the choice needs their counts by length only: a table of at
most `capacity` - 1 numbers, whatever the size of the corpus. From it the plan is
made window by window: the longest rest left goes in, and a bitset of reachable
sums over the other lengths (each with its count) finds the fill closest to the
capacity, its counts being read back from the sets of every step. A window found is
repeated as often as the counts allow, so there are about as many steps as
lengths, not as windows. Rests then take their places by rank within their length.

Defined cases: a null or empty text is the end id alone; repeated rows are packed
each; an empty table gives no rows. Ranks follow the stored pieces, so rows that
tie (equal lengths) may trade places between runs; the fill is the same.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import as_bytes, checked_broadcast, slices, written
from spanloom.llm.tokens import crc, tokenizer, vocabulary_path

CAPACITY = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Place(NamedTuple):
    """Rests of a length with ranks from `first`: `each` a window in windows from `window`, the first at `offset`."""

    length: int
    first: int
    each: int
    windows: int
    window: int
    offset: int


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """The pieces of every text, with a rank among the pieces of that length in its task."""
    path = vocabulary or vocabulary_path()

    def cut(batches):
        words, seen, part = tokenizer(path), {}, TaskContext.get().partitionId()
        for batch in batches:
            for some in slices(batch, "text"):
                ids, counts = words.batch(as_bytes(some.column("text")))
                ids = ids.astype("<u4")
                out = {name: [] for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth")}
                at = 0
                for doc_id, n in zip(some.column("doc_id").to_pylist(), counts.tolist()):
                    for start in range(0, n, capacity):
                        length = min(capacity, n - start)
                        nth = seen.get(length, 0)
                        seen[length] = nth + 1
                        for name, value in zip(out, (doc_id, start, length, crc(ids[at + start: at + start + length]), n, nth)):
                            out[name].append(value)
                    at += n
                columns = {name: pa.array(values, pa.int64()) for name, values in out.items()}
                nth = columns.pop("nth")
                columns["part"] = pa.array(np.full(len(nth), part, np.int32))
                columns["nth"] = nth
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def fill(counts: np.ndarray, room: int, longest: int) -> dict[int, int]:
    """How many rests of each length up to `longest` come closest to `room` without passing it."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in range(min(longest, room), 0, -1):
        left = min(int(counts[length]), room // length)
        taken = 1
        while left:  # counts as powers of two and a rest
            taken = min(taken, left)
            steps.append((length, taken, reach))
            reach = (reach | reach << (length * taken)) & mask
            left -= taken
            taken *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, taken, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + taken
            total -= length * taken
    return chosen


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[Place]:
    """Places for all rests, from their counts by length (index 0 to capacity - 1)."""
    left, first, window, places = counts.copy(), np.zeros(len(counts), np.int64), 0, []
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        chosen = fill(left, capacity - longest, longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(int(left[length]) // each for length, each in chosen.items())
        offset = 0
        for length, each in sorted(chosen.items(), reverse=True):
            places.append(Place(length, int(first[length]), each, times, window, offset))
            left[length] -= each * times
            first[length] += each * times
            offset += length * each
        window += times
    return places


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Every piece of docs(doc_id, text) with its sequence and offset."""
    spark = docs.sparkSession
    pieces = written(pieces_of(docs, capacity, vocabulary), "pieces")
    per_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # ranks: per length the tasks one after another
    order = Window.partitionBy("length").orderBy("part")
    ranked = written(per_task.select("part", "length", "n", (F.sum("n").over(order) - F.col("n")).alias("before")), "ranks")
    totals = ranked.groupBy("length").agg(F.sum("n").alias("n")).toArrow()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    counts[totals.column("length").to_numpy()] = totals.column("n").to_numpy()
    places = plan(counts[:capacity], capacity)
    whole = int(counts[capacity])
    table = np.array(places, np.int64).reshape(-1, 6)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    shared = spark.sparkContext.broadcast(table)

    def settle(batches):
        table = shared.value
        key = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            window, offset = rank.copy(), np.zeros(len(rank), np.int64)
            rest = np.flatnonzero(length < capacity)
            row = table[np.searchsorted(key, (length[rest] << 48) + rank[rest], "right") - 1] if len(rest) else np.zeros((0, 6), np.int64)
            nth = rank[rest] - row[:, 1]
            each = np.maximum(row[:, 2], 1)
            window[rest] = whole + row[:, 4] + nth // each
            offset[rest] = row[:, 5] + nth % each * length[rest]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(window), pa.array(offset)],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    placed = pieces.join(checked_broadcast(ranked.drop("n")), ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(settle, PACKED)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
