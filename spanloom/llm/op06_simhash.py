"""SimHash near duplicates by deletion-variant signatures.

A 64-bit fingerprint: bit b is set if it is set in over half of the XXH64 values
(seed 42) of the text's word shingles. Fingerprints link if they differ in at most
DISTANCE bits.

* Signatures. With d bits allowed, ceil((d + 1) / 2) segments are enough for one of
  them to differ in at most one bit (two halves for two bits, where equality would
  need three parts). Each segment is indexed once per bit with that bit deleted:
  two segments that differ in at most one bit share such a variant.
* Candidates. Rows of one variant meet in a window sorted by fingerprint, where each
  looks back over the NEIGHBOURS before it, and is verified against them.
* Crowded variants. In a variant with more members than that, the members link
  exactly through other keys instead: two fingerprints differ in at most two bits if
  and only if some 64-bit value differs from both in at most one, so each member goes to its
  65 such values and joins the smallest member there. That is linear in the group,
  loses no link, and needs no pairs.
* Components. Copies collapse to one fingerprint first. Links are then contracted by
  alternating large-star and small-star steps, each written to the shared folder.

Defined cases: a null text counts as empty; texts without words share the
fingerprint zero and link like any other; a null doc_id takes part, and a component
of null doc_ids only has a null component_id; repeated rows are returned each; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import as_bytes, free_name, slices, written

SHINGLE = 3
DISTANCE = 2
SEED = 42
NEIGHBOURS = 24
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """As a signed 64-bit integer."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    if len(words) <= size:
        grams = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        grams = [joined[a:b] for a, b in zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1:] - 1).tolist())]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], np.uint64).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 255):  # 255 ones fit a byte
        ones += np.unpackbits(hashes[start: start + 255], axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, column: str, size: int = SHINGLE) -> DataFrame:
    """docs with the fingerprint of `text` in a new long column."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{column}` long"])

    def add(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                values = np.fromiter((fingerprint(t, size) for t in as_bytes(part.column("text"))), np.int64, part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values)], names=[*part.schema.names, column])

    return docs.mapInArrow(add, schema)


def segments(distance: int, bits: int = 64) -> list[tuple[int, int]]:
    """(first bit, end) of the fewest segments of which one differs in at most one bit."""
    parts = (distance + 2) // 2
    cuts = [round(i * bits / parts) for i in range(parts + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def _long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def variants(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """x, and per segment and bit a key: the deleted bit's place and the segment without it."""
    keys = []
    for first, end in segments(distance):
        for bit in range(first, end):
            mask = _long(((1 << end) - (1 << first)) & ~(1 << bit))
            keys.append(F.struct(F.lit(bit).cast("byte").alias("bit"), F.col("x").bitwiseAND(F.lit(mask)).alias("rest")))
    return prints.select("x", F.explode(F.array(*keys)).alias("key")).select("x", "key.bit", "key.rest")


def links(prints: DataFrame, distance: int = DISTANCE, neighbours: int = NEIGHBOURS) -> DataFrame:
    """src, dst: links enough to connect all fingerprints in prints(x, distinct) that differ in at most `distance` bits."""
    if distance != 2:
        raise NotImplementedError("the exact way through crowded variants is for two bits")
    place = Window.partitionBy("bit", "rest").orderBy("x")
    met = variants(prints, distance).select(
        "x",
        F.collect_list("x").over(place.rowsBetween(-neighbours, -1)).alias("near"),
        F.lag("x", neighbours).over(place).isNotNull().alias("crowded"),
        F.lead("x", neighbours).over(place).isNotNull().alias("more"),
    )
    near = F.filter("near", lambda y: F.bit_count(F.col("x").bitwiseXOR(y)) <= distance)
    found = met.select("x", near.alias("near"), (F.col("crowded") | F.col("more")).alias("crowd")).where(F.col("crowd") | (F.size("near") > 0))
    found = written(found, "met")
    close = found.select(F.explode("near").alias("src"), F.col("x").alias("dst"))
    # two members further apart than `neighbours` rows are both marked: one has so many rows before it, the other after it
    crowd = found.where("crowd").select("x").distinct()
    around = [F.col("x"), *(F.col("x").bitwiseXOR(F.lit(_long(1 << bit))) for bit in range(64))]
    meet = crowd.select("x", F.explode(F.array(*around)).alias("y")).groupBy("y").agg(F.min("x").alias("src"), F.collect_set("x").alias("members"))
    hub = meet.where(F.size("members") > 1).select("src", F.explode("members").alias("dst"))
    return close.unionByName(hub).where("src <> dst").distinct()


def components(edges: DataFrame) -> DataFrame:
    """x, root: the smallest x of each component of edges(src, dst); x without an edge is absent."""
    both = lambda e: e.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    now = written(both(edges), "edges")
    while True:
        # large star: larger neighbours of u go to the smallest of u's neighbourhood
        arcs = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both(arcs.where("v > u").join(low, "u").select(F.col("v").alias("src"), F.col("m").alias("dst"))), "edges")
        # small star: u's smaller neighbours and u go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = written(both(joined.select(F.col("v").alias("src"), F.col("m").alias("dst")).unionByName(least.select(F.col("u").alias("src"), F.col("m").alias("dst")))), "edges")
        # done when nothing moves: all edges are stars around roots
        before = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        after = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        now = small
        if tuple(before) == tuple(after):
            return now.select(F.col("u").alias("x"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("x"), F.col("v").alias("root")).distinct())


def groups(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Per distinct x of rows(x, doc_id): the smallest x and the smallest doc_id of its component."""
    prints = written(rows.groupBy("x").agg(F.min("doc_id").alias("least")), "prints")
    found = components(links(prints.select("x"), distance))
    with_root = prints.join(found, "x", "left").withColumn("root", F.coalesce("root", "x"))
    ids = with_root.groupBy("root").agg(F.min("least").alias("component_id"))
    return with_root.select("x", "root").join(ids, "root").select("x", "root", "component_id")


def component_ids(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, x (fingerprint), component_id for docs(doc_id, text)."""
    rows = written(with_fingerprint(docs.select("doc_id", "text"), "x", size).drop("text"), "fingerprints")
    return rows.join(groups(rows, distance), "x").select("doc_id", "x", "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of docs per group of near duplicates: that of the smallest doc_id (of rows with the same doc_id and fingerprint, one)."""
    x = free_name(docs, "x")
    rows = written(with_fingerprint(docs.select("doc_id", "text"), "x", size).drop("text"), "fingerprints")
    return one_per_group(docs, with_fingerprint(docs, x, size), x, rows, groups(rows, distance))


def one_per_group(docs: DataFrame, marked: DataFrame, x: str, rows: DataFrame, group: DataFrame) -> DataFrame:
    """The row of docs that stays per group(x, root, component_id), for rows(doc_id, x) and marked, docs with the column named by x."""
    nth, place = free_name(marked, "nth"), free_name(marked, "place")
    # the x and doc_id of the row that stays, one per group
    stays = rows.join(group, "x").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("x").alias("x"), F.first("component_id").alias("doc_id"))
    stays = stays.select(F.col("doc_id").alias("__id"), F.col("x").alias("__x"), F.xxhash64("doc_id").alias("__place"))
    # joined by columns by which the rows then lie for the window too: a null-safe join of doc_id would move them twice
    marked = marked.withColumn(place, F.xxhash64("doc_id"))
    same_id = F.nullif(marked["doc_id"], stays["__id"]).isNull() & F.nullif(stays["__id"], marked["doc_id"]).isNull()
    kept = marked.join(stays, (marked[place] == stays["__place"]) & (marked[x] == stays["__x"]) & same_id).drop("__id", "__x", "__place")
    # repeated rows: any one of them, told apart by their whole content
    order = Window.partitionBy(place, x, "doc_id").orderBy(F.xxhash64(*(c for c in docs.columns)))
    return kept.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(*docs.columns)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    return component_ids(docs).select("doc_id", F.lpad(F.lower(F.hex("x")), 16, "0").alias("fingerprint"), "component_id")
