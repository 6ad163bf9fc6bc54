"""Token ids as canonical, length-limited Huffman codes in a table of shards.

Two passes: the ids are counted over the whole table, then every text is coded
with the one code that follows from the counts. A shard holds the documents of a
range of doc_id in ascending order (rows that share a doc_id: by their ids; a
null doc_id first). Its rows are runs of documents with

    shard, run        place of the row
    base              ids in the shard before this run
    doc_ids, n_tokens per document
    marks             per block of BLOCK ids (blocks end with their document): the bit
                      offset in `payload` at which it starts
    payload           the code bits, the first bit highest; documents start at whole 32-bit words

so any block can be decoded without the others. `code` beside the shards holds
the code's length for every id that occurs; lengths alone fix a canonical code.
Both are Parquet tables, so writing commits task by task and any file system
that Spark reaches will do.

Defined cases: a null or empty text is a document of the end id alone; repeated
rows are written each; an empty table gives an empty folder and no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import as_bytes, checked_broadcast, scratch_path, slices, written
from spanloom.llm.tokens import tokenizer, vocabulary_path

BLOCK = 1024
LONGEST = 16
#: Documents in one row of a shard, and ids in a shard (there are at least as many shards as shuffle partitions).
RUN, SHARD_IDS = 2048, 100_000_000

SHARDS = "shard int, run int, base bigint, doc_ids array<bigint>, n_tokens array<bigint>, marks array<bigint>, payload binary"
CODE = "id int, bits int"


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of its text as little-endian 16-bit integers."""

    def encode(batches):
        words = tokenizer(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = words.batch(as_bytes(part.column("text")))
                ends = np.concatenate(([0], np.cumsum(counts))) * 2
                if ids.size and ids.max() >= 1 << 16:
                    raise ValueError("the shard format holds ids below 65,536")
                packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), packed], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, ids binary")


def _ids_of(column) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    ids = np.frombuffer(data, "<u2", (offsets[-1] - offsets[0]) // 2, offsets[0]) if len(column) and offsets[-1] > offsets[0] else np.zeros(0, "<u2")
    return ids, np.diff(offsets) // 2


def id_counts(tokens: DataFrame) -> DataFrame:
    """How often each id occurs; a task sends one row per id it saw."""

    def count(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            total += np.bincount(_ids_of(batch.column("ids"))[0], minlength=1 << 16)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code whose codes have at most `longest` bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids don't fit codes of {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    # level by level: the cheapest items are the leaves and the pairs of the level below
    levels, packages = [], np.zeros(0)
    for _ in range(longest):
        items = np.concatenate((leaves, packages))
        rank = np.argsort(items, kind="stable")
        levels.append(rank < len(leaves))
        items = items[rank]
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(leaves) - 2
    depth = np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        depth[:chosen] += 1
        take = 2 * (take - chosen)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each the one before plus one."""
    codes = np.zeros(len(lengths), np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        longest = int(lengths.max())
        step = np.int64(1) << (longest - lengths[order])
        codes[order] = (np.concatenate(([0], np.cumsum(step)[:-1]))) >> (longest - lengths[order])
    return codes


def pack(ids: np.ndarray, counts: np.ndarray, codes: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """Payload of the documents and the bit offset of each of their blocks."""
    own = lengths[ids]
    before = np.concatenate(([0], np.cumsum(own)))
    ends = np.cumsum(counts)
    starts = ends - counts
    bits = before[ends] - before[starts]
    words = (bits + 31) // 32
    first_word = np.cumsum(words) - words
    at = before[:-1] + np.repeat(first_word * 32 - before[starts], counts)
    shifted = codes[ids].astype(np.uint64) << (64 - (at & 31) - own).astype(np.uint64)
    n = int(words.sum())
    # the bits don't overlap, so sums are ORs; a 32-bit sum is exact in a double
    high = np.bincount(at >> 5, weights=(shifted >> np.uint64(32)).astype(np.float64), minlength=n + 1)
    low = np.bincount((at >> 5) + 1, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n + 1)
    payload = (high[:n] + low[:n]).astype(np.uint64).astype(">u4").tobytes()
    blocks = (counts + block - 1) // block
    nth = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return payload, at[np.repeat(starts, blocks) + nth * block] if len(ids) else np.zeros(0, np.int64)


def decode_table(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each possible next `longest` bits: the id they start with and the length of its code."""
    longest = max(int(lengths.max()) if len(lengths) else 1, 1)
    ids, taken = np.zeros(1 << longest, np.uint32), np.ones(1 << longest, np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    span = np.int64(1) << (longest - lengths[order])
    filled = int(span.sum())
    ids[:filled] = np.repeat(order, span)
    taken[:filled] = np.repeat(lengths[order], span)
    return ids, taken, longest


def unpack(payload: bytes, marks: np.ndarray, counts: np.ndarray, symbols: np.ndarray, taken: np.ndarray, longest: int, block: int = BLOCK) -> np.ndarray:
    """Ids of all documents in a row; every block is read from its own mark, all blocks side by side."""
    words = np.concatenate((np.frombuffer(payload, ">u4").astype(np.uint64), np.zeros(2, np.uint64)))
    blocks = (counts + block - 1) // block
    nth = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    sizes = np.minimum(block, np.repeat(counts, blocks) - nth * block)
    out = np.empty(int(counts.sum()), np.uint32)
    place = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    at, place, left = marks[order].astype(np.int64), place[order], -np.sort(-sizes)
    mask, top = np.uint64((1 << longest) - 1), 64 - longest
    for step in range(int(left[0]) if len(left) else 0):
        active = int(np.searchsorted(-left, -step, "left"))  # blocks with more than `step` ids
        at, place = at[:active], place[:active]
        word = at >> 5
        window = (words[word] << np.uint64(32) | words[word + 1]) >> (top - (at & 31)).astype(np.uint64) & mask
        out[place + step] = symbols[window]
        at = at + taken[window]
    return out


def _code_arrays(spark: SparkSession, code: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = code.toArrow()  # one row per id of the vocabulary at most
    lengths = np.zeros(1 << 16, np.int64)
    lengths[rows.column("id").to_numpy()] = rows.column("bits").to_numpy()
    return lengths, canonical_codes(lengths)


def write_shards(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Encodes docs(doc_id, text) and writes `path`/code and `path`/shards."""
    spark = docs.sparkSession
    tokens = written(tokenized(docs, vocabulary or vocabulary_path()), "tokens")
    seen = id_counts(tokens).toArrow()  # one row per id of the vocabulary at most
    counts = np.zeros(1 << 16, np.int64)
    counts[seen.column("id").to_numpy()] = seen.column("n").to_numpy()
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], CODE).coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast((codes, lengths))

    def encode(batches):
        codes, lengths = shared.value
        shard, base, run = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, RUN):
                part = batch.slice(start, RUN)
                ids, counts = _ids_of(part.column("ids"))
                payload, marks = pack(ids, counts, codes, lengths)
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([shard], pa.int32()), "run": pa.array([run], pa.int32()), "base": pa.array([base], pa.int64()),
                    "doc_ids": pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "n_tokens": pa.array([counts.tolist()], pa.list_(pa.int64())),
                    "marks": pa.array([marks.tolist()], pa.list_(pa.int64())), "payload": pa.array([payload], pa.binary()),
                })
                base, run = base + len(ids), run + 1

    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(counts.sum()) // SHARD_IDS))
    ordered = tokens.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(encode, SHARDS).write.option("compression", "zstd").parquet(f"{path}/shards")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Documents from the files: doc_id, start (ids of all documents before it), n_tokens, ids as bytes (32-bit)."""
    lengths, codes = _code_arrays(spark, spark.read.schema(CODE).parquet(f"{path}/code"))
    shared = spark.sparkContext.broadcast(decode_table(lengths, codes))

    def decode(batches):
        symbols, taken, longest = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                counts = row.column("n_tokens").flatten().to_numpy().astype(np.int64)
                ids = unpack(row.column("payload")[0].as_py(), row.column("marks").flatten().to_numpy(), counts, symbols, taken, longest)
                ends = np.cumsum(counts)
                packed = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(np.concatenate(([0], ends)) * 4), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(counts), row.column("shard")[0].as_py(), np.int32)), row.column("doc_ids").flatten(), pa.array(row.column("base")[0].as_py() + ends - counts), pa.array(counts), packed.cast(pa.binary())],
                    names=["shard", "doc_id", "in_shard", "n_tokens", "ids"],
                )

    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    sizes = shards.select("shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    # one row per shard, so per task of the writer
    before = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    docs = shards.mapInArrow(decode, "shard int, doc_id long, in_shard long, n_tokens long, ids binary")
    return docs.join(checked_broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("in_shard")).alias("start"), "n_tokens", "ids")


def ids_crc32(df: DataFrame) -> DataFrame:
    """Replaces `ids` (32-bit little-endian) by their unsigned CRC-32."""
    return df.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op1_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "shards")
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    return ids_crc32(read_shards(spark, path))


