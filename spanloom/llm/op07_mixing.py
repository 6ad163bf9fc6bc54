"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / size times on average: a whole
number of copies and a probability for one more. Pivotal rounding settles those
probabilities: two documents meet, and probability moves from one to the other so
that (words x probability) of the pair stays and one of the two becomes 0 or 1; which
way it goes is random, with odds that leave each document's own expectation unchanged.
So a source's words stay at the target until one document is left, and the error is
at most that document.

The meetings form a reduction tree. Documents are dealt to LEAVES leaves per source by
a hash of their id; a task runs through its leaves in order with one open document in
hand, so it needs no memory; what is left open of each leaf meets on the next level
(FAN leaves to one), up to one document per source. The largest source is spread over
all leaves. Order and chance come from hashes, so reruns agree on any cluster.

Rows that repeat (doc_id, source, size) are settled together as one unit of their
joint size. Other defined cases: a null text has size 0; a null source is a source
and comes last; documents of size 0 are taken 0 times; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import checked_broadcast, free_name, slices, written

WEIGHTS = (3, 1, 2)
#: Words to take, of all words, as a fraction.
SHARE = (3, 2)
MOST = 2
LEAVES, FAN = 4096, 64
SEED = 7
UNIT = "doc_id long, source string, size long, n long, h long, bucket long, copies long, p double"
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_counts(column) -> np.ndarray:
    """Words of each text of an Arrow column, from its bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(len(column), np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]: offsets[-1]]
    offsets = offsets - offsets[0]
    word = ~SPACE[data]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    starts[first] = word[first]
    before = np.concatenate(([0], np.cumsum(starts, dtype=np.int64)))
    return before[offsets[1:]] - before[offsets[:-1]]


def with_size(docs: DataFrame, column: str) -> DataFrame:
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{column}` long"])

    def add(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(word_counts(part.column("text")))], names=[*part.schema.names, column])

    return docs.mapInArrow(add, schema)


def targets(units: DataFrame) -> DataFrame:
    """source, source_size, target: shares by weight, none above MOST times its size."""
    spark = units.sparkSession
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    # ranks by range: a partition's first rank is the number of sources before it
    in_order = F.asc_nulls_last("source")
    spread = sizes.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), in_order)
    placed = written(spread.withColumn("part", F.spark_partition_id()), "sources")
    before = placed.groupBy("part").agg(F.count("*").alias("m"))
    before = before.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("before"))  # one row per partition
    rank = F.row_number().over(Window.partitionBy("part").orderBy(in_order)) - 1
    ranked = placed.withColumn("rank", rank).join(checked_broadcast(before), "part")
    turn = F.array(*map(F.lit, WEIGHTS))[((F.col("before") + F.col("rank")) % len(WEIGHTS)).cast("int")]
    weighed = written(ranked.select("source", "source_size", turn.cast("long").alias("weight")), "weights")
    level, cap = None, F.col("source_size") * MOST
    total = weighed.agg(F.sum("source_size")).head()[0] or 0
    while True:  # sources above their cap get the cap; the rest shares what is left
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        row = weighed.agg(F.sum(F.when(above, cap).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).head()
        capped, weight = row[0] or 0, row[1] or 0
        new = (total * SHARE[0] / SHARE[1] - capped) / weight if weight else level or 0.0
        if new == level:
            break
        level = new
    share = F.least(F.col("weight") * F.lit(float(level)), cap.cast("double"))
    return weighed.select("source", "source_size", share.alias("target"))


def mix64(value: int) -> int:
    value = (value ^ value >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    value = (value ^ value >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return value ^ value >> 31


def chance(a: int, b: int, level: int) -> float:
    return mix64(mix64((a & 0xFFFFFFFFFFFFFFFF) + 0x9E3779B97F4A7C15 * (level + SEED)) ^ (b & 0xFFFFFFFFFFFFFFFF)) / 2.0**64


def meet(p: float, s: float, q: float, t: float, u: float) -> tuple[float, float]:
    """Probabilities of documents of sizes s and t after their meeting; u is uniform in [0, 1)."""
    up = min(1 - p, q * t / s)  # what the first can gain
    down = min(p, (1 - q) * t / s)  # what it can lose
    if u * (up + down) < down:
        p, q = (1.0, q - up * s / t) if 1 - p <= q * t / s else (p + up, 0.0)
    else:
        p, q = (0.0, q + down * s / t) if p <= (1 - q) * t / s else (p - down, 1.0)
    return p, min(max(q, 0.0), 1.0)


def settle_level(units: DataFrame, level: int, last: bool) -> DataFrame:
    """One level: within (source, bucket) all but at most one unit end with p 0 or 1; on the last level all do."""

    def run(batches):
        held, key = None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                own = row["source"], row["bucket"]
                if held and own != key:
                    done.append(held)
                    held = None
                key = own
                if not 0 < row["p"] < 1:
                    done.append(row)
                elif held is None:
                    held = row
                else:
                    held["p"], row["p"] = meet(held["p"], held["size"] * held["n"], row["p"], row["size"] * row["n"], chance(held["h"], row["h"], level))
                    pair = [x for x in (held, row) if 0 < x["p"] < 1]
                    done += [x for x in (held, row) if not 0 < x["p"] < 1]
                    held = pair[0] if pair else None
            yield pa.RecordBatch.from_pylist(done, batch.schema)
        if held:
            yield pa.RecordBatch.from_pylist([held], batch.schema)

    def close(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                if 0 < row["p"] < 1:
                    row["p"] = float(chance(row["h"], row["h"], level + 1) < row["p"])
            yield pa.RecordBatch.from_pylist(rows, batch.schema)

    # the longest first: documents of like length settle each other, and the last one open tends to be short
    ordered = units.withColumn("weight", F.col("size") * F.col("n")).repartition("source", "bucket").sortWithinPartitions("source", "bucket", F.desc("weight"), "h", "doc_id", "size").drop("weight")
    settled = ordered.mapInArrow(run, UNIT)
    return settled.mapInArrow(close, UNIT) if last else settled


def decisions(sized: DataFrame) -> DataFrame:
    """doc_id, source, size, n, source_size, target, copies for the distinct rows of sized(doc_id, source, size)."""
    units = written(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "units")
    shares = written(targets(units), "targets")
    small = checked_broadcast(shares.withColumnsRenamed({"source": "__source"}))
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    dealt = units.join(small, F.col("source").eqNullSafe(F.col("__source")), "left").withColumn("rate", rate)
    hashed = F.xxhash64("doc_id", "size", F.lit(SEED))
    width = LEAVES
    open_units = dealt.select("doc_id", "source", "size", "n", hashed.alias("h"), F.pmod(hashed, F.lit(width)).alias("bucket"),
                              F.floor("rate").alias("copies"), (F.col("rate") - F.floor("rate")).alias("p"))
    closed, level = [], 0
    while True:
        rows = written(settle_level(open_units, level, width == 1), "mixed")
        fractional = (F.col("p") > 0) & (F.col("p") < 1)
        closed.append(rows.where(~fractional))
        if width == 1:
            break
        width, level = max(1, width // FAN), level + 1
        open_units = rows.where(fractional).withColumn("bucket", F.pmod("bucket", F.lit(width)))
    every = closed[0]
    for more in closed[1:]:
        every = every.unionByName(more)
    settled = every.select("doc_id", "source", "size", "n", (F.col("copies") + F.col("p").cast("long")).alias("copies"))
    return settled.join(small, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, source, text, ...), each as often as it is taken."""
    size, copies = free_name(docs, "size"), free_name(docs, "copies")
    keys = docs.select(F.col("doc_id").cast("long"), "source", "text")
    plan = decisions(with_size(keys, "size").drop("text"))
    plan = plan.where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("copies").alias("__copies"))
    sized = with_size(docs, size)
    found = sized.join(plan, sized["doc_id"].eqNullSafe(plan["__id"]) & sized["source"].eqNullSafe(plan["__source"]) & (sized[size] == plan["__size"]))
    return found.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def op7_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "source", "text")
    plan = decisions(with_size(docs, "size").drop("text"))
    each = plan.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")
