"""Exact ranks, running sums and quantiles that never gather a key in one task.

A window over a key sorts all rows of that key in one task. These functions
split large keys instead and put the pieces together through small summaries.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Keys with more rows than this are worked on in slices.
LARGE_KEY_ROWS = 100_000


def split_by_size(df: DataFrame, keys: list[str], limit: int = LARGE_KEY_ROWS):
    """(rows of ordinary keys, rows of large keys or None).

    Costs one pre-aggregated count over the key columns only, which mostly finds
    no large key. If it does, their list is checkpointed; the joins with it carry
    no broadcast hint, so a hash join is chosen by measured size alone.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    large = counts.where(F.col("_rows") > limit).select(*keys)
    if large.isEmpty():
        return df, None
    large = cut_lineage(large)
    return df.join(large, keys, "left_anti"), df.join(large, keys, "left_semi")


def join_aggregate(rows: DataFrame, aggregate: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join rows with an aggregation that has one row per key, whatever a key's size.

    Adaptive execution splits a key with very many rows only when both sides of
    the join come straight from a shuffle. An aggregation by the join keys does
    not, since its own shuffle already fits. The additional key, a function of
    the first one, makes Spark shuffle the small aggregated side once more.
    """
    again = F.length(keys[0])
    return (
        rows.withColumn("_again", again)
        .join(aggregate.withColumn("_again", again), [*keys, "_again"], how)
        .drop("_again")
    )


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Inclusive running sum per key for keys of any size.

    Rows are range-partitioned by key and order, so a large key spreads over
    many slices. The slice number is frozen by a checkpoint because range bounds
    are sampled; each slice is then summed alone and shifted by the total of the
    slices before it (at most one row per key and slice).
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = cut_lineage(
        df.withColumn("_value", value)
        .repartitionByRange(slices, *keys, *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.sum("_value").alias("_total"))
        .withColumn("_shift", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s"), "_shift")
    )
    within = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return (
        sliced.withColumn("_local", F.sum("_value").over(within))
        .join(shifts, [*same, F.col("_slice") == F.col("_s")])
        .withColumn(name, F.col("_local") + F.col("_shift"))
        .select(*df.columns, name)
    )


def values_at_ranks(
    df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], one_key: bool = False
) -> DataFrame:
    """Exact order statistics per key of a BIGINT column.

    ranks maps an output column to a function from the row count of the key to
    the wanted 1-based rank. A first pass counts value buckets, which the map side
    combines to little, and locates each rank in one of them; a second pass keeps the
    rows of the located buckets only and counts their values. A bucket is the bit
    length and the leading 17 bits: it keeps the order, there are at most 2^17 per
    bit length, and each spans a 65536th of its values' size. Negative values take
    the mirror images of the buckets. Nothing runs before the result is asked for.

    one_key promises that the keys have one value, so the located buckets are as few as
    the ranks and are broadcast; otherwise Spark chooses by their size when it knows it.
    """
    size = F.when(F.col("_value") < 0, -1 - F.col("_value")).otherwise(F.col("_value"))
    valued = (
        df.where(F.col(value).isNotNull())
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias("_value"))
        .withColumn("_size", size)
        # number of low bits a bucket leaves out
        .withColumn("_drop", F.greatest(F.length(F.bin("_size")) - 17, F.lit(0)))
        .withColumn("_bucket", F.col("_drop").cast("bigint") * F.lit(1 << 17) + F.expr("shiftright(_size, _drop)"))
        .withColumn("_bucket", F.when(F.col("_value") < 0, -1 - F.col("_bucket")).otherwise(F.col("_bucket")))
    )
    group = [f"_k{i}" for i in range(len(keys))]
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.array(
        *[F.struct(F.lit(n).alias("name"), f(F.col("_n")).cast("bigint").alias("rank")) for n, f in ranks.items()]
    )
    located = (
        valued.groupBy(*group, "_bucket")
        .agg(F.count(F.lit(1)).alias("_in_bucket"))
        .withColumn("_n", F.sum("_in_bucket").over(whole))
        .withColumn("_before", F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)))
        .withColumn("_want", F.explode(wanted))
        .where(
            (F.col("_want.rank") > F.col("_before"))
            & (F.col("_want.rank") <= F.col("_before") + F.col("_in_bucket"))
        )
        .select(
            *[F.col(g).alias(f"{g}_at") for g in group], F.col("_bucket").alias("_bucket_at"), "_n", "_before",
            F.col("_want.name").alias("_name"), F.col("_want.rank").alias("_rank"),
        )
    )
    if one_key:
        located = F.broadcast(located)
    upto = Window.partitionBy(*group, "_bucket", "_name").orderBy("_value")
    same = [F.col(g).eqNullSafe(F.col(f"{g}_at")) for g in group] + [F.col("_bucket") == F.col("_bucket_at")]
    hits = (
        valued.join(located, same)
        .groupBy(*group, "_bucket", "_name", "_before", "_rank", "_n", "_value")
        .agg(F.count(F.lit(1)).alias("_count"))
        .withColumn("_upto", F.col("_before") + F.sum("_count").over(upto))
        .where(F.col("_upto") >= F.col("_rank"))
        .groupBy(*group)
        .agg(
            F.max("_n").alias("n"),
            *[F.min(F.when(F.col("_name") == n, F.col("_value"))).alias(n) for n in ranks],
        )
    )
    return hits.select(*[F.col(g).alias(k) for g, k in zip(group, keys)], "n", *ranks)


def disc_rank(p: float) -> Callable[[Column], Column]:
    """Rank of the discrete quantile: the smallest with at least a share p at or below."""
    return lambda n: F.greatest(F.ceil(n * F.lit(p)), F.lit(1))
