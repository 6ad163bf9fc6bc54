"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are dealt to blocks by a hash of their id, queries to blocks of their own, and
each pair of blocks is one group. In a group every dimension has its list of the
block's vectors sorted by value. A query reads all its lists downward (upward where
its own component is negative), scores each vector it meets in full, and stops as soon
as the bound, the score of an imagined vector made of the values last read, is below
its k-th score; at equality it reads on, as ties go by id. The k best of every block
then meet in a window per query.

Work is by design the number of queries times the number of vectors, less what the
bound saves. A group holds BLOCK vectors and QUERY_BLOCK queries whatever the table's size.

Defined cases: vectors that are null, or hold null or non-finite components, take no
part; shorter vectors count as padded with zeros; rows that share the query's vec_id
are not its candidates; a null vec_id is neither; repeated rows are candidates each.
Scores are 64-bit integers: exact while components stay below 2**23 in 2**10 dimensions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import written

K = 5
BLOCK, QUERY_BLOCK = 4096, 1024
#: Depth of the first read; each further one is four times as deep.
DEPTH = 32
FOUND = "query_id long, vec_id long, score long"


def matrix(column, width: int) -> np.ndarray:
    """Integer vectors as rows, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def sorted_lists(vectors: np.ndarray) -> np.ndarray:
    """[direction, dimension, depth]: rows from small to large (0) and from large to small (1)."""
    order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)
    return np.stack((order, order[:, ::-1]))


def threshold_top_k(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and scores of the k best rows, ties to the smaller id."""
    n = len(vectors)
    used = np.flatnonzero(query)
    if not len(used):
        used = np.arange(min(1, len(query)))  # all scores are 0: one list is read to its end
    way, weights = (query[used] > 0).astype(np.int64), query[used]
    done = ids == own
    met = np.zeros(n, bool)
    best, scores = np.zeros(0, np.int64), np.zeros(0, vectors.dtype)
    at, step = 0, DEPTH
    while at < n:
        end = min(n, at + step)
        read = lists[way, used, at:end]
        met[read.ravel()] = True
        new = np.flatnonzero(met & ~done)
        done |= met
        own_scores = (vectors @ query)[new] if 4 * len(new) > n else vectors[new] @ query
        best, scores = np.concatenate((best, new)), np.concatenate((scores, own_scores))
        if len(best) > k:
            least = np.partition(scores, -k)[-k]
            best, scores = best[scores >= least], scores[scores >= least]
            rank = np.lexsort((ids[best], -scores))[:k]
            best, scores = best[rank], scores[rank]
        bound = (vectors[read[:, -1], used] * weights).sum()
        if len(best) == k and bound < scores.min():
            break
        at, step = end, step * 4
    rank = np.lexsort((ids[best], -scores))
    return best[rank], scores[rank]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for vectors(vec_id, v) and queries(vec_id, v), v arrays of whole numbers."""
    vectors, queries = written(vectors.where("vec_id IS NOT NULL"), "vectors"), written(queries.where("vec_id IS NOT NULL"), "queries")
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).head()
    n_blocks = max(1, -(-n // block))
    n_query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    width = width or 0
    place = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    left = vectors.withColumn("b", place(n_blocks)).withColumn("q", every(n_query_blocks))
    right = queries.withColumn("q", place(n_query_blocks)).withColumn("b", every(n_blocks))

    def search(rows, asked):
        ids, qids = rows.column("vec_id").to_numpy(), asked.column("vec_id").to_numpy()
        out = [[], [], []]
        if len(ids) and len(qids):
            size = max(width, 1)
            x, wanted = matrix(rows.column("v"), size), matrix(asked.column("v"), size)
            # doubles hold whole numbers up to 2**53, and multiply faster
            if size * float(np.abs(x).max(initial=0)) * float(np.abs(wanted).max(initial=0)) < 2.0**53:
                x, wanted = x.astype(np.float64), wanted.astype(np.float64)
            lists = sorted_lists(x)
            for query, own in zip(wanted, qids):
                best, scores = threshold_top_k(x, ids, query, own, k, lists)
                for kept, values in zip(out, (np.full(len(best), own), ids[best], scores.astype(np.int64))):
                    kept.append(values)
        return pa.table([np.concatenate(c) if c else np.zeros(0, np.int64) for c in out], names=["query_id", "vec_id", "score"])

    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(search, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def whole_vectors(table: DataFrame) -> DataFrame:
    """vec_id, v: each component x as floor(256 * x); rows with a null or non-finite component are left out."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.where(F.col("embedding").isNotNull() & sound).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("v"))


def op4_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
