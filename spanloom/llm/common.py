"""What the operators share: table reading, words, interned words per worker, checked broadcasts.

A word is a run of characters outside space and 0x09-0x0D. `bytes.split()` cuts
UTF-8 at exactly those six characters, so texts are handled as bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.session import cut_lineage, scratch_path  # noqa: F401  (for the operators)

#: Rows of a side that may be broadcast; beyond it the join shuffles.
SMALL_ROWS = 100_000
#: Rows of an Arrow batch where the rows hold whole texts.
BATCH_ROWS = 1000
#: Interned words a Python worker keeps before it starts afresh.
WORDS_KEPT = 400_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def written(df: DataFrame, label: str, *by: str) -> DataFrame:
    """The rows of df as a table in the shared folder: computed once, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Rows with whole texts go to Python in batches of `rows`, unless the session asks for fewer: a batch lies in memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def checked_broadcast(small: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Hints a broadcast only if `small` has few rows now; else Spark joins by shuffle."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def struct_type(*columns: tuple[str, str]) -> T.StructType:
    return T.StructType([T.StructField(name, T._parse_datatype_string(kind)) for name, kind in columns])


def as_bytes(column) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Interned(dict):
    """Numbers words in order of appearance; `fresh` holds those not yet worked on."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word):
        number = self[word] = len(self)
        self.fresh.append(word)
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


_STATE: list[tuple] = []


def worker_state(key: object, make):
    """The worker's state for `key` (compared by identity). It outlives a task, so what it learnt serves the next; a new key drops the old state."""
    if not _STATE or _STATE[0][0] is not key:
        _STATE.clear()
        _STATE.append((key, make()))
    return _STATE[0][1]


def drop_worker_state() -> None:
    """Frees what earlier tasks of the worker kept, for a task with a memory of its own."""
    worker_state(None, lambda: None)


def split_batch(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts in one list, and how many each text has."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            own = text.split()
            counts[i] = len(own)
            words += own
    return words, counts


def sums_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of the given sizes."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20):
    """Cuts a batch into runs of rows whose texts hold about `limit` bytes (a longer text stands alone)."""
    sizes = batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset: sizes.offset + len(sizes) + 1] if len(sizes) else np.zeros(1, np.int64)
    start = 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end
