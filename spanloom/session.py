"""Session set-up and the folder that executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores="*", app="spanloom", **conf) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.parquet.compression.codec": "zstd",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's spark.checkpoint.dir.

    A session without one gets a temporary folder only when driver and
    executors are the same machine; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="spanloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, never used path below the shared folder."""
    return f"{shared_root(spark)}/spanloom/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def local_path(path: str) -> str:
    """Strip the file: scheme where plain Python file access is wanted."""
    return path[5:] if path.startswith("file:/") and not path.startswith("file://") else path.removeprefix("file://")
