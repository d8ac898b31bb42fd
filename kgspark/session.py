"""Session helpers: the shared folder, durable cuts of lineage, and batch bounds."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "kgspark", cpus: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster, pass the cluster's own session instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is made and set for the session's life if everything runs on one machine; on a cluster that raises.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = made.get() if made.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="kgspark-shared-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


_made: list[str] = []


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is created yet."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clean_up(spark: SparkSession) -> int:
    """Delete the tables and files that this driver wrote below the shared folder; call it once results are stored elsewhere.

    Frames that read them can't be used afterwards. Returns the number of folders deleted.
    """
    gone = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


#: Rows of a file, about, where the number of rows is known beforehand.
FILE_ROWS = 100_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written copy.

    Survives lost executors, and Spark drops the files once the frame is no longer referenced. ``rows``, a bound on the number of rows, keeps
    small frames in few files however many partitions made them.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(2, -(-rows // FILE_ROWS)))
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly, for work that is dear by the row: small tables come as one split, and adaptive execution joins partitions by their bytes."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: column pruning and statistics stay available."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where the session started without its folder on PYTHONPATH.

    For local sessions and shared installations; elsewhere ship the package with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark
