"""Session helpers shared by the library, the registered queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

WIDE = 256  # tasks of a wide exchange, see ``spread``
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("knownwhen")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def utc_session(spark: SparkSession) -> SparkSession:
    """Pin the session time zone, which every operator in this package assumes."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; chosen here only in local sessions without one."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        shared = tempfile.mkdtemp(prefix="kw-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.sparkContext.setCheckpointDir(shared)
        shared = spark.sparkContext.getCheckpointDir() or shared
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes a stage result once as parquet in the shared checkpoint folder and reads it back.

    Operators that work in two levels read their input more than once. Put this between the
    reduction of raw data and such operators: raw data is then scanned once, lost executors
    recompute nothing before the cut, and column pruning and size statistics still work. The
    shuffle files of the write go with its end and don't wait for the driver's garbage collector.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.stage_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Deletes the stage results that ``cut_lineage`` returned as ``frames``, which nothing may read any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stage_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread(df: DataFrame, *columns: str, least: int = 1) -> DataFrame:
    """``df`` dealt by hash over all shuffle partitions of the session, and over ``least`` tasks at least; adaptive execution leaves these apart.

    For few small rows that are about to become many, which their own size would have merged into a task or two, and for
    sorts and groups whose memory should not follow the size of the table (``least=WIDE``).
    """
    return df.repartition(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *columns)
