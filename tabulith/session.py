"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings that may be changed on a live session."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # rows that hold packed blocks are large: a batch of ten thousand would hold a table
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    }.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: str | int = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tabulith")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="tabulith-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for an intermediate table, on shared storage."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: a fit gets a task for every so many rows, up to so many tasks, and beyond them no more rows a task than this;
#: each task of a forest sends sums for every node, so more tasks than that cost more than they save
FIT_ROWS, FIT_TASKS, FIT_ROWS_MOST = 25_000, 24, 1_000_000


def spread(df: DataFrame, rows: int, rows_a_task: int | None = None) -> DataFrame:
    """The rows dealt evenly over tasks: for a fit, or of ``rows_a_task`` each. Few rows stay as they are.

    A file of a few MB is read by one task, however many rows it holds and however much work on each follows."""
    want = -(-rows // rows_a_task) if rows_a_task else max(min(-(-rows // FIT_ROWS), FIT_TASKS), -(-rows // FIT_ROWS_MOST))
    return df.repartition(want) if want > max(1, df.rdd.getNumPartitions()) else df


def dealt_keys(spark: SparkSession, tasks: int) -> list[int]:
    """Whole numbers that ``repartition(tasks, number)`` sends to a task each, in the order of the tasks."""
    found = spark.range(40 * tasks).groupBy(F.pmod(F.hash("id"), F.lit(tasks)).alias("at")).agg(F.min("id").alias("id")).collect()  # one row a task
    at = {r["at"]: r["id"] for r in found}
    return [at.get(t, t) for t in range(tasks)]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
