"""Session helpers of the corpus operators: the shared folder, materialised tables, Arrow batch sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that Spark hands to Python at once: some MB of text for usual documents.
ARROW_ROWS = 400
#: Bytes of them, for tables of very long documents.
ARROW_BYTES = 8_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset a local session (tests) gets a temporary folder; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="lumigrid-")
        spark.sparkContext.setCheckpointDir(root)
        return spark.sparkContext.getCheckpointDir()
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder (files go when df is collected)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, name: str) -> DataFrame:
    """df written as compressed Parquet into the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumigrid/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove what `table` wrote, once nothing reads it any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows and the bytes that one Arrow batch carries to a Python worker (a longer row goes alone).

    Plans are lazy, so the bounds hold for the session from then on; they are lowered only, never raised.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def parts(spark: SparkSession) -> int:
    """Partitions for the shuffles that an operator sets itself."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
