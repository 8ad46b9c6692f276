"""Where intermediate results may be written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """Folder that every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a session on one machine (tests) may name none; a fresh local folder is set there. On a cluster
    that would be a folder the executors cannot read, so it is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quillstone-", dir="/tmp")
        context.setCheckpointDir(root)
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """The same rows read back from reliable storage, so later stages never recompute them."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written as a table in the shared folder and read back: lineage ends here.

    What was shuffled for it is deleted when it is written; if Spark lacks some of it later, it repeats the stage.
    """
    path, conf = fresh_dir(df.sparkSession, label), df.sparkSession.conf
    old = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANUP) if old is None else conf.set(CLEANUP, old)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
