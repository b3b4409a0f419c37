"""A folder that all executors share, and what a job stores there between its steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def landing(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's shared folder. Only a local session, which has one machine, may leave that unset."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        top = sc.getCheckpointDir()
    return f"{top.rstrip('/')}/landed-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, which ends its lineage there. Who makes a table that isn't read any more discards it."""
    path = landing(df.sparkSession, "table")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of stored tables, once all that was read from them is stored elsewhere."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
