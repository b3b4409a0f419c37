"""Helpers shared by the operators: table access, lineage cuts, text hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session, which has one machine, may leave it unset."""
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not there:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        there = sc.getCheckpointDir()
    return there.rstrip("/")


def free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more.

    It does so when the driver collects its garbage, by itself every 30 minutes only."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame, large: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back, which ends its lineage there; after a large step its
    shuffle files are freed. Who makes a table that isn't read any more discards it."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if large:
        free(df.sparkSession)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Deletes the files of tables that cut() made, once all that was read from them is stored elsewhere."""
    for df in stored:
        for path in [df.stored_at] if isinstance(df.stored_at, str) else df.stored_at:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: Bytes of a batch of rows between the JVM and Python, at most, where the session has Spark's default of 64 MB.
BATCH = "8m"


def bounded(df: DataFrame, most: str = BATCH) -> DataFrame:
    """df, whose session from now on sends Python small batches; batches exist several times over, in the JVM and in each worker."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == "67108864b":
        conf.set(key, most)
    return df


def give_back() -> None:
    """Returns a Python worker's free memory to the system; workers are reused and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def byte_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows in record batches whose texts have about limit bytes, however many rows Spark sends at once."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        for part in spans(sizes, limit, rows=2000):
            yield batch.slice(part.start, part.stop - part.start)
    give_back()


def spans(lengths: list[int], limit: int, rows: int = 1 << 30) -> Iterator[slice]:
    """Slices of consecutive items, ``rows`` at most, whose lengths add up to about limit."""
    begin = total = 0
    for k, n in enumerate(lengths):
        total += n
        if total >= limit or k + 1 - begin >= rows:
            yield slice(begin, k + 1)
            begin, total = k + 1, 0
    if begin < len(lengths):
        yield slice(begin, len(lengths))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0].., starts[1].. with lengths[i] consecutive ones each."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns by a generator of one row, across which the optimizer doesn't copy
    them into the filters and lambdas that use them, where they would be computed anew."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that must not broadcast. Spark sizes a table by its files and its columns' types, which says too
    little by far of exploded rows, of lists and of columns that compress well; such a table may be sent to the driver."""
    return df.hint("merge")


def bucketed(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """df as a table bucketed by key in the shared folder, whose joins on the key don't shuffle it; and the table's name, to drop it by."""
    spark = df.sparkSession
    name = f"by_{key}_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    free(spark)
    return spark.table(name), name


def drop_bucketed(spark: SparkSession, name: str) -> None:
    """Drops a table that bucketed() made, and its files."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, str]:
    """key, body (bytes) and copies of each different text, as a table bucketed by key; and its name."""
    rows = docs.select(F.unhex(F.md5("body")).alias("key"), "body")
    return bucketed(rows.groupBy("key").agg(F.first("body").alias("body"), F.count("*").alias("copies")), "key")
