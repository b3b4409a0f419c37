"""Usage events as streams: daily counters, admission by sliding window, and ingest of landed files."""

from __future__ import annotations

import datetime
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import publish

KINDS = ("page_loads", "searches", "table_row_opens", "outgoing_clicks")
WINDOW_S, MOST = 60, 20
LABELLED = "event_id long, user_id long, ts timestamp_ntz, admitted boolean"


def per_kind() -> list[Column]:
    return [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]


def daily(events: DataFrame) -> DataFrame:
    """Events of each kind by UTC day; days without any are left out. Works on tables and streams."""
    day = F.window(F.col("ts").cast("timestamp"), "1 day")
    out = events.where(F.col("kind").isin(*KINDS)).groupBy(day.alias("w")).agg(*per_kind())
    return out.select(F.to_date("w.start").alias("day"), *KINDS)


def clicks_by_tag(events: DataFrame) -> DataFrame:
    tag = F.get_json_object("props", "$.k")
    return events.where("kind = 'outgoing_clicks'").groupBy(F.to_date("ts").alias("day"), tag.alias("tag")).agg(F.count("*").alias("clicks"))


def write_daily(events: DataFrame, table: str, checkpoint: str):
    """Starts a query that keeps a table of daily counters, one partition a day.

    A batch's counts are kept beside the table by day and batch, and the days it touched are summed anew from
    them; so events count however late they come, and a replayed batch changes nothing. The stream has no state."""

    def add(batch: DataFrame, number: int) -> None:
        spark, parts = batch.sparkSession, f"{table}-batches"
        own = daily(batch)
        own.withColumn("batch", F.lit(number)).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(parts)
        days = own.select("day").distinct()
        kinds = ", ".join(f"{k} long" for k in KINDS)
        told = spark.read.schema(f"{kinds}, day date, batch long").parquet(parts).join(F.broadcast(days), "day")  # a batch's days; only their partitions are read
        sums = told.groupBy("day").agg(*(F.sum(k).alias(k) for k in KINDS))
        sums.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(table)

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()


def ingest(spark: SparkSession, landed: str, schema, staging: str, checkpoint: str):
    """Starts a query that moves landed files into staging, a partition for each batch, which a replay writes over."""

    def stage(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{staging}/batch={number}")

    return spark.readStream.schema(schema).parquet(landed).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(stage).start()


def staged_import(spark: SparkSession, store: publish.Store, run: publish.Run, landed: str, schema, at: datetime.datetime, **told) -> None:
    """Streams landed files into the run's staging and then publishes them as its source's rows.

    Nothing is served before the stream has ended; called again for the same run, as after a lost driver, it
    goes on behind the last committed batch. told: what ``publish.replace`` takes besides."""
    staging = f"{store.staging}/{run.source}-{run.run_id}"
    ingest(spark, landed, schema, f"{staging}/rows", f"{staging}/progress").awaitTermination()
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{staging}/rows")
    publish.replace(spark, store, run, rows, at, **told)
    publish.delete(spark, staging)


def admitted(times: list[float], state: deque, window: float = WINDOW_S, most: int = MOST) -> list[bool]:
    """Whether each event (seconds, ascending) is let in; only those let in count, until they are window old."""
    out = []
    for t in times:
        while state and t - state[0] >= window:
            state.popleft()
        out.append(len(state) < most)
        if out[-1]:
            state.append(t)
    return out


def told_apart(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with user and time, and the others, labelled NULL."""
    rows, known = events.select("event_id", "user_id", "ts"), F.col("user_id").isNotNull() & F.col("ts").isNotNull()
    return rows.where(known), rows.where(~known).withColumn("admitted", F.lit(None).cast("boolean"))


def seconds_of(ts: pd.Series) -> np.ndarray:
    return ts.astype("datetime64[us]").astype("int64").to_numpy() / 1e6


def admission_labels(events: DataFrame) -> DataFrame:
    """Each event with whether its user's window had room; without user or time that can't be told and is NULL.

    A task reads its users' events in order, holding one window at a time."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state = None, deque()
        for batch in batches:
            users, seconds = batch["user_id"].to_numpy(), seconds_of(batch["ts"])
            begin = np.flatnonzero(np.r_[True, users[1:] != users[:-1]]) if len(users) else []
            out = []
            for a, z in zip(begin, [*begin[1:], len(users)]):
                if users[a] != user:
                    user, state = users[a], deque()
                out += admitted(seconds[a:z].tolist(), state)
            yield batch.assign(admitted=out)

    rows, odd = told_apart(events)
    return rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInPandas(of, LABELLED).unionByName(odd)


class Admission(StatefulProcessor):
    """A user's window as state, cleared by a timer once the watermark has left it behind."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "times array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # one batch's events of one user, by their times
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        kept = deque(self.times.get()[0] if self.times.exists() else [])
        seconds = seconds_of(frame["ts"])
        labels = admitted(seconds.tolist(), kept)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.times.update((list(kept),))
        self.handle.registerTimer(int((max(seconds[-1], kept[-1] if kept else 0) + WINDOW_S) * 1000))
        yield frame.assign(admitted=labels)[["event_id", "user_id", "ts", "admitted"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        yield pd.DataFrame({"event_id": [], "user_id": [], "ts": [], "admitted": []}).astype({"event_id": "int64", "user_id": "int64", "ts": "datetime64[us]", "admitted": "bool"})

    def close(self) -> None:
        pass


def admission_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The same over a stream, with each user's window as state, which goes when the user has been quiet for a window.

    Events of a user must come in the order of their times from batch to batch; those later than ``late`` behind the
    newest aren't labelled. The session keeps state in RocksDB, which timers need."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, odd = told_apart(events)
    timed = rows.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    out = timed.groupBy("user_id").transformWithStateInPandas(Admission(), LABELLED, "Append", "eventTime")
    return out.unionByName(odd)
