"""Streaming forms of the build: labels that go on from batch to batch, and event-time counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "dialog bigint, session bigint, turn bigint, label bigint, batch_no bigint"


def label_stream(messages: DataFrame, size: int = 10) -> DataFrame:
    """Running label of each message in its dialog, and its batch in its session.

    The state of a dialog is its last label, its current session and how many messages that has; a new session
    starts a new batch and keeps the label. Messages of a trigger are ordered inside it; order between
    triggers is the source's.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        label, session, pos = state.get if state.exists else (0, -1, 0)
        rows = pd.concat(list(frames)).sort_values(["session", "turn"])
        out = []
        for s, t in zip(rows["session"].tolist(), rows["turn"].tolist()):
            if s != session:
                session, pos = s, 0
            label, pos = label + 1, pos + 1
            out.append((key[0], s, t, label, (pos - 1) // size))
        state.update((label, session, pos))
        yield pd.DataFrame(out, columns=["dialog", "session", "turn", "label", "batch_no"])

    return messages.groupBy("dialog").applyInPandasWithState(step, OUT, "label bigint, session bigint, pos bigint", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all that is there, with its checkpoint beside its output, and read the output."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Number and sum of events by type in windows of event time; later events than ``late`` are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def latest(stream: DataFrame, folder: str) -> DataFrame:
    """Run an aggregate in complete mode over all that is there; the last trigger's table is the result.

    A trigger that is run again overwrites its own folder, so the sink is idempotent.
    """

    def write(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}-checkpoint").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    done = stream.sparkSession.read.parquet(folder)
    return done.join(F.broadcast(done.agg(F.max("epoch").alias("epoch"))), "epoch").drop("epoch")  # one row


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet")
