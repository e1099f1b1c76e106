"""Structured Streaming twins of the trace operators. Each runs over the files of a folder, with a bounded state by
key, ends when all is read (``availableNow``) and gives its result as a table.

Checkpoints and result tables live in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch


def table(spark: SparkSession, path: str, batch_bytes: int = 256 << 20) -> DataFrame:
    """The files of a table as a stream; a micro-batch takes files of some ``batch_bytes``, one at least."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes))
    return reader.option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else reader.parquet(path)


def source(spark: SparkSession, path: str) -> DataFrame:
    """The files of a table as a stream, with event time as a timestamp."""
    return table(spark, path).withColumn("at", F.col("ts").cast("timestamp"))


def _is_file(spark: SparkSession, path: str) -> bool:
    """Whether a table is one file: its rows come from a file of its own name."""
    first = spark.read.parquet(path).select(F.col("_metadata.file_path")).first()
    return first is not None and first[0].rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1]


def finished(stream: DataFrame, keys: list[str] | None = None, log: str | None = None) -> DataFrame:
    """Runs an append stream to its end and reads what it wrote. With ``keys`` the stream is in update mode, and the last
    row of each key (by batch) stands. ``log``: the checkpoint's place, if it is to be kept."""
    spark, base = stream.sparkSession, scratch(stream.sparkSession, "stream")
    out = f"{base}/table"
    if keys is None:
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log or f"{base}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def keep(batch: DataFrame, number: int) -> None:  # a batch that runs again overwrites itself
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/__n={number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/log").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("__batch", T.IntegerType())])).parquet(out)
    columns = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "__batch").alias("__row"))
    return last.select(*keys, "__row.*")


def running_totals(spark: SparkSession, path: str) -> DataFrame:
    """Events, kinds and summed values of each user."""
    rows = source(spark, path).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.size(F.collect_set("event_type")).cast("long").alias("n_types"), F.round(F.sum("value"), 4).alias("total"))
    return finished(rows, ["user_id"])


def session_windows(spark: SparkSession, path: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of each user by event time, those that the watermark has passed. Sessions still open at the end of the
    stream are not among them: Spark gives session windows in append mode only."""
    rows = source(spark, path).withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n_events"))
    return finished(rows.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events"))


def epochs(spark: SparkSession, path: str, write: str = "purchase", most: int = 64) -> DataFrame:
    """State by user: a write opens a new epoch and forgets what was read; a kind read again in an epoch is a repeat.
    What an epoch has read is bounded by ``most`` kinds."""

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epoch, repeats, seen = state.get if state.exists else (0, 0, [])
        seen = list(seen)
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        for kind in rows["event_type"]:
            if kind == write:
                epoch, seen = epoch + 1, []
            elif kind in seen:
                repeats += 1
            else:
                seen = [*seen, kind][-most:]
        state.update((epoch, repeats, seen))
        yield pd.DataFrame({"user_id": [key[0]], "epoch": [epoch], "repeats": [repeats], "n_seen": [len(seen)]})

    rows = source(spark, path).select("user_id", "event_type", "event_id", "at").groupBy("user_id")
    rows = rows.applyInPandasWithState(advance, "user_id long, epoch long, repeats long, n_seen long", "epoch long, repeats long, seen array<string>", "update", GroupStateTimeout.NoTimeout)
    return finished(rows, ["user_id"])
