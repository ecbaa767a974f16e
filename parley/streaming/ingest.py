"""Messages as a stream: the same results as over the finished table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.conversations import summed_up
from parley.sources.jsonl import conversations_of, sound
from parley.sources.store import shared_folder


def drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """What a stream holds once all that is there has been read; state is kept in the shared folder."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    table = f"{name}_{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/parley-{table}/state")
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/parley-{table}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/parley-{table}/rows")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/parley-{table}/rows")

    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/parley-{table}/rows")


def opened(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream over a Parquet file or folder with the schema of what is there; a pattern that fits just it, since a stream's path may be no single file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{path[:-1]}[{path[-1]}]")


def turns(stream: DataFrame) -> DataFrame:
    """Running counts of each conversation, in complete mode."""
    return stream.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"))


def dataset_summary(stream: DataFrame, user: Column) -> DataFrame:
    """One row, as of the finished table: turns are counted as they come, and conversations summed up at the end of what is there."""
    counted = stream.groupBy("conv_id").agg(F.count("*").alias("n"), F.min(user).alias("user_id"))
    return summed_up(drained(counted, "summary", "complete"))


def ingested(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Valid conversations (conversation_id, user_id, messages, timestamp) of files of JSON lines, read as a stream: lines are checked
    as they come, and of those with one id, over all batches, one stays."""
    reader = spark.readStream.schema("value string")
    lines = (reader.option("maxFilesPerTrigger", files) if files else reader).text(path).select(F.col("value").alias("line"), F.lit(0).cast("long").alias("line_number"))
    found = conversations_of(sound(lines)).drop("line_number")
    return drained(found.dropDuplicates(["conversation_id"]), "ingested", "append")


def first_seen(stream: DataFrame, key: list[str]) -> DataFrame:
    """Rows without repeats of a key, across all batches."""
    return stream.dropDuplicates(key)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by time window and kind, late ones up to ``late``: an extension for event logs. Append mode gives windows once they are
    past; complete mode gives all that there are."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"))
