"""Streaming variants: incremental detection, log assembly, windowed counts.

Every function takes a streaming (or static) DataFrame and returns one; the caller starts the
query with a checkpoint location in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 16) -> DataFrame:
    """A file stream with an event time named at."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def detections(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Calls of catalogued methods as they arrive: a stream-static join, no state."""
    return events.where("kind = 'METHOD_CALL'").join(catalog, "callee")


def windowed_counts(events: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums of each event type in tumbling or sliding windows; rows later than the watermark are dropped."""
    frame = F.window("at", width, slide) if slide else F.window("at", width)
    made = events.withWatermark("at", late).groupBy(frame.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return made.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of each user that end after a gap."""
    made = events.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return made.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_flows(flows: DataFrame, late: str) -> DataFrame:
    """Each flow (source, sink, at) once, whatever the path it is found by."""
    return flows.withWatermark("at", late).dropDuplicatesWithinWatermark(["source", "sink"])


INTERACTION = "id string, prompt string, response string, success boolean, n_events int"


def assembled(log: DataFrame) -> DataFrame:
    """Interaction records put together from log events (id, event, text, success) as they arrive.

    State is one small record for each open interaction; it is emitted and dropped once the
    response is there.
    """

    def step(key, frames, state):
        import pandas as pd

        prompt, response, success, n = state.get if state.exists else (None, None, None, 0)
        for frame in frames:
            for event, text, ok in zip(frame["event"], frame["text"], frame["success"], strict=True):
                n += 1
                if event == "prompt":
                    prompt = text
                elif event == "response":
                    response, success = text, bool(ok)
        if prompt is not None and response is not None:
            state.remove() if state.exists else None
            yield pd.DataFrame([(key[0], prompt, response, success, n)], columns=["id", "prompt", "response", "success", "n_events"])
        else:
            state.update((prompt, response, success, n))
            yield pd.DataFrame({"id": [], "prompt": [], "response": [], "success": [], "n_events": []})

    return log.groupBy("id").applyInPandasWithState(step, INTERACTION, "prompt string, response string, success boolean, n int", "append", "NoTimeout")


def resumable(rows: DataFrame, done_path: str):
    """A foreachBatch function that appends only apps without results, so that a batch can be repeated."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            done = spark.read.parquet(done_path).select("app_id").distinct()
        except Exception as error:  # the folder is not there before the first batch
            if "PATH_NOT_FOUND" not in str(error):
                raise
            done = spark.createDataFrame([], "app_id string")
        batch.join(done, "app_id", "left_anti").write.mode("append").parquet(done_path)

    return rows.writeStream.foreachBatch(write)
