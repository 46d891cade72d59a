"""Captioning a stream: stateless composition, a progress sink and an optional content dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators.assembly import compose


def read_inputs(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet caption inputs as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def compose_stream(inputs: DataFrame, seen_by: str | None = None, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Captions of each row as it comes. With ``seen_by`` and ``event_time``, repeats within ``delay`` are dropped first."""
    if seen_by:
        if not event_time:
            raise ValueError("dedupe needs an event time, so that its state stays bounded")
        inputs = inputs.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([seen_by])
    return compose(inputs)


def write_captions(captions: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends JSON lines exactly once (file sink)."""
    writer = captions.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).option("ignoreNullFields", "false")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def progress_events(results: DataFrame, order: str = "idx") -> DataFrame:
    """(done, total, name, status) of a finished batch, in order; one row per result."""
    from marlstone.operators.batch import image_index

    total = results.agg(F.count(F.lit(1)).alias("total"))
    rows = image_index(results, order).crossJoin(F.broadcast(total))
    return rows.select((F.col("image_index") + 1).alias("done"), "total", "name", F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"))
