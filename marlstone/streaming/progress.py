"""Running progress of a caption stream: one event for each result, numbered over micro-batches, then a completion.

foreachBatch may run a batch again after a crash. So a batch's events and its line in
the ledger lie under the batch's number and are replaced as a whole, and numbering
begins after the sums of the ledger's earlier lines. A repeated batch therefore
writes what it wrote before, and events come out exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators.batch import image_index

LEDGER = "batch_id long, results long, captioned long, failed long, xmp_written long"


def read_ledger(spark: SparkSession, out: str) -> DataFrame:
    """(batch_id, results, captioned, failed, xmp_written): a line for each batch that is through."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{out}/ledger/*")
    except AnalysisException:  # no batch yet
        return spark.createDataFrame([], LEDGER)


def record(results: DataFrame, batch_id: int, out: str, order: str, total: int | None) -> None:
    """Writes the events and the ledger line of one micro-batch of results (name, error or null, and any others)."""
    spark = results.sparkSession
    before = read_ledger(spark, out).filter(F.col("batch_id") < batch_id).agg(F.coalesce(F.sum("results"), F.lit(0))).first()[0]
    numbered = image_index(results, order)
    events = numbered.select(
        F.lit("progress").alias("type"), (F.col("image_index") + 1 + before).alias("done"), F.lit(total).cast("long").alias("total"),
        *[c for c in results.columns], F.lit(batch_id).cast("long").alias("batch_id"),
    )
    events.write.mode("overwrite").parquet(f"{out}/events/{batch_id}")
    xmp = F.count_if(F.col("xmp_path").isNotNull()) if "xmp_path" in results.columns else F.lit(0).cast("long")
    line = results.agg(F.count(F.lit(1)).alias("results"), F.count_if(F.col("error").isNull()).alias("captioned"), F.count_if(F.col("error").isNotNull()).alias("failed"), xmp.alias("xmp_written"))
    line.select(F.lit(batch_id).cast("long").alias("batch_id"), "*").coalesce(1).write.mode("overwrite").parquet(f"{out}/ledger/{batch_id}")


def follow(
    stream: DataFrame, caption: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, order: str = "idx", total: int | None = None,
    available_now: bool = True, after_batch: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Captions a stream and records its progress under ``out``.

    ``caption`` gives results with a column error (null if captioned). ``total``, if
    known, stands in each event. ``after_batch`` is called once a batch is recorded.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        from marlstone.sources.shared import settle

        record(settle(caption(batch), "results"), batch_id, out, order, total)
        if after_batch:
            after_batch(batch_id)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def events(spark: SparkSession, out: str) -> DataFrame:
    """All progress events so far; only those of batches that are through."""
    done = read_ledger(spark, out).select("batch_id")
    return spark.read.option("mergeSchema", "false").parquet(f"{out}/events/*").join(F.broadcast(done), "batch_id", "left_semi")


def completion(spark: SparkSession, out: str) -> DataFrame:
    """The last event of a stream that has ended: type, total, captioned, failed, xmp_written."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("results", "total"), ("captioned", "captioned"), ("failed", "failed"), ("xmp_written", "xmp_written"))]
    return read_ledger(spark, out).agg(*sums).select(F.lit("complete").alias("type"), "*")
