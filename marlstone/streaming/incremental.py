"""Incremental work: what is left to do, keyed merges of what is done, and streams of arriving documents.

The streaming functions are an extension: the batch operators define the results.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose key is not done."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def finished_files(files: DataFrame, progress: DataFrame, outputs: DataFrame, least: int = 100) -> DataFrame:
    """Sources that progress lists and whose output file is there with over least bytes: those are skipped."""
    listed = progress.select(F.explode("completed_files").alias("source")).distinct()
    written = outputs.where(F.col("length") > least).select("source").distinct()
    return files.join(listed, "source", "left_semi").join(written, "source", "left_semi").select("source")


def uncovered(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sources without any chunk."""
    return sources.join(chunks.select("source").distinct(), "source", "left_anti")


def merge_done(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends rows whose key is not there yet: a batch that is run again adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.schema(batch.schema).parquet(path).select(key).distinct()
            batch = batch.join(known, key, "left_anti")
        except AnalysisException as error:  # the first batch has nothing to compare with
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        batch.dropDuplicates([key]).write.mode("append").parquet(path)

    return write


def stream_documents(spark: SparkSession, folder: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Documents that arrive as Parquet files go through transform to the sink; runs until what is there is done."""
    arriving = spark.readStream.schema(schema).parquet(folder)
    return transform(arriving).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) of events (ts, event_type, value); on a stream, late rows past the watermark go."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    out = timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
