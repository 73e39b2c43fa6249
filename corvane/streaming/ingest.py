"""Incremental ingest by Structured Streaming (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators import store
from corvane.sources.files import Extractor, plain_pages, texts, transcripts


def ingest_stream(spark: SparkSession, folder: str, path: str, checkpoint: str, extract: Extractor = plain_pages) -> StreamingQuery:
    """New files in ``folder`` replace their transcripts at ``path``; a batch that is run again replaces them alike."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.replace_transcripts(spark, path, transcripts(texts(batch.select("path", "content"), extract)))

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window and type with a watermark; works on streams and tables alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
