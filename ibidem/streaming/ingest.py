"""Structured Streaming, in addition to the batch operators: ingest by files, and verdicts by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ibidem.operators.chunk import chunks


def stream_of(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def ingest(docs: DataFrame, target: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Chunks each batch of new documents into a folder. A batch is written under its number, so a repeated one replaces
    itself; a document seen within two hours of event time isn't taken again, if the stream has a timestamp `ts`."""
    fresh = docs.withWatermark("ts", "2 hours").dropDuplicatesWithinWatermark([key]) if "ts" in docs.columns else docs

    def write(batch: DataFrame, number: int) -> None:
        chunks(batch, key).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monthly(events: DataFrame, at: str = "ts", label: str = "event_type", late: str = "10 days", window: str = "30 days") -> DataFrame:
    """Counts of labels by window of event time; windows close when the watermark has passed."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), F.col(label).alias("label")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "label", "n")
