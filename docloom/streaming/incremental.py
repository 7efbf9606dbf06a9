"""Incremental ingest: batches of fetched pages upserted into a page table as they come (an extension)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from docloom.plans import ingest
from docloom.sources.store import Store

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def page_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Fetched pages from Parquet files as they appear in a folder."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def keep_up(stream: DataFrame, store: Store, checkpoint: str, now: Callable[[], str] = lambda: datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")):
    """Start a query that takes each batch into its knowledge bases, with all that reads them: links, contents, toc, index and kbs.

    A batch that is run again gives the same tables; ``now`` gives the time that its pages and bases get.
    """

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            ingest.refresh(store, df, now())

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Windowed counts and sums of an event stream (ts, event_type, value), late rows within a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
