"""Keep a table of page versions in step with fetched pages: a file stream that takes only what is new.

    python -m jobs.page_sync --source FETCHED --target VERSIONS --checkpoint STATE [--config FILE]

Fetched pages (page_id, url, html) come as files in a folder, or as files of a pattern. Every run takes the files that no run before it has taken, in micro-batches, reads
each page once, and writes the pages that are new or whose html has changed. The output is a Parquet table partitioned by the batch and by
what happened (new, changed); a batch that is run again replaces its own partitions, so a failed run is simply repeated.
The current pages are the highest version of each (kb_id, path): see ``current``.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docloom.functions import urls
from docloom.sources import pages as src
from jobs.common import command, held, logger, settings

DEFAULTS = {"format": "parquet", "files_a_batch": 1000}
SOURCE = "page_id long, url string, html string"
VERSIONS = "kb_id string, path string, url string, title string, content_hash string, content_len long, links array<string>, version int, batch long, status string"
KEY = ["kb_id", "path"]


def versions(spark: SparkSession, target: str) -> DataFrame:
    """All versions of all pages."""
    return spark.read.schema(VERSIONS).parquet(target)


def latest(rows: DataFrame) -> DataFrame:
    """Of each page the narrow row of its highest version: a group with partial maxima, no sort."""
    return rows.groupBy(*KEY).agg(F.max_by("content_hash", "version").alias("old_hash"), F.max("version").alias("old_version"))


def current(spark: SparkSession, target: str) -> DataFrame:
    """The page table: of each page its highest version."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("version"))
    return versions(spark, target).withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def read_pages(pages: DataFrame) -> DataFrame:
    """Rows of fetched pages, one a (kb_id, path): of several the one fetched last, with the greatest page_id, and then url and hash.

    A page whose URL is null or has no host belongs to the knowledge base ``unknown``, and its path is the URL as it is; null html counts as empty.
    """
    read = src.read_facts(pages, "hrefs")
    table = src.of_facts(read.withColumn("url", F.coalesce("url", F.lit("")))).withColumn("path", F.when(urls.host(F.col("url")).isNull(), F.col("url")).otherwise(F.col("path")))
    target = F.array_sort(F.array_distinct(F.filter(F.transform(F.filter("hrefs", urls.followable), lambda h: urls.resolve_any(F.col("url"), h)), lambda x: x.isNotNull())))
    links = read.select("page_id", F.coalesce("url", F.lit("")).alias("url"), "content_hash", target.alias("links"))
    # Rows that agree in these three have the same html, so one of them stands for all.
    one = table.select(*KEY, F.struct(F.coalesce("page_id", F.lit(-1)).alias("at"), "url", "content_hash", "title", "content_len", "page_id").alias("r")).groupBy(*KEY).agg(F.max("r").alias("r"))
    links = links.groupBy("page_id", "url", "content_hash").agg(F.first("links").alias("links"))
    one = one.select(*KEY, "r.*")
    same = one["page_id"].eqNullSafe(links["page_id"]) & (one["url"] == links["url"]) & (one["content_hash"] == links["content_hash"])
    return one.join(links, same).select(*[one[c] for c in (*KEY, "url", "title", "content_hash", "content_len")], links["links"])


def take(spark: SparkSession, pages: DataFrame, batch: int, target: str) -> None:
    """Write what a batch of fetched pages adds to the versions of earlier batches."""
    known = latest(versions(spark, target).filter(F.col("batch") < batch).select(*KEY, "content_hash", "version"))
    new = read_pages(pages).join(known, KEY, "left").filter(~F.col("old_hash").eqNullSafe(F.col("content_hash")))
    status = F.when(F.col("old_version").isNull(), "new").otherwise("changed")
    out = new.withColumns({"version": F.coalesce("old_version", F.lit(0)) + 1, "batch": F.lit(batch).cast("long"), "status": status}).drop("old_hash", "old_version")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "status").parquet(target)


def run(spark: SparkSession, source: str, target: str, checkpoint: str, given: dict | None = None) -> DataFrame:
    """Take all files of the source that the checkpoint does not know yet, wait for them, and return all versions."""
    s, log = settings(DEFAULTS, given), logger("page_sync")
    spark.createDataFrame([], VERSIONS).write.mode("append").partitionBy("batch", "status").parquet(target)  # there is a table to read, even before any page
    stream = spark.readStream.format(s["format"]).schema(SOURCE).option("maxFilesPerTrigger", s["files_a_batch"]).load(source)

    def batch(df: DataFrame, k: int) -> None:
        take(df.sparkSession, df, k, target)
        n = versions(df.sparkSession, target).filter(F.col("batch") == k).groupBy("status").count().collect()
        log.info("batch %d: read %s files of %s, wrote to %s: %s", k, len(df.inputFiles()), source, target, {r["status"]: r["count"] for r in n})

    # Whole pages travel to Python, so few of them at once; a stream takes the settings that hold when it starts.
    with held(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1000", spark__sql__execution__arrow__maxBytesPerBatch=str(4 << 20)):
        q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    took = [p["numInputRows"] for p in q.recentProgress]
    log.info("run ended: %d batches, %d rows read from %s", len([x for x in took if x]), sum(took), source)
    return versions(spark, target)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    return command("page_sync", __doc__.splitlines()[0], ["source", "target", "checkpoint"], run, argv, spark)


if __name__ == "__main__":
    sys.exit(main())
