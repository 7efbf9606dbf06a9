"""Build the full-text index of a table of documents: postings by buckets of terms, with document frequencies and lengths.

    python -m jobs.document_index --source DOCUMENTS --target INDEX [--config FILE]

Documents (doc_id, text) become rows (term, doc_id, tf, doc_len, df), folded and split as the page index is. The output is a Parquet table partitioned by
the bucket of the term, and sorted by term inside its files, so a search reads one bucket a word, and of it the row groups that hold the
word. Postings move once: the terms of a bucket are dealt over shards, as many as there are documents for, and a shard is counted, sorted and written by one task. A word
has one posting a document at most, so no word is much of a shard unless documents are of few words; its rows spill where they do not fit.
A run replaces the whole index; run again over the same documents it gives the same rows.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docloom.functions import text
from jobs.common import command, held, logger, settings

DEFAULTS = {"format": "parquet", "buckets": 32, "shards": 16}
SOURCE = "doc_id long, text string"
INDEX = "term string, doc_id long, tf long, doc_len long, df long, bucket int"
INDEX_COLUMNS = [c.split()[0] for c in INDEX.split(", ")]
#: Constants of the ranking function, as in the page index.
K1, B = 1.2, 0.75
#: Documents for which a bucket gets one more shard.
DOCUMENTS = 250_000


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term), F.lit(buckets)).cast("int")


def shards(documents: int, most: int) -> int:
    """Shards of a bucket, so that the work of a task stays the same however many documents there are."""
    return min(most, 1 + documents // DOCUMENTS)


def postings(docs: DataFrame, tasks: int) -> DataFrame:
    """term, doc_id, tf and doc_len of documents. Rows of one id are one document; rows without an id or a term are in no posting.

    Texts move once, by document; lengths are added up before, and words counted after, each word has become a row.
    """
    d = docs.filter("doc_id is not null").select("doc_id", "text").repartition(tasks, "doc_id")
    words = d.select("doc_id", text.tokens(F.col("text")).alias("words")).withColumn("doc_len", F.sum(F.size("words")).over(Window.partitionBy("doc_id")))
    each = words.select("doc_id", "doc_len", F.explode("words").alias("term"))
    return each.groupBy("doc_id", "doc_len", "term").agg(F.count("*").alias("tf")).select("term", "doc_id", "tf", "doc_len")


def build(docs: DataFrame, s: dict, documents: int) -> DataFrame:
    """The rows of the index, each task's of one shard of a bucket and in the order of terms and documents."""
    n = shards(documents, s["shards"])
    p = postings(docs, s["buckets"] * n).withColumn("bucket", bucket(F.col("term"), s["buckets"]))
    p = p.withColumn("shard", F.col("bucket") * n + F.pmod(F.xxhash64("term"), F.lit(n)).cast("int")).repartitionById(s["buckets"] * n, "shard")
    # The term comes first, as Spark compares the first key of an order by its bytes; bucket and shard are the same in all of a task.
    same = Window.partitionBy("term", "bucket", "shard").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return p.withColumn("df", F.count("*").over(same)).select(*INDEX_COLUMNS)


def index(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(target)


def find(spark: SparkSession, target: str, words: list[str], buckets: int, documents: int, mean_len: float, limit: int = 10) -> DataFrame:
    """doc_id and score of the documents that rank best for words, any of them: only their buckets and row groups are read.

    ``documents`` and ``mean_len`` are those of the table: see ``totals``. Higher scores are better; ties go to the smaller doc_id.
    """
    asked = sorted({w for x in spark.createDataFrame([(w,) for w in words], "w string").select(text.tokens(F.col("w")).alias("t")).collect() for w in x["t"]})
    if not asked:
        return spark.createDataFrame([], "doc_id long, score double")
    at = [r[0] for r in spark.createDataFrame([(w,) for w in asked], "w string").select(bucket(F.col("w"), buckets)).distinct().collect()]
    rows = index(spark, target).filter(F.col("bucket").isin(at) & F.col("term").isin(asked))
    idf = F.log(1 + (F.lit(documents) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.lit(mean_len)))
    return rows.groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(limit)


def totals(spark: SparkSession, target: str) -> tuple[int, float]:
    """Documents that have a word, and their mean length."""
    r = index(spark, target).groupBy("doc_id").agg(F.first("doc_len").alias("n")).agg(F.count("*"), F.coalesce(F.avg("n"), F.lit(0.0))).first()
    return r[0], r[1]


def run(spark: SparkSession, source: str, target: str, given: dict | None = None) -> DataFrame:
    """Index all documents of the source into the target and return the index."""
    s, log = settings(DEFAULTS, given), logger("document_index")
    docs = spark.read.format(s["format"]).schema(SOURCE).load(source)
    documents = docs.count()
    # A task holds one bucket, so it needs no order by bucket, which would undo that of terms.
    with held(spark, spark__sql__maxConcurrentOutputFileWriters="1"):
        build(docs, s, documents).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(target)
    # A term has df rows, so its rows make one when each counts for 1 / df.
    n = index(spark, target).agg(F.count("*"), F.coalesce(F.round(F.sum(1 / F.col("df"))), F.lit(0)).cast("long"), F.countDistinct("bucket")).first()
    log.info("read %d documents of %s, wrote %d postings of %d terms in %d buckets to %s", documents, source, n[0], n[1], n[2], target)
    return index(spark, target)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    return command("document_index", __doc__.splitlines()[0], ["source", "target"], run, argv, spark)


if __name__ == "__main__":
    sys.exit(main())
