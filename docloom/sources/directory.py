"""Knowledge bases in directory form as tables: all directories below a root at once, read by Spark's readers; broken files are rows that say why.

A directory holds manifest.json, toc.json, docs/<path>.md and artifacts/<name>. A root without any gives empty tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docloom.operators import artifacts
from docloom.shipping import ship
from docloom.sources.store import SCHEMA_VERSION

MANIFEST = "schema_version int, id string, name string, source_url string, tool_version string, created_at string, updated_at string, page_count long, artifacts string, bad string"
REQUIRED = ("schema_version", "id", "name", "source_url", "page_count")


def _files(spark: SparkSession, pattern: str, **options: str) -> DataFrame:
    """file (its decoded path) and text of all files of a pattern, each whole; none if there is no such file."""
    try:
        found = spark.read.options(**options).text(pattern, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string, text string")
    return found.select(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("file"), F.col("value").alias("text"))


def _folder(inside: str) -> Column:
    """The directory's own name, of a file below it."""
    return F.regexp_extract("file", f"([^/]+)/{inside}", 1)


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """folder, the fields of its manifest, and problem: null for a proper one, else what is wrong with it. Artifacts are JSON, an array or an object."""
    m = _files(spark, f"{root}/*/manifest.json").select(_folder("manifest\\.json$").alias("folder"), F.from_json("text", MANIFEST, {"columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE"}).alias("m")).select("folder", "m.*")
    problem = F.when(F.col("bad").isNotNull(), "is no manifest")
    for k in REQUIRED:
        problem = problem.when(F.col(k).isNull(), f"{k} is missing")
    return m.withColumn("problem", problem.when(F.col("schema_version") > SCHEMA_VERSION, "its version is newer")).drop("bad")


def proper(spark: SparkSession, root: str) -> DataFrame:
    """Manifests of the directories that can be opened."""
    return manifests(spark, root).filter("problem is null").drop("problem")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """folder, id and name of every directory that has a manifest, broken ones too: ``?`` and ``unnamed`` stand for what is missing."""
    return manifests(spark, root).select("folder", F.coalesce("id", F.lit("?")).alias("id"), F.coalesce("name", F.lit("unnamed")).alias("name")).orderBy("folder")


def docs(spark: SparkSession, root: str) -> DataFrame:
    """folder, path and markdown of every page of every directory."""
    d = _files(spark, f"{root}/*/docs", recursiveFileLookup="true", pathGlobFilter="*.md")
    return d.select(_folder("docs/").alias("folder"), F.regexp_extract("file", r"/docs/(.*)\.md$", 1).alias("path"), F.col("text").alias("markdown"))


def artifact_files(spark: SparkSession, root: str) -> DataFrame:
    """folder, filename and content of the artifacts that a directory may have; other files are passed over."""
    a = _files(spark, f"{root}/*/artifacts/*")
    return a.select(_folder("artifacts/").alias("folder"), F.regexp_extract("file", "([^/]+)$", 1).alias("filename"), F.col("text").alias("content")).filter(F.col("filename").isin(*artifacts.NAMES))


def toc_entries(spark: SparkSession, root: str) -> DataFrame:
    """folder, pos, depth, path, title and source_url of the entries of every toc.json, of any depth, parents first; a broken one gives a row with a problem alone."""
    ship(spark)
    files = _files(spark, f"{root}/*/toc.json").select(_folder("toc\\.json$").alias("folder"), "text")

    def entries(text: str) -> list[tuple]:
        out, todo = [], [(e, 0) for e in reversed(json.loads(text)["sections"])]
        while todo:
            e, depth = todo.pop()
            out.append((len(out), depth, e["path"], e["title"], e.get("source_url"), None))
            todo += [(c, depth + 1) for c in reversed(e.get("children") or [])]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            rows = []
            for folder, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [(folder, *e) for e in entries(text)]
                except (ValueError, KeyError, TypeError, AttributeError) as e:
                    rows.append((folder, None, None, None, None, None, f"is no toc: {type(e).__name__}"))
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["folder", "pos", "depth", "path", "title", "source_url", "problem"])

    return files.mapInArrow(run, "folder string, pos int, depth int, path string, title string, source_url string, problem string")


def missing_files(spark: SparkSession, root: str) -> DataFrame:
    """folder and path of the entries that name a page without a file."""
    e = toc_entries(spark, root).filter("source_url is not null").select("folder", "path").distinct()
    return e.join(docs(spark, root).select("folder", "path"), ["folder", "path"], "left_anti")
