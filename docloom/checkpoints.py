"""Tables in the shared folder that end a lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        with contextlib.suppress(Exception):  # the JVM may have ended first
            remove(spark, path)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode with it unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="docloom-")
    sc.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder, deleted when the application ends (see ``scope`` for earlier); lazy results need it until then."""
    folder = f"{shared_dir(spark)}/docloom-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, folder))
    with contextlib.suppress(Exception):  # the JVM deletes it when it ends, if Python has not: spark.stop() may come first
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return f"{folder}/{tag}"


@contextlib.contextmanager
def scope():
    """Tables written inside are deleted at its end: for sessions that outlive their results, which must be consumed by then."""
    begun = len(_WRITTEN)
    try:
        yield
    finally:
        for spark, path in _WRITTEN[begun:]:
            with contextlib.suppress(Exception):
                remove(spark, path)
        del _WRITTEN[begun:]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, whatever file system it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends here."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
