"""Snapshots: what is new, changed, unchanged or removed, and keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def page_diff(existing: DataFrame, fetched: DataFrame, force: bool = False) -> DataFrame:
    """kb_id, path and status of every path of two snapshots (kb_id, path, content_hash).

    One shuffle on the key. Repeated rows of a fetched path stay repeated; repeated existing rows count
    once, with the least hash. With ``force`` a known path is always changed.
    """
    old = existing.groupBy("kb_id", "path").agg(F.min("content_hash").alias("old_hash"), F.lit(True).alias("known"))
    new = fetched.select("kb_id", "path", F.col("content_hash").alias("new_hash"), F.lit(True).alias("got"))
    same = F.lit(False) if force else F.coalesce(F.col("old_hash") == F.col("new_hash"), F.lit(False))
    status = F.when(F.col("got").isNull(), "removed").when(F.col("known").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return old.join(new, ["kb_id", "path"], "full_outer").select("kb_id", "path", status.alias("status"))


def summary(diff: DataFrame, prune: bool = True) -> DataFrame:
    """One row: added, changed, unchanged and removed; removed counts only where they are pruned."""
    n = lambda s: F.count_if(F.col("status") == s)
    return diff.agg(n("new").alias("added"), n("changed").alias("changed"), n("unchanged").alias("unchanged"), (n("removed") if prune else F.lit(0).cast("long")).alias("removed"))


def needs_convert(diff: DataFrame) -> DataFrame:
    """Keys of new and changed pages, once each."""
    return diff.filter(F.col("status").isin("new", "changed")).select("kb_id", "path").distinct()


def removed(existing: DataFrame, fetched: DataFrame) -> DataFrame:
    """Existing rows whose path was not fetched."""
    return existing.join(fetched.select("kb_id", "path").distinct(), ["kb_id", "path"], "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Incoming rows replace existing ones of equal keys, but columns ``keep`` stay those of the existing row.

    Of several incoming rows of one key, the one of the greatest values in column order counts. One
    shuffle on the keys; both sides have the same columns.
    """
    cols = existing.columns
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.select(*cols).withColumn("__new", F.lit(1)))
    rest = [c for c in cols if c not in keys]
    w = Window.partitionBy(*keys).orderBy(F.desc("__new"), *[F.desc(c) for c in rest])
    old = Window.partitionBy(*keys)
    both = both.withColumns({f"__{c}": F.max(F.when(F.col("__new") == 0, F.col(c))).over(old) for c in keep}).withColumn("__k", F.row_number().over(w)).filter("__k = 1")
    return both.select(*[F.coalesce(f"__{c}", c).alias(c) if c in keep else F.col(c) for c in cols])


def prune(existing: DataFrame, fetched: DataFrame) -> DataFrame:
    """Existing rows whose path was fetched again."""
    return existing.join(fetched.select("kb_id", "path").distinct(), ["kb_id", "path"], "left_semi")


def last_of(readers: DataFrame, key: str, priority: str, order: str) -> DataFrame:
    """One row for each key: the highest priority, and of those the last."""
    w = Window.partitionBy(key).orderBy(F.desc(priority), F.desc(order))
    return readers.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
