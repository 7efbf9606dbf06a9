"""Page ids that stay: keys of 63 bits from (kb_id, path), told apart where two of a knowledge base meet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.checkpoints import cut
from docloom.sources.config import StorageError

#: Rounds of keys that are tried; one is enough but for collisions of whole keys.
ROUNDS = 32


def page_key(kb_id: Column, path: Column, round: int = 0) -> Column:
    """A key of a page: the same for the same knowledge base and path in every run. Null parts count as empty."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(kb_id, F.lit("")), F.lit("\n"), F.coalesce(path, F.lit("")), F.lit(round)), 1)


def identify(pages: DataFrame, known: DataFrame, key: Callable[[Column, Column, int], Column] = page_key) -> DataFrame:
    """kb_id, path and page_id of all paths of ``pages`` (kb_id, path), each once.

    Paths that ``known`` (kb_id, path, page_id) holds keep their id. Others get the first of their keys that no other
    page of the knowledge base has; of two new paths with one key the lesser path gets it. Ids are unique in a knowledge
    base, so tables meet on (kb_id, page_id). One shuffle on (kb_id, path) and one on (kb_id, key) a round; rounds after the
    first have colliding rows only.
    """
    paths = pages.select("kb_id", "path").distinct()
    held = known.groupBy("kb_id", "path").agg(F.min("page_id").alias("page_id"))
    have = cut(paths.join(held, ["kb_id", "path"], "left"), "ids")
    out, todo = [have.filter(F.col("page_id").isNotNull())], have.filter(F.col("page_id").isNull()).select("kb_id", "path")
    taken = known.select("kb_id", "page_id")
    for k in range(ROUNDS):
        w = Window.partitionBy("kb_id", "page_id").orderBy("path")
        tried = todo.withColumn("page_id", key(F.col("kb_id"), F.col("path"), k)).withColumn("nth", F.row_number().over(w))
        tried = cut(tried.join(taken.distinct().withColumn("used", F.lit(True)), ["kb_id", "page_id"], "left"), "ids")
        got = tried.filter("nth = 1 and used is null").select("kb_id", "path", "page_id")
        out.append(got)
        todo = tried.filter("nth > 1 or used").select("kb_id", "path")
        if todo.isEmpty():
            result = out[0]
            for x in out[1:]:
                result = result.unionByName(x)
            return result
        taken = taken.unionByName(got.select("kb_id", "page_id"))
    raise StorageError(f"pages of one knowledge base have equal keys in {ROUNDS} rounds")
