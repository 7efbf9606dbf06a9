"""Ordered texts of groups joined to files in parts: prefix sums of lengths give every text its place, so no group meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.checkpoints import cut

#: Bytes of a part, as far as whole texts allow: a part ends with the text that begins in it.
PART_BYTES = 8 << 20


def prefix_sums(df: DataFrame, group: str, order: list[str], size: Column) -> DataFrame:
    """All columns, and ``before``: the sum of ``size`` over the rows of the same group that come earlier in the order.

    Rows are dealt by ranges of (group, order) and written; running sums inside a range are local, and those of whole ranges are summed over
    one row for each range and group. Rows that agree in group and order count in an order that the written table fixes.
    """
    ranged = df.withColumn("__size", size.cast("long")).repartitionByRange(F.col(group), *[F.col(c) for c in order]).withColumn("__range", F.spark_partition_id()).sortWithinPartitions(group, *order)
    rows = cut(ranged.withColumn("__nth", F.monotonically_increasing_id()), "concat-ranges")
    inside = Window.partitionBy("__range", group).orderBy(*order, "__nth").rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy("__range", group).agg(F.sum("__size").alias("__all"))
    earlier = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("__range", group, F.coalesce(F.sum("__all").over(earlier), F.lit(0)).alias("__earlier"))
    local = rows.withColumn("__local", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    met = local.alias("l").join(each.alias("e"), (F.col("l.__range") == F.col("e.__range")) & F.col(f"l.{group}").eqNullSafe(F.col(f"e.{group}")))
    return met.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("l.__local") + F.col("e.__earlier")).alias("before"))


def in_parts(texts: DataFrame, group: str, order: list[str], text: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """group, part (from 0), at (byte at which it begins in the whole) and content: joined in the order of parts, the contents are the whole text of the group.

    Null texts count as empty. A part has at most ``part_bytes`` and one text more.
    """
    sized = texts.select(group, *order, F.coalesce(text, F.lit("")).alias("__text"))
    placed = prefix_sums(sized, group, order, F.octet_length("__text")).withColumn("__cell", F.floor(F.col("before") / part_bytes))
    row = F.struct("before", *order, "__text")
    parts = placed.groupBy(group, "__cell").agg(F.min("before").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["__text"]), "").alias("content"))
    nth = F.row_number().over(Window.partitionBy(group).orderBy("__cell")) - 1  # a row a part
    return parts.select(group, nth.alias("part"), "at", "content")


def whole(parts: DataFrame, group: str) -> DataFrame:
    """group and content of texts in parts, each in one row."""
    return parts.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "content"))), lambda r: r["content"]), "").alias("content"))
