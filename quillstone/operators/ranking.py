"""Positions inside groups of any size, and ordered text put together from bounded pieces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.sources.storage import pinned


def rank_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos") -> DataFrame:
    """1-based position of every row within its group, for groups that may hold most of the rows.

    The rows are range-partitioned by (keys, order), so a big group is spread over many partitions.
    Each row is numbered inside its piece of the group and moved by the size of the pieces before it.
    The piece numbers are written once, because recomputing a sampled range could cut elsewhere.
    """
    ranged = [F.col(c) for c in (*keys, *order)]
    pieces = pinned(df.repartitionByRange(*ranged).withColumn("_piece", F.spark_partition_id()))
    sizes = pieces.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*keys, "_piece").orderBy(*order)
    numbered = pieces.withColumn("_rn", F.row_number().over(inside))
    return numbered.join(starts, [*keys, "_piece"]).withColumn(
        name, (F.col("_start") + F.col("_rn")).cast("long")
    ).drop("_piece", "_rn", "_start", "_n")


def joined_in_order(order: Column | str, text: Column | str, sep: str) -> Column:
    """Aggregate: texts of a bounded group in order, joined with ``sep``."""
    order = F.col(order) if isinstance(order, str) else order
    text = F.col(text) if isinstance(text, str) else text
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), sep)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows of each group. Spark cuts to ``n`` per partition before it shuffles."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
