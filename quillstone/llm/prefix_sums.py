"""Running totals inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.sources.storage import stored


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the group that stand before the row.

    Rows are range-partitioned by (keys, order), so a group that holds most of the rows is spread over many
    partitions; a row gets the sum inside its partition and the sum of the group's partitions before it. The
    cut rows are written once, since a recomputed range could be cut elsewhere. Null keys are a group.
    """
    cut = stored(
        df.repartitionByRange(*[F.col(c) for c in (*keys, *order)]).withColumn("_slab", F.spark_partition_id()), "running-total"
    )
    slabs = cut.groupBy(*keys, "_slab").agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_slab").rowsBetween(W.unboundedPreceding, -1)
    bases = slabs.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)],
        F.col("_slab").alias("_of"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"),
    )
    inside = W.partitionBy(*keys, "_slab").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = cut.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.col("_slab") == F.col("_of")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return summed.join(bases, same).select(*df.columns, (F.col("_base") + F.col("_inside")).cast("long").alias(name))
