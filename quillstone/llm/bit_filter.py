"""A bounded filter that spares a shuffle rows which cannot meet anything there.

One bit for each value of the last ``bits`` bits of a hash. Rows whose bit is not set have no partner; rows that pass
may have none either and are left to the join. Its size is fixed by ``bits``, whatever it is built from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.names import fresh


class BitFilter:
    def __init__(self, hashes: DataFrame, column: str, bits: int = 24):
        """Collects at most ``2 ** bits / 64`` numbers of eight bytes."""
        bit = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
        words = (
            hashes.select(F.shiftrightunsigned(bit, 6).alias("word"), F.expr("1L").alias("one"), (bit % 64).cast("int").alias("place"))
            .groupBy("word")
            .agg(F.bit_or(F.expr("shiftleft(one, place)")).alias("set"))
            .toPandas()
        )
        table = np.zeros(1 << (bits - 6), np.uint64)
        table[words["word"].to_numpy(np.int64)] = words["set"].to_numpy(np.int64).view(np.uint64)
        self.mask = np.uint64((1 << bits) - 1)
        self.table = hashes.sparkSession.sparkContext.broadcast(table)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes.view(np.uint64) & self.mask
        return (self.table.value[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def parted(rows: DataFrame, key: str, partners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may have the key of a partner, rows that have none), without a shuffle.

    ``partners`` has the column ``key``. The rows with their whole texts are read twice instead of shuffled once.
    """
    (hash_of,) = fresh(rows, "h")
    likely = BitFilter(partners.select(F.xxhash64(key).alias(hash_of)), hash_of)
    hashed = rows.withColumn(hash_of, F.xxhash64(key))
    shape = T.StructType([f for f in hashed.schema.fields if f.name != hash_of])

    def filtered(passing: bool):
        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = likely.passes(batch.column(hash_of).to_numpy(zero_copy_only=False)) == passing
                at = pa.array(np.flatnonzero(own))
                yield pa.RecordBatch.from_arrays([batch.column(f.name).take(at) for f in shape.fields], names=shape.names)

        return chosen

    return hashed.mapInArrow(filtered(True), shape), hashed.mapInArrow(filtered(False), shape)
