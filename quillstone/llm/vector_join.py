"""Embedding near-duplicates by an exact metric range join.

Vectors are scaled to length 1, where cosine >= ``cosine`` is a distance of at most r = sqrt(2 - 2 cosine). Pivots,
picked by hash, partition the vectors: each is at home with its nearest pivot. A vector x with pivot p visits the cell
of pivot q if a vector of that cell could be within r of it; by the triangle inequality it cannot be if
d(x, q) > r + the radius of that cell, nor if d(x, q)^2 - d(x, p)^2 > 2 r d(p, q). Every ordered pair within r then
meets once, in the cell where its second vector is at home. Cells join independently, as blocks of residents by blocks
of visitors, so a dense cell is many bounded tasks; a block sends on link counts and a star per linked group.

Equal vectors are joined once and counted with their number. There are ``ceil(vectors / block)`` pivots, at most
``max_pivots``, which are broadcast.

Defined results: vectors that are null, zero or hold a null or non-finite component link with nothing, nor do vectors
of different lengths; rows that share an id are one node of a component; a row without id links with nothing and keeps
a null component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.components import components, stars
from quillstone.sources.storage import stored

EDGE = 1e-9  #: added to every bound of a distance; the cosine itself is exact
ROWS_AT_ONCE = 512


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = vectors.astype(float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def packed_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, dims, v): the components as bytes; v is null where a vector links with nothing."""
    kind = "<f4" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, dims = [], []
            for x in batch.column("v").to_pylist():
                row = None if x is None or not x or None in x else np.array(x, kind)
                fits = row is not None and bool(np.isfinite(row).all()) and bool(row.any())
                out.append(row.tobytes() if fits else None)
                dims.append(len(x) if fits else 0)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["key", "dims", "v"])

    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    return rows.mapInArrow(pack, f"key {rows.schema['key'].dataType.simpleString()}, dims int, v binary"), kind


class Pivots(NamedTuple):
    dims: int
    at: np.ndarray  #: pivot by component
    apart: np.ndarray  #: distances of the pivots


def _pivots(classes: DataFrame, kind: str, block: int, max_pivots: int) -> Pivots | None:
    counts = classes.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    if counts is None:
        return None
    many = min(max_pivots, -(-counts["n"] // block))
    picked = classes.where(F.col("dims") == counts["dims"]).orderBy(F.xxhash64("v"), "v").limit(many).select("v").toPandas()
    at = unit(np.stack([np.frombuffer(v, kind) for v in picked["v"]]))
    return Pivots(counts["dims"], at, np.sqrt(np.maximum(2 - 2 * at @ at.T, 0)))


def linked_blocks(x: np.ndarray, x_id: np.ndarray, y: np.ndarray, y_id: np.ndarray, y_count: np.ndarray, cosine: float):
    """Per row of x the number of rows of y it links with, and stars that connect the linked ids."""
    counts, a, b = np.zeros(len(x), np.int64), [], []
    for i in range(0, len(x), ROWS_AT_ONCE):
        near = x[i : i + ROWS_AT_ONCE] @ y.T >= cosine
        near &= x_id[i : i + ROWS_AT_ONCE, None] != y_id
        if near.any():
            p, q = np.nonzero(near)
            counts[i : i + ROWS_AT_ONCE] = np.bincount(p, weights=y_count[q], minlength=len(near)).astype(np.int64)
            s, t = stars(x_id[i + p], y_id[q])
            a.append(s)
            b.append(t)
    return counts, *(stars(np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2)


def link_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, block: int = 8192, max_pivots: int = 256
) -> DataFrame:
    """key, n_links, component_id and kept of every vector; ``block`` bounds the rows that are compared at once."""
    spark = vectors.sparkSession
    packed, kind = packed_vectors(vectors, key, vector)
    packed = stored(packed.withColumn("key", F.col("key").cast("long")), "vectors")
    usable = packed.where("v IS NOT NULL AND key IS NOT NULL")
    classes = stored(usable.groupBy("dims", "v").agg(F.min("key").alias("id"), F.count("*").alias("n")), "vector-classes")
    found = _pivots(classes, kind, block, max_pivots)
    if found is None:
        return packed.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    pivots = spark.sparkContext.broadcast(found)
    reach = float(np.sqrt(2 - 2 * cosine)) + EDGE

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        for batch in batches:
            dims = batch.column("dims").to_numpy(zero_copy_only=False)
            cell, away = -dims.astype(np.int64), np.zeros(len(dims))
            own = np.flatnonzero(dims == p.dims)
            if len(own):
                x = unit(np.stack([np.frombuffer(batch.column("v")[int(i)].as_py(), kind) for i in own]))
                cos = x @ p.at.T
                cell[own] = cos.argmax(1)
                away[own] = np.sqrt(np.maximum(2 - 2 * cos.max(1), 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    shape = "dims int, v binary, id long, n long"
    homes = stored(classes.mapInArrow(home, shape + ", cell long, away double"), "vector-homes")
    sizes = {r["cell"]: (r["n"], r["far"]) for r in homes.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("far")).collect()}
    sizes = spark.sparkContext.broadcast(sizes)  # a row for each pivot and vector length

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, known = pivots.value, sizes.value
        far = np.array([known[j][1] if j in known else -np.inf for j in range(len(p.at))])
        for batch in batches:
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            row = [np.arange(len(cell))]
            to = [cell]
            own = np.flatnonzero(cell >= 0)
            if len(own):
                x = unit(np.stack([np.frombuffer(batch.column("v")[int(i)].as_py(), kind) for i in own]))
                square = np.maximum(2 - 2 * x @ p.at.T, 0)
                at = cell[own]
                nearest = square[np.arange(len(own)), at][:, None]
                goes = (square - nearest <= 2 * reach * (p.apart[at] + EDGE)) & (np.sqrt(square) <= reach + far + EDGE)
                goes[np.arange(len(own)), at] = False
                i, j = np.nonzero(goes)
                row.append(own[i])
                to.append(j)
            row = np.concatenate(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("v").take(pa.array(row)), batch.column("id").take(pa.array(row)), pa.array(np.concatenate(to))], names=["v", "id", "cell"]
            )

    dealt = stored(homes.mapInArrow(visits, "v binary, id long, cell long"), "vector-visits")
    visitors = dealt.groupBy("cell").agg(F.count("*").alias("visitors"))
    grid = homes.groupBy("cell").agg(F.count("*").alias("residents")).join(visitors, "cell").select(
        "cell", F.ceil(F.col("residents") / block).cast("int").alias("rows"), F.ceil(F.col("visitors") / block).cast("int").alias("columns")
    )  # a row for each cell
    at = F.xxhash64("id", F.lit(9))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    residents = homes.join(F.broadcast(grid), "cell").select("v", "id", "n", "cell", F.pmod(at, "rows").cast("int").alias("i"), all_of("columns").alias("j"))
    comers = dealt.join(F.broadcast(grid), "cell").select("v", "id", "cell", all_of("rows").alias("i"), F.pmod(at, "columns").cast("int").alias("j"))

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"id": [], "n": [], "to": []}
        if left.num_rows and right.num_rows:
            y, x = (unit(np.stack([np.frombuffer(v.as_py(), kind) for v in t.column("v")])) for t in (left, right))
            y_id, x_id = (t.column("id").to_numpy() for t in (left, right))
            counts, a, b = linked_blocks(x, x_id, y, y_id, left.column("n").to_numpy().astype(float), cosine)
            some = np.flatnonzero(counts)
            out = {"id": np.concatenate([x_id[some], a]), "n": np.concatenate([counts[some], np.zeros(len(a), np.int64)]), "to": np.concatenate([x_id[some], b])}
        return pa.table(out, schema=pa.schema([("id", pa.int64()), ("n", pa.int64()), ("to", pa.int64())]))

    by = ["cell", "i", "j"]
    met = stored(residents.groupBy(*by).cogroup(comers.groupBy(*by)).applyInArrow(joined, "id long, n long, to long"), "vector-links")
    linked = components(met.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")))
    counts = met.groupBy("id").agg(F.sum("n").alias("others"))
    named = classes.join(counts, "id", "left").join(linked.withColumnRenamed("node", "id"), "id", "left").select(
        "v", "dims", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    out = packed.join(named, ["v", "dims"], "left").select(
        F.col("key").alias(key),
        F.when(F.col("key").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
