"""SimHash near-duplicates by a popcount embedding of the fingerprints.

A fingerprint is cut into 32 segments of two bits; the bit counts of the segments are a point of a grid, and the
Manhattan distance of two points is never above the Hamming distance of the fingerprints. For links within ``distance``
bits the segments are dealt to ``distance // 2 + 1`` blocks, so two linked fingerprints are at Manhattan distance 0 or
1 in at least one block: they share a grid cell there, or lie in cells one step apart. Every distinct fingerprint goes
to its own cell of each block and, as a visitor, to the cells one step up; cells join independently, and each pair that
meets is verified by its exact Hamming distance. A cell sends on a star per linked group, not its pairs.

Only distinct fingerprints are joined, so copies cost nothing here. A task holds the residents of one cell.

Defined results: texts without words, null texts among them, have fingerprint zero and link like any other; equal
texts have equal fingerprints; a null key never is the smallest of a component (null only if there is no other); an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.arrow_text import bytes_list, slices
from quillstone.llm.bit_filter import parted
from quillstone.llm.components import components, stars
from quillstone.sources.storage import stored

SEGMENTS = 32  #: of two bits each
PAIRS = 1 << 21  #: verified at once
BLOCK = 256  #: rows of a matrix of pairs


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """Bits that are set in over half the hashes of the ``width``-word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[: len(last)].tolist(), last.tolist(), strict=True)], "<u8")
    return majority(hashes)


def fingerprints(docs: DataFrame, key: str, text: str, width: int = 4) -> DataFrame:
    """(key, fp): the fingerprint of each whole text as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            fps = np.array([fingerprint(t, width) for t in bytes_list(part.column("t"))], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(fps.view(np.int64))], names=["key", "fp"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    return rows.mapInArrow(hashed, f"key {rows.schema['key'].dataType.simpleString()}, fp long")


def grid_rows(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, fp, visit) of each fingerprint: its own cells and those one step up."""
    bits = fps.astype(np.uint64)
    counts = np.stack([((bits >> np.uint64(2 * s)) & np.uint64(1)) + ((bits >> np.uint64(2 * s + 1)) & np.uint64(1)) for s in range(SEGMENTS)], 1)
    counts = counts.astype(np.int64)
    cells, who, visit = [], [], []
    everyone = np.arange(len(fps))
    blocks = np.array_split(np.arange(SEGMENTS), distance // 2 + 1)
    for b, block in enumerate(blocks):
        steps = 3 ** np.arange(len(block), dtype=np.int64)
        own = counts[:, block] @ steps
        cells.append(own * len(blocks) + b)
        who.append(everyone)
        visit.append(np.zeros(len(fps), np.int8))
        row, axis = np.nonzero(counts[:, block] < 2)
        cells.append((own[row] + steps[axis]) * len(blocks) + b)
        who.append(row)
        visit.append(np.ones(len(row), np.int8))
    return np.concatenate(cells), fps[np.concatenate(who)], np.concatenate(visit)


def linked_in_runs(cell: np.ndarray, fp: np.ndarray, visit: np.ndarray, fresh: int, distance: int):
    """Links among rows sorted by (cell, visit); rows before ``fresh`` have met one another before.

    Each row meets the residents of its cell that stand before it; pairs are verified a bounded number at a time.
    """
    n = len(cell)
    begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    run = np.cumsum(np.concatenate([[False], cell[1:] != cell[:-1]]))
    residents = np.add.reduceat(visit == 0, begins)
    start = begins[run]
    meets = np.minimum(np.arange(n) - start, residents[run])
    meets[:fresh] = 0
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for begin, homes, size in zip(begins, residents, np.diff(np.append(begins, n)), strict=True):
        if homes >= BLOCK:  # a large cell is compared as blocks of a matrix
            for i in range(max(begin, fresh), begin + size, BLOCK):
                rows = fp[i : min(i + BLOCK, begin + size)]
                for j in range(begin, min(begin + homes, i + BLOCK), 16 * BLOCK):
                    others = fp[j : min(j + 16 * BLOCK, begin + homes)]
                    x, y = np.nonzero(np.bitwise_count(rows[:, None] ^ others) <= distance)
                    a, b = stars(rows[x].view(np.int64), others[y].view(np.int64))
                    out_a.append(a)
                    out_b.append(b)
            meets[begin : begin + size] = 0
    reach = np.cumsum(meets)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + PAIRS, side="right")))
        k = meets[at:stop]
        x = np.repeat(np.arange(at, stop), k)
        y = np.repeat(start[at:stop] - (np.cumsum(k) - k), k) + np.arange(len(x))
        near = np.bitwise_count(fp[x] ^ fp[y]) <= distance
        a, b = stars(fp[x[near]].view(np.int64), fp[y[near]].view(np.int64))
        out_a.append(a)
        out_b.append(b)
        at = stop
    return np.concatenate(out_a), np.concatenate(out_b)


def near_links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): links that connect the fingerprints (fp) within ``distance`` bits; components are whole."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, fp, visit = grid_rows(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), distance)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp.view(np.int64)), pa.array(visit)], names=["cell", "fp", "visit"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_cell, kept_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, fp, visit = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "fp", "visit"))
            same = kept_cell == cell[0]
            cell = np.concatenate([kept_cell[same], cell])
            fp = np.concatenate([kept_fp[same], fp.view(np.uint64)])
            visit = np.concatenate([np.zeros(int(same.sum()), np.int8), visit])
            a, b = linked_in_runs(cell, fp, visit, int(same.sum()), distance)
            last = (cell == cell[-1]) & (visit == 0)
            kept_cell, kept_fp = cell[last], fp[last]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    rows = distinct.select("fp").mapInArrow(placed, "cell long, fp long, visit byte")
    return rows.repartition("cell").sortWithinPartitions("cell", "visit").mapInArrow(joined, "a long, b long")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 4, width: int = 4) -> DataFrame:
    """The documents but for those whose component has a smaller key; of rows that share a key one stays.

    Rows without a key are not judged and stay.
    """
    judged = stored(near_duplicates(docs.where(F.col(key).isNotNull()), key, text, distance, width).select(key, "component_id"), "simhash-judged")
    dropped = judged.where(F.col(key) != F.col("component_id")).select(key)
    again = judged.where(F.col(key) == F.col("component_id")).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    marked = stored(dropped.withColumn("_again", F.lit(False)).unionByName(again.withColumn("_again", F.lit(True))).distinct(), "simhash-marked")
    maybe, rest = parted(docs, key, marked)
    judged = maybe.join(marked, key, "left").where(F.coalesce("_again", F.lit(True)))
    once = judged.where("_again IS NULL")
    return rest.select(docs.columns).unionByName(once.select(docs.columns)).unionByName(
        judged.where("_again").dropDuplicates([key]).select(docs.columns)
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 4, width: int = 4) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id (smallest key within reach) of every document."""
    marked = stored(fingerprints(docs, key, text, width), "simhash")
    distinct = marked.groupBy("fp").agg(F.min("key").alias("least"))
    linked = components(near_links(distinct, distance))
    named = stored(
        distinct.join(linked, F.col("fp") == F.col("node"), "left").select(
            "fp", "least", F.coalesce("component", "fp").alias("component")
        ),
        "simhash-classes",
    )
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = named.join(smallest, "component").select("fp", "component_id")
    return marked.join(classes, "fp").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
