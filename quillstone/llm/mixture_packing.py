"""Mixture-controlled packing: deficit round-robin over one queue of documents for each source.

All tokens are cut into windows of ``capacity``. For each window every queue earns its share of the capacity; whole
tokens are taken at once, and the places left go to the queues with the largest fractions still owed. What a queue is
owed or has had too much (its deficit, always less than one token) carries over to the next window. After m tokens the
deficits depend on m alone, so the round-robin can be resumed at any window: each task starts with the deficits of its
first window and goes on from there, and no task needs the windows before it.

Shares are those of the sources in all tokens, or given weights. With weights a queue may run dry; from then on the
others share its part. Every window, up to the places where a queue runs dry, holds each queue's share to within one
token. Sources that would get under ``least`` tokens of a window stand in one queue together, so there are at most
capacity / least + 1 queues, whatever the number of sources.

Nothing is padded: all sequences but those at the end are full, and the last tokens, fewer than a window, go into
sequences of a power of two (their number in binary).

Spark's part: texts become ids once, written with their running place inside (task, source); a table with a row for
each task and source gives where these blocks begin in their queue; joined to it, a row computes its pieces by itself.
Ids are never shuffled while that table is small enough to broadcast, and no source is ever in one task.

Defined results: a null text is empty, an empty text is the end token alone; a null source is a source; repeated rows
and ids are documents of their own; an empty table gives an empty result. Order inside a queue is that of the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.arrow_text import slices
from quillstone.llm.byte_tokens import byte_tokens
from quillstone.llm.prefix_sums import running_total
from quillstone.sources.storage import stored

TOKENS = "doc long, source string, part int, slot int, start long, n long, ids binary"
PIECES = "doc long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
RUN = 4096  #: windows that are computed at once


class Phase(NamedTuple):
    """Tokens ``first`` to ``first + size`` of the mixture: what the queues have given before, and give in it."""

    first: int
    size: int
    before: list[int]
    given: list[int]


def phases(totals: list[int], weights: list[float] | None = None) -> list[Phase]:
    """The stretches between the places where a queue runs dry; one stretch if shares are those of the totals."""
    if weights is None:
        return [Phase(0, sum(totals), [0] * len(totals), list(totals))] if sum(totals) else []
    out, done = [], [0] * len(totals)
    while any(t > d for t, d in zip(totals, done, strict=True)):
        turns = min((t - d) / w for t, d, w in zip(totals, done, weights, strict=True) if t > d)
        given = [min(t - d, int(w * turns)) if (t - d) / w > turns else t - d for t, d, w in zip(totals, done, weights, strict=True)]
        out.append(Phase(sum(done), sum(given), list(done), given))
        done = [d + g for d, g in zip(done, given, strict=True)]
    return out


class RoundRobin:
    """How many tokens each queue has given at the start of any window."""

    def __init__(self, parts: list[Phase], capacity: int):
        self.parts, self.capacity = parts, capacity
        self.total = parts[-1].first + parts[-1].size if parts else 0
        self.windows = -(-self.total // capacity)

    def at_start(self, first: int, stop: int) -> np.ndarray:
        """Rows of tokens given by each queue before the windows ``first`` to ``stop``; window ``windows`` is the end."""
        rows = []
        for part in self.parts:
            last = part is self.parts[-1]
            low = max(first, -(-part.first // self.capacity))
            high = min(stop, self.windows if last else -(-(part.first + part.size) // self.capacity) - 1)
            while low <= high:
                upto = min(high, low + RUN - 1)
                rows.append(self.resumed(part, low, upto - low + 1))
                low = upto + 1
        return np.concatenate(rows)

    def resumed(self, part: Phase, window: int, n: int) -> np.ndarray:
        """The round-robin from ``window`` on, for n windows: whole tokens earned, then the largest fractions."""
        at = window * self.capacity - part.first
        whole, owed = np.array([divmod(g * min(at, part.size), part.size) for g in part.given], np.int64).T
        step, more = np.array([divmod(g * self.capacity, part.size) for g in part.given], np.int64).T
        turn = np.arange(n)[:, None]
        owed = owed + turn * more
        out = whole + turn * step + owed // part.size
        owed %= part.size
        places = np.minimum(at + turn[:, 0] * self.capacity, part.size)
        if at + (n - 1) * self.capacity > part.size:  # the last window is not full
            out[-1], owed[-1] = part.given, 0
        left = places - out.sum(axis=1)
        rank = np.empty_like(owed)
        np.put_along_axis(rank, np.argsort(-owed, axis=1, kind="stable"), np.arange(len(part.given))[None, :], axis=1)
        return out + (rank < left[:, None]) + np.array(part.before, np.int64)

    def about(self, queue: int, place: int) -> int:
        """A window at, or up to two before, the one that holds this token of the queue."""
        for part in self.parts:
            if part.given[queue] and place < part.before[queue] + part.given[queue]:
                return max(0, (part.first + (place - part.before[queue]) * part.size // part.given[queue]) // self.capacity - 2)
        return max(0, self.windows - 1)


def binary_cuts(rest: int) -> list[int]:
    """Where sequences of powers of two, large ones first, end among ``rest`` tokens."""
    out, at = [], 0
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            at += 1 << bit
            out.append(at)
    return out


def tokenized(docs: DataFrame, tokenizer: str, key: str, text: str, source: str | None, end: int) -> DataFrame:
    """Ids of every document and its place among those of its source in the same task."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_tokens(tokenizer)
        tail = end.to_bytes(tokens.width, "little")
        part = TaskContext.get().partitionId()
        slots: dict[str | None, int] = {}
        given: list[int] = []
        for some in slices(batches, "t"):
            slot, start, n, ids = [], [], [], []
            for body, src in zip(some.column("t").to_pylist(), some.column("source").to_pylist(), strict=True):
                raw = tokens.encode(body or "") + tail
                i = slots.setdefault(src, len(slots))
                if i == len(given):
                    given.append(0)
                slot.append(i)
                start.append(given[i])
                n.append(len(raw) // tokens.width)
                ids.append(raw)
                given[i] += n[-1]
            yield pa.RecordBatch.from_arrays(
                [
                    some.column("doc"), some.column("source"), pa.array([part] * len(ids), pa.int32()), pa.array(slot, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
                ],
                names=["doc", "source", "part", "slot", "start", "n", "ids"],
            )

    origin = F.lit(None) if source is None else F.col(source)
    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("t"), origin.cast("string").alias("source")).mapInArrow(encode, TOKENS)


def queues(blocks: DataFrame, capacity: int, least: int, targets: Mapping[str | None, float] | None) -> tuple[Column, list[int], list[float] | None]:
    """Number of each source's queue, the tokens of the queues and their weights.

    Only sources with at least ``least`` tokens of a window come to the driver, at most capacity / least of them.
    """
    total = blocks.agg(F.sum("n")).first()[0] or 0
    sums = blocks.groupBy("source").agg(F.sum("n").alias("n"))
    big = sums.where(F.col("n").cast("decimal(38,0)") * capacity >= F.lit(least * total).cast("decimal(38,0)"))
    own = sorted(((r[0], r[1]) for r in big.collect()), key=lambda r: (r[0] is None, r[0] or ""))
    if targets is not None:  # the named sources have queues, all others share one
        named = sorted(targets, key=lambda s: (s is None, s or ""))
        asked = sums.where(F.col("source").isin([s for s in named if s is not None]) | (F.col("source").isNull() & F.lit(None in targets)))
        sizes = {r[0]: r[1] for r in asked.collect()}
        own = [(s, sizes[s]) for s in named if s in sizes]
    sizes = [n for _, n in own]
    rest = total - sum(sizes)
    pool = len(own)
    if rest and own and targets is None and rest * capacity < least * total:
        pool = sizes.index(min(sizes))  # too few for a queue: they join the smallest
        sizes[pool] += rest
    elif rest:
        sizes.append(rest)
    weights = None
    if targets is not None:
        weights = [float(targets[s]) for s, _ in own]
        if rest:
            weights.append(sum(weights) * rest / max(1, total - rest) if weights else 1.0)
        if any(w <= 0 or w * capacity < 2 * sum(weights) for w in weights):
            raise ValueError("a target weight must give its source two tokens of a window at least")
    number = F.lit(pool)
    for i, (s, _) in enumerate(own):
        number = F.when(F.col("source").eqNullSafe(F.lit(s)), i).otherwise(number)
    return number, sizes, weights


def pieces_of(robin: RoundRobin, queue: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, place, length, sequence, offset) of the pieces of the rows with tokens low..high of the queue, in order."""
    first = robin.about(queue, int(low[0]))
    stop = min(robin.windows, robin.about(queue, int(high[-1]) - 1) + 5)
    given = robin.at_start(first, stop)
    own = given[:, queue]
    ahead = np.diff(given, axis=0)[:, :queue].sum(axis=1)
    head = np.searchsorted(own, low, side="right") - 1
    tail = np.searchsorted(own, high - 1, side="right") - 1
    n = tail - head + 1
    row = np.repeat(np.arange(len(low)), n)
    window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(head, n)
    place, upto = np.maximum(low[row], own[window]), np.minimum(high[row], own[window + 1])
    full = upto > place
    row, window, place, upto = row[full], window[full], place[full], upto[full]
    offset = ahead[window] + place - own[window]
    window = window + first
    rest = robin.total % robin.capacity
    if not rest or not len(window) or window.max() < robin.windows - 1:
        return row, place, upto - place, window, offset
    ends = [(robin.windows - 1) * robin.capacity + e for e in binary_cuts(rest)]
    out = []
    for r, p, u, w, o in zip(*(x.tolist() for x in (row, place, upto, window, offset)), strict=True):
        at = w * robin.capacity + o
        while p < u:
            if w < robin.windows - 1:
                length, seq, off = u - p, w, o
            else:
                i = next(i for i, e in enumerate(ends) if at < e)
                length, seq, off = min(u - p, ends[i] - at), w + i, at - (ends[i - 1] if i else w * robin.capacity)
            out.append((r, p, length, seq, off))
            p, at = p + length, at + length
    return tuple(np.array(out, np.int64).reshape(-1, 5).T)


def pack_mixture(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", source: str | None = "source", capacity: int = 2048,
    end: int = 1, targets: Mapping[str | None, float] | None = None, least: int = 16, with_ids: bool = False,
) -> DataFrame:
    """The pieces of all documents and their places: (key, source, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    ``targets`` weighs sources (others share one queue with their part of all tokens); without it the mixture of every
    sequence is that of the whole corpus. ``with_ids`` adds the tokens of each piece as an array.
    """
    if capacity & (capacity - 1) or not 1 <= least <= capacity // 2:
        raise ValueError("capacity must be a power of two, and least at most half of it")
    spark = docs.sparkSession
    tokens = stored(tokenized(docs, tokenizer, key, text, source, end), "mixture-tokens")
    blocks = tokens.groupBy("part", "slot").agg(F.first("source").alias("source"), F.sum("n").alias("n"))
    number, sizes, weights = queues(blocks, capacity, least, targets)
    schema = PIECES + (", ids array<int>" if with_ids else "")
    if not sizes:
        return spark.createDataFrame([], schema).withColumnRenamed("doc", key)
    robin = RoundRobin(phases(sizes, weights), capacity)
    bases = running_total(blocks.select("part", "slot", number.alias("queue"), "n"), ["queue"], ["part", "slot"], "n", "base")
    bases = stored(bases.select("part", "slot", "queue", "base"), "mixture-bases")  # Spark knows its size before it joins
    placed = tokens.join(bases, ["part", "slot"]).select(
        "doc", "source", "queue", (F.col("base") + F.col("start")).alias("low"), "n", "ids"
    )
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = byte_tokens(tokenizer).width
        for batch in slices(batches, "ids"):
            queue, low, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("queue", "low", "n"))
            parts = []
            for q in np.unique(queue):
                mine = np.flatnonzero(queue == q)
                mine = mine[np.argsort(low[mine], kind="stable")]
                gap = np.flatnonzero(low[mine][1:] != (low[mine] + n[mine])[:-1]) + 1  # rows of several blocks may meet here
                for run in np.split(mine, gap):
                    row, *rest = pieces_of(robin, int(q), low[run], low[run] + n[run])
                    parts.append((run[row], *rest))
            row, place, length, seq, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
            start = place - low[row]
            raw = [np.frombuffer(b, "<u2" if width == 2 else "<u4").astype("<u4") for b in batch.column("ids").to_pylist()]
            own = [raw[r][s : s + m] for r, s, m in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            columns = [
                batch.column("doc").take(pa.array(row)), batch.column("source").take(pa.array(row)), pa.array(start), pa.array(length),
                pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(n[row]), pa.array(seq), pa.array(offset),
            ]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return placed.mapInArrow(cut, schema).withColumnRenamed("doc", key)
