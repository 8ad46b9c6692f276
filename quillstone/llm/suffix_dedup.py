"""Exact removal of repeated byte strings by a distributed suffix array.

A byte goes if a string of ``length`` bytes that covers it starts at another place too, in any document.

1. Sampling. Every window of ``length`` bytes names one of its inner positions, the one whose next ``length // 2`` bytes have
   the smallest hash (the rightmost of equals). These anchors depend on the bytes of the window alone, so equal windows name
   the same relative position. About one byte in a hundred is an anchor. An anchor whose bytes occur once cannot be in a
   repeated window; the others are the symbols (bytes of the anchor, distance to the next) of one string per text.
2. Difference cover. The suffixes of these strings are sorted by the algorithm of the cover {1, 2} modulo 3: the triples
   at positions 1 and 2 modulo 3 are sorted and named, the strings of names are sorted in the same way until the names
   are unique or span the length in question, and the suffixes at 0 modulo 3 are merged by their first symbol and the
   rank of the next suffix. Every sort is by ranges of unique keys or of distinct triples, so no text and no passage is
   a hot spot.
3. Adjacent prefixes. A suffix shares its longest prefix with a neighbour in the suffix array. The symbols they share
   settle the windows inside that prefix.
4. Exact check. What is left are the ends of repeated passages, which lie between anchors. All windows that name an
   anchor with unsettled windows are compared by a 64-bit hash of their bytes, anchor by anchor; an anchor that very many
   texts share is dealt to many tasks by that hash. Windows that occur twice in one text are settled there, and the text
   sends each of its different windows once.

In a text that repeats one word or phrase every period names the same anchor. Only the ends of such a run are symbols of
the strings; its windows go to the exact check, where they are one run of one text and few different hashes.

The units are bytes or, with ``words``, whole words: then ``length`` and all places count words, each told by a 64-bit hash
of its bytes, so white space does not matter. Scripts that put no spaces between words count each character as one.

Texts are worked on once each, however many documents hold them: a text that several documents hold repeats wholly.

Defined results: a null text is empty; a text shorter than ``length`` loses nothing; repeated rows are copies, so both
lose all their bytes; a null key is kept as it is; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.arrow_text import bytes_list, prefix_hashes, slices, span_hashes
from quillstone.llm.bit_filter import BitFilter
from quillstone.llm.names import fresh
from quillstone.sources.storage import discard, stored

CHUNK = 1 << 20  #: windows worked on at once
SPAN = 6  #: symbols compared between neighbours
MEMBERS = 5_000  #: texts with the same anchor that go to one task
LOW32 = np.uint64(0xFFFFFFFF)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes: between white space, and each character of a script without spaces."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = ~((data == 32) | ((data >= 9) & (data <= 13)))
    start = inner & np.append(True, ~inner[:-1])
    second = np.append(data[1:], 0)
    alone = np.flatnonzero(((data >= 0xE3) & (data <= 0xE9)) | ((data == 0xE0) & (second >= 0xB8)))  # kana, Han; Thai, Lao
    start[alone] = True
    after = alone[alone + 3 < len(data)] + 3
    start[after[inner[after]]] = True
    starts = np.flatnonzero(start)
    stop = np.append(~inner[1:] | start[1:], True) & inner
    return starts, np.flatnonzero(stop) + 1


def units(text: bytes, words: bool) -> np.ndarray:
    """The text as numbers: its bytes, or hashes of its words."""
    if not words:
        return np.frombuffer(text, np.uint8)
    starts, ends = word_bounds(text)
    return span_hashes(prefix_hashes(np.frombuffer(text, np.uint8)), starts, ends)


def anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int):
    """Anchors of the texts that stand one after another in ``data``: place, hash and first window of each, in order."""
    windows, size = len(data) - length + 1, length // 2
    if windows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(data) + 1, np.int8)
    long = sizes >= length
    edge[starts[long]] += 1
    edge[(starts + sizes - length + 1)[long]] -= 1
    valid = np.cumsum(edge, dtype=np.int8)[:windows] > 0
    places, grams, firsts = [], [], []
    for c in range(0, windows, CHUNK):
        part = data[c : c + CHUNK + length - 1]
        prefix = prefix_hashes(part)
        at = np.arange(len(part) - size + 1)
        h = span_hashes(prefix, at, at + size)
        key = (h & ~LOW32) | (LOW32 - at.astype(np.uint64))
        least = sliding_min(key, length - size + 1)
        own = np.flatnonzero(valid[c : c + len(least)])
        place = (LOW32 - (least[own] & LOW32)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(own) else own
        places.append(place[new] + c)
        grams.append(h[place[new]].view(np.int64))
        firsts.append(own[new] + c)
    place, gram, first = (np.concatenate(x) for x in (places, grams, firsts))
    keep = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, bool)
    return place[keep], gram[keep], first[keep]


def _name(text: bytes) -> tuple[int, int]:
    n = xxhash.xxh3_128_intdigest(text)
    return tuple(int(x) for x in np.array([n >> 64, n & (2**64 - 1)], np.uint64).view(np.int64))


def describe(docs: DataFrame, key: str, text: str, length: int, words: bool = False) -> DataFrame:
    """A row per document: key, docno, n_units, sha, the text's name (t1, t2) and its anchors as bytes."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(key).alias("docno"), F.col(text).alias("t"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            texts = bytes_list(part.column("t"))
            numbers = [units(t, words) for t in texts]
            sizes = np.array([len(x) for x in numbers], np.int64)
            starts = np.cumsum(sizes) - sizes
            place, gram, first = anchors(np.concatenate([np.zeros(0, np.uint8), *numbers]), starts, sizes, length)
            cut = np.searchsorted(place, np.append(starts, sizes.sum()))
            at = [slice(cut[i], cut[i + 1]) for i in range(len(texts))]
            names = [_name(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key"),
                    part.column("docno"),
                    pa.array(sizes),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                    *(pa.array([n[i] for n in names], pa.int64()) for i in (0, 1)),
                    *(pa.array([(x[s] - b).astype(kind).tobytes() for s, b in zip(at, bases, strict=True)], pa.binary())
                      for x, bases, kind in ((place, starts, "<u4"), (first, starts, "<u4"), (gram, [0] * len(at), "<i8"))),
                ],
                names=["key", "docno", "n_units", "sha", "t1", "t2", "place", "first", "gram"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(described, f"key {kind}, docno long, n_units long, sha string, t1 long, t2 long, place binary, first binary, gram binary")


def anchor_rows(texts: DataFrame, length: int, likely: BitFilter | None = None) -> DataFrame:
    """(t1, t2, ord, pos, gap, low, high, g, run): an anchor, the distance to the next, its windows and its hash.

    Of neighbours with the same hash, a run, only the first and the last are given.
    """

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                pos = np.frombuffer(batch.column("place")[i].as_py(), "<u4").astype(np.int64)
                if len(pos):
                    low, high, gram = _windows_of(batch, i, length)
                    same = gram[1:] == gram[:-1]
                    before, after = np.append(False, same), np.append(same, False)
                    own = ~(before & after)
                    columns = np.arange(len(pos)), pos, np.append(np.diff(pos), 0), low, high, gram, before | after
                    out.append((np.full(own.sum(), i), *(c[own] for c in columns)))
            if out:
                row, *columns = (np.concatenate(c) for c in zip(*out, strict=True))
                if likely:
                    own = likely.passes(columns[-2])
                    row, columns = row[own], [c[own] for c in columns]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(row)) for c in ("t1", "t2")), *(pa.array(c) for c in columns)],
                    names=["t1", "t2", "ord", "pos", "gap", "low", "high", "g", "run"],
                )

    return texts.mapInArrow(exploded, "t1 long, t2 long, ord long, pos long, gap long, low long, high long, g long, run boolean")


def _windows_of(batch: pa.RecordBatch, i: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window and hash of the anchors of a text."""
    low = np.frombuffer(batch.column("first")[i].as_py(), "<u4").astype(np.int64)
    high = np.append(low[1:], batch.column("n_units")[i].as_py() - length + 1) - 1
    return low, high, np.frombuffer(batch.column("gram")[i].as_py(), "<i8")


def anchor_groups(texts: DataFrame, length: int, likely: BitFilter | None = None) -> DataFrame:
    """(t1, t2, docno, g, n, places): a row for each different anchor of a text, how often it holds it and, for those
    that ``likely`` lets pass, the places, first and last windows as packed numbers."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, grams, counts, places = [], [], [], []
            for i in range(batch.num_rows):
                pos = np.frombuffer(batch.column("place")[i].as_py(), "<u4")
                if not len(pos):
                    continue
                low, high, gram = _windows_of(batch, i, length)
                order = np.argsort(gram, kind="stable")
                begins = np.flatnonzero(np.append(True, np.diff(gram[order]) != 0))
                ends = np.append(begins[1:], len(order))
                if likely:
                    own = likely.passes(gram[order[begins]])
                    begins, ends = begins[own], ends[own]
                    packed = np.stack([pos, low, high], axis=1).astype("<u4")[order]
                    places += [packed[a:b].tobytes() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                rows += [i] * len(begins)
                grams.append(gram[order[begins]])
                counts.append(ends - begins)
            if rows:
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(at) for c in ("t1", "t2", "docno")), pa.array(np.concatenate(grams)), pa.array(np.concatenate(counts)),
                     pa.array(places if likely else [None] * len(rows), pa.binary())],
                    names=["t1", "t2", "docno", "g", "n", "places"],
                )

    return texts.mapInArrow(grouped, "t1 long, t2 long, docno long, g long, n long, places binary")


def _next(column: str, k: int) -> Column:
    """Value ``k`` positions later in the same string, 0 where the string has ended before."""
    w = W.partitionBy("t1", "t2").orderBy("path", "ord")
    there = (F.lead("path", k).over(w) == F.col("path")) & (F.lead("ord", k).over(w) == F.col("ord") + k)
    return F.coalesce(F.when(there, F.lead(column, k).over(w)), F.lit(0))


def _sorted_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _below(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in the order of the keys with ``at`` (their place) and ``below`` (largest rank up to there, 0 if none)."""

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, done = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            rank = batch.column("rank").fill_null(0).to_numpy(zero_copy_only=False)
            below = np.maximum.accumulate(np.maximum(rank, seen)) if len(rank) else rank
            seen = int(below[-1]) if len(below) else seen
            at = (part << 33) + done + np.arange(len(rank))
            done += len(rank)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("t1", "t2", "path", "ord", "rank")), pa.array(np.full(len(rank), part), pa.int32()), pa.array(at), pa.array(below)],
                names=["t1", "t2", "path", "ord", "rank", "part", "at", "below"],
            )

    shape = "t1 long, t2 long, path long, ord long, rank long, part int, at long, below long"
    rows = stored(_sorted_by(df, *keys).mapInArrow(running, shape), "suffix-order")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    tops = rows.groupBy("part").agg(F.max("below").alias("top")).select("part", F.coalesce(F.max("top").over(before), F.lit(0)).alias("top"))
    zeros = rows.where("rank IS NULL").join(F.broadcast(tops), "part")  # a row for each partition
    out = stored(zeros.select("t1", "t2", "path", "ord", "at", F.greatest("below", "top").alias("below")), "suffix-below")
    discard(rows)
    return out


def suffix_ranks(strings: DataFrame, depth: int) -> DataFrame:
    """(t1, t2, path, ord, rank): order of all suffixes of the strings (t1, t2, path, ord, sym), sym above 0 or below.

    Suffixes with the same ``3 ** depth`` first symbols may come in any order among themselves.
    """
    place = ["t1", "t2", "path", "ord"]
    ahead = strings.select(*place, "sym", _next("sym", 1).alias("n1"), _next("sym", 2).alias("n2"))
    triples = stored(ahead.where("ord % 3 <> 0"), "suffix-triples")
    names = stored(
        _sorted_by(triples.select("sym", "n1", "n2").distinct(), "sym", "n1", "n2").withColumn("name", F.monotonically_increasing_id() + 1),
        "suffix-names",
    )
    named = stored(
        triples.join(names, ["sym", "n1", "n2"]).select(
            "t1", "t2", (F.col("path") * 3 + F.col("ord") % 3).alias("path"), F.expr("ord div 3").alias("ord"), F.col("name").alias("sym")
        ),
        "suffix-strings",
    )
    unique = names.count() == named.count()
    discard(triples, names)
    deeper = None if depth <= 1 or unique else suffix_ranks(named, depth - 1)
    ranked = named.withColumnRenamed("sym", "rank") if deeper is None else deeper
    sampled = ranked.select("t1", "t2", F.expr("path div 3").alias("path"), (F.col("ord") * 3 + F.col("path") % 3).alias("ord"), "rank")
    known = strings.join(sampled, place, "left")
    ahead = stored(known.select(*place, "sym", "rank", _next("sym", 1).alias("n1"), _next("rank", 1).alias("r1"), _next("rank", 2).alias("r2")), "suffix-ahead")
    first = _below(ahead.where("ord % 3 <> 2"), "sym", "r1")
    second = _below(ahead.where("ord % 3 <> 1"), "sym", "n1", "r2")
    merged = first.join(second.select(*place, F.col("below").alias("other")), place).select(
        *place, F.greatest("below", "other").alias("after"), F.lit(1).alias("kind"), "at"
    )
    rows = sampled.select(*place, F.col("rank").alias("after"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at")).unionByName(merged)
    out = stored(_sorted_by(rows, "after", "kind", "at").select(*place, (F.monotonically_increasing_id() + 1).alias("rank")), "suffix-ranks")
    discard(named, ahead, first, second, *([] if deeper is None else [deeper]))
    return out


def shared_reach(strings: DataFrame, ranks: DataFrame, size: int) -> DataFrame:
    """(t1, t2, ord, reach): units, ``size`` of them in an anchor, that a suffix surely shares with a neighbour in the suffix array."""
    ahead = strings.select(
        "t1", "t2", "ord", F.array("sym", *[_next("sym", k) for k in range(1, SPAN)]).alias("syms"),
        F.array("gap", *[_next("gap", k) for k in range(1, SPAN)]).alias("gaps"),
    )
    order = _sorted_by(ahead.join(ranks.select("t1", "t2", "ord", "rank"), ["t1", "t2", "ord"]), "rank")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("t1", "t2", "ord")]
            rows += [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, SPAN) for c in ("syms", "gaps")]
            if last is not None:  # it is sent again, with its neighbour in this batch
                rows = [np.concatenate([a, b]) for a, b in zip(last, rows, strict=True)]
            t1, t2, at, syms, gaps = rows
            if not len(at):
                continue
            same = np.logical_and.accumulate((syms[1:] == syms[:-1]) & (syms[1:] != 0), axis=1).sum(1)
            best = np.maximum(np.append(0, same), np.append(same, 0))
            offset = np.hstack([np.zeros((len(gaps), 1), np.int64), np.cumsum(gaps, axis=1)])
            reach = np.where(best > 0, offset[np.arange(len(best)), np.maximum(best - 1, 0)] + size, 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t1, t2, at, reach)], names=["t1", "t2", "ord", "reach"])
            last = [x[-1:] for x in rows]

    shape = "t1 long, t2 long, ord long, reach long"
    return order.mapInArrow(compared, shape).groupBy("t1", "t2", "ord").agg(F.max("reach").alias("reach"))


def unsettled(candidates: DataFrame, settled: DataFrame) -> DataFrame:
    """Hashes of the anchors that have a window outside every settled range (t1, t2, start, stop) of their text."""
    events = settled.select("t1", "t2", F.col("start").alias("at"), F.lit(0).alias("kind"), "stop", F.lit(None).cast("long").alias("g"), F.lit(None).cast("long").alias("high"))
    asked = candidates.select("t1", "t2", F.col("low").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("stop"), "g", "high")
    reached = F.max("stop").over(W.partitionBy("t1", "t2").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0))
    rows = events.unionByName(asked).withColumn("reached", reached)
    return rows.where((F.col("kind") == 1) & (F.coalesce("reached", F.lit(-1)) < F.col("high"))).select("g").distinct()


def _parts(before: np.ndarray, hashes: np.ndarray, parts: int, length: int) -> np.ndarray:
    """Part of each window: by its place relative to the anchor, which equal windows share, then by its hash."""
    most = length - length // 2  # places before the anchor go from 0 up to this
    places = min(parts, most)
    finer = np.uint64(-(-parts // most))
    return (before * places // (most + 1)) * int(finer) + (hashes % finer).astype(np.int64)


def text_windows(data: np.ndarray, wanted: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows of the anchors (pos, low, high), in order, of a text."""
    at, hashes, i = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while i < len(wanted):
        base = wanted[i, 1]
        j = int(np.searchsorted(wanted[:, 1], base + CHUNK))
        n = wanted[i:j, 2] - wanted[i:j, 1] + 1
        own = np.repeat(wanted[i:j, 1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        prefix = prefix_hashes(data[base : own[-1] + length])
        at.append(own)
        hashes.append(span_hashes(prefix, own - base, own - base + length))
        i = j
    return np.concatenate(at), np.concatenate(hashes)


def runs_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of successive numbers in ascending ones."""
    edge = np.flatnonzero(np.diff(at) != 1)
    return (at[np.append(0, edge + 1)], at[np.append(edge, len(at) - 1)]) if len(at) else (at, at)


def window_rows(docs: DataFrame, length: int, words: bool = False) -> DataFrame:
    """(g, part, t1, t2, at, hash): the different windows of the anchors (places, g, parts) of each text, as packed numbers.

    A row of the part -1 has the first and the last places of runs of windows that the text itself holds twice.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            out: list[tuple] = []
            for i, text in enumerate(bytes_list(batch.column("t"))):
                name = batch.column("t1")[i].as_py(), batch.column("t2")[i].as_py()
                groups = batch.column("wanted")[i].as_py()
                places = [np.frombuffer(w["places"], "<u4").reshape(-1, 3).astype(np.int64) for w in groups]
                anchor = np.repeat(np.arange(len(groups)), [len(p) for p in places])
                wanted = np.concatenate(places)
                order = np.argsort(wanted[:, 1])
                wanted, anchor = wanted[order], anchor[order]
                at, h = text_windows(units(text, words), wanted, length)
                n = wanted[:, 2] - wanted[:, 1] + 1
                anchor, before = np.repeat(anchor, n), np.repeat(wanted[:, 0], n) - at
                order = np.argsort(h, kind="stable")
                new = np.append(True, h[order][1:] != h[order][:-1])
                twice = ~(new & np.append(new[1:], True))
                if twice.any():
                    starts, stops = runs_of(np.sort(at[order[twice]]))
                    out.append((name[0], -1, *name, starts.astype("<u4").tobytes(), stops.astype("<u8").tobytes()))
                once = order[new]
                at, h, anchor, before = at[once], h[once], anchor[once], before[once]
                part = np.zeros(len(at), np.int64)
                for k, w in enumerate(groups):
                    if w["parts"] > 1:
                        own = anchor == k
                        part[own] = _parts(before[own], h[own], w["parts"], length)
                order = np.lexsort((at, part, anchor))
                at, h, anchor, part = at[order], h[order], anchor[order], part[order]
                begins = np.flatnonzero(np.append(True, (np.diff(anchor) != 0) | (np.diff(part) != 0))).tolist()
                for a, b in zip(begins, [*begins[1:], len(at)], strict=True):
                    out.append((groups[anchor[a]]["g"], int(part[a]), *name, at[a:b].astype("<u4").tobytes(), h[a:b].tobytes()))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            columns = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["g", "part", "t1", "t2", "at", "hash"]
            )

    return docs.select("t", "t1", "t2", "wanted").mapInArrow(hashed, "g long, part int, t1 long, t2 long, at binary, hash binary")


def repeated_windows(windows: DataFrame) -> DataFrame:
    """(t1, t2, start, stop): runs of windows whose bytes stand at more than one place."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _then_none(batches):
            if batch is not None:
                rows = pa.Table.from_batches([batch])
                held = rows if held is None else pa.concat_tables([held, rows])
            if held is None or not held.num_rows:
                continue
            g, p = held.column("g").to_numpy(), held.column("part").to_numpy()
            done = held.num_rows
            if batch is not None:  # the last anchor may go on in the next batch
                other = np.flatnonzero((g != g[-1]) | (p != p[-1]))
                done = int(other[-1]) + 1 if len(other) else 0
            if done:
                own = pa.array(p[:done] < 0)
                whole = held.slice(0, done)
                yield from _settled(whole.filter(own)).to_batches()
                if (p[:done] >= 0).any():
                    yield _runs(whole.filter(pc.invert(own)))
                held = held.slice(done)

    shape = "t1 long, t2 long, start long, stop long"
    return windows.repartition("g", "part").sortWithinPartitions("g", "part").mapInArrow(found, shape)


def _then_none(batches):
    yield from batches
    yield None


def _settled(rows: pa.Table) -> pa.Table:
    """(t1, t2, start, stop) of runs that texts have settled themselves."""
    starts = [np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in rows.column("at")]
    stops = [np.frombuffer(x.as_py(), "<u8").astype(np.int64) for x in rows.column("hash")]
    row = np.repeat(np.arange(len(starts)), [len(x) for x in starts])
    empty = np.zeros(0, np.int64)
    return pa.table({
        **{c: rows.column(c).to_numpy()[row] for c in ("t1", "t2")},
        "start": np.concatenate([empty, *starts]), "stop": np.concatenate([empty, *stops]),
    })


def _runs(rows: pa.Table) -> pa.RecordBatch:
    at = [np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in rows.column("at")]
    h = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in rows.column("hash")])
    row = np.repeat(np.arange(len(at)), [len(x) for x in at])
    at = np.concatenate(at)
    t1, t2 = (rows.column(c).to_numpy() for c in ("t1", "t2"))
    order = np.lexsort((at, t1[row], h))
    h, row, at = h[order], row[order], at[order]
    same = h[1:] == h[:-1]
    other = (at[1:] != at[:-1]) | (t1[row[1:]] != t1[row[:-1]]) | (t2[row[1:]] != t2[row[:-1]])
    group = np.cumsum(np.append(True, ~same)) - 1
    many = np.zeros(group[-1] + 1, bool)
    many[group[1:][same & other]] = True
    hit = many[group]
    order = np.lexsort((at[hit], row[hit]))
    row, at = row[hit][order], at[hit][order]
    new = np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    last = last[: len(first)]
    return pa.RecordBatch.from_arrays(
        [pa.array(t1[row[first]]), pa.array(t2[row[first]]), pa.array(at[first]), pa.array(at[last])], names=["t1", "t2", "start", "stop"]
    )


def cut_texts(docs: DataFrame, length: int, words: bool = False) -> DataFrame:
    """(t1, t2, n_removed, n_spans, sha, kept): each text without the bytes under its windows (start, stop).

    Words go with the white space up to the next word.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            removed, spans, sha, texts = [], [], [], []
            for text, windows in zip(bytes_list(batch.column("t")), batch.column("windows").to_pylist(), strict=True):
                at = np.array(sorted((w["start"], w["stop"] + length) for w in windows), np.int64)
                stop = np.maximum.accumulate(at[:, 1])
                new = np.append(True, at[1:, 0] > stop[:-1])
                begins, ends = at[new, 0], stop[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
                if words:
                    edges = np.append(word_bounds(text)[0], len(text))
                    begins, ends = edges[begins], edges[ends]
                kept = b"".join(text[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(text)], strict=True))
                removed.append(len(text) - len(kept))
                spans.append(len(begins))
                sha.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("t1", "t2")), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())],
                names=["t1", "t2", "n_removed", "n_spans", "sha", "kept"],
            )

    return docs.select("t", "t1", "t2", "windows").mapInArrow(cut, "t1 long, t2 long, n_removed long, n_spans long, sha string, kept string")


def repeated_ranges(info: DataFrame, docs: DataFrame, key: str, text: str, length: int, depth: int, words: bool = False) -> DataFrame:
    """(t1, t2, docno, windows): the repeated windows of the texts that one document alone holds."""
    texts = stored(
        info.where("n_units >= %d" % length).groupBy("t1", "t2").agg(
            F.count("*").alias("holders"), F.min("docno").alias("docno"), F.first("n_units").alias("n_units"),
            F.first("place").alias("place"), F.first("first").alias("first"), F.first("gram").alias("gram"),
        ),
        "suffix-texts",
    )
    members = anchor_groups(texts, length).groupBy("g").agg(F.sum("n").alias("members"), F.count("*").alias("holding"))
    often = stored(members.where("members > 1").select("g", "holding"), "suffix-often")
    candidates = stored(anchor_rows(texts, length, BitFilter(often, "g")).join(often.select("g"), "g"), "suffix-anchors")
    strings = stored(
        candidates.select("t1", "t2", F.lit(0).cast("long").alias("path"), "ord", F.xxhash64("g", "gap").alias("sym"), "gap", "pos"), "suffix-strings"
    )
    ranks = suffix_ranks(strings.select("t1", "t2", "path", "ord", "sym"), depth)
    reach = shared_reach(strings, ranks, length // 2).where(F.col("reach") >= length)
    settled = stored(
        reach.join(strings.select("t1", "t2", "ord", "pos"), ["t1", "t2", "ord"]).select(
            "t1", "t2", F.col("pos").alias("start"), (F.col("pos") + F.col("reach") - length).alias("stop")
        ),
        "suffix-settled",
    )
    discard(ranks, strings)
    unsure = unsettled(candidates, settled).unionByName(candidates.where("run").select("g")).distinct()
    unsure = stored(often.join(unsure, "g").select("g", F.ceil(F.col("holding") / MEMBERS).cast("int").alias("parts")), "suffix-unsure")
    wanted = anchor_groups(texts, length, BitFilter(unsure, "g")).join(unsure, "g")
    asked = stored(wanted.groupBy("t1", "t2", "docno").agg(F.collect_list(F.struct("g", "parts", "places")).alias("wanted")), "suffix-asked")
    windows = window_rows(named_texts(docs, key, text, BitFilter(asked, "t1")).join(asked, ["t1", "t2", "docno"]), length, words)
    ranges = settled.unionByName(repeated_windows(windows))
    alone = texts.where("holders = 1").select("t1", "t2", "docno")
    out = stored(
        ranges.join(alone, ["t1", "t2"]).groupBy("t1", "t2", "docno").agg(F.collect_list(F.struct("start", "stop")).alias("windows")),
        "suffix-ranges",
    )
    discard(settled, asked, unsure, candidates, texts, often)
    return out


def named_texts(docs: DataFrame, key: str, text: str, likely: BitFilter) -> DataFrame:
    """(t1, t2, docno, t): the texts that the filter lets pass, with their names."""
    rows = docs.select(F.xxhash64(key).alias("docno"), F.col(text).alias("t"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            names = np.array([_name(t) for t in bytes_list(part.column("t"))], np.int64).reshape(-1, 2)
            own = pa.array(np.flatnonzero(likely.passes(names[:, 0].copy())))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(names[:, i].copy()).take(own) for i in (0, 1)), part.column("docno").take(own), part.column("t").take(own)],
                names=["t1", "t2", "docno", "t"],
            )

    return rows.mapInArrow(named, "t1 long, t2 long, docno long, t string")


def cut_results(info: DataFrame, docs: DataFrame, key: str, text: str, length: int, depth: int, words: bool = False) -> DataFrame:
    """(t1, t2, n_removed, n_spans, cut_sha, kept) of the texts that lose bytes; null n_removed: all."""
    ranges = repeated_ranges(info, docs, key, text, length, depth, words)
    bodies = named_texts(docs, key, text, BitFilter(ranges, "t1"))
    cut = cut_texts(bodies.join(ranges, ["t1", "t2", "docno"]), length, words).dropDuplicates(["t1", "t2"])
    copies = info.where("n_units >= %d" % length).groupBy("t1", "t2").agg(F.count("*").alias("holders")).where("holders > 1")
    whole = copies.select(
        "t1", "t2", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("sha"), F.lit("").alias("kept")
    )
    return cut.unionByName(whole).withColumnRenamed("sha", "cut_sha")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, depth: int = 2) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    info = stored(describe(docs, key, text, length), "suffix-info")
    found = cut_results(info, docs, key, text, length, depth).drop("kept")
    return info.select("key", F.col("n_units").alias("n_bytes"), "sha", "t1", "t2").join(found, ["t1", "t2"], "left").select(
        F.col("key").alias(key),
        "n_bytes",
        F.when(F.col("n_spans").isNull(), 0).otherwise(F.coalesce("n_removed", "n_bytes")).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("cut_sha", "sha").alias("kept_sha256"),
    )


def drop_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, depth: int = 2, words: bool = False
) -> DataFrame:
    """The documents with what is left of their texts; what is left of a character that is cut apart goes too."""
    info = stored(describe(docs, key, text, length, words), "suffix-info")
    a, b, own_a, own_b, kept = fresh(docs, "t1", "t2", "own_t1", "own_t2", "kept")
    found = cut_results(info, docs, key, text, length, depth, words).select(F.col("t1").alias(a), F.col("t2").alias(b), F.col("kept").alias(kept))
    found = stored(found, "suffix-kept")
    discard(info)
    likely = BitFilter(found, a)
    shape = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in (own_a, own_b))])

    def marked(passing: bool):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text):
                names = np.array([_name(t) for t in bytes_list(part.column(text))], np.int64).reshape(-1, 2)
                own = pa.array(np.flatnonzero(likely.passes(names[:, 0].copy()) == passing))
                columns = [*part.columns, *(pa.array(names[:, i].copy()) for i in (0, 1))]
                yield pa.RecordBatch.from_arrays([c.take(own) for c in columns], names=shape.names)

        return rows

    same = (F.col(own_a) == F.col(a)) & (F.col(own_b) == F.col(b))
    changed = docs.mapInArrow(marked(True), shape).join(found, same, "left").withColumn(text, F.coalesce(kept, text))
    return changed.select(docs.columns).unionByName(docs.mapInArrow(marked(False), shape).select(docs.columns))
