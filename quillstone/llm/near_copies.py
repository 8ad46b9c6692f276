"""Near copies by the exact similarity of their word shingles; candidates by fingerprints and by minima of hashes.

The set of a text are its lower-cased ``width``-word shingles (the whole text if it has fewer words). Two texts are near
copies if their sets have a Jaccard similarity of ``SIMILAR`` at least. Near copies of near copies form one group.

1. Candidates. The popcount grid (``simhash.py``) links the sets whose fingerprints differ by at most ``DISTANCE`` bits;
   each set meets one set of its group. Fingerprints of pairs at 0.8 differ by more, so the others are found by ``BANDS``
   times ``ROWS`` minima of independently hashed shingles; two sets share a minimum with the probability of their
   similarity, so two of similarity 0.8 share no whole band with a probability of (1 - 0.8 ** 5) ** 40 = 1.3e-7, and
   less above. This is the only place where a pair can be missed.
2. Bound. ``PARITIES`` bits of a set say for each class of shingles whether it holds an odd number of them. Two sets
   differ in at least as many shingles as in bits, so a pair with too many different bits is surely not similar and is
   never made. The bound loses no pair, whatever the sets' sizes; it prunes little for texts of many thousand words.
3. Verification. The sets of a band are compared with its hub, the one of them that shares the most bands with others:
   copies that were each made from one text meet that text. Pairs of the grid are verified with them. In bands whose sets are then not all in one group, the sets
   outside the hub's group are compared with all sets of other groups that the bound leaves. A pair links by the exact
   similarity of its shingles alone (as 64-bit hashes), never by the minima.
4. Groups are the components of the verified links. Of each group one row stays: that of the smallest key, a null key
   only if there is no other.

Only distinct sets are compared; rows are told apart by key and text, so a repeated or null key is judged row by row.
Texts without words, null texts among them, have the same empty set and are copies of one another.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm import simhash
from quillstone.llm.arrow_text import bytes_list, prefix_hashes, slices, span_hashes
from quillstone.llm.bit_filter import BitFilter
from quillstone.llm.components import components
from quillstone.llm.names import fresh
from quillstone.sources.storage import discard, stored

BANDS, ROWS = 40, 5
DISTANCE = 4  #: bits in which fingerprints of the grid's pairs differ
PARITIES = 512  #: a multiple of 64
SIMILAR = (4, 5)  #: numerator and denominator of the least similarity
_random = np.random.default_rng(42)
FACTORS = _random.integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
MIXERS = _random.integers(1, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    return np.unique(span_hashes(prefix_hashes(joined), starts[: len(last)], last))


def bands(members: np.ndarray) -> np.ndarray:
    """A number for each band of minima; none for an empty set."""
    if not len(members):
        return members
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for i in range(0, len(members), 1024):
        np.minimum(least, np.multiply.outer(FACTORS, members[i : i + 1024]).min(1), out=least)
    h = ((least ^ (least >> np.uint64(31))).reshape(BANDS, ROWS) * MIXERS).sum(1, dtype=np.uint64)
    return h ^ (h >> np.uint64(29))


def parities(members: np.ndarray) -> np.ndarray:
    """Whether the set holds an odd number of shingles of each of ``PARITIES`` classes."""
    odd = np.bincount((members % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the least similarity, in whole numbers."""
    common = len(a) + len(b) - len(np.union1d(a, b))
    return SIMILAR[1] * common >= SIMILAR[0] * (len(a) + len(b) - common)


def text_name(text: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(text)).view(np.int64))


def described(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, t, s, n, fp, bands, bits): name of the text, name and size of its set, its fingerprint, bands as bytes and parities."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            texts = bytes_list(part.column("t"))
            sets = [shingles(t, width) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key"),
                    pa.array([text_name(t) for t in texts], pa.int64()),
                    pa.array([text_name(x.tobytes()) for x in sets], pa.int64()),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array(np.array([simhash.majority(x) for x in sets], np.uint64).view(np.int64)),
                    pa.array([bands(x).tobytes() for x in sets], pa.binary()),
                    pa.array([parities(x) for x in sets], pa.list_(pa.int64())),
                ],
                names=["key", "t", "s", "n", "fp", "bands", "bits"],
            )

    own = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    return own.mapInArrow(rows, f"key {own.schema['key'].dataType.simpleString()}, t long, s long, n long, fp long, bands binary, bits array<long>")


def band_rows(sets: DataFrame, likely: BitFilter | None = None) -> DataFrame:
    """(band, s, n, bits): a row for each band of each set."""

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("bands")]
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            band = np.concatenate([np.zeros(0, np.int64), *found])
            if likely:
                own = likely.passes(band)
                row, band = row[own], band[own]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(band), *(batch.column(c).take(at) for c in ("s", "n", "bits"))], names=["band", "s", "n", "bits"])

    return sets.select("bands", "s", "n", "bits").mapInArrow(exploded, "band long, s long, n long, bits array<long>")


def verified(pairs: DataFrame, bodies: DataFrame, width: int) -> DataFrame:
    """Those of the pairs (a, b) whose texts, (s, body), are similar."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            keep = []
            for i, (a, x, y) in enumerate(zip(batch.column("a").to_pylist(), bytes_list(batch.column("x")), bytes_list(batch.column("y")), strict=True)):
                if a != last:
                    last, own = a, shingles(x, width)
                if similar(own, shingles(y, width)):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("a", "b")], names=["a", "b"])

    y = bodies.select(F.col("s").alias("b"), F.col("body").alias("y"))
    x = bodies.select(F.col("s").alias("a"), F.col("body").alias("x"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(judged, "a long, b long")


def texts_of(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(s, body): a text of each wanted set (s, t)."""
    likely = BitFilter(wanted, "t")

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "body"):
            names = np.array([text_name(t) for t in bytes_list(part.column("body"))], np.int64)
            own = pa.array(np.flatnonzero(likely.passes(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names).take(own), part.column("body").take(own)], names=["t", "body"])

    found = docs.select(F.col(text).alias("body")).mapInArrow(passing, "t long, body string")
    return found.join(wanted, "t").dropDuplicates(["s"]).select("s", "body")


def may_be_similar(n: str, m: str, bits: str, others: str) -> Column:
    """False only for sets that cannot be similar: their sizes, or the bits in which they differ, leave too little in common."""
    num, den = SIMILAR
    sizes = (F.col(n) * den >= F.col(m) * num) & (F.col(m) * den >= F.col(n) * num)
    apart = functools.reduce(operator.add, (F.bit_count(F.col(bits)[i].bitwiseXOR(F.col(others)[i])) for i in range(PARITIES // 64)))
    return sizes & ((F.col(n) + F.col(m)) * (den - num) >= apart * (den + num))


def hubs(sets: DataFrame) -> DataFrame:
    """(band, a, m, a_bits): of each band of several sets the one that shares the most bands."""
    several = stored(band_rows(sets).groupBy("band").agg(F.count("*").alias("c")).where("c > 1"), "near-several")
    rows = stored(band_rows(sets, BitFilter(several, "band")).select("band", "s").join(several, "band"), "near-rows")
    degree = rows.groupBy("s").agg(F.sum("c").alias("d"))
    best = rows.join(degree, "s").groupBy("band").agg(F.max(F.struct("d", "s")).alias("best")).select("band", F.col("best.s").alias("a"))
    own = sets.select(F.col("s").alias("a"), F.col("n").alias("m"), F.col("bits").alias("a_bits"))
    out = stored(best.join(own, "a"), "near-hubs")
    discard(several, rows)
    return out


def grid_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): sets whose fingerprints the popcount grid links, each with one of its group, if the bound leaves them."""
    leads = stored(sets.groupBy("fp").agg(F.min("s").alias("a")), "near-fingerprints")
    near = simhash.near_links(leads, DISTANCE)
    other = leads.select(F.col("fp").alias("b"), F.col("a").alias("s"))
    apart = near.join(other, "b").join(leads.withColumnRenamed("a", "lead"), F.col("a") == F.col("fp")).select(F.col("lead").alias("a"), "s")
    same = sets.select("fp", "s").join(leads, "fp").where("s <> a").select("a", "s")
    own = sets.select(F.col("s").alias("a"), F.col("n").alias("m"), F.col("bits").alias("a_bits"))
    met = apart.unionByName(same).distinct().join(sets.select("s", "n", "bits"), "s").join(own, "a")
    out = stored(met.where(may_be_similar("n", "m", "bits", "a_bits")).select("a", F.col("s").alias("b")), "near-grid")
    discard(leads)
    return out


def linked(pairs: DataFrame, sets: DataFrame, docs: DataFrame, text: str, width: int) -> DataFrame:
    """(a, b): the similar ones of the pairs, whose texts are read once."""
    pairs = stored(pairs.distinct(), "near-pairs")
    names = pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).distinct()
    wanted = stored(names.join(sets.select("s", "t"), "s"), "near-wanted")
    bodies = stored(texts_of(docs, text, wanted), "near-bodies")
    out = stored(verified(pairs, bodies, width), "near-links")
    discard(pairs, wanted, bodies)
    return out


def near_links(sets: DataFrame, docs: DataFrame, text: str, width: int) -> DataFrame:
    """(a, b): verified links that connect all similar candidates; ``sets`` has (s, t, n, fp, bands, bits), each set once."""
    grid = grid_pairs(sets)
    leads = hubs(sets)
    members = stored(band_rows(sets, BitFilter(leads, "band")).join(leads, "band"), "near-members")
    with_hub = members.where((F.col("s") != F.col("a")) & may_be_similar("n", "m", "bits", "a_bits"))
    links = linked(with_hub.select("a", F.col("s").alias("b")).unionByName(grid), sets, docs, text, width)
    placed = members.join(components(links), F.col("s") == F.col("node"), "left").select("band", "s", "n", "bits", "a", F.coalesce("component", "s").alias("group"))
    placed = stored(placed, "near-placed")
    settled = placed.where("s = a").select("band", F.col("group").alias("hub"))
    outside = stored(placed.join(settled, "band").where("group <> hub").select("band", "s", "n", "bits", "group", "hub"), "near-outside")
    other = placed.where("s <> a").select("band", F.col("s").alias("o"), F.col("n").alias("m"), F.col("bits").alias("o_bits"), F.col("group").alias("other"))
    new = (F.col("group") != F.col("other")) & ((F.col("other") == F.col("hub")) | (F.col("s") < F.col("o")))
    apart = outside.join(other, "band").where(new & may_be_similar("n", "m", "bits", "o_bits"))
    more = linked(apart.select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")), sets, docs, text, width)
    out = stored(links.unionByName(more), "near-all-links")
    discard(grid, leads, members, placed, outside, links, more)
    return out


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """The documents but for those that have a verified near copy in a group whose one row stays."""
    marked = stored(described(docs, key, text, width), "near-described")
    sets = stored(marked.groupBy("s").agg(F.min("t").alias("t"), *(F.first(c).alias(c) for c in ("n", "fp", "bands", "bits"))), "near-sets")
    group = components(near_links(sets, docs, text, width))
    rows = marked.select("key", "t", "s").join(group, F.col("s") == F.col("node"), "left")
    rows = rows.select("key", "t", F.coalesce("component", "s").alias("group"))
    best = rows.groupBy("group").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "t")).alias("best"), F.count("*").alias("n")).where("n > 1")
    own_key, name, stays, text_name_of = fresh(docs, "key", "name", "stays", "text_name")
    chosen_row = F.col("key").eqNullSafe(F.col("best.key")) & (F.col("t") == F.col("best.t"))
    judged = rows.join(best, "group").select(F.col("key").alias(own_key), F.col("t").alias(name), chosen_row.alias(stays))
    judged = stored(judged.distinct(), "near-judged")
    discard(marked, sets)
    likely = BitFilter(judged, name)
    shape = T.StructType([*docs.schema.fields, T.StructField(text_name_of, T.LongType())])

    def filtered(passing: bool):
        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text):
                names = np.array([text_name(t) for t in bytes_list(part.column(text))], np.int64)
                own = pa.array(np.flatnonzero(likely.passes(names) == passing))
                yield pa.RecordBatch.from_arrays([*(c.take(own) for c in part.columns), pa.array(names).take(own)], names=shape.names)

        return chosen

    rest = docs.mapInArrow(filtered(False), shape)
    maybe = docs.mapInArrow(filtered(True), shape)
    met = maybe.join(judged, (F.col(text_name_of) == F.col(name)) & maybe[key].eqNullSafe(F.col(own_key)), "left")
    once = met.where(F.col(stays)).dropDuplicates([key, text_name_of])
    return rest.select(docs.columns).unionByName(met.where(F.col(stays).isNull()).select(docs.columns)).unionByName(once.select(docs.columns))
