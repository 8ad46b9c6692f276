"""Places in texts where one of many terms stands.

A text is cut into units: words, runs of white space, single other characters. A term is a run of units, so it stands
whole wherever its units follow each other, and it is found by an equi-join on the run's text. Runs become rows only
where they are likely terms: the bytes of a run are hashed from sums over the bytes of the text, for all runs of a batch
at once, and a table of bits knows the hashes of the terms and of their first units. It has 16 to 32 bits a term and at
most 16 MB; beyond four million terms more runs are made than needed, and the join still decides.

Rows in an exchange hold the caller's key, a place and the run, never the text. The terms are written once, because
they are read four times, and because Spark broadcasts them only if their known size allows it.

``line_terms`` gives the terms of lines as arrays in the row of their text, so nothing is shuffled at all. A term in them is a
likely one: about one run in a hundred that passes is none, and is dropped where terms meet their names. ``Names`` looks
these up in the row too; a table of names is sent out in blocks.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.sources.storage import stored

UNIT = r"(?U)(\w+|\s+|[^\w\s])"
MOST_BITS = 27  #: the table of bits has at most two to this power
PAIRS = 1 << 20  #: mentions that are made at once, unless one row has more
CHUNK = 1 << 18  #: bytes of text that are hashed at once, unless one row has more
BASE = 0x9E3779B97F4A7C15  #: odd, so that it has an inverse modulo two to the 64th
FIRST = np.uint64(0xD6E8FEB86659FD93)  #: tells the hash of a first unit from that of a term of one unit


def units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), 1)


def is_word(unit: Column) -> Column:
    """Whether a unit is a word; none is not."""
    return F.coalesce(unit.rlike(r"(?U)^\w"), F.lit(False))


def shaped(terms: DataFrame) -> DataFrame:
    """The terms (column ``term``) with their number of units, their first unit, and whether a symbol stands at either end."""
    named = terms.where(F.col("term") != "").withColumn("_units", units(F.col("term")))
    return stored(
        named.select(
            *terms.columns,
            F.size("_units").alias("_size"),
            F.get("_units", F.lit(0)).alias("_first"),
            (~is_word(F.get("_units", F.lit(0)))).alias("_open"),
            (~is_word(F.element_at("_units", -1))).alias("_shut"),
        ),
        "terms",
    )


@functools.cache
def powers(base: int, bits: int) -> np.ndarray:
    """The first ``2 ** bits`` powers modulo two to the 64th."""
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(33))


def ends_of(strings: pa.Array) -> np.ndarray:
    """Where the bytes of strings begin, and where the last ones end."""
    kind = np.int64 if pa.types.is_large_string(strings.type) else np.int32
    if not len(strings):
        return np.zeros(1, np.int64)
    return np.frombuffer(strings.buffers()[1], kind)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings, one behind the other, and where each begins."""
    ends = ends_of(strings)
    data = strings.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8), ends - ends[0]


class Hashed:
    """Bytes, to hash any run of them."""

    def __init__(self, data: np.ndarray):
        bits = max(CHUNK.bit_length(), len(data).bit_length())
        self.bytes, self.back = data, powers(pow(BASE, -1, 1 << 64), bits)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, bits)[: len(data)], out=self.sums[1:])

    def runs(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.back[start])

    def texts(self, start: np.ndarray, stop: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(stop - start)])
        picked = self.bytes[np.arange(ends[-1]) + np.repeat(start - ends[:-1], stop - start)]
        return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(picked)).cast(pa.string())


KINDS: dict[str, Broadcast] = {}
WORD, SPACE, OTHER = b"w ."


def kinds(spark: SparkSession) -> Broadcast:
    """Whether each code point is part of a word, white space or a symbol, as the patterns of Spark see it."""
    app = spark.sparkContext.applicationId
    if app not in KINDS:
        points = [*range(0xD800), *range(0xE000, 0x110000)]
        blank = F.regexp_replace(F.regexp_replace("t", r"(?U)\s", " "), r"(?U)\w", "w")
        seen = spark.createDataFrame([("".join(map(chr, points)),)], "t string").select(F.regexp_replace(blank, "[^ w]", ".")).collect()[0][0]
        table = np.full(0x200000, OTHER, np.uint8)
        table[points] = np.frombuffer(seen.encode(), np.uint8)
        KINDS[app] = spark.sparkContext.broadcast(table)
    return KINDS[app]


def unit_starts(data: np.ndarray, rows: np.ndarray, kind_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the units of texts begin, whose bytes begin at ``rows``, and of what kind they are."""
    kind = kind_of[data]
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        tail = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64) & 0x3F
        lead, point = data[wide].astype(np.int64), tail[wide + 1]
        point = np.where(lead >= 0xE0, point << 6 | tail[wide + 2], point)
        point = np.where(lead >= 0xF0, point << 6 | tail[wide + 3], point)
        bits = np.where(lead >= 0xF0, 18, np.where(lead >= 0xE0, 12, 6))
        kind[wide] = kind_of[((lead & np.where(lead >= 0xF0, 7, np.where(lead >= 0xE0, 15, 31))) << bits | point)]
    at = np.flatnonzero((data & 0xC0) != 0x80)
    own = kind[at]
    begins = np.ones(len(at), bool)
    begins[1:] = (own[1:] != own[:-1]) | (own[1:] == OTHER)
    edge = np.searchsorted(at, rows)
    begins[edge[edge < len(at)]] = True
    return at[begins], own[begins]


def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of terms and of their first units."""
    for batch in batches:
        every = []
        for name, tag in (("term", np.uint64(0)), ("_first", FIRST)):
            data, ends = bytes_of(batch.column(name))
            every.append(Hashed(data).runs(ends[:-1], ends[1:]) ^ tag)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(every).view(np.int64))], names=["h"])


class Bits:
    """A table of bits, two for each hash (column ``h``) of ``n``; what passes may be none of the hashes, what does not pass is none."""

    def __init__(self, own: DataFrame, n: int):
        bits = min(MOST_BITS, max(12, (16 * n).bit_length()))
        self.mask = (1 << bits) - 1
        places = F.array(F.col("h").bitwiseAND(self.mask), F.shiftrightunsigned("h", 32).bitwiseAND(self.mask))
        words = (
            own.select(F.explode(places).alias("bit"))
            .groupBy(F.shiftright("bit", 6).alias("word"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63).cast("int"))).alias("set"))
            .toArrow()
        )
        table = np.zeros((1 << bits) // 64, np.uint64)
        table[words["word"].to_numpy()] = words["set"].to_numpy().view(np.uint64)
        self.table = own.sparkSession.sparkContext.broadcast(table)

    def passes(self, h: np.ndarray) -> np.ndarray:
        table, out = self.table.value, np.ones(len(h), bool)
        for bit in (h & np.uint64(self.mask), (h >> np.uint64(32)) & np.uint64(self.mask)):
            out &= (table[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return out

    def holds(self, h: Column) -> Column:
        """Whether a hash, never null, passes."""

        def held(h: pa.Array) -> pa.Array:
            return pa.array(self.passes(h.to_numpy(zero_copy_only=False).view(np.uint64)))

        return in_arrow(held, "boolean")(h)


class Likely(Bits):
    """The bits of the hashes of terms and of their first units."""

    def __init__(self, shapes: DataFrame):
        super().__init__(shapes.select("term", "_first").mapInArrow(hashes, "h long"), shapes.count())


def in_arrow(function: Callable[[pa.Array], pa.Array], kind: str) -> Callable[..., Column]:
    """A function of an Arrow array on a column. Spark takes it for one without a fixed result, or it would move filters
    on the result below it and call it twice."""
    return F.arrow_udf(function, kind).asNondeterministic()


class Runs:
    """Likely terms in strings: ``at`` is the first of ``count`` units of the string ``own``; ``bounds`` are the first units of the strings."""

    def __init__(self, strings: pa.Array, likely: Likely, kind_of: np.ndarray, sizes: Sequence[int]):
        self.data, begin = bytes_of(strings)
        self.start, self.kind = unit_starts(self.data, begin[:-1], kind_of)
        self.bounds = np.searchsorted(self.start, begin)  # the first unit of each row, and the number of all units
        row = np.repeat(np.arange(len(strings)), np.diff(self.bounds))
        self.edges = edges = np.append(self.start, len(self.data))
        self.hashed = Hashed(self.data)
        begun = np.flatnonzero(likely.passes(self.hashed.runs(edges[:-1], edges[1:]) ^ FIRST))
        room = self.bounds[row[begun] + 1] - begun
        at, count, named = [], [], []
        for n in sizes:
            fits = begun[room >= n]
            h = self.hashed.runs(edges[fits], edges[fits + n])
            hit = likely.passes(h)
            at.append(fits[hit])
            count.append(np.full(len(at[-1]), n))
            named.append(h[hit])
        self.at, self.count, self.named = np.concatenate(at), np.concatenate(count), np.concatenate(named)
        self.own = row[self.at]

    def beside(self, also: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Whether a word, or one of the ASCII symbols of ``also``, stands before and behind."""
        worded = np.append((self.kind == WORD) | np.isin(self.data[self.start], np.frombuffer(also, np.uint8)), False)
        end = self.at + self.count
        return worded[self.at - 1] & (self.at > self.bounds[self.own]), worded[end] & (end < self.bounds[self.own + 1])

    def texts(self, some: np.ndarray | slice = slice(None)) -> pa.Array:
        at = self.at[some]
        return self.hashed.texts(self.edges[at], self.edges[at + self.count[some]])


def pieces(strings: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of strings with some ``CHUNK`` bytes, or one string."""
    where, start = ends_of(strings), 0
    while start < len(strings):
        stop = max(start + 1, int(np.searchsorted(where, where[start] + CHUNK, "right")) - 1)
        yield start, stop
        start = stop


def spans(rows: DataFrame, text: Column, keep: Sequence[str], shapes: DataFrame, also: str = "") -> DataFrame:
    """(keep..., _at, _before, _after, columns of the shapes) for each place in ``text`` where a term stands.

    ``_at`` counts units from 0; ``_before`` and ``_after`` say whether a word, or one of the ASCII symbols of ``also``,
    stands beside the term.
    """
    likely, kind_of = Likely(shapes), kinds(shapes.sparkSession)
    sizes = sorted(r[0] for r in shapes.select("_size").distinct().collect())
    held = rows.select(*keep, text.alias("_sp_text"))
    found = [("_at", T.IntegerType()), ("_before", T.BooleanType()), ("_after", T.BooleanType()), ("term", T.StringType())]
    shape = T.StructType([*[held.schema[k] for k in keep], *[T.StructField(n, t) for n, t in found]])

    def search(part: pa.RecordBatch) -> pa.RecordBatch:
        runs = Runs(part.column(len(keep)), likely, kind_of.value, sizes)
        before, after = runs.beside(also.encode())
        kept = [part.column(i).take(pa.array(runs.own)) for i in range(len(keep))]
        place = pa.array((runs.at - runs.bounds[runs.own]).astype(np.int32))
        return pa.RecordBatch.from_arrays([*kept, place, pa.array(before), pa.array(after), runs.texts()], names=shape.names)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in pieces(batch.column(len(keep))) if sizes else ():
                yield search(batch.slice(start, stop - start))

    return held.mapInArrow(searched, shape).join(shapes, "term")


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` numbers from each of ``first`` on, one after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def list_sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def ends_from(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))


def line_terms(texts: Column, terms: DataFrame, mode: str = "word") -> Column:
    """For each text of an array of texts the different likely ``terms`` that stand whole in it; see ``match_terms`` on the mode."""
    shapes = shaped(terms.select("term").distinct())
    likely, kind_of = Likely(shapes), kinds(shapes.sparkSession)
    sizes = sorted(r[0] for r in shapes.select("_size").distinct().collect())

    def search(strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
        runs = Runs(strings, likely, kind_of.value, sizes)
        before, after = runs.beside()
        first, last = runs.kind[runs.at] == WORD, runs.kind[runs.at + runs.count - 1] == WORD
        whole = (first | before) & (last | after) if mode == "edge" else ~(~first & before) & ~(~last & after)
        whole = np.flatnonzero(whole)
        order = whole[np.lexsort((runs.named[whole], runs.own[whole]))]
        own, named = runs.own[order], runs.named[order]
        new = np.ones(len(order), bool)
        new[1:] = (own[1:] != own[:-1]) | (named[1:] != named[:-1])
        return np.bincount(own[new], minlength=len(strings)), runs.texts(order[new])

    def found(texts: pa.Array) -> pa.Array:
        flat = texts.flatten()
        each = [search(flat.slice(i, j - i)) for i, j in pieces(flat)] if sizes else [(np.zeros(len(flat), int), pa.array([], pa.string()))]
        n = np.concatenate([np.zeros(0, int), *[x for x, _ in each]])
        words = pa.concat_arrays([pa.array([], pa.string()), *[w for _, w in each]])
        return pa.ListArray.from_arrays(ends_from(list_sizes(texts)), pa.ListArray.from_arrays(ends_from(n), words))

    return in_arrow(found, "array<array<string>>")(texts)


class Names:
    """Names (column ``canonical``) of terms, to look up the names of a row's terms."""

    def __init__(self, table: DataFrame):
        rows = table.select("term", "canonical").toArrow().combine_chunks()
        terms, coded = pa.concat_arrays(rows["term"].chunks or [pa.array([], pa.string())]), pa.concat_arrays(rows["canonical"].chunks or [pa.array([], pa.string())])
        coded = coded.cast(pa.string()).dictionary_encode(null_encoding="encode")
        terms = terms.cast(pa.string())
        h = self.hashed(terms)
        order = np.argsort(h, kind="stable")
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order]
        self.table = table.sparkSession.sparkContext.broadcast((h[order], terms.take(pa.array(order)), code, coded.dictionary))

    @staticmethod
    def hashed(strings: pa.Array) -> np.ndarray:
        data, ends = bytes_of(strings)
        return Hashed(data).runs(ends[:-1], ends[1:])

    def places(self) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A function of strings to their names: the codes of all names, and for each string the first of its codes and their number."""
        table, hashed = self.table, self.hashed

        def looked_up(flat: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, own, code, _ = table.value
            coded = flat.dictionary_encode()
            words, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            asked = hashed(words)
            low = np.searchsorted(h, asked)
            n = np.searchsorted(h, asked, "right") - low
            place, word = spread(low, n), np.repeat(np.arange(len(words)), n)
            same = pc.equal(own.take(pa.array(place)), words.take(pa.array(word))).to_numpy(zero_copy_only=False).astype(bool)
            n = np.bincount(word[same], minlength=len(words))
            return code[place[same]], (np.cumsum(n) - n)[at], n[at]

        return looked_up

    def of(self, terms: Column) -> Column:
        """The different names of an array of terms, null among them; terms without a name have none."""
        table, looked_up = self.table, self.places()

        def named(terms: pa.Array) -> pa.Array:
            row = np.repeat(np.arange(len(terms)), list_sizes(terms))
            codes, first, n = looked_up(terms.flatten())
            both = np.unique(np.repeat(row, n) << 32 | codes[spread(first, n)])
            return pa.ListArray.from_arrays(ends_from(np.bincount(both >> 32, minlength=len(terms))), table.value[3].take(pa.array(both & 0xFFFFFFFF)))

        return in_arrow(named, "array<string>")(terms)

    def mentions(self) -> Callable[[pa.Array], Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]]:
        """A function of rows of arrays of terms to ranges of rows (start, stop, row, code, line): each name of a row once, at its first line."""
        looked_up = self.places()

        def met(terms: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
            inner = terms.flatten()
            lines, words = list_sizes(terms), list_sizes(inner)
            row = np.repeat(np.repeat(np.arange(len(terms)), lines), words)
            line = np.repeat(spread(np.zeros(len(terms), np.int64), lines), words)
            codes, first, n = looked_up(inner.flatten())
            ends = np.cumsum(np.bincount(row, weights=n, minlength=len(terms)).astype(np.int64))
            bounds, start = np.searchsorted(row, np.arange(len(terms) + 1)), 0
            while start < len(terms):
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
                s = slice(bounds[start], bounds[stop])
                both = np.repeat(row[s] - start, n[s]) << 32 | codes[spread(first[s], n[s])]
                both, at = np.unique(both, return_index=True)
                yield start, stop, both >> 32, both & 0xFFFFFFFF, np.repeat(line[s], n[s])[at]
                start = stop

        return met

    def counts(self, rows: DataFrame) -> DataFrame:
        """(_piece, code, n): in how many rows (_piece, terms) of a piece each name is mentioned, summed within a batch."""
        table, met = self.table, self.mentions()

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                piece, some = batch.column("_piece").to_numpy(), len(table.value[3])
                for i in np.unique(piece):
                    n = np.zeros(some, np.int64)
                    for *_, code, _ in met(batch.column("terms").filter(pa.array(piece == i))):
                        n += np.bincount(code, minlength=some)
                    code = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), i, np.int32)), pa.array(code.astype(np.int32)), pa.array(n[code])], names=["_piece", "code", "n"])

        return rows.select("_piece", "terms").mapInArrow(counted, "_piece int, code int, n long")

    def ranked(self, rows: DataFrame) -> DataFrame:
        """The rows with their names, the ranks of these mentions, and the lines where they stand first.

        Rows come in order, the pieces one after the other; first in a piece stand ``start`` of each ``code``, how many
        mentions of the name are in the pieces before.
        """
        table, met = self.table, self.mentions()
        kept = [c for c in rows.columns if c not in ("_piece", "terms", "code", "start")]
        shape = T.StructType([*[rows.schema[c] for c in kept], *[T.StructField(c, T.ArrayType(t)) for c, t in (("names", T.StringType()), ("ranks", T.LongType()), ("lines", T.IntegerType()))]])

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = None
            for batch in batches:
                piece, heads = batch.column("_piece").to_numpy(), batch.column("code").is_valid().to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | heads[1:] | heads[:-1])) if len(piece) else np.zeros(0, int)
                for i, j in zip(cuts, np.append(cuts[1:], len(piece)), strict=True):
                    if piece[i] != last:
                        last, so_far = piece[i], np.zeros(len(table.value[3]), np.int64)
                    part = batch.slice(i, j - i)
                    if heads[i]:
                        so_far[part.column("code").flatten().to_numpy()] = part.column("start").flatten().to_numpy()
                        continue
                    for start, stop, row, code, line in met(part.column("terms")):
                        order = np.argsort(code, kind="stable")
                        n = np.bincount(code, minlength=len(so_far))
                        own = np.flatnonzero(n)
                        ranks = np.empty(len(code), np.int64)
                        ranks[order] = spread(so_far[own] + 1, n[own])
                        so_far += n
                        ends = ends_from(np.bincount(row, minlength=stop - start))
                        lists = [table.value[3].take(pa.array(code)), pa.array(ranks), pa.array(line.astype(np.int32))]
                        columns = [part.column(c).slice(start, stop - start) for c in kept]
                        yield pa.RecordBatch.from_arrays([*columns, *[pa.ListArray.from_arrays(ends, x) for x in lists]], schema=None, names=shape.names)

        return rows.mapInArrow(numbered, shape).where(F.size("names") > 0)
