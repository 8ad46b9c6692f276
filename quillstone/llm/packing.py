"""Best-fit packing by the configuration linear program.

Documents become pieces of at most ``capacity`` tokens; only longer ones are cut. A configuration is a multiset of
piece lengths that fits into a sequence. The covering program over the length histogram (at most ``capacity`` numbers)
is solved on the driver by multiplicative weights: each round prices the lengths by their weights, finds the best
configuration by a knapsack dynamic program, and lowers the weights of what it covers. Rare neighbouring lengths stand as
one class, so that whole sequences are left after rounding; a length common enough is a class of its own.

The mean of the rounds is rounded to whole sequences and the slots of each get real lengths of their classes; the last
slot takes the best fit. What the configurations leave is solved by the same program again, and the few pieces after
that are packed by best-fit patterns. Each pattern repeats until one of its lengths is used up, so their number
is bounded by the capacity and the rounds, not by the data.

Pieces then take their places in Spark: their number among the pieces of their length (counted in bounded groups, so a
length that a third of all pieces share is no hot spot) gives pattern, repetition and offset by a look-up in a table of
bounded size.

Defined results: a null text is empty, an empty text is the end token alone; repeated rows and ids are documents of
their own; an empty table gives an empty result.
"""

from __future__ import annotations

import collections
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.llm.arrow_text import slices
from quillstone.sources.storage import stored

PIECES = "doc long, piece int, start long, length long, ids_crc32 long"
MOST_WORDS = 1_000_000  #: words whose tokens a worker keeps
AT_ONCE = 2_000  #: words that the tokenizer gets at once; its answers are large
_MARKED = re.compile(rb"(.*[^\x00-\x40\x5b-\x60\x7b-\x7f])([!-/:-@\[-`{-~]+)", re.S)
_BYTES = np.arange(256)
_MARK = np.isin(_BYTES, np.frombuffer(bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]), np.uint8))
_LETTER = (_BYTES | 32 >= ord("a")) & (_BYTES | 32 <= ord("z")) & (_BYTES < 128)
_tokenizers: dict[str, WordTokens] = {}


class WordTokens:
    """Tokens of white-space separated words, kept for the next time the word comes.

    The vocabulary drops white space and joins nothing across it, so the tokens of a text are those of its words. Only
    spaces and line feeds separate here; other white space stays inside a word and is left to the tokenizer. ASCII
    letters are lowered first, as the tokenizer does, except beside markers, whose capitals count. Marks at the end of a
    word, behind a letter, are a word of their own. Texts are cut and put together in arrays; only distinct words of a
    slice are looked up one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Tokens of each word. Words of letters go as one text, which is faster; each ends with an end-of-word token."""
        texts = [w.decode() for w in words]
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        out: list[bytes] = [b""] * len(words)
        for i in range(0, len(plain), AT_ONCE):
            some = plain[i : i + AT_ONCE]
            ids = self.ids(" ".join([texts[k] for k in some]))
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                raw, start = ids.tobytes(), 0
                for k, stop in zip(some, (4 * stops).tolist(), strict=True):
                    out[k] = raw[start:stop]
                    start = stop
            else:  # a letter became more than letters when it was lowered
                for k in some:
                    out[k] = self.ids(texts[k]).tobytes()
        for k in set(range(len(words))).difference(plain):
            out[k] = self.ids(texts[k]).tobytes()
        return out

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, words: list[bytes]) -> None:
        """Adds words. Those of a to z go to the model itself: what stands before it leaves them as they are."""
        known, tokens = self.known, self.tokenizer.model.tokenize
        plain = [w for w in words if w.isalpha() and w.islower()]
        known.update((w, array("I", [t.id for t in tokens(w.decode())]).tobytes()) for w in plain)
        others = [w for w in words if w not in known]
        cut = [None if b"<|" in w else _MARKED.fullmatch(w) for w in others]
        parts = [(m[1], m[2]) if m and m[1].decode()[-1].lower()[-1].isalpha() else (w, b"") for w, m in zip(others, cut, strict=True)]
        known[b""] = b""
        fresh = list({p for pair in parts for p in pair}.difference(known))
        known.update(zip(fresh, self.encode(fresh), strict=True))
        known.update((word, known[core] + known[marks]) for word, (core, marks) in zip(others, parts, strict=True))

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit tokens of each text."""
        words, bounds = cut_words([t if b"<|" in t else t.lower() for t in texts])
        if not len(words):
            return [b""] * len(texts)
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        known, coded = self.known, words.dictionary_encode()
        _, ends, letters = coded.dictionary.buffers()
        ends, letters = np.frombuffer(ends, np.int32)[: len(coded.dictionary) + 1].tolist(), letters.to_pybytes()
        distinct = [letters[i:j] for i, j in zip(ends, ends[1:], strict=False)]
        found = list(map(known.get, distinct))
        if None in found:
            self.learn([w for w, t in zip(distinct, found, strict=True) if t is None])
            found = [known[w] for w in distinct]
        tokens = pa.array(found, pa.large_binary()).take(coded.indices)
        ends, raw = np.frombuffer(tokens.buffers()[1], np.int64), tokens.buffers()[2].to_pybytes()
        stops = ends[bounds].tolist()
        return [raw[i:j] for i, j in zip([0, *stops], stops, strict=False)]


def cut_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and how many there are up to the end of each text.

    Marks at the end of a word behind an ASCII letter, or one from U+00C0 to U+023F, are a word of their own, unless
    the word has a marker.
    """
    data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    blank = (data == 32) | (data == 10)
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    stops = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    mark = _MARK[data]
    at = np.flatnonzero(mark[1:] & ~mark[:-1]) + 1
    last, lead = data[at - 1], data[np.maximum(at - 2, 0)]
    wide = (last >= 0x80) & (lead >= 0xC3) & (lead <= 0xC8)
    wide &= ~np.isin(lead.astype(np.int64) << 8 | last, [0xC397, 0xC3B7, 0xC4B0])  # two signs, and one that is lowered to a letter and an accent
    at = at[_LETTER[last] | wide]
    word = np.searchsorted(starts, at, "right") - 1
    before = np.cumsum(mark, dtype=np.int32)
    cut = before[stops[word] - 1] - before[at - 1] == stops[word] - at
    marker = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    cut &= ~np.isin(word, np.searchsorted(starts, marker, "right") - 1)
    edges = np.sort(np.concatenate([starts, at[cut]]))
    gone = np.cumsum(blank, dtype=np.int32)  # a slice has at most 2 GB, as a text has
    kept = data[~blank]
    offsets = np.append(edges - gone[edges], len(kept)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(edges), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return words, np.searchsorted(edges, ends)


def tokenize_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end: int = 0) -> DataFrame:
    """(doc, piece, start, length, ids_crc32): the pieces of every document; the text stays behind."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _tokenizers:
            _tokenizers[tokenizer] = WordTokens(tokenizer)
        tail = np.array([end], "<u4").tobytes()
        for part in slices(batches, "t"):
            texts = [t or b"" for t in part.column("t").cast(pa.binary()).to_pylist()]
            rows, number, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(_tokenizers[tokenizer].texts(texts)):
                ids += tail
                for j in range(0, len(ids), 4 * capacity):
                    own = ids[j : j + 4 * capacity]
                    rows.append(i)
                    number.append(j // (4 * capacity))
                    start.append(j // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc").take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("t")).mapInArrow(pieces, PIECES)


class Class(NamedTuple):
    """Neighbouring lengths that the program takes for one: their mean, how many pieces, the lengths from the longest."""

    size: int
    demand: int
    lengths: list[int]


def classes(left: np.ndarray, parts: int, width: int) -> list[Class]:
    """Lengths from the longest on share a class while it holds at most 1 / ``parts`` of the tokens and its lengths differ
    by at most 1 / ``width``: a common length stands alone."""
    groups: list[list[int]] = []
    most, mass = float(left @ np.arange(len(left))) / parts, 0
    for size in np.flatnonzero(left)[::-1].tolist():
        own = size * int(left[size])
        if not groups or mass + own > most or size * width < groups[-1][0] * (width - 1):
            groups.append([])
            mass = 0
        groups[-1].append(size)
        mass += own
    out = []
    for lengths in groups:
        demand = int(left[lengths].sum())
        out.append(Class(-(-int(left[lengths] @ np.array(lengths)) // demand), demand, lengths))
    return out


class Knapsack:
    """Most valuable configuration for given prices, by dynamic programming over the room; no class more often than it
    has pieces (its copies are items of 1, 2, 4, ... pieces)."""

    def __init__(self, of: list[Class], capacity: int):
        self.capacity = capacity
        self.items: list[tuple[int, int, int]] = []
        for i, c in enumerate(of):
            most, n = min(capacity // c.size, c.demand), 1
            while most > 0:
                n = min(n, most)
                self.items.append((i, n, c.size * n))
                most -= n
                n *= 2
        self.taken = np.zeros((len(self.items), capacity + 1), bool)

    def best(self, prices: np.ndarray) -> dict[int, int]:
        worth = np.zeros(self.capacity + 1)
        for taken, (i, n, size) in zip(self.taken, self.items, strict=True):
            total = worth[:-size] + n * prices[i]
            np.greater(total, worth[size:], out=taken[size:])
            np.maximum(total, worth[size:], out=worth[size:])
        out: dict[int, int] = {}
        room = self.capacity
        for taken, (i, n, size) in zip(self.taken[::-1], self.items[::-1], strict=True):
            if taken[room]:
                out[i] = out.get(i, 0) + n
                room -= size
        return out


def program(of: list[Class], capacity: int, rounds: int, rate: float) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Configurations ((class, number), ...) with the whole sequences that the mean of the rounds gives each; fractions
    are carried to the next."""
    demand = np.array([c.demand for c in of], float)
    bins = sum(c.size * c.demand for c in of) / capacity
    weights, chosen, knapsack = np.ones(len(of)), collections.Counter(), Knapsack(of, capacity)
    for _ in range(rounds):
        pattern = knapsack.best(weights / demand)
        chosen[tuple(sorted(pattern.items()))] += 1
        for i, n in pattern.items():
            weights[i] *= np.exp(-rate * n * bins / rounds / demand[i])
        weights /= weights.max()
    out, carry = [], 0.0
    for form, n in sorted(chosen.items(), key=lambda x: (-x[1], x[0])):
        carry += n * bins / rounds
        out.append((form, int(carry)))
        carry -= int(carry)
    return out


def best_fit(left: np.ndarray, capacity: int, first: dict[int, int] | None = None) -> dict[int, int]:
    """A sequence filled with the largest length that still fits, again and again, from what is left."""
    out = dict(first or {})
    room = capacity - sum(s * n for s, n in out.items())
    sizes = np.flatnonzero(left)
    while room > 0:
        k = int(np.searchsorted(sizes, room, side="right")) - 1
        while k >= 0 and left[sizes[k]] <= out.get(int(sizes[k]), 0):
            k -= 1
        if k < 0:
            break
        size = int(sizes[k])
        n = min(room // size, int(left[size]) - out.get(size, 0))
        out[size] = out.get(size, 0) + n
        room -= n * size
    return out


def longest(left: np.ndarray, room: int, used: dict[int, int]) -> int:
    return next((s for s in np.flatnonzero(left[: room + 1])[::-1].tolist() if left[s] > used.get(s, 0)), 0)


def fill(form: tuple[tuple[int, int], ...], of: list[Class], left: np.ndarray, capacity: int, near: int) -> tuple[dict[int, int], int] | None:
    """Real lengths for the slots of a configuration, and the tokens in slots of their class; None if a class is used up.

    A slot takes the longest of its class that leaves the later slots their means. If the last one then leaves more than
    ``near`` tokens open, the longest piece of any class that fits stands there.
    """
    out: dict[int, int] = {}
    slots = [i for i, n in form for _ in range(n)]
    room, ahead, own = capacity, sum(of[i].size for i in slots), 0
    for turn, i in enumerate(slots, 1):
        ahead -= of[i].size
        free = [s for s in of[i].lengths if s <= room and left[s] > out.get(s, 0)]
        if not free:
            return None
        size = next((s for s in free if s <= room - ahead), free[-1])
        if turn == len(slots) and room - size > near:
            size = longest(left, room, out)
        own += size if size in of[i].lengths else 0
        out[size] = out.get(size, 0) + 1
        room -= size
    return out, own


def take(left: np.ndarray, pattern: dict[int, int], times: int) -> int:
    """Takes the pattern's pieces out of ``left`` as often as they last, at most ``times``."""
    times = min([times, *(int(left[s]) // n for s, n in pattern.items())])
    for s, n in pattern.items():
        left[s] -= n * times
    return times


def by_program(left: np.ndarray, capacity: int, rounds: int, rate: float, parts: int, width: int, near: int) -> list[tuple[dict[int, int], int, int]]:
    """Patterns with their repetitions and the tokens that one repetition holds in slots of the program; what they hold is
    taken out of ``left``. The same program is solved for what its configurations leave, until they place nothing more."""
    out: list[tuple[dict[int, int], int, int]] = []
    lengths = np.arange(capacity + 1)
    while left @ lengths >= capacity:
        before, of = len(out), classes(left, parts, width)
        for form, times in program(of, capacity, rounds, rate):
            while times > 0 and (slots := fill(form, of, left, capacity, near)):
                pattern = best_fit(left, capacity, slots[0])
                n = take(left, pattern, times)
                out.append((pattern, n, slots[1]))
                times -= n
        if len(out) == before:
            break
    return out


def solve(
    histogram: dict[int, int], capacity: int = 2048, rounds: int = 600, rate: float = 40.0, parts: int = 32, width: int = 8, near: int = 4
) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> number) with their repetitions; together they hold the histogram exactly."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        left[size] = n
    patterns = [({capacity: 1}, int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    patterns += [(pattern, times) for pattern, times, _ in by_program(left, capacity, rounds, rate, parts, width, near)]
    while left.any():
        largest = int(np.flatnonzero(left)[-1])
        pattern = best_fit(left, capacity, {largest: 1})
        patterns.append((pattern, take(left, pattern, int(left[largest]))))
    return patterns


class Places(NamedTuple):
    """By (length, first number of the pieces that a pattern takes): where they go."""

    keys: np.ndarray
    first: np.ndarray
    per: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def places(patterns: list[tuple[dict[int, int], int]]) -> Places:
    rows, used, base = [], {}, 0
    for pattern, times in patterns:
        at = 0
        for size, n in sorted(pattern.items(), reverse=True):
            start = used.get(size, 0)
            rows.append((size << 44 | start, start, n, base, at))
            used[size] = start + n * times
            at += size * n
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Places(*table.T)


def pack(pieces: DataFrame, capacity: int = 2048, part: int = 50_000) -> DataFrame:
    """The pieces (doc, piece, start, length, ids_crc32) with sequence_id and offset."""
    pieces = stored(pieces, "pack-pieces")
    total = pieces.count()
    parts = max(1, -(-total // part))
    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64("doc", "piece"), F.lit(parts)))
    counts = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # at most ``capacity`` rows
    table = pieces.sparkSession.sparkContext.broadcast(places(solve(histogram, capacity)))
    before = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy("length", "_part").orderBy("doc", "piece"))
    numbered = dealt.withColumn("_place", inside).join(starts, ["length", "_part"]).select(
        "doc", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_place") - 1).alias("number")
    )

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for batch in batches:
            size, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            at = np.searchsorted(t.keys, size << 44 | number, side="right") - 1
            turn, copy = np.divmod(number - t.first[at], t.per[at])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(t.sequence[at] + turn), pa.array(t.offset[at] + copy * size)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    return numbered.mapInArrow(placed, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end: int = 0) -> DataFrame:
    packed = pack(tokenize_pieces(docs, tokenizer, key, text, capacity, end), capacity)
    return packed.withColumnRenamed("doc", key)
