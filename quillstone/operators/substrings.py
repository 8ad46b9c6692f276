"""How often terms stand in texts, and which texts score best for many queries.

All windows of a text that are as long as a term are hashed at once, from sums over the bytes of the text. Windows whose
hash is that of a term are compared with it byte by byte, so the counts are exact. A term that can overlap itself is
counted from the left, as a replacement would find it. Scores are products of two tables, documents by terms and terms by
queries: the terms that most queries ask are multiplied as dense blocks, the others entry by entry.

A task holds a block of queries and a group of documents of at most ``GROUP`` bytes and ``CELLS`` scores. It gives the best documents of each query that it
has seen; a document that scores less than what a query has already is left out as soon as its score is known.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillstone.operators.spans import BASE, Hashed, bytes_of, ends_of

BLANK = 32
PIECE = 1 << 18  #: bytes that are hashed at once, unless one word has more
GROUP = 4 << 20  #: bytes of the documents of a group, or one document
CELLS = 1 << 22  #: scores that are held at once
DENSE = 256  #: terms that are multiplied as blocks
BITS = 18  #: of the table that tells whether a hash may be that of a term
KEPT = 200_000  #: candidates above the best that are kept before they are cut


class Terms(NamedTuple):
    """The terms of one length, ordered by their hash."""

    size: int
    hashes: np.ndarray
    ids: np.ndarray
    letters: np.ndarray  #: a row for each place in a term
    period: np.ndarray  #: the least distance at which a term can overlap itself, or its length
    likely: np.ndarray


class Asked(NamedTuple):
    """A block of queries: the terms by length, the queries that ask a term, and the dense part."""

    queries: pa.Array
    lengths: list[Terms]
    start: np.ndarray
    query: np.ndarray
    times: np.ndarray
    dense: np.ndarray  #: the row of a term in the dense part, or -1
    table: np.ndarray


def places_of(h: np.ndarray) -> np.ndarray:
    """Where hashes stand in a table of ``BITS`` bits."""
    return (h * np.uint64(BASE)) >> np.uint64(64 - BITS)


def periods(letters: np.ndarray) -> np.ndarray:
    size = letters.shape[1]
    out = np.full(len(letters), size)
    for p in range(size - 1, 0, -1):
        out[(letters[:, p:] == letters[:, :-p]).all(1)] = p
    return out


def asked_of(rows: pa.Table) -> Asked:
    """``rows`` are (query_id, term, times), one for each query and term."""
    rows = rows.combine_chunks()
    column = lambda name: rows.column(name).combine_chunks()
    coded, own = column("term").dictionary_encode(), column("query_id").dictionary_encode(null_encoding="encode")
    term, query, times = coded.indices.to_numpy(), own.indices.to_numpy(), column("times").to_numpy().astype(float)
    data, ends = bytes_of(coded.dictionary)
    runs, sizes = Hashed(data), np.diff(ends)
    hashes = (runs.sums[ends[1:]] - runs.sums[ends[:-1]]) * runs.back[ends[:-1]]
    lengths = []
    for size in np.unique(sizes).tolist():
        ids = np.flatnonzero(sizes == size)
        ids = ids[np.argsort(hashes[ids])]
        letters, likely = data[ends[ids][:, None] + np.arange(size)], np.zeros(1 << BITS, bool)
        likely[places_of(hashes[ids])] = True
        lengths.append(Terms(size, hashes[ids], ids, np.ascontiguousarray(letters.T), periods(letters), likely))
    order, n = np.argsort(term, kind="stable"), np.bincount(term, minlength=len(sizes))
    often = np.argsort(-n, kind="stable")[:DENSE]
    dense = np.full(len(sizes), -1)
    dense[often] = np.arange(len(often))
    table, block = np.zeros((len(often), len(own.dictionary))), dense[term] >= 0
    table[dense[term[block]], query[block]] = times[block]
    return Asked(own.dictionary, lengths, np.append(0, np.cumsum(n)), query[order], times[order], dense, table)


def apart(at: np.ndarray, term: np.ndarray, size: int, period: np.ndarray) -> np.ndarray:
    """Which of the places, in order, are counted if each term is looked for from the left and never overlaps itself."""
    kept = np.ones(len(at), bool)
    some = np.flatnonzero(period < size)
    some = some[np.argsort(term[some], kind="stable")]
    near = np.flatnonzero((term[some][1:] == term[some][:-1]) & (np.diff(at[some]) < size)) + 1
    last, end = -1, 0  # the place before, and where the counted one before it ends
    for i in near.tolist():
        if last != i - 1:
            end = at[some[i - 1]] + size
        if at[some[i]] < end:
            kept[some[i]] = False
        else:
            end = at[some[i]] + size
        last = i
    return kept


def places(data: np.ndarray, asked: Asked) -> tuple[np.ndarray, np.ndarray]:
    """Where in the bytes a term is counted, and which."""
    runs, where, found = Hashed(data), [], []
    for t in asked.lengths:
        windows = len(data) - t.size + 1
        if windows <= 0:
            continue
        h = (runs.sums[t.size :] - runs.sums[:windows]) * runs.back[:windows]
        at = np.flatnonzero(t.likely[places_of(h)])
        k = np.minimum(np.searchsorted(t.hashes, h[at]), len(t.hashes) - 1)
        same = t.hashes[k] == h[at]
        at, k = at[same], k[same]
        same = np.ones(len(at), bool)
        for j, letter in enumerate(t.letters):
            same &= data[at + j] == letter[k]
        at, k = at[same], k[same]
        kept = apart(at, k, t.size, t.period[k])
        where.append(at[kept])
        found.append(t.ids[k[kept]])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *where]), np.concatenate([empty, *found])


def pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of the bytes that end at blanks."""
    start = 0
    while start < len(data):
        stop = min(start + PIECE, len(data))
        if stop < len(data):
            blanks = np.flatnonzero(data[start:stop] == BLANK)
            if len(blanks):
                stop = start + int(blanks[-1]) + 1
            else:
                while stop < len(data) and data[stop] != BLANK:
                    stop += 1
        yield start, stop
        start = stop


def counts(texts: pa.Array, asked: Asked) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, n). Words of a text are separated by blanks, and a text ends with one."""
    data, ends = bytes_of(texts)
    terms, keys, n = len(asked.dense), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start, stop in pieces(data):
        at, term = places(data[start:stop], asked)
        own, often = np.unique((np.searchsorted(ends, at + start, "right") - 1) * terms + term, return_counts=True)
        keys.append(own)
        n.append(often)
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(n), minlength=len(key))
    return key // max(terms, 1), key % max(terms, 1), total


def scores(docs: int, doc: np.ndarray, term: np.ndarray, n: np.ndarray, asked: Asked) -> np.ndarray:
    """The sum of count times weight for each document and query."""
    queries, row = len(asked.queries), asked.dense[term]
    block = np.zeros((docs, len(asked.table)))
    block[doc[row >= 0], row[row >= 0]] = n[row >= 0]
    out = (block @ asked.table).ravel()
    rare = np.flatnonzero(row < 0)
    size = np.diff(asked.start)[term[rare]]
    ends, first = np.cumsum(size), 0
    while first < len(rare):
        stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CELLS, "right")))
        some, each = rare[first:stop], size[first:stop]
        of = np.repeat(np.arange(len(some)), each)
        at = asked.start[term[some]][of] + np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
        np.add.at(out, doc[some][of] * queries + asked.query[at], n[some][of] * asked.times[at])
        first = stop
    return out.reshape(docs, queries)


def groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The documents in order, at most ``most`` at once."""
    for batch in batches:
        where, start = ends_of(batch.column(1)), 0
        while start < len(batch):
            stop = max(start + 1, min(start + most, int(np.searchsorted(where, where[start] + GROUP, "right")) - 1))
            yield batch.slice(start, stop - start)
            start = stop


def best_of(batches: Iterator[pa.RecordBatch], asked: Asked, names: list[str], limit: int | None) -> Iterator[pa.RecordBatch]:
    """(query, document, score) of (document, text): the ``limit`` best documents that a task has for each query, or all."""
    queries = len(asked.queries)
    if not queries:
        return
    least, found = np.zeros(queries), []
    held = 0
    for part in groups(batches, max(1, CELLS // queries)):
        score = scores(len(part), *counts(part.column(1), asked), asked)
        doc, query = np.nonzero((score > 0) & (score >= least))
        found.append(pa.table({"query": query, "doc": part.column(0).take(pa.array(doc)), "score": score[doc, query]}))
        held += len(doc)
        if limit is None or held > KEPT + 2 * limit * queries:
            rows = cut(found, limit)
            if limit is None:
                yield from answers(rows, asked, names)
                found, held = [], 0
                continue
            found, held = [rows], len(rows)
            own, value = rows.column("query").to_numpy(), rows.column("score").to_numpy()
            full = np.bincount(own, minlength=queries) >= limit
            low = np.full(queries, np.inf)
            np.minimum.at(low, own, value)
            least = np.where(full, low, 0.0)
    if found:
        yield from answers(cut(found, limit), asked, names)


def cut(found: list[pa.Table], limit: int | None) -> pa.Table:
    rows = pa.concat_tables(found).combine_chunks()
    if limit is None or not len(rows):
        return rows
    rows = rows.take(pc.sort_indices(rows, [("query", "ascending"), ("score", "descending"), ("doc", "ascending")]))
    own = rows.column("query").to_numpy()
    return rows.filter(pa.array(np.arange(len(own)) - np.searchsorted(own, own) < limit))


def answers(rows: pa.Table, asked: Asked, names: list[str]) -> Iterator[pa.RecordBatch]:
    query = asked.queries.take(rows.column("query").combine_chunks())
    yield from pa.table([query, rows.column("doc"), rows.column("score")], names=names).to_batches(max_chunksize=100_000)
