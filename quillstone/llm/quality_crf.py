"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are its own shape (length, capitals, digits, symbols, repeated words, ...) and
that of the lines beside it; a transition weight ties neighbouring labels. Forward-backward gives each line's marginal
probability of being good, and the length-weighted mean of the marginals is the score of the document.

The field is fitted on a bounded sample of labelled documents, whose lines all take the label of their document:
``max_docs`` documents by hash order, and of these the ones with at most ``max_lines`` lines. The driver holds their
line features only, at most max_docs * max_lines * 40 bytes. Scoring reads every whole text, line by line, without a
shuffle; its model is a few hundred bytes.

Defined results: a null or empty text is one empty line; equal texts get equal scores; null labels and null ids are
not learned from, and of several labels of a document the largest counts; without labelled documents every score is
0.5; an empty table gives an empty result. All columns of the input are kept; a column with the name of the score is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.arrow_text import bytes_list, prefix_hashes, slices, span_hashes, with_column

N_SHAPE = 10
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF8)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:'\"()-?"]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not (_LETTER[c] or _DIGIT[c] or _MARK[c]) and c != ord("!")]] = True


class Lines(NamedTuple):
    shape: np.ndarray  #: line by feature
    length: np.ndarray  #: bytes of each line
    first: np.ndarray  #: number of the first line of each document
    count: np.ndarray  #: lines of each document


def line_shapes(texts: list[bytes]) -> Lines:
    """Features of every line of the texts, by whole-array operations over their bytes."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    doc_end = np.cumsum([len(t) + 1 for t in texts]) - 1
    last = np.searchsorted(ends, doc_end)
    first = np.concatenate([[0], last[:-1] + 1])

    per_line = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64).astype(float)
    before = np.concatenate([[np.uint8(10)], data[:-1]])
    space = (data == 32) | (data == 10) | (data == 9) | (data == 13)
    upper = _UPPER[data] | ((before == 0xC3) & (data >= 0x80) & (data < 0x9F))
    begins = ~space & ((before == 32) | (before == 10) | (before == 9) | (before == 13))
    w0 = np.flatnonzero(begins)
    w1 = np.flatnonzero(space & ~((before == 32) | (before == 10) | (before == 9) | (before == 13)))
    prefix = prefix_hashes(data)
    words = span_hashes(prefix, w0, w1)
    again = np.zeros(len(data), bool)
    again[w0[1:]] = words[1:] == words[:-1]

    chars = per_line((data & 0xC0) != 0x80) - 1
    letters, n_words = per_line(_LETTER[data]), per_line(begins)
    some, per_letter, per_word = np.maximum(chars, 1), np.maximum(letters, 1), np.maximum(n_words, 1)
    lines = span_hashes(prefix, starts, ends)
    same = np.zeros(len(starts))
    same[1:] = (lines[1:] == lines[:-1]) & (chars[1:] > 0)
    same[first] = 0
    shape = np.stack(
        [
            np.log1p(chars),
            per_line(upper) / per_letter,
            per_line(_DIGIT[data]) / some,
            per_line(_SYMBOL[data]) / some,
            per_line(data == ord("!")) / per_word,
            per_line(_MARK[data]) / per_word,
            letters / per_word / 10,
            per_line(again) / per_word,
            same,
            (chars <= 0).astype(float),
        ],
        axis=1,
    )
    return Lines(shape, (ends - starts).astype(float), first, last - first + 1)


def node_features(lines: Lines) -> np.ndarray:
    """Each line's shape beside those of the lines before and after it in its document."""
    shape = lines.shape
    n = len(shape)
    head, tail = np.zeros(n), np.zeros(n)
    head[lines.first] = 1
    tail[lines.first + lines.count - 1] = 1
    prev = np.vstack([np.zeros((1, N_SHAPE)), shape[:-1]]) * (1 - head)[:, None]
    after = np.vstack([shape[1:], np.zeros((1, N_SHAPE))]) * (1 - tail)[:, None]
    return np.hstack([shape, prev, after, head[:, None], tail[:, None]])


class Field(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  #: of the node features, bias last
    ties: np.ndarray  #: 2 by 2, from label to label

    def odds(self, nodes: np.ndarray) -> np.ndarray:
        return np.clip((nodes - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]


def forward_backward(odds: np.ndarray, ties: np.ndarray, first: np.ndarray, count: np.ndarray):
    """Marginals (line by label) and, for lines after a first one, pair marginals (line by label by label).

    Documents go side by side, longest first, so step t is one array operation over those that have a line t.
    """
    order = np.argsort(-count, kind="stable")
    starts, lengths = first[order], count[order]
    node = np.stack([1 / (1 + np.exp(np.clip(odds, -60, 60))), 1 / (1 + np.exp(-np.clip(odds, -60, 60)))], axis=1)
    move = np.exp(ties - ties.max())
    fore, back = np.empty_like(node), np.ones_like(node)
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    for t, k in enumerate(active):
        at = starts[:k] + t
        a = node[at] * (fore[at - 1] @ move if t else 1.0)
        fore[at] = a / a.sum(1, keepdims=True)
    for t in range(len(active) - 1, 0, -1):
        at = starts[: active[t]] + t
        b = (node[at] * back[at]) @ move.T
        back[at - 1] = b / b.sum(1, keepdims=True)
    single = fore * back
    single /= single.sum(1, keepdims=True)
    pair = np.zeros((len(node), 2, 2))
    pair[1:] = fore[:-1, :, None] * move * (node[1:] * back[1:])[:, None, :]
    pair[first] = 0
    total = pair.sum((1, 2), keepdims=True)
    return single, np.divide(pair, total, out=pair, where=total > 0)


def fit(lines: Lines, labels: np.ndarray, rounds: int = 150, rate: float = 0.15, l2: float = 1e-3) -> Field:
    """Gradient ascent (Adam) on the likelihood of the lines' labels; each document weighs the same."""
    nodes = node_features(lines)
    mean, scale = nodes.mean(0), nodes.std(0) + 1e-3
    x = np.hstack([np.clip((nodes - mean) / scale, -8, 8), np.ones((len(nodes), 1))])
    y = np.repeat(labels, lines.count).astype(int)
    weight = np.repeat(1 / lines.count, lines.count) / len(labels)
    inner = np.ones(len(y), bool)
    inner[lines.first] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), weight[inner])
    theta, m, v = np.zeros(x.shape[1] + 4), 0.0, 0.0
    for i in range(1, rounds + 1):
        single, pair = forward_backward(x @ theta[:-4], theta[-4:].reshape(2, 2), lines.first, lines.count)
        slope = np.concatenate([x.T @ (weight * (y - single[:, 1])), (seen - (weight[:, None, None] * pair).sum(0)).ravel()]) - l2 * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return Field(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))


def document_scores(texts: list[bytes], field: Field) -> np.ndarray:
    lines = line_shapes(texts)
    single, _ = forward_backward(field.odds(node_features(lines)), field.ties, lines.first, lines.count)
    weight = lines.length + 1
    return np.add.reduceat(single[:, 1] * weight, lines.first) / np.add.reduceat(weight, lines.first)


def learn_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_docs: int = 3000,
    max_lines: int = 400,
) -> Field | None:
    """The field fitted on a bounded sample of the labelled documents, one text for each id; None if there are none."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    sample = known.orderBy(F.xxhash64("k"), "k").limit(max_docs)
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), "k")  # max_docs rows
    one = F.max(F.struct(F.xxhash64("t"), "t"))["t"]
    rows = found.groupBy("k", "y").agg(one.alias("t"))
    shapes = rows.select("y", "t").mapInArrow(_shapes_of(max_lines), "y long, shape binary")
    pdf = shapes.toPandas().sort_values(["y", "shape"], ignore_index=True)  # max_docs rows of max_lines lines, in one order
    if not len(pdf):
        return None
    parts = [np.frombuffer(s, np.float32).reshape(-1, N_SHAPE).astype(float) for s in pdf["shape"]]
    count = np.array([len(p) for p in parts])
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    return fit(Lines(np.vstack(parts), np.zeros(int(count.sum())), first, count), (pdf["y"] > 0).to_numpy())


def _shapes_of(max_lines: int):
    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            lines = line_shapes(bytes_list(part.column("t")))
            kept = np.flatnonzero(lines.count <= max_lines)
            whole = lines.shape.astype(np.float32)
            data = [whole[lines.first[i] : lines.first[i] + lines.count[i]].tobytes() for i in kept]
            yield pa.RecordBatch.from_arrays(
                [part.column("y").take(pa.array(kept)).cast(pa.int64()), pa.array(data, pa.binary())], names=["y", "shape"]
            )

    return shapes


def score_quality(docs: DataFrame, field: Field | None, text: str = "text", name: str = "score") -> DataFrame:
    """The documents with the score of their whole text."""
    kept = docs.drop(name)
    if field is None:
        return kept.withColumn(name, F.lit(0.5))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            yield with_column(part, name, pa.array(document_scores(bytes_list(part.column(text)), field), pa.float64()))

    return kept.mapInArrow(scored, T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())]))
