"""Mixture-controlled packing against the tokenizer and a plain deficit round-robin."""

import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillstone.llm import mixture_packing
from quillstone.llm.byte_tokens import ByteTokens
from quillstone.llm.queries import QUERIES
from tests.llm import corpus

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(tokenizer, text, end=1):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def held(rows, docs, capacity):
    """Each id in one piece, hashes right, sequences gapless and full or a power of two; returns tokens by sequence and source."""
    tokenizer = Tokenizer.from_file(VOCABULARY)
    own = defaultdict(list)
    for r in rows:
        own[r.doc_id, r.doc_tokens, r.source].append(r)
    expected = defaultdict(int)
    for doc_id, text, source in docs:
        ids = ids_of(tokenizer, text)
        expected[doc_id, len(ids), source] += 1
    assert {k: sum(r.length for r in v) for k, v in own.items()} == {k: k[1] * n for k, n in expected.items()}
    texts = defaultdict(list)
    for doc_id, text, source in docs:
        texts[doc_id].append(ids_of(tokenizer, text))
    for r in rows:
        assert r.length > 0 and any(zlib.crc32(i[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for i in texts[r.doc_id] if len(i) == r.doc_tokens)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    mixed = defaultdict(lambda: defaultdict(int))
    short = 0
    for number, pieces in sequences.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
            mixed[number][r.source] += r.length
        assert at <= capacity and at & (at - 1) == 0
        short += at < capacity
    assert short <= capacity.bit_length()
    return mixed


def test_whole_corpus(spark):
    rows = corpus.documents()
    docs = [(r[0], r[1], r[3]) for r in rows]
    out = mixture_packing.pack_mixture(corpus.frame(spark, rows).repartition(5), VOCABULARY, capacity=256, least=2).collect()
    mixed = held(out, docs, 256)
    total = sum(r.length for r in out)
    size = {s: sum(r.length for r in out if r.source == s) for s in {d[2] for d in docs}}
    small = {s for s in size if size[s] * 256 < 2 * total}
    smallest = min(set(size) - small, key=size.get)  # small sources stand in its queue
    queue = {s: smallest if s in small else s for s in size}
    share = {q: Fraction(sum(n for s, n in size.items() if queue[s] == q), total) for q in set(queue.values())}
    given = dict.fromkeys(share, 0)
    for number in range(total // 256):  # every prefix of windows is within a token of the shares, so is every window within two
        for q in share:
            given[q] += sum(n for s, n in mixed[number].items() if queue[s] == q)
            assert abs(given[q] - share[q] * 256 * (number + 1)) < 1


def test_registered_query(spark):
    out = QUERIES["op11_deficit_packing"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source").collect()
    held(out, [tuple(d) for d in docs], 2048)
    again = QUERIES["op11_deficit_packing"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)


def test_targets_and_ids(spark):
    rng = random.Random(2)
    docs = [(i, corpus.prose(rng, rng.randint(1, 90)), ("a", "b", "c", None)[i % 4]) for i in range(80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = mixture_packing.pack_mixture(frame, VOCABULARY, capacity=128, targets={"a": 3.0, "b": 1.0, None: 1.0}, least=1, with_ids=True).collect()
    mixed = held(out, docs, 128)
    first = [mixed[i] for i in range(8)]  # before a queue runs dry
    assert all(abs(w["a"] - 3 * w["b"]) <= 6 for w in first)
    tokenizer = Tokenizer.from_file(VOCABULARY)
    for r in out:
        assert r.ids == ids_of(tokenizer, docs[r.doc_id][1])[r.start : r.start + r.length].tolist()


def test_many_sources_share_a_queue(spark):
    docs = [(i, "word " * (400 if i % 10 == 0 else 3), "big" if i % 10 == 0 else f"host{i}") for i in range(600)]
    out = mixture_packing.pack_mixture(spark.createDataFrame(docs, "doc_id long, text string, source string"), VOCABULARY).collect()
    held(out, docs, 2048)


def test_empty_and_single(spark):
    assert mixture_packing.pack_mixture(corpus.empty(spark), VOCABULARY).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [(r.length, r.doc_tokens, r.offset) for r in mixture_packing.pack_mixture(one, VOCABULARY).collect()] == [(1, 1, 0)]


def plain_round_robin(totals, capacity):
    """Window after window: earn, take whole tokens, then the largest fractions."""
    total, owed, given, out = sum(totals), [Fraction(0)] * len(totals), [0] * len(totals), []
    for at in range(0, total, capacity):
        room = min(capacity, total - at)
        owed = [o + Fraction(t * room, total) for o, t in zip(owed, totals, strict=True)]
        take = [o.numerator // o.denominator for o in owed]
        order = sorted(range(len(totals)), key=lambda q: (take[q] - owed[q], q))
        for q in order[: room - sum(take)]:
            take[q] += 1
        owed = [o - t for o, t in zip(owed, take, strict=True)]
        given = [g + t for g, t in zip(given, take, strict=True)]
        out.append(list(given))
    return out


@pytest.mark.parametrize("totals", [[5000, 3000, 777], [100_000, 1], [64 * 3], [9, 8, 7, 6, 5], [10**6 + 7, 10**5 + 3, 31_337]])
def test_resumed_anywhere(totals):
    """The round-robin resumed at any window is the one that ran from the first."""
    robin = mixture_packing.RoundRobin(mixture_packing.phases(totals), 64)
    expected = [[0] * len(totals), *plain_round_robin(totals, 64)]
    assert robin.at_start(0, robin.windows).tolist() == expected
    for first in range(0, robin.windows, max(1, robin.windows // 20)):
        assert robin.at_start(first, robin.windows)[0].tolist() == expected[first]
    parts = mixture_packing.phases(totals, [1.0] * len(totals))
    weighted = mixture_packing.RoundRobin(parts, 64).at_start(0, robin.windows)
    assert (np.diff(weighted, axis=0) >= 0).all() and weighted[-1].tolist() == totals


def test_byte_tokens():
    tokenizer, tokens = Tokenizer.from_file(VOCABULARY), ByteTokens(VOCABULARY)
    assert tokens.plain is not None
    rng = random.Random(4)
    alphabet = [" ", "  ", "\n", "\t", "\r\n", " ", "　", "a", "Bc", "don't", "12", "é", "ß", "漢", "!", "<|endoftext|>", "<|", "\x1c", "\x85", "🙂", "´", "'ll"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(tokens.encode(text), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert ByteTokens(public_tokenizers.path("word_bpe_49k.json")).plain is None  # not a byte vocabulary: the library itself
