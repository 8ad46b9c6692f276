"""The passage stage of the pipeline against brute force over windows of 51 words."""

import collections
import hashlib
import random

from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm import near_copies, suffix_dedup
from quillstone.llm.bit_filter import BitFilter
from tests.llm import corpus

WINDOW = 51


def brute_force(texts):
    """The words of each text that no repeated window covers."""
    split = [(t or "").split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + WINDOW]) for w in split for i in range(len(w) - WINDOW + 1))
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - WINDOW + 1):
            if seen[tuple(w[i : i + WINDOW])] > 1:
                gone[i : i + WINDOW] = [True] * WINDOW
        yield [x for x, g in zip(w, gone, strict=True) if not g]


def test_passages_of_over_50_words_go(spark):
    rng = random.Random(11)
    rows = corpus.documents()
    planted = {}
    for n in (50, *range(51, 71)):
        short = n % 2  # passages of short words too, of some 150 bytes
        passage = ["".join(rng.choice("abcdefgh") for _ in range(2)) if short else corpus.words(rng, 1)[0] for _ in range(n)]
        planted[n] = passage
        for place in range(3):
            text = f"{corpus.prose(rng, 40)} {(' ' if place else '  ').join(passage)}\n{corpus.prose(rng, 30 * place)}"
            rows.append([2000 + len(rows), text, "en", "s1"])
    out = corpus_pipeline.repeated_passages(spark, corpus.frame(spark, rows), "").collect()
    want = collections.Counter((r[0], *w) for r, w in zip(rows, brute_force([r[1] for r in rows]), strict=True))
    assert collections.Counter((r["doc_id"], *(r["text"] or "").split()) for r in out) == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in out if r["text"] is not None)
    left = " ".join(" ".join((r["text"] or "").split()) for r in out)
    assert [n for n, p in planted.items() if " ".join(p) in left] == [50]


def periodic():
    """Texts that repeat a word or a phrase, some alike, some with other words at their ends or in between."""
    rng = random.Random(4)
    rows = []
    for i in range(24):
        phrase = corpus.words(rng, 1 + i % 5) if i % 3 else ["ab", "cd", "ef"][: 1 + i % 2]
        own = " ".join(phrase * rng.randint(20, 1500 if i % 8 == 0 else 90))
        rows.append([3000 + i, f"{corpus.prose(rng, i % 4 * 9)} {own} {corpus.prose(rng, i % 3 * 30)} {own[: 40 * i]}", "en", "s1"])
    rows.append([3100, " ".join(["ab"] * 50000), "en", "s1"])
    return rows


def test_periodic_texts_lose_the_same_words(spark):
    rows = periodic() + corpus.documents()
    out = corpus_pipeline.repeated_passages(spark, corpus.frame(spark, rows), "").collect()
    want = collections.Counter((r[0], *w) for r, w in zip(rows, brute_force([r[1] for r in rows]), strict=True))
    assert collections.Counter((r["doc_id"], *(r["text"] or "").split()) for r in out) == want


def test_periodic_texts_lose_the_same_bytes(spark):
    rows = [r for r in periodic() if r[0] != 3100]
    rows.append([3101, "xyzzy " * 3000, "en", "s1"])
    length, seen = 400, collections.Counter()
    texts = [r[1].encode() for r in rows]
    for t in texts:
        seen.update(t[i : i + length] for i in range(len(t) - length + 1))
    want = {}
    for r, t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        want[r[0]] = (sum(gone), bytes(x for x, g in zip(t, gone, strict=True) if not g))
    got = suffix_dedup.repeats(corpus.frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in got} == {
        k: (n, hashlib.sha256(kept).hexdigest()) for k, (n, kept) in want.items()
    }


def test_periodic_texts_send_few_windows(spark):
    """A text of one repeated word has one anchor row at each end of its run and sends one window."""
    docs = corpus.frame(spark, [[i, "ab " * (700 + i), "en", "s1"] for i in range(9)])
    info = suffix_dedup.describe(docs, "doc_id", "text", 51, True)
    assert suffix_dedup.anchor_rows(info, 51).count() <= 2 * 9
    wanted = suffix_dedup.anchor_groups(info, 51, BitFilter(suffix_dedup.anchor_rows(info, 51), "g"))
    asked = wanted.groupBy("t1", "t2", "docno").agg(F.collect_list(F.struct("g", F.lit(1).alias("parts"), "places")).alias("wanted"))
    texts = docs.select(F.xxhash64("doc_id").alias("docno"), F.col("text").alias("t")).join(asked, "docno")
    rows = suffix_dedup.window_rows(texts, 51, True).collect()
    assert sorted((r["part"], len(r["at"])) for r in rows) == [(-1, 4)] * 9 + [(0, 4)] * 9


def test_helper_columns_do_not_clash(spark):
    names = "kept t1 t2 _t1 _t2 own_t1 __kept _text_name text_name _stays stays _name name _key".split()
    rng = random.Random(9)
    passage = corpus.prose(rng, 80)
    rows = [(i, f"{corpus.prose(rng, 50)} {passage}" if i < 4 else "same words in both " * 3, len(""), *names) for i in range(6)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "n_chars", *names])
    near = near_copies.drop_near_copies(docs)
    assert near.columns == docs.columns and sorted(r["doc_id"] for r in near.collect()) == [0, 1, 2, 3, 4]
    cut = suffix_dedup.drop_repeats(docs, length=51, words=True).collect()
    assert len(cut) == 6 and all(r["kept"] == "kept" and passage not in r["text"] for r in cut)


def test_characters_without_spaces_are_words():
    text = " ab 日本語x 한국 don’t กข\n".encode()
    words = [text[a:b].decode() for a, b in zip(*suffix_dedup.word_bounds(text), strict=True)]
    assert words == ["ab", "日", "本", "語", "x", "한국", "don’t", "ก", "ข"]
    assert [len(x) for x in suffix_dedup.word_bounds(b"")] == [0, 0]
