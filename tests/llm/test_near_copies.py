"""The near-copy stage of the pipeline against brute force over word shingles."""

import collections
import random

from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm import mixing, near_copies
from tests.llm import corpus


def shingle_set(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def survivors(rows):
    """Smallest key of each component of similar rows, null keys last."""
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and alike(sets[i], sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    return sorted(min((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if root[i] == k) for k in set(root))


def kept(spark, rows):
    out = corpus_pipeline.near_duplicates(spark, corpus.frame(spark, rows), "").collect()
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out), out


def edited(rng, words, edits):
    """The words with single changes five and more words apart: each changes five shingles."""
    out = list(words)
    for i in rng.sample(range(5, len(words) - 5, 6), edits):
        out[i] = f"edit{rng.randrange(10**9)}"
    return " ".join(out)


def test_near_copies_are_those_of_similarity(spark):
    rng = random.Random(8)
    rows = corpus.documents()
    for family in range(12):
        words = corpus.words(rng, 300)
        for edits in (0, 4, 6, 7, 12, 20):  # similarity 1, 0.87, 0.82, 0.79, 0.66, 0.5 with the first
            rows.append([1000 + len(rows), edited(rng, words, edits), "en", "s1"])
    got, _ = kept(spark, rows)
    assert got == survivors(rows)


def test_copies_are_found_by_the_popcount_grid(spark, monkeypatch):
    """Without any band, texts of near fingerprints still go by their verified shingles."""
    rng = random.Random(6)
    near, far = corpus.words(rng, 2000), corpus.words(rng, 2000)
    rows = [[1, " ".join(near), "en", "s1"], [2, edited(rng, near, 1), "en", "s1"], [3, " ".join(far), "en", "s1"], [4, "", "en", "s1"], [5, None, "en", "s1"]]
    whole = near_copies.band_rows
    monkeypatch.setattr(near_copies, "band_rows", lambda sets, likely=None: whole(sets, likely).limit(0))
    got, _ = kept(spark, rows)
    assert got == survivors(rows) == [(False, 1), (False, 3), (False, 4)]


def test_groups_in_mixed_bands_are_whole(spark):
    rng = random.Random(3)
    words = corpus.words(rng, 300)
    rows = [[i, edited(rng, words, 3 + i % 5), "en", "s1"] for i in range(60)]
    got, _ = kept(spark, rows)
    assert got == survivors(rows) and 1 < len(got) < 60


def test_copies_of_one_text_meet_at_their_hub(spark):
    """2,000 different near copies of one text, each unlike most others: they are one group, and no pair of them is verified twice."""
    rng = random.Random(14)
    words = corpus.words(rng, 300)
    rows = [[0, " ".join(words), "en", "s1"]] + [[i, edited(rng, words, 5 + i % 2), "en", "s1"] for i in range(1, 2001)]
    rows += [[5000 + i, edited(rng, words, 14), "en", "s1"] for i in range(40)]
    got, _ = kept(spark, rows)
    assert got == [(False, 0)] + [(False, 5000 + i) for i in range(40)]


def test_bound_never_drops_a_similar_pair(spark):
    rng = random.Random(15)
    words = corpus.words(rng, 300)
    sets = [near_copies.shingles(edited(rng, words[: rng.randint(200, 300)], rng.randint(0, 12)).encode()) for _ in range(80)] + [near_copies.shingles(b"")]
    rows = [(i, len(s), near_copies.parities(s).tolist()) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "a long, n long, x array<long>")
    pairs = frame.join(frame.select(F.col("a").alias("b"), F.col("n").alias("m"), F.col("x").alias("y")), F.col("a") < F.col("b"))
    left = {(r["a"], r["b"]) for r in pairs.where(near_copies.may_be_similar("n", "m", "x", "y")).select("a", "b").collect()}
    true = {(i, j) for j in range(80) for i in range(j) if near_copies.similar(sets[i], sets[j])}
    assert true <= left and len(left) < 1.5 * len(true) + 40


def test_repeated_and_null_ids_are_judged_row_by_row(spark):
    rng = random.Random(6)
    a, b, c, d = (corpus.prose(rng, 80) for _ in range(4))
    rows = [[1, a, "en", "s1"], [2, b, "en", "s1"], [2, a, "en", "s1"], [2, c, "en", "s1"], [3, c, "en", "s1"], [3, c, "en", "s1"]]
    rows += [[None, d, "en", "s1"], [None, d, "en", "s1"], [None, b, "en", "s1"], [4, b.upper(), "en", "s1"]]
    _, out = kept(spark, rows)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out) == sorted([(1, a), (2, b), (2, c), (0, d)])


def test_rows_that_share_an_id_keep_their_copies(spark):
    rng = random.Random(2)
    rows = [[i // 3 if i % 10 else None, corpus.prose(rng, rng.randint(20, 90)), "en", f"s{i % 4}"] for i in range(60)]
    rows += [list(rows[5]), list(rows[5]), list(rows[10])]
    docs = corpus.frame(spark, rows)
    out = corpus_pipeline.source_mix(spark, docs, "").collect()
    want = sum(r["copies"] for r in mixing.mix(docs).collect())
    assert 0 < want == len(out) and max(collections.Counter(r["text"] for r in out).values()) <= 9
