"""Operators on documents against brute force, with every edge case of the small corpus."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillstone.llm import langid, mixing, packing, quality_crf, search, simhash, suffix_dedup
from tests.llm import corpus

ROWS = corpus.documents()
public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return corpus.empty(spark)


def data(df):
    return [r.asDict() for r in df.collect()]


def ranked_auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_quality(spark, docs, nothing):
    labels = spark.createDataFrame(corpus.labels(ROWS), corpus.LABELS)
    field = quality_crf.learn_quality(docs, labels)
    out = data(quality_crf.score_quality(docs, field))
    assert len(out) == len(ROWS) and set(out[0]) == set(docs.columns)
    assert all(0 <= r["score"] <= 1 for r in out)
    texts = {r["text"]: r["score"] for r in out}
    assert all(texts[r["text"]] == r["score"] for r in out)
    unseen = [(r["score"], "$$$" not in (r["text"] or "")) for r in out if r["doc_id"] is not None and r["doc_id"] % 3 == 1]
    assert ranked_auc(unseen) > 0.95
    assert quality_crf.learn_quality(docs, labels.limit(0)) is None
    assert {r["score"] for r in data(quality_crf.score_quality(docs, None))} == {0.5}
    assert data(quality_crf.score_quality(nothing, field)) == []


def test_forward_backward_sums_over_all_labellings():
    rng = np.random.default_rng(1)
    odds, ties = rng.normal(size=7), rng.normal(size=(2, 2))
    first, count = np.array([0, 4]), np.array([4, 3])
    single, pair = quality_crf.forward_backward(odds, ties, first, count)
    for f, n in zip(first, count, strict=True):
        total, want, want_pair = 0.0, np.zeros((n, 2)), np.zeros((n, 2, 2))
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            p = math.exp(sum(odds[f + i] * y[i] for i in range(n)) + sum(ties[y[i - 1], y[i]] for i in range(1, n)))
            total += p
            for i in range(n):
                want[i, y[i]] += p
                if i:
                    want_pair[i, y[i - 1], y[i]] += p
        assert np.allclose(single[f : f + n], want / total)
        assert np.allclose(pair[f + 1 : f + n], want_pair[1:] / total)


def test_languages(docs, nothing):
    model = langid.learn_languages(docs.where("doc_id % 4 <> 2"))
    assert model.languages == ["en", "fr"]
    out = data(langid.identify(docs, model))
    assert len(out) == len(ROWS)
    for r in out:
        letters = any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] % 4 == 2 and r["lang_pred"] != "und" and r["lang"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held if len(r["text"].split()) > 5 and "ab ab" not in r["text"]]) > 0.85
    assert data(langid.identify(nothing, model)) == []
    unlearned = langid.learn_languages(nothing)
    assert {r["lang_pred"] for r in data(langid.identify(docs, unlearned))} == {"und"}


def test_backoff_takes_the_longest_known_grams():
    model = langid.Model("m", ["a", "b"], {"known": 0}, {"<xy": 1, "xy": 2, "y": 3}, np.log([[0.9, 0.1], [0.8, 0.2], [0.3, 0.7], [0.5, 0.5]]))
    scorer = langid.Scorer(model)
    assert np.allclose(scorer.table[scorer.learn("xyz")], np.log([0.8, 0.2]))
    assert np.allclose(scorer.table[scorer.learn("qxyq")], np.log([0.3, 0.7]))
    assert np.allclose(scorer.table[scorer.learn("yy")], np.log([0.5, 0.5]))
    assert np.allclose(scorer.table[scorer.learn("qqq")], 0)
    assert scorer.predict("known")[0] == "a" and scorer.predict("1 2 ²") == ("und", 0.0)


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    out = data(packing.pack_documents(docs, TOKENIZER))
    want = collections.Counter()
    for i, text, *_ in ROWS:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            own = ids[k : k + 2048]
            want[i, k // 2048, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    by = collections.defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= 2048
    assert len(by) <= math.ceil(sum(r["length"] for r in out) / 2048) + 1
    assert data(packing.pack_documents(nothing, TOKENIZER)) == []


def test_words_and_their_marks():
    """Marks behind a letter are words of their own, so the tokenizer sees a word once, whatever follows it."""
    from tokenizers import Tokenizer

    whole, some = Tokenizer.from_file(TOKENIZER), packing.WordTokens(TOKENIZER)
    bits = ["fox", "Fox", "don't", "é", "e\u0301", "×", "İ", "日本", "12", "a-b", "\t", "\u3000", "<|endoftext|>", "<|", "|>", "'s", ",", "...", " ", "\n", "ENDOFTEXT"]
    rng = np.random.default_rng(3)
    texts = ["", " ", "\n\n", ",", "fox,", " fox, Fox. fox!?", "İ.", "ñ,", "é;é"] + ["".join(rng.choice(bits, rng.integers(0, 25))) for _ in range(3000)]
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert some.texts([t.encode() for t in texts]) == want
    assert some.texts([]) == [] and some.texts([b"", b"\n"]) == [b"", b""]
    some.known.clear()
    some.texts(["fox fox, Fox. fox!?".encode()])
    assert set(some.known) - {b""} == {b"fox", b",", b".", b"!?"}


def test_patterns_hold_the_histogram():
    rng = np.random.default_rng(2)
    for capacity in (10, 64, 257):
        histogram = {int(s): int(rng.integers(1, 90)) for s in rng.choice(np.arange(1, capacity + 1), min(40, capacity), replace=False)}
        patterns = packing.solve(histogram, capacity, rounds=200)
        got = collections.Counter()
        for pattern, times in patterns:
            assert sum(s * n for s, n in pattern.items()) <= capacity and times > 0
            for s, n in pattern.items():
                got[s] += n * times
        assert got == collections.Counter(histogram)
        assert sum(t for _, t in patterns) <= 1.02 * first_fit(histogram, capacity) + 1


def test_program_places_the_pieces():
    rng = np.random.default_rng(5)
    sizes = np.minimum(2047, rng.lognormal(6, 0.9, 8000).astype(int) + 1)
    histogram = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True), strict=True)}
    left = np.zeros(2049, np.int64)
    left[list(histogram)] = list(histogram.values())
    planned = sum(times * own for _, times, own in packing.by_program(left, 2048, 600, 40.0, 32, 8, 4))
    assert planned >= 0.85 * sizes.sum()
    assert left @ np.arange(2049) <= 3 * 2048
    assert sum(t for _, t in packing.solve(histogram)) <= 1.002 * math.ceil(sizes.sum() / 2048) + 1


def test_program_beats_best_fit():
    """Best fit pairs 510 with 270 and wastes the rest; the program pairs 510 + 260 + 230 and 2 x 270 + 2 x 230."""
    histogram = {510: 6000, 270: 6000, 260: 6000, 230: 12000}
    assert sum(t for _, t in packing.solve(histogram, 1000, rounds=0)) == 11_000
    assert sum(t for _, t in packing.solve(histogram, 1000)) <= 1.005 * 9000


def first_fit(histogram, capacity):
    room = []
    for size in sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True):
        for i, left in enumerate(room):
            if size <= left:
                room[i] -= size
                break
        else:
            room.append(capacity - size)
    return len(room)


def test_mix(docs, nothing):
    out = data(mixing.mix(docs, part=3))
    assert len(out) == len(ROWS)
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sizes = collections.Counter()
    for _, text, _, source in ROWS:
        sizes[source] += len(word.findall(text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and weight[s] * level > 3 * sizes[s]}
        if not more:
            break
        full |= more
    taken = collections.Counter()
    for r in out:
        want = 3 * sizes[r["source"]] if r["source"] in full else weight[r["source"]] * level
        assert math.isclose(r["target"], want, rel_tol=1e-9) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert collections.Counter((r["doc_id"], r["size"]) for r in out) == collections.Counter((i, len(word.findall(t or ""))) for i, t, *_ in ROWS)
    for s in names:
        largest = max(r["size"] for r in out if r["source"] == s)
        want = 3 * sizes[s] if s in full else weight[s] * level
        assert abs(taken[s] - want) <= largest / 2 + 1
    assert sorted(map(str, out)) == sorted(map(str, data(mixing.mix(docs, part=3))))
    assert data(mixing.mix(nothing)) == []


def test_mix_of_many_copies(spark):
    import pytest

    rows = [(i, "w " * (1 + i % 7), "ab"[i % 10 == 0]) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = data(mixing.mix(df, weights=(1, 9), most=20))
    assert {r["source"] for r in out if r["target"] < 20 * r["source_size"]} == {"a", "b"}
    for s in "ab":
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 4
        assert max(r["copies"] for r in own) <= 20
    assert max(r["copies"] for r in out) > 3
    cells = spark.createDataFrame([("a", s, 5) for s in range(1, 9)], "source string, size long, n long")
    targets = spark.createDataFrame([("a", 180, 99.0)], "source string, source_size long, target double")
    with pytest.raises(RuntimeError, match="misses its target"):
        mixing.tilts(cells, targets, rounds=2)


def fingerprint(text, width=4):
    w = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    root = {n: n for n in nodes}
    for a in nodes:
        for b in nodes:
            if linked(a, b):
                x, y = root[a], root[b]
                low = min(x, y)
                for n in nodes:
                    if root[n] in (x, y):
                        root[n] = low
    return root


@pytest.mark.parametrize("distance", [4, 20])
def test_simhash(docs, nothing, distance):
    out = data(simhash.near_duplicates(docs, distance=distance))
    assert len(out) == len(ROWS)
    prints = {i: fingerprint(t) for i, t, *_ in ROWS}
    assert all(r["fingerprint"] == f"{prints[r['doc_id']]:016x}" for r in out)
    root = components([i for i in prints if i is not None], lambda a, b: (prints[a] ^ prints[b]).bit_count() <= distance)
    assert all(r["component_id"] == root[r["doc_id"]] for r in out if r["doc_id"] is not None)
    kept = data(simhash.drop_near_duplicates(docs, distance=distance))
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(set(root.values()))
    assert set(kept[0]) == set(docs.columns) and sum(r["doc_id"] is None for r in kept) == 1
    assert data(simhash.near_duplicates(nothing)) == []


def test_parted_rows_keep_their_columns(spark):
    from quillstone.llm.bit_filter import parted

    df = spark.createDataFrame([(i, f"v{i}", -i) for i in range(40)], "doc_id long, _h string, __H long")
    maybe, rest = parted(df, "doc_id", spark.createDataFrame([(3,), (5,)], "doc_id long"))
    assert maybe.columns == rest.columns == df.columns
    found = {tuple(r) for r in maybe.collect()}
    assert {(3, "v3", -3), (5, "v5", -5)} <= found and len(found) < 40
    assert found | {tuple(r) for r in rest.collect()} == {tuple(r) for r in df.collect()}


def test_dense_cells_meet_as_blocks():
    rng = np.random.default_rng(3)
    fp = np.unique(np.uint64(0xABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)))
    cell, visit = np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int8)
    a, b = simhash.linked_in_runs(cell, fp, visit, 0, 4)
    assert len(a) < 40 * len(fp)
    joined = {int(x) for x in np.concatenate([a, b]).view(np.uint64)}
    assert joined == {int(x) for x in fp}


def test_search(docs, nothing):
    word = re.compile(r"[^\W_]+")
    bags = [(i, collections.Counter(word.findall((t or "").lower()))) for i, t, *_ in ROWS]
    mean = sum(sum(b.values()) for _, b in bags) / len(bags)
    df = collections.Counter(w for _, b in bags for w in b)
    out = collections.defaultdict(list)
    asked = docs["doc_id"] % 4 == 0
    for r in data(search.search(docs, asked, k=5, shard=20, block=6)):
        out[r["query_id"]].append((r["rank"], r["doc_id"], r["score"]))
    for q, bag in bags[:60]:
        if q % 4:
            continue
        scores = []
        for i, other in bags:
            size = sum(other.values())
            s = sum(
                math.log1p((len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * other[w] * 2.2 / (other[w] + 1.2 * (0.25 + 0.75 * size / mean))
                for w in bag
                if w in other
            )
            if s > 0:
                scores.append((-round(s, 8), i is None, i))
        best = sorted(scores)[:5]
        got = sorted(out[q])
        assert [g[1] for g in got] == [b[2] for b in best]
        assert np.allclose([g[2] for g in got], [-b[0] for b in best], atol=1e-6)
    assert data(search.search(nothing, nothing["doc_id"] % 4 == 0)) == []


def test_search_copies_no_document_for_a_block_of_queries(docs):
    tokens = search.term_counts(docs)
    rows = tokens.limit(9).select(F.col("key").alias("query"), F.col("terms").alias("term"), F.col("counts").alias("df")).toArrow()
    block = docs.sparkSession.sparkContext.broadcast(search.questions_of(rows, len(ROWS)))
    found = search.answers(tokens, block, 40.0, 3, 1.2, 0.75, 20)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["query_id"] for r in data(found)} <= set(rows.column("query").to_pylist())


def test_shards_are_bounded_by_documents_and_postings(monkeypatch):
    monkeypatch.setattr(search, "POSTINGS", 10)
    sizes = [4, 4, 4, 25, 1, 1, 1, 1, 1]
    batch = pa.RecordBatch.from_arrays([pa.array([[7] * n for n in sizes], pa.list_(pa.int64()))], names=["terms"])
    parts = [[len(x) for x in part.column("terms").to_pylist()] for part in search.shards([batch], 4)]
    assert parts == [[4, 4], [4], [25], [1, 1, 1, 1], [1]]


def test_threshold_from_an_earlier_shard_keeps_what_can_enter():
    rng = np.random.default_rng(5)
    n, asked = 300, np.arange(30)
    lists = [np.flatnonzero(rng.random(30) < rng.random()) for _ in range(n)]
    lists = [x if len(x) else np.array([3]) for x in lists]
    ends = np.append(0, np.cumsum([len(x) for x in lists]))
    counts = rng.integers(1, 5, ends[-1]).astype(np.int32)
    shard = search.Shard(rng.integers(5, 90, n), ends, np.concatenate(lists), counts, 40.0, 1.2, 0.75, asked, np.linspace(0.1, 3, 30))
    rank = np.arange(n)
    for some in (asked, asked[::3], asked[:4]):
        docs, scores = shard.search(some, n, rank)
        for least in (0.0, scores[3], scores[20], scores[0]):
            got, worth = shard.search(some, 10, rank, least)
            keep = scores[:10] >= least
            assert got[: keep.sum()].tolist() == docs[:10][keep].tolist()
            assert np.allclose(worth[: keep.sum()], scores[:10][keep], rtol=1e-12)


def cut(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        yield len(t), sum(gone), sum(g and not p for g, p in zip(gone, [False, *gone], strict=False)), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("depth", [1, 3])
def test_repeats(docs, nothing, depth, monkeypatch):
    if depth == 1:
        monkeypatch.setattr(suffix_dedup, "MEMBERS", 1)  # every anchor is dealt to several tasks
    out = data(suffix_dedup.repeats(docs, depth=depth))
    want = collections.Counter((r[0], *c) for r, c in zip(ROWS, cut(ROWS, 400), strict=True))
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in out) == want
    assert sum(r["n_removed"] for r in out) > 5000
    if depth == 3:
        left = data(suffix_dedup.drop_repeats(docs))
        assert len(left) == len(ROWS) and set(left[0]) == set(docs.columns)
        whole = {hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in left}
        assert {r["kept_sha256"] for r in out if r["n_removed"] == 0} <= whole
        assert data(suffix_dedup.repeats(nothing)) == []


def test_suffix_ranks_order_all_suffixes(spark):
    rng = np.random.default_rng(4)
    strings = {(1, 1): rng.integers(1, 3, 23).tolist(), (1, 2): rng.integers(1, 3, 14).tolist(), (2, 1): [1]}
    rows = [(*k, 0, i, s) for k, v in strings.items() for i, s in enumerate(v)]
    df = spark.createDataFrame(rows, "t1 long, t2 long, path long, ord long, sym long")
    got = sorted(suffix_dedup.suffix_ranks(df, 6).collect(), key=lambda r: r["rank"])
    order = [strings[r["t1"], r["t2"]][r["ord"] :] for r in got]
    assert order == sorted(order) and len(order) == len(rows)
