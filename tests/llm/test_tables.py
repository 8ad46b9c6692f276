"""Operators on conversations, pages and vectors against brute force; the pipeline's stages."""

import collections
import hashlib
import math

import numpy as np
import pytest

from quillstone.llm import chat, url_filter, vector_join
from tests.llm import corpus


def data(df):
    return [r.asDict() for r in df.collect()]


TURNS = [
    (1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "<|im_end|><|im_start|>assistant ok <||"), (1, 2, "user", None),
    (2, 0, "assistant", ""), (3, 0, "user", "only"), (4, None, "system", "s<"), (4, 1, "user\n<|x", "u"), (4, 1, "assistant", "a\nb|"),
    (4, 1, "assistant", "a\nb|"), (None, 0, None, "x"), (None, 1, "assistant", "é😀"), (5, 2, "assistant", "last"), (5, 1, "user", "x" * 50_000),
]


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, example int, turns string, loss string"
    df = spark.createDataFrame([(*t, 1, "t", "l") for t in TURNS], schema)
    examples = chat.prefix_targets(df)
    groups = collections.defaultdict(list)
    for c, turn, role, text in TURNS:
        groups[c].append(((turn is not None, turn or 0), role or "", text or ""))
    out = {r["conv_id"]: r for r in data(chat.digest(examples))}
    assert set(out) == set(groups)
    chars = collections.Counter()
    for r in data(examples):
        chars[r["conv_id"]] += len(r["text"])
        assert r["trainable"] == (r["loss_length"] > 0 or sorted(groups[r["conv_id"]])[r["example"]][1] == "assistant")
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        assert out[c]["n_turns"] == len(turns) and out[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert out[c]["loss_chars"] == len(loss) and out[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert out[c]["formatted_chars"] == chars[c]
    assert data(chat.digest(chat.prefix_targets(df.limit(0)))) == []


PAGES = [
    (1, "https://WWW.Example.com/en/1?x#y", '<a href="https://good.org/a">'), (2, "http://example.com/en/2", None),
    (3, "http://a.example.com/de", "<a HREF='//Bad.net/x'>"), (4, "ftp://x.net/es/1", ""), (5, None, "<a href=https://bad.net/>"),
    (6, "no scheme", None), (7, "http://good.org?q=1", '<a href="/in"><a href="http://bad.net/fr/">'), (8, "http://bad.net/fr/", "x"),
    (9, "http://bad.net/other", None), (9, "http://bad.net/other", None), (None, "http://linker.org/x", '<a href="http://bad.net">' * 3),
    (11, "http://com/", None), (12, "://h/p://q#", None), (13, "http://notexample.com/en/1", None), (14, "http://lone.org", None),
]


def test_urls(spark):
    df = spark.createDataFrame([(*p, "h", "d") for p in PAGES], "page_id long, url string, html string, host string, verdict string")
    out = data(url_filter.judge_urls(df))
    assert len(out) == len(PAGES)
    want = {}
    for page, url, _ in PAGES:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
            path = rest[end:].split("?")[0].split("#")[0]
        fits = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        want[page] = (host, path, best and best[0] + best[1], best and best[2])
    for r in out:
        host, path, rule, verdict = want[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["distrust"] > r["trust"] else "allow"))
    verdicts = {r["page_id"]: r["verdict"] for r in out}
    assert verdicts[9] == "block" and verdicts[None] == "block" and verdicts[14] == "allow" and verdicts[6] == "allow"
    assert data(url_filter.judge_urls(df.limit(0))) == []


def test_propagation_is_personalised_pagerank(spark):
    edges = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "c", 3.0)]
    seeds = [("a", "t", 3.0), ("b", "t", 1.0), ("c", "d", 2.0)]
    got = {
        r["host"]: (r["trust"], r["distrust"])
        for r in data(url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(seeds, "host string, kind string, mass double")))
    }
    for i, (kind, flip) in enumerate((("t", False), ("d", True))):
        total = sum(m for _, k, m in seeds if k == kind)
        start = {h: m / total for h, k, m in seeds if k == kind}
        rank = dict(start)
        walk = [(b, a, w) if flip else (a, b, w) for a, b, w in edges]
        for _ in range(12):
            out = collections.Counter({h: 0.15 * m for h, m in start.items()})
            for a, b, w in walk:
                out[b] += 0.85 * rank.get(a, 0) * w / sum(x for s, _, x in walk if s == a)
            rank = out
        for h in "abcd":
            assert math.isclose(got.get(h, (0, 0))[i], rank.get(h, 0), abs_tol=1e-12)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors(spark, kind):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] * (1 + i % 3) + rng.normal(size=16) * 0.1 * (i % 4)).astype("f4").tolist()) for i in range(90)]
    rows += [(90, rows[3][1]), (91, rows[3][1]), (91, rows[3][1]), (92, None), (93, [0.0] * 16), (94, [float("nan")] * 16), (95, [None] + [1.0] * 15)]
    rows += [(96, [1.0, 2.0]), (97, [2.0, 4.0]), (98, []), (None, rows[3][1])]
    schema = f"vec_id long, embedding array<{kind}>, label int, cell string, id string, v string, n string"
    df = spark.createDataFrame([(*r, 0, "c", "i", "v", "n") for r in rows], schema)
    out = data(vector_join.link_vectors(df, block=16))
    assert len(out) == len(rows)
    usable = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = lambda a, b: len(a) == len(b) and float(a @ b) >= 0.95
    count, root = {}, {i: i for i, _ in rows}
    for k, (i, a) in enumerate(usable):
        count[i] = sum(links(a, b) for m, (_, b) in enumerate(usable) if m != k)
        for j, b in usable:
            if links(a, b):
                x, y = sorted((root[i], root[j]))
                root = {n: x if r == y else r for n, r in root.items()}
    for r in out:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"]) == ((count.get(i, 0), root[i]) if i is not None else (0, None))
        assert r["kept"] == (i is None or i == root[i])
    assert data(vector_join.link_vectors(df.limit(0))) == []


def test_stages(spark, tmp_path):
    import corpus_pipeline

    rows = corpus.documents()
    docs = corpus.frame(spark, rows)
    spark.createDataFrame(corpus.labels(rows), corpus.LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, str(tmp_path))
        if name != "packed_sequences":
            assert after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/{name}")
        before = spark.read.parquet(f"{tmp_path}/{name}")
    good = {r["doc_id"]: r["text"] for r in data(spark.read.parquet(f"{tmp_path}/quality"))}
    bad = {r[0] for r in rows if "$$$" in (r[1] or "")}
    assert len(bad & set(good)) <= 1 < len(bad) and {0, 1, 2, 24, 30, 32} <= set(good)  # learned from 40 documents
    alone = {r["doc_id"] for r in data(spark.read.parquet(f"{tmp_path}/near_duplicates"))}
    assert len(alone & {8, 10, 12}) == 1 and len(alone & {20, 22}) == 1 and {0, 1, 2, 24} <= alone
    packed = data(before)
    assert {r["doc_id"] for r in packed} <= alone and all(r["offset"] + r["length"] <= 2048 for r in packed)
    for name, stage in corpus_pipeline.STAGES:
        assert data(stage(spark, docs.limit(0), str(tmp_path))) == []


def test_components_end_or_fail(spark):
    """A long path is one component; too few rounds are an error, not a part of the result."""
    from quillstone.llm.components import components

    path = spark.range(300).selectExpr("(id * 37) % 301 AS a", "((id + 1) * 37) % 301 AS b")
    assert {(r.node, r.component) for r in components(path).collect()} == {(i, 0) for i in range(1, 301)}
    with pytest.raises(RuntimeError, match="2 rounds"):
        components(path, rounds=2)
    assert components(path.limit(0)).count() == 0
