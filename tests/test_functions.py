"""Column helpers by properties of their results and by written cases."""

import itertools
import random
import re

from pyspark.sql import functions as F

from quillstone.functions import cleaning as C
from quillstone.functions import text as X
from quillstone.functions.quality import jaccard, page_quality
from quillstone.operators.sessions import chunk_array, session_summary

WORDS = ["Alpha", "beta", "gamma.", "12", "Page 3", "", " ", "SHOUT", "low;", "x-", "don't", "# 2024-01-02", "on 2023/05/06", "## plain"]


def random_texts(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        rows = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(0, 9))]
        rows = [r for row in rows for r in ([row, row] if rng.random() < 0.3 else [row])]
        yield "\n".join(rows) + rng.choice(["", "\n", "\n\n"])


def evaluate(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r[0] for r in df.select("i", column.alias("v")).orderBy("i").select("v").collect()]


def test_lines(spark):
    texts = ["", "\n", "a", "a\n", "a\r\nb\x1cc d\n\n", "\n\na"]
    assert evaluate(spark, texts, X.lines(F.col("text"))) == [t.splitlines() for t in texts]


def test_strip_and_collapse(spark):
    texts = ["  a\t b　 \n", "\x1fa\x1f \x1fb", "plain text", "", "a  b", " x"]
    assert evaluate(spark, texts, X.strip(F.col("text"))) == [t.strip() for t in texts]
    assert evaluate(spark, texts, X.collapse(F.col("text"))) == [re.sub(r"\s+", " ", t.strip()) for t in texts]


def test_title_case(spark):
    texts = ["don't STOP", "3d model", "éa-öb", ""]
    assert evaluate(spark, texts, X.title_case(F.col("text"))) == [t.title() for t in texts]


def test_repeated_lines_go(spark):
    texts = list(random_texts(150, 1))
    got = evaluate(spark, texts, C.dedupe_consecutive_lines(X.lines(F.col("text"))))
    for text, after in zip(texts, got, strict=True):
        before = text.splitlines()
        full = lambda ls: [x.strip() for x in ls if x.strip()]
        assert all(x != y for x, y in itertools.pairwise(full(after)))
        assert full(after) == [k for k, _ in itertools.groupby(full(before))]
        assert len(after) - len(full(after)) == len(before) - len(full(before))
    cases = {"a\na\n\n a \nb": ["a", "", "b"], "a\nb\na": ["a", "b", "a"], "\n\n": ["", ""]}
    assert evaluate(spark, list(cases), C.dedupe_consecutive_lines(X.lines(F.col("text")))) == list(cases.values())


def test_wrapped_lines_join(spark):
    texts = list(random_texts(150, 1))
    got = evaluate(spark, texts, C.join_wrapped_lines(X.lines(F.col("text"))))
    for text, after in zip(texts, got, strict=True):
        assert "".join("".join(after).split()) == "".join(text.split())
        assert text.count("\n") // 2 <= len(after) <= len(text.splitlines())
    cases = {
        "one two\nthree\nfour": ["one two three", "four"],
        "The end.\nnext": ["The end.", "next"],
        "No\nCapital": ["No", "Capital"],
        "gap\n\nmore": ["gap", "", "more"],
        "trail  \n  lead": ["trail lead"],
        "a\nb\nc\nd": ["a b", "c d"],
        "last": ["last"],
    }
    assert evaluate(spark, list(cases), C.join_wrapped_lines(X.lines(F.col("text")))) == list(cases.values())


def test_clean_text_is_stable(spark):
    texts = list(random_texts(60, 2))
    once = evaluate(spark, texts, C.clean_text(F.col("text")))
    assert all(t.endswith("\n") and "\n\n\n" not in t for t in once)
    assert all(len(b) <= len(a) for a, b in zip(once, evaluate(spark, once, C.clean_text(F.col("text")))))


def session_loop(text):
    found = re.compile(r"(20\d{2})[-_/](\d{2})[-_/](\d{2})")
    lines = text.splitlines()
    cuts = [(0, None)]
    for n, line in enumerate(lines, 1):
        m = found.search(line)
        if line.strip().startswith("#") and m:
            cuts.append((n, "-".join(m.groups())))
    out = []
    for k, (n, date) in enumerate(cuts):
        end = cuts[k + 1][0] - 1 if k + 1 < len(cuts) else len(lines)
        start = n + 1
        if k == 0:
            dated = [(i, found.search(lines[i - 1])) for i in range(1, end + 1) if found.search(lines[i - 1])]
            if not dated:
                continue
            start, date = dated[0][0], "-".join(dated[0][1].groups())
        content = "\n".join(lines[n:end]).strip()
        if content:
            out.append((date, start, end, content))
    return out


def test_session_chunks(spark):
    texts = list(random_texts(200, 3))
    got = evaluate(spark, texts, chunk_array(F.col("text")))
    assert [[tuple(c) for c in row] for row in got] == [session_loop(t) for t in texts]


def test_session_summary(spark):
    texts = ["# head\nshort\n", "A line that is long enough: yes\nchunk of something not used\nAnother quite long line here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = {r["doc_id"]: r["summary"] for r in session_summary(docs).collect()}
    assert rows[0] == "Session notes available; summary pending refinement."
    assert rows[1] == "A line that is long enough yes Another quite long line here"


def test_empty_page_quality(spark):
    q = evaluate(spark, [""], page_quality(F.col("text")))[0]
    assert (q["quality_score"], q["empty"], q["low_quality"], q["suspicious"]) == (-110.0, True, True, True)


def test_jaccard_of_empty(spark):
    assert evaluate(spark, [""], jaccard(F.col("text"), F.lit(""))) == [1.0]
    assert evaluate(spark, [""], jaccard(F.col("text"), F.lit("a"))) == [0.0]


def test_clip(spark):
    texts = [None, "**a** `b`", "word " * 30, "x" * 100]
    got = evaluate(spark, texts, X.clip(F.col("text"), 20))
    assert got == ["first campaign mention", "a b", "word word word…", "x" * 19 + "…"]


def test_fold_case(spark):
    texts = ["Straße", "STRASSE", "ẞ", "Éa"]
    assert evaluate(spark, texts, X.fold_case(F.col("text"))) == [t.casefold() for t in texts]


def test_lexicon_patterns_know_all_scripts(spark):
    from quillstone.operators.lexicon import count_hits, tag_entities

    texts = ["Die größe, GRÖSSE und Größen", "groß", "über-Über xüber"]
    assert evaluate(spark, texts, count_hits(F.col("text"), [r"gr\w*e\b"])) == [2, 0, 0]
    assert evaluate(spark, texts, count_hits(F.col("text"), [r"\büber\b"])) == [0, 0, 2]
    pages = spark.createDataFrame([("b", 1, texts[0])], "book string, page int, text string")
    assert [r["entity"] for r in tag_entities(pages, [("Size", r"\bgröß\w+n\b")]).collect()] == ["Size"]
