"""Operators against brute force on small tables, with hot keys and odd names."""

import collections
import dataclasses
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone import api
from quillstone.operators import links as K
from quillstone.operators import mentions as M
from quillstone.operators import pages as P
from quillstone.operators import profiles
from quillstone.operators import requests as R
from quillstone.operators import search as L
from quillstone.operators import spans, substrings
from quillstone.operators.ranking import rank_in_group
from quillstone.sources import scans as S

LINES = [
    "The Red Fox met Dr. No near C++ town, twice",
    "red foxes are not the fox; a red, fox either",
    "#hash and x#hash and #hashtag, then ++ alone",
    "Über-Fox and fox_trot and FOX",
    "nothing to see here at all",
]
ALIASES = [("Red Fox", "Fox"), ("fox", "Fox"), ("dr. no", "No"), ("c++", "Lang"), ("#hash", "Tag"), ("++", "Plus"), ("über-fox", "Ü")]


@pytest.mark.parametrize("mode", ["word", "edge"])
def test_match_terms(spark, mode):
    rows = spark.createDataFrame(list(enumerate(LINES)), "i int, text string")
    terms = spark.createDataFrame([(a.lower(), c) for a, c in ALIASES], "term string, canonical string")
    got = {tuple(r) for r in M.match_terms(rows, terms, "text", ["i"], ["canonical"], mode).collect()}
    before, after = M.BOUNDARIES[mode]
    want = {
        (i, c) for i, line in enumerate(LINES) for a, c in ALIASES
        if re.search(before + re.escape(a) + after, line, re.IGNORECASE)
    }
    assert got == want


def test_match_terms_without_terms(spark):
    rows = spark.createDataFrame([(1, "a")], "i int, text string")
    none = spark.createDataFrame([], "term string, canonical string")
    assert M.match_terms(rows, none, "text", ["i"], ["canonical"]).count() == 0


def test_links(spark):
    names = ["Fox", "Red Fox", "Fox Den", "C++", "Den", "A\\b", "Q[x]"]
    texts = ["Red Fox Den and Fox Den", "a/Fox Fox/x Foxes <b Fox>Den</b>", "C++ x C++y A\\b Q[x]", "Fox. (Den)", "none"]
    rows = [(f"n{i}", n, f"p{i}", "", "general", 0, 1) for i, n in enumerate(names)]
    rows += [(f"t{i}", f"Text number {i}", f"t{i}", t, "general", 0, 2) for i, t in enumerate(texts)]
    articles = spark.createDataFrame(
        rows, "slug string, title string, path string, body string, category string, part bigint, src_rank int"
    )
    got = {(r.src, r.dst) for r in K.outgoing_edges(articles).collect()}
    slug = {n: f"n{i}" for i, n in enumerate(names)}
    every = re.compile(r"(?<![\w/])(" + "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)) + r")(?![\w/])")
    want = set()
    for i, text in enumerate(texts):
        for piece in re.split(r"<[^>]+>", text):
            want |= {(f"t{i}", slug[n]) for n in every.findall(piece)}
    assert got == want


def test_link_dictionary_last_writer_wins(spark):
    rows = [
        ("a", "Name", "1", "- Synonyms: Other, Name2 ,", "general", 0, 1),
        ("campaign-entities-other", "X", "2", "- synonyms: _None_", "campaign", 0, 2),
        ("b", "Name", "3", "", "general", 0, 3),
    ]
    articles = spark.createDataFrame(
        rows, "slug string, title string, path string, body string, category string, part bigint, src_rank int"
    )
    got = dict(tuple(r) for r in K.link_dictionary(articles).select("name", "slug").collect())
    assert got == {"Name": "b", "Other": "campaign-entities-other", "Name2": "a", "X": "campaign-entities-other"}


def test_rank_in_a_hot_group(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("k"), F.hash("id").alias("o"), "id"
    )
    got = rank_in_group(df, ["k"], ["o", "id"]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["k"], []).append((r["o"], r["id"], r["pos"]))
    assert len(got) == 5000
    for rows in groups.values():
        assert [p for _, _, p in sorted(rows)] == list(range(1, len(rows) + 1))


def test_parse_what_was_assembled(spark):
    pages = spark.createDataFrame([("b", p, f"text {p}") for p in (1, 2, 5, 7)], "book string, page bigint, text string")
    totals = spark.createDataFrame([("b", 7)], "book string, total int")
    errors = spark.createDataFrame([("b", 3, "boom")], "book string, page bigint, error string")
    whole = P.assemble_document(pages, totals, errors)
    assert whole.count() == 1
    parsed = {r["page"]: r["text"] for r in P.parse_pages(whole).collect()}
    assert parsed == {
        1: "text 1", 2: "text 2", 3: "[OCR_ERROR] boom", 4: "[MISSING_PAGE_OUTPUT]",
        5: "text 5", 6: "[MISSING_PAGE_OUTPUT]", 7: "text 7",
    }


def test_last_page_wins(spark):
    text = "lost\n===== PAGE 2 =====\nold\n=====PAGE 2===== \n\nnew\n===== PAGE x =====\n"
    docs = spark.createDataFrame([("b", text)], "book string, text string")
    assert [tuple(r) for r in P.parse_pages(docs).collect()] == [("b", 2, "new\n===== PAGE x =====")]


def test_batch_search_counts_substrings(spark):
    texts = {1: "the other there the", 2: "no match", 3: "aaa aa a", 4: ""}
    asked = {10: "the THE", 11: "aa", 12: "zz", 13: "a  match"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    queries = spark.createDataFrame(list(asked.items()), "query_id bigint, text string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in L.batch_search(docs, queries).collect()}
    want = {}
    for q, query in asked.items():
        for d, text in texts.items():
            score = sum(text.lower().count(t) for t in query.lower().split())
            if score:
                want[q, d] = float(score)
    assert got == want


def test_resolve_folds_case_and_keeps_the_first(spark):
    catalog = spark.createDataFrame(
        [(0, "Große  Straße", "NPC", ["Shared"]), (1, "Other", "PC", ["shared"])],
        "pos bigint, canonical string, type string, synonyms array<string>",
    )
    asked = spark.createDataFrame(
        [(1, " GROSSE STRASSE"), (2, "SHARED"), (3, "New  one"), (4, "new ONE")], "request_id bigint, entity string"
    )
    got = {r["request_id"]: r["canonical"] for r in M.resolve_canonical(asked, catalog).collect()}
    assert got == {1: "Große  Straße", 2: "Große  Straße", 3: None, 4: None}
    names = [r["canonical"] for r in M.extend_catalog(asked, catalog).orderBy("pos").collect()]
    assert names == ["Große  Straße", "Other", "New  one"]


def test_find_mentions_keeps_logs_first_and_caps(spark):
    terms = spark.createDataFrame([("Fox", "fox"), ("Fox", "red")], "canonical string, term string")
    log = spark.createDataFrame([("a.md", i, "red fox") for i in range(1, 6)], "source string, line_no bigint, text string")
    pages = spark.createDataFrame([("b.md", 4, "x\n the fox \nfox")], "source string, page bigint, text string")
    got = [tuple(r) for r in R.find_mentions(terms, log, pages).orderBy("rank").collect()]
    assert got[-1] == ("Fox", 6, "general", "b.md#PAGE-4", "the fox")
    assert R.find_mentions(terms, log, pages, cap=3).count() == 3


def test_dossier(spark):
    done = spark.createDataFrame(
        [(1, "fox", "researched", "Fox", "Fox", "why", 1, "incoming"), (2, "cat", "integrated", "Cat", "Cat", "", 0, "incoming")],
        "request_id bigint, slug string, result string, resolved_entity string, entity string, note string, n_mentions bigint, asked_status string",
    )
    catalog = spark.createDataFrame([(0, "Fox", "NPC", ["Red"])], "pos bigint, canonical string, type string, synonyms array<string>")
    mentions = spark.createDataFrame(
        [("Fox", 1, "campaign", "a#L1", "the fox")], "canonical string, rank bigint, domain string, source string, excerpt string"
    )
    rows = R.dossier_rows(done, catalog, mentions).collect()
    assert [r["slug"] for r in rows] == ["fox"]
    for part in ("- Synonyms: Red", "- Request note: why", "- **campaign** - the fox\n  - Source: `a#L1`", "**NPC**", "- Queue status at processing: **incoming**"):
        assert part in rows[0]["body"]


def small_sources(spark):
    return api.Sources(
        catalog=spark.createDataFrame(
            [(0, "Red Fox", "NPC", ["Foxy"]), (1, "Absent One", "PC", [])],
            "pos bigint, canonical string, type string, synonyms array<string>",
        ),
        notes=spark.createDataFrame(
            [("2024-01-02", "a.md", "Red Fox looks tall today\nThen foxy died in the attack\nFoxy is still alive, they say")],
            "session string, source string, text string",
        ),
        inputs=spark.createDataFrame(
            [(1, "red fox", None, None, "a note about nothing")],
            "line_no bigint, entity string, player string, date string, note string",
        ),
        entity_files=spark.createDataFrame(
            [("campaign", "c/fox.timeline.jsonl", "fox.timeline.jsonl"), ("campaign", "c/fox.bio.md", "fox.bio.md"),
             ("campaign", "c/fox.md", "fox.md"), ("campaign", "c/owl.md", "owl.md"), ("general", "g/owl.md", "owl.md")],
            "scope string, path string, name string",
        ),
        timeline_events=spark.createDataFrame(
            [("c/fox.timeline.jsonl", 2, "x", "later"), ("c/fox.timeline.jsonl", 1, None, "*first* seen")],
            "file string, seq bigint, date_or_session string, text string",
        ),
    )


def test_rebuild(spark):
    out = api.rebuild(small_sources(spark), target="fox")
    assert {r["canonical"]: r["citation_count"] for r in out["entity_index"].collect()} == {"Red Fox": 4, "Absent One": 0}
    docs = out["entity_documents"].collect()
    assert [d["slug"] for d in docs] == ["red-fox"]
    body = docs[0]["body"]
    for part in ("# Campaign NPC: Red Fox", "### Physical description", "## Continuity notes\n\n- conflicting", "- [1] `a.md#L1`"):
        assert part in body
    manifest = {(r["scope"], r["entity"]): (r["md_files"], r["jsonl_files"]) for r in out["manifest"].collect()}
    assert manifest == {
        ("campaign", "fox"): (["c/fox.bio.md"], ["c/fox.timeline.jsonl"]), ("general", "owl"): (["g/owl.md"], []),
    }
    assert [tuple(r) for r in out["intro_timeline"].collect()] == [
        ("fox", "Fox", "unspecified", "first seen", "c/fox.timeline.jsonl")
    ]


def test_document_without_mentions(spark):
    out = api.rebuild(small_sources(spark), target="absent", scope="entity")
    assert set(out) == {"mentions", "coverage_index", "entity_index", "entity_documents"}
    body = out["entity_documents"].collect()[0]["body"]
    assert "_No references recorded._" in body and "has no cited campaign references yet." in body


def test_profile_rules(spark):
    rows = [(0, "s", "a.md", i, t, "E") for i, t in enumerate(["can do deck", "can do deck", "able to spell", "drone pilot", "gun skill"], 1)]
    mentions = spark.createDataFrame(rows, "src_rank int, session string, source string, line_no bigint, text string, canonical string")
    got = {(r["facet"], r["rank"]): r["source"] for r in profiles.entity_facets(mentions).collect()}
    assert got == {
        ("capabilities", 1): "a.md#L1", ("capabilities", 2): "a.md#L3", ("capabilities", 3): "a.md#L4",
        ("equipment", 1): "a.md#L1", ("equipment", 2): "a.md#L4", ("equipment", 3): "a.md#L5",
    }


def test_scan_text(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"ok\xff")
    (tmp_path / "b.txt").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.md").write_text("deep")
    flat = {r["name"]: r["text"] for r in S.scan_text(spark, str(tmp_path), "*.md").collect()}
    deep = {r["name"]: r["text"] for r in S.scan_text(spark, str(tmp_path), "*.md", recursive=True).collect()}
    assert flat == {"a.md": "ok�"} and deep == {"a.md": "ok�", "c.md": "deep"}


def test_strict_jsonl_fails(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"k": 1}\n{"k": \n')
    assert [r["k"] for r in S.scan_jsonl(spark, str(tmp_path / "q.jsonl"), {"k": "bigint"}).collect()] == [1]
    with pytest.raises(Exception, match="(?i)malformed"):
        S.scan_jsonl_strict(spark, str(tmp_path / "q.jsonl"), "k bigint").collect()


def test_append_facts(spark, tmp_path):
    payloads = spark.createDataFrame(
        [(" a fact ", "E", None, None, None, None)],
        "fact string, entity string, source string, channel string, confidence string, tags array<string>",
    )
    for _ in range(2):
        api.append_facts(payloads, F.lit(7), str(tmp_path / "facts"), str(tmp_path / "audit"))
    facts = spark.read.json(str(tmp_path / "facts")).collect()
    assert [(f["fact"], f["confidence"], f["ts"]) for f in facts] == [("a fact", "medium", 7)] * 2
    assert spark.read.json(str(tmp_path / "audit")).count() == 2


def test_search_scope(spark):
    docs = spark.createDataFrame([(1, "campaign", "fox fox"), (2, "lore", "fox")], "doc_id bigint, scope string, text string")
    assert [r["doc_id"] for r in api.search(docs, "Fox").collect()] == [1, 2]
    assert [r["doc_id"] for r in api.search(docs, "Fox", "lore").collect()] == [2]
    assert api.search(docs, " ").count() == 0


def test_one_pass_over_plans(spark):
    """Caps are applied before the shuffle, and no plan pairs all rows with all rows."""
    from __spark_entry__ import queries

    for name in ("find_mentions", "entity_facets", "batch_search"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "WindowGroupLimit" in plan
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_queue_run_with_new_names(spark):
    from quillstone.operators import mentions as M
    from quillstone.operators import requests as R

    catalog = spark.createDataFrame([(0, "Fox", "NPC", ["Red"])], "pos bigint, canonical string, type string, synonyms array<string>")
    rows = [(1, 10, " Owl ", "", "incoming", "", None, "ann"), (2, 11, "OWL", "", "pending", "", 5, "ben"), (3, 12, "red", "n", "Pending ", "s", None, "cat"), (4, 13, "x", "", "completed", "", 1, "dan")]
    schema = "request_id bigint, ts bigint, entity string, note string, status string, source_submission_id string, started_at bigint, submitter string"
    queue = spark.createDataFrame(rows, schema).withColumn("created_at", F.lit(None).cast("bigint")).withColumn("history", F.lit(None).cast(R.HISTORY))
    asked = R.select_open_requests(queue)
    settled = M.settle_names(asked, catalog)
    extended = M.extend_catalog(asked, catalog)
    terms = extended.select("canonical", F.explode(F.concat(F.array("canonical"), "synonyms")).alias("term"))
    logs = spark.createDataFrame([("log", 1, "the owl sat"), ("log", 2, "an OWL, a red one")], "source string, line_no bigint, text string")
    pages = spark.createDataFrame([("book", 1, "nothing\nowl here")], "source string, page bigint, text string")
    done = R.complete_requests(settled, R.find_mentions(terms, logs, pages), spark.createDataFrame([("fox",)], "slug string"), F.lit(99))
    got = {r["request_id"]: r for r in done.collect()}
    assert [(got[i]["resolved_entity"], got[i]["is_new"], got[i]["n_mentions"], got[i]["started_at"]) for i in (1, 2, 3)] == [("Owl", True, 3, 99), ("Owl", False, 3, 5), ("Fox", False, 1, 99)]
    assert got[3]["result"] == "integrated" and got[2]["submitter"] == "ben"
    whole = {r["request_id"]: r["status"] for r in R.write_back(queue, done).collect()}
    assert whole == {1: "completed", 2: "completed", 3: "completed", 4: "completed"}


def test_entity_with_many_files_loses_none(spark):
    from quillstone.operators import articles as A
    from quillstone.operators import manifest as MF

    n = 10_000
    names = [(i, f"fox.{i:05d}.{'md' if i % 4 == 0 else 'jsonl'}") for i in range(n)]
    files = spark.createDataFrame([("general", f"p/{x}", x) for _, x in names], "scope string, path string, name string")
    row = MF.manifest_rows(files).collect()
    assert len(row) == 1 and len(row[0]["md_files"]) == n // 4 and len(row[0]["jsonl_files"]) == n - n // 4
    listed = MF.entity_files(files).withColumn("body", F.concat(F.lit(" body of "), "name"))
    body = A.aggregate_entity_body(listed).collect()
    assert len(body) == 1 and all(x in body[0]["body"] for _, x in names)
    empty = spark.createDataFrame([("requests", "a/b.md", "# nested"), ("requests", "c.md", "# flat")], "root string, rel_path string, body string")
    built = A.build_articles(A.aggregate_entity_body(listed), empty)
    slugs = {r["slug"]: r["body"] for r in built.collect()}
    assert set(slugs) == {"lore-entities-fox", "campaign-requests-c", "index", "entity-queue"} and slugs["lore-entities-fox"] == body[0]["body"]


def test_imports_stand_between_notes_and_inputs(spark):
    imports = spark.createDataFrame([("2024-01-03", "wp.md", "An imported line on the Red Fox")], "session string, source string, text string")
    found = api.rebuild(dataclasses.replace(small_sources(spark), imports=imports), scope="entity")["mentions"].collect()
    assert {(r["src_rank"], r["source"]) for r in found} == {(0, "a.md"), (1, "wp.md"), (2, "submissions")}


def exchanged(df):
    """Columns that go through an exchange, by plan node."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\(\d+\) (?:Broadcast)?Exchange[^\n]*\nInput \[\d+\]: \[([^\n]*)\]", plan)


def test_texts_stay_out_of_exchanges(spark):
    """Neither lines nor bodies move before names are found in them, also when nothing is broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        notes = spark.createDataFrame([("s", "a.md", "the red fox ran\nnothing"), ("s", "b.md", None)], "session string, source string, text string")
        terms = spark.createDataFrame([("red fox", "Fox"), ("ran", "Run")], "term string, canonical string")
        hits = M.line_hits(notes, ["session", "source"], "text", terms, carry=["source"])
        moved = exchanged(hits)
        assert moved and not any(c in m for m in moved for c in ("_text", "_line", "_sp_units"))
        assert {(r.source, r["_i"], r.canonical) for r in hits.collect()} == {("a.md", 0, "Fox"), ("a.md", 0, "Run")}
        articles = spark.createDataFrame(
            [("a", "Red Fox", "p", "Den", "general", 0, 1), ("b", "Den", "q", "the Red Fox Den", "general", 0, 1)],
            "slug string, title string, path string, body string, category string, part bigint, src_rank int",
        )
        edges = K.link_spans(articles, K.link_dictionary(articles))
        assert not any(c in m for m in exchanged(edges) for c in ("body", "text", "_sp_units"))
        assert sorted(map(tuple, edges.collect())) == [("a", "b"), ("b", "a")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_batch_search_keeps_the_best(spark):
    """The bound drops no document that belongs to the best, ties included."""
    rng = random.Random(7)
    words = ["the", "at", "a", "there", "cat", "tt", "rat", "theatre"]
    texts = {d: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 3, 40]))) for d in range(120)}
    asked = {q: " ".join(rng.choice([*words, "zz", "e"]) for _ in range(rng.randint(1, 5))) for q in range(12)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    queries = spark.createDataFrame(list(asked.items()), "query_id bigint, text string")
    got = {(r.query_id, r.doc_id): (r.score, r["rank"]) for r in L.batch_search(docs, queries, 5).collect()}
    want = {}
    for q, query in asked.items():
        scores = [(sum(t.count(w) for w in query.split()), d) for d, t in texts.items()]
        for i, (n, d) in enumerate(sorted(((-n, d) for n, d in scores if n))[:5]):
            want[q, d] = (float(-n), i + 1)
    assert got == want


def test_lines_that_name_several_entities(spark):
    """Profiles read lines with names as they read one row per mention, and no text moves for an aggregate."""
    rows = [(0, "s", "a.md", 1, "fox died by the gun", ["Fox", "Owl"]), (0, "s", "a.md", 2, "the fox is alive", ["Fox"]), (0, "t", "b.md", 1, "fox died by the gun", ["Fox", None])]
    lines = spark.createDataFrame(rows, "src_rank int, session string, source string, line_no bigint, text string, names array<string>")
    single = M.by_name(lines)
    assert single.count() == 5
    makers = (
        profiles.entity_facets, profiles.entity_timeline, profiles.passing_record, profiles.continuity_conflicts, profiles.entity_tags,
        lambda found: profiles.notable_events(found, ["gun"]),
    )
    for make in makers:
        got = [sorted(map(repr, make(found).collect())) for found in (lines, single)]
        assert got[0] == got[1] and got[0]
    assert {(r.canonical, r.rank, r.source) for r in profiles.notable_events(lines, ["gun"]).collect()} == {("Fox", 1, "a.md#L1"), ("Owl", 1, "a.md#L1"), (None, 1, "b.md#L1")}
    moved = exchanged(profiles.entity_tags(lines)) + exchanged(profiles.continuity_conflicts(lines))
    assert moved and not any("text" in m for m in moved)


def mention_input(spark):
    notes = [("s", "a.md", "the Red Fox ran home\nnothing is to be seen\nfoxy, red fox and the owl"), ("s", "b.md", None), ("t", "c.md", "an owl in the old barn")]
    names = [("red fox", "Red Fox"), ("foxy", "Red Fox"), ("owl", "Owl"), ("old barn", None), ("fox ran", "Run"), ("", "Blank"), (None, "None")]
    aliases = spark.createDataFrame(names, "alias_key string, canonical string")
    notes = spark.createDataFrame([*notes, notes[0]], "session string, source string, text string")
    first = "the Red Fox ran home nothing is to be seen"
    third = "nothing is to be seen foxy, red fox and the owl"
    owl = "an owl in the old barn"
    want = [
        ("a.md", 1, first, "Red Fox"), ("a.md", 1, first, "Run"), ("a.md", 3, third, "Owl"), ("a.md", 3, third, "Red Fox"), ("c.md", 1, owl, None), ("c.md", 1, owl, "Owl"),
    ]
    return notes, aliases, sorted(want, key=repr)


def mentioned(found):
    return sorted(((r.source, r.line_no, r.text, r.canonical) for r in found.collect()), key=repr)


def test_mentions_move_neither_texts_nor_places(spark):
    """Names are found and looked up in the row of the text, also when Spark may broadcast nothing; a row that repeats counts once."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        notes, aliases, want = mention_input(spark)
        assert mentioned(M.match_mentions(notes, aliases)) == want
        once = M.match_mentions(notes.distinct(), aliases)
        assert exchanged(once) == [] and mentioned(once) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_names_in_many_blocks(spark, monkeypatch):
    """Names that one task cannot hold are looked up in several readings, and each mention is found once."""
    notes, aliases, want = mention_input(spark)
    for block, chain in ((1 << 20, 4), (40, 100), (40, 1)):
        monkeypatch.setattr(M, "BLOCK", block)
        monkeypatch.setattr(M, "CHAIN", chain)
        lines = M.mention_lines(notes, aliases)
        assert mentioned(M.by_name(lines)) == want
        first = {(r.canonical, r.source) for r in profiles.entity_timeline(lines, 1).collect()}
        assert first == {("Red Fox", "a.md#L1"), ("Run", "a.md#L1"), ("Owl", "a.md#L3"), (None, "c.md#L1")}


def test_profiles_shuffle_wanted_lines_alone(spark):
    """Lines that no profile shows are left out before texts are shuffled, and texts are joined with few rows."""
    notes = [("s", f"{i:03d}.md", f"the red fox {'died' if i % 50 == 0 else 'ran'} on day {i}") for i in range(200)]
    aliases = spark.createDataFrame([("red fox", "Red Fox")], "alias_key string, canonical string")
    lines = M.mention_lines(spark.createDataFrame(notes, "session string, source string, text string"), aliases)
    got = profiles.passing_record(lines)
    assert [(r.canonical, r.source, r.text) for r in got.collect()] == [("Red Fox", "000.md#L1", "the red fox died on day 0")]
    assert not any("names" in m or "terms" in m for m in exchanged(got))
    assert [(r["rank"], r.source) for r in profiles.notable_events(lines, ["died"]).orderBy("rank").collect()] == [(i + 1, f"{50 * i:03d}.md#L1") for i in range(4)]


def test_submissions_with_the_same_text(spark):
    """Rows that show the same are one submission with the names of both; an entity it was filed for is named, too."""
    long = "x" * 400
    rows = [(1, "owl ", None, None, f"{long} red fox"), (1, "", None, None, f"{long} foxy barn"), (2, "nobody", "ann", "", "the owl sat here")]
    inputs = spark.createDataFrame(rows, "line_no bigint, entity string, player string, date string, note string")
    aliases = spark.createDataFrame([("red fox", "Red Fox"), ("barn", "Barn"), ("owl", "Owl")], "alias_key string, canonical string")
    catalog = spark.createDataFrame([("Owl",), ("Barn",), (None,)], "canonical string")
    got = M.match_player_inputs(inputs, aliases, catalog, "in").collect()
    assert sorted((r.line_no, r.canonical) for r in got) == [(1, "Barn"), (1, "Owl"), (1, "Red Fox"), (2, "Owl")]


def test_every_mention_moves_places_alone(spark, monkeypatch):
    """No mention is shuffled, names count on from one range of places to the next, and a page counts at its first line."""
    names = spark.createDataFrame([("Fox", "fox"), ("Fox", "red"), ("Hen", "red"), ("Cat", "cat")], "canonical string, term string")
    rows = [(f"log{i:02d}", f"a red fox\nnothing\n{'the cat' if i % 3 == 0 else 'red'}") for i in range(40)]
    logs = spark.createDataFrame([*rows, rows[0]], "source string, text string")
    pages = spark.createDataFrame([("book", 1, "x\nfox\nred"), ("book", 1, "no\ncat\nfox\nred"), ("book", 2, "cat cat")], "source string, page bigint, text string")
    want = []
    for name, terms in (("Fox", ("fox", "red")), ("Hen", ("red",)), ("Cat", ("cat",))):
        found = [(s, i, line) for s, t in rows for i, line in enumerate(t.split("\n"), 1) if any(x in line.split() for x in terms)]
        found = [("campaign", f"{s}#L{i}", line) for s, i, line in found]
        first = {"Fox": [(1, "fox")], "Hen": [(1, "red")], "Cat": [(1, "cat"), (2, "cat cat")]}[name]
        found += [("general", f"book#PAGE-{p}", line) for p, line in first]
        want += [(name, n, *x) for n, x in enumerate(found, 1)]
    for block in (M.BLOCK, 30):
        monkeypatch.setattr(M, "BLOCK", block)
        got = R.find_mentions(names, logs, pages)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert not any("canonical" in m or "ranks" in m for m in exchanged(got))


def test_shared_terms_are_searched_once(spark):
    """A term of several names has its places once, and names that no request asks for are not searched."""
    catalog = spark.createDataFrame(
        [(0, "Fox", "NPC", ["Red"]), (1, "Hen", "NPC", ["Red"]), (2, "Cat", "NPC", ["sat"])], "pos bigint, canonical string, type string, synonyms array<string>"
    )
    queue = spark.createDataFrame([(1, "fox", "incoming"), (2, "hen", "pending")], "request_id bigint, entity string, status string")
    logs = spark.createDataFrame([("log", 1, "a red fox sat"), ("log", 2, "red")], "source string, line_no bigint, text string")
    pages = spark.createDataFrame([("book", 1, "x\nfox\nred")], "source string, page bigint, text string")
    run = R.queue_run(queue, catalog, logs, pages)
    assert sorted((r.term, r.file) for r in run.terms.collect()) == [("fox", "book"), ("fox", "log"), ("red", "book"), ("red", "log"), ("red", "log")]
    assert sorted((r.canonical, r.file, r.place, r["_i"]) for r in run.hits.collect()) == [
        ("Fox", "book", 1, 1), ("Fox", "log", 1, 0), ("Fox", "log", 2, 0), ("Hen", "book", 1, 2), ("Hen", "log", 1, 0), ("Hen", "log", 2, 0),
    ]
    assert sorted((r.canonical, r.rank, r.source, r.excerpt) for r in run.cited(1).collect()) == [("Fox", 1, "log#L1", "a red fox sat"), ("Hen", 1, "log#L1", "a red fox sat")]


def test_runs_that_are_no_terms_are_no_rows(spark):
    """Words that begin a term, with as many units as it has, are rows only where the term itself is likely."""
    rows = spark.createDataFrame([(1, "red a red b red c Été vert red fox x"), (2, None), (3, "")], "i int, text string")
    shapes = spans.shaped(spark.createDataFrame([("red fox",), ("Été vert",), ("/",)], "term string"))
    found = spans.spans(rows, F.col("text"), ["i"], shapes)
    assert {(r["_at"], r.term, r["_before"], r["_after"]) for r in found.collect()} == {(12, "Été vert", False, False), (16, "red fox", False, False)}
    searched = spans.Likely(shapes)
    texts = [b"red a", b"red b", b"red c", b"red fox", "Été vert".encode()]
    ends = [0]
    for t in texts:
        ends.append(ends[-1] + len(t))
    hashed = spans.Hashed(np.frombuffer(b"".join(texts), np.uint8))
    assert searched.passes(hashed.runs(np.array(ends[:-1]), np.array(ends[1:]))).tolist() == [False, False, False, True, True]


def test_units_are_those_of_the_pattern(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab_1 \t\n.,-́éßЖ中\U0001f600\x1c\xa0‍٣\x85") for _ in range(rng.randrange(30))) for _ in range(300)]
    want = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", spans.units(F.col("t")).alias("u")).orderBy("i").collect()
    data, begin = spans.bytes_of(pa.array(texts))
    start, _ = spans.unit_starts(data, begin[:-1], spans.kinds(spark).value)
    ends, bounds = [*start.tolist(), len(data)], np.searchsorted(start, begin)
    for r in want:
        assert [bytes(data[ends[k] : ends[k + 1]]).decode() for k in range(bounds[r.i], bounds[r.i + 1])] == r.u


def test_counts_of_names_that_share_terms(spark):
    """As many as the places of each name, though places and names never meet in an exchange."""
    rng = random.Random(3)
    places = [(d, f"f{i % 7}", i, i * 10 + d, i) for i in range(60) for d in (0, 1)]
    hits = [(t, *p) for p in places for t in "abcdef" if rng.random() < 0.4]
    hits += [("a", 1, "f0", 0, 99, 99)]
    names = [(n, t) for n, own in (("x", "abc"), ("y", "abc"), ("z", "f"), ("w", "adef"), ("v", "q")) for t in own]
    hits = spark.createDataFrame(hits, "term string, domain_rank int, file string, place long, _doc long, _i int")
    names = spark.createDataFrame(names, "canonical string, term string")
    got = R.mention_counts(hits, names)
    want = R.name_hits(hits, names).groupBy("canonical").count()
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    exchanges = [line for line in exchanged(R.mention_counts(hits, F.broadcast(names))) if "canonical" in line and "file" in line]
    assert not exchanges


def test_links_of_an_article_of_many_places(spark):
    """Places apart from each other need no fold; overlapping ones are resolved in reading order."""
    names = [("Red Fox", "rf"), ("Fox Den", "fd"), ("Den", "d"), ("Red", "r")]
    body = ". ".join(["Red", "Red Fox Den", "Den", "Fox Den Den", "Red Fox"] * 50)
    articles = spark.createDataFrame([("t", "T", "p", body, "general", 0, 1)] * 2, "slug string, title string, path string, body string, category string, part bigint, src_rank int")
    found = K.link_spans(articles, spark.createDataFrame(names, "name string, slug string"))
    assert {tuple(r) for r in found.groupBy("dst").count().collect()} == {("r", 50), ("rf", 100), ("d", 150), ("fd", 50)}


def exchanged(frame):
    """The lines of a plan that exchange rows by hash."""
    return [line for line in frame._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning" in line]


def test_batch_search_stores_no_counts(spark, monkeypatch):
    """Rows grow as documents, query words and results, not as documents times the words in them; ids that repeat are one document."""
    rng = random.Random(3)
    words = ["a", "an", "anan", "banana", "aa", "aaa", "ñandú", "du", "n"]
    rows = [(d % 90 if d else None, " ".join(rng.choices(words, k=60)) if d % 7 else None) for d in range(100)]
    asked = [(q // 2 if q else None, " ".join(rng.choices([*words, "zz", "ú"], k=4)) + "\n\taa") for q in range(20)]
    written = []
    keep = L.stored

    def recorded(df, label):
        out = keep(df, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(L, "stored", recorded)
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    queries = spark.createDataFrame(asked, "query_id int, text string")
    got = {(r.query_id, r.doc_id): (r.score, r["rank"]) for r in L.batch_search(docs, queries, 4, block=3).collect()}
    assert max(written) <= 100
    total = collections.Counter()
    for q, query in asked:
        for d, text in rows:
            total[q, d] += sum((text or "").count(t) for t in query.split())
    want = {}
    for q in {q for q, _ in asked} - {None}:
        scores = sorted((-n, d) for (own, d), n in total.items() if own == q and d is not None and n)[:4]
        want |= {(q, d): (float(-n), i + 1) for i, (n, d) in enumerate(scores)}
    assert got == want
    every = L.batch_search(docs, queries).collect()
    assert {(r.query_id, r.doc_id): r.score for r in every} == {k: float(n) for k, n in total.items() if n and k[0] is not None}


def test_best_of_many_groups(monkeypatch):
    """Groups, pieces and cuts of any size give the same best documents."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab ", k=rng.randint(0, 60))) + " " for _ in range(80)] + ["ab" * 40 + " "]
    asked = [(q, t, n) for q in range(9) for t, n in {"a": 1, "aba": 2, "ab" * rng.randint(1, 3): 1, "b" * rng.randint(1, 2): q + 1}.items()]
    rows = pa.table({"query_id": [r[0] for r in asked], "term": [r[1] for r in asked], "times": [r[2] for r in asked]})
    batch = pa.RecordBatch.from_arrays([pa.array(range(81)), pa.array(texts)], names=["doc_id", "text"])
    scores = collections.Counter()
    for q, t, n in asked:
        for d, text in enumerate(texts):
            scores[q, d] += n * text.count(t)
    want = {(q, d, float(-n)) for q in range(9) for n, d in sorted((-scores[q, d], d) for d in range(81) if scores[q, d])[:5]}
    for cells, kept, piece, dense in ((1 << 22, 200_000, 1 << 18, 256), (20, 0, 7, 2), (1, 10, 1, 0)):
        for name, value in (("CELLS", cells), ("KEPT", kept), ("PIECE", piece), ("DENSE", dense)):
            monkeypatch.setattr(substrings, name, value)
        found = [tuple(r.values()) for b in substrings.best_of(iter([batch]), substrings.asked_of(rows), ["q", "d", "s"], 5) for r in b.to_pylist()]
        assert len(found) == len(want) and set(found) == want
