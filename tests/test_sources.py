"""Files, folders and versions."""

import re

import pytest
from pyspark.sql import functions as F

from quillstone import api
from quillstone.operators import pages as P
from quillstone.plans import views
from quillstone.sources import scans, sinks, versions


def test_documents_in_buckets(spark, tmp_path):
    """The number of folders does not depend on the documents, and a new version replaces the old one as a whole."""
    path = str(tmp_path / "docs")
    for n in (50, 3000):
        docs = spark.range(n).select(F.col("id").alias("key"), F.concat(F.lit("body\n\n"), F.col("id").cast("string"), F.lit(f" of {n}")).alias("body"))
        version = sinks.write_docs(docs, path, buckets=8)
        assert len([p for p in (tmp_path / "docs" / version.rsplit("/", 1)[1]).iterdir() if p.name.startswith("bucket=")]) == 8
        read = {r.key: r.body for r in sinks.read_docs(spark, path).collect()}
        assert read == {i: f"body\n\n{i} of {n}" for i in range(n)}
    some = sinks.read_docs(spark, path, keys=[5, 2999, 10**6], buckets=8)
    assert sorted(r.key for r in some.collect()) == [5, 2999]
    assert "PartitionFilters: [bucket" in some._jdf.queryExecution().toString()


def test_failed_step_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "kb")
    with pytest.raises(FileNotFoundError):
        versions.read_table(spark, root, "a")
    versions.write_tables(spark, root, [("a", lambda: spark.range(3)), ("b", lambda: spark.range(1))])
    first = versions.current(spark, root)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        versions.write_tables(spark, root, [("a", lambda: spark.range(9)), ("b", lambda: spark.range(4).select((F.lit(1) / (F.col("id") - 2)).alias("x")))])
    assert versions.current(spark, root) == first and versions.read_table(spark, root, "a").count() == 3
    versions.write_tables(spark, root, [("a", lambda: spark.range(7))])
    assert versions.current(spark, root) != first and versions.read_table(spark, root, "a").count() == 7


def test_published_rebuild(spark, tmp_path):
    from tests.test_operators import small_sources

    root = str(tmp_path / "kb")
    api.publish_rebuild(small_sources(spark), root, scope="entity")
    assert versions.read_table(spark, root, "mentions").count() > 0
    with pytest.raises(ValueError, match="scope"):
        api.publish_rebuild(small_sources(spark), root, scope="nothing")


def test_listing_opens_no_file(spark, tmp_path):
    root = str(tmp_path / "lib")
    files = [("lib/core_rules/a.pdf", "é"), ("lib/core_rules/._b.pdf", "x"), ("lib/misc/c.pdf", "x"), ("lib/adventures/d.txt", "x"), ("lib/adventures/x/e.pdf", "x")]
    sinks.write_files(spark.createDataFrame(files, "path string, text string"), root)
    listed = scans.list_files(spark, root)
    assert "content" not in re.findall(r"ReadSchema: (\S+)", listed._jdf.queryExecution().toString())[0]
    assert {(r.path, r.length) for r in scans.list_work_items(listed).collect()} == {("lib/core_rules/a.pdf", 2)}
    assert {r.path for r in listed.collect()} >= {"lib/misc/c.pdf", "lib/adventures/x/e.pdf"}


def test_scopes_read_their_folders_only(spark, tmp_path):
    path = str(tmp_path / "scoped")
    rows = [("p1", "lore", "a"), ("p1", "lore", "b"), ("p2", "campaign", "c"), ("p3", "90_derived", "d"), ("p4", "other", "e")]
    spark.createDataFrame(rows, "path string, scope string, text string").write.partitionBy("scope").parquet(path)
    found = scans.scan_scopes(spark.read.parquet(path), scans.scope_table(spark), "Rules")
    assert "dynamicpruning" in found._jdf.queryExecution().toString()
    assert {r.path for r in found.collect()} == {"p1", "p3"} and found.count() == 2
    assert scans.scan_scopes(spark.read.parquet(path), scans.scope_table(spark), "unknown").count() == 0


def test_ranges_from_a_table(spark):
    """Any number of ranges, overlapping, empty and wide ones; no pair of all pages with all ranges."""
    pages = spark.createDataFrame([(b, p, f" {b}.{p}") for b in ("x", "y") for p in range(1, 130)], "book string, page bigint, text string")
    ranges = [("x", a, a + w, f"r{a}") for a, w in ((1, 0), (30, 5), (32, 64), (120, 500), (700, 3))] + [("y", i, i, "one") for i in range(1, 400)] + [("z", 1, 5, "gone")]
    plan = spark.createDataFrame(ranges, "book string, a bigint, b bigint, hint string")
    got = P.split_page_ranges(pages, plan)
    assert not re.search("NestedLoop|Cartesian", got._jdf.queryExecution().toString())
    want = {}
    for book, a, b, hint in ranges:
        here = [p for p in range(a, b + 1) if book != "z" and p < 130]
        want[book, f"chunk_{a:03d}-{b:03d}_{hint}"] = "".join(f"===== PAGE {p} ===== {book}.{p}" for p in here)
    assert {(r.book, r.chunk_name): r.text for r in got.collect()} == want
    short = P.split_page_ranges(pages, [(1, 2, "a"), (500, 501, "b")])
    assert {(r.book, r.chunk_name, r.n_chars > 0) for r in short.collect()} == {(b, c, c[6] == "0") for b in "xy" for c in ("chunk_001-002_a", "chunk_500-501_b")}


def test_a_text_table_is_dealt_out_by_its_splits(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    files = cores // 2 + 2
    spark.range(1000).selectExpr("id AS doc_id", "repeat('word ', 50) AS text").repartition(files).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # less than two files
    try:
        splits = spark.read.parquet(f"{tmp_path}/documents.parquet").rdd.getNumPartitions()
        dealt = views.table(spark, str(tmp_path), "documents")
        assert dealt.rdd.getNumPartitions() == (max(cores, 4 * splits) if splits < 4 * cores else splits)
        assert dealt.rdd.getNumPartitions() > cores
        assert sorted(r[0] for r in dealt.select("doc_id").collect()) == list(range(1000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
