"""Topic and entity lexicons applied to pages.

A lexicon is a short argument list, so each pattern becomes a literal that is compiled once per task and
a page is tagged in one pass without a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.functions.text import left, let, stripped_lines

ANY_CASE = "(?iU)"  #: ignoring case, with word characters and borders of all scripts
Topics = Sequence[tuple[str, Sequence[str]]]
Entities = Sequence[tuple[str, str]]


def count_hits(text: Column, patterns: Sequence[str]) -> Column:
    """Sum of the matches of all patterns; overlapping patterns count twice."""
    low = F.lower(text)
    total = F.lit(0).cast("long")
    for p in patterns:
        total = total + F.regexp_count(low, F.lit(ANY_CASE + p))
    return total


def leading_snippets(text: Column, n: int = 2, min_len: int = 20, width: int = 220) -> Column:
    long_lines = F.filter(stripped_lines(text), lambda s: F.length(s) > min_len)
    return F.transform(F.slice(long_lines, 1, n), lambda s: left(s, width))


def topic_page_index(pages: DataFrame, lexicon: Topics) -> DataFrame:
    """(topic, book, page, hits, snippets) of every page with at least one hit."""
    hits = let(
        F.lower("text"),
        lambda low: F.filter(
            F.array(
                *[F.struct(F.lit(name).alias("topic"), count_hits(low, ps).alias("hits")) for name, ps in lexicon]
            ),
            lambda r: r["hits"] > 0,
        ),
    )
    return (
        pages.select("book", "page", leading_snippets(F.col("text")).alias("snippets"), F.explode_outer(hits).alias("h"))
        .where(F.col("h").isNotNull())
        .select("h.topic", "book", "page", "h.hits", "snippets")
    )


def lexicon_names(spark, lexicon) -> DataFrame:
    rows = [(i, entry[0]) for i, entry in enumerate(lexicon)]
    return spark.createDataFrame(rows, "pos bigint, name string")


def topic_scores(index: DataFrame, books: DataFrame, lexicon: Topics) -> DataFrame:
    """Score of every topic, also of those without hits.

    ``books`` counts for coverage even where it has no pages. Counting distinct books first reduces to
    (topic, book), so no topic is one big group.
    """
    per_topic = index.groupBy("topic").agg(
        F.count_distinct("book").alias("coverage_books"),
        F.sum("hits").alias("total_hits"),
        F.count("*").alias("citation_count"),
    )
    total = books.agg(F.greatest(F.count_distinct("book"), F.lit(1)).alias("n")).scalar()
    names = lexicon_names(index.sparkSession, lexicon).withColumnRenamed("name", "topic")
    zero = F.lit(0).cast("long")
    filled = names.join(per_topic, "topic", "left").select(
        "pos",
        "topic",
        F.coalesce("coverage_books", zero).alias("coverage_books"),
        total.alias("coverage_total_books"),
        F.coalesce("total_hits", zero).alias("total_hits"),
        F.coalesce("citation_count", zero).alias("citation_count"),
        F.max("total_hits").over(W.partitionBy()).alias("_most"),  # one row per topic of the lexicon
    )
    ratio = F.when(F.col("_most") > 0, F.col("total_hits") / F.col("_most")).otherwise(0.0)
    coverage = F.col("coverage_books") / F.col("coverage_total_books")
    return filled.withColumn("score", F.round((coverage * 0.6 + ratio * 0.4) * 100, 1)).drop("_most")


def topic_detail(index: DataFrame) -> DataFrame:
    return index.orderBy("topic", "book", "page")


def topic_ranking(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc("score"), "pos")


def pick_line(text: Column, lines: Column, pattern: str, width: int = 260, fallback: int = 220) -> Column:
    """First line that matches, else the beginning of the text."""
    found = F.get(F.filter(lines, lambda s: (s != "") & s.rlike(ANY_CASE + pattern)), F.lit(0))
    return F.coalesce(left(found, width), left(text, fallback))


def tag_entities(pages: DataFrame, lexicon: Entities, keep: Sequence[str] = ("book", "page")) -> DataFrame:
    """(entity, keep..., snippet) for each entity whose pattern occurs in the text, ignoring case."""
    text = F.col("text")
    tags = let(
        F.struct(F.lower(text).alias("low"), stripped_lines(text).alias("lines")),
        lambda v: F.array_compact(
            F.array(
                *[
                    F.when(
                        v["low"].rlike(ANY_CASE + p),
                        F.struct(F.lit(name).alias("entity"), pick_line(text, v["lines"], p).alias("snippet")),
                    )
                    for name, p in lexicon
                ]
            )
        ),
    )
    return (
        pages.select(*keep, F.explode_outer(tags).alias("t"))
        .where(F.col("t").isNotNull())
        .select("t.entity", *keep, "t.snippet")
    )


def lore_union(manual_tags: DataFrame, import_tags: DataFrame, prefix: str = "Wordpress/") -> DataFrame:
    """Page references and references of imported documents (folder, source) in one table."""
    manual = manual_tags.select(
        "entity", F.lit("manual").alias("source_kind"), F.col("book").alias("manual"), "page", "snippet"
    )
    imported = import_tags.select(
        "entity",
        F.lit("wordpress").alias("source_kind"),
        F.concat(F.lit(prefix), "folder").alias("manual"),
        F.col("source"),
        "snippet",
    )
    return manual.unionByName(imported, allowMissingColumns=True)


def entity_ref_counts(tags: DataFrame, lexicon: Entities) -> DataFrame:
    """References per entity, also zero, most cited first and ties in lexicon order."""
    counts = tags.groupBy("entity").agg(F.count("*").alias("refs"))
    names = lexicon_names(tags.sparkSession, lexicon).withColumnRenamed("name", "entity")
    return (
        names.join(counts, "entity", "left")
        .select("pos", "entity", F.coalesce("refs", F.lit(0)).cast("long").alias("refs"))
        .orderBy(F.desc("refs"), "pos")
    )


def entity_ref_list(refs: DataFrame) -> DataFrame:
    """Cited mentions in reading order, one row each, with the page in the citation when there is one."""
    where = F.concat(F.col("manual"), F.coalesce(F.concat(F.lit(" p."), F.col("page").cast("string")), F.lit("")))
    return refs.select(
        "entity", "source_kind", "manual", "page", "source", where.alias("citation"), "snippet"
    ).orderBy("entity", "source_kind", "manual", F.asc_nulls_last("page"), "source")
