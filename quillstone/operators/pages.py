"""Page-marked books: parsing, splitting, assembling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import let, stem, strip
from quillstone.operators.ranking import joined_in_order

# The page marker and the texts for pages without a result.
PAGE_MARKER = r"(?md)^=====\s*PAGE\s+(\d+)\s*=====\s*$"
MISSING_PAGE = "[MISSING_PAGE_OUTPUT]"
FAILED_PAGE = "[OCR_ERROR] "


def marker(page):
    return F.concat(F.lit("===== PAGE "), page.cast("string"), F.lit(" ====="))


def parse_pages(docs: DataFrame, trim: str = "newlines", key: str = "book") -> DataFrame:
    """Pages of marked texts: (key, page, text).

    Text before the first marker is dropped; of equal page numbers the last wins. ``trim`` is
    ``newlines``, ``all`` or ``none``. All of it happens inside the document's row.
    """
    numbers = F.regexp_extract_all(F.col("text"), F.lit(PAGE_MARKER), 1)
    bodies = F.split(F.col("text"), PAGE_MARKER, -1)

    def last_of_each(found):
        ordered = F.array_sort(
            F.transform(found["n"], lambda n, i: F.struct(n.cast("long").alias("page"), i.alias("i")))
        )
        return let(
            ordered,
            lambda rows: F.transform(
                F.filter(
                    rows,
                    lambda r, k: (k == F.size(rows) - 1)
                    | (rows[F.least(k + 1, F.size(rows) - 1)]["page"] != r["page"]),
                ),
                lambda r: F.struct(r["page"].alias("page"), found["b"][r["i"] + 1].alias("text")),
            ),
        )

    found = let(F.struct(numbers.alias("n"), bodies.alias("b")), last_of_each)
    rows = docs.select(key, F.explode_outer(found).alias("p")).where(F.col("p").isNotNull())
    text = F.col("p.text")
    if trim == "newlines":
        text = F.btrim(text, F.lit("\n"))
    elif trim == "all":
        text = strip(text)
    elif trim != "none":
        raise ValueError(f"unknown trim mode {trim!r}")
    return rows.select(key, F.col("p.page").alias("page"), text.alias("text"))


def synthesize_pages(files: DataFrame) -> DataFrame:
    """Pages from files (book, name, text) called ``page_<n>``; other suffixes are skipped."""
    number = F.substring_index(stem(F.col("name")), "_", -1).try_cast("bigint")
    return (
        files.select("book", "name", number.alias("page"), F.btrim("text", F.lit("\n")).alias("text"))
        .where(F.col("page").isNotNull() & F.startswith(F.col("name"), F.lit("page_")))
        .groupBy("book", "page")
        .agg(F.max_by("text", "name").alias("text"))
    )


def plan_table(books: DataFrame, plan: Sequence[tuple[int, int, str]]) -> DataFrame:
    """A short plan (first page, last page, hint) for each of the books, as (book, a, b, hint)."""
    ranges = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(h).alias("hint")) for a, b, h in plan])
    return books.select("book", F.inline(ranges))


def split_page_ranges(pages: DataFrame, plan: DataFrame | Sequence[tuple[int, int, str]], width: int = 32) -> DataFrame:
    """One text per planned range (book, a, b, hint) of pages; a range without pages gives an empty text.

    Ranges and pages are joined on the book and on buckets of ``width`` pages, then compared, so any number of ranges
    meets only the pages near them. A group holds at most the pages of one range.
    """
    if not isinstance(plan, DataFrame):
        plan = plan_table(pages.select("book").distinct(), plan)
    named = plan.select(
        "book", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.format_string("chunk_%03d-%03d_%s", "a", "b", "hint").alias("chunk_name")
    ).distinct()

    def bucket(page):
        return F.floor(page / width).cast("long")

    spread = named.where("a <= b").select("*", F.explode(F.sequence(bucket(F.col("a")), bucket(F.col("b")))).alias("bucket"))
    text = F.concat(marker(F.col("page")), "text").alias("text")
    near = pages.select("book", "page", text, bucket(F.col("page")).alias("bucket"))
    hits = near.join(spread, ["book", "bucket"]).where(F.col("page").between(F.col("a"), F.col("b"))).select("book", "page", "text", "chunk_name")
    empty = named.select("book", F.lit(None).cast("long").alias("page"), F.lit("").alias("text"), "chunk_name")
    return (
        hits.unionByName(empty)
        .groupBy("book", "chunk_name")
        .agg(joined_in_order("page", "text", "").alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )


def assemble_document(pages: DataFrame, totals: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Marked text of pages 1..total of every book: (book, text).

    A missing page gets a fixed text, a failed one its error. A document is one text by definition.
    """
    wanted = totals.select("book", F.explode(F.sequence(F.lit(1).cast("long"), F.col("total").cast("long"))).alias("page"))
    rows = wanted.join(pages.select("book", "page", "text"), ["book", "page"], "left")
    text = F.coalesce("text", F.lit(MISSING_PAGE))
    if errors is not None:
        rows = rows.join(errors.select("book", "page", "error"), ["book", "page"], "left")
        text = F.coalesce(F.concat(F.lit(FAILED_PAGE), "error"), text)
    piece = F.concat(F.lit("\n\n"), marker(F.col("page")), F.lit("\n"), text)
    return rows.select("book", "page", piece.alias("piece")).groupBy("book").agg(joined_in_order("page", "piece", "").alias("text"))


def compile_text(candidates: DataFrame) -> DataFrame:
    """Preferred text (lowest ``pref``) of every book with the tag of its source."""
    return candidates.groupBy("book").agg(
        F.min_by(F.struct("source", "text"), "pref").alias("c")
    ).select("book", "c.source", "c.text")
