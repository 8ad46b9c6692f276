"""Links between articles, link counts, citations and the index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.functions.text import strip, stripped_lines, title_case
from quillstone.operators.spans import shaped, spans

# Articles that neither link nor lend their names, and the category order of the index.
NO_LINKS = ("index", "entity-queue")
CATEGORY_ORDER = ("core", "general", "campaign", "campaign-queue")
TAG = r"<[^>]+>"
CUT = "\x01"


def link_dictionary(articles: DataFrame) -> DataFrame:
    """(name, slug): titles, ``- Synonyms:`` aliases and title-cased slug tails; the last writer wins."""
    usable = articles.where(~F.col("slug").isin(list(NO_LINKS)))

    def at(turn: int, *inner) -> Column:
        return F.struct(F.lit(turn).alias("pass"), "src_rank", "path", *inner).alias("at")

    no_line = (F.lit(0).cast("long").alias("part"), F.lit(-1).alias("line"), F.lit(0).alias("i"))
    titles = usable.where(F.col("part") == 0).select(F.col("title").alias("name"), "slug", at(0, *no_line))
    raw = F.transform(
        stripped_lines(F.col("body")),
        lambda s: F.when(F.startswith(F.lower(s), F.lit("- synonyms:")), strip(F.regexp_extract(s, "(?s):(.*)", 1))),
    )
    lists = usable.select("slug", "src_rank", "path", "part", F.posexplode_outer(raw).alias("line", "raw")).where(
        (F.col("raw") != "") & (F.lower("raw") != "_none_")
    )
    synonyms = lists.select(
        "slug", "src_rank", "path", "part", "line", F.posexplode(F.transform(F.split("raw", ","), strip)).alias("i", "name")
    ).select("name", "slug", at(0, "part", "line", "i"))
    tails = usable.where((F.col("part") == 0) & F.col("slug").rlike("^(lore|campaign)-entities-")).select(
        title_case(F.translate(F.regexp_replace("slug", "^(lore|campaign)-entities-", ""), "-", " ")).alias("name"),
        "slug",
        at(1, *no_line),
    )
    return (
        titles.unionByName(synonyms)
        .unionByName(tails)
        .where(F.col("name") != "")
        .groupBy("name")
        .agg(F.max_by("slug", "at").alias("slug"))
    )


def link_spans(articles: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(src, dst) for each place outside of tags where an article names another one.

    Names are case-sensitive and have no word character or slash beside them. Reading on from the end of the last name,
    the longest name at a place wins and uses up its text. Names are found as runs of words (``spans``), so bodies stay
    where they are. A place that shares no text with another one is taken; places that overlap, one after the other, are
    put in order and resolved by one fold, which thus is as long as such a knot and not as the article.
    """
    names = shaped(dictionary.select(F.col("name").alias("term"), F.col("slug").alias("dst")))
    plain = articles.where(~F.col("slug").isin(list(NO_LINKS))).select(
        F.col("slug").alias("src"), "part", F.regexp_replace("body", TAG, CUT).alias("text")
    )
    found = spans(plain, F.col("text"), ["src", "part"], names, also="/")
    order = W.partitionBy("src", "part").orderBy("_at", F.desc("_size"), F.asc_nulls_last("dst"))
    ended = F.max("_end").over(order.rowsBetween(W.unboundedPreceding, -1))
    places = (
        found.where(~F.col("_before") & ~F.col("_after"))
        .select("src", "part", "_at", "_size", "dst", (F.col("_at") + F.col("_size")).alias("_end"))
        .withColumn("_apart", F.col("_at") >= F.coalesce(ended, F.lit(0)))
        .withColumn("_alone", F.col("_apart") & (F.coalesce(F.lead("_at").over(order), F.col("_end")) >= F.col("_end")))
        .withColumn("_knot", F.count_if("_apart").over(order.rowsBetween(W.unboundedPreceding, 0)))
    )
    knots = places.where(~F.col("_alone")).groupBy("src", "part", "_knot").agg(
        F.array_sort(F.collect_list(F.struct("_at", (-F.col("_size")).alias("size"), "dst"))).alias("places")
    )
    nothing = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("taken"))

    def step(state: Column, p: Column) -> Column:
        taken = F.struct((p["_at"] - p["size"]).alias("end"), F.concat(state["taken"], F.array(p["dst"])).alias("taken"))
        return F.when(p["_at"] >= state["end"], taken).otherwise(state)

    taken = F.aggregate("places", nothing, step, lambda state: state["taken"])
    every = places.where("_alone").select("src", "dst").unionByName(knots.select("src", F.explode(taken).alias("dst")))
    return every.where(F.col("src") != F.col("dst"))


def extract_links(articles: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Distinct (src, dst) of ``link_spans``."""
    return link_spans(articles, dictionary).distinct()


def outgoing_edges(articles: DataFrame) -> DataFrame:
    """(src, dst, n): how often each article names each other one."""
    return link_spans(articles, link_dictionary(articles)).groupBy("src", "dst").agg(F.count("*").alias("n"))


def inbound_counts(articles: DataFrame, edges: DataFrame) -> DataFrame:
    """In-degree of every article, also zero."""
    degree = edges.groupBy(F.col("dst").alias("slug")).agg(F.count("*").alias("inbound"))
    return (
        articles.select("slug").distinct().join(degree, "slug", "left")
        .select("slug", F.coalesce("inbound", F.lit(0)).cast("long").alias("inbound"))
    )


def backlinks(articles: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct sources of the links to each article with their titles, one row each, in order.

    Rows instead of an array, because a popular article may hold a large share of all links.
    """
    titles = articles.select(F.col("slug").alias("src"), "title").dropDuplicates(["src"])
    return (
        edges.select("src", "dst").distinct()
        .join(titles, "src", "left")
        .select(F.col("dst").alias("slug"), "src", F.coalesce("title", "src").alias("title"))
        .orderBy("slug", "src")
    )


def outbound_count(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("slug")).agg(F.count_distinct("dst").alias("outbound"))


def parse_citation(citations: DataFrame, roots: Sequence[str], column: str = "citation") -> DataFrame:
    """(citation, path, line, section) of ``path#Ln`` and ``path#PAGE-n`` below one of the roots."""
    raw = strip(F.col(column))
    line = F.nullif(F.regexp_extract(raw, r"#L(\d+)\z", 1), F.lit(""))
    page = F.nullif(F.regexp_extract(raw, r"#(PAGE-\d+)\z", 1), F.lit(""))
    path = strip(F.try_url_decode(F.regexp_replace(raw, r"#(?:L|PAGE-)\d+\z", "")))
    allowed = F.lit(False)
    for root in roots:
        clean = root.rstrip("/")
        allowed = allowed | (F.col("path") == clean) | F.startswith("path", F.lit(clean + "/"))
    return citations.select(
        F.col(column).alias("citation"), path.alias("path"), line.cast("long").alias("line"), page.alias("section")
    ).where(allowed)


def article_index(articles: DataFrame, inbound: DataFrame, hidden: str | None = None, pinned: str | None = None) -> DataFrame:
    """Articles by category, then title ignoring case, with their in-degree.

    ``hidden`` is left out where ``pinned`` exists.
    """
    rows = articles.where(F.col("part") == 0).select("slug", "title", "category")
    if hidden is not None:
        has_pin = rows.where(F.col("slug") == pinned).agg(F.count("*").alias("n")).scalar()
        rows = rows.where(~((F.col("slug") == hidden) & (has_pin > 0)))
    rank = F.lit(None).cast("int")
    for i, c in enumerate(CATEGORY_ORDER):
        rank = F.when(F.col("category") == c, i).otherwise(rank)
    return (
        rows.join(inbound, "slug", "left")
        .withColumn("category_rank", rank)
        .where(F.col("category_rank").isNotNull())
        .select("category_rank", "category", "title", "slug", F.coalesce("inbound", F.lit(0)).cast("long").alias("inbound"))
        .orderBy("category_rank", F.lower("title"), "slug")
    )


def source_window(lines: DataFrame, target: Column, before: int = 40, size: int = 1400) -> DataFrame:
    """Lines around a target line: (keys..., line_no, marked, text)."""
    start = F.when(target > before, target - before).otherwise(0)
    keep = [c for c in lines.columns if c not in ("line_no", "text")]
    return lines.where((F.col("line_no") > start) & (F.col("line_no") <= start + size)).select(
        *keep, "line_no", F.coalesce(F.col("line_no") == target, F.lit(False)).alias("marked"), "text"
    )


def diagnostics(articles: DataFrame, manifest: DataFrame, queue: DataFrame, submissions: DataFrame) -> DataFrame:
    """(metric, value): articles per category, manifest rows per scope, queue and submission counts."""
    by_category = articles.where(F.col("part") == 0).groupBy("category").agg(F.count("*").alias("value"))
    scope = F.lower(F.coalesce("scope", F.lit("")))
    scopes = manifest.agg(
        F.count("*").alias("manifest_rows"),
        F.count_if(scope == "campaign").alias("manifest_campaign"),
        F.count_if(scope == "general").alias("manifest_general"),
    ).unpivot([], ["manifest_rows", "manifest_campaign", "manifest_general"], "metric", "value")
    return (
        by_category.select(F.concat(F.lit("articles_"), "category").alias("metric"), "value")
        .unionByName(articles.where(F.col("part") == 0).agg(F.count("*").alias("value")).select(F.lit("articles_total").alias("metric"), "value"))
        .unionByName(scopes)
        .unionByName(queue.agg(F.count("*").alias("value")).select(F.lit("queue_rows").alias("metric"), "value"))
        .unionByName(submissions.agg(F.count("*").alias("value")).select(F.lit("submissions").alias("metric"), "value"))
    )


def latest_requests(queue: DataFrame, n: int = 5) -> DataFrame:
    return queue.orderBy(F.desc(F.coalesce("ts", F.lit(0))), "request_id").limit(n)


def data_source_counts(inventory: DataFrame) -> DataFrame:
    """Entries per group and subgroup; the group total has an empty subgroup."""
    return (
        inventory.rollup("group_name", "subgroup")
        .agg(F.count("*").alias("n"))
        .where(F.col("group_name").isNotNull())
        .select("group_name", F.coalesce("subgroup", F.lit("")).alias("subgroup"), "n")
    )
