"""Articles of the knowledge base from entity files, documents and queue dossiers.

An article is one row. Its body is one text by definition, however many files it is made of; ``part`` numbers the rows
of callers that cut bodies themselves and is 0 here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import base_name, entity_key, heading_title, rstrip, stem, strip, title_case
from quillstone.operators.ranking import joined_in_order

# Document roots in reading order, with slug prefix, category and what an equal slug does.
ROOTS = (
    # root, slug prefix, category, overrides an earlier article
    ("lore", "lore", "general", False),
    ("campaign_entities", "campaign-entities", "campaign", False),
    ("campaign", "campaign", "campaign", False),
    ("topics", "topics", "general", True),
    ("sessions", "sessions", "campaign", True),
    ("requests", "campaign-requests", "campaign-queue", True),
)
TITLE_PREFIXES = ("Campaign NPC: ", "Campaign PC: ", "Campaign Entity: ")


def by_root(root: Column, position: int, default: str) -> Column:
    out = F.lit(default)
    for row in ROOTS:
        out = F.when(root == row[0], F.lit(row[position])).otherwise(out)
    return out


def article_category(root: Column, scope: Column | None = None) -> Column:
    """Category of an article by the root it comes from; manifest entities by their scope."""
    category = by_root(root, 2, "core")
    if scope is None:
        return category
    return F.when(root == "manifest", F.when(scope == "campaign", "campaign").otherwise("general")).otherwise(category)


def aggregate_entity_body(files: DataFrame) -> DataFrame:
    """Bodies of entities (scope, entity, part, path, body) from their files.

    ``files`` has (scope, entity, kind, name, path, body). Markdown files are joined by a blank line in
    name order; the names of the JSONL files follow as a list. Entities without Markdown have no body.
    """
    order = F.struct(F.lower("name").alias("low"), "name", "path")
    kind = F.col("kind")
    grouped = files.groupBy("scope", "entity").agg(
        F.min_by("path", F.when(kind == "md", order)).alias("path"),
        joined_in_order(order, F.when((kind == "md") & (strip(F.col("body")) != ""), strip(F.col("body"))), "\n\n").alias("text"),
        joined_in_order(order, F.when(kind == "jsonl", F.concat(F.lit("\n- `"), "name", F.lit("`"))), "").alias("names"),
    )
    tail = F.when(F.col("names") != "", F.concat(F.lit("\n\n## Data files (JSONL)\n"), "names")).otherwise("")
    return grouped.where(F.col("path").isNotNull()).select(
        "scope", "entity", F.lit(0).cast("long").alias("part"), "path", F.concat("text", tail).alias("body")
    )


def unlisted_bodies(files: DataFrame) -> DataFrame:
    """Bodies of entities without a manifest: all Markdown files (scope, name, path, body) of a scope with the same first name part.

    Sub-documents and the single document stand together, and data files are not listed.
    """
    found = files.where(F.col("name").endswith(".md")).select(
        "scope", F.substring_index("name", ".", 1).alias("entity"), F.lit("md").alias("kind"), "name", "path", "body"
    )
    return aggregate_entity_body(found)


def entity_articles(bodies: DataFrame, general_keys: DataFrame) -> DataFrame:
    """Manifest entities as articles; campaign entities known as general ones are left out."""
    in_campaign = F.col("scope") == "campaign"
    rows = bodies.withColumn("key", F.when(in_campaign, entity_key(F.col("entity")))).join(
        general_keys, "key", "left_anti"
    )
    prefix = F.when(in_campaign, "campaign-entities-").otherwise("lore-entities-")
    fallback = title_case(F.replace("entity", F.lit("-"), F.lit(" ")))
    return rows.select(
        F.concat(prefix, F.lower(F.replace("entity", F.lit("_"), F.lit("-")))).alias("slug"),
        heading_title(F.col("body"), fallback).alias("title"),
        "path",
        "body",
        article_category(F.lit("manifest"), F.col("scope")).alias("category"),
        "part",
        F.lit(0).alias("src_rank"),
        F.lit(1).alias("precedence"),
    )


def document_articles(files: DataFrame, general_keys: DataFrame, taken: DataFrame) -> DataFrame:
    """Documents (root, rel_path, body) as articles.

    Files below a ``requests`` folder, and entity files below the campaign root, belong to other roots;
    the requests root itself is flat.
    A sub-document ``<e>.<section>`` is left out when its entity already has an article: one of
    ``taken``, or a file before it. Campaign documents of general entities are left out.
    """
    name = base_name(F.col("rel_path"))
    folders = F.slice(F.split("rel_path", "/"), 1, F.greatest(F.size(F.split("rel_path", "/")) - 1, F.lit(0)))
    root = F.col("root")
    known = [r[0] for r in ROOTS]
    rows = files.where(root.isin(known)).where(
        ~(root.isin("lore", "campaign_entities", "campaign") & F.array_contains(folders, "requests"))
        & ~((root == "campaign") & F.array_contains(folders, "entities"))
        & ~((root == "requests") & (F.size(folders) > 0))
    )
    no_suffix = stem(F.col("rel_path"))
    slug = F.concat(
        by_root(root, 1, ""), F.lit("-"), F.translate(F.lower(F.replace(no_suffix, F.lit("/"), F.lit("-"))), "_", "-")
    )
    rank = F.lit(0)
    for i, r in enumerate(ROOTS):
        rank = F.when(root == r[0], i + 1).otherwise(rank)
    overrides = root.isin([r[0] for r in ROOTS if r[3]])
    file_stem = stem(name)
    campaign_side = root.isin("campaign_entities", "campaign")
    rows = rows.select(
        slug.alias("slug"),
        heading_title(F.col("body"), title_case(F.replace(file_stem, F.lit("_"), F.lit(" ")))).alias("title"),
        F.concat(root, F.lit("/"), "rel_path").alias("path"),
        "body",
        article_category(root).alias("category"),
        F.lit(0).cast("long").alias("part"),
        rank.alias("src_rank"),
        F.when(overrides, 2).otherwise(0).alias("precedence"),
        F.when(campaign_side, entity_key(file_stem)).alias("key"),
        F.when(
            (root == "campaign_entities") & F.contains(file_stem, F.lit(".")),
            F.concat(
                F.lit("campaign-entities-"),
                F.translate(F.lower(F.substring_index(file_stem, ".", 1)), "_", "-"),
            ),
        ).alias("base_slug"),
    )
    firsts = (
        taken.select(F.col("slug").alias("base_slug"), F.lit("").alias("first"))
        .unionByName(
            rows.where((F.col("src_rank") == 2) & F.col("base_slug").isNull()).select(
                F.col("slug").alias("base_slug"), F.col("path").alias("first")
            )
        )
        .groupBy("base_slug")
        .agg(F.min("first").alias("first"))
    )
    return (
        rows.join(general_keys, "key", "left_anti")
        .join(firsts, "base_slug", "left")
        .where(F.col("first").isNull() | (F.col("first") >= F.col("path")))
        .drop("key", "base_slug", "first")
    )


def winners(candidates: DataFrame) -> DataFrame:
    """The winning path of each slug, decided on narrow rows without bodies.

    Overriding roots and manifest entities: the last one wins. Other documents: the first one wins and
    only where nothing else has the slug.
    """
    place = F.struct("precedence", "src_rank", "path")
    return (
        candidates.where(F.col("part") == 0)
        .groupBy("slug")
        .agg(
            F.max_by("path", F.when(F.col("precedence") > 0, place)).alias("later"),
            F.min_by("path", F.when(F.col("precedence") == 0, place)).alias("earlier"),
        )
        .select("slug", F.coalesce("later", "earlier").alias("path"))
    )


def build_articles(bodies: DataFrame, files: DataFrame, listed: bool = True) -> DataFrame:
    """All articles: (slug, title, path, body, category, part, src_rank).

    ``bodies`` come from the manifest (scope, entity, part, path, body), ``files`` are documents
    (root, rel_path, body). Without a manifest (``listed`` is false, see ``unlisted_bodies``) a general entity does not
    hide a campaign one.
    """
    general = F.col("scope") == "general" if listed else F.lit(False)
    general_keys = bodies.where(general).select(entity_key(F.col("entity")).alias("key")).distinct()
    entities = entity_articles(bodies, general_keys)
    documents = document_articles(files, general_keys, entities.select("slug").distinct())
    candidates = entities.unionByName(documents)
    chosen = candidates.join(winners(candidates), ["slug", "path"], "left_semi").drop("precedence")
    core = files.sparkSession.createDataFrame(
        [
            ("index", "Index", None, "# Index\n\nBrowse every knowledge article.", "core", 0, 9),
            ("entity-queue", "Entity Request Queue", None, "# Entity Request Queue", "core", 0, 9),
        ],
        "slug string, title string, path string, body string, category string, part bigint, src_rank int",
    )
    return chosen.select(core.columns).unionByName(core)


def merge_pinned_article(
    articles: DataFrame, candidates: Sequence[str], extra: DataFrame, alias: str, title: str, heading: str
) -> DataFrame:
    """Append ``extra`` (pos, body) to the first existing candidate and show it under ``alias`` too.

    ``extra`` is a handful of profile documents, so its text is one scalar.
    """
    rank = F.lit(None).cast("int")
    for i, slug in reversed(list(enumerate(candidates))):
        rank = F.when(F.col("slug") == slug, i).otherwise(rank)
    best = articles.where(rank.isNotNull()).agg(F.min_by("slug", rank).alias("s")).scalar()
    more = extra.agg(joined_in_order("pos", "body", "\n\n").alias("b")).scalar()
    merged = F.concat(rstrip(F.col("body")), F.lit(f"\n\n---\n\n# {heading}\n\n"), more)
    is_best = (F.col("slug") == best) & (F.col("part") == 0)
    done = articles.where(F.col("slug") != alias).select(
        "slug",
        F.when(is_best, title).otherwise(F.col("title")).alias("title"),
        "path",
        F.when(is_best, merged).otherwise(F.col("body")).alias("body"),
        "category",
        "part",
        "src_rank",
    )
    twin = done.where(F.col("slug") == best).withColumn("slug", F.lit(alias))
    kept = articles.where((F.col("slug") == alias) & best.isNull()).select(done.columns)
    return done.unionByName(twin).unionByName(kept)


def bare_title(title: Column) -> Column:
    for prefix in TITLE_PREFIXES:
        title = F.replace(title, F.lit(prefix), F.lit(""))
    return strip(title)


def entity_choices(articles: DataFrame) -> DataFrame:
    """Distinct names of the campaign entities in order."""
    names = articles.where(F.startswith("slug", F.lit("campaign-entities-")) & (F.col("part") == 0))
    return (
        names.select(bare_title(F.col("title")).alias("name")).where(F.col("name") != "").distinct().orderBy("name")
    )
