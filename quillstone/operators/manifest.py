"""Entity manifest: files of every entity, without duplicates between scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import entity_key, stem


def listed_files(files: DataFrame) -> DataFrame:
    """Markdown and JSONL files (scope, path, name) with their entity: the name up to the first dot."""
    name = F.col("name")
    kind = F.when(name.endswith(".md"), "md").when(name.endswith(".jsonl"), "jsonl")
    return files.select(
        "scope", F.substring_index(name, ".", 1).alias("entity"), kind.alias("kind"), "name", "path"
    ).where(F.col("kind").isNotNull())


def prefer_subsections(listed: DataFrame) -> DataFrame:
    """Drop ``<e>.md`` where some ``<e>.<section>.md`` exists.

    Only the single-document rows need the check, so the join does not move the other files.
    """
    single = (F.col("kind") == "md") & (stem(F.col("name")) == F.col("entity"))
    sectioned = (
        listed.where((F.col("kind") == "md") & (F.length("name") - F.length(F.replace("name", F.lit("."), F.lit(""))) >= 2))
        .select("scope", "entity")
        .distinct()
    )
    return listed.where(~single).unionByName(listed.where(single).join(sectioned, ["scope", "entity"], "left_anti"))


def entity_files(files: DataFrame) -> DataFrame:
    """Files of every entity, one row each: (scope, entity, kind, name, path)."""
    return prefer_subsections(listed_files(files))


def manifest_rows(files: DataFrame) -> DataFrame:
    """Manifest rows (scope, entity, md_files, jsonl_files), names in order ignoring case; one row per entity."""

    def paths(kind: str):
        named = F.struct(F.lower("name").alias("low"), "name", "path")
        rows = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, named)))
        return F.transform(rows, lambda r: r["path"])

    return entity_files(files).groupBy("scope", "entity").agg(paths("md").alias("md_files"), paths("jsonl").alias("jsonl_files"))


def with_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", entity_key(F.col("entity")))


def suppress_duplicates(campaign: DataFrame, general: DataFrame) -> DataFrame:
    """Campaign rows whose entity is not a general one too."""
    keys = with_key(general).select("key").distinct()
    return with_key(campaign).join(keys, "key", "left_anti").select(campaign.columns)


def skipped_count(campaign: DataFrame, general: DataFrame) -> DataFrame:
    keys = with_key(general).select("key").distinct()
    return with_key(campaign).join(keys, "key", "left_semi").agg(F.count("*").alias("skipped"))


def manifest_union(campaign: DataFrame, general: DataFrame) -> DataFrame:
    return suppress_duplicates(campaign, general).unionByName(general)
