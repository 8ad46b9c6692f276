"""Readers for text files, JSON lines, catalogs and file listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import base_name, lines, not_blank, or_blank, slug, stem, strip

# Accepted scope names and the folders each of them covers.
SCOPE_FOLDERS = {
    "campaign": ("campaign",),
    "sr3": ("lore", "topics", "rules_references"),
    "sr3_rules": ("lore", "topics", "rules_references"),
    "rules": ("lore", "topics", "rules_references"),
    "lore": ("lore", "topics", "rules_references"),
    "all": ("campaign", "lore", "topics", "rules_references"),
}
ALWAYS_IN_SCOPE = ("90_derived",)

# Folders that hold work items.
WORK_FOLDERS = ("core_rules", "sourcebooks", "adventures", "player_aids")


def decode_files(files: DataFrame) -> DataFrame:
    """Files with binary ``content`` as text; bytes that are no UTF-8 become U+FFFD."""
    return files.select(
        "path",
        base_name(F.col("path")).alias("name"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
    )


def scan_text(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """One row per file: path, name, text."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return decode_files(reader.load(path))


def match_glob(files: DataFrame, suffix: str, folder: str | None = None, recursive: bool = False) -> DataFrame:
    """Rows of a file table below ``folder`` whose name ends with ``suffix``."""
    found = files.where(F.col("path").endswith(suffix))
    if folder is not None:
        prefix = folder.rstrip("/") + "/"
        found = found.where(F.startswith(F.col("path"), F.lit(prefix)))
        if not recursive:
            found = found.where(F.instr(F.substring(F.col("path"), len(prefix) + 1, 1 << 30), "/") == 0)
    return found


def parse_jsonl(
    raw: DataFrame,
    fields: Mapping[str, str],
    line: str = "line",
    keep: Sequence[str] = (),
    objects_only: bool = False,
) -> DataFrame:
    """Typed columns of JSON lines; blank and malformed lines are skipped.

    A field of another type reads as null. ``objects_only`` also drops valid JSON that is no object.
    """
    rows = raw.where(strip(F.col(line)) != "").select(*keep, F.try_parse_json(F.col(line)).alias("_v"))
    rows = rows.where(F.col("_v").isNotNull())
    if objects_only:
        rows = rows.where(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")))
    return rows.select(*keep, *[F.try_variant_get("_v", f"$.{n}", t).alias(n) for n, t in fields.items()])


def parse_jsonl_strict(raw: DataFrame, schema: str, line: str = "line", keep: Sequence[str] = ()) -> DataFrame:
    """Typed columns of JSON lines; a malformed line fails the job, blank lines are skipped."""
    rows = raw.where(strip(F.col(line)) != "")
    parsed = F.from_json(F.col(line), schema, {"mode": "FAILFAST"})
    return rows.select(*keep, parsed.alias("_r")).select(*keep, "_r.*")


def scan_jsonl(spark: SparkSession, path: str, fields: Mapping[str, str], objects_only: bool = False) -> DataFrame:
    raw = spark.read.text(path).withColumnRenamed("value", "line")
    return parse_jsonl(raw, fields, objects_only=objects_only)


def scan_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def load_catalog(files: DataFrame, default_type: str = "Unclassified", keep: Sequence[str] = ()) -> DataFrame:
    """Catalog rows of JSON texts that hold a list of entities or ``{"entities": [...]}``."""
    doc = F.try_parse_json(F.col("text"))
    entries = F.coalesce(
        F.try_variant_get(doc, "$.entities", "array<variant>"), F.try_variant_get(doc, "$", "array<variant>")
    )
    rows = files.select(*keep, F.posexplode_outer(entries).alias("pos", "entry"))
    entry = F.col("entry")
    synonyms = F.transform(
        F.filter(
            F.try_variant_get(entry, "$.synonyms", "array<variant>"),
            lambda s: F.schema_of_variant(s) == "STRING",
        ),
        lambda s: strip(F.variant_get(s, "$", "string")),
    )
    return rows.select(
        *keep,
        F.col("pos").cast("long").alias("pos"),
        strip(or_blank(F.try_variant_get(entry, "$.canonical", "string"))).alias("canonical"),
        strip(not_blank(F.try_variant_get(entry, "$.type", "string"), default_type)).alias("type"),
        F.coalesce(F.filter(synonyms, lambda s: s != ""), F.array().cast("array<string>")).alias("synonyms"),
    ).where(F.col("canonical") != "")


def scan_scope(
    docs: DataFrame,
    scope: str = "all",
    folders: Mapping[str, Sequence[str]] = SCOPE_FOLDERS,
    always: Sequence[str] = ALWAYS_IN_SCOPE,
    column: str = "scope",
    key: str | None = "path",
) -> DataFrame:
    """Documents of a scope. On a table partitioned by the scope column only its folders are read."""
    wanted = [*folders.get((scope or "all").lower(), ()), *always]
    found = docs.where(F.col(column).isin(wanted))
    return found if key is None else found.dropDuplicates([key])


def scan_scopes(docs: DataFrame, scopes: DataFrame, scope: str = "all", column: str = "scope", key: str | None = "path") -> DataFrame:
    """Documents in the folders that a table (scope, folder) gives for a scope.

    On a table partitioned by ``column`` Spark reads the folder names first and then only these folders.
    """
    wanted = scopes.where(F.lower("scope") == (scope or "all").lower()).select(F.col("folder").alias("_folder"))
    found = docs.join(wanted, F.col(column) == F.col("_folder"), "left_semi")
    return found if key is None else found.dropDuplicates([key])


def scope_table(spark: SparkSession, folders: Mapping[str, Sequence[str]] = SCOPE_FOLDERS, always: Sequence[str] = ALWAYS_IN_SCOPE) -> DataFrame:
    """(scope, folder) of the accepted scope names."""
    rows = [(scope, f) for scope, own in folders.items() for f in (*own, *always)]
    return spark.createDataFrame(rows, "scope string, folder string")


def list_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path below root, length, modified) of all files below a folder of any file system; none is opened.

    The file reader lists folders in parallel; as the content is not selected, it reads nothing else.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    below = F.substring_index("path", root.rstrip("/").removeprefix("file:") + "/", -1)
    return reader.load(root).select(below.alias("path"), "length", F.col("modificationTime").alias("modified"))


def list_work_items(
    files: DataFrame, folders: Sequence[str] = WORK_FOLDERS, suffix: str = ".pdf"
) -> DataFrame:
    """Visible files with the suffix that lie directly in one of the folders."""
    parent = F.substring_index(F.substring_index(F.col("path"), "/", -2), "/", 1)
    name = base_name(F.col("path"))
    return (
        files.select("path", parent.alias("folder"), name.alias("name"), "length")
        .where(F.col("folder").isin(list(folders)))
        .where(F.col("name").endswith(suffix) & ~F.startswith(F.col("name"), F.lit(".")))
    )


def source_inventory(files: DataFrame, rules: Mapping[str, tuple[str, str]], default: tuple[str, str]) -> DataFrame:
    """Group and subgroup of each distinct file by its first path part."""
    part = F.substring_index(F.col("path"), "/", 1)
    group = F.lit(default[0])
    subgroup = F.lit(default[1])
    for first, (g, s) in rules.items():
        group = F.when(part == first, g).otherwise(group)
        subgroup = F.when(part == first, s).otherwise(subgroup)
    return (
        files.select("path")
        .distinct()
        .select(group.alias("group_name"), subgroup.alias("subgroup"), "path")
        .orderBy(F.lower("path"), "path")
    )


def doc_stub_scan(stubs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Imported documents: stubs (path, json) that carry a document id, joined to their fetched bodies."""
    name = stem(base_name(F.col("path")))
    with_id = (
        stubs.select(
            "path",
            F.substring_index(F.substring_index(F.col("path"), "/", -2), "/", 1).alias("folder"),
            name.alias("title"),
            F.try_variant_get(F.try_parse_json("json"), "$.doc_id", "string").alias("doc_id"),
        )
        .where(F.col("doc_id") != "")
    )
    body = strip(F.col("body"))
    return (
        with_id.join(bodies.where(body != ""), "doc_id")
        .select(
            "folder",
            slug(F.col("title"), split_separators=False).alias("slug"),
            "doc_id",
            F.concat(
                F.lit("# Imported: "), "title",
                F.lit("\n\n- Source gdoc: `"), "path",
                F.lit("`\n- Doc ID: `"), "doc_id", F.lit("`\n\n"),
                body, F.lit("\n"),
            ).alias("body"),
        )
    )


def doc_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Numbered lines of documents; a narrow generate, no shuffle."""
    return (
        docs.select(key, *keep, F.posexplode_outer(lines(F.col(text))).alias("_i", "line"))
        .where(F.col("_i").isNotNull())
        .select(key, *keep, (F.col("_i") + 1).cast("long").alias("line_no"), F.col("line").alias("text"))
    )


