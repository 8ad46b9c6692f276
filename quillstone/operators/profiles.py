"""Entity profiles from mentions: coverage, facets, timeline, conflicts, citations, documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.functions.text import let, or_blank, slug, strip
from quillstone.operators.mentions import MENTION, citation, kept_lines, reading_order
from quillstone.operators.ranking import first_per_group, joined_in_order
from quillstone.operators.spans import Bits
from quillstone.sources.storage import stored

# Word lists and labels of an entity profile.
DEATH_HINTS = r"(?iU)\b(died|dead|killed|slain|passed away|deceased|death)\b"
ALIVE_HINTS = r"(?iU)\b(alive|survived|returns?|back again|still active|still around)\b"
FACETS = (
    ("physical", ("looks", "appearance", "tall", "short", "hair", "eyes", "face", "tattoo", "scar")),
    ("capabilities", ("can ", "able to", "skill", "hacking", "deck", "combat", "spell", "drone", "pilot")),
    ("quirks", ("weird", "odd", "meme", "quirk", "obsess", "habit", "insane", "eccentric")),
    ("equipment", ("deck", "gun", "shotgun", "sword", "armor", "vehicle", "drone", "transceiver", "gear")),
)
FACET_LABELS = {
    "physical": "Physical description",
    "capabilities": "Capabilities",
    "quirks": "Quirks",
    "equipment": "Equipment",
}
TAG_RULES = (
    ("matrix-active", ("matrix", "host", "deck", "security", "network")),
    ("field-tech", ("drone", "vehicle", "rig", "vcr")),
    ("social-connector", ("contact", "deal", "negotiat", "introduce", "ask")),
    ("combat-capable", ("attack", "fight", "shot", "combat", "gun", "sword")),
)
NOTABLE_WORDS = (
    "attack", "run", "mission", "contact", "plan", "host", "matrix", "drone", "fed", "mayor", "deal", "conflict",
)
GROUPS = ("PCs", "NPCs", "Unclassified")

# Opinion rules: type -> (tag, sentence) in order, the entry without a tag is the default.
OPINIONS: Mapping[str, Sequence[tuple[str | None, str]]] = {
    "PC": (
        ("matrix-active", "{name} decides fast where networks matter."),
        ("combat-capable", "{name} is strongest with a concrete plan."),
        (None, "{name} is dependable under pressure."),
    ),
    "NPC": (
        ("social-connector", "{name} is a contact worth keeping."),
        ("matrix-active", "{name} is part of the infrastructure."),
        (None, "{name} has influence; approach with care."),
    ),
    "": ((None, "{name} is not well known yet."),),
}
# The sentences of a profile, its section titles and what stands in a section without rows.
SENTENCES = {
    "described": "{name} is a {label} campaign figure first cited in {session}.",
    "unknown": "{name} has no cited campaign references yet.",
    "summary": "Across {n} cited mentions, {name} appears as a consistent participant in key run-time decisions and scene-level developments.",
    "no_summary": "{name} currently has insufficient campaign data for a reliable profile.",
}
SECTIONS = (
    ("## Timeline (abbreviated)", "_No timeline events yet._"),
    ("## Notable events", "_No notable events identified yet._"),
    ("## Passing / death record", "_No confirmed passing/death reference found in current notes._"),
    ("## Continuity notes", "_No major continuity conflicts detected in current notes._"),
)
NO_FACET = "_Not clearly established in current notes._"
NO_REFERENCES = "_No references recorded._"
NO_OPINION = "Still a mystery; more notes are needed."
FEW_DATA = "Insufficient data for a meaningful opinion."


def group_name(entity_type: Column) -> Column:
    t = F.upper(strip(or_blank(entity_type)))
    return F.when(t == "PC", "PCs").when(t == "NPC", "NPCs").otherwise("Unclassified")


def has_any(low: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def by_line(mentions: DataFrame) -> DataFrame:
    """Mentions as lines with ``names``; a table with one row per mention is one of lines that name one entity each."""
    if "names" in mentions.columns:
        return mentions
    return mentions.select(*MENTION, F.array("canonical").alias("names"))


def held(mentions: DataFrame) -> DataFrame:
    """The lines of the mentions with their key ``_line``, written once; a table that is written already stays.

    ``kept`` of it are lines to take texts from, without names.
    """
    if "_line" in mentions.columns:
        return mentions
    kept, key = kept_lines(mentions), F.xxhash64(*MENTION)
    if kept is None:
        out = stored(by_line(mentions).withColumn("_line", key), "mention-lines")
        out.kept = out
    else:
        out = mentions.withColumn("_line", key)
        out.kept = kept.withColumn("_line", key)
    return out


def places(lines: DataFrame, *cols: Column | str) -> DataFrame:
    """(canonical, cols...) for each mention; what the columns make of a line is made before it is repeated for its names."""
    made = lines.select("names", *cols)
    return made.select(F.explode("names").alias("canonical"), *[c for c in made.columns if c != "names"])


def shown(picked: DataFrame, lines: DataFrame, *cols: str) -> DataFrame:
    """The picked mentions with ``cols`` of their lines. A table of bits tells which lines are not wanted before they are shuffled."""
    wanted = picked.select(F.col("_line").alias("h")).distinct()
    some = kept_lines(lines).where(Bits(wanted, wanted.count()).holds(F.col("_line")))
    texts = some.select("_line", *cols).dropDuplicates(["_line"])
    return picked.join(texts, "_line")


def citation_counts(catalog: DataFrame, mentions: DataFrame) -> DataFrame:
    counts = places(by_line(mentions)).groupBy("canonical").agg(F.count("*").alias("citations"))
    return catalog.join(counts, "canonical", "left").withColumn(
        "citations", F.coalesce("citations", F.lit(0)).cast("long")
    )


def coverage_index(catalog: DataFrame, mentions: DataFrame) -> DataFrame:
    """Citations of every entity by group, most cited first, ties in catalog order."""
    group = group_name(F.col("type"))
    rank = F.when(F.col("group_name") == "PCs", 0).when(F.col("group_name") == "NPCs", 1).otherwise(2)
    return (
        citation_counts(catalog, mentions)
        .select(group.alias("group_name"), "canonical", "citations", slug(F.col("canonical")).alias("slug"), "pos")
        .orderBy(rank, F.desc("citations"), "pos")
    )


def first_texts(lines: DataFrame, keys: Sequence[str], rows: DataFrame, n: int) -> DataFrame:
    """(keys..., rank, session, text, source): the first ``n`` distinct texts of each group, in reading order.

    ``rows`` are mentions with (keys..., the order, _line, _text), where ``_text`` names the text by two hashes. Texts that stand on
    one line only need no comparison, so each task keeps ``n`` of them a group before anything is shuffled; the others, which a
    table of bits knows, are told apart by group first. Texts are joined with the mentions that are left.
    """
    order = [F.col(c) for c in ORDER]
    several = stored(kept_lines(lines).groupBy(text_name().alias("_text")).agg(F.count("*").alias("_n")).where("_n > 1").select("_text.a"), "mention-texts")
    again = Bits(several.select(F.col("a").alias("h")), several.count()).holds(F.col("_text.a"))
    marked = rows.withColumn("_again", again)
    firsts = marked.where("_again").groupBy(*keys, "_text").agg(F.min(F.struct(*ORDER, "_line")).alias("f")).select(*keys, "f.*")
    kept = first_per_group(marked.where("not _again"), keys, order, n).select(*keys, *ORDER, "_line").unionByName(firsts)
    best = first_per_group(stored(kept, "mention-picks"), keys, order, n).select(*keys, "rank", "_line", citation().alias("source"))
    return shown(best, lines, "session", "text").select(*keys, "rank", "session", "text", "source")


ORDER = ("src_rank", "source", "line_no")


def text_name() -> Column:
    """Two 64-bit hashes of a text as one value."""
    return F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))


def entity_facets(mentions: DataFrame, facets=FACETS, n: int = 3) -> DataFrame:
    """Up to ``n`` distinct texts per entity and facet whose text contains one of the facet's words."""
    hit = let(
        F.lower("text"),
        lambda low: F.array_compact(F.array(*[F.when(has_any(low, words), F.lit(name)) for name, words in facets])),
    )
    lines = held(mentions)
    rows = places(lines, *ORDER, "_line", text_name().alias("_text"), hit.alias("_facets"))
    rows = rows.withColumn("facet", F.explode_outer("_facets")).where(F.col("facet").isNotNull()).drop("_facets")
    return first_texts(lines, ["canonical", "facet"], rows, n).select("canonical", "facet", "rank", "text", "source")


def continuity_conflicts(mentions: DataFrame, death: str = DEATH_HINTS, alive: str = ALIVE_HINTS) -> DataFrame:
    """Entities with a mention of each kind, citing the first of either."""

    def first_of(flag: str) -> Column:
        return F.min(F.when(F.col(flag), F.struct(*ORDER, citation().alias("c"))))

    flags = [F.coalesce(F.col("text").rlike(p), F.lit(False)).alias(f) for p, f in ((death, "_death"), (alive, "_alive"))]
    rows = places(by_line(mentions).select("names", *ORDER, *flags).where("_death OR _alive"), *ORDER, "_death", "_alive")
    found = rows.groupBy("canonical").agg(first_of("_death").alias("d"), first_of("_alive").alias("a"))
    return found.where(F.col("d").isNotNull() & F.col("a").isNotNull()).select(
        "canonical", F.col("d.c").alias("death_source"), F.col("a.c").alias("alive_source")
    )


def tag_columns(rules) -> tuple[Column, list[Column], Column]:
    """The tags a text gives, as an array of flags; aggregates of them; and the array of tags made from their results."""

    def holds(low: Column) -> Column:
        return F.array(*[has_any(low, words) for _, words in rules])

    flags = let(F.lower("text"), holds).alias("_flags")
    tests = [F.bool_or(F.get("_flags", F.lit(i))).alias(f"_tag{i}") for i in range(len(rules))]
    tags = F.array_compact(F.array(*[F.when(F.col(f"_tag{i}"), F.lit(name)) for i, (name, _) in enumerate(rules)]))
    return flags, tests, tags


def entity_tags(mentions: DataFrame, rules=TAG_RULES) -> DataFrame:
    """Tags of each entity, in rule order; a rule holds when any mention contains one of its words."""
    flags, tests, tags = tag_columns(rules)
    return places(by_line(mentions), flags).groupBy("canonical").agg(*tests).select("canonical", tags.alias("tags"))


def entity_summary(
    catalog: DataFrame, mentions: DataFrame, tag_rules=TAG_RULES, opinions=OPINIONS
) -> DataFrame:
    """Description, summary and opinion of every entity from its tags, type and number of mentions."""
    flags, tests, tags = tag_columns(tag_rules)
    known = (
        places(by_line(mentions), *ORDER, "session", flags)
        .groupBy("canonical")
        .agg(F.min_by("session", reading_order()).alias("first_session"), F.count("*").alias("n"), *tests)
        .select("canonical", "first_session", "n", tags.alias("tags"))
    )
    rows = catalog.select("canonical", "type").join(known, "canonical", "left")
    none = F.col("n").isNull()
    label = F.when(F.size("tags") > 0, F.array_join("tags", " and ")).otherwise("recurring")

    def sentence(text: str) -> Column:
        out = F.lit(text)
        for field, value in (("{label}", label), ("{session}", F.col("first_session")), ("{n}", F.col("n").cast("string")), ("{name}", F.col("canonical"))):
            if field in text:
                out = F.replace(out, F.lit(field), value)
        return out

    kind = F.upper(or_blank(F.col("type")))
    opinion = None
    for entity_type, choices in opinions.items():
        choice = None
        for tag, text in reversed(choices):
            held = sentence(text)
            choice = held if tag is None else F.when(F.array_contains("tags", tag), held).otherwise(choice)
        if entity_type:
            cond = kind == entity_type
            opinion = F.when(cond, choice) if opinion is None else opinion.when(cond, choice)
        else:
            other = choice
    opinion = opinion.otherwise(other)
    return rows.select(
        "canonical",
        F.when(none, sentence(SENTENCES["unknown"])).otherwise(sentence(SENTENCES["described"])).alias("description"),
        F.when(none, sentence(SENTENCES["no_summary"])).otherwise(sentence(SENTENCES["summary"])).alias("summary"),
        F.when(none, NO_OPINION).when(F.col("n") < 2, FEW_DATA).otherwise(opinion).alias("opinion"),
    )


def entity_timeline(mentions: DataFrame, n: int = 6) -> DataFrame:
    lines = held(mentions)
    first = first_per_group(places(lines, *ORDER, "_line"), ["canonical"], [F.col(c) for c in ORDER], n)
    best = stored(first, "mention-picks").select("canonical", "rank", "_line", citation().alias("cite"))
    return shown(best, lines, "session", "text").select("canonical", "rank", "session", "text", F.col("cite").alias("source"))


def notable_events(mentions: DataFrame, words: Sequence[str] = NOTABLE_WORDS, n: int = 5) -> DataFrame:
    lines = held(mentions)
    notable = lines.where(let(F.lower("text"), lambda low: has_any(low, words)))
    rows = places(notable, *ORDER, "_line", text_name().alias("_text"))
    return first_texts(lines, ["canonical"], rows, n).select("canonical", "rank", "session", "text", "source")


def passing_record(mentions: DataFrame, death: str = DEATH_HINTS) -> DataFrame:
    lines = held(mentions)
    rows = places(lines.where(F.col("text").rlike(death)), *ORDER, "_line")
    first = rows.groupBy("canonical").agg(F.min(F.struct(*ORDER, "_line")).alias("f")).select("canonical", "f.*")
    best = stored(first, "mention-picks").select("canonical", "_line", citation().alias("cite"))
    return shown(best, lines, "session", "text").select("canonical", "session", "text", F.col("cite").alias("source"))


def section_rows(
    mentions: DataFrame,
    facets=FACETS,
    notable_words=NOTABLE_WORDS,
    death: str = DEATH_HINTS,
    alive: str = ALIVE_HINTS,
) -> DataFrame:
    """Cited items of all profile sections: (canonical, section_rank, item_rank, session, text, source).

    An entity has at most a few dozen of these rows, however many mentions it has.
    """
    facet_rank = F.lit(0)
    for i, (name, _) in enumerate(facets):
        facet_rank = F.when(F.col("facet") == name, i).otherwise(facet_rank)
    none = F.lit(None).cast("string")
    mentions = held(mentions)
    conflicts = continuity_conflicts(mentions, death, alive)
    base = len(facets)
    parts = [
        entity_facets(mentions, facets).select("canonical", facet_rank.alias("section_rank"), "rank", none.alias("session"), "text", "source"),
        entity_timeline(mentions).select("canonical", F.lit(base).alias("section_rank"), "rank", "session", "text", "source"),
        notable_events(mentions, notable_words).select("canonical", F.lit(base + 1).alias("section_rank"), "rank", none.alias("session"), "text", "source"),
        passing_record(mentions, death).select("canonical", F.lit(base + 2).alias("section_rank"), F.lit(1).alias("rank"), none.alias("session"), "text", "source"),
        conflicts.select("canonical", F.lit(base + 3).alias("section_rank"), F.lit(1).alias("rank"), none.alias("session"), none.alias("text"), F.col("death_source").alias("source")),
        conflicts.select("canonical", F.lit(base + 3).alias("section_rank"), F.lit(2).alias("rank"), none.alias("session"), none.alias("text"), F.col("alive_source").alias("source")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("rank", "item_rank")


def reference_numbers(sections: DataFrame) -> DataFrame:
    """Sources of an entity numbered by first use; an entity has a few dozen section rows at most."""
    first = sections.groupBy("canonical", "source").agg(F.min(F.struct("section_rank", "item_rank")).alias("o"))
    number = F.row_number().over(W.partitionBy("canonical").orderBy("o"))
    return first.select("canonical", "source", number.cast("long").alias("ref_no"))


def entity_index(catalog: DataFrame, mentions: DataFrame) -> DataFrame:
    return citation_counts(catalog, mentions).select(
        "canonical", "type", "synonyms", F.col("citations").alias("citation_count")
    )


def entity_heading(entity_type: Column, canonical: Column) -> Column:
    t = F.upper(strip(or_blank(entity_type)))
    kind = F.when(t == "PC", "PC").when(t == "NPC", "NPC").otherwise("Entity")
    return F.concat(F.lit("# Campaign "), kind, F.lit(": "), canonical)


def entity_document(
    catalog: DataFrame,
    mentions: DataFrame,
    facets=FACETS,
    notable_words=NOTABLE_WORDS,
    death: str = DEATH_HINTS,
    alive: str = ALIVE_HINTS,
    tag_rules=TAG_RULES,
    opinions=OPINIONS,
) -> DataFrame:
    """Markdown profile of each entity: (canonical, slug, body).

    The mentions feed every section, so they are written once.
    """
    mentions = held(mentions)
    sections = section_rows(mentions, facets, notable_words, death, alive)
    refs = reference_numbers(sections)
    base = len(facets)
    numbered = sections.join(refs, ["canonical", "source"])
    cite = F.concat(F.lit("[["), F.col("ref_no").cast("string"), F.lit("]]"))
    item = (
        F.when(F.col("section_rank") == base, F.concat(F.lit("- **"), "session", F.lit("** — "), "text", F.lit(" "), cite))
        .when(F.col("section_rank") == base + 3, F.concat(F.lit("- conflicting survival language "), cite))
        .otherwise(F.concat(F.lit("- "), "text", F.lit(" "), cite))
    )
    titles = [f"### {FACET_LABELS.get(name, name)}" for name, _ in facets] + [title for title, _ in SECTIONS]
    empty = [NO_FACET] * base + [nothing for _, nothing in SECTIONS]
    items = (
        numbered.select("canonical", "section_rank", "item_rank", item.alias("item"))
        .groupBy("canonical")
        .pivot("section_rank", list(range(base + 4)))
        .agg(joined_in_order("item_rank", "item", "\n"))
    )
    references = refs.groupBy("canonical").agg(
        joined_in_order(
            "ref_no", F.concat(F.lit("- ["), F.col("ref_no").cast("string"), F.lit("] `"), "source", F.lit("`")), "\n"
        ).alias("references")
    )
    summary = entity_summary(catalog, mentions, tag_rules, opinions)
    rows = (
        citation_counts(catalog, mentions)
        .join(summary, "canonical")
        .join(items, "canonical", "left")
        .join(references, "canonical", "left")
    )
    synonyms = F.when(F.size("synonyms") > 0, F.array_join("synonyms", ", ")).otherwise("_None_")
    blocks = [
        entity_heading(F.col("type"), F.col("canonical")),
        F.concat(
            F.lit("- Entity type: **"), "type", F.lit("**\n- Synonyms: "), synonyms,
            F.lit("\n- Citation count: **"), F.col("citations").cast("string"), F.lit("**"),
        ),
        F.lit("## Description"), F.col("description"),
        F.lit("## Summary"), F.col("summary"),
        F.lit("## Opinion"), F.col("opinion"),
        F.lit("## Profile facets"),
    ]
    for i, title in enumerate(titles):
        shown = F.when(or_blank(F.col(str(i))) == "", empty[i]).otherwise(F.col(str(i)))
        blocks += [F.lit(title), shown]
    blocks += [F.lit("## References"), F.coalesce("references", F.lit(NO_REFERENCES))]
    return rows.select(
        "canonical", slug(F.col("canonical")).alias("slug"), F.concat_ws("\n\n", *blocks).alias("body")
    )
