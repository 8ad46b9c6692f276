"""Catalog aliases and their mentions in lines of text.

Aliases are looked for in the row of their text (``spans.line_terms``), so the work grows with the text and not with text
times aliases, and neither texts nor places are shuffled. Lines with terms are written once; the names of their terms are
looked up whenever they are read (``with_names_of``), in a table of those names alone that have a term in some line.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import collapse, left, let, lines, name_key, not_blank, or_blank, slug, strip, stripped_lines
from quillstone.operators.spans import Names, line_terms, shaped, spans
from quillstone.sources.storage import discard, stored

#: what stands at both ends of a term, as patterns
BOUNDARIES = {"word": (r"(?<!\w)", r"(?!\w)"), "edge": (r"\b", r"\b")}


def expand_aliases(catalog: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(pos, canonical, alias, idx): name, synonyms, first two words of longer names, extra aliases."""
    words = F.filter(F.split(strip(F.col("canonical")), r"(?U)\s+"), lambda w: w != "")
    short = F.when(F.size(words) >= 2, F.array(F.array_join(F.slice(words, 1, 2), " "))).otherwise(
        F.array().cast("array<string>")
    )
    every = F.concat(F.array("canonical"), F.coalesce("synonyms", F.array().cast("array<string>")), short)
    aliases = catalog.select("pos", "canonical", F.posexplode(every).alias("idx", "alias"))
    if extra is not None:
        more = catalog.join(extra, "canonical").select("pos", "canonical", F.lit(1 << 20).alias("idx"), "alias")
        aliases = aliases.unionByName(more)
    return aliases.select(
        "pos", "canonical", strip(F.col("alias")).alias("alias"), F.col("idx").cast("long").alias("idx")
    ).where(F.col("alias") != "")


def dedupe_aliases(aliases: DataFrame) -> DataFrame:
    """One canonical per lower-cased alias: the first one in catalog order."""
    rank = F.struct((-F.length("alias")).alias("l"), "pos", "idx")
    return (
        aliases.groupBy(F.lower("alias").alias("alias_key"))
        .agg(F.min_by(F.struct("pos", "canonical", "alias"), rank).alias("a"))
        .select("alias_key", "a.pos", "a.canonical", "a.alias")
    )


def match_terms(
    rows: DataFrame, terms: DataFrame, text: str, keep: Sequence[str], out: Sequence[str], mode: str = "word"
) -> DataFrame:
    """(keep..., out...) for each place where ``text`` holds a term, ignoring case.

    ``terms`` has ``term`` (lower case) and the ``out`` columns. ``mode`` is ``word`` (no word character
    next to the term) or ``edge`` (a word boundary at both ends); they differ for terms with symbols at
    their ends only. Rows repeat when a term stands at several places or several terms match.
    """
    found = spans(rows, F.lower(F.col(text)), keep, shaped(terms.select("term", *out)))
    before, after = F.col("_before"), F.col("_after")
    if mode == "edge":
        whole = (~F.col("_open") | before) & (~F.col("_shut") | after)
    else:
        whole = ~(F.col("_open") & before) & ~(F.col("_shut") & after)
    return found.where(whole).select(*keep, *out)


def with_row_hash(docs: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys..., _text, _doc): texts with a hash of their row, by which hits find them again."""
    return docs.select(*keys, F.col(text).alias("_text"), F.xxhash64(*keys, text).alias("_doc"))


def line_hits(
    docs: DataFrame, keys: Sequence[str], text: str, terms: DataFrame, mode: str = "word", min_len: int = 0, carry: Sequence[str] = ()
) -> DataFrame:
    """(carry..., _doc, _i, canonical): the stripped lines, counted from 0, of at least ``min_len`` characters that hold a term.

    A line that holds several terms of a name is there several times. ``_doc`` is the hash of the text's row; ``carry`` are those keys that are needed before the text is met again.
    """
    named = with_row_hash(docs, keys, text)
    rows = named.select(*carry, "_doc", F.posexplode_outer(F.transform(lines(F.col("_text")), strip)).alias("_i", "_line"))
    return match_terms(rows.where(F.length("_line") >= min_len), terms, "_line", [*carry, "_doc", "_i"], ["canonical"], mode)


def listed(name: str) -> Column:
    """Aggregate: the distinct values of a column, null among them."""
    return F.transform(F.collect_set(F.struct(F.col(name).alias("v"))), lambda s: s["v"])


def show_lines(
    docs: DataFrame,
    keys: Sequence[str],
    text: str,
    hits: DataFrame,
    show: Callable[[Column, Column], Column],
    add: Sequence[str] = (),
    cut: Callable[[Column], Column] = stripped_lines,
) -> DataFrame:
    """(add..., _doc, _i, names, shown): each line with hits once, with what is found there and what ``show`` gives of it.

    ``names`` holds the distinct values of the hits' column ``name``; ``show`` takes the lines that ``cut`` makes of the
    text and a place in them. A text is joined once with all places wanted of it, and no line is shuffled after that.
    """
    placed = hits.repartition("_doc").groupBy("_doc", "_i").agg(listed("name").alias("names"))
    wanted = placed.groupBy("_doc").agg(F.collect_list(F.struct("_i", "names")).alias("_places"))
    texts = with_row_hash(docs, keys, text).join(wanted, "_doc").dropDuplicates(["_doc"])
    places = let(
        cut(F.col("_text")),
        lambda ls: F.transform(F.col("_places"), lambda p: F.struct(p["_i"].alias("_i"), p["names"].alias("names"), show(ls, p["_i"]).alias("shown"))),
    )
    return texts.select(*add, "_doc", F.explode_outer(places).alias("_s")).select(*add, "_doc", "_s.*")


def flat_lines(text: Column) -> Column:
    """Stripped lines (line, n characters, flat), each put on one line once, however many neighbours show it."""
    return F.transform(
        lines(text), lambda x: let(strip(x), lambda line: F.struct(line.alias("line"), F.length(line).alias("n"), collapse(line).alias("flat")))
    )


def with_context(ls: Column, i: Column, min_len: int = 15, width: int = 420) -> Column:
    """Line ``i`` (0-based) of ``flat_lines`` with its longer neighbours, on one line.

    Stripped lines end in no white space, so collapsed lines joined by a blank are the collapsed joined lines.
    """
    last = F.size(ls) - 1

    def neighbour(at: Column, inside: Column) -> Column:
        line = ls[F.greatest(F.least(at, last), F.lit(0))]
        return F.when(inside & (line["n"] >= min_len), F.nullif(line["flat"], F.lit("")))

    parts = F.concat_ws(" ", neighbour(i - 1, i > 0), F.nullif(ls[i]["flat"], F.lit("")), neighbour(i + 1, i < last))
    return left(parts, width)


def lines_with_context(
    docs: DataFrame, keep: Sequence[str], text: str = "text", min_len: int = 0, width: int = 420
) -> DataFrame:
    """(keep..., line_no, line, context): stripped lines of at least ``min_len`` characters."""
    rows = let(
        flat_lines(F.col(text)),
        lambda ls: F.filter(
            F.transform(
                ls,
                lambda line, i: F.when(
                    line["n"] >= min_len,
                    F.struct(
                        (i + 1).cast("long").alias("line_no"),
                        line["line"].alias("line"),
                        with_context(ls, i, width=width).alias("context"),
                    ),
                ),
            ),
            lambda r: r.isNotNull(),
        ),
    )
    return (
        docs.select(*keep, F.explode_outer(rows).alias("r"))
        .where(F.col("r").isNotNull())
        .select(*keep, "r.line_no", "r.line", "r.context")
    )


def as_terms(aliases: DataFrame) -> DataFrame:
    return aliases.select(F.col("alias_key").alias("term"), "canonical")


MENTION = ("src_rank", "session", "source", "line_no", "text")


def by_name(found: DataFrame) -> DataFrame:
    """One row for each of the ``names`` of each line, as ``canonical``."""
    return found.select(*MENTION, F.explode("names").alias("canonical"))


def term_lines(
    docs: DataFrame,
    keys: Sequence[str],
    text: str,
    terms: DataFrame,
    show: Callable[[Column, Column], Column],
    mode: str = "word",
    min_len: int = 0,
    cut: Callable[[Column], Column] = stripped_lines,
) -> DataFrame:
    """(keys..., _doc, _i, shown, terms): each stripped line of at least ``min_len`` characters where likely terms stand.

    ``show`` takes the lines that ``cut`` makes of the text and a place in them. All of it is made in the text's row.
    """
    low = F.transform(lines(F.col("_text")), lambda x: let(strip(x), lambda line: F.when(F.length(line) >= min_len, F.lower(line)).otherwise("")))
    found = with_row_hash(docs, keys, text).withColumn("_found", line_terms(low, terms, mode))
    placed = F.filter(F.transform("_found", lambda t, i: F.struct(i.alias("_i"), t.alias("terms"))), lambda p: F.size(p["terms"]) > 0)
    rows = let(
        cut(F.col("_text")),
        lambda ls: F.transform(placed, lambda p: F.struct(p["_i"].alias("_i"), show(ls, p["_i"]).alias("shown"), p["terms"].alias("terms"))),
    )
    return found.select(*keys, "_doc", F.explode_outer(rows).alias("_s")).where(F.col("_s").isNotNull()).select(*keys, "_doc", "_s.*")


def held_once(rows: DataFrame, key: str, label: str) -> DataFrame:
    """The rows, written, each ``key`` once, with the ``terms`` of all its rows; only rows whose key repeats are shuffled."""
    held = stored(rows, label)
    twice = stored(held.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), label + "-again")
    if twice.isEmpty():
        return held
    others = [F.first(c).alias(c) for c in rows.columns if c not in (key, "terms")]
    every = F.array_distinct(F.flatten(F.collect_set("terms"))).alias("terms")
    again = held.join(twice, key, "left_semi").groupBy(key).agg(*others, every)
    out = stored(held.join(twice, key, "left_anti").unionByName(again), label)
    discard(held, twice)
    return out


BLOCK = 48 << 20  #: bytes of the names that are collected and sent out at once
CHAIN = 4  #: blocks that a task holds


def name_blocks(found: DataFrame, names: DataFrame) -> list[Names]:
    """``names`` (term, canonical) in blocks; if they are many, only those that have a term in ``found``.

    A name with all its terms is in one block.
    """
    sized = F.sum(F.octet_length("term") + F.coalesce(F.octet_length("canonical"), F.lit(0)) + 24)
    live = names
    if (names.agg(sized).first()[0] or 0) > BLOCK:
        seen = found.select(F.explode_outer("terms").alias("term")).select(F.xxhash64("term").alias("_h")).distinct()
        live = stored(names.withColumn("_h", F.xxhash64("term")).join(seen, "_h", "left_semi").drop("_h"), "mention-names")
    blocks = -(-(live.agg(sized).first()[0] or 1) // BLOCK)
    own = F.pmod(F.xxhash64("canonical"), F.lit(blocks))
    return [Names(live.where(own == i)) for i in range(blocks)]


def with_names_of(found: DataFrame, names: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(cols..., names): the rows of ``found`` with the different names of their ``terms``, in the row.

    ``names`` (term, canonical) are sent out in blocks. Where a task cannot hold all blocks, rows are read again for the
    others and repeat with other names.
    """
    tables, parts = name_blocks(found, names), []
    for i in range(0, len(tables), CHAIN):
        own = [t.of(F.col("terms")) for t in tables[i : i + CHAIN]]
        parts.append(found.select(*cols, (F.concat(*own) if len(own) > 1 else own[0]).alias("names")).where(F.size("names") > 0))
    return functools.reduce(DataFrame.unionByName, parts)


def named_lines(found: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """Lines (MENTION..., terms), written once, with their names; ``kept`` are the written lines, which hold the same texts."""
    kept = held_once(found, key, "mention-lines")
    out = with_names_of(kept, names, MENTION)
    out.kept = kept.select(*MENTION)
    return out


def kept_lines(mentions: DataFrame) -> DataFrame | None:
    """The written lines behind a table of mentions, if it has some."""
    return vars(mentions).get("kept")


def terms_table(aliases: DataFrame) -> DataFrame:
    """(term, canonical) of the aliases, written if they are not yet."""
    return as_terms(aliases) if "stored_at" in vars(aliases) else stored(as_terms(aliases), "aliases")


def mention_lines(
    notes: DataFrame, aliases: DataFrame, src_rank: int = 0, min_len: int = 12, mode: str = "word", width: int = 420
) -> DataFrame:
    """(src_rank, session, source, line_no, text, names): each line of notes (session, source, text) with the entities it names.

    ``text`` is the line's context of ``width`` characters. A line names many entities, so its text is kept once.
    """
    keys, terms = ["session", "source"], terms_table(aliases)
    found = term_lines(notes, keys, "text", terms, lambda ls, i: with_context(ls, i, width=width), mode, min_len, flat_lines)
    rows = found.select(
        F.lit(src_rank).alias("src_rank"),
        *keys,
        (F.col("_i") + 1).cast("long").alias("line_no"),
        F.col("shown").alias("text"),
        F.xxhash64("_doc", "_i").alias("_row"),
        "terms",
    )
    return named_lines(rows, "_row", terms)


def match_mentions(
    notes: DataFrame, aliases: DataFrame, src_rank: int = 0, min_len: int = 12, mode: str = "word", width: int = 420
) -> DataFrame:
    """Mentions in notes: one row per line and entity; see ``mention_lines``."""
    return by_name(mention_lines(notes, aliases, src_rank, min_len, mode, width))


def input_lines(
    inputs: DataFrame, aliases: DataFrame, catalog: DataFrame, source: str, src_rank: int = 2, min_len: int = 8
) -> DataFrame:
    """Submissions (line_no, entity, player, date, note) with the entities they mention, as ``mention_lines``.

    A submission mentions what its note names, and the entity it was filed for.
    """
    note = strip(or_blank(F.col("note")))
    rows = inputs.select(
        "line_no",
        note.alias("note"),
        F.lower(strip(or_blank(F.col("entity")))).alias("hint"),
        strip(not_blank(F.col("player"), "Unknown Player")).alias("player"),
        strip(not_blank(F.col("date"), "undated")).alias("date"),
    ).where(F.length("note") >= min_len)
    rows = rows.select(
        "line_no",
        "note",
        "hint",
        F.concat(F.lit("Player Input ("), "date", F.lit(")")).alias("session"),
        left(F.concat(F.lit("["), "player", F.lit("] "), "note"), 320).alias("text"),
    )
    terms = terms_table(aliases)
    filed = catalog.select(filed_as(F.lower("canonical")).alias("term"), "canonical").distinct()
    found = rows.withColumn("_found", line_terms(F.array(F.lower("note")), terms))
    held = found.select(
        F.lit(src_rank).alias("src_rank"),
        "session",
        F.lit(source).alias("source"),
        "line_no",
        "text",
        F.xxhash64("line_no", "session", "text").alias("_row"),
        F.concat(F.get("_found", F.lit(0)), F.array(filed_as(F.col("hint")))).alias("terms"),
    )
    return named_lines(held, "_row", terms.unionByName(filed))


def filed_as(name: Column) -> Column:
    """The name of an entity as a term that no text holds."""
    return F.concat(F.lit("\0"), name)


def match_player_inputs(
    inputs: DataFrame, aliases: DataFrame, catalog: DataFrame, source: str, src_rank: int = 2, min_len: int = 8
) -> DataFrame:
    """Mentions in submissions: one row per submission and entity; see ``input_lines``."""
    return by_name(input_lines(inputs, aliases, catalog, source, src_rank, min_len))


def all_mentions(*tables: DataFrame) -> DataFrame:
    """Mention tables, or tables of lines, as one; reading order is (src_rank, source, line_no)."""
    out = functools.reduce(DataFrame.unionByName, tables)
    kept = [kept_lines(t) for t in tables]
    if all(k is not None for k in kept):
        out.kept = functools.reduce(DataFrame.unionByName, kept)
    return out


def citation() -> Column:
    return F.concat(F.col("source"), F.lit("#L"), F.col("line_no").cast("string"))


def reading_order() -> Column:
    return F.struct("src_rank", "source", "line_no")


def matches_target(canonical: Column, target: str | None) -> Column:
    if not target:
        return F.lit(True)
    t = F.lower(strip(F.lit(target)))
    c = F.lower(strip(canonical))
    return (t == c) | F.contains(c, t) | (slug(canonical) == slug(F.lit(target)))


def target_filter(catalog: DataFrame, target: str | None) -> DataFrame:
    return catalog.where(matches_target(F.col("canonical"), target))


def resolve_canonical(requests: DataFrame, catalog: DataFrame, entity: str = "entity") -> DataFrame:
    """Requests with the catalog row whose name or synonym they give; null when there is none.

    Names compare without case and extra blanks; of several rows the first in the catalog wins.
    """
    names = F.concat(F.array("canonical"), F.coalesce("synonyms", F.array().cast("array<string>")))
    keys = (
        catalog.select("pos", "canonical", "type", "synonyms", F.explode(names).alias("n"))
        .groupBy(name_key(F.col("n")).alias("_key"))
        .agg(F.min_by(F.struct("canonical", "type", "synonyms"), "pos").alias("m"))
        .select("_key", "m.canonical", "m.type", "m.synonyms")
    )
    return requests.withColumn("_key", name_key(F.col(entity))).join(keys, "_key", "left").drop("_key")


def new_names(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """(_key, canonical, first_id): names among the requests that the catalog lacks, in their first spelling."""
    unresolved = resolve_canonical(requests, catalog).where(F.col("canonical").isNull())
    return unresolved.groupBy(name_key(F.col("entity")).alias("_key")).agg(
        strip(F.min_by("entity", "request_id")).alias("canonical"), F.min("request_id").alias("first_id")
    )


def with_names(catalog: DataFrame, new: DataFrame, default_type: str = "Unknown") -> DataFrame:
    """Catalog plus the new names; their positions follow all others in order of first use."""
    last = catalog.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("p")).scalar()
    return catalog.select("pos", "canonical", "type", "synonyms").unionByName(
        new.select(
            (last + 1 + F.col("first_id")).alias("pos"),
            "canonical",
            F.lit(default_type).alias("type"),
            F.array().cast("array<string>").alias("synonyms"),
        )
    )


def extend_catalog(requests: DataFrame, catalog: DataFrame, default_type: str = "Unknown") -> DataFrame:
    """Catalog plus one row for each new name among the requests, in order of first use.

    ``requests`` carries ``request_id``; the first spelling of a new name is kept.
    """
    return with_names(catalog, new_names(requests, catalog), default_type)


def settle_names(requests: DataFrame, catalog: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """Requests with the ``canonical`` name they get in the catalog extended by their own new names.

    ``is_new`` marks the first request for a new name, the one that adds it. ``new`` are their ``new_names`` if known.
    """
    new = new_names(requests, catalog) if new is None else new
    fresh = new.select("_key", F.col("canonical").alias("_fresh"), "first_id")
    known = resolve_canonical(requests, catalog).withColumn("_key", name_key(F.col("entity"))).join(fresh, "_key", "left")
    return known.select(
        *requests.columns,
        F.coalesce("canonical", "_fresh").alias("canonical"),
        F.coalesce(F.col("request_id") == F.col("first_id"), F.lit(False)).alias("is_new"),
    )
