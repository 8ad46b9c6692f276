"""Dated session chunks of notes, session summaries, first introductions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import (
    base_name, clip, display_name, let, lines, norm_date, not_blank, plain_text, strip, stripped_lines,
)
from quillstone.operators.ranking import joined_in_order, rank_in_group

# Beginnings of lines that say nothing about a session, and the default texts.
NOT_CONTENT = ("#", "##", "###", "- source chunks:", "- type:", "source:", "## consolidated notes", "chunk")
NO_SUMMARY = "Session notes available; summary pending refinement."


def chunk_array(text: Column, name: Column | None = None) -> Column:
    """Dated chunks of one note file as an array of (date, start_line, end_line, content).

    A ``#`` line with a date closes the chunk before it and opens one that starts behind it. Lines
    before the first dated heading form a chunk only when one of them has a date; it takes the first
    such date and starts there, but keeps the lines before it. With ``name``, a file without chunks
    becomes one chunk when its name has a date.
    """

    def of_rows(rows: Column) -> Column:
        heads = F.filter(rows, lambda r: r["head"])
        start = F.array(F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("date")))
        cuts = F.concat(start, F.transform(heads, lambda r: F.struct(r["n"].alias("n"), r["date"].alias("date"))))
        return let(
            cuts,
            lambda bounds: F.filter(
                F.transform(bounds, lambda b, k: segment(rows, bounds, b, k)),
                lambda c: c["date"].isNotNull() & (c["content"] != ""),
            ),
        )

    def segment(rows: Column, bounds: Column, b: Column, k: Column) -> Column:
        end = F.when(
            k + 1 < F.size(bounds), bounds[F.least(k + 1, F.size(bounds) - 1)]["n"] - 1
        ).otherwise(F.size(rows))
        body = F.slice(rows, b["n"] + 1, F.greatest(end - b["n"], F.lit(0)))
        content = strip(F.array_join(F.transform(body, lambda r: r["line"]), "\n"))
        dated = F.get(F.filter(body, lambda r: r["date"].isNotNull()), F.lit(0))
        return F.struct(
            F.when(k == 0, dated["date"]).otherwise(b["date"]).alias("date"),
            F.when(k == 0, dated["n"]).otherwise(b["n"] + 1).cast("long").alias("start_line"),
            end.cast("long").alias("end_line"),
            content.alias("content"),
        )

    def number(line: Column, i: Column) -> Column:
        return let(
            F.struct(strip(line).alias("s"), norm_date(line).alias("date")),
            lambda v: F.struct(
                (i + 1).alias("n"),
                line.alias("line"),
                v["date"].alias("date"),
                (F.startswith(v["s"], F.lit("#")) & v["date"].isNotNull()).alias("head"),
            ),
        )

    def with_fallback(rows: Column) -> Column:
        found = of_rows(rows)
        if name is None:
            return found
        whole = strip(text)
        day = norm_date(name)
        single = F.array(
            F.struct(
                day.alias("date"),
                F.lit(1).cast("long").alias("start_line"),
                F.size(rows).cast("long").alias("end_line"),
                whole.alias("content"),
            )
        )
        return let(
            found,
            lambda c: F.when((F.size(c) == 0) & day.isNotNull() & (whole != ""), single).otherwise(c),
        )

    return let(F.transform(lines(text), number), with_fallback)


def session_chunks(notes: DataFrame, name_fallback: bool = True) -> DataFrame:
    """(date, source, start_line, end_line, content) of notes (source, name, text); no shuffle."""
    chunks = chunk_array(F.col("text"), F.col("name") if name_fallback else None)
    return (
        notes.select("source", F.explode_outer(chunks).alias("c"))
        .where(F.col("c").isNotNull())
        .select("c.date", "source", "c.start_line", "c.end_line", "c.content")
    )


def filename_date_fallback(notes: DataFrame) -> DataFrame:
    """Only the chunks that come from a dated file name."""
    chunks = chunk_array(F.col("text"))
    day = norm_date(F.col("name"))
    return notes.where((F.size(chunks) == 0) & day.isNotNull() & (strip(F.col("text")) != "")).select(
        day.alias("date"),
        "source",
        F.lit(1).cast("long").alias("start_line"),
        F.size(lines(F.col("text"))).cast("long").alias("end_line"),
        strip(F.col("text")).alias("content"),
    )


def session_group(chunks: DataFrame) -> DataFrame:
    """Chunks of each date numbered by (source, start_line), also for dates with very many chunks."""
    return rank_in_group(chunks, ["date"], ["source", "start_line"], "chunk_no")


def session_index(chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """Chunks per date with the totals of sessions and of input files."""
    per_date = chunks.groupBy("date").agg(F.count("*").alias("chunks"))
    return per_date.select(
        "date",
        "chunks",
        per_date.agg(F.count("*").alias("n")).scalar().alias("sessions"),
        notes.agg(F.count("*").alias("n")).scalar().alias("input_files"),
    ).orderBy("date")


def first_event_per_entity(manifest: DataFrame, events: DataFrame, scope: str = "campaign") -> DataFrame:
    """First event of each entity of the scope, read from its first timeline file.

    ``manifest`` has (entity, scope, jsonl_files), ``events`` has (file, seq, date_or_session, text).
    """
    file = F.get(F.filter("jsonl_files", lambda f: f.endswith(".timeline.jsonl")), F.lit(0))
    wanted = (
        manifest.where((F.lower(strip(F.col("scope"))) == scope) & (strip(F.col("entity")) != ""))
        .select(strip(F.col("entity")).alias("entity"), file.alias("file"))
        .where(F.col("file").isNotNull())
    )
    first = events.groupBy("file").agg(F.min_by(F.struct("date_or_session", "text"), "seq").alias("e"))
    return wanted.join(first, "file").select(
        "entity",
        display_name(F.col("entity")).alias("display_name"),
        not_blank(strip(not_blank(F.col("e.date_or_session"), "unspecified")), "unspecified").alias("date_or_session"),
        clip(F.col("e.text")).alias("text"),
        F.col("file").alias("source"),
    )


def intro_order(intro: DataFrame) -> DataFrame:
    """Real dates first, then other session names, then by entity."""
    key = strip(F.col("date_or_session"))
    day = F.when(key.rlike(r"^\d{4}-\d{1,2}-\d{1,2}\z"), F.try_to_timestamp(key, F.lit("yyyy-M-d")))
    return intro.orderBy(day.isNull(), day, F.when(day.isNull(), F.lower(key)), F.lower("display_name"))


def summary_of(text: Column, skip: Sequence[str] = NOT_CONTENT) -> Column:
    """One-line summary from the first two lines that look like content."""

    def content(line: Column) -> Column:
        low = F.lower(line)
        skipped = F.lit(False)
        for start in skip:
            skipped = skipped | F.startswith(low, F.lit(start))
        return (F.length(line) >= 20) & ~skipped

    def from_two(two: Column) -> Column:
        first = plain_text(clip(F.get(two, F.lit(0)), 90))
        second = plain_text(clip(F.get(two, F.lit(1)), 70))
        return let(
            F.struct(first.alias("a"), second.alias("b")),
            lambda s: F.when(F.size(two) == 0, NO_SUMMARY)
            .when(F.size(two) == 1, s["a"])
            .when(F.contains(F.lower(s["a"]), F.lower(s["b"])), s["a"])
            .otherwise(plain_text(clip(F.concat(s["a"], F.lit(" - "), s["b"]), 120))),
        )

    return let(F.slice(F.filter(stripped_lines(text), content), 1, 2), from_two)


def session_summary(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(key, summary_of(F.col("text")).alias("summary"))


def session_source_refs(docs: DataFrame, sources: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct quoted source names of each document in order of first use: (key, pos, ref).

    ``sources`` (name, path, root_rank) resolves a name to its path, a later root wins; an unknown name
    is kept as it stands.
    """
    named = F.transform(
        stripped_lines(F.col("text")), lambda s: base_name(strip(F.regexp_extract(s, r"Source:\s*`([^`]+)`", 1)))
    )
    uses = docs.select(key, F.posexplode_outer(named).alias("pos", "name")).where(F.col("name") != "")
    paths = sources.groupBy("name").agg(F.max_by("path", F.struct("root_rank", "path")).alias("known"))
    return (
        uses.join(paths, "name", "left")
        .groupBy(key, F.coalesce("known", "name").alias("ref"))
        .agg(F.min("pos").cast("long").alias("pos"))
        .select(key, "pos", "ref")
    )


def session_events(sessions: DataFrame, sources: DataFrame) -> DataFrame:
    """Session documents (path, name, text) named by their date: date, summary, source, refs."""
    day = F.regexp_extract("name", r"^(20\d{2}-\d{2}-\d{2})\.md\z", 1)
    dated = sessions.where(day != "").withColumn("date", day)
    refs = session_source_refs(dated, sources, "path").groupBy("path").agg(
        joined_in_order("pos", "ref", "\n").alias("refs")
    )
    return (
        dated.select("path", "date", summary_of(F.col("text")).alias("summary"))
        .join(refs, "path", "left")
        .select("date", "summary", F.col("path").alias("source"), F.coalesce("refs", F.lit("")).alias("refs"))
        .orderBy("date")
    )
