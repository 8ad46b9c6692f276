"""Line noise removal as column expressions over one document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.text import let, lines, lstrip, quoted, rstrip, strip, title_case

# Markup spans left by the transcription engine.
TAG_SPANS = (("<|ref|>", "<|/ref|>"), ("<|det|>", "<|/det|>"))


def strip_tags(text: Column, spans: Sequence[tuple[str, str]] = TAG_SPANS) -> Column:
    for opening, closing in spans:
        text = F.regexp_replace(text, f"(?i){quoted(opening)}.*?{quoted(closing)}", "")
    return text


def apply_fixes(text: Column, fixes: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements in the given order."""
    for bad, good in fixes:
        text = F.replace(text, F.lit(bad), F.lit(good))
    return text


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")


def is_page_number(line: Column) -> Column:
    return strip(line).rlike(r"^(?:\d{1,4}|(?i:page)(?U:\s)+\d{1,4})\z")


def drop_page_number_lines(ls: Column) -> Column:
    return F.filter(ls, lambda line: ~is_page_number(line))


def dedupe_consecutive_lines(ls: Column) -> Column:
    """Drop a non-blank line equal to the last non-blank line before it; blank lines stay."""

    def body(src: Column) -> Column:
        numbered = F.transform(src, lambda line, i: F.struct(i.alias("i"), strip(line).alias("t")))
        return let(
            numbered,
            lambda rows: let(
                F.filter(rows, lambda r: r["t"] != ""),
                lambda full: F.transform(
                    F.array_sort(
                        F.concat(
                            F.transform(F.filter(rows, lambda r: r["t"] == ""), lambda r: r["i"]),
                            F.transform(
                                F.filter(full, lambda r, k: (k == 0) | (r["t"] != full[F.greatest(k - 1, F.lit(0))]["t"])),
                                lambda r: r["i"],
                            ),
                        )
                    ),
                    lambda i: src[i],
                ),
            ),
        )

    return let(ls, body)


def join_wrapped_lines(ls: Column) -> Column:
    """Join a line with the next one when the sentence goes on; every line is used at most once.

    Each line is marked 1 when it may take its successor. Scanning the marks from the left, ``1`` takes
    the mark behind it, whatever that is, so one regular-expression pass gives the greedy pairing.
    """

    def may_take_next(src: Column) -> Column:
        def mark(line: Column, i: Column) -> Column:
            cur = rstrip(line)
            nxt = lstrip(src[F.least(i + 1, F.size(src) - 1)])
            goes_on = (
                (i + 1 < F.size(src))
                & (cur != "")
                & (nxt != "")
                & ~F.substring(cur, -1, 1).isin(".", ":", ";", "!", "?")
                & nxt.rlike(r"^\p{Ll}")
            )
            return F.when(goes_on, "1").otherwise("0")

        return F.array_join(F.transform(src, mark), "")

    def body(src: Column) -> Column:
        roles = F.split(F.regexp_replace(may_take_next(src), "1.", "JS"), "")
        return let(
            roles,
            lambda role: F.filter(
                F.transform(
                    src,
                    lambda line, i: F.when(role[i] == "S", F.lit(None).cast("string"))
                    .when(
                        role[i] == "J",
                        F.concat(rstrip(line), F.lit(" "), lstrip(src[F.least(i + 1, F.size(src) - 1)])),
                    )
                    .otherwise(line),
                ),
                lambda line: line.isNotNull(),
            ),
        )

    return let(ls, body)


def normalize_heading(line: Column, max_len: int = 70) -> Column:
    def body(s: Column) -> Column:
        shouted = (F.length(s) < max_len) & (F.upper(s) == s) & s.rlike(r"\p{L}")
        return F.when(s == "", "").when(shouted, F.concat(F.lit("## "), title_case(s))).otherwise(line)

    return let(strip(line), body)


def normalize_headings(ls: Column, max_len: int = 70) -> Column:
    return F.transform(ls, lambda line: normalize_heading(line, max_len))


def collapse_blank_runs(text: Column) -> Column:
    return F.concat(strip(F.regexp_replace(text, "\n{3,}", "\n\n")), F.lit("\n"))


def clean_text(
    text: Column,
    fixes: Sequence[tuple[str, str]] = (),
    spans: Sequence[tuple[str, str]] = TAG_SPANS,
    max_heading: int = 70,
) -> Column:
    """All cleaning steps in their fixed order, inside one row."""
    flat = dehyphenate(apply_fixes(strip_tags(text, spans), fixes))
    ls = join_wrapped_lines(dedupe_consecutive_lines(drop_page_number_lines(lines(flat))))
    return collapse_blank_runs(F.array_join(normalize_headings(ls, max_heading), "\n"))
