"""Column helpers for text: trimming, lines, tokens, slugs, titles, excerpts.

Everything here is a native Column expression, so it stays in the JVM and needs no shuffle: a
document is one row, and work on its lines happens inside that row.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when trimming, and the line separators.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# separators that ``\R`` and ``\s`` do not know
LINE_CONTROLS = "\x1c\x1d\x1e"
SPACE_CONTROLS = "\x1c\x1d\x1e\x1f"
SPACES = r"(?U)\s+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    Inside a lambda of a higher-order function an outer expression is evaluated for every element; a
    lambda variable is not. Wrapping the value in a one-element array makes it a lambda variable.
    """
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE))


def or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def not_blank(c: Column, default: str | Column) -> Column:
    """``c`` unless it is null or empty, then ``default``."""
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(c, F.lit("")), fallback)


def swap(c: Column, chars: str, to: str) -> Column:
    """Replace single characters; costs next to nothing where a text has none of them."""
    for ch in chars:
        c = F.replace(c, F.lit(ch), F.lit(to))
    return c


def collapse(c: Column) -> Column:
    """Trimmed text with every run of white space as one blank; most short texts already are that."""
    return let(
        strip(swap(c, SPACE_CONTROLS, " ")),
        lambda t: F.when(t.rlike(r"(?U)\s\s|[^\S ]"), F.regexp_replace(t, SPACES, " ")).otherwise(t),
    )


def lines(c: Column) -> Column:
    """Lines of a text as an array; a final line break does not open another line."""
    return let(
        F.split(swap(c, LINE_CONTROLS, "\n"), r"\R", -1),
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p),
    )


def stripped_lines(c: Column) -> Column:
    return F.transform(lines(c), strip)


def left(c: Column, n: int | Column) -> Column:
    return F.substring(c, F.lit(1), F.lit(n) if isinstance(n, int) else n)


def excerpt(c: Column, width: int = 280) -> Column:
    return let(
        collapse(c),
        lambda t: F.concat(left(t, width), F.when(F.length(t) > width, "...").otherwise("")),
    )


def count_literal(text: Column, term: Column | str) -> Column:
    """Non-overlapping occurrences of a literal."""
    term = F.lit(term) if isinstance(term, str) else term
    gone = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.when(F.length(term) > 0, (gone / F.length(term)).cast("long")).otherwise(F.lit(0).cast("long"))


def word_tokens(c: Column) -> Column:
    """ASCII letter and digit runs of the lower-cased text, as used by the quality measures."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)


def title_case(c: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others."""
    pieces = F.split(c, r"(?<=\P{L})|(?=\P{L})", -1)
    return F.array_join(F.transform(pieces, F.initcap), "")


def slug(c: Column, split_separators: bool = True) -> Column:
    """File-name form. With ``split_separators`` each blank and slash gives its own dash."""
    low = F.lower(c)
    if split_separators:
        low = F.translate(low, "/ ", "--")
    return F.btrim(F.regexp_replace(low, "[^a-z0-9-]+", "-"), F.lit("-"))


def entity_key(c: Column) -> Column:
    """Comparison key of an entity name: lower, no ``entity:`` prefix, alphanumeric runs only."""
    bare = F.regexp_replace(F.lower(strip(or_blank(c))), r"(?U)^entity\s*:\s*", "")
    return F.btrim(F.regexp_replace(bare, "[^a-z0-9]+", "-"), F.lit("-"))


def fold_case(c: Column) -> Column:
    """Form for comparing without case, where sharp s equals double s."""
    return F.lower(F.upper(F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))))


def name_key(c: Column) -> Column:
    """Case-insensitive, blank-insensitive equality key of a name."""
    return fold_case(collapse(or_blank(c)))


def display_name(c: Column) -> Column:
    label = collapse(F.regexp_replace(strip(or_blank(c)), "[-_]+", " "))
    return F.when(label == "", "Unknown Entity").otherwise(title_case(label))


def norm_date(c: Column) -> Column:
    """First 20yy-mm-dd date (also with ``_`` or ``/``) as yyyy-mm-dd, else null; not validated."""
    found = F.regexp_extract(c, r"20\d{2}[-_/]\d{2}[-_/]\d{2}", 0)
    return F.translate(F.nullif(found, F.lit("")), "_/", "--")


def session_title(c: Column) -> Column:
    """First dddd-dd-dd in a file name, else the name without its extension."""
    found = F.regexp_extract(c, r"\d{4}[-_]\d{2}[-_]\d{2}", 0)
    return not_blank(F.translate(found, "_", "-"), stem(c))


def stem(c: Column) -> Column:
    """File name without the last extension; a leading dot is no extension."""
    return F.regexp_replace(c, r"(?s)^(.+)\.[^.]+$", "$1")


def base_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def heading_title(body: Column, fallback: Column) -> Column:
    """Text of the first line that starts with ``#``, without the marks."""
    first = F.get(F.filter(stripped_lines(body), lambda s: s.startswith("#")), F.lit(0))
    return not_blank(strip(F.ltrim(first, F.lit("#"))), fallback)


def clip(c: Column, limit: int = 80, empty: str = "first campaign mention") -> Column:
    """Plain one-line form cut at a blank before ``limit`` and closed with an ellipsis."""
    plain = collapse(F.regexp_replace(F.replace(or_blank(c), F.lit("\ufeff"), F.lit(" ")), r"[*_`#>\-\u2022]+", " "))

    def cut(t: Column) -> Column:
        head = left(t, limit - 1)
        # everything before the last blank, or the whole head when it has none
        at_blank = F.when(F.instr(head, " ") > 0, strip(F.regexp_replace(head, r"(?s) [^ ]*\z", ""))).otherwise(head)
        return F.concat(F.rtrim(not_blank(at_blank, head), F.lit(" ,;:.")), F.lit("…"))

    return let(
        plain,
        lambda t: F.when(t == "", empty).when(F.length(t) <= limit, t).otherwise(cut(t)),
    )


def plain_text(c: Column) -> Column:
    """Text without the punctuation that a timeline label cannot hold."""
    dashed = F.regexp_replace(c, "[:;]", " -")
    return collapse(F.regexp_replace(dashed, r'["`{}\[\]()<>]', ""))


def quoted(literal: str) -> str:
    """A literal as a regular expression."""
    return re.escape(literal)
