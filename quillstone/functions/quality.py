"""Page quality as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.text import WHITESPACE, collapse, lines, strip, word_tokens


@dataclass(frozen=True)
class Thresholds:
    # Fixed values of the quality formula.
    base: float = 100.0
    empty_penalty: float = 120.0
    short_penalty: float = 30.0
    noise_weight: float = 60.0
    duplicate_weight: float = 40.0
    reward_words: int = 300
    reward_divisor: float = 20.0
    short_words: int = 25
    low_score: float = 45.0
    low_noise: float = 0.28
    suspicious_words: int = 15
    suspicious_noise: float = 0.45
    suspicious_duplicates: float = 0.45
    disagreement_overlap: float = 0.22
    disagreement_words: int = 20


DEFAULT = Thresholds()


def line_signature(line: Column) -> Column:
    return collapse(F.lower(line))


def signatures(text: Column) -> Column:
    """Signatures of the non-blank lines."""
    return F.filter(F.transform(lines(strip(text)), line_signature), lambda s: s != "")


def symbol_noise_ratio(text: Column) -> Column:
    """Share of non-alphanumeric characters among the non-space ones; 1 when there are none."""
    visible = F.length(F.translate(text, WHITESPACE, ""))
    symbols = F.regexp_count(text, F.lit(r"(?U)[^\p{L}\p{N}\s\x1c-\x1f]"))
    return F.when(visible == 0, F.lit(1.0)).otherwise(symbols / visible)


def duplicate_line_ratio(sigs: Column) -> Column:
    n = F.size(sigs)
    return F.when(n > 1, (n - F.size(F.array_distinct(sigs))) / n).otherwise(F.lit(0.0))


def measure(text: Column) -> Column:
    """Raw measures of one page, unrounded."""
    return F.struct(
        F.length(strip(text)).cast("long").alias("char_count"),
        F.regexp_count(F.lower(text), F.lit("[a-z0-9]+")).cast("long").alias("word_count"),
        symbol_noise_ratio(text).alias("noise"),
        signatures(text).alias("signatures"),
    )


def judge(raw: Column, t: Thresholds = DEFAULT) -> Column:
    """Quality record of a page from its raw measures.

    Ratios and score are stored rounded, the flags come from the unrounded values.
    """
    words = raw["word_count"]
    noise = raw["noise"]
    dup = raw["dup"]
    empty = words == 0
    short = words < t.short_words
    score = (
        F.lit(t.base)
        - F.when(empty, t.empty_penalty).otherwise(0.0)
        - F.when(short, t.short_penalty).otherwise(0.0)
        - noise * t.noise_weight
        - dup * t.duplicate_weight
        + F.least(words, F.lit(t.reward_words)) / t.reward_divisor
    )
    return F.struct(
        raw["char_count"].alias("char_count"),
        words.alias("word_count"),
        raw["line_count"].alias("line_count"),
        empty.alias("empty"),
        short.alias("short"),
        F.round(noise, 4).alias("symbol_noise_ratio"),
        F.round(dup, 4).alias("duplicate_line_ratio"),
        F.round(score, 3).alias("quality_score"),
        ((score < t.low_score) | (short & (noise > t.low_noise))).alias("low_quality"),
        (
            empty
            | (words < t.suspicious_words)
            | (noise > t.suspicious_noise)
            | (dup > t.suspicious_duplicates)
        ).alias("suspicious"),
    )


def page_quality(text: Column, t: Thresholds = DEFAULT) -> Column:
    """Full quality record of a page as a struct; each measure is computed once."""
    measured = F.transform(
        F.array(measure(text)),
        lambda m: F.struct(
            m["char_count"].alias("char_count"),
            m["word_count"].alias("word_count"),
            F.size(m["signatures"]).cast("long").alias("line_count"),
            m["noise"].alias("noise"),
            duplicate_line_ratio(m["signatures"]).alias("dup"),
        ),
    )
    return F.transform(measured, lambda m: judge(m, t))[0]


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token sets; both empty gives 1, one empty gives 0."""
    both = F.transform(
        F.array(F.struct(F.array_distinct(word_tokens(a)).alias("a"), F.array_distinct(word_tokens(b)).alias("b"))),
        lambda s: F.when((F.size(s["a"]) == 0) & (F.size(s["b"]) == 0), F.lit(1.0))
        .when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), F.lit(0.0))
        .otherwise(F.size(F.array_intersect(s["a"], s["b"])) / F.size(F.array_union(s["a"], s["b"]))),
    )
    return both[0]
