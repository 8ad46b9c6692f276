"""Two transcriptions of the same pages: measure both, choose one, flag doubtful pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.quality import DEFAULT, Thresholds, jaccard, page_quality
from quillstone.functions.text import excerpt, strip

# Names of the review flags and of the reasons.
FLAG_DISAGREE = "high_disagreement_low_overlap"
FLAG_BOTH_LOW = "both_low_quality"
FLAG_SUSPICIOUS = "chosen_suspicious"
REASON_SCORE = "higher_quality_score"


def page_metrics(pages: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Quality columns of every page."""
    keep = [c for c in pages.columns if c != "text"]
    return pages.select(*keep, page_quality(F.col("text"), t).alias("q")).select(*keep, "q.*")


def decide(qa: Column, qb: Column, names: tuple[str, str]) -> tuple[Column, Column]:
    """Winner and reasons: the higher rounded score, a tie goes to the second source."""
    a, b = names
    first = qa["quality_score"] > qb["quality_score"]
    tie = qa["quality_score"] == qb["quality_score"]
    winner = F.when(first, a).otherwise(b)
    reasons = F.array(
        F.when(tie, f"tie_break_{b}").otherwise(REASON_SCORE),
        F.when(first & qa["short"] & ~qb["short"], f"{a}_short_penalty_override"),
        F.when(~first & qb["short"] & ~qa["short"], f"{b}_short_penalty_override"),
    )
    return winner, F.array_compact(reasons)


def review_flags(qa: Column, qb: Column, first: Column, overlap: Column, t: Thresholds = DEFAULT) -> Column:
    chosen = F.when(first, qa["suspicious"]).otherwise(qb["suspicious"])
    return F.array_compact(
        F.array(
            F.when(
                (overlap < t.disagreement_overlap)
                & (qa["word_count"] >= t.disagreement_words)
                & (qb["word_count"] >= t.disagreement_words),
                FLAG_DISAGREE,
            ),
            F.when(qa["low_quality"] & qb["low_quality"], FLAG_BOTH_LOW),
            F.when(chosen, FLAG_SUSPICIOUS),
        )
    )


def harmonize(
    a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b"), t: Thresholds = DEFAULT
) -> DataFrame:
    """Chosen text per (book, page) of two page tables; a page missing on one side counts as empty.

    One shuffle on (book, page), so a big book is spread; all measures are computed behind the join.
    """
    sides = a.select("book", "page", F.col("text").alias("text_a")).join(
        b.select("book", "page", F.col("text").alias("text_b")), ["book", "page"], "full"
    )
    blank = F.lit("")
    measured = sides.select(
        "book",
        "page",
        F.coalesce("text_a", blank).alias("text_a"),
        F.coalesce("text_b", blank).alias("text_b"),
    ).select(
        "*",
        page_quality(F.col("text_a"), t).alias("q_a"),
        page_quality(F.col("text_b"), t).alias("q_b"),
        jaccard(F.col("text_a"), F.col("text_b")).alias("overlap"),
    )
    qa, qb = F.col("q_a"), F.col("q_b")
    winner, reasons = decide(qa, qb, names)
    first = qa["quality_score"] > qb["quality_score"]
    return measured.select(
        "book",
        "page",
        winner.alias("winner"),
        reasons.alias("winner_reasons"),
        F.round("overlap", 4).alias("overlap_jaccard"),
        review_flags(qa, qb, first, F.col("overlap"), t).alias("flags"),
        strip(F.when(first, F.col("text_a")).otherwise(F.col("text_b"))).alias("text"),
        "text_a",
        "text_b",
        "q_a",
        "q_b",
    )


def review_queue(harmonised: DataFrame) -> DataFrame:
    return harmonised.where(F.size("flags") > 0).select(
        "book",
        "page",
        "winner",
        "flags",
        "overlap_jaccard",
        excerpt(F.col("text_a")).alias("excerpt_a"),
        excerpt(F.col("text_b")).alias("excerpt_b"),
    )


def harmonize_summary(harmonised: DataFrame) -> DataFrame:
    return harmonised.groupBy("book").agg(
        F.count("*").alias("total_pages"), F.count_if(F.size("flags") > 0).alias("flagged_pages")
    )


def harmonize_all(
    a: DataFrame,
    b_clean: DataFrame,
    b_pages: DataFrame,
    names: tuple[str, str] = ("a", "b"),
    t: Thresholds = DEFAULT,
) -> DataFrame:
    """All books of the first source in one job, with ``input_mode`` telling what the second side was.

    The second side is the cleaned text of a book, else its single pages, else nothing.
    """
    in_a = a.select("book").distinct()
    in_clean = b_clean.select("book").distinct()
    in_pages = b_pages.select("book").distinct()
    second = b_clean.unionByName(b_pages.join(in_clean, "book", "left_anti")).join(in_a, "book", "left_semi")
    modes = (
        in_a.join(in_clean.withColumn("_clean", F.lit(True)), "book", "left")
        .join(in_pages.withColumn("_pages", F.lit(True)), "book", "left")
        .select(
            "book",
            F.when(F.col("_clean"), "cleaned_text")
            .when(F.col("_pages"), "synthesized_from_pages")
            .otherwise("missing_second_source")
            .alias("input_mode"),
        )
    )
    return harmonize(a, second, names, t).join(modes, "book")


def page_record(harmonised: DataFrame, names: tuple[str, str] = ("a", "b"), width: int = 200) -> DataFrame:
    """Nested meta row of each page: decision plus one record per source."""

    def record(side: str) -> Column:
        quality = F.col(f"q_{side}")
        fields = [
            "char_count", "word_count", "line_count", "empty", "short", "symbol_noise_ratio",
            "duplicate_line_ratio", "quality_score", "low_quality", "suspicious",
        ]
        return F.struct(
            F.col("page"),
            *[quality[f].alias(f) for f in fields],
            excerpt(F.col(f"text_{side}"), width).alias("excerpt"),
        )

    return harmonised.select(
        "book",
        "page",
        "winner",
        "winner_reasons",
        "overlap_jaccard",
        "flags",
        F.struct(record("a").alias(names[0]), record("b").alias(names[1])).alias("sources"),
    )
