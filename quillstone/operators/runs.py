"""Accounting of transcription runs: what is left to do and what came out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.ranking import first_per_group

# Sizes above which an output counts as done, and the alert pattern of run logs.
DONE_BYTES = 100
ALERTS = r"(?i)timed out|curl: \(28\)|connection refused|empty response body"


def document_key(path: Column) -> Column:
    """Relative path with ``__`` for ``/`` and without the PDF extension."""
    return F.replace(F.replace(path, F.lit("/"), F.lit("__")), F.lit(".pdf"), F.lit(""))


def pending_documents(items: DataFrame, outputs: DataFrame, min_bytes: int = DONE_BYTES) -> DataFrame:
    """Work items (path) without an output (document, length) larger than ``min_bytes``."""
    done = outputs.where(F.col("length") > min_bytes).select("document").distinct()
    return items.withColumn("document", document_key(F.col("path"))).join(done, "document", "left_anti")


def document_status(pages: DataFrame, may_fail: bool = True, sample: int = 200) -> DataFrame:
    """State of every document from its pages (document, page, ok, chars, error).

    ``ok``, ``partial`` or, where the engine can fail as a whole, ``error``; the first ``sample`` errors
    are kept as text. They are cut before the shuffle, so a document with many errors stays small.
    """
    totals = pages.groupBy("document").agg(
        F.count("*").alias("pages"),
        F.count_if(~F.col("ok")).alias("failed_pages"),
        F.sum(F.when(F.col("ok"), F.col("chars")).otherwise(0)).alias("chars"),
    )
    failed = first_per_group(pages.where(~F.col("ok")), ["document"], [F.col("page")], sample)
    errors = failed.groupBy("document").agg(
        F.array_sort(F.collect_list(F.struct("page", "error"))).alias("errors")
    )
    all_failed = F.lit(may_fail) & (F.col("failed_pages") >= F.col("pages"))
    status = F.when(F.col("failed_pages") == 0, "ok").when(all_failed, "error").otherwise("partial")
    return totals.join(errors, "document", "left").select(
        "document", status.alias("status"), "pages", "failed_pages", "chars", "errors"
    )


def run_summary(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("n"))


def log_alerts(log: DataFrame, pattern: str = ALERTS) -> DataFrame:
    """Alerting lines per run (run, text): whether there are any, and how many."""
    hit = F.col("text").rlike(pattern)
    return log.groupBy("run").agg(F.bool_or(hit).alias("alert"), F.count_if(hit).alias("n"))


def chars_delta(raw_pages: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Characters before and after cleaning per document."""
    before = raw_pages.groupBy("document").agg(F.sum(F.length("text")).alias("chars"))
    after = cleaned.select("document", F.length("text").cast("long").alias("cleaned_chars"))
    return before.join(after, "document", "left").select(
        "document", "chars", F.coalesce("cleaned_chars", F.lit(0)).cast("long").alias("cleaned_chars")
    )
