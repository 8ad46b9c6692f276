"""Document cleaning steps as DataFrame operators; every step is a narrow projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import cleaning as C
from quillstone.functions.text import lines


def on_text(docs: DataFrame, step: Callable[[Column], Column]) -> DataFrame:
    return docs.withColumn("text", step(F.col("text")))


def on_lines(docs: DataFrame, step: Callable[[Column], Column]) -> DataFrame:
    """Apply an array-of-lines step and join the lines again."""
    return on_text(docs, lambda t: F.array_join(step(lines(t)), "\n"))


def clean_documents(docs: DataFrame, fixes: Sequence[tuple[str, str]] = (), **options) -> DataFrame:
    return on_text(docs, lambda t: C.clean_text(t, fixes, **options))
