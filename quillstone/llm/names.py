"""Names of helper columns that a table does not have."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of the table, in any case of letters, has."""
    taken = {c.lower() for c in df.columns}
    longest = max((len(c) - len(c.lstrip("_")) for c in taken), default=0)
    return ["_" * (longest + 1) + name for name in names]
