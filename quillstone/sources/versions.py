"""Folders whose content changes as a whole: a new version is written beside the old one, then named the current one."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"


def _folder(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def new_version(root: str) -> str:
    return f"{root.rstrip('/')}/version-{uuid.uuid4().hex}"


def publish(spark: SparkSession, root: str, version: str) -> None:
    """Make a version the current one, in one step: its name replaces the old name by a rename."""
    pointer, files = _folder(spark, f"{root.rstrip('/')}/{POINTER}")
    draft, _ = _folder(spark, f"{root.rstrip('/')}/{POINTER}-{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(bytearray(version.rstrip("/").rsplit("/", 1)[-1].encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(files.makeQualified(draft), files.makeQualified(pointer), kinds)


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the current version; None before the first one is published."""
    pointer, files = _folder(spark, f"{root.rstrip('/')}/{POINTER}")
    if not files.exists(pointer):
        return None
    source = files.open(pointer)
    try:
        name = bytes(source.readNBytes(256)).decode()
    finally:
        source.close()
    return f"{root.rstrip('/')}/{name}"


def write_tables(spark: SparkSession, root: str, steps: Iterable[tuple[str, Callable[[], DataFrame]]]) -> str:
    """Write the tables of all steps as a new version and publish them together.

    A step that fails ends the run; what was current stays current, and nothing of the new version is seen.
    """
    version = new_version(root)
    for name, step in steps:
        step().write.parquet(f"{version}/{name}")
    publish(spark, root, version)
    return version


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    version = current(spark, root)
    if version is None:
        raise FileNotFoundError(f"no version is published below {root}")
    return spark.read.parquet(f"{version}/{name}")
