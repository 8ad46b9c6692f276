"""Writers for Markdown documents, JSON documents and JSON-lines logs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.versions import current, new_version, publish


def write_docs(docs: DataFrame, path: str, buckets: int = 64) -> str:
    """Text documents (key, body) as JSON lines, ``buckets`` folders with many documents each; gives the new version.

    A document's folder is the hash of its key, so the number of folders does not depend on the rows. The documents
    replace what was there when all of them are written; readers see the old ones until then.
    """
    spark = docs.sparkSession
    version = new_version(path)
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    rows = docs.select("key", "body", bucket).repartition("bucket", F.pmod(F.xxhash64("body"), F.lit(8)))
    rows.write.partitionBy("bucket").option("maxRecordsPerFile", 100_000).option("compression", "gzip").json(version)
    publish(spark, path, version)
    return version


def read_docs(spark: SparkSession, path: str, key: str = "bigint", keys: Sequence | None = None, buckets: int = 64) -> DataFrame:
    """Current documents (key, body); with ``keys`` only the folders of these are read."""
    version = current(spark, path)
    if version is None:
        raise FileNotFoundError(f"no documents are published below {path}")
    docs = spark.read.schema(f"key {key}, body string, bucket bigint").json(version)
    if keys is not None:
        wanted = spark.createDataFrame([(k,) for k in keys], f"key {key}")
        folders = [r[0] for r in wanted.select(F.pmod(F.xxhash64("key"), F.lit(buckets))).distinct().collect()]
        docs = docs.where(F.col("bucket").isin(folders) & F.col("key").isin(list(keys)))
    return docs.select("key", "body")


def write_files(files: DataFrame, root: str) -> None:
    """One file (path below ``root``, text) per row, for tools that want single files; a repeated task replaces them."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = FileSystem.from_uri(root) if "://" in root else (LocalFileSystem(), root.removeprefix("file:"))
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                place = f"{base.rstrip('/')}/{path}"
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(place) as out:
                    out.write((text or "").encode())
            yield batch.select(["path"])

    files.select("path", "text").mapInArrow(write, "path string").count()


def json_documents(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Nested summary document per row as JSON text."""
    return df.select(key, F.to_json(F.struct(*columns)).alias("json"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def central_review_queue(queue: DataFrame) -> DataFrame:
    """Review items of all books wrapped as (book, item); overwritten per run, so re-runs add nothing."""
    item = F.struct(*[c for c in queue.columns if c != "book"])
    return queue.select("book", item.alias("item"))
