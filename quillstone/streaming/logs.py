"""Append-only logs as streams. Each run takes what is new and stops; progress is in its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone.functions.quality import page_quality
from quillstone.operators.cleaning import clean_documents
from quillstone.operators.requests import route_submissions, valid_submissions
from quillstone.sources.versions import current, new_version, publish


def read_log(
    spark: SparkSession, path: str, schema, fmt: str = "json", pattern: str | None = None, files: int | None = None
) -> DataFrame:
    """Files of a folder as a stream, oldest first; ``files`` bounds how many a batch takes."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def drain(query: StreamingQuery) -> None:
    query.awaitTermination()


def stream_ingest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append the new rows of a log to a Parquet table, each exactly once."""
    return (
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(target)
    )


def stream_dedupe(
    stream: DataFrame, target: str, checkpoint: str, key: str = "submission_id", delay: str = "10 minutes"
) -> StreamingQuery:
    """Drop repeated keys that arrive within ``delay``; the watermark bounds the kept state."""
    unique = stream.withWatermark("event_time", delay).dropDuplicatesWithinWatermark([key])
    return stream_ingest(unique, target, checkpoint)


def newest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    columns = rows.columns
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select("r.*")


def write_batch(rows: DataFrame, root: str, batch_id: int) -> None:
    """A batch has its own folder, so a batch repeated after a failure replaces itself."""
    rows.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")


def stream_latest_status(
    stream: DataFrame, root: str, checkpoint: str, key: str = "request_id", order: tuple[str, ...] = ("ts",)
) -> StreamingQuery:
    """Changes per request, reduced to one row per key and batch; see ``latest_table``."""

    def keep_newest(batch: DataFrame, batch_id: int) -> None:
        write_batch(newest(batch, key, list(order)), root, batch_id)

    return (
        stream.writeStream.foreachBatch(keep_newest).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def latest_table(
    spark: SparkSession, root: str, key: str = "request_id", order: tuple[str, ...] = ("ts",), state: str | None = None
) -> DataFrame:
    """Current row of each key. With a ``state`` (see ``compact``) only the batches after it are read."""
    rows = spark.read.parquet(root)
    if state is not None:
        kept = spark.read.parquet(state)
        upto = kept.agg(F.max("upto")).first()[0]
        rows = rows.where(F.col("batch") > upto).unionByName(kept.where(F.col("upto") == upto).drop("upto"))
    return newest(rows, key, list(order)).drop("batch")


def compact(
    spark: SparkSession, root: str, state: str, key: str = "request_id", order: tuple[str, ...] = ("ts",), after: str | None = None
) -> int:
    """Write the current rows of all batches up to now as a new version of ``state``; gives that version.

    ``after`` is the state to start from. A version is named by its last batch, so a repeated run replaces itself.
    """
    rows = spark.read.parquet(root)
    upto = rows.agg(F.max("batch")).first()[0]
    if after is not None:
        kept = spark.read.parquet(after)
        before = kept.where(F.col("upto") < upto).agg(F.max("upto")).first()[0]
        if before is not None:
            rows = rows.where(F.col("batch") > before).unionByName(kept.where(F.col("upto") == before).drop("upto"))
    newest(rows.where(F.col("batch") <= upto), key, list(order)).write.mode("overwrite").parquet(f"{state}/upto={upto}")
    return upto


def stream_route(stream: DataFrame, submissions: str, queue: str, checkpoint: str) -> StreamingQuery:
    """Split submissions into the submission table and the queue rows they cause."""

    def split(batch: DataFrame, batch_id: int) -> None:
        write_batch(valid_submissions(batch), submissions, batch_id)
        write_batch(route_submissions(batch), queue, batch_id)

    return (
        stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def daily_sessions(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events per day; days older than the watermark are final and leave the state."""
    day = F.window("event_time", "1 day")
    return (
        stream.withWatermark("event_time", delay)
        .groupBy(day.alias("w"))
        .agg(F.count("*").alias("n"))
        .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")
    )


def stream_daily_sessions(stream: DataFrame, root: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Counts per day, corrected while late events arrive; ``day_table`` reads them."""
    return (
        daily_sessions(stream, delay)
        .writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: write_batch(batch, root, batch_id))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def day_table(spark: SparkSession, root: str, state: str) -> DataFrame:
    """(day, n) as of now. The batches so far are folded into ``state`` first, so only new batches are read next time."""
    folded = current(spark, state)
    after = None if folded is None else f"{folded}/days"
    version = new_version(state)
    compact(spark, root, f"{version}/days", key="day", order=("batch",), after=after)
    publish(spark, state, version)
    return spark.read.parquet(f"{version}/days").select("day", "n")


def quality_pages(docs: DataFrame, fixes, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cleaned documents with their quality and, from a static table (key, quality), their label if they have one."""
    cleaned = clean_documents(docs.select(key, "text"), fixes)
    measured = cleaned.withColumn("q", page_quality(F.col("text")))
    known = labels.select(key, F.col("quality").alias("label"))
    return measured.join(known, key, "left").select(
        key, "text", "label", F.col("q.word_count").alias("word_count"), F.col("q.quality_score").alias("quality_score"), F.col("q.low_quality").alias("low_quality")
    )


def stream_incremental_pages(
    stream: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str
) -> StreamingQuery:
    """Only new documents pass through ``work``, any narrow chain of this package, joins with static tables included."""
    return stream_ingest(work(stream), target, checkpoint)
