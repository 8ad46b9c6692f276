"""Corpus pipeline: from documents to packed training sequences, stage by stage.

Each stage works on all documents that the stage before it kept, written as Parquet in the shared folder and read again.

Defined results of every stage: an empty table gives an empty one; null ids, sources and texts are kept as they are; a null
text counts as an empty one; rows that repeat an id or a whole row are rows of their own; further columns pass through,
whatever their names, up to the last stage, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import mixing, near_copies, packing, quality_crf, suffix_dedup
from quillstone.llm.names import fresh
from quillstone.sources.storage import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are likely good; learned from the labels that the quality query may learn from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    field = quality_crf.learn_quality(docs, labels)
    (score,) = fresh(docs, "score")
    return quality_crf.score_quality(docs, field, name=score).where(F.col(score) >= 0.3).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles with an exact similarity of 0.8 and more.

    Candidates are those of the popcount grid over fingerprints, and those that only bands of minima find.
    """
    return near_copies.drop_near_copies(docs, width=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words that stand at several places."""
    cut = suffix_dedup.drop_repeats(docs, length=51, words=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, whatever its id; rows equal in all columns share their copies, none is lost."""
    row, copies, number, copy = fresh(docs, "row", "copies", "number", "copy")
    rows = docs.withColumn(row, F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.hex(F.xxhash64(*docs.columns))))
    taken = mixing.mix(rows, key=row).groupBy(row).agg(F.sum("copies").cast("int").alias(copies), F.count("*").alias(number))
    taken = stored(taken, "mix-taken")
    equal = stored(taken.where(F.col(number) > 1), "mix-equal")
    picked = rows.join(taken.where(F.col(number) == 1), row).unionByName(rows.join(equal, row).dropDuplicates([row]))
    return picked.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(copies)))).select(docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packed_sequences", packed_sequences),
]
#: Sequence labelling, fingerprints and packing cannot be stated in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
