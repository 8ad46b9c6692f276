"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm import (
    chat,
    langid,
    mixing,
    mixture_packing,
    packing,
    prefix_trie,
    quality_crf,
    search,
    simhash,
    suffix_dedup,
    turn_repair,
    url_filter,
    vector_join,
)


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def fold(key: str, folds: int) -> Column:
    """Fold of an id: crc32 of its text, modulo ``folds``."""
    return F.crc32(F.col(key).cast("string")) % folds


def op1_line_crf(spark, sf):
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    field = quality_crf.learn_quality(docs, labels.where(fold("doc_id", 5) != 0))
    return quality_crf.score_quality(docs.select("doc_id", "text"), field).select(
        "doc_id",
        F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op2_configuration_packing(spark, sf):
    import public_tokenizers

    return packing.pack_documents(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"))


def op3_entropy_mix(spark, sf):
    return mixing.mix(documents(spark, sf)).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op4_link_trust(spark, sf):
    return url_filter.judge_urls(spark.read.parquet(f"{sf}/pages.parquet"))


def op5_popcount_grid(spark, sf):
    return simhash.near_duplicates(documents(spark, sf))


def op6_block_max_search(spark, sf):
    """Every document whose id is divisible by 20 is a query, with its whole text."""
    return search.search(documents(spark, sf), F.col("doc_id") % 20 == 0)


def op7_word_backoff(spark, sf):
    docs = documents(spark, sf)
    model = langid.learn_languages(docs.where(fold("doc_id", 4) != 2))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op8_prefix_targets(spark, sf):
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.prefix_targets(rows.unionByName(extra)))


def op9_pivot_range_join(spark, sf):
    return vector_join.link_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op10_suffix_array(spark, sf):
    return suffix_dedup.repeats(documents(spark, sf))


def op11_deficit_packing(spark, sf):
    import public_tokenizers

    return mixture_packing.pack_mixture(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))


def op12_hirschberg_repair(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    return turn_repair.repair_report(rows, turn_repair.damage(rows))


def op13_parentheses_trie(spark, sf):
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf}/conversations.parquet"), rebuilt=True)


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_crf,
        op2_configuration_packing,
        op3_entropy_mix,
        op4_link_trust,
        op5_popcount_grid,
        op6_block_max_search,
        op7_word_backoff,
        op8_prefix_targets,
        op9_pivot_range_join,
        op10_suffix_array,
        op11_deficit_packing,
        op12_hirschberg_repair,
        op13_parentheses_trie,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run

#: Other results cannot be stated in SQL over whole tables; tests/llm holds their brute-force versions.
ORACLES = {
    "op8_prefix_targets": """WITH said AS (SELECT '<|im_end|><|im_start|>assistant ok' AS s),
      turns AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', s FROM said UNION ALL SELECT -1, 1, 'assistant', s FROM said),
      plain AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM turns),
      placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
        24 + length(replace(replace(r, '<|', '<||'), chr(10), '<|nl|>')) + length(replace(x, '<|', '<||')) AS size FROM plain),
      grown AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto, r = 'assistant' AS reply FROM placed)
      SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY i)) AS turns_sha256,
        CAST(coalesce(sum(length(x)) FILTER (reply), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(x, '' ORDER BY i) FILTER (reply), '')) AS loss_sha256,
        CAST(sum(upto) FILTER (reply OR i = n) AS BIGINT) AS formatted_chars FROM grown GROUP BY conv_id""",
    "op9_pivot_range_join": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
      reached AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
      named AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
      counted AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
      SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM named LEFT JOIN counted USING (vec_id)""",
}
