"""The numbered queries: each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitsliced_topk, fill_in_middle, jaccard_join, language_id, lexical_search, line_templates, lm_score, media_columns, mixing, packing, quality, sharding, suffix_dedup
from .common import crc_of_id


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(_read(spark, sf_dir, "documents"))


DOMAINS = ["clean", "junk", "toxic"]


def label_domain() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality").isNotNull(), "clean")


def op3_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = mixing.fit_domains(docs, _read(spark, sf_dir, "labels"), label_domain(), DOMAINS)
    found = mixing.mix(docs, model, {"clean": 0.9, "junk": 0.1, "toxic": 0.0})
    posterior = [F.col("mix_posterior")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return found.select("doc_id", F.col("mix_tokens").alias("n_tokens"), *posterior, F.col("mix_rate").alias("rate"), F.col("mix_copies").alias("copies"))


def op5_log_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_templates.drop_recurring_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op4_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return bitsliced_topk.top_k(vectors, vectors["vec_id"] % 100 == 0, 10)


def op6_sampled_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(_read(spark, sf_dir, "documents"), 16)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = crc_of_id(docs["doc_id"], 4) == 2
    model = language_id.fit(docs.where(~held_out))
    found = language_id.predict(model, docs.select("doc_id", "text", held_out.alias("held_out")))
    return found.select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def op8_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.media_columns(_read(spark, sf_dir, "documents")).drop("media")


def op9_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return lm_score.score_documents(docs, crc_of_id(docs["doc_id"], 7) != 2)


def op10_multi_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = crc_of_id(docs["doc_id"], 4) == 2
    model = quality.fit(docs, _read(spark, sf_dir, "labels"), ~held_out)
    found = quality.predict(model, docs.select("doc_id", "text", held_out.alias("held_out")))
    return found.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


def op12_bisection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), 10)


def op13_marker_injection_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.fill_in_middle(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = fill_in_middle.restore(F.col("fim_text"), F.col("fim_form"))
    return found.select(
        "doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"),
        F.col("fim_middle_chars").alias("middle_chars"), F.sha2("fim_text", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"),
    )


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_prefix_tree_join": op2_prefix_tree_join,
    "op3_soft_membership_mixing": op3_soft_membership_mixing,
    "op5_log_template_lines": op5_log_template_lines,
    "op4_bit_sliced_topk": op4_bit_sliced_topk,
    "op6_sampled_splitter_shards": op6_sampled_splitter_shards,
    "op7_ppm_language": op7_ppm_language,
    "op8_lossless_webp": op8_lossless_webp,
    "op9_ppm_scores": op9_ppm_scores,
    "op10_multi_length_packing": op10_multi_length_packing,
    "op11_random_indexing_quality": op11_random_indexing_quality,
    "op12_bisection_search": op12_bisection_search,
    "op13_marker_injection_fim": op13_marker_injection_fim,
}
ORACLE_SQL: dict[str, str] = {
    "op4_bit_sliced_topk": """
        WITH q AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
                CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        WHERE rank <= 10
    """,
    "op12_bisection_search": """
        WITH docs AS (
            SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), sizes AS (
            SELECT doc, doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0
        ), total AS (
            SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes
        ), wanted AS (
            SELECT row, item_id, term, count(*) AS times
            FROM (SELECT row_number() OVER () AS row, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
            GROUP BY ALL
        ), counts AS (
            SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM docs)
            WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, total GROUP BY term, n_docs
        ), impacts AS (
            SELECT doc, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS worth
            FROM counts JOIN sizes USING (doc) JOIN weights USING (term), total
        ), scored AS (
            SELECT row, item_id, doc, doc_id, CAST(sum(times * worth) AS BIGINT) AS score FROM wanted JOIN impacts USING (term) GROUP BY ALL
        )
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
        WHERE rank <= 10
    """,
    "op13_marker_injection_fim": """
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x
            FROM documents
        ), h AS (
            SELECT doc_id, text, n, CAST('0x' || x[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || x[9:16] AS BIGINT) % (n + 1) AS b,
                text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || x[17:24] AS BIGINT) % 100 >= 90 AS plain,
                CAST('0x' || x[25:32] AS BIGINT) % 100 < 20 AS suffix_first
            FROM t
        ), c AS (
            SELECT *, CASE WHEN plain THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form,
                substring(text, 1, least(a, b)) AS p, substring(text, least(a, b) + 1, abs(a - b)) AS m, substring(text, greatest(a, b) + 1) AS s
            FROM h
        )
        SELECT doc_id, n, form, CASE WHEN NOT plain THEN least(a, b) END AS prefix_chars, CASE WHEN NOT plain THEN abs(a - b) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM c
    """,
}
