"""A training corpus from raw documents: the stages, each a numbered operator, in their order."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.llm import jaccard_join, language_id, line_templates, mixing, packing
from sparkquarry.llm.common import crc_of_id, shared_table
from sparkquarry.llm.queries import DOMAINS, label_domain

#: Least posterior of the language found; documents under it, and those without a language, go.
LEAST_LANGUAGE_SCORE = 0.5
#: What each domain keeps of its expected tokens.
DOMAIN_FACTORS = {"clean": 1.0, "junk": 0.25, "toxic": 0.0}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (7): documents without a clear language go."""
    model = language_id.fit(docs.where(crc_of_id(docs["doc_id"], 4) != 2))
    found = language_id.predict(model, docs)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (5): lines of recurring templates go; n_chars follows the text."""
    found = line_templates.drop_recurring_lines(docs)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (2): of each component the row of the smallest id and text hash stays; of rows equal in id and text one."""
    key = ("doc_id", "t1", "t2")
    found = shared_table(jaccard_join.keyed_components(docs).select(*key, "label"), "components")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), *key))  # a null id only where no row has one
    first = found.where("label IS NOT NULL").groupBy("label").agg(least.alias("first")).select("first.doc_id", "first.t1", "first.t2")
    first = shared_table(first.unionByName(found.where("label IS NULL").select(*key).distinct()), "survivors").alias("first")
    rows = docs.select("*", *jaccard_join.text_hashes(docs["text"])).alias("row")
    same = F.col("row.doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row.t1") == F.col("first.t1")) & (F.col("row.t2") == F.col("first.t2"))
    kept = rows.join(first, same, "left_semi")
    total, keys = found.agg(F.count("*"), F.count_distinct(F.struct(*key))).first()
    if total != keys:
        kept = kept.groupBy(*key).agg(F.min(F.struct(*docs.columns)).alias("whole")).select("whole.*")
    return kept.select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights (3): rates of at most 1 meet DOMAIN_FACTORS; a document stays with its rate as the chance."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = mixing.fit_domains(docs, labels, label_domain(), DOMAINS)
    return mixing.mix(docs, model, factors=DOMAIN_FACTORS, most_rate=1.0).where(F.col("mix_copies") >= 1).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (10): one row per piece of a sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_copies", near_copies),
    ("mixing", mixed),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
