"""Stages of the pipeline on rows that they must keep."""

import gc

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from sparkquarry.llm import language_id, packing, ppm
from sparkquarry.llm.queries import DOMAINS


def test_near_copies_of_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(1)), (None, text(2)), (None, "short"), (5, text(3)), (5, text(4)), (6, text(4)), (2, text(4) + " tail"), (7, text(5)), (7, text(5)), (8, text(1))]
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    want = [(None, text(2)), (None, "short"), (5, text(3)), (2, text(4) + " tail"), (7, text(5)), (8, text(1))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_mixing_meets_its_targets(spark, tmp_path):
    own = {"clean": "river stone garden", "junk": "buy cheap pills", "toxic": "foul nasty slur"}
    rows = [(i, f"{own[DOMAINS[i % 3]]} w{i % 7} common words", DOMAINS[i % 3]) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    frame.selectExpr("doc_id", "cast(domain <> 'junk' as int) AS quality", "cast(domain = 'toxic' as int) AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.mixed(spark, frame.select("doc_id", "text"), str(tmp_path))
    found = {r["domain"]: r["n"] / 300 for r in kept.join(frame.select("doc_id", "domain"), "doc_id").groupBy("domain").agg(F.count("*").alias("n")).collect()}
    assert all(abs(found.get(d, 0) - corpus_pipeline.DOMAIN_FACTORS[d]) < 0.1 for d in DOMAINS), found


def test_workers_hold_nothing_between_stages(spark):
    def held(batches):
        """Tables of contexts and tokenizers that the worker of a task still holds."""
        for _ in batches:
            tokenizers = [x for x in gc.get_objects() if type(x) is packing.WordTokenizer]
            yield pa.RecordBatch.from_arrays([pa.array([len(ppm._tables) + len(tokenizers)])], names=["n"])

    docs = spark.createDataFrame([(i, f"words of text number {i}", "en" if i % 2 else "fr") for i in range(40)], "doc_id long, text string, lang string").repartition(8)
    tasks = spark.range(64).repartition(32)
    assert language_id.predict(language_id.fit(docs), docs).where("lang_pred <> 'und'").count() == 40
    assert {r.n for r in tasks.mapInArrow(held, "n long").collect()} == {0}
    assert packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).count() >= 40
    assert {r.n for r in tasks.mapInArrow(held, "n long").collect()} == {0}
