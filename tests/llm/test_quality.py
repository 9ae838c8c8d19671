"""Random-indexing quality: context vectors against a plain count, held-out accuracy, calibration and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkquarry.llm import quality
from sparkquarry.llm.common import crc_of_id
from sparkquarry.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def _bytes(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(b) for b in raw]))


def test_context_vectors(spark):
    texts = ["the cat sat, the cat ran", "a dog ran!! THE dog", "", "cat", "ünder 12 ab9"] * 7
    got = quality.fit_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), 5)
    hashes, shapes, doc = quality.tokens(*_bytes(texts))
    rows = quality._rows_of(got.vocabulary, hashes, shapes)
    total, times = np.zeros((len(got.vectors), quality.DIMENSIONS)), np.zeros(len(got.vectors))
    index = quality._index_vectors(hashes)
    for i in range(len(hashes)):
        times[rows[i]] += 1
        for j in (i - 2, i - 1, i + 1, i + 2):
            if 0 <= j < len(hashes) and doc[i] == doc[j]:
                total[rows[i]] += index[j]
    want = total / np.maximum(1, times)[:, None]
    want -= (want * times[:, None]).sum(0) / times.sum()
    want /= np.maximum(1e-9, np.linalg.norm(want, axis=1))[:, None]
    share = np.zeros(len(want))
    share[: len(got.vocabulary)] = [np.mean(hashes == h) for h in got.vocabulary]
    want *= (quality.SMOOTHING / (quality.SMOOTHING + share) * (times > 0))[:, None]
    assert len(got.vocabulary) == 5 and np.allclose(got.vectors, want, atol=1e-6)


def test_pooling_is_a_mean_for_each_text():
    vectors = quality.WordVectors(np.zeros(0, np.uint64), np.arange(quality.SHAPES * quality.DIMENSIONS, dtype=np.float32).reshape(quality.SHAPES, -1))
    texts = ["one Two THREE 44 !!", "", "same same same", " \n", "one Two THREE 44 !!", "x " * 5000]
    x = vectors.pooled(*_bytes(texts))
    _, shapes, doc = quality.tokens(*_bytes(texts))
    for i in range(len(texts)):
        own = shapes[doc == i]
        assert np.allclose(x[i], np.append(vectors.vectors[own].mean(0), quality._SHAPE_VECTORS[own].mean(0)) if len(own) else 0.0, rtol=1e-5)
    assert (x[0] == x[4]).all()


def test_temperature_finds_the_scale_of_the_logits():
    pick = np.random.default_rng(2)
    x = pick.normal(0, 1, (4000, 2 * quality.DIMENSIONS))
    y = (pick.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    network = quality.train(x[:3000], y[:3000], rounds=3)
    network.out, network.out_bias = 8 * network.out, 8 * network.out_bias  # far too sure of itself
    score = quality.calibrated(network, x[3000:], y[3000:]).scores(x[3000:])
    assert 4 < network.temperature < 16
    for low in (0.0, 0.25, 0.5, 0.75):
        inside = (score >= low) & (score < low + 0.25)
        assert abs(score[inside].mean() - y[3000:][inside].mean()) < 0.12


def test_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    found = QUERIES["op11_random_indexing_quality"](spark, SF)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows) and {r.quality for r in rows} == {0, 1}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"good plain words number {i % 9} here", 1) if i % 3 else (i, "BUY!! NOW!! %%% cheap cheap cheap", 2) for i in range(300)]
    rows += [(None, "good plain words", 3), (1000, None, 4), (1001, "", 5), (1001, " \n", 6), (1002, "!! " * 40_000, 7), (5, "another text of id five", 8), (1003, "", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality_score long")


def test_odd_rows(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (7, None), (8, 0), (8, 1), (9, 5)], "doc_id long, quality int")
    model = quality.fit(docs, labels, crc_of_id(docs["doc_id"], 4) != 2, words=50)
    rows = quality.predict(model, docs).collect()
    assert len(rows) == docs.count() and rows[0].asDict().keys() == {"doc_id", "text", "quality_score"}
    by_text = {}
    for r in rows:
        assert 0 <= r.quality_score <= 1
        by_text.setdefault((r.text or "").strip(), set()).add(r.quality_score)
    assert all(len(s) == 1 for t, s in by_text.items() if t != "!! " * 40_000)
    assert by_text["BUY!! NOW!! %%% cheap cheap cheap"].pop() < 0.3 and by_text["good plain words number 1 here"].pop() > 0.9


def test_no_labels_and_no_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True), words=50)
    assert {round(r.quality_score, 6) for r in quality.predict(model, docs).collect()} == {0.75}
    none = docs.limit(0)
    model = quality.fit(none, labels, F.lit(True))
    assert quality.predict(model, none).count() == 0 and {r.quality_score for r in quality.predict(model, docs.limit(3)).collect()} == {0.5}
