"""Ranked lexical search against a plain version, with ties, copies, odd rows and several shards and blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sparkquarry.llm import graph_bisection, lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _brute(docs, items, k):
    bags = [(i, Counter(_terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        wanted, scored = Counter(_terms(text)), []
        for i, b, n in bags:
            m = 25 + (75 * n * n_docs) // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t, times in wanted.items() if t in b)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def _rows():
    pick = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ärger", "日本", "x²", "E2e"]
    topic = lambda k: [pick.choice(vocabulary[(k % 6) * 50 : (k % 6) * 50 + 60]) for _ in range(pick.randrange(1, 60))]
    docs = [(i, " ".join(topic(i))) for i in range(1500)]
    docs += [(i, "hot passage w1 w2 w3 Ärger") for i in range(2000, 2900)]  # copies: ties by id
    docs += [(None, "w5 w6 hot"), (None, "w5 w6 hot"), (7, "w5 w6 hot"), (3000, None), (3001, ""), (3002, "?!. --"), (3003, "w9-w9_w9 " * 30_000), (3004, "W1w2\x7fw3")]
    items = [(i, " ".join(pick.choice(vocabulary) for _ in range(12))) for i in range(12)]
    items += [(90, "hot PASSAGE"), (91, "hot PASSAGE"), (91, "hot PASSAGE"), (92, None), (93, "absent"), (94, ""), (None, "w5 hot w5"), (95, "w9"), (96, "ärger Ärger 日本")]
    return docs, items


@pytest.fixture(scope="module")
def tables(spark):
    docs, items = _rows()
    # columns named like those of results and of the other table
    d = spark.createDataFrame([(*r, 1, 2, "z") for r in docs], "doc_id long, text string, score long, rank int, item_id string")
    return d, spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, doc_id long")


@pytest.mark.parametrize("k,sample,depth,batch", [(10, 400, 3, 5000), (3, 50, 6, 4), (2000, 8192, 1, 5000)])
def test_results(tables, monkeypatch, k, sample, depth, batch):
    docs, items = _rows()
    got = lexical_search.search(*tables, k, sample=sample, depth=depth, batch=batch)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _brute(docs, items, k)


def test_empty_tables(tables):
    docs, items = tables
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("text IS NULL"), items), (docs, items.where("text = 'absent'"))):
        found = lexical_search.search(d, i)
        assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]


def test_long_texts_are_hashed_in_parts():
    text = ("abc " * 1000 + "word" * 900 + " ").encode() * 3
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    start, end, doc = lexical_search.spans(lexical_search._TERM_BYTE[data], offsets)
    assert (lexical_search.span_hashes(data, start, end, 64) == lexical_search.span_hashes(data, start, end)).all()
    assert len(start) == 3003 and not doc.any()


def test_bisection_brings_topics_together():
    pick = np.random.default_rng(1)
    topic = pick.permutation(np.arange(512) % 4)
    rows = [np.unique(pick.integers(0, 40, 20) + 40 * t) for t in topic]
    ptr, terms = np.append(0, np.cumsum([len(r) for r in rows])), np.concatenate(rows)
    place = graph_bisection.order(ptr, terms, 160, 64)
    assert sorted(place) == list(range(512)) and np.count_nonzero(np.diff(topic[place])) < 20
    tree = graph_bisection.Tree(ptr, terms, 160, 2)
    leaves = tree.leaves(ptr, terms)
    assert all(len(set(leaves[topic == t])) == 1 for t in range(4)) and len(set(leaves)) == 4
