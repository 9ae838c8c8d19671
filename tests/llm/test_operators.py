"""The numbered operators on a small table of odd rows, against plain versions."""

import functools
import hashlib
import zlib

import public_tokenizers
import pytest
from brute import near_components, ppm_bits, repeated_bytes, tokens

from sparkquarry.llm import bitsliced_topk, jaccard_join, language_id, line_templates, lm_score, media_columns, mixing, packing, sharding, suffix_dedup
from sparkquarry.llm.queries import QUERIES

BASE = " ".join(f"word{i * 7919 % 997}" for i in range(90))
TEXTS = [
    None, "", "   \n\t", "one two", "one two", BASE, BASE, BASE + " tail", BASE[:300] + " other words here " + BASE[300:], "A" * 3000, "ünïcödé 日本 " * 40,
    "a <|endoftext|> b", "glued<|startoftext|>on", "short TEXT of Six words here", "short text of six words here", " ".join(str(i) for i in range(2000)), BASE + " " + BASE,
]
SCHEMA = "doc_id long, text string, lang string, sid long, token long, size long"


@pytest.fixture(scope="module")
def rows():
    return [(i, t, "en" if i % 2 else None, 0, 0, 0) for i, t in enumerate(TEXTS)] + [(None, BASE, None, None, None, None), (3, "one two", "fr", 1, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _empty(docs):
    return docs.limit(0)


def test_repeated_bytes(docs, rows):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs).collect()), key=repr)
    want = [(r[0], n, gone, spans, hashlib.sha256(left).hexdigest()) for r, (n, gone, spans, left) in zip(rows, repeated_bytes([r[1] for r in rows], 400), strict=True)]
    assert got == sorted(want, key=repr)
    assert suffix_dedup.dedup(_empty(docs)).count() == 0


def test_near_components(docs, rows):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join_components(docs).collect()), key=repr)
    assert got == sorted(near_components([r[:2] for r in rows]), key=repr)


def test_topk_with_ties_and_bad_vectors(spark):
    data = [(i, [float((i * 37 + d * 11) % 19) / 7 - 1 for d in range(8)]) for i in range(300)] + [(300, None), (301, [None] * 8), (302, [float("nan")] * 8)]
    v = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in bitsliced_topk.top_k(v, v["vec_id"] % 100 == 0, 10).collect()}
    import numpy as np

    q = {i: np.floor(1024 * np.array(x, np.float32).astype(float)).astype(int) for i, x in data[:300]}
    for a in (0, 100, 200):
        best = sorted(((-int(q[a] @ q[b]), b) for b in q if b != a))[:10]
        assert [got[a, n + 1] for n in range(10)] == [(b, -s) for s, b in best]


def test_shards(docs, rows):
    got = sharding.shard_documents(docs, 4).collect()
    assert sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 1 for _, t, *_ in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_media_round_trip(docs, rows):
    got = media_columns.media_columns(docs).collect()
    want = {}
    for d, t, *_ in rows:
        raw = (t or "").encode()
        raw += b" " * (-len(raw) % 192 or (0 if raw else 192))
        want.setdefault(d, set()).add((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:])))
    assert len(got) == len(rows)
    assert all((r.payload_bytes, r.payload_sha256, r.tail_crc32) in want[r.doc_id] for r in got)


def test_packing_round_trip(spark, docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, one = Tokenizer.from_file(path), docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).coalesce(1)
    pieces = packing.pack_documents(one, path).collect()
    texts = {r.doc_id: r.text for r in one.collect()}
    for d, t in texts.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.start)
        assert sum(p.length for p in own) == len(ids) == own[0].doc_tokens
        for p in own:
            part = b"".join(i.to_bytes(4, "little") for i in ids[p.start : p.start + p.length])
            assert zlib.crc32(part) == p.ids_crc32
    held = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == held.get(p.sequence_id, 0)
        held[p.sequence_id] = p.offset + p.length
    assert max(held.values()) <= 2048


def test_language_held_out(spark):
    got = QUERIES["op7_ppm_language"](spark, "/root/testdata/sf0.01").where("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = got.join(docs, "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'").selectExpr("avg(cast(lang = lang_pred as double))").first()[0]
    assert right > 0.95


def test_language_of_odd_rows(docs, rows):
    found = language_id.predict(language_id.fit(docs), docs).collect()
    assert len(found) == len(rows)
    assert all(r.lang_pred == "und" and r.score == 0 for r in found if not any(c.isalpha() for c in r.text or ""))
    assert language_id.predict(language_id.fit(_empty(docs)), docs).where("lang_pred <> 'und'").count() == 0


def test_scores(docs, rows):
    import math
    from collections import Counter

    got = lm_score.score_documents(docs, docs["doc_id"] >= 0).collect()
    c = Counter(w for r in rows if r[0] is not None for w in tokens(r[1]))
    end = sum(r[0] is not None for r in rows)
    n, v = sum(c.values()) + end, len(c) + 1
    want = sorted((round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(r[1])) + math.log10((end + 1) / (n + v + 1)), 6) for r in rows))
    assert sorted(round(r.base_score, 6) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)


def test_scores_keep_every_context(spark, monkeypatch):
    import math
    from collections import Counter, defaultdict

    from sparkquarry.llm import gram_table

    monkeypatch.setattr(gram_table.TopGrams.of.__func__, "__defaults__", (20,))  # nearly all grams meet the join
    texts = ["слово и другое слово", "日本語の文 日本語", "plain words and plain words", "слово 日本 words", "слова nowhere seen 語 zq", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_score.score_documents(docs, docs["doc_id"] < 4).collect()}
    streams = [[*"".join(f" {w}" for w in t.lower().split()).encode(), 256] for t in texts]
    behind = lambda s, i, k: tuple(([256] * k + s[:i])[len(s[:i]) :])
    counts = defaultdict(Counter)
    for s in streams[:4]:
        for i, x in enumerate(s):
            for k in range(5):
                counts[behind(s, i, k)][x] += 1

    @functools.cache
    def p(context, x):
        c = counts[context]
        if len(context) and not c:
            return p(context[1:], x)
        if x in c:
            return c[x] / (sum(c.values()) + len(c))
        shorter = (lambda y: p(context[1:], y)) if context else (lambda y: 1 / 257)
        return len(c) / (sum(c.values()) + len(c)) * shorter(x) / sum(shorter(y) for y in range(257) if y not in c)

    want = {i: sum(math.log10(p(behind(s, j, 4), x)) for j, x in enumerate(s)) for i, s in enumerate(streams)}
    assert all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_lines(spark):
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    own = [[f"{word()} {word()} {word()} {word()} {word()}" for _ in range(4)] for _ in range(40)]
    data = [(i, "\n".join([*x[:2], f"served by node {i} at your request today", *x[2:]])) for i, x in enumerate(own)] + [(99, None), (98, "")]
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(got[i].text == "\n".join(x) and got[i].n_dropped == 1 for i, x in enumerate(own))
    assert got[99].text is None and got[98].text == ""


def test_inner_lines_of_a_shared_block(spark):
    import random

    rng = random.Random(2)
    line = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(8))
    block = [line() for _ in range(5)]
    own = [[line() for _ in range(12)] for _ in range(60)]
    whole = [line() for _ in range(15)]  # copied as a whole, with one line changed here and there
    data = [(i, "\n".join([*x[:6], *block, *x[6:]])) for i, x in enumerate(own)]
    data += [(100 + i, "\n".join([*whole[:7], *([line()] if i % 8 == 0 else []), *whole[7:]])) for i in range(60)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(frame.withColumns({"kind": frame["doc_id"], "pos": frame["doc_id"], "template": frame["text"]})).collect()}
    assert all(got[i] == "\n".join(x) for i, x in enumerate(own))
    assert all(got[d] == t for d, t in data[60:])


def test_mixing_of_odd_rows(spark, docs, rows):
    labels = spark.createDataFrame([(i, "clean" if i % 2 else "junk") for i in range(8)], "doc_id long, domain string")
    odd = docs.selectExpr("*", "1 AS domain", "2 AS label_id", "3 AS mix_id", "4 AS mix", "5 AS mix_rate", "'x' AS own_text")
    model = mixing.fit_domains(odd, labels, labels["domain"], ["clean", "junk"], least_documents=1, least_g=0.5)
    got = mixing.mix(odd, model, {"clean": 1.0, "junk": 1.0}).collect()
    assert len(got) == len(rows)
    assert all(abs(sum(r.mix_posterior) - 1) < 1e-9 and r.mix_rate >= 0 and r.mix_copies in (int(r.mix_rate), int(r.mix_rate) + 1) for r in got)
    assert all(r.mix_tokens == 0 for r in got if not (r.text or "").strip())
    assert mixing.mix(_empty(odd), model, {"clean": 1.0}).count() == 0
    none = mixing.fit_domains(odd, labels.limit(0), labels["domain"], ["clean", "junk"])
    assert all(r.mix_posterior == [0.5, 0.5] for r in mixing.mix(odd.where("text IS NULL"), none, {"clean": 1.0}).collect())


def test_mixing_held_out_and_residual(spark):
    from sparkquarry.llm.queries import DOMAINS, label_domain

    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    model = mixing.fit_domains(docs, labels.where("doc_id % 2 = 0"), label_domain(), DOMAINS)
    held = docs.join(labels.where("doc_id % 2 = 1").select("doc_id", label_domain().alias("own")), "doc_id").where("own IS NOT NULL")
    found = mixing.mix(held, model, factors={d: 1.0 for d in DOMAINS})
    best = "element_at(array('clean', 'junk', 'toxic'), cast(array_position(mix_posterior, array_max(mix_posterior)) AS int))"
    right = {r["own"]: r["hit"] for r in found.selectExpr("own", f"cast(own = {best} AS double) AS hit").groupBy("own").avg("hit").toDF("own", "hit").collect()}
    assert right["clean"] > 0.98 and right["junk"] > 0.85 and right["toxic"] > 0.75, right


def _noisy(n, words, edits, rng):
    base = [f"b{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("tree_sets", "members"), [(256, 2048), (16, 8)])
def test_near_components_of_hot_groups(spark, monkeypatch, tree_sets, members):
    import random

    rng = random.Random(3)
    monkeypatch.setattr(jaccard_join, "TREE_SETS", tree_sets)  # groups over many tasks and parts
    monkeypatch.setattr(jaccard_join, "MEMBERS", members)
    shared = " ".join(f"s{i}" for i in range(60))
    texts = _noisy(300, 80, 7, rng) + [f"{t} {shared}" for t in _noisy(40, 60, 9, rng)] + [f"{shared} own{i} end" for i in range(30)] + ["copy of a text with more words"] * 50
    rows = list(enumerate(texts))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect())
    assert got == sorted(near_components(rows))


def test_joins_of_empty_and_repeated_rows(spark, docs):
    assert jaccard_join.join_components(_empty(docs)).count() == 0
    same = spark.createDataFrame([(None, BASE)] * 40 + [(7, BASE + " x")] * 3, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard_join.join_components(same).collect()} == {(None, 7), (7, 7)}


def test_language_codes_match_brute_force(spark):
    texts = {"el": ["Καλημέρα κόσμε", "η γλώσσα μας"], "en": ["Good morning world", "our language is here"], "ja": ["おはよう世界", "私たちの言葉"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, own in texts.items() for t in own for _ in range(2))]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    asked = ["", "κόσμε η", "morning here ÿ", "世界の言葉 x", "zq" * 300, "\U0001f600 mixed κό"]
    got = language_id.predict(model, spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id int, text string")).orderBy("doc_id").collect()
    trained = {lang: [t for t in own for _ in range(2)] for lang, own in texts.items()}
    for row, text in zip(got, asked, strict=True):
        want = {lang: ppm_bits(own, text) for lang, own in trained.items()}
        if text == "":
            assert row.lang_pred == "und" and row.score == 0
            continue
        best = min(want, key=want.get)
        assert row.lang_pred == best
        assert abs(row.bits_per_byte * len(text.encode()) - want[best]) < 1e-3 * len(text)
        assert abs(row.score - 1 / sum(2.0 ** (want[best] - b) for b in want.values())) < 1e-4


def test_language_of_a_rare_script(spark):
    rows = [(i, "the quick brown fox jumps over it again and again", "en") for i in range(300)] + [(900, "быстрая лиса", "ru"), (901, "敏捷的狐狸", "zh")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    found = language_id.predict(language_id.fit(docs, most_nodes=120), spark.createDataFrame([(1, "лиса"), (2, "狐狸"), (3, "brown")], "doc_id int, text string"))
    assert [r.lang_pred for r in found.orderBy("doc_id").collect()] == ["ru", "zh", "en"]
