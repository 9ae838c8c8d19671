"""Fill-in-middle against a plain version, with escapes, sentinels and other planes in the texts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sparkquarry.llm import fill_in_middle as fim

ROWS = [
    (1, None), (2, ""), (3, "a\x01b\x02c\x02d\x02e" * 5), (None, "日本語😀 text é"), (5, "has <P> in"), (6, "<S"), (7, "x" * 5), (8, "\x02e\x01d" * 40 + "\n\r \u0085"),
    (9, "😀" * 50), (9, "😀" * 50), (10, "long é\x01 " * 60_000), (11, "é‍\r\n"), (12, "<P"), (13, ">S><M"),
] + [(i, "abc <\x02\x01>😀é\n" * (i % 13)) for i in range(20, 400)]


def _plain(i, t):
    t = t or ""
    n, x = len(t), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    if t == "" or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (i, n, "plain", None, None, t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    return (i, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (i, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"fim": F.lit(1), "fim_form": F.lit(2), "n": F.lit(3)})


def test_code_points(docs):
    found = fim.fill_in_middle(docs)
    assert found.columns == ["doc_id", "text", "fim", "n", *fim.RESULT]
    got = [tuple(r) for r in found.select("doc_id", *fim.RESULT).collect()]
    assert sorted(map(repr, got)) == sorted(repr(_plain(*r)) for r in ROWS)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", sorted(fim.UNITS))
def test_every_text_comes_back(docs, unit):
    found = fim.fill_in_middle(docs, unit=unit, fim_percent=100, spm_percent=50, seed="other")
    rows = found.select("text", fim.restore(F.col("fim_text"), F.col("fim_form")).alias("back"), "fim_units", "fim_form", "fim_text").collect()
    assert all(r.back == (r.text or "") for r in rows)
    assert all((r.fim_form == "plain") == (not r.text or any(s in r.text for s in fim.SENTINELS)) for r in rows)
    units = {"code_point": len, "word": lambda t: len(t.split()) + (t != t.rstrip()), "line": lambda t: len(t.split("\n")) - t.endswith("\n") if t else 0}
    if unit != "word":  # Python's blanks are others than the pattern's
        assert all(r.fim_units == units[unit](r.text or "") for r in rows)


def test_cuts_lie_between_words(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(30))) for i in range(60)], "doc_id long, text string")
    for r in fim.fill_in_middle(docs, unit="word", fim_percent=100, spm_percent=0).collect():
        prefix = r.text[: r.fim_prefix_chars]
        assert r.fim_units == 30 and (prefix == "" or r.text[len(prefix) :] == "" or r.text[len(prefix)] == " ")


def test_nothing_is_shuffled_and_empty_stays_empty(docs):
    found = fim.fill_in_middle(docs.limit(0))
    assert found.count() == 0
    plan = fim.fill_in_middle(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
