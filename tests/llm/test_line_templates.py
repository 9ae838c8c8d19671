"""Notices in documents with few or many lines of their own, short lines, and copies that must stay whole."""

import random

import pytest

from sparkquarry.llm import line_templates

_pick = random.Random(11)


def _line(n=8):
    return " ".join("".join(_pick.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def _kept(spark, texts, **options):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in sorted(line_templates.drop_recurring_lines(frame, **options).collect(), key=lambda r: r.doc_id)]


@pytest.mark.parametrize("n_own", [1, 2, 3, 4, 5, 12])
def test_a_notice_goes_whatever_stands_beside_it(spark, n_own):
    notice, own = [_line() for _ in range(5)], [[_line() for _ in range(n_own)] for _ in range(100)]
    copies = [_line() for _ in range(20)]  # a page and its copies, exact and with a line changed
    copied = ["\n".join(copies)] * 40 + ["\n".join([*copies[:i], _line(), *copies[i + 1 :]]) for i in range(20)]
    got = _kept(spark, ["\n".join([*x[: n_own // 2], *notice, *x[n_own // 2 :]]) for x in own] + copied)
    assert got == ["\n".join(x) for x in own] + copied


def test_short_lines(spark):
    own = [[_line() for _ in range(4)] for _ in range(100)]
    texts = ["\n".join(["Menu", x[0], "Read more", "", *x[1:], *(["Yes."] if i < 9 else [])]) for i, x in enumerate(own)]
    got = _kept(spark, texts)
    assert got == ["\n".join([x[0], "", *x[1:], *(["Yes."] if i < 9 else [])]) for i, x in enumerate(own)]
    assert _kept(spark, texts, short_share=1.1) == texts


def test_odd_rows(spark):
    long = "\n".join(_line() for _ in range(4000))
    texts = [None, "", "\n\n", "one", long, long, "a\r\nb\n"]
    assert _kept(spark, texts) == texts and _kept(spark, [None]) == [None]
    frame = spark.createDataFrame([(1, "x", 2, 3)], "doc_id long, text string, n_dropped int, of int")
    assert line_templates.drop_recurring_lines(frame.limit(0)).collect() == []
    assert line_templates.drop_recurring_lines(frame).columns == ["doc_id", "text", "of", "n_lines", "n_dropped"]
