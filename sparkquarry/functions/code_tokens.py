"""Source code as arrays of tokens, and what stands around a token, as column expressions.

A token is a quoted text on one line, a word, a number, one of a few signs of two characters, a line end or any other sign. Comments are no tokens.
Backticks are signs, so that what a template holds is read like other code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens on each side of one that are looked at.
REACH = 300
_TOKEN = r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[A-Za-z_$][\w$]*|\d[\w.]*|\?\.|\?\?|\|\||:=|\n|[^\s]"""
WORD = r"^[A-Za-z_$][\w$]*$"


def without_comments(code: Column) -> Column:
    """Code whose comments are blanks; what looks like one within quotes stays."""
    quoted = r""""(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'|`(?:[^`\\]++|\\[\s\S])*+`"""
    return F.regexp_replace(code, rf"({quoted})|//[^\n]*|/\*(?:[^*]++|\*(?!/))*+\*/", "$1 ")


def tokens(code: Column) -> Column:
    return F.regexp_extract_all(without_comments(code), F.lit(_TOKEN), F.lit(0))


def places(array: Column, wanted: Column) -> Column:
    """Positions (from 0) of the tokens that are among ``wanted``."""
    at = F.transform(array, lambda t, i: F.when(F.array_contains(wanted, t), i))
    return F.array_compact(at)


def before(array: Column, at: Column) -> Column:
    """The tokens before a position, the nearest first."""
    first = F.greatest(at - REACH, F.lit(0))
    return F.reverse(F.slice(array, first + 1, at - first))


def behind(array: Column, at: Column) -> Column:
    return F.slice(array, at + 2, F.lit(REACH))


def rest(array: Column, n: int | Column) -> Column:
    """``array`` without its first ``n`` tokens."""
    return F.slice(array, F.lit(n) + 1 if isinstance(n, int) else n + 1, F.lit(REACH))


def until(array: Column, token: str) -> Column:
    """The tokens before the first ``token``; null if there is none."""
    n = F.array_position(array, token).cast("int")
    return F.when(n > 0, F.slice(array, F.lit(1), n - 1))


def get(array: Column, n: int) -> Column:
    return F.get(array, F.lit(n))


def starts(array: Column, *wanted: str) -> Column:
    """Whether ``array`` begins with these tokens."""
    found = F.lit(True)
    for n, token in enumerate(wanted):
        found = found & get(array, n).eqNullSafe(token)
    return found


def content(token: Column) -> Column:
    """What a quoted token holds; null for any other."""
    return F.when(token.rlike("^[\"']"), F.substr(token, F.lit(2), F.length(token) - 2))


def quoted(array: Column) -> tuple[Column, Column]:
    """(content, number of tokens) of the text in quotes or backticks that ``array`` begins with; null if there is none."""
    tick = get(array, 0).eqNullSafe("`") & get(array, 2).eqNullSafe("`")
    return F.coalesce(content(get(array, 0)), F.when(tick, get(array, 1))), F.when(tick, 3).otherwise(1)
