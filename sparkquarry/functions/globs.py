"""Globs: compiled once on the driver to a regular expression that the JVM runs.

``*`` stays in a segment and also matches dot files, ``**`` crosses segments, ``?`` is one
character, ``{a,b}`` may nest, brackets are literal. Patterns beyond the bounds match nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PATTERN, MAX_ALTERNATIVES, MAX_SOURCE = 1024, 256, 8192
NEVER = r"[^\s\S]"


def _alternatives(pattern: str) -> list[str]:
    """All brace-free readings, innermost braces first; raises ValueError beyond the bound."""
    inner = re.search(r"\{([^{}]*)\}", pattern)
    if not inner:
        return [pattern]
    found: list[str] = []
    for choice in inner[1].split(","):
        found += _alternatives(pattern[: inner.start()] + choice + pattern[inner.end() :])
        if len(found) > MAX_ALTERNATIVES:
            raise ValueError("too many alternatives")
    return found


def _segment(text: str) -> str:
    return "".join("[^/]*" if x[0] == "*" else "[^/]" if x == "?" else re.escape(x) for x in re.findall(r"\*+|\?|[^*?]+", text))


def glob_regex(pattern: str) -> str:
    """Anchored expression that both Java and RE2 accept."""
    cleaned = re.sub(r"/+$", "", re.sub(r"^(?:\./)+", "", pattern))
    try:
        if len(cleaned) > MAX_PATTERN:
            return NEVER
        sources = []
        for alternative in _alternatives(cleaned):
            parts, source = alternative.split("/"), ""
            for i, part in enumerate(parts):
                last = i == len(parts) - 1
                if part == "**":
                    source += "" if i and parts[i - 1] == "**" and not last else ".*" if last else "(?:[^/]*/)*"
                else:
                    source += _segment(part) + ("" if last else "/")
            sources.append(source)
    except ValueError:
        return NEVER
    found = f"^(?:{'|'.join(dict.fromkeys(sources))})$"
    return found if len(found) <= MAX_SOURCE else NEVER


def match_glob(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def match_patterns(path: Column, patterns: list[str]) -> Column:
    """The last pattern that matches decides; ``!`` negates; none: false."""
    found = F.lit(False)
    for p in patterns:
        found = F.when(match_glob(path, p.removeprefix("!")), F.lit(not p.startswith("!"))).otherwise(found)
    return found


def match_wildcard(text: Column, pattern: str) -> Column:
    """``*`` stands for any text, everything else for itself."""
    return text.rlike("^(?s:" + ".*".join(re.escape(x) for x in pattern.split("*")) + ")$")


def glob_regex_of(pattern: Column) -> Column:
    """The expression of a glob that comes as a column, for joins of patterns with paths. Braces may nest; a comma is a
    choice where the pattern has braces; other bounds than the length do not apply."""
    out = F.regexp_replace(F.regexp_replace(pattern, "^(?:\\./)+", ""), "/+$", "")
    out = F.regexp_replace(out, r"([.+^$()|\[\]\\])", r"\\$1")
    out = F.when(out.contains("{"), F.replace(F.replace(F.replace(out, F.lit("{"), F.lit("(?:")), F.lit(","), F.lit("|")), F.lit("}"), F.lit(")"))).otherwise(out)
    # stand-ins keep a star that is done from being read again; a question mark of "(?:" is none of the pattern
    out = F.regexp_replace(out, r"(?<!\()\?", "[^/]")
    out = F.regexp_replace(F.regexp_replace(out, r"(^|/)\*\*/", "$1\u0001"), r"(^|/)\*\*$", "$1\u0002")
    out = F.regexp_replace(F.regexp_replace(out, r"\u0001\*\*/", "\u0001"), r"\*+", "[^/]*")
    out = F.replace(F.replace(out, F.lit("\u0001"), F.lit("(?:[^/]*/)*")), F.lit("\u0002"), F.lit(".*"))
    return F.when(F.length(pattern) <= MAX_PATTERN, F.concat(F.lit("^"), out, F.lit("$"))).otherwise(NEVER)
