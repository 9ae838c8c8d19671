"""Git config files as rows, and the remotes in them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.sources.files import lines_of


def read_value(text: str) -> str:
    """A value without its comment and quotes: outside quotes a tab is a blank, and there are none at the ends."""
    out, gap, inside, chars = "", "", False, iter(text)
    for c in chars:
        if c == "\\":
            c = next(chars, "")
            out, gap = out + gap + {"n": "\n", "t": "\t", "b": "\b"}.get(c, c), ""
        elif c == '"':
            inside = not inside
        elif inside or c not in "#; \t":
            out, gap = out + gap + c, ""
        elif c in "#;":
            break
        elif out:
            gap += " "
    return out


def _value(text: Column) -> Column:
    def read(values: pd.Series) -> pd.Series:
        return pd.Series([v if v is None else read_value(v) for v in values], dtype="object")

    return F.pandas_udf(read, "string")(text)


def parse_git_config(files: DataFrame) -> DataFrame:
    """repo_id, path, line, section, subsection, key and value of .git/config and .gitmodules files.

    Sections and keys are small letters, a subsection in quotes keeps its own. A backslash at its end continues a line. A key without the sign = has a
    null value. Lines under a header that is none, and those that are no entry, give no rows.
    """
    text = F.regexp_replace(F.regexp_replace("content", r"\r\n", "\n"), r"(?<!\\)((?:\\\\)*)\\\n", "$1")
    rows = lines_of(files.withColumn("content", text)).withColumn("code", F.trim(F.col("raw"), F.lit(" \t")))
    rows = rows.where((F.col("code") != "") & ~F.substring("code", 1, 1).isin("#", ";"))
    head = r'^\[\s*([A-Za-z0-9.-]+)(?:\s+"((?:[^"\\]|\\.)*)")?\s*\](.*)$'
    opens = F.col("code").startswith("[")
    name = F.regexp_extract("code", head, 1)
    inner = F.regexp_replace(F.regexp_extract("code", head, 2), r"\\(.)", "$1")
    dotted = F.when(name.contains("."), F.lower(F.substr(name, F.length(F.substring_index(name, ".", 1)) + 2)))
    quoted = F.col("code").rlike(r'^\[\s*[A-Za-z0-9.-]+\s+"')
    section = F.when(quoted, F.struct(F.lower(name).alias("section"), inner.alias("subsection"))).otherwise(F.struct(F.lower(F.substring_index(name, ".", 1)).alias("section"), dotted.alias("subsection")))
    up_to = Window.partitionBy("repo_id", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("under", F.last(F.when(opens, section), ignorenulls=True).over(up_to))
    entry = F.when(opens, F.trim(F.regexp_extract("code", head, 3), F.lit(" \t"))).otherwise(F.col("code"))
    key, rest = F.regexp_extract(entry, r"^([A-Za-z][A-Za-z0-9-]*)[ \t]*(.*)$", 1), F.regexp_extract(entry, r"^([A-Za-z][A-Za-z0-9-]*)[ \t]*(.*)$", 2)
    rows = rows.select("repo_id", "path", "line", "under.*", F.lower(key).alias("key"), rest.alias("rest")).where("section <> '' AND key <> ''")
    rows = rows.where((F.col("rest") == "") | F.substring("rest", 1, 1).isin("=", "#", ";"))
    return rows.select("repo_id", "path", "line", "section", "subsection", "key", _value(F.when(F.col("rest").startswith("="), F.substr("rest", F.lit(2)))).alias("value"))


def remotes(config: DataFrame) -> DataFrame:
    """repo_id, name, url and push_url of remotes; the first url of a name counts, and push_url is null where it is the same."""
    own = config.where("section = 'remote' AND subsection <> '' AND value <> ''")
    first = lambda key: F.min(F.when(F.col("key") == key, F.struct("line", "value")))["value"]
    found = own.groupBy("repo_id", F.col("subsection").alias("name")).agg(first("url").alias("url"), first("pushurl").alias("push_url"))
    return found.where("url IS NOT NULL").withColumn("push_url", F.when(F.col("push_url") != F.col("url"), F.col("push_url")))
