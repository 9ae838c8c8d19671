"""Locked packages of lockfiles as one table: repo_id, path, ecosystem, name, version.

files: repo_id, path, content. Only exact versions count; links, workspaces, URLs and branches are no packages of a registry.
A file that does not parse yields no rows.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkquarry.functions import paths
from sparkquarry.sources.files import lines_of, parse_gomod

#: Levels of a nested dependency tree that are read.
MAX_TREE_DEPTH = 64
ENTRIES = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("raw", T.StringType())]))


def exact_version(raw: Column) -> Column:
    """A full semantic version without a leading ``v``; null for ranges, URLs, branches and build numbers."""
    number, tag = r"(?:0|[1-9]\d*)", r"(?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*)"
    plain = F.regexp_replace(F.trim(raw), r"^v(?=\d)", "")
    return F.when(plain.rlike(rf"^{number}\.{number}\.{number}(?:-{tag}(?:\.{tag})*)?$"), plain)


def _packages(rows: DataFrame, ecosystem: str) -> DataFrame:
    """Rows (repo_id, path, name, raw) with an exact version, each once."""
    out = rows.select("repo_id", "path", F.lit(ecosystem).alias("ecosystem"), "name", exact_version(F.col("raw")).alias("version"))
    return out.where("name IS NOT NULL AND name <> '' AND version IS NOT NULL").distinct()


@F.pandas_udf(ENTRIES)
def _tree_entries(content: pd.Series) -> pd.Series:
    """Every (name, version) of a nested ``dependencies`` tree, which has no bounded type that from_json could take."""

    def entries(text):
        try:
            doc = json.loads(text)
        except (TypeError, ValueError, RecursionError):
            return []
        found, level = [], [doc.get("dependencies") if isinstance(doc, dict) else None]
        for _ in range(MAX_TREE_DEPTH + 1):
            each = [(n, e) for deps in level if isinstance(deps, dict) for n, e in deps.items() if isinstance(e, dict)]
            found += [{"name": n, "raw": e["version"]} for n, e in each if isinstance(e.get("version"), str)]
            level = [e.get("dependencies") for _, e in each]
        return found

    return content.map(entries)


def parse_npm_lock(files: DataFrame) -> DataFrame:
    """npm lockfiles of versions 1 to 3: by install path, or the nested tree of a file without a map of packages."""
    entry = "struct<name:string,version:string,link:boolean>"
    read = files.withColumn("packages", F.from_json("content", f"packages map<string,{entry}>")["packages"])
    installed = F.regexp_extract("e.key", r"(?:^|.*/)node_modules/((?:@[^/]+/)?[^/@][^/]*)$", 1)
    mapped = read.select("repo_id", "path", F.explode(F.map_entries("packages")).alias("e")).where("e.key <> '' AND e.value IS NOT NULL AND NOT coalesce(e.value.link, false)")
    mapped = mapped.select("repo_id", "path", F.coalesce("e.value.name", installed).alias("name"), F.col("e.value.version").alias("raw"))
    tree = read.where("packages IS NULL AND content IS NOT NULL").select("repo_id", "path", F.explode(_tree_entries("content")).alias("e")).select("repo_id", "path", "e.*")
    return _packages(mapped.unionByName(tree), "npm")


def parse_pnpm_lock(files: DataFrame) -> DataFrame:
    """Keys of the packages section of pnpm lockfiles, versions 5 to 9, without the peers that follow."""
    section = F.when(F.col("raw").rlike(r"^\S.*:"), F.regexp_extract("raw", r"^([^:]+):", 1))
    under = F.last(section, ignorenulls=True).over(Window.partitionBy("repo_id", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    keys = lines_of(files).withColumn("section", under).where((F.col("section") == "packages") & F.col("raw").rlike(r"^  \S.*:\s*(?:\{.*)?$"))
    # ends at the colon that closes the key; peers follow in parentheses
    line = F.trim(F.regexp_replace("raw", r"\{.*$", ""))
    key = F.ltrim(F.trim(F.substr(line, F.lit(1), F.length(line) - 1), F.lit("'\"")), F.lit("/"))
    keys = keys.withColumn("key", F.substring_index(key, "(", 1)).withColumn("parts", F.split("key", "/"))
    n = F.when(F.col("key").startswith("@"), 2).otherwise(1)
    # old keys put a slash before the version and an underscore before peers
    old = F.array_join(F.slice("parts", 1, n), "/")
    is_old = F.get("parts", n).rlike(r"^\d") & ~F.substr(old, F.lit(2)).contains("@")
    raw = F.substring_index("key", "@", -1)
    name = F.when(is_old, old).otherwise(F.substr("key", F.lit(1), F.length("key") - F.length(raw) - 1))
    return _packages(keys.select("repo_id", "path", name.alias("name"), F.when(is_old, F.substring_index(F.get("parts", n), "_", 1)).otherwise(raw).alias("raw")), "npm")


def _before_range(wanted: Column) -> Column:
    """The name in ``name@range``; a scope begins with the same sign."""
    wanted = F.trim(F.trim(wanted), F.lit('"'))
    rest = F.substring_index(F.substr(wanted, F.lit(2)), "@", 1)
    return F.when(F.substr(wanted, F.lit(2)).contains("@"), F.concat(F.substring(wanted, 1, 1), rest)).otherwise("")


def parse_yarn_lock(files: DataFrame) -> DataFrame:
    """Yarn lockfiles, classic and Berry: the names of a header take the version below it."""
    rows = lines_of(files).where(~F.col("raw").startswith("#") & (F.col("raw") != ""))
    head = F.col("raw").rlike(r"^\S")
    parts = F.split(F.regexp_replace("raw", ":$", ""), ",")
    names = F.array_distinct(F.transform(parts, _before_range))
    registry = F.col("raw").endswith(":") & ~F.col("raw").startswith("__metadata") & ~F.col("raw").rlike("@(?:workspace|link|portal|file):")
    block = F.count_if(head).over(Window.partitionBy("repo_id", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    words = F.split(F.trim("raw"), r"\s+")
    version = F.when((F.size(words) == 2) & F.get(words, F.lit(0)).isin("version", "version:"), F.trim(F.get(words, F.lit(1)), F.lit('"'))).otherwise("")
    rows = rows.select("repo_id", "path", "line", block.alias("block"), F.when(head & registry, names).alias("names"), F.when(~head & (version != ""), version).alias("raw"))
    each = rows.groupBy("repo_id", "path", "block").agg(F.first("names", ignorenulls=True).alias("names"), F.min(F.when(F.col("raw").isNotNull(), F.struct("line", "raw")))["raw"].alias("raw"))
    return _packages(each.select("repo_id", "path", F.explode("names").alias("name"), "raw"), "npm")


def strict_json(text: Column) -> Column:
    """JSON without the comments and trailing commas that JSONC has; strings stay as they are."""
    quoted = r'"(?:[^"\\]++|\\.)*+"'
    plain = F.regexp_replace(text, rf"({quoted})|//[^\n]*|/\*(?:[^*]++|\*(?!/))*+\*/", "$1")
    return F.regexp_replace(plain, rf"({quoted})|,(?=\s*[}}\]])", "$1")


def parse_bun_lock(files: DataFrame) -> DataFrame:
    """bun.lock: each package is an array that begins with its name and version."""
    packages = F.from_json(strict_json(F.col("content")), "packages map<string,array<string>>")["packages"]
    spec = F.get(F.col("e.value"), F.lit(0))
    rows = files.select("repo_id", "path", F.explode(F.map_entries(packages)).alias("e"))
    return _packages(rows.select("repo_id", "path", F.regexp_extract(spec, "^(.+)@[^@]*$", 1).alias("name"), F.regexp_extract(spec, "^.+@([^@]*)$", 1).alias("raw")), "npm")


def parse_composer_lock(files: DataFrame) -> DataFrame:
    """composer.lock: packages and those for development."""
    entry = "array<struct<name:string,version:string>>"
    doc = F.from_json("content", f"packages {entry}, `packages-dev` {entry}")
    none = F.array().cast(entry)
    both = F.concat(F.coalesce(doc["packages"], none), F.coalesce(doc["packages-dev"], none))
    rows = files.select("repo_id", "path", F.explode(both).alias("e"))
    return _packages(rows.select("repo_id", "path", "e.name", F.col("e.version").alias("raw")), "Packagist")


def parse_go_requires(files: DataFrame) -> DataFrame:
    """Modules that a go.mod requires."""
    rows = parse_gomod(files).where("directive = 'require'")
    return _packages(rows.select("repo_id", "path", F.col("module").alias("name"), F.col("version").alias("raw")), "Go")


#: Name of a lockfile, and its reader.
LOCKFILES = [
    ("package-lock.json", parse_npm_lock),
    ("npm-shrinkwrap.json", parse_npm_lock),
    ("pnpm-lock.yaml", parse_pnpm_lock),
    ("yarn.lock", parse_yarn_lock),
    ("bun.lock", parse_bun_lock),
    ("composer.lock", parse_composer_lock),
]
MAX_DEPTH = 2


def locked_packages(files: DataFrame) -> DataFrame:
    """repo_id, ecosystem, name, version and the lockfiles that hold it, of all lockfiles at most two directories deep and all go.mod."""
    name = paths.base_name(F.col("path"))
    near = files.where(paths.depth_of(F.col("path")) <= MAX_DEPTH)
    rows = parse_go_requires(files.where(name == "go.mod"))
    for reader in dict.fromkeys(r for _, r in LOCKFILES):
        rows = rows.unionByName(reader(near.where(name.isin([n for n, r in LOCKFILES if r is reader]))))
    return rows.groupBy("repo_id", "ecosystem", "name", "version").agg(F.array_sort(F.collect_set("path")).alias("lockfiles"))
