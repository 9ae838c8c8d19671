"""Line formats around a project: version files, task files, requirements, workspaces of Go, Deno imports, Git refs, ignore rules.

files: repo_id, path, content. Each reader gives one row an entry; malformed lines give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.functions import globs, paths
from sparkquarry.sources.files import lines_of
from sparkquarry.sources.locks import strict_json


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _unquoted(text: Column) -> Column:
    """A text without the quotes around it."""
    quote = F.substring(text, 1, 1)
    return F.when((F.length(text) > 1) & quote.isin('"', "'") & text.endswith(quote), F.substr(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def _first(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("repo_id", "path", *keys).orderBy("line"))).where("__n = 1").drop("__n")


def _carry(value: Column) -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy("repo_id", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))


def parse_version_file(files: DataFrame) -> DataFrame:
    """repo_id, path and version: the first word of the first line that is not a comment."""
    rows = lines_of(files).withColumn("version", F.regexp_extract(F.regexp_replace("raw", "#.*$", ""), r"^\s*(\S+)", 1)).where("version <> ''")
    return _first(rows).select("repo_id", "path", "version")


def parse_tool_versions(files: DataFrame) -> DataFrame:
    """repo_id, path, line, tool and the first version of a .tool-versions file."""
    pattern = r"^\s*(\S+)\s+(\S+)"
    plain = F.regexp_replace("raw", "#.*$", "")
    return lines_of(files).where(plain.rlike(pattern)).select("repo_id", "path", "line", F.regexp_extract(plain, pattern, 1).alias("tool"), F.regexp_extract(plain, pattern, 2).alias("version"))


def parse_mise_tools(files: DataFrame) -> DataFrame:
    """repo_id, path, line, tool and version of the tools of a mise config: a string, the first of a list, or a table's version."""
    plain = _strip(F.regexp_replace("raw", r"""("[^"]*"|'[^']*')|#.*$""", "$1"))
    rows = lines_of(files).withColumn("raw", plain)
    rows = rows.withColumn("table", F.coalesce(_carry(F.when(F.col("raw").rlike(r"^\[[^\]]*\]$"), _strip(F.regexp_extract("raw", r"^\[([^\]]*)\]$", 1)))), F.lit("")))
    entry = F.when(F.col("table") == "tools", F.col("raw")).otherwise(F.regexp_extract("raw", r"^tools\.(.*)$", 1))
    name = _unquoted(_strip(F.substring_index(entry, "=", 1)))
    value = _strip(F.substr(entry, F.length(F.substring_index(entry, "=", 1)) + 2))
    inner = _strip(F.substr(value, F.lit(2), F.length(value) - 2))
    fields = F.filter(F.split(inner, ","), lambda f: _strip(F.substring_index(f, "=", 1)) == "version")
    of_table = _strip(F.substr(F.get(fields, F.lit(0)), F.length(F.substring_index(F.get(fields, F.lit(0)), "=", 1)) + 2))
    version = F.when(value.startswith("["), _unquoted(_strip(F.substring_index(inner, ",", 1)))).when(value.startswith("{"), _unquoted(of_table)).otherwise(_unquoted(value))
    fine = name.rlike(r"^[\w:@/.-]+$") & (value.rlike("^[\\[{\"']") | value.rlike(r"^\d[\d.]*$"))
    return rows.select("repo_id", "path", "line", F.when(name.startswith("core:"), F.substr(name, F.lit(6))).otherwise(name).alias("tool"), F.when(fine, version).alias("version")).where("version <> '' AND tool <> ''")


#: Signs that begin a bound of a requirement.
BOUNDS = "=!<>~"


def parse_requirements(files: DataFrame) -> DataFrame:
    """repo_id, path, line, name (normalised) and spec (null: any) of requirements files; options and comments go."""
    plain = _strip(F.regexp_replace("raw", r"(?:^|\s)#.*$", ""))
    rows = lines_of(files).withColumn("raw", plain).where(F.col("raw").rlike("^[A-Za-z0-9]"))
    # a name ends where an extra, a bound, a marker, an address or a blank begins
    name = F.regexp_extract("raw", r"^[A-Za-z0-9._-]+", 0)
    name = F.rtrim(name, F.lit("._-"))
    tail = F.regexp_replace(F.regexp_replace(F.substr("raw", F.length(name) + 1), r"^\s*\[[^\]]*\]", ""), r"\s+", "")
    clauses = F.split(F.substring_index(F.substring_index(tail, ";", 1), "@", 1), ",")
    is_bound = lambda c: F.translate(F.substring(c, 1, 1), BOUNDS, "") == ""
    kept = F.array_join(F.filter(clauses, lambda c: (c != "") & is_bound(c)), ",")
    return rows.select("repo_id", "path", "line", F.lower(F.regexp_replace(name, "[-_.]+", "-")).alias("name"), F.when(kept != "", kept).alias("spec"))


def parse_go_work(files: DataFrame) -> DataFrame:
    """repo_id, path, line and dir of each module that a go.work uses."""
    rows = lines_of(files).withColumn("code", _strip(F.regexp_replace("raw", "//.*$", ""))).where("code <> ''")
    opens = F.col("code").rlike(r"^use\s*\($")
    inside = _carry(F.when(opens, True).when(F.col("code") == ")", False))
    rows = rows.withColumn("inside", F.coalesce(inside, F.lit(False))).where(~opens & (F.col("code") != ")"))
    used = F.when(F.col("inside"), F.col("code")).otherwise(F.regexp_extract("code", r"^use\s+(\S+)", 1))
    return rows.select("repo_id", "path", "line", F.regexp_replace(used, "^[\"`]|[\"`]$", "").alias("dir")).where("dir <> ''")


def parse_deno_imports(files: DataFrame) -> DataFrame:
    """repo_id, path, name, range (default any) and registry of a Deno config's imports; URLs, paths and prefixes go."""
    imports = F.map_values(F.from_json(strict_json(F.col("content")), "imports map<string,string>")["imports"])
    rows = files.select("repo_id", "path", F.posexplode(imports).alias("line", "s")).withColumn("s", _strip(F.col("s")))
    rows = rows.withColumns({"registry": F.lower(F.substring_index("s", ":", 1)), "parts": F.split(F.regexp_replace(F.substr("s", F.length(F.substring_index("s", ":", 1)) + 2), "^/", ""), "/")})
    scope = F.when(F.get("parts", F.lit(0)).startswith("@"), F.get("parts", F.lit(0)))
    rows = rows.where(F.col("registry").isin("jsr", "npm")).withColumns({"scope": scope, "last": F.get("parts", F.when(scope.isNotNull(), 1).otherwise(0))})
    own = F.substring_index("last", "@", 1)
    span = F.when(F.col("last").contains("@"), F.substr("last", F.length(own) + 2))
    word = lambda w: w.rlike(r"(?i)^[a-z0-9][\w.-]{0,100}$")
    fine = word(own) & (F.col("scope").isNull() | word(F.substr("scope", F.lit(2)))) & (span.isNull() | (F.length(span).between(1, 64) & ~span.rlike(r"\s")))
    rows = rows.where(fine).select("repo_id", "path", "line", F.concat_ws("/", "scope", own).alias("name"), F.coalesce(span, F.lit("*")).alias("range"), "registry")
    return _first(rows, "name").drop("line")


def _recipe(lines: DataFrame) -> DataFrame:
    """Each line with its block, that of the last line that is not indented."""
    return lines.withColumn("top", ~F.col("raw").rlike(r"^\s|^$")).withColumn("block", _carry(F.when(F.col("top"), F.col("line"))))


#: Words that begin a directive of a makefile and no rule.
MAKE_DIRECTIVES = ["include", "-include", "sinclude", "ifeq", "ifneq", "ifdef", "ifndef", "else", "endif", "export", "unexport", "override", "vpath", "undefine", "private", "load", "-load"]


def parse_makefile(files: DataFrame) -> DataFrame:
    """repo_id, path, name and command: plain targets with what follows the semicolon or the first line of the recipe.

    A target that comes again fills an empty command. Assignments, patterns, expansions, dot targets and define bodies go.
    """
    words = F.split(_strip(F.col("raw")), r"\s+")
    at = F.when(F.get(words, F.lit(0)).isin("export", "override"), 1).otherwise(0)
    begins, ends = (F.get(words, at) == "define") & ~F.col("raw").rlike(r"^\s"), F.get(words, F.lit(0)) == "endef"
    defined = _carry(F.when(begins, True).when(ends, False))
    rows = lines_of(files).withColumn("ends", ends).withColumn("in_define", F.coalesce(defined, F.lit(False))).where(~F.col("in_define") & ~F.col("ends") & ~F.col("raw").startswith("#"))
    rows = _recipe(rows)
    command = F.regexp_replace(_strip(F.col("raw")), r"^[@+-]+\s*", "")
    body = rows.where(~F.col("top") & (command != "") & ~command.startswith("#")).groupBy("repo_id", "path", "block").agg(F.min(F.struct("line", command.alias("command")))["command"].alias("body"))
    head, rest = F.regexp_extract("raw", "^([^:]+):", 1), F.regexp_extract("raw", "^[^:]+::?(.*)$", 1)
    rule = F.col("top") & (head != "") & ~F.col("raw").rlike("^[^:]+:{1,2}=") & ~head.rlike("[=$(){}%]") & ~rest.rlike(r"^\s*[A-Za-z_][\w.-]*\s*[:?+!]?=") & ~F.regexp_extract(head, r"^\s*(\S+)", 1).isin(MAKE_DIRECTIVES)
    inline = F.regexp_replace(_strip(F.regexp_extract(rest, ";(.*)$", 1)), r"^[@+-]+\s*", "")
    rules = rows.where(rule).select("repo_id", "path", "line", "block", F.explode(F.split(_strip(head), r"\s+")).alias("name"), inline.alias("inline")).where(F.col("name").rlike(r"^[A-Za-z0-9_][\w./-]*$"))
    full = rules.join(body, ["repo_id", "path", "block"], "left").withColumn("command", F.when(F.col("inline") != "", F.col("inline")).otherwise(F.coalesce("body", F.lit(""))))
    return full.groupBy("repo_id", "path", "name").agg(F.min("line").alias("line"), F.coalesce(F.min(F.when(F.col("command") != "", F.struct("line", "command")))["command"], F.lit("")).alias("command"))


def parse_justfile(files: DataFrame) -> DataFrame:
    """repo_id, path, line, name and command: the first definition of each public recipe with its first line."""
    rows = _recipe(lines_of(files).where(~F.col("raw").startswith("#")))
    line = F.regexp_replace(_strip(F.col("raw")), r"^[@-]+\s*", "")
    body = rows.where(~F.col("top") & (line != "") & ~line.startswith("#")).groupBy("repo_id", "path", "block").agg(F.min(F.struct("line", line.alias("command")))["command"].alias("command"))
    tops = rows.where("top")
    before = F.lag("raw").over(Window.partitionBy("repo_id", "path").orderBy("line"))
    hidden = F.coalesce(before.rlike(r"^\[.*\bprivate\b"), F.lit(False))
    unquoted = F.regexp_replace("raw", r"""("[^"]*"|'[^']*'|`[^`]*`)""", "q")
    name = F.regexp_extract(unquoted, r"^@?([A-Za-z_][\w-]*)(?:\s[^:#]*)?:(?!=)", 1)
    recipes = tops.withColumn("hidden", hidden).where(~F.col("raw").rlike(r"^(?:\[|(?:set|alias|export|import\??|mod\??|unexport)\s)")).withColumn("name", name)
    recipes = _first(recipes.where((F.col("name") != "") & ~F.col("name").startswith("_") & ~F.col("hidden")), "name")
    return recipes.join(body, ["repo_id", "path", "block"], "left").select("repo_id", "path", "line", "name", F.coalesce("command", F.lit("")).alias("command"))


def parse_head(files: DataFrame) -> DataFrame:
    """repo_id, ref, branch and sha of a Git HEAD: a symbolic ref or a detached commit."""
    value = _strip(F.regexp_replace("content", r"\s+$", ""))
    ref = F.regexp_extract(value, r"^ref:\s*(\S+)$", 1)
    branch = F.regexp_extract(ref, "^refs/heads/(.+)$", 1)
    sha = F.when(value.rlike("^(?:[0-9a-f]{40}|[0-9a-f]{64})$"), value)
    return files.select("repo_id", F.when(ref != "", ref).alias("ref"), F.when(~branch.isin("", ".invalid"), branch).alias("branch"), sha.alias("sha")).where("ref IS NOT NULL OR sha IS NOT NULL")


def parse_packed_refs(files: DataFrame) -> DataFrame:
    """repo_id, ref and sha; the first entry of a ref counts, peeled lines and comments go."""
    pattern = "^([0-9a-f]{40}|[0-9a-f]{64}) (\\S+)$"
    rows = lines_of(files).withColumn("raw", _strip(F.col("raw"))).where(F.col("raw").rlike(pattern)).select("repo_id", "path", "line", F.regexp_extract("raw", pattern, 2).alias("ref"), F.regexp_extract("raw", pattern, 1).alias("sha"))
    return _first(rows, "ref").select("repo_id", "ref", "sha")


def resolve_refs(heads: DataFrame, refs: DataFrame, *, most: int = 5) -> DataFrame:
    """heads (repo_id, ref, sha) with the commit that each ref leads to: refs (repo_id, ref, sha, target), at most ``most`` steps."""
    at = heads.select("repo_id", "ref", "sha", F.col("ref").alias("__at"))
    step = refs.select("repo_id", F.col("ref").alias("__at"), F.col("sha").alias("__sha"), F.col("target").alias("__target"))
    for _ in range(most):
        at = at.join(step, ["repo_id", "__at"], "left").select("repo_id", "ref", F.coalesce("sha", "__sha").alias("sha"), F.col("__target").alias("__at"))
    return at.select("repo_id", "ref", "sha")


def parse_ignore_rules(files: DataFrame) -> DataFrame:
    """repo_id, base (the file's directory), ord, pattern (glob from the base), keep (``!``) and dirs_only of ignore files."""
    raw = F.regexp_replace("raw", r"(?<!\\)\s+$", "")
    rows = lines_of(files).withColumn("raw", raw).where(~F.col("raw").rlike("^(?:#|!?/?$)"))
    keep = F.col("raw").startswith("!")
    plain = F.regexp_replace(F.regexp_replace("raw", "^!", ""), r"^\\(?=[!#])", "")
    inner = F.regexp_replace(plain, "/$", "")
    # a slash before the end ties a pattern to the file's directory; others match at any depth
    glob = F.when(inner.contains("/"), F.regexp_replace(inner, "^/", "")).otherwise(F.concat(F.lit("**/"), inner))
    return rows.select("repo_id", paths.dir_of(F.col("path")).alias("base"), F.col("line").alias("ord"), glob.alias("pattern"), keep.alias("keep"), plain.endswith("/").alias("dirs_only"))


#: Parts into which the paths below an ignore file are dealt.
IGNORE_SALTS = 16


def ignored_paths(files: DataFrame, rules: DataFrame) -> DataFrame:
    """repo_id and path of the files that rules (repo_id, base, ord, pattern, keep, dirs_only) ignore.

    Each directory above a file, and the file, is judged on its own: the deepest rule file with a match decides, in it the
    last match. What lies in an ignored directory is ignored. Distinct directories are judged once, so files move once.
    """
    dirs = files.select("repo_id", paths.dir_of(F.col("path")).alias("d")).distinct().select("repo_id", F.explode(paths.ancestors(F.col("d"))).alias("a")).select("repo_id", F.col("a.dir").alias("path")).distinct().where("path <> '.'")
    asked = dirs.withColumn("is_dir", F.lit(True)).unionByName(files.select("repo_id", "path").distinct().withColumn("is_dir", F.lit(False)))
    up = asked.select("repo_id", "path", "is_dir", F.explode(paths.ancestors(paths.dir_of(F.col("path")))).alias("a")).select("repo_id", "path", "is_dir", F.col("a.dir").alias("base"), F.col("a.depth").alias("depth"))
    local = F.when(F.col("base") == ".", F.col("path")).otherwise(F.expr("substring(path, length(base) + 2)"))
    # the rules of a file as one row, dealt to every salt, so that neither the files nor the rules of a large directory meet in one task
    ruled = rules.withColumn("regex", globs.glob_regex_of(F.col("pattern"))).groupBy("repo_id", "base").agg(F.array_sort(F.collect_list(F.struct("ord", "keep", "dirs_only", "regex"))).alias("rules"))
    ruled = ruled.withColumn("any", F.array_join(F.transform("rules", lambda r: F.concat(F.lit("(?:"), r["regex"], F.lit(")"))), "|")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(IGNORE_SALTS - 1))))
    up = up.withColumn("local", local).withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(IGNORE_SALTS)).cast("int"))
    # one expression of all rules of a file sorts out most paths; it stays the same from row to row, so it is compiled once
    met = up.join(ruled, ["repo_id", "base", "salt"]).where(F.rlike("local", "any"))
    met = met.withColumn("hits", F.filter("rules", lambda r: (F.col("is_dir") | ~r["dirs_only"]) & F.regexp_like("local", r["regex"]))).where(F.size("hits") > 0)
    hit = met.select("repo_id", "path", "is_dir", "depth", F.element_at("hits", -1)["keep"].alias("keep"))
    verdict = hit.groupBy("repo_id", "path", "is_dir").agg(F.max_by("keep", "depth").alias("keep")).where("NOT keep")
    inside = files.select("repo_id", "path", F.explode(paths.ancestors(paths.dir_of(F.col("path")))).alias("a")).select("repo_id", "path", F.col("a.dir").alias("at"))
    by_dir = inside.join(verdict.where("is_dir").select("repo_id", F.col("path").alias("at")), ["repo_id", "at"], "left_semi").select("repo_id", "path")
    return by_dir.unionByName(verdict.where("NOT is_dir").select("repo_id", "path")).distinct()
