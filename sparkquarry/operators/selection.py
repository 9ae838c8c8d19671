"""What is read, kept and in which order it is listed. Orders are lists of columns for ``orderBy`` or a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.functions import paths
from sparkquarry.operators.evidence import CONFIDENCE, rank_of, root_first
from sparkquarry.operators.hierarchy import owner_join

#: Endings of sources, most files of a repository that are read, depths, suffixes that are no Dockerfile's, and the order of runtimes.
SOURCE_ENDINGS = [".js", ".mjs", ".cjs", ".jsx", ".ts", ".mts", ".cts", ".tsx", ".vue", ".svelte", ".astro", ".go"]
MOST_SOURCES, ENV_DEPTH, DOCKERFILE_DEPTH = 20_000, 3, 4
NO_DOCKERFILE = ["go", "js", "ts", "md", "txt", "json", "yml", "yaml", "py", "sh"]
RUNTIMES = ["node", "go", "php", "bun", "deno"]
_SHARED = ["eslint", "prettier", "stylelint", "typescript", "ts"]


def by_confidence(rows: DataFrame, least: str = "medium") -> DataFrame:
    """Rows of at least that confidence."""
    return rows.where(rank_of(F.col("confidence"), CONFIDENCE) >= CONFIDENCE.index(least))


def source_files(files: DataFrame, packages: DataFrame, *, most: int = MOST_SOURCES) -> DataFrame:
    """repo_id, path, ext and package of the sources that are read: not generated, the first ``most`` of a repository in path order. ``packages``: (repo_id, dir)."""
    ext = paths.ext_of(F.col("path"))
    own = files.where(ext.isin(SOURCE_ENDINGS) & ~paths.is_generated(F.col("path"))).select("repo_id", "path", ext.alias("ext"))
    first = own.withColumn("nth", F.row_number().over(Window.partitionBy("repo_id").orderBy("path"))).where(F.col("nth") <= most).drop("nth")
    return owner_join(first, packages).withColumnRenamed("owner", "package")


def env_files(files: DataFrame, package_dirs: DataFrame, named: DataFrame) -> DataFrame:
    """repo_id and path of the env files that count: not deep, in the top directory, a package's (repo_id, dir), or that of a Compose file or of a file that a
    service loads (``named``: repo_id, path), where these are no tests or samples."""
    name = paths.base_name(F.col("path"))
    found = files.where((name.rlike(r"^\.env(?:\.|$)|\.env$|^\.envrc$")) & (paths.depth_of(F.col("path")) <= ENV_DEPTH)).select("repo_id", "path", paths.dir_of(F.col("path")).alias("dir")).distinct()
    named = named.where(~paths.is_under(F.col("path"))).select("repo_id", paths.dir_of(F.col("path")).alias("dir"))
    dirs = package_dirs.select("repo_id", "dir").unionByName(named).distinct()
    return found.where("dir = '.'").unionByName(found.where("dir <> '.'").join(dirs, ["repo_id", "dir"], "left_semi").select("repo_id", "path", "dir")).select("repo_id", "path")


def is_project_dockerfile(path: Column) -> Column:
    """By name, not too deep and under no tests or samples."""
    name = F.lower(paths.base_name(path))
    first, last = F.substring_index(name, ".", 1), F.substring_index(name, ".", -1)
    named = first.isin("dockerfile", "containerfile") & ((last == first) | ~last.isin(NO_DOCKERFILE)) | last.isin("dockerfile", "containerfile")
    return named & ~name.endswith(".dockerignore") & (paths.depth_of(path) <= DOCKERFILE_DEPTH) & ~paths.is_under(path)


def is_no_app_source(path: Column, package: Column) -> Column:
    """Tests, and what lies in a directory of tests or samples below its package."""
    inside = F.when(package == ".", path).otherwise(F.substr(path, F.length(package) + 2))
    return paths.is_test_file(path) | paths.is_under(inside)


def is_config_package(name: Column) -> Column:
    """Whether a package shares configuration by its name, without the scope."""
    bare = F.lower(F.regexp_replace(name, "^@[^/]+/", ""))
    begins = F.lit(False)
    for word in [*(f"{s}-config" for s in [*_SHARED, "commitlint", "biome", "lint"]), "tsconfig", "eslint-plugin", *(f"config-{s}" for s in _SHARED)]:
        begins = begins | (bare == word) | bare.startswith(word + "-")
    ends = bare.endswith("-tsconfig")
    for word in ("eslint", "prettier", "stylelint", "typescript"):
        ends = ends | bare.endswith(f"-{word}-config")
    return begins | ends


def with_git_state(files: DataFrame, tracked: DataFrame | None, ignored: DataFrame) -> DataFrame:
    """``files`` with tracked and ignored; tracked is null where Git is not known (no table)."""
    flag = lambda rows, name: rows.select("repo_id", "path", F.lit(True).alias(name)).distinct()
    found = files.join(flag(ignored, "ignored"), ["repo_id", "path"], "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))
    if tracked is None:
        return found.withColumn("tracked", F.lit(None).cast("boolean"))
    return found.join(flag(tracked, "tracked"), ["repo_id", "path"], "left").withColumn("tracked", F.coalesce("tracked", F.lit(False)))


def unique_functions(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """``calls`` (repo_id, dir, name) with the ``target`` file of the one function of that name in that directory; calls of several or none go.
    ``functions``: (repo_id, path, name)."""
    f = functions.select("repo_id", paths.dir_of(F.col("path")).alias("dir"), "name", "path")
    one = f.groupBy("repo_id", "dir", "name").agg(F.count("*").alias("n"), F.min("path").alias("target")).where("n = 1").drop("n")
    return calls.join(one, ["repo_id", "dir", "name"])


def direct_dependencies(refs: DataFrame) -> DataFrame:
    """Distinct dependencies that are not indirect, a repository and ecosystem."""
    return refs.where("NOT coalesce(indirect, false)").groupBy("repo_id", "ecosystem").agg(F.count_distinct("name").alias("dependencies"))


def test_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id").agg(F.count_if(paths.is_test_file(F.col("path"))).alias("tests"))


def go_test_signals(files: DataFrame, modules: DataFrame, packages: DataFrame) -> DataFrame:
    """Go tests by module, or by package where no module holds them: count, and whether they can be run (confidence high) or not (low)."""
    tests = files.where(F.col("path").endswith("_test.go") & ~paths.is_under(F.col("path"), ["fixture"])).select("repo_id", "path")
    owned = owner_join(tests, modules, default=None).withColumnRenamed("owner", "module")
    owned = owner_join(owned, packages).withColumn("package", F.coalesce("module", "owner"))
    found = owned.groupBy("repo_id", "package").agg(F.count("*").alias("n"), F.bool_or(F.col("module").isNotNull()).alias("runs"))
    where = F.when(F.col("package") == ".", "").otherwise(F.concat(F.lit(" in "), "package"))
    evidence = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " *_test.go file").otherwise(" *_test.go files"), where)
    return found.select("repo_id", "package", F.when(F.col("runs"), "high").otherwise("low").alias("confidence"), evidence.alias("evidence"))


def distinct_sources(sources: DataFrame) -> DataFrame:
    """Of equal sources of a runtime (repo_id, runtime, file, field, raw) the first by ``ord``."""
    keys = ["repo_id", "runtime", "file", "field", "raw"]
    return sources.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).where("nth = 1").drop("nth")


def unused_and_mentioned(variables: DataFrame, mentions: DataFrame) -> DataFrame:
    """Documented variables that no code reads but some file names."""
    return variables.where("documented AND NOT used").join(mentions.select("repo_id", "name"), ["repo_id", "name"], "left_semi")


def project_runtimes(sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """Runtimes with a source that something else of the project speaks for: both by (repo_id, runtime), in the order of their rank: 0 at the top, 1 in a
    package, 2 elsewhere (evidence: dir, null for images and CI)."""
    rank = F.min(F.when(F.col("dir") == ".", 0).when(F.col("dir").isNotNull(), 1).otherwise(2)).alias("rank")
    return evidence.groupBy("repo_id", "runtime").agg(rank).join(sources.select("repo_id", "runtime"), ["repo_id", "runtime"], "left_semi")


# orders --------------------------------------------------------------------------------------------

def order_tools() -> list[Column]:
    return [F.col("kind"), F.lower("name"), F.col("id")]


def order_databases() -> list[Column]:
    return [rank_of(F.col("confidence"), CONFIDENCE).desc(), F.lower("name"), F.col("name")]


def order_runtimes() -> list[Column]:
    return [F.col("rank"), rank_of(F.col("runtime"), RUNTIMES)]


def order_warnings() -> list[Column]:
    return [F.asc_nulls_first(c) for c in ("file", "message", "detail")]


def order_variables(has_local: Column, platform: list[str]) -> list[Column]:
    """The most urgent first: undocumented, of local files only, missing from a local file, unused, fine; then by name."""
    c = F.col
    undocumented = c("used") & ~c("documented") & ~c("test_only") & ~c("name").isin(platform)
    missing = has_local & c("used") & ~c("defined") & ~c("fallback") & ~c("test_only")
    rank = F.when(undocumented, 0).when(~c("documented") & ~c("used"), 1).when(missing, 2).when(~c("used"), 3).otherwise(4)
    return [rank, c("name")]


def order_languages() -> list[Column]:
    return [F.when(F.col("kind") == "style", 1).otherwise(0), F.desc("share"), F.desc("files"), F.col("name")]


def order_services() -> list[Column]:
    from sparkquarry.sources.compose import file_order

    return [*root_first(paths.dir_of(F.coalesce("included_from", "source"))), F.col("name"), file_order(F.col("source"))]


def order_remotes() -> list[Column]:
    return [F.col("name") != "origin", F.col("name")]
