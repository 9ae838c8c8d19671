"""Graphs of source files: relative imports and what they mount, and catalogs of versions that manifests point to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.functions import paths
from sparkquarry.operators.fixpoint import closure

#: TypeScript endings that a JavaScript ending may stand for, and endings that may be left out, in the order of trial.
STANDS_FOR = {".js": [".ts", ".tsx"], ".jsx": [".tsx"], ".mjs": [".mts"], ".cjs": [".cts"]}
ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts"]


#: What is tried for a specifier, in order: the ending that goes, and what comes in its place.
TRIALS = [("", ""), *((e, t) for e, to in STANDS_FOR.items() for t in to), *(("", e) for e in ENDINGS), *(("", f"/index{e}") for e in ENDINGS)]


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (repo_id, path, specifier) with the ``target`` among ``files`` (repo_id, path); null if none fits.

    Tried in this order: the file itself, its TypeScript source, an ending added, an index file of the directory. A specifier that leaves the root or
    names it finds nothing. Not the trials of an import are looked up, some twenty, but each file says under which few names it is found, and the first
    trial of a name is all that joins.
    """
    path = F.col("path")
    cut = lambda c, n: F.substr(c, F.lit(1), F.length(c) - n)
    names = [F.when(path.endswith(new), F.struct(F.concat(cut(path, F.lit(len(new))), F.lit(old)).alias("base"), F.lit(n).alias("turn"))) for n, (old, new) in enumerate(TRIALS)]
    found = files.select("repo_id", F.explode(F.array_compact(F.array(*names))).alias("f")).groupBy("repo_id", "f.base").agg(F.min("f.turn").alias("turn"))
    base = paths.let(paths.join_path(paths.dir_of(path), F.col("specifier")), lambda b: F.when(b != ".", b))
    joined = imports.withColumn("base", base).join(found.hint("merge"), ["repo_id", "base"], "left")
    of = lambda values: F.get(F.lit(values), F.col("turn"))
    target = F.concat(cut(F.col("base"), of([len(old) for old, _ in TRIALS])), of([new for _, new in TRIALS]))
    return joined.select(*imports.columns, target.alias("target"))


def mounted_files(users: DataFrame, mounts: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files in scope, mounts between them): the files that import a framework (repo_id, path) and all that they mount, over any number of files.

    ``mounts``: (repo_id, path, specifier) of every file that mounts another; ``files``: those that could be mounted. Files in scope have the least
    number of mounts that lead to them (``level``); a mount whose file is not found is left out.
    """
    edges = resolve_imports(mounts, files).where("target IS NOT NULL")
    found = closure(users.select("repo_id", F.col("path").alias("node")), edges.withColumnRenamed("path", "source"), ["repo_id"]).withColumnRenamed("node", "path")
    return found, edges.join(found.select("repo_id", "path"), ["repo_id", "path"], "left_semi")


def resolve_catalogs(refs: DataFrame, catalogs: DataFrame) -> DataFrame:
    """``refs`` (repo_id, name, range and more) with ranges ``catalog:`` and ``catalog:NAME`` replaced by the catalog's entry; the others, and those
    that no catalog has, stay. ``catalogs``: (repo_id, catalog, name, range), the plain one named default."""
    wanted = F.when(F.col("range").startswith("catalog:"), F.trim(F.substr("range", F.lit(9))))
    wanted = F.when(wanted == "", "default").otherwise(wanted)
    entry = catalogs.where("range <> ''").groupBy("repo_id", "catalog", "name").agg(F.min("range").alias("entry"))
    joined = refs.withColumn("catalog", wanted).join(entry, ["repo_id", "catalog", "name"], "left")
    return joined.select(*[F.coalesce("entry", "range").alias("range") if c == "range" else F.col(c) for c in refs.columns])
