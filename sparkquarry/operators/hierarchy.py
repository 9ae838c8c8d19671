"""Joins over a path hierarchy: the deepest declared directory that holds a path.

Only distinct directories are exploded into their ancestors (a handful of rows each), so files move
once, on (repo, dir); the owner of a directory is then found by an equality join and a max.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.functions import paths


def owner_join(files: DataFrame, owners: DataFrame, *, path: str = "path", owner_dir: str = "dir", keys: tuple[str, ...] = ("repo_id",), default: str | None = ".", order: Column | None = None) -> DataFrame:
    """``files`` with ``owner``: the deepest ``owner_dir`` above each path, else ``default`` (None: null).

    ``order``: ranks owners of one directory, least first; else the columns of ``owners`` are not carried.
    """
    own = files.withColumn("__dir", paths.dir_of(F.col(path)))
    dirs = own.select(*keys, "__dir").distinct()
    up = dirs.select(*keys, "__dir", F.explode(paths.ancestors(F.col("__dir"))).alias("__a")).select(*keys, "__dir", F.col("__a.dir").alias("__at"), F.col("__a.depth").alias("__depth"))
    declared = owners.select(*keys, F.col(owner_dir).alias("__at"), (order if order is not None else F.lit(0)).alias("__rank")).groupBy(*keys, "__at").agg(F.min("__rank").alias("__rank"))
    found = up.join(declared, [*keys, "__at"]).groupBy(*keys, "__dir").agg(F.max_by("__at", F.struct("__depth", -F.col("__rank"))).alias("owner"))
    out = own.join(found, [*keys, "__dir"], "left").drop("__dir")
    return out if default is None else out.withColumn("owner", F.coalesce("owner", F.lit(default)))


def pin_scopes(pins: DataFrame, version_files: list[str], *, keys: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """Pins with the scope that they must agree in: the deepest directory with a version file, else the top."""
    scopes = pins.where(paths.base_name(F.col("path")).isin(version_files)).select(*keys, paths.dir_of(F.col("path")).alias("dir")).distinct()
    return owner_join(pins, scopes, keys=keys).withColumnRenamed("owner", "scope")


def nearest_env_file(uses: DataFrame, env_files: DataFrame, preferred: list[str], *, keys: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """The env file for each use: deepest directory above it, then preferred names, then path."""
    rank = F.coalesce(*[F.when(paths.base_name(F.col("path")) == n, F.lit(i)) for i, n in enumerate(preferred)], F.lit(len(preferred)))
    best = env_files.groupBy(*keys, paths.dir_of(F.col("path")).alias("dir")).agg(F.min(F.struct(rank.alias("rank"), "path"))["path"].alias("env_file"))
    owned = owner_join(uses, best, keys=keys, default=None)
    return owned.join(best.withColumnRenamed("dir", "owner"), [*keys, "owner"], "left")
