"""Results as JSON documents, one a repository, written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The parts of a full document that one about findings has.
FINDINGS_PARTS = ["schemaVersion", "tool", "project", "checks", "diagnostics", "ignored", "summary", "config"]


def documents(parts: dict[str, DataFrame], lists: dict[str, tuple[DataFrame, list[str]]], constants: dict[str, str] | None = None) -> DataFrame:
    """(repo_id, document): JSON with a member for each of ``parts`` (tables of at most one row a repository), each of ``lists`` (a table and the columns that
    order its rows) and each constant. Repositories are those of the parts; a list without rows is empty, a part without one is left out."""
    out = None
    for name, rows in parts.items():
        own = rows.select("repo_id", F.struct(*[c for c in rows.columns if c != "repo_id"]).alias(name))
        out = own if out is None else out.join(own, "repo_id", "full_outer")
    for name, (rows, order) in lists.items():
        item = F.struct(*[c for c in rows.columns if c != "repo_id"])
        own = rows.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct(*order, item.alias("item")))).alias(name))
        out = out.join(own.select("repo_id", F.transform(name, lambda x: x["item"]).alias(name)), "repo_id", "left")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    whole = F.struct(*[F.lit(v).alias(k) for k, v in (constants or {}).items()], *[F.col(c) for c in (*parts, *lists)])
    return out.select("repo_id", F.to_json(whole).alias("document"))


def findings_documents(parts: dict[str, DataFrame], lists: dict[str, tuple[DataFrame, list[str]]], constants: dict[str, str] | None = None) -> DataFrame:
    """The same with only the parts that are about findings."""
    keep = lambda of: {k: v for k, v in (of or {}).items() if k in FINDINGS_PARTS}
    return documents(keep(parts), keep(lists), keep(constants))


def write_documents(found: DataFrame, folder: str) -> None:
    """Writes documents as JSON lines into a new folder; one that is there is an error and stays as it is."""
    found.select("document").write.mode("errorifexists").text(folder)
