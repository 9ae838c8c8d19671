"""Rounds of joins to a fixed point: what the frontier reaches anew goes on, what was reached before does not."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """``df`` at the end of its lineage: a table in the folder of ``spark.checkpoint.dir``, which driver and executors share. A local session
    without that setting (tests) gets a temporary folder; on a cluster its absence is an error."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = settled.own = getattr(settled, "own", None) or "file://" + tempfile.mkdtemp(prefix="sparkquarry-")
    path = f"{base.rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def closure(start: DataFrame, edges: DataFrame, scope: list[str], *, most_rounds: int = 1000) -> DataFrame:
    """All (scope, node) that ``start`` reaches along ``edges``, with the least number of steps as ``level``.

    ``start``: scope and node; ``edges``: source, target and those of the scope's columns that it has. A row is reached once, so cycles end, and a
    round joins only what the round before added. Ends when nothing is new. The tables' files are small for their rows, so no join goes by the size of a
    file and broadcasts one.
    """
    by = [c for c in scope if c in edges.columns]
    edges = settled(edges.select(*by, F.col("source").alias("node"), "target").where("node <> target").distinct())
    found = frontier = settled(start.select(*scope, "node").distinct().withColumn("level", F.lit(0)))
    for level in range(1, most_rounds + 1):
        reached = frontier.join(edges.hint("merge"), [*by, "node"]).select(*scope, F.col("target").alias("node")).distinct()
        frontier = settled(reached.join(found.hint("merge"), [*scope, "node"], "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found
