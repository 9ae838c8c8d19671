"""Evidence: merging signals into findings, keeping the best of duplicates, ranking, carrying forward.

Orders are carried by explicit ordinals, never by the order in which rows happen to arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONFIDENCE = ["low", "medium", "high"]
SEVERITY = ["error", "warning", "info"]


def rank_of(value: Column, order: list[str]) -> Column:
    """Position of a value in ``order``, from 0; null if it isn't there."""
    return F.coalesce(*[F.when(value == v, F.lit(i)) for i, v in enumerate(order)])


def root_first(directory: Column) -> list[Column]:
    return [directory != ".", directory]


def merge_signals(signals: DataFrame, keys: list[str], *, most: int = 6) -> DataFrame:
    """One finding a key from (package, confidence, evidence, config_file, version, ord).

    Packages: distinct, the top first. Confidence: the strongest. Version: of the strongest signal that
    has one. Evidence: distinct, strongest first, at most ``most`` with the number of the others.
    """
    rank = F.col("__rank")
    s = signals.withColumn("__rank", rank_of(F.col("confidence"), CONFIDENCE))
    each = s.groupBy(*keys, "evidence").agg(F.min(F.struct((-rank).alias("less"), "ord")).alias("first"))
    listed = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "evidence"))), lambda x: x["evidence"]).alias("all"))
    more = F.concat(F.lit("and "), (F.size("all") - most + 1).cast("string"), F.lit(" more"))
    listed = listed.select(*keys, F.when(F.size("all") > most, F.concat(F.slice("all", 1, most - 1), F.array(more))).otherwise(F.col("all")).alias("evidence"))
    found = s.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_set(F.struct((F.col("package") != ".").alias("below"), "package"))), lambda x: x["package"]).alias("packages"),
        F.max("__rank").alias("__best"),
        F.min(F.when(F.col("version").isNotNull(), F.struct((-rank).alias("less"), "ord", "version")))["version"].alias("version"),
        F.array_sort(F.collect_set("config_file")).alias("config_files"),
    )
    return found.withColumn("confidence", F.get(F.lit(CONFIDENCE), F.col("__best"))).drop("__best").join(listed, keys)


def union_findings(findings: list[DataFrame], keys: list[str], *, most: int = 10) -> DataFrame:
    """Findings (source, confidence, evidence, ord) of several origins as one row a key."""
    both = findings[0]
    for f in findings[1:]:
        both = both.unionByName(f)
    rank = rank_of(F.col("confidence"), CONFIDENCE)
    each = both.groupBy(*keys, "evidence").agg(F.min(F.struct((-rank).alias("less"), "ord")).alias("first"), F.collect_set("source").alias("sources"))
    return each.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        F.get(F.lit(CONFIDENCE), -F.min("first.less")).alias("confidence"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("first", "evidence"))), lambda x: x["evidence"]), 1, most).alias("evidence"),
    )


def dedup_keep_best(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in this order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key with their rank; Spark limits each partition before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def priority_coalesce(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Of each key the first value that is not null, in the order of these columns."""
    best = F.min(F.when(F.col(value).isNotNull(), F.struct(*order, value)))
    return rows.groupBy(*keys).agg(best[value].alias(value))


def carry_forward(rows: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """The last value that is not null, up to each row."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def finalise_routes(routes: DataFrame, *, most: int = 2000, keys: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """Of equal routes on one line the most confident; sure ones once in all; at most ``most`` a repository."""
    route = [*keys, "package", "kind", "path", "method", "file", "framework"]
    strong = rank_of(F.col("confidence"), CONFIDENCE)
    by_line = dedup_keep_best(routes, [*route, "line"], [strong.desc()])
    first = Window.partitionBy(*route, F.col("confidence") == "high").orderBy(F.asc_nulls_first("line"))
    kept = by_line.withColumn("__n", F.row_number().over(first)).where((F.col("confidence") != "high") | (F.col("__n") == 1)).drop("__n")
    place = Window.partitionBy(*keys).orderBy(*[c for c in route if c not in keys], F.asc_nulls_first("line"), strong)
    return kept.withColumn("__n", F.row_number().over(place)).where(F.col("__n") <= most).drop("__n")
