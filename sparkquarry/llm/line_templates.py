"""Line dedup with a log-template tree, in DataFrame operations only.

Every line is masked (A-Z lowered, a run of characters from a digit to the next space becomes <*>) and falls
into a leaf of a tree of fixed depth: its token count, then its leading tokens. Lines of a leaf share
a template: the masked line itself, or, where the leaf holds several, its most frequent token at each
position that has one with at least ``constant_share`` of the leaf's lines, and <*> elsewhere; lines belong to it that agree in ``similarity`` of the tokens behind the leading ones. Lines of fewer than
twice the leading tokens are not generalised, as little would hold their template together.

A template recurs across documents if one of two counts says so; documents are counted by kind, not one by one, so that
lines that recur only because whole documents are copied, exactly or nearly, stay.

- It stands between at least ``least_contexts`` different neighbours (previous and next line), and these are at least
  ``least_share`` of its lines.
- It stands in at least ``least_contexts`` kinds of documents, and these are at least ``kind_share`` of the different texts that
  hold it. A text of whose lines more than ``own_share`` are its own, standing in fewer than ``least_contexts`` texts, is a kind for
  itself: two such texts share under 0.8 of their lines (1/9 of own lines each). The others are copies of each other to that degree, and their kind is the least
  hash of their lines, which most copies share. So blocks go that many documents share, long or short beside their own lines, and lines that only copies share stay.

Lines of recurring templates are dropped; documents are never dropped. Lines under ``least_tokens`` tokens recur by chance in running
text: they go only if they stand in ``short_share`` of all different texts as well. A template in fewer than ``least_contexts`` documents never goes.

Null text stays null; empty lines stay. Rows that are equal
in id and text lose the same lines. All input columns are kept; added columns replace input columns
of the same name. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded, shared_table

ADDED = ("n_lines", "n_dropped")


def _masked(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[0-9]\S*", "<*>")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].alias("line_doc"), F.xxhash64(text).alias("line_text"), text.alias("text")).where(text.isNotNull())


def _lines(docs: DataFrame, id_col: str, text_col: str, depth: int, *more: str, only: DataFrame | None = None) -> DataFrame:
    """Hashes of each line: leaf, template, context (previous and next line); ``more``: "masked" too, if asked for; ``only``: texts to take (line_text)."""
    keyed = _keyed(docs, id_col, text_col)
    if only is not None:
        keyed = keyed.join(only, "line_text", "left_semi")
    line = F.col("line")["masked"]
    tokens = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    return (
        keyed.withColumn("masked", F.split(_masked(F.col("text")), "\n"))
        .withColumn("hashes", F.transform("masked", lambda x: F.xxhash64(x)))
        .select(
            "line_doc", "line_text",
            F.posexplode(F.transform("masked", lambda x, i: F.struct(
                x.alias("masked"), F.get("hashes", i - 1).alias("before"), F.get("hashes", i).alias("template"), F.get("hashes", i + 1).alias("after"),
            ))).alias("pos", "line"), F.array_min("hashes").alias("kind"), F.size(F.filter("masked", lambda x: F.trim(x) != "")).alias("of"),
        )
        .select(
            "line_doc", "line_text", "pos", "kind", "of", F.when(F.trim(line) == "", 0).otherwise(tokens).alias("tokens"),
            F.xxhash64(tokens, F.substring_index(line, " ", depth)).alias("leaf"), F.col("line")["template"].alias("template"),
            F.xxhash64(F.col("line")["before"], F.col("line")["after"]).alias("context"), line.alias("masked"),
        )
        .select("line_doc", "line_text", "pos", "kind", "of", "tokens", "leaf", "template", "context", *more)
    )


def recurring(lines: DataFrame, key: str, least_contexts: int, least_share: float, kind_share: float) -> DataFrame:
    """Keys that recur, with their least and greatest template; partial counts first, so no key is hot."""
    ends = [F.min("low").alias("low"), F.max("high").alias("high")]
    own = [F.min("template").alias("low"), F.max("template").alias("high")]
    by_context = (
        lines.groupBy(key, "context").agg(F.count("*").alias("n"), *own).groupBy(key).agg(F.count("*").alias("kinds"), F.sum("n").alias("of"), *ends)
        .where((F.col("kinds") >= least_contexts) & (F.col("kinds") >= least_share * F.col("of")))
    )
    by_kind = (
        lines.groupBy(key, "kind", "line_text").agg(*own).groupBy(key, "kind").agg(F.count("*").alias("n"), *ends)
        .groupBy(key).agg(F.count("*").alias("kinds"), F.sum("n").alias("of"), *ends)
        .where((F.col("kinds") >= least_contexts) & (F.col("kinds") >= kind_share * F.col("of")))
    )
    return by_context.unionByName(by_kind).groupBy(key).agg(*ends)


def _own_kinds(lines: DataFrame, least_contexts: int, own_share: float) -> DataFrame:
    """The lines of templates in at least ``least_contexts`` different texts, with the text as the kind where it has enough lines of its own."""
    often = lines.groupBy("template", "line_text").agg(F.lit(1)).groupBy("template").agg(F.count("*").alias("texts")).where(F.col("texts") >= least_contexts)
    held = shared_table(lines.join(bounded(shared_table(often, "often")), "template", "left_semi"), "often-lines")
    # exact copies count as one text, so a group of them is no hot key
    common = held.groupBy("line_text", "pos").agg(F.max("of").alias("of")).groupBy("line_text").agg(F.count("*").alias("common"), F.max("of").alias("of"))
    own = shared_table(common.where(F.col("of") - F.col("common") > own_share * F.col("of")).select("line_text", F.lit(True).alias("own")), "own-texts")
    found = held.join(bounded(own), "line_text", "left")
    return found.withColumn("kind", F.when(F.col("own"), F.col("line_text")).otherwise(F.col("kind")))


def dropped_lines(
    docs: DataFrame, *, least_contexts: int = 10, least_share: float = 0.3, kind_share: float = 0.4, own_share: float = 1 / 9, least_tokens: int = 3,
    short_share: float = 0.1, depth: int = 3, constant_share: float = 0.5, similarity: float = 0.6, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(line_doc, line_text, pos) of the lines to drop; line_text is the hash of the text."""
    lines = shared_table(_lines(docs, id_col, text_col, depth).where("tokens > 0"), "lines")
    held = _own_kinds(lines, least_contexts, own_share)
    found = recurring(held.where(F.col("tokens") >= least_tokens), "template", least_contexts, least_share, kind_share).select("template")
    texts = _keyed(docs, id_col, text_col).select("line_text").distinct().count()
    short = held.where(F.col("tokens") < least_tokens).groupBy("template", "kind").agg(F.lit(1)).groupBy("template").agg(F.count("*").alias("kinds"))
    short = short.where((F.col("kinds") >= least_contexts) & (F.col("kinds") >= short_share * texts)).select("template")
    exact = bounded(shared_table(found.unionByName(short), "templates"))
    first = lines.join(exact, "template", "left_semi").select("line_doc", "line_text", "pos")

    # leaves of several templates that recur only together; their lines are read again where the texts are
    several = (F.col("tokens") >= 2 * depth) & (F.col("tokens") >= least_tokens)
    rest = lines.where(several).join(exact, "template", "left_anti")
    leaves = shared_table(recurring(rest, "leaf", least_contexts, least_share, kind_share).where("low < high").select("leaf"), "leaves")
    if leaves.isEmpty():
        return first
    # few texts are read again; where they are too many to be broadcast, all are, as texts should not be shuffled for that
    again = shared_table(rest.join(bounded(leaves), "leaf", "left_semi").select("line_text").distinct(), "leaf-texts")
    again = F.broadcast(again) if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else None
    wanted = _lines(docs, id_col, text_col, depth, "masked", only=again).where(several).join(bounded(leaves), "leaf", "left_semi").join(exact, "template", "left_anti")
    wanted = shared_table(wanted.select("line_doc", "line_text", "pos", "kind", "leaf", "template", "context", F.split("masked", " ").alias("words")), "leaf-lines")
    constants = (
        wanted.select("leaf", F.posexplode("words").alias("at", "token"))
        .groupBy("leaf", "at", "token").agg(F.count("*").alias("n"))
        .groupBy("leaf", "at").agg(F.sum("n").alias("all"), F.min(F.struct((-F.col("n")).alias("less"), "token")).alias("best"))
        .where(-F.col("best.less") >= constant_share * F.col("all"))
        .groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("at", "best.token"))).alias("constants"))
    )
    places = F.sequence(F.lit(depth), F.size("words") - 1)
    agreeing = F.size(F.filter(places, lambda i: F.try_element_at("constants", i).eqNullSafe(F.get("words", i))))
    matched = (
        wanted.join(bounded(shared_table(constants, "leaf-constants"), BROADCAST_ROWS // 10), "leaf")
        .where(agreeing >= similarity * F.size(places)).select("line_doc", "line_text", "pos", "kind", "leaf", "template", "context")
    )
    general = bounded(shared_table(recurring(matched, "leaf", least_contexts, least_share, kind_share).select("leaf"), "general-leaves"))
    second = matched.join(general, "leaf", "left_semi").select("line_doc", "line_text", "pos")
    return first.unionByName(second)


def drop_recurring_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the lines of recurring templates, with n_lines and n_dropped."""
    found = (
        dropped_lines(docs, id_col=id_col, text_col=text_col, **options)
        .groupBy("line_doc", "line_text").agg(F.collect_set("pos").alias("line_gone"))
    )
    text = docs[text_col].cast("string")
    joined = docs.join(found, docs[id_col].eqNullSafe(found["line_doc"]) & (F.xxhash64(text) == found["line_text"]), "left")
    gone = found["line_gone"]
    kept = F.when(gone.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n"))
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    return joined.select(
        *[kept.alias(c) if c == text_col else docs[c] for c in docs.columns if c not in ADDED],
        n_lines.alias("n_lines"), F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
    )
