"""Mixing sources to target weights, in DataFrame operations only.

A classifier learned from a labelled table gives each document posteriors over domains; the
expected tokens of a domain are the sum of posterior * tokens * rate over all documents. Projected
gradient steps fit nonnegative rates, all 1 at first, so that expected tokens meet the targets in
weighted least squares. With document weights equal to tokens a step is
rate <- max(0, rate - posterior . step), so all that a step needs is one vector over domains: the
driver keeps these vectors, each iteration is one aggregation over a small table, and a lost
executor costs nothing but its tasks. A fit that ends short of its targets, as some can't be met, raises no error:
``mix_residual`` of ``RateFit`` says how far off it is.

Classifier: naive Bayes on the presence of words, and on shares of capitals and of repeated words in steps. Every
word counts whose document frequencies in the domains differ beyond chance (G statistic of at least ``least_g``), that is at
least ``least_lift`` times as frequent in one domain as in any other and stands in ``least_documents`` documents. It is fitted on at
most ``labelled`` rows of each domain (a documented bound, chosen by hash of the id), so the number of its words has a bound as
well; everything else covers all documents.

Null or empty text: no tokens, the posterior follows the words that it lacks, the rate is fitted as
any other. Labels without an id or a domain are left out; of several labels of one id the
first domain in name order counts. Equal rows are rated alike and each for itself. With no labelled document posteriors are
equal shares. An empty table stays empty. Input columns named like an added column are replaced; other names never clash.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table

ADDED = ("mix_tokens", "mix_posterior", "mix_rate", "mix_copies")
#: Rows of a domain among which the labelled ones are chosen are first thinned in this many parts, so that no window meets a whole domain.
PARTS = 64
#: Upper ends of the steps of a share.
STEPS = (0.02, 0.05, 0.1, 0.2, 0.4)


@dataclass
class DomainModel:
    domains: list[str]
    words: list[str]
    weights: list[list[float]]  # by domain: of the words, then the constant


@dataclass
class RateFit:
    """The steps that lead to the rates, and how far the expected tokens are off, as a share of all that is wanted."""

    steps: list[list[float]] = field(default_factory=list)
    mix_residual: float = 0.0


def _words(text: Column) -> Column:
    """Words without case; runs of marks other than sentence marks are words of their own."""
    return F.split(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"([%&$#*|<>=@~^+]+)", " $1 "), r"[\s.,;:!?]+")


def _shaped(docs: DataFrame, name: str, text: Column) -> DataFrame:
    """``docs`` with a struct ``name`` of a text's words, tokens and features: the distinct words, and words with a blank in front
    that say in which step the shares of capitals and of repeated words lie. Each stage reads what is dear from the one before."""
    c = lambda x: F.col(name)[x]
    text = F.coalesce(text.cast("string"), F.lit(""))
    capitals = F.length(F.regexp_replace(text, r"[^A-Z]+", "")) / F.greatest(F.length(text), F.lit(1))
    docs = docs.withColumn(name, F.struct(_words(text).alias("words"), capitals.alias("capitals")))
    blank = F.when(F.get(c("words"), F.lit(0)) == "", 1).otherwise(0) + F.when((F.size(c("words")) > 1) & (F.element_at(c("words"), -1) == ""), 1).otherwise(0)
    docs = docs.withColumn(name, F.struct((F.size(c("words")) - blank).cast("long").alias("tokens"), F.size(c("words")).alias("n"), F.array_distinct(c("words")).alias("words"), c("capitals").alias("capitals")))
    step = lambda share: F.size(F.filter(F.lit(list(STEPS)), lambda x: share > x)).cast("string")
    shape = F.array(F.concat(F.lit(" capitals "), step(c("capitals"))), F.concat(F.lit(" repeated "), step(1 - F.size(c("words")) / c("n"))))
    return docs.withColumn(name, F.struct(c("tokens").alias("tokens"), F.concat(c("words"), shape).alias("features")))


def fit_domains(
    docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], *, labelled: int = 2_000, least_g: float = 10.8,
    least_documents: int = 5, least_lift: float = 2.0, id_col: str = "doc_id", text_col: str = "text",
) -> DomainModel:
    """Learns from ``labels`` (``id_col`` and what ``domain`` reads) and the texts of those documents."""
    n = len(domains)
    known = (
        labels.select(labels[id_col].alias("label_id"), domain.alias("domain")).where(F.col("label_id").isNotNull() & F.col("domain").isin(domains))
        .groupBy("label_id").agg(F.min("domain").alias("domain")).withColumn("turn", F.xxhash64("label_id"))
    )
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("turn", "label_id"))
    thinned = known.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "label_id"), F.lit(PARTS))).withColumn("nth", nth("domain", "part")).where(F.col("nth") <= labelled)
    known = thinned.withColumn("nth", nth("domain")).where(F.col("nth") <= labelled).select("label_id", "domain")
    # at most ``labelled`` rows a domain, so a broadcast has a bound
    own = docs.select(docs[id_col].alias("own_id"), docs[text_col].cast("string").alias("own_text"))
    sample = _shaped(own.join(F.broadcast(known), F.col("own_id") == F.col("label_id")).select("domain", "own_text"), "own", F.col("own_text"))
    sample = shared_table(sample.select("domain", F.col("own")["features"].alias("words")), "labelled")
    totals = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return DomainModel(domains, [], [[0.0] for _ in domains])
    all_ = sum(totals.values())
    found = [F.coalesce(F.sum(F.when(F.col("domain") == d, 1)), F.lit(0)) for d in domains]
    counted = sample.select("domain", F.explode("words").alias("word")).where("word <> ''").groupBy("word")
    shares = counted.agg(F.count("*").alias("n"), *[c.alias(f"c{i}") for i, c in enumerate(found)]).where(F.col("n") >= least_documents)
    shares = shares.select("word", "n", "*", *[((F.col(f"c{i}") + 0.5) / (totals.get(d, 0) + 1.0)).alias(f"p{i}") for i, d in enumerate(domains)])
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    g = F.lit(0.0)
    for i, d in enumerate(domains):
        size = float(totals.get(d, 0))
        if size:
            g = g + part(F.col(f"c{i}"), F.col("n") * size / all_) + part(size - F.col(f"c{i}"), (all_ - F.col("n")) * size / all_)
    ranked = F.sort_array(F.array(*[F.col(f"p{i}") for i in range(n)]), asc=False)
    telling = 2 * g >= least_g
    if n > 1:  # a word must point to one domain, so that languages or topics of the sample don't decide
        telling = telling & (ranked[0] >= least_lift * ranked[1])
    # the words of at most ``labelled`` documents a domain, each in several of them: a bounded number
    best = shares.where(telling | F.col("word").startswith(" ")).select("word", *[f"p{i}" for i in range(n)]).orderBy("word").collect()
    weights = []
    for i, d in enumerate(domains):
        p = [min(max(r[f"p{i}"], 1e-6), 1 - 1e-6) for r in best]
        prior = math.log((totals.get(d, 0) + 1) / (all_ + n))
        # the steps of a share are one feature: only the one that holds counts
        own = [math.log(x) - (0.0 if r["word"].startswith(" ") else math.log(1 - x)) for r, x in zip(best, p, strict=True)]
        weights.append(own + [prior + sum(math.log(1 - x) for r, x in zip(best, p, strict=True) if not r["word"].startswith(" "))])
    return DomainModel(domains, [r["word"] for r in best], weights)


def _posteriors(docs: DataFrame, name: str, text: Column, model: DomainModel) -> DataFrame:
    """``docs`` with a struct ``name`` of a text's tokens and its array ``p`` of posteriors."""
    n, c = len(model.domains), lambda x: F.col(name)[x]
    # whole tables of the model as one literal each
    vocabulary = F.from_json(F.lit(json.dumps(model.words)), "array<string>")
    weights = F.from_json(F.lit(json.dumps([list(map(float, w)) for w in zip(*model.weights, strict=True)])), "array<array<double>>")
    docs = _shaped(docs, name, text)
    docs = docs.withColumn(name, F.struct(c("tokens").alias("tokens"), F.array_intersect(c("features"), vocabulary).alias("found")))
    docs = docs.withColumn(name, F.struct(c("tokens").alias("tokens"), F.transform(c("found"), lambda w: F.array_position(vocabulary, w).cast("int")).alias("places")))
    logs = F.aggregate(c("places"), F.element_at(weights, -1), lambda total, k: F.zip_with(total, F.get(weights, k - 1), lambda x, y: x + y))
    docs = docs.withColumn(name, F.struct(c("tokens").alias("tokens"), logs.alias("logs")))
    docs = docs.withColumn(name, F.struct(c("tokens").alias("tokens"), F.transform(c("logs"), lambda x: F.exp(x - F.array_max(c("logs")))).alias("odds")))
    total = sum((F.get(c("odds"), F.lit(i)) for i in range(n)), F.lit(0.0))
    return docs.withColumn(name, F.struct(c("tokens").alias("tokens"), F.transform(c("odds"), lambda x: x / total).alias("p")))


def _rate(steps: list[list[float]], n: int, most: float | None = None, p=lambda i: F.col(f"p{i}")) -> Column:
    """The rate after these steps, each projected to 0 at least and ``most``."""
    if not steps:
        return F.lit(1.0)
    dot = lambda v: sum((p(i) * F.get(v, F.lit(i)) for i in range(n)), F.lit(0.0))
    upper = (lambda r: r) if most is None else (lambda r: F.least(F.lit(float(most)), r))
    whole = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")
    return F.aggregate(whole, F.lit(1.0), lambda r, v: upper(F.greatest(F.lit(0.0), r - dot(v))))


def fit_rates(features: DataFrame, targets: list[float], *, iterations: int = 20, tolerance: float = 1e-4, most: float | None = None) -> RateFit:
    """The steps to the rates; ``targets``: expected tokens of each domain. Ends when the targets are met within ``tolerance``
    of their sum, or when a step no longer comes nearer (rates at a bound)."""
    n = len(targets)
    sums = lambda **of: [F.coalesce(F.sum(v), F.lit(0.0)).alias(k) for k, v in of.items()]
    p, tokens = [F.col(f"p{i}") for i in range(n)], F.col("tokens")
    first = features.agg(*sums(**{f"h{i}_{j}": tokens * p[i] * p[j] for i in range(n) for j in range(n)})).first()
    if not any(first[f"h{i}_{i}"] for i in range(n)):
        return RateFit()  # no tokens, nothing to fit
    scale = [max(first[f"h{i}_{i}"], 1e-9) for i in range(n)]
    # rows of |H| / scale bound the largest eigenvalue, so the step is short enough
    step = 1 / max(sum(abs(first[f"h{i}_{j}"]) / scale[i] for j in range(n)) for i in range(n))
    fit, wanted, before = RateFit(), max(1.0, sum(targets)), math.inf
    for _ in range(iterations):
        # the rate is computed once a row: two selects, as an optimiser does not repeat what is dear
        rated = features.select("tokens", *p, _rate(fit.steps, n, most).alias("rate"))
        got = rated.agg(*sums(**{f"s{i}": tokens * p[i] * F.col("rate") for i in range(n)})).first()
        off = [got[f"s{i}"] - targets[i] for i in range(n)]
        worth = sum(x * x / s for x, s in zip(off, scale, strict=True))
        fit.mix_residual = max(abs(x) for x in off) / wanted
        if fit.mix_residual <= tolerance or worth >= 0.998 * before:
            break
        before = worth
        fit.steps.append([step * x / s for x, s in zip(off, scale, strict=True)])
    return fit


def mix(
    docs: DataFrame, model: DomainModel, weights: dict[str, float] | None = None, *, budget: float | None = None, factors: dict[str, float] | None = None,
    most_rate: float | None = None, iterations: int = 20, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` with tokens, posteriors (by domain), rate and copies (the rate, rounded by a hash of the id).

    Targets: ``weights``, shares of ``budget`` tokens (as many as there are, if not given), or ``factors`` of what each domain has now.
    With ``most_rate`` the fit keeps every rate at or under it. Rows are written with their posteriors and read again: no text is
    shuffled or judged twice.
    """
    n = len(model.domains)
    name = "mix"  # that no column has
    while name in docs.columns:
        name += "_"
    text = docs[text_col].cast("string")
    chance = F.pmod(F.xxhash64(docs[id_col], F.xxhash64(text), F.lit(3)), F.lit(1_000_003)) / 1_000_003.0
    rows = docs.select(*[docs[c] for c in docs.columns if c not in ADDED], text.alias(f"{name}_text"), chance.alias(f"{name}_chance"))
    rows = shared_table(_posteriors(rows, name, F.col(f"{name}_text"), model).drop(f"{name}_text"), "mix-rows")
    own = F.col(name)
    features = rows.select(own["tokens"].alias("tokens"), *[F.get(own["p"], F.lit(i)).alias(f"p{i}") for i in range(n)])
    now = features.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col(f"p{i}")), F.lit(0.0)).alias(f"s{i}") for i in range(n)]).first()
    if factors is not None:
        targets = [factors[d] * now[f"s{i}"] for i, d in enumerate(model.domains)]
    else:
        whole = sum(now[f"s{i}"] for i in range(n)) if budget is None else budget
        targets = [(weights or {}).get(d, 0.0) / max(sum((weights or {}).values()), 1e-12) * whole for d in model.domains]
    fit = fit_rates(features, targets, iterations=iterations, most=most_rate)
    rate = _rate(fit.steps, n, most_rate, lambda i: F.get(own["p"], F.lit(i)))
    rows = rows.withColumn(name, F.struct(own["tokens"].alias("mix_tokens"), own["p"].alias("mix_posterior"), rate.alias("mix_rate")))
    copies = F.floor(own["mix_rate"] + F.col(f"{name}_chance")).cast("long")
    return rows.select(*[c for c in docs.columns if c not in ADDED], *[own[c].alias(c) for c in ADDED[:3]], copies.alias("mix_copies"))
