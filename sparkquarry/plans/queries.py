"""Driver queries of the library's own operators, each with DuckDB SQL for the same rows.

The tables hold no repositories, so facts are derived from their columns by the same arithmetic on
both sides: pages give paths and URLs, documents texts, events pins, bindings, variables and signals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkquarry.functions import globs, paths, text, versions
from sparkquarry.operators import evidence, hierarchy, rules
from sparkquarry.operators.fixpoint import settled

PAGE_PATH = r"^[a-z]+://[^/?#]+/([^?#]*)"
NOW = "2026-09-01"
LICENSE_LINE = "Released under the ([A-Za-z0-9. -]+) License"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and path (host first, as a directory) of each page."""
    path = F.concat(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1), F.lit("/"), F.regexp_replace(F.regexp_extract("url", PAGE_PATH, 1), "/$", ""))
    return _read(spark, sf_dir, "pages").select("page_id", path.alias("path"))


_PAGES = rf"(SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) || '/' || regexp_replace(regexp_extract(url, '{PAGE_PATH}', 1), '/$', '') AS path FROM pages)"


@_query("""SELECT lang AS name, CAST(count(*) AS BIGINT) AS files, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 3) AS share FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
def lang_share(spark, sf_dir):
    counts = _read(spark, sf_dir, "documents").where("lang IS NOT NULL").groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("files"))
    return counts.withColumn("share", F.round(F.col("files") / F.sum("files").over(Window.partitionBy()), 3))


@_query("""
    WITH c AS (SELECT lang, source, count(*) FILTER (doc_id % 3 <> 0) AS own, count(*) AS every FROM documents WHERE lang IS NOT NULL GROUP BY ALL)
    SELECT lang, source, CAST(files AS BIGINT) AS files FROM (SELECT *, CASE WHEN sum(own) OVER (PARTITION BY lang) > 0 THEN own ELSE every END AS files FROM c) WHERE files > 0""")
def lang_share_own_or_all(spark, sf_dir):
    c = _read(spark, sf_dir, "documents").where("lang IS NOT NULL").groupBy("lang", "source").agg(F.count_if(F.col("doc_id") % 3 != 0).alias("own"), F.count("*").alias("every"))
    files = F.when(F.sum("own").over(Window.partitionBy("lang")) > 0, F.col("own")).otherwise(F.col("every"))
    return c.select("lang", "source", files.alias("files")).where("files > 0")


@_query(f"""SELECT split_part(path, '/', 2) AS dir, CAST(count(*) AS BIGINT) AS files FROM {_PAGES} GROUP BY 1 ORDER BY files DESC, dir LIMIT 15""")
def dir_summary_top15(spark, sf_dir):
    top = _pages(spark, sf_dir).groupBy(F.coalesce(F.get(paths.segments(F.col("path")), F.lit(1)), F.lit("")).alias("dir")).agg(F.count("*").alias("files"))
    return top.orderBy(F.desc("files"), "dir").limit(15)


@_query("""
    SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host,
        regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([a-z]+://)[^/@]*@', '\\1') AS shown FROM pages""")
def url_parts(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1).alias("host"),
        F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^([a-z]+://)[^/@]*@", "$1").alias("shown"),
    )


@_query(f"""
    SELECT page_id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir, regexp_extract(path, '([^/]*)$', 1) AS name,
        CAST(length(path) - length(replace(path, '/', '')) AS INTEGER) AS depth, regexp_matches(path, '(^|/)(docs|doc|test|tests|en)/') AS under FROM {_PAGES}""")
def path_ext_depth(spark, sf_dir):
    p = F.col("path")
    under = F.exists(paths.dir_segments(p), lambda s: s.isin("docs", "doc", "test", "tests", "en"))
    return _pages(spark, sf_dir).select("page_id", paths.dir_of(p).alias("dir"), paths.base_name(p).alias("name"), paths.depth_of(p).alias("depth"), under.alias("under"))


GLOBS = ["*/en/**", "**/{fr,de}/?5*", "blog.*/*", "m.*.{com,net}/**/1*"]


@_query(f"""SELECT page_id, {", ".join(f"regexp_matches(path, '{globs.glob_regex(g)}') AS g{i}" for i, g in enumerate(GLOBS))} FROM {_PAGES}""")
def glob_match(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", *[globs.match_glob(F.col("path"), g).alias(f"g{i}") for i, g in enumerate(GLOBS)])


@_query(f"""SELECT page_id, path LIKE 'blog.%/en/%5' AS hit FROM {_PAGES}""")
def wildcard_match(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", globs.match_wildcard(F.col("path"), "blog.*/en/*5").alias("hit"))


@_query(f"""
    SELECT page_id, CASE WHEN path LIKE '%/en/7%' AND NOT regexp_matches(path, '/en/7.*/') THEN true WHEN regexp_matches(path, '^[^/]*/en/[^/]*$') THEN false
        ELSE contains(path, '/') END AS kept FROM {_PAGES}""")
def pattern_list_last_wins(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", globs.match_patterns(F.col("path"), ["*/**", "!*/en/*", "**/en/7*"]).alias("kept"))


@_query(f"""
    WITH p AS (SELECT page_id, path, regexp_replace(path, '/[^/]*$', '') AS d FROM {_PAGES}),
    owners AS (SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN d ELSE split_part(d, '/', 1) END AS dir FROM p WHERE page_id % 3 = 0)
    SELECT page_id, coalesce((SELECT max_by(dir, length(dir)) FROM owners o WHERE p.d = o.dir OR starts_with(p.d, o.dir || '/')), '.') AS owner FROM p""")
def owner_deepest_ancestor(spark, sf_dir):
    pages = _pages(spark, sf_dir).withColumn("repo_id", F.lit(0))
    d = paths.dir_of(F.col("path"))
    declared = pages.where("page_id % 3 = 0").select("repo_id", F.when(F.col("page_id") % 2 == 0, d).otherwise(F.get(paths.segments(d), F.lit(0))).alias("dir")).distinct()
    return hierarchy.owner_join(pages, declared).select("page_id", "owner")


@_query(f"""
    SELECT doc_id, CAST(len(regexp_extract_all(text, '{text.SECRET_ASSIGNMENT}')) AS INTEGER) AS secrets,
        CASE {" ".join(f"WHEN regexp_matches(text, '{p}') THEN '{i}'" for i, p in text.CREDENTIALS)} END AS credential
    FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '{text.SECRET_ASSIGNMENT}')""")
def secret_scan(spark, sf_dir):
    t = F.col("text")
    found = F.size(F.regexp_extract_all(t, F.lit(text.SECRET_ASSIGNMENT), 0))
    return _read(spark, sf_dir, "documents").where(t.rlike(text.SECRET_ASSIGNMENT)).select("doc_id", found.alias("secrets"), text.credential_pattern(t).alias("credential"))


@_query(f"""SELECT doc_id, md5(regexp_replace(text, '{text.SECRET_ASSIGNMENT}', '\\1\\2"***"', 'g')) AS digest FROM documents WHERE text IS NOT NULL""")
def redact_assignments(spark, sf_dir):
    return _read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(text.redact_assignments(F.col("text")).cast("binary")).alias("digest"))


@_query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{61c}\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2069}\x{feff}\x{fff9}-\x{fffb}\x{e0000}-\x{e007f}]', '', 'g'), '[\t\n\r\x{2028}\x{2029}]+', ' ', 'g'))) AS digest FROM documents WHERE text IS NOT NULL""")
def clean_text(spark, sf_dir):
    return _read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(text.clean_untrusted(F.col("text"), one_line=True).cast("binary")).alias("digest"))


@_query(f"""SELECT regexp_extract(text, '{LICENSE_LINE}', 1) AS license, CAST(count(*) AS BIGINT) AS docs FROM documents WHERE regexp_matches(text, '{LICENSE_LINE}') GROUP BY 1""")
def license_mentions(spark, sf_dir):
    return _read(spark, sf_dir, "documents").where(F.col("text").rlike(LICENSE_LINE)).groupBy(F.regexp_extract("text", LICENSE_LINE, 1).alias("license")).agg(F.count("*").alias("docs"))


@_query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1""")
def dedup_keep_best(spark, sf_dir):
    return evidence.dedup_keep_best(_read(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("value"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@_query("""SELECT user_id, event_id, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5""")
def top_k_per_group(spark, sf_dir):
    return evidence.top_k(_read(spark, sf_dir, "events"), ["user_id"], [F.desc("value"), F.col("event_id")], 5).select("user_id", "event_id", "value", "rank")


@_query("""
    SELECT user_id, arg_min(value, (CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END)::BIGINT * 1000000000 + event_id) AS value
    FROM events WHERE value > 5 GROUP BY user_id""")
def priority_coalesce(spark, sf_dir):
    e = _read(spark, sf_dir, "events").withColumns({"value": F.when(F.col("value") > 5, F.col("value")), "priority": F.coalesce(evidence.rank_of(F.col("event_type"), ["purchase", "signup", "click", "view"]), F.lit(4))})
    return evidence.priority_coalesce(e, ["user_id"], "value", ["priority", "event_id"]).where("value IS NOT NULL")


@_query("""
    SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user FROM conversations""")
def carry_forward(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return evidence.carry_forward(c, ["conv_id"], [F.col("turn")], F.when(F.col("role") == "user", F.col("turn")), "last_user").select("conv_id", "turn", "last_user")


@_query("""SELECT event_id, least(400, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), event_id + 400) - event_id) AS span FROM events""")
def next_key_span(spark, sf_dir):
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return _read(spark, sf_dir, "events").select("event_id", F.least(F.lit(400), F.coalesce(after, F.col("event_id") + 400) - F.col("event_id")).alias("span"))


@_query("""SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL""")
def json_props(spark, sf_dir):
    return _read(spark, sf_dir, "events").groupBy("event_type", F.from_json("props", "k int")["k"].alias("k")).agg(F.count("*").alias("n"))


# runtimes: pins from events ------------------------------------------------------------------------

def _pins(spark, sf_dir):
    i = F.col("event_id")
    return _read(spark, sf_dir, "events").select(
        F.col("user_id").alias("repo_id"), F.concat(F.lit("p"), (i % 7).cast("string"), F.when(i % 3 == 0, "/Dockerfile").otherwise("/.nvmrc")).alias("path"),
        F.concat_ws(".", (16 + i % 5 * 2).cast("string"), (i % 13).cast("string"), (i % 11).cast("string")).alias("version"), F.lit("exact").alias("kind"),
    )


_PINS = """(SELECT user_id AS repo_id, 'p' || (event_id % 7) || CASE WHEN event_id % 3 = 0 THEN '/Dockerfile' ELSE '/.nvmrc' END AS path,
    (16 + event_id % 5 * 2) || '.' || (event_id % 13) || '.' || (event_id % 11) AS version, 16 + event_id % 5 * 2 AS major FROM events)"""
_ONE = f"(SELECT DISTINCT repo_id, path, version, major FROM (SELECT *, min(major) OVER (PARTITION BY repo_id, path) AS lo, max(major) OVER (PARTITION BY repo_id, path) AS hi FROM {_PINS}) WHERE lo = hi)"


@_query(f"""SELECT repo_id, path, version, CAST(major AS INTEGER) AS major FROM {_ONE}""")
def node_pins(spark, sf_dir):
    return rules.node_pins(_pins(spark, sf_dir))


@_query(f"""
    WITH pins AS {_ONE}, s AS (SELECT DISTINCT repo_id, split_part(path, '/', 1) AS dir FROM pins WHERE path LIKE '%/.nvmrc'),
    scoped AS (SELECT p.*, coalesce(s.dir, '.') AS scope FROM pins p LEFT JOIN s ON p.repo_id = s.repo_id AND split_part(p.path, '/', 1) = s.dir)
    SELECT repo_id, scope AS subject, string_agg(DISTINCT path, ',' ORDER BY path) AS files FROM scoped GROUP BY repo_id, scope HAVING count(DISTINCT major) > 1""")
def pin_conflict(spark, sf_dir):
    scoped = hierarchy.pin_scopes(rules.node_pins(_pins(spark, sf_dir)), [".nvmrc"])
    return rules.version_conflicts(scoped).select("repo_id", "subject", F.array_join("files", ",").alias("files"))


@_query(f"""
    SELECT repo_id, CAST(arg_max(major, n * 1000 + major) AS INTEGER) AS major FROM (SELECT repo_id, major, count(*) AS n FROM (SELECT DISTINCT * FROM {_PINS}) WHERE major >= 18 AND major < 24 GROUP BY ALL) GROUP BY repo_id""")
def suggest_major(spark, sf_dir):
    pins = _pins(spark, sf_dir).select("repo_id", "path", "version", versions.major_of(F.col("version")).alias("major")).distinct()
    return rules.suggest_major(pins, ["repo_id"], versions.fits_range(F.col("major").cast("string"), F.lit(">=18 <24")))


_EOL = " UNION ALL ".join(f"SELECT {m} AS major, DATE '{d}' AS eol" for m, d in versions.NODE_EOL.items())


@_query(f"""SELECT repo_id, 'node@' || major AS subject, string_agg(DISTINCT path, ',' ORDER BY path) AS files FROM {_ONE} JOIN ({_EOL}) USING (major) WHERE eol <= DATE '{NOW}' GROUP BY repo_id, major""")
def runtime_eol(spark, sf_dir):
    eol = spark.createDataFrame([(m, d) for m, d in versions.NODE_EOL.items()], "major int, d string").select("major", F.col("d").cast("date").alias("eol"))
    return rules.end_of_life(rules.node_pins(_pins(spark, sf_dir)), eol, NOW).select("repo_id", "subject", F.array_join("files", ",").alias("files"))


FIXES = [("node", "18.5.3", "high"), ("node", "18.11.0", "critical"), ("node", "20.9.1", "low"), ("node", "22.2.2", "medium"), ("node", "24.12.0", "high"), ("node", "16.0.5", None)]
_FIXES = " UNION ALL ".join(f"SELECT '{r}' AS runtime, '{v}' AS fix, {'NULL' if s is None else chr(39) + s + chr(39)} AS severity" for r, v, s in FIXES)
_KEY = "list_transform(string_split({}, '.'), lambda x: CAST(x AS INTEGER))"


@_query(f"""
    WITH p AS (SELECT DISTINCT version FROM {_PINS}), m AS (SELECT version, fix, CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 END AS r
        FROM p JOIN ({_FIXES}) f ON split_part(version, '.', 1) = split_part(fix, '.', 1) AND {_KEY.format("fix")} > {_KEY.format("version")})
    SELECT version, CAST(count(*) AS BIGINT) AS missed, CAST(max(r) AS INTEGER) AS worst, arg_max(fix, {_KEY.format("fix")}) AS latest FROM m GROUP BY version""")
def missed_fixes(spark, sf_dir):
    fixes = spark.createDataFrame(FIXES, "runtime string, fix string, severity string")
    return rules.missed_fixes(_pins(spark, sf_dir).withColumn("runtime", F.lit("node")), fixes).drop("runtime")


@_query(f"""
    WITH p AS (SELECT DISTINCT version, {_KEY.format("version")} AS k FROM {_PINS})
    SELECT version, k[1] = 18 AND k >= [18, 4, 0] AS caret, k[1] = 20 AND k[2] = 3 AS tilde, k >= [16, 2, 0] AND k < [18, 0, 0] OR k >= [22, 0, 0] AS either, k >= [18, 0, 0] AND k <= [20, 5, 0] AS hyphen FROM p""")
def semver_in_range(spark, sf_dir):
    v = F.col("version")
    fits = lambda r: versions.fits_range(v, F.lit(r))
    return _pins(spark, sf_dir).select("version").distinct().select("version", fits("^18.4.0").alias("caret"), fits("~20.3").alias("tilde"), fits(">=16.2.0 <18 || 22.x || >22").alias("either"), fits("18.0.0 - 20.5.0").alias("hyphen"))


@_query(f"""
    WITH l AS (SELECT DISTINCT p_brand AS name, (1 + p_partkey % 3) || '.' || (p_size % 10) || '.0' AS version FROM part),
    a AS (SELECT DISTINCT p_brand AS name, (1 + p_partkey % 3) || '.' || (p_size % 10) || '.0' AS version, p_partkey % 40 AS id, CASE WHEN p_partkey % 5 > 0 THEN (1 + p_partkey % 3) || '.' || (p_partkey % 40) || '.1' END AS fixed FROM part WHERE p_partkey % 4 = 0)
    SELECT name, version, CAST(count(*) AS BIGINT) AS advisories, CASE WHEN count(*) = count(fixed) THEN arg_max(fixed, {_KEY.format("fixed")}) END AS fix FROM l JOIN a USING (name, version) GROUP BY ALL""")
def fix_all(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    first = (1 + F.col("p_partkey") % 3).cast("string")
    base = part.select(F.lit("npm").alias("ecosystem"), F.col("p_brand").alias("name"), F.concat_ws(".", first, (F.col("p_size") % 10).cast("string"), F.lit("0")).alias("version"), "p_partkey")
    fixed = F.when(F.col("p_partkey") % 5 > 0, F.concat_ws(".", first, (F.col("p_partkey") % 40).cast("string"), F.lit("1")))
    advisories = base.where("p_partkey % 4 = 0").select("ecosystem", "name", "version", (F.col("p_partkey") % 40).alias("id"), fixed.alias("fixed")).distinct()
    return rules.fix_all(base.drop("p_partkey").distinct(), advisories).drop("ecosystem")


# containers and environment -------------------------------------------------------------------------

@_query("""
    WITH b AS (SELECT user_id AS repo_id, 's' || (event_id % 5) AS service, 'c' || (event_id % 2) || '.yml' AS file, 3000 + event_id % 17 AS port,
            CASE event_id % 4 WHEN 0 THEN '*' WHEN 1 THEN '127.0.0.1' WHEN 2 THEN '10.0.0.1' ELSE '*' END AS ip, event_id % 29 = 0 AS profiled FROM events),
    w AS (SELECT repo_id, port, count(DISTINCT service) AS wild, min(service) AS one FROM b WHERE ip = '*' GROUP BY ALL),
    n AS (SELECT repo_id, port, count(DISTINCT service) AS names FROM b GROUP BY ALL), h AS (SELECT repo_id, port, ip, count(DISTINCT service) AS here FROM b GROUP BY ALL),
    c AS (SELECT b.* FROM b JOIN n USING (repo_id, port) JOIN h USING (repo_id, port, ip) LEFT JOIN w USING (repo_id, port)
        WHERE CASE WHEN ip = '*' THEN names > 1 ELSE here > 1 OR coalesce(wild > 1 OR wild = 1 AND one <> service, false) END)
    SELECT repo_id, port || '/tcp' AS subject, CASE WHEN bool_or(profiled) THEN 'warning' ELSE 'error' END AS severity, string_agg(DISTINCT file, ',' ORDER BY file) AS files
    FROM c GROUP BY repo_id, port HAVING count(DISTINCT service) >= 2""")
def port_conflicts(spark, sf_dir):
    i = F.col("event_id")
    b = _read(spark, sf_dir, "events").select(
        F.col("user_id").alias("repo_id"), F.lit(".").alias("project"), F.concat(F.lit("s"), (i % 5).cast("string")).alias("service"), F.concat(F.lit("c"), (i % 2).cast("string"), F.lit(".yml")).alias("file"),
        (3000 + i % 17).alias("port"), F.when(i % 4 == 0, "0.0.0.0").when(i % 4 == 1, "127.0.0.1").when(i % 4 == 2, "10.0.0.1").alias("host_ip"), F.lit("TCP").alias("protocol"), (i % 29 == 0).alias("profiled"),
    )
    return rules.port_conflicts(b).select("repo_id", "subject", "severity", F.array_join("files", ",").alias("files"))


NAMES = ["DATABASE_URL", "VITE_API_TOKEN", "PORT", "REDIS_URL", "NEXT_PUBLIC_APP_SECRET", "SMTP_PASSWORD", "NODE_ENV", "LOG_LEVEL"]


def _env(spark, sf_dir) -> dict[str, DataFrame]:
    i = F.col("event_id")
    name = F.get(F.lit(NAMES), (i % 8).cast("int"))
    e = _read(spark, sf_dir, "events").select(F.col("user_id").alias("repo_id"), name.alias("name"), i.alias("i"), "event_type")
    kind = F.when(F.col("event_type") == "click", "example").when(F.col("event_type") == "view", "local")
    path = F.when(kind == "example", F.when(i % 6 == 0, "apps/.env.example").otherwise(".env.example")).when(kind == "local", F.when(F.col("repo_id") % 4 == 0, ".envrc").otherwise(".env"))
    definitions = e.withColumnRenamed("i", "event_id").select("repo_id", "name", path.alias("path"), kind.alias("kind")).where("kind IS NOT NULL").distinct()
    uses = e.where("event_type IN ('purchase', 'signup')").select("repo_id", "name", F.concat(F.lit("src/"), (F.col("i") % 9).cast("string"), F.lit(".ts")).alias("path"), (F.col("i") % 3 == 0).alias("required"), (F.col("event_type") == "signup").alias("test"))
    files = definitions.select("repo_id", "path", "kind").distinct()
    return {"definitions": definitions, "env_files": files, "variables": rules.merge_env(definitions, uses), "platform": spark.createDataFrame([("NODE_ENV",), ("PORT",)], "name string")}


_ENV = f"""e AS (SELECT user_id AS repo_id, ['{"', '".join(NAMES)}'][1 + event_id % 8] AS name, event_id AS i, event_type FROM events),
    d AS (SELECT DISTINCT repo_id, name, CASE WHEN event_type = 'click' THEN CASE WHEN i % 6 = 0 THEN 'apps/.env.example' ELSE '.env.example' END WHEN repo_id % 4 = 0 THEN '.envrc' ELSE '.env' END AS path, CASE event_type WHEN 'click' THEN 'example' ELSE 'local' END AS kind FROM e WHERE event_type IN ('click', 'view')),
    u AS (SELECT repo_id, name, string_agg(DISTINCT 'src/' || (i % 9) || '.ts', ',' ORDER BY 'src/' || (i % 9) || '.ts') AS used_in, bool_or(i % 3 = 0) AS required, bool_and(event_type = 'signup') AS test_only
        FROM e WHERE event_type IN ('purchase', 'signup') GROUP BY ALL),
    g AS (SELECT repo_id, name, bool_or(kind = 'local') AS defined, bool_or(kind = 'example') AS documented FROM d GROUP BY ALL),
    v AS (SELECT repo_id, name, coalesce(defined, false) AS defined, coalesce(documented, false) AS documented, used_in IS NOT NULL AS used, coalesce(required, false) AS required, coalesce(test_only, false) AS test_only
        FROM g FULL JOIN u USING (repo_id, name))"""


@_query(f"WITH {_ENV} SELECT repo_id, name, defined, documented, used, used AND NOT required AS fallback, test_only FROM v")
def env_merge_full_outer(spark, sf_dir):
    return _env(spark, sf_dir)["variables"].select("repo_id", "name", "defined", "documented", "used", "fallback", "test_only")


@_query(f"""WITH {_ENV} SELECT repo_id, name AS subject, CASE WHEN required THEN 'warning' ELSE 'info' END AS severity FROM v WHERE used AND NOT test_only AND NOT documented AND name NOT IN ('NODE_ENV', 'PORT')
    AND repo_id IN (SELECT repo_id FROM d WHERE kind = 'example')""")
def env_undocumented(spark, sf_dir):
    return rules.env_undocumented(_env(spark, sf_dir)).select("repo_id", "subject", "severity")


@_query(f"WITH {_ENV} SELECT repo_id, name AS subject FROM v WHERE NOT documented AND (NOT used OR test_only) AND name NOT IN ('NODE_ENV', 'PORT') AND (repo_id, name) IN (SELECT repo_id, name FROM d WHERE path = '.env') AND repo_id IN (SELECT repo_id FROM d WHERE kind = 'example')")
def env_local_only(spark, sf_dir):
    return rules.env_local_only(_env(spark, sf_dir)).select("repo_id", "subject")


@_query(f"WITH {_ENV} SELECT repo_id, name AS subject FROM v WHERE documented AND NOT used AND name NOT IN ('NODE_ENV', 'PORT')")
def env_unused(spark, sf_dir):
    return rules.env_unused(_env(spark, sf_dir)).select("repo_id", "subject")


@_query(f"WITH {_ENV} SELECT repo_id, name AS subject FROM v WHERE used AND required AND NOT test_only AND NOT defined AND name NOT IN ('NODE_ENV', 'PORT') AND (repo_id, name) IN (SELECT repo_id, name FROM d WHERE path = '.env.example') AND repo_id IN (SELECT repo_id FROM d WHERE path = '.env')")
def env_missing_local(spark, sf_dir):
    return rules.env_missing_local(_env(spark, sf_dir)).select("repo_id", "subject")


@_query(f"WITH {_ENV} SELECT repo_id, name AS subject FROM v WHERE name = 'NEXT_PUBLIC_APP_SECRET'")
def env_public_secret(spark, sf_dir):
    return rules.env_public_secret(_env(spark, sf_dir)).select("repo_id", "subject")


def _rules() -> list[rules.Rule]:
    has = lambda kind: lambda s: s["env_files"].where(F.col("kind") == kind)
    return [
        rules.Rule("ENV_UNDOCUMENTED", "environment", has("example"), rules.env_undocumented), rules.Rule("ENV_LOCAL_ONLY", "environment", has("local"), rules.env_local_only),
        rules.Rule("ENV_UNUSED", "environment", has("example"), rules.env_unused), rules.Rule("ENV_MISSING_LOCAL", "environment", has("local"), rules.env_missing_local),
    ]


def _ran(spark, sf_dir):
    s = {name: settled(df) if name in ("definitions", "variables") else df for name, df in _env(spark, sf_dir).items()}  # each rule reads them
    settings = spark.createDataFrame([("ENV_UNUSED", "off"), ("ENV_LOCAL_ONLY", "error")], "code string, setting string")
    ignores = spark.createDataFrame([("ENV_UNDOCUMENTED", "*_URL")], "code string, pattern string")
    return rules.run_rules(_rules(), s, _read(spark, sf_dir, "events").select(F.col("user_id").alias("repo_id")).distinct(), settings, ignores)


_RAN = f"""{_ENV}, x AS (SELECT DISTINCT repo_id FROM d WHERE kind = 'example'), l AS (SELECT DISTINCT repo_id FROM d WHERE kind = 'local'),
    f AS (SELECT repo_id, 'ENV_UNDOCUMENTED' AS code, CASE WHEN required THEN 'warning' ELSE 'info' END AS severity, name, name LIKE '%\\_URL' ESCAPE '\\' AS ignored FROM v WHERE used AND NOT test_only AND NOT documented AND name NOT IN ('NODE_ENV', 'PORT') AND repo_id IN (FROM x)
        UNION ALL SELECT repo_id, 'ENV_LOCAL_ONLY', 'error', name, false FROM v WHERE NOT documented AND (NOT used OR test_only) AND name NOT IN ('NODE_ENV', 'PORT') AND (repo_id, name) IN (SELECT repo_id, name FROM d WHERE path = '.env') AND repo_id IN (SELECT repo_id FROM d WHERE kind = 'example') AND repo_id IN (FROM l)
        UNION ALL SELECT repo_id, 'ENV_MISSING_LOCAL', 'info', name, false FROM v WHERE used AND required AND NOT test_only AND NOT defined AND name NOT IN ('NODE_ENV', 'PORT') AND (repo_id, name) IN (SELECT repo_id, name FROM d WHERE path = '.env.example') AND repo_id IN (SELECT repo_id FROM d WHERE path = '.env') AND repo_id IN (FROM l)),
    c AS (SELECT r.repo_id, code, CASE WHEN code = 'ENV_UNUSED' THEN 'disabled' WHEN r.repo_id NOT IN (SELECT repo_id FROM d WHERE kind = k) THEN 'skipped'
            WHEN EXISTS (SELECT 1 FROM f WHERE f.repo_id = r.repo_id AND f.code = t.code AND NOT ignored) THEN 'failed' ELSE 'passed' END AS status
        FROM (SELECT DISTINCT user_id AS repo_id FROM events) r, (VALUES ('ENV_UNDOCUMENTED', 'example'), ('ENV_LOCAL_ONLY', 'local'), ('ENV_UNUSED', 'example'), ('ENV_MISSING_LOCAL', 'local')) t(code, k))"""


@_query(f"WITH {_RAN} SELECT repo_id, code, status FROM c")
def rule_statuses(spark, sf_dir):
    return _ran(spark, sf_dir)[1].select("repo_id", "code", "status")


@_query(f"""WITH {_RAN}, s AS (SELECT repo_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM f WHERE NOT ignored GROUP BY ALL)
    SELECT repo_id, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'disabled') AS disabled,
        coalesce(any_value(errors), 0) AS errors, coalesce(any_value(warnings), 0) AS warnings, coalesce(any_value(infos), 0) AS infos FROM c LEFT JOIN s USING (repo_id) GROUP BY repo_id""")
def rule_status_summary(spark, sf_dir):
    found, checks = _ran(spark, sf_dir)
    return rules.summary(checks, found)


@_query(f"WITH {_RAN} SELECT repo_id, coalesce(bool_or(severity = 'error' AND NOT ignored), false) AS fails FROM f GROUP BY repo_id")
def fail_gate(spark, sf_dir):
    return rules.should_fail(_ran(spark, sf_dir)[0], "error")


# evidence --------------------------------------------------------------------------------------------

def _signals(spark, sf_dir):
    i = F.col("event_id")
    return _read(spark, sf_dir, "events").select(
        F.col("user_id").alias("repo_id"), F.when(i % 4 == 0, ".").otherwise(F.concat(F.lit("apps/"), (i % 4).cast("string"))).alias("package"), F.get(F.lit(evidence.CONFIDENCE), (i % 3).cast("int")).alias("confidence"),
        F.concat(F.lit("dependency "), (i % 23).cast("string")).alias("evidence"), F.when(i % 5 == 0, F.concat(F.lit("cfg"), (i % 2).cast("string"))).alias("config_file"), F.when(i % 6 == 0, (i % 10).cast("string")).alias("version"), i.alias("ord"),
    )


@_query("""
    WITH s AS (SELECT user_id AS repo_id, CASE WHEN event_id % 4 = 0 THEN '.' ELSE 'apps/' || (event_id % 4) END AS package, event_id % 3 AS r, 'dependency ' || (event_id % 23) AS ev,
        CASE WHEN event_id % 5 = 0 THEN 'cfg' || (event_id % 2) END AS cf, CASE WHEN event_id % 6 = 0 THEN CAST(event_id % 10 AS VARCHAR) END AS v, (2 - event_id % 3) * 1000000000000 + event_id AS o FROM events),
    e AS (SELECT repo_id, list(ev ORDER BY o) AS every FROM (SELECT repo_id, ev, min(o) AS o FROM s GROUP BY ALL) GROUP BY repo_id)
    SELECT repo_id, string_agg(DISTINCT package, ',' ORDER BY package) AS packages, ['low', 'medium', 'high'][1 + max(r)] AS confidence, arg_min(v, o) FILTER (v IS NOT NULL) AS version,
        coalesce(string_agg(DISTINCT cf, ',' ORDER BY cf), '') AS config_files, any_value(CASE WHEN len(every) > 6 THEN array_to_string(every[1:5], ',') || ',and ' || (len(every) - 5) || ' more' ELSE array_to_string(every, ',') END) AS evidence
    FROM s JOIN e USING (repo_id) GROUP BY repo_id""")
def signal_merge(spark, sf_dir):
    m = evidence.merge_signals(_signals(spark, sf_dir), ["repo_id"])
    return m.select("repo_id", "confidence", "version", *[F.array_join(c, ",").alias(c) for c in ("packages", "config_files", "evidence")])


@_query("""
    WITH s AS (SELECT user_id AS repo_id, 'dependency ' || (event_id % 23) AS ev, event_id % 3 AS r, CASE WHEN event_type = 'click' THEN 'docker' WHEN event_type = 'view' THEN 'env' ELSE 'config' END AS source, event_id AS i FROM events),
    e AS (SELECT repo_id, ev, min((2 - r) * 1000000000000 + i) AS o FROM s GROUP BY ALL), l AS (SELECT repo_id, list(ev ORDER BY o)[1:10] AS every FROM e GROUP BY ALL)
    SELECT repo_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, ['low', 'medium', 'high'][1 + max(r)] AS confidence, any_value(array_to_string(every, ',')) AS evidence FROM s JOIN l USING (repo_id) GROUP BY repo_id""")
def database_union(spark, sf_dir):
    types = _read(spark, sf_dir, "events").select("event_id", "event_type")
    s = _signals(spark, sf_dir).join(types, F.col("ord") == F.col("event_id"))
    one = lambda where, source: s.where(where).select("repo_id", F.lit(source).alias("source"), "confidence", "evidence", "ord")
    found = [one("event_type = 'click'", "docker"), one("event_type = 'view'", "env"), one("event_type NOT IN ('click', 'view')", "config")]
    u = evidence.union_findings(found, ["repo_id"])
    return u.select("repo_id", "confidence", *[F.array_join(c, ",").alias(c) for c in ("sources", "evidence")])


@_query("""
    WITH t AS (SELECT user_id, list_sort(list_distinct(list(event_id % 4))) AS a, list_sort(list_distinct(list((event_id * 7) % 4))) AS b FROM events GROUP BY user_id)
    SELECT user_id, a = b AS same, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS together FROM t""")
def set_equality(spark, sf_dir):
    t = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.col("event_id") % 4).alias("a"), F.collect_set(F.col("event_id") * 7 % 4).alias("b"))
    both = text.sorted_distinct(F.array_union("a", "b"))
    return t.select("user_id", text.same_set(F.col("a"), F.col("b")).alias("same"), F.array_join(F.transform(both, lambda x: x.cast("string")), ",").alias("together"))


@_query("""
    SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY ALL""")
def tpch_sanity(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    lines = _read(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
