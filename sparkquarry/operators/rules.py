"""Diagnostic rules as relational queries: anti-joins, having clauses and range conditions.

A finding has repo_id, code, severity, category, subject and files. Each rule says where it applies;
where it does not, its status is skipped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.functions import paths, text, versions
from sparkquarry.operators.evidence import SEVERITY, rank_of
from sparkquarry.operators.fixpoint import settled

FINDING = ["repo_id", "code", "severity", "category", "subject", "files"]


@dataclass
class Rule:
    """``applies``: repo_ids; ``check``: findings; both from a mapping of section names to DataFrames."""

    code: str
    category: str
    applies: Callable[[dict[str, DataFrame]], DataFrame]
    check: Callable[[dict[str, DataFrame]], DataFrame]


def finding(rows: DataFrame, code: str, category: str, severity: Column | str, subject: Column, files: Column) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select("repo_id", F.lit(code).alias("code"), severity.alias("severity"), F.lit(category).alias("category"), subject.cast("string").alias("subject"), files.alias("files"))


# environment -------------------------------------------------------------------------------------

def merge_env(definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """Variables by name: definitions (repo_id, name, path, kind) and uses (repo_id, name, path, required, test) in a full outer join."""
    keys = ["repo_id", "name"]
    defined = definitions.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") != "example", F.col("path")))).alias("defined_in"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "example", F.col("path")))).alias("documented_in"),
    )
    used = uses.groupBy(*keys).agg(
        F.slice(F.array_sort(F.collect_set("path")), 1, 5).alias("used_in"), F.bool_or("required").alias("required"), F.bool_and("test").alias("test_only")
    )
    none = F.array().cast("array<string>")
    out = defined.join(used, keys, "full_outer")
    out = out.select(*keys, *[F.coalesce(c, none).alias(c) for c in ("defined_in", "documented_in", "used_in")], F.coalesce("required", F.lit(False)).alias("required"), F.coalesce("test_only", F.lit(False)).alias("test_only"))
    return out.withColumns({
        "defined": F.size("defined_in") > 0, "documented": F.size("documented_in") > 0, "used": F.size("used_in") > 0,
        "fallback": (F.size("used_in") > 0) & ~F.col("required"), "public": text.is_public_name(F.col("name")), "sensitive": text.is_sensitive_name(F.col("name")),
    })


def env_undocumented(s: dict[str, DataFrame]) -> DataFrame:
    """Used outside tests, not provided by the platform, in no example file though there is one."""
    v = s["variables"].where("used AND NOT test_only AND NOT documented").join(s["platform"], "name", "left_anti")
    v = v.join(s["env_files"].where("kind = 'example'").select("repo_id").distinct(), "repo_id", "left_semi")
    return finding(v, "ENV_UNDOCUMENTED", "environment", F.when(F.col("fallback"), "info").otherwise("warning"), F.col("name"), F.col("used_in"))


def env_local_only(s: dict[str, DataFrame]) -> DataFrame:
    """Set in a local file (not direnv's) of a repository with an example file, which does not name it; not the platform's."""
    local = s["definitions"].where((F.col("kind") == "local") & (paths.base_name(F.col("path")) != ".envrc")).groupBy("repo_id", "name").agg(F.min("path").alias("local"))
    v = s["variables"].where("NOT documented AND (NOT used OR test_only)").join(s["platform"], "name", "left_anti").join(local, ["repo_id", "name"])
    v = v.join(s["env_files"].where("kind = 'example'").select("repo_id").distinct(), "repo_id", "left_semi")
    return finding(v, "ENV_LOCAL_ONLY", "environment", "warning", F.col("name"), F.array("local"))


def env_unused(s: dict[str, DataFrame]) -> DataFrame:
    """Documented and read nowhere: not by code (complete scans only: ``scans`` with repo_id, if given), nor by name (``mentioned``), by Compose services
    (``compose_names``), as build arguments (``build_args``), by tools (``tool_names``, of all repositories) or by a container that gets a whole
    file of that directory (``env_file_dirs``: repo_id, dir). Sections that are not given hold nothing; all but tool_names have repo_id and name."""
    v = s["variables"].where("documented AND NOT used").join(s["platform"], "name", "left_anti")
    if "scans" in s:
        v = v.join(s["scans"], "repo_id", "left_semi")
    for section in ("mentioned", "compose_names", "build_args"):
        if section in s:
            v = v.join(s[section].select("repo_id", "name"), ["repo_id", "name"], "left_anti")
    if "tool_names" in s:
        v = v.join(s["tool_names"].select("name"), "name", "left_anti")
    if "env_file_dirs" in s:
        given = v.select("repo_id", "name", F.explode("documented_in").alias("file")).select("repo_id", "name", paths.dir_of(F.col("file")).alias("dir"))
        v = v.join(given.join(s["env_file_dirs"], ["repo_id", "dir"], "left_semi"), ["repo_id", "name"], "left_anti")
    return finding(v, "ENV_UNUSED", "environment", "info", F.col("name"), F.col("documented_in"))


def env_missing_local(s: dict[str, DataFrame]) -> DataFrame:
    """Named in an example file at the top and needed by code outside tests, but set in no local or mode file though there is a
    local file at the top; not the platform's."""
    have = s["definitions"].where("kind IN ('local', 'mode')").select("repo_id", "name").distinct()
    top = s["env_files"].where((F.col("kind") == "local") & ~F.col("path").contains("/") & (F.col("path") != ".envrc")).select("repo_id").distinct()
    example = F.get(F.filter("documented_in", lambda p: ~p.contains("/")), F.lit(0))
    v = s["variables"].where("documented AND used AND NOT test_only AND NOT fallback").withColumn("example", example).where("example IS NOT NULL")
    v = v.join(s["platform"], "name", "left_anti").join(have, ["repo_id", "name"], "left_anti").join(top, "repo_id", "left_semi")
    return finding(v, "ENV_MISSING_LOCAL", "environment", "info", F.col("name"), F.array("example"))


#: Words of a name that say secret outright; tokens and keys of browser clients are public by design.
SECRET_WORDS = ["SECRET", "SECRETS", "SECRETKEY", "CLIENTSECRET", "PASSWORD", "PASSWD", "PRIVATEKEY", "PRIVATE_KEY", "SERVICEROLE", "SERVICE_ROLE"]


def env_public_secret(s: dict[str, DataFrame]) -> DataFrame:
    """A variable that reaches the browser and says in its name that it is a secret."""
    name = F.concat(F.lit("_"), F.upper("name"), F.lit("_"))
    says = F.exists(F.lit([f"_{w}_" for w in SECRET_WORDS]), lambda w: name.contains(w))
    files = F.array_distinct(F.concat("used_in", "defined_in", "documented_in"))
    return finding(s["variables"].where(F.col("public") & says), "ENV_PUBLIC_SECRET", "security", "warning", F.col("name"), files)


def env_not_ignored(s: dict[str, DataFrame]) -> DataFrame:
    """Untracked files with values that are known not to be ignored; unknown (null) is not false."""
    f = s["env_files"].where("kind IN ('local', 'mode', 'service') AND NOT coalesce(tracked, false) AND ignored <=> false")
    return finding(f, "ENV_FILE_NOT_IGNORED", "security", "warning", F.col("path"), F.array("path"))


def env_tracked(s: dict[str, DataFrame]) -> DataFrame:
    f = s["env_files"].where("tracked <=> true AND kind IN ('local', 'mode', 'service', 'other')")
    envrc = paths.base_name(F.col("path")) == ".envrc"
    severity = F.when((F.col("kind") == "local") & ~envrc, "error").when(F.col("credential"), "error").when((F.col("kind") == "other") | (F.col("variables") == 0), None).otherwise("warning")
    f = f.where(~(envrc & (F.col("variables") == 0))).withColumn("severity", severity).where("severity IS NOT NULL")
    return finding(f, "TRACKED_ENV_FILE", "security", F.col("severity"), F.col("path"), F.array("path"))


# containers --------------------------------------------------------------------------------------

def port_conflicts(bindings: DataFrame) -> DataFrame:
    """Services that publish one host port on overlapping addresses: bindings of (repo_id, project, service, file, host_ip, port, protocol, profiled).

    Distinct names are counted per address and over wildcards, so a port of many services needs no self-join.
    """
    ip = F.regexp_replace(F.trim(F.coalesce("host_ip", F.lit(""))), r"^\[|\]$", "")
    b = bindings.where(F.col("port").between(1, 65535)).withColumns({"ip": F.when(ip.isin("", "0.0.0.0", "::"), "*").otherwise(ip), "protocol": F.lower(F.coalesce("protocol", F.lit("tcp")))})
    group = ["repo_id", "project", "port", "protocol"]
    at = b.groupBy(*group, "ip").agg(F.count_distinct("service").alias("here"))
    wild = b.where("ip = '*'").groupBy(*group).agg(F.count_distinct("service").alias("wild"), F.min("service").alias("one"))
    names = b.groupBy(*group).agg(F.count_distinct("service").alias("names"))
    b = b.join(at, [*group, "ip"]).join(names, group).join(wild, group, "left")
    clash = F.when(F.col("ip") == "*", F.col("names") > 1).otherwise((F.col("here") > 1) | F.coalesce((F.col("wild") > 1) | ((F.col("wild") == 1) & (F.col("one") != F.col("service"))), F.lit(False)))
    found = b.where(clash).groupBy(*group).agg(F.array_sort(F.collect_set("service")).alias("services"), F.array_sort(F.collect_set("file")).alias("files"), F.bool_or("profiled").alias("profiled"))
    found = found.where(F.size("services") >= 2)
    subject = F.concat(F.when(F.col("project") == ".", "").otherwise(F.concat(F.get("files", F.lit(0)), F.lit(":"))), F.col("port").cast("string"), F.lit("/"), F.col("protocol"))
    return finding(found, "DOCKER_PORT_CONFLICT", "docker", F.when(F.col("profiled"), "warning").otherwise("error"), subject, F.col("files"))


#: Technologies of services that serve a scheme.
SCHEME_TECHNOLOGIES = [
    ("postgres", "postgresql"), ("postgresql", "postgresql"), ("mysql", "mysql"), ("mysql", "mariadb"), ("mariadb", "mariadb"), ("mariadb", "mysql"), ("mongodb", "mongodb"),
    *[(scheme, technology) for scheme in ("redis", "rediss") for technology in ("redis", "valkey", "keydb", "dragonfly", "dragonflydb")],
]


def endpoint_mismatch(endpoints: DataFrame, publishers: DataFrame) -> DataFrame:
    """Local endpoints (repo_id, name, file, scheme, port, local) whose scheme some service serves, but none on that port.

    ``publishers``: (repo_id, service, source, technology, host) of published ports, host as written and null where none is. A scheme is left alone where
    a service of its technologies publishes a range or a variable, which could be any port. One finding a variable: its files and that of the first service.
    """
    served = endpoints.sparkSession.createDataFrame(SCHEME_TECHNOLOGIES, "scheme string, technology string")
    port = F.when(F.col("host").rlike(r"^\d{1,5}$"), F.col("host").cast("int"))
    p = publishers.where("host IS NOT NULL").withColumn("published", port).join(F.broadcast(served), "technology")
    group = p.groupBy("repo_id", "scheme").agg(F.bool_or(F.col("published").isNull()).alias("open"), F.collect_set("published").alias("published"), F.min_by("source", "service").alias("source"))
    e = endpoints.where("local AND port IS NOT NULL").withColumn("scheme", F.substring_index(F.lower("scheme"), "+", 1))
    off = e.join(group.where("NOT open"), ["repo_id", "scheme"]).where(~F.array_contains("published", F.col("port")))
    rows = off.groupBy("repo_id", "name").agg(F.array_sort(F.array_distinct(F.concat(F.collect_set("file"), F.collect_set("source")))).alias("files"))
    return finding(rows, "ENV_PORT_MISMATCH", "docker", "warning", F.col("name"), F.col("files"))


# runtimes ----------------------------------------------------------------------------------------

def node_pins(sources: DataFrame) -> DataFrame:
    """Distinct exact pins; files that pin several majors (a test matrix) are left out."""
    p = sources.where("kind = 'exact' AND version IS NOT NULL").select("repo_id", "path", "version", versions.major_of(F.col("version")).alias("major")).where("major IS NOT NULL").distinct()
    one = Window.partitionBy("repo_id", "path")
    return p.withColumns({"__lo": F.min("major").over(one), "__hi": F.max("major").over(one)}).where("__lo = __hi").drop("__lo", "__hi")


def version_conflicts(scoped: DataFrame) -> DataFrame:
    g = scoped.groupBy("repo_id", "scope").agg(F.count_distinct("major").alias("majors"), F.array_sort(F.collect_set("path")).alias("files")).where("majors > 1")
    return finding(g, "NODE_VERSION_CONFLICT", "runtime", "warning", F.col("scope"), F.col("files"))


def suggest_major(pins: DataFrame, keys: list[str], fits: Column) -> DataFrame:
    """The major that most pins name among those that fit; ties go to the higher."""
    counts = pins.where(fits).groupBy(*keys, "major").agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.max_by("major", F.struct("n", "major")).alias("major"))


def end_of_life(pins: DataFrame, eol: DataFrame, now: str) -> DataFrame:
    """Pins past the end of life of their major at ``now`` (a date, never the clock)."""
    gone = pins.join(F.broadcast(eol.where(F.col("eol") <= F.lit(now).cast("date"))), "major")
    g = gone.groupBy("repo_id", "major").agg(F.array_sort(F.collect_set("path")).alias("files"))
    return finding(g, "RUNTIME_EOL", "runtime", "warning", F.concat(F.lit("node@"), F.col("major").cast("string")), F.col("files"))


def missed_fixes(pins: DataFrame, fixes: DataFrame) -> DataFrame:
    """Security releases of a pin's line that are newer than it: how many, the worst, the latest."""
    rank = rank_of(F.col("severity"), ["low", "medium", "high", "critical"])
    p = pins.select("runtime", "version").distinct().withColumns({"line": versions.release_line(F.col("runtime"), F.col("version")), "key": versions.version_key(F.col("version"))})
    f = fixes.select("runtime", versions.release_line(F.col("runtime"), F.col("fix")).alias("line"), "fix", versions.version_key(F.col("fix")).alias("fix_key"), rank.alias("rank"))
    missed = p.join(f, ["runtime", "line"]).where(F.col("fix_key") > F.col("key"))
    return missed.groupBy("runtime", "version").agg(F.count("*").alias("missed"), F.max("rank").alias("worst"), F.max_by("fix", "fix_key").alias("latest"))


def fix_all(locked: DataFrame, advisories: DataFrame) -> DataFrame:
    """Advisories of each locked package, and the version that fixes all of them (null if one has no fix)."""
    hits = locked.join(advisories, ["ecosystem", "name", "version"])
    latest = F.max_by("fixed", F.when(F.col("fixed").isNotNull(), versions.version_key(F.col("fixed"))))
    return hits.groupBy("ecosystem", "name", "version").agg(F.count("*").alias("advisories"), F.when(F.count("*") == F.count("fixed"), latest).alias("fix"))


def fix_for(version: Column, events: Column) -> Column:
    """The least fixed version whose range [introduced, fixed) holds ``version``; events: array of (introduced, fixed) pairs."""
    key = versions.version_key(version)
    holds = lambda e: (versions.version_key(e["introduced"]) <= key) & (key < versions.version_key(e["fixed"]))
    ranked = F.transform(F.filter(events, holds), lambda e: F.struct(versions.version_key(e["fixed"]).alias("k"), e["fixed"].alias("v")))
    return F.array_min(ranked)["v"]


# packages and workspaces ---------------------------------------------------------------------------

def multiple_lockfiles(lockfiles: DataFrame) -> DataFrame:
    g = lockfiles.where(paths.dir_of(F.col("path")) == ".").groupBy("repo_id").agg(F.count_distinct("manager").alias("n"), F.array_sort(F.collect_set("path")).alias("files")).where("n > 1")
    return finding(g, "MULTIPLE_LOCKFILES", "package-manager", "warning", F.lit(None), F.col("files"))


def manager_mismatch(declared: DataFrame, lockfiles: DataFrame) -> DataFrame:
    """A declared manager (repo_id, manager) without a lockfile of its own where others have one."""
    others = lockfiles.groupBy("repo_id").agg(F.array_sort(F.collect_set("path")).alias("files"))
    m = declared.join(lockfiles.select("repo_id", "manager"), ["repo_id", "manager"], "left_anti").join(others, "repo_id")
    return finding(m, "PACKAGE_MANAGER_MISMATCH", "package-manager", "warning", F.col("manager"), F.col("files"))


def missing_sums(requires: DataFrame, local: DataFrame, sums: DataFrame) -> DataFrame:
    """Go modules with direct requirements that no local module meets, and no sum file."""
    r = requires.where("NOT indirect").join(local, ["repo_id", "module"], "left_anti").select("repo_id", "dir").distinct().join(sums, ["repo_id", "dir"], "left_anti")
    return finding(r, "GO_SUM_MISSING", "tooling", "warning", F.col("dir"), F.array(F.col("dir")))


# the runner ----------------------------------------------------------------------------------------

def _for_rules(rows: DataFrame, security: list[str], raised: Column) -> tuple[DataFrame, list[str]]:
    """Settings or ignores with the columns to join by. Entries of one repository (repo_id) may not lower a security rule."""
    if "repo_id" not in rows.columns:
        return rows, ["code"]
    return rows.where(~F.col("code").isin(security) | raised), ["repo_id", "code"]


def run_rules(rules: list[Rule], sections: dict[str, DataFrame], repos: DataFrame, settings: DataFrame, ignores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings with ``ignored``, checks with status). settings: (code, setting), one a rule; ignores: (code, pattern); each with a repo_id where
    they are a repository's own.

    A setting of off disables a rule, another one replaces its severities; an ignore entry hides findings
    whose subject its wildcard matches. A repository's own entries can only raise a security rule to error. Statuses: disabled, skipped, failed, passed.
    Findings are computed once and written; what follows reads them.
    """
    found = applied = None
    for r in rules:
        f, a = r.check(sections).select(*FINDING), r.applies(sections).select("repo_id", F.lit(r.code).alias("code")).distinct()
        found = f if found is None else found.unionByName(f)
        applied = a if applied is None else applied.unionByName(a)
    security = [r.code for r in rules if r.category == "security"]
    set_, by = _for_rules(settings, security, F.col("setting") == "error")
    applied = settled(applied.withColumn("applies", F.lit(True)))
    found = found.join(applied, ["repo_id", "code"], "left_semi").join(set_, by, "left").where("setting IS NULL OR setting <> 'off'")
    found = found.withColumn("severity", F.coalesce("setting", "severity")).drop("setting")
    own, by_ignore = _for_rules(ignores, security, F.lit(False))
    regex = F.concat(F.lit("^"), F.replace(F.regexp_replace("pattern", r"([.\\+?^${}()|\[\]])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("$"))
    hidden = own.select(*by_ignore, regex.alias("__re")).groupBy(*by_ignore).agg(F.collect_set("__re").alias("__res"))
    found = found.join(hidden, by_ignore, "left").withColumn("ignored", F.coalesce(F.exists("__res", lambda p: F.regexp_like(F.coalesce("subject", F.lit("")), p)), F.lit(False))).drop("__res")
    found = settled(found)
    every = repos.select("repo_id", F.explode(F.lit([r.code for r in rules])).alias("code"))
    every = every.withColumn("category", F.try_element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.code, r.category)]), F.col("code")))
    failed = found.where("NOT ignored").groupBy("repo_id", "code").agg(F.count("*").alias("findings"))
    checks = every.join(set_, by, "left").join(applied, ["repo_id", "code"], "left").join(failed, ["repo_id", "code"], "left")
    status = F.when(F.col("setting").eqNullSafe("off"), "disabled").when(F.col("applies").isNull(), "skipped").when(F.col("findings") > 0, "failed").otherwise("passed")
    return found, checks.select("repo_id", "code", "category", status.alias("status"), F.coalesce("findings", F.lit(0)).alias("findings"))


def summary(checks: DataFrame, findings: DataFrame) -> DataFrame:
    by_status = checks.groupBy("repo_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("passed", "failed", "skipped", "disabled")])
    by_severity = findings.where("NOT ignored").groupBy("repo_id").agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in SEVERITY])
    return by_status.join(by_severity, "repo_id", "left").fillna(0)


def should_fail(findings: DataFrame, fail_on: str = "error") -> DataFrame:
    """repo_id and whether a finding is at least as severe as ``fail_on``."""
    return findings.groupBy("repo_id").agg((F.min(F.when(~F.col("ignored"), rank_of(F.col("severity"), SEVERITY))) <= SEVERITY.index(fail_on)).alias("fails")).fillna(False)


def in_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy("repo_id", rank_of(F.col("severity"), SEVERITY), "category", "code", F.asc_nulls_first("subject"))
