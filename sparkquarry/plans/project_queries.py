"""Driver queries of the rules over manifests, workspaces, containers, scripts and tools.

As in ``queries``, facts come from columns of the events by the same arithmetic on both sides; the SQL says what a rule
reports from the arithmetic, not from the library's patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.operators import project_rules as rules
from sparkquarry.operators.fixpoint import settled
from sparkquarry.operators.rules import run_rules
from sparkquarry.plans.queries import _ENV, _env, _query, _read, ORACLE_SQL

FILES = [
    "package.json", ".gitignore", "apps/a/middleware.ts", "apps/a/src/proxy.ts", ".env.production", "config/app.env", ".pnp.cjs", "src/index.test.ts",
    "README.md", "middleware.js", "apps/b/src/middleware.ts",
]
PACKAGE_DIRS = [".", "packages/a", "packages/b", "tools/x", "libs/deep/y"]
PATTERNS = ["packages/*", "libs/**", "!tools/*", "{tools,libs}/x", "node_modules/*"]
ENV_PATHS = [".env.production", "config/app.env", "missing.env", "other/.env"]
PLACEHOLDER = 'echo "Error: no test specified" && exit 1'


def _pick(values: list, at: Column) -> Column:
    return F.get(F.lit(values), at.cast("int"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _sections(spark, sf_dir) -> dict[str, DataFrame]:
    events = _read(spark, sf_dir, "events").select(F.col("user_id").alias("repo_id"), F.col("event_id").alias("i"))
    i, u = F.col("i"), F.col("repo_id")
    repos = events.select("repo_id").distinct()

    def drawn(modulus: int, n: int, **columns: Column) -> DataFrame:
        return events.where(i % modulus < n).select("repo_id", *[c.alias(k) for k, c in columns.items()]).distinct()

    def some(test: Column, **columns) -> DataFrame:
        return repos.where(test).select("repo_id", *[(c if isinstance(c, Column) else F.lit(c)).alias(k) for k, c in columns.items()])

    none = F.array().cast("array<string>")
    return {
        "files": drawn(97, 11, path=_pick(FILES, i % 97)),
        "projects": some(
            F.lit(True), type=_pick(["library", "cli", "service"], u % 3), declared=F.when(u % 4 == 0, "npm").when(u % 4 == 1, "pnpm"), has_manifest=u % 5 != 0, unlocked=u % 7 == 0,
            turbo=F.when(u % 3 != 0, u % 4), git_root=u % 2 == 0,
        ),
        "warnings": drawn(53, 4, kind=F.when(i % 2 == 0, "parse").otherwise("limit"), file=F.when(i % 53 == 0, "package.json").when(i % 53 == 1, "tsconfig.json").when(i % 53 == 3, F.concat(F.lit("a"), (i % 5).cast("string"))), message=F.concat(F.lit("m"), (i % 3).cast("string"))),
        "example_values": drawn(31, 1, name=F.concat(F.lit("K"), (i % 4).cast("string")), path=F.when(i % 5 == 0, "b/.env.example").otherwise(".env.example"), credential=F.when(i % 3 == 0, "npm-token")),
        "locks": drawn(41, 2, manager=_pick(["npm", "pnpm"], i % 41), path=_pick(["package-lock.json", "pnpm-lock.yaml"], i % 41)),
        "packages": drawn(37, 5, dir=_pick(PACKAGE_DIRS, i % 37), role=_pick(["root", "workspace", "workspace", "nested", "nested"], i % 37), dependencies=i % 2),
        "node_pins": drawn(29, 3, path=_pick([".nvmrc", "apps/a/.nvmrc", "apps/a/deep/.nvmrc"], i % 29), version=F.concat_ws(".", (16 + i % 5 * 2).cast("string"), (i % 13).cast("string"), F.lit("0"))),
        "engines": some(u % 2 == 0, dir=".", range=">=18 <22").unionByName(some(u % 3 == 0, dir="apps/a", range="^20.3.0 || 24.x")),
        "go_tools": drawn(43, 3, path=_pick(["Dockerfile", "svc/a/Dockerfile", "svc/b/x/Dockerfile"], i % 43), version=F.concat(F.lit("1."), (18 + i % 6).cast("string"))),
        "go_modules": some(u % 2 == 0, dir=".", go="1.21").unionByName(some(u % 3 == 0, dir="svc/a", go="1.22.1")),
        "workspaces": some(u % 2 == 0, source="pnpm-workspace.yaml", patterns=F.when(u % 4 == 0, none).otherwise(F.array(F.lit("packages/*")))).unionByName(some(u % 3 != 1, source="package.json", patterns=F.array(F.lit("packages/*")))),
        "workspace_patterns": drawn(47, 5, file=F.lit("package.json"), pattern=_pick(PATTERNS, i % 47)),
        "turbo_configs": drawn(59, 2, path=_pick(["turbo.json", "apps/a/turbo.json"], i % 59), has_pipeline=i % 3 != 0),
        "compose_files": drawn(61, 2, path=_pick(["compose.yml", "docker/compose.yml"], i % 61), has_version=i % 2 == 0),
        "env_file_refs": drawn(23, 4, compose_file=_pick(["compose.yml", "docker/compose.yml"], i % 2), service=F.concat(F.lit("s"), (i % 3).cast("string")), path=_pick(ENV_PATHS, i % 23), required=F.when(i % 5 == 0, False).when(i % 5 > 1, True)),
        "ignored_dirs": some(u % 3 == 0, dir="node_modules"),
        "root_scripts": drawn(67, 4, name=_pick(["test", "test:unit", "lint", "build"], i % 67), command=F.when(i % 2 == 0, PLACEHOLDER).when(i % 3 == 0, "npx eslint .").otherwise("vite build")),
        "tools": some(u % 2 == 0, category="test").unionByName(some(u % 3 == 0, category="lint")),
        "tasks": some(u % 5 == 0, name="test").unionByName(some(u % 7 == 0, name="lint")),
        "eslint_configs": drawn(71, 2, dir=_pick([".", "apps/a"], i % 71), path=_pick([".eslintrc.json", "apps/a/package.json"], i % 71), in_manifest=i % 71 == 1),
        "eslint": some(u % 4 != 0, dir=".", major=8 + u % 3, opted_out=u % 2 == 0).unionByName(some(u % 5 == 0, dir="apps/a", major=F.lit(9).cast("long"), opted_out=False)),
        "next_apps": some(F.lit(True), dir=".", major=15 + u % 2).unionByName(some(F.lit(True), dir="apps/a", major=F.lit(16).cast("long"))).unionByName(some(u % 3 == 0, dir="apps/b", major=F.lit(16).cast("long"))),
    }


_E = f"""e AS (SELECT user_id AS u, event_id AS i FROM events), r AS (SELECT DISTINCT u FROM e),
    fl AS (SELECT DISTINCT u, {_list(FILES)}[1 + i % 97] AS path FROM e WHERE i % 97 < 11)"""


def _rule(sql: str):
    """A rule's findings by repository, subject and severity."""

    def register(f):
        def query(spark, sf_dir):
            return f(_sections(spark, sf_dir)).select("repo_id", "subject", "severity")

        query.__name__ = "rule_" + f.__name__
        return _query(f"WITH {_E} {sql}")(query)

    return register


_rule("SELECT DISTINCT u AS repo_id, 'package.json' AS subject, 'error' AS severity FROM e WHERE i % 53 = 0 AND i % 2 = 0")(rules.manifest_invalid)
_rule("""SELECT DISTINCT u AS repo_id, CASE i % 53 WHEN 1 THEN 'tsconfig.json' WHEN 2 THEN 'm' || (i % 3) ELSE 'a' || (i % 5) END AS subject, 'warning' AS severity
    FROM e WHERE i % 53 BETWEEN 1 AND 3 AND i % 2 = 0""")(rules.config_parse_error)
_rule("SELECT DISTINCT u AS repo_id, 'K' || (i % 4) AS subject, 'error' AS severity FROM e WHERE i % 31 = 0 AND i % 3 = 0")(rules.example_real_secret)
_rule("""SELECT DISTINCT u AS repo_id, 'package.json' AS subject, 'info' AS severity FROM e WHERE i % 41 < 2 AND u % 4 > 1 AND u % 5 <> 0""")(rules.manager_undeclared)
_rule("""SELECT u AS repo_id, 'package.json' AS subject, 'info' AS severity FROM r WHERE u % 7 <> 0 AND u IN (SELECT u FROM e WHERE i % 37 < 3 AND i % 2 = 1)
    AND u IN (SELECT u FROM e WHERE i % 37 = 0) AND u NOT IN (SELECT u FROM e WHERE i % 41 < 2)""")(rules.lockfile_missing)
_rule("""SELECT DISTINCT u AS repo_id, ['.nvmrc', 'apps/a/.nvmrc', 'apps/a/deep/.nvmrc'][1 + i % 29] AS subject, 'warning' AS severity FROM (SELECT *, 16 + i % 5 * 2 AS m FROM e) WHERE i % 29 < 3
    AND CASE WHEN i % 29 > 0 AND u % 3 = 0 THEN NOT (m = 20 AND i % 13 >= 3 OR m = 24) WHEN u % 2 = 0 THEN NOT (m >= 18 AND m < 22) ELSE false END""")(rules.node_out_of_range)
_rule("""SELECT DISTINCT u AS repo_id, ['Dockerfile', 'svc/a/Dockerfile', 'svc/b/x/Dockerfile'][1 + i % 43] AS subject, 'warning' AS severity FROM e WHERE i % 43 < 3
    AND CASE WHEN i % 43 = 1 AND u % 3 = 0 THEN 18 + i % 6 < 22 WHEN u % 2 = 0 THEN 18 + i % 6 < 21 WHEN u % 3 = 0 THEN 18 + i % 6 < 22 ELSE false END""")(rules.go_version_conflict)
_rule("SELECT u AS repo_id, 'workspaces' AS subject, 'warning' AS severity FROM r WHERE u % 2 = 0 AND u % 3 <> 1 AND u % 4 <> 0")(rules.workspace_duplicate)
_rule("""SELECT DISTINCT u AS repo_id, p AS subject, 'warning' AS severity FROM (SELECT u, ['packages/*', 'libs/**', NULL, '{tools,libs}/x', NULL][1 + i % 47] AS p FROM e WHERE i % 47 < 5)
    WHERE p IS NOT NULL AND (u, p) NOT IN (SELECT u, CASE WHEN i % 37 < 3 THEN 'packages/*' WHEN i % 37 = 3 THEN '{tools,libs}/x' ELSE 'libs/**' END FROM e WHERE i % 37 BETWEEN 1 AND 4)""")(rules.workspace_pattern_empty)
_rule("""SELECT DISTINCT u AS repo_id, ['turbo.json', 'apps/a/turbo.json'][1 + i % 59] AS subject, CASE WHEN u % 3 = 0 THEN 'info' ELSE 'warning' END AS severity
    FROM e WHERE i % 59 < 2 AND i % 3 <> 0 AND (u % 3 = 0 OR u % 4 >= 2)""")(rules.turbo_pipeline)
_rule("SELECT DISTINCT u AS repo_id, ['compose.yml', 'docker/compose.yml'][1 + i % 61] AS subject, 'info' AS severity FROM e WHERE i % 61 < 2 AND i % 2 = 0")(rules.compose_version)
_rule(f"""SELECT DISTINCT u AS repo_id, {_list(ENV_PATHS)}[1 + i % 23] AS subject, 'warning' AS severity FROM e WHERE i % 23 < 4 AND i % 5 <> 0
    AND (u, {_list(ENV_PATHS)}[1 + i % 23]) NOT IN (SELECT u, path FROM fl)""")(rules.compose_env_file_missing)
_rule("SELECT u AS repo_id, '.gitignore' AS subject, 'warning' AS severity FROM r WHERE u % 2 = 0 AND u NOT IN (SELECT u FROM fl WHERE path = '.gitignore')")(rules.gitignore_missing)
_rule("""SELECT u AS repo_id, 'node_modules' AS subject, 'warning' AS severity FROM r WHERE u % 3 <> 0 AND u IN (SELECT u FROM fl WHERE path = '.gitignore')
    AND u IN (SELECT u FROM fl WHERE path = 'package.json') AND u NOT IN (SELECT u FROM fl WHERE path = '.pnp.cjs')""")(rules.gitignore_node_modules)
_rule("SELECT DISTINCT u AS repo_id, 'test' AS subject, 'info' AS severity FROM e WHERE i % 67 = 0 AND i % 2 = 0")(rules.test_placeholder)
_rule("""SELECT u AS repo_id, 'test' AS subject, 'info' AS severity FROM r WHERE u IN (SELECT u FROM fl WHERE path = 'package.json') AND (u % 2 = 0 OR u IN (SELECT u FROM fl WHERE path = 'src/index.test.ts'))
    AND u % 5 <> 0 AND u NOT IN (SELECT u FROM e WHERE i % 67 < 2)""")(rules.missing_test)
_rule("""SELECT u AS repo_id, 'lint' AS subject, 'info' AS severity FROM r WHERE u % 3 = 0 AND u % 7 <> 0 AND (u IN (SELECT u FROM fl WHERE path = 'package.json') OR u % 5 = 0)
    AND u NOT IN (SELECT u FROM e WHERE i % 67 = 2 OR i % 67 < 4 AND i % 2 = 1 AND i % 3 = 0)""")(rules.missing_lint)
_rule("""SELECT DISTINCT u AS repo_id, CASE WHEN i % 71 = 0 THEN '.eslintrc.json' ELSE 'apps/a/package.json#eslintConfig' END AS subject,
    CASE WHEN i % 71 = 1 THEN CASE WHEN u % 5 = 0 THEN 'warning' ELSE 'info' END WHEN u % 4 = 0 THEN 'info' WHEN u % 3 = 2 THEN 'error' WHEN u % 2 = 0 THEN 'info' ELSE 'warning' END AS severity
    FROM e WHERE i % 71 < 2 AND (i % 71 = 1 OR u % 4 = 0 OR u % 3 > 0)""")(rules.eslint_legacy)
_rule("""SELECT repo_id, subject, 'info' AS severity FROM (
    SELECT u AS repo_id, 'middleware.js' AS subject FROM fl WHERE path = 'middleware.js' AND u % 2 = 1
    UNION ALL SELECT u, path FROM fl WHERE path = 'apps/a/middleware.ts' AND u NOT IN (SELECT u FROM fl WHERE path = 'apps/a/src/proxy.ts')
    UNION ALL SELECT u, path FROM fl WHERE path = 'apps/b/src/middleware.ts' AND u % 3 = 0)""")(rules.next_middleware)


@_query(f"""WITH {_ENV}, x AS (SELECT DISTINCT repo_id FROM d WHERE kind = 'example' AND repo_id % 3 > 0), l AS (SELECT DISTINCT repo_id FROM d WHERE path = '.env' AND repo_id % 2 = 1),
    n AS (SELECT DISTINCT repo_id FROM v WHERE used AND NOT test_only AND required AND name NOT IN ('NODE_ENV', 'PORT'))
    SELECT repo_id, '.env.example' AS subject, CASE WHEN repo_id IN (FROM l) OR repo_id % 3 = 2 THEN 'warning' ELSE 'info' END AS severity FROM (SELECT DISTINCT user_id AS repo_id FROM events)
    WHERE repo_id NOT IN (FROM x) AND (repo_id IN (FROM l) OR repo_id IN (FROM n))""")
def rule_example_missing(spark, sf_dir):
    s = _env(spark, sf_dir) | {"projects": _sections(spark, sf_dir)["projects"]}
    s["env_files"] = s["env_files"].where("CASE kind WHEN 'example' THEN repo_id % 3 > 0 WHEN 'local' THEN repo_id % 2 = 1 ELSE true END")
    return rules.example_missing(s).select("repo_id", "subject", "severity")


#: code, the query with its findings, and the SQL for where it applies
_APPLIES = [
    ("PACKAGE_JSON_INVALID", "manifest_invalid", "u IN (SELECT u FROM fl WHERE path = 'package.json')"),
    ("ENV_EXAMPLE_REAL_SECRET", "example_real_secret", "u IN (SELECT u FROM e WHERE i % 31 = 0)"),
    ("PACKAGE_MANAGER_UNDECLARED", "manager_undeclared", "u % 5 <> 0 AND u IN (SELECT u FROM e WHERE i % 41 < 2)"),
    ("LOCKFILE_MISSING", "lockfile_missing", "u IN (SELECT u FROM e WHERE i % 37 = 0)"),
    ("NODE_VERSION_OUT_OF_RANGE", "node_out_of_range", "(u % 2 = 0 OR u % 3 = 0) AND u IN (SELECT u FROM e WHERE i % 29 < 3)"),
    ("GO_VERSION_CONFLICT", "go_version_conflict", "(u % 2 = 0 OR u % 3 = 0) AND u IN (SELECT u FROM e WHERE i % 43 < 3)"),
    ("WORKSPACE_DUPLICATE_CONFIG", "workspace_duplicate", "u % 2 = 0 AND u % 3 <> 1"),
    ("WORKSPACE_PATTERN_EMPTY", "workspace_pattern_empty", "u IN (SELECT u FROM e WHERE i % 47 < 5)"),
    ("TURBO_PIPELINE_KEY", "turbo_pipeline", "u IN (SELECT u FROM e WHERE i % 59 < 2)"),
    ("COMPOSE_VERSION_OBSOLETE", "compose_version", "u IN (SELECT u FROM e WHERE i % 61 < 2)"),
    ("COMPOSE_ENV_FILE_MISSING", "compose_env_file_missing", "u IN (SELECT u FROM e WHERE i % 61 < 2 OR i % 23 < 4)"),
    ("GITIGNORE_MISSING", "gitignore_missing", "u % 2 = 0"),
    ("GITIGNORE_NODE_MODULES", "gitignore_node_modules", "u IN (SELECT u FROM fl WHERE path = 'package.json') AND u IN (SELECT u FROM fl WHERE path = '.gitignore') AND u NOT IN (SELECT u FROM fl WHERE path = '.pnp.cjs')"),
    ("SCRIPT_TEST_PLACEHOLDER", "test_placeholder", "u IN (SELECT u FROM e WHERE i % 67 = 0)"),
    ("SCRIPT_MISSING_TEST", "missing_test", "u IN (SELECT u FROM fl WHERE path = 'package.json') AND (u % 2 = 0 OR u IN (SELECT u FROM fl WHERE path = 'src/index.test.ts'))"),
    ("SCRIPT_MISSING_LINT", "missing_lint", "u % 3 = 0 AND (u IN (SELECT u FROM fl WHERE path = 'package.json') OR u % 5 = 0 OR u % 7 = 0)"),
    ("ESLINT_LEGACY_CONFIG", "eslint_legacy", "u IN (SELECT u FROM e WHERE i % 71 < 2)"),
    ("NEXT_MIDDLEWARE_DEPRECATED", "next_middleware", "u IN (SELECT u FROM fl WHERE path LIKE '%middleware.%')"),
    ("CONFIG_PARSE_ERROR", "config_parse_error", "u IN (SELECT u FROM e WHERE i % 53 < 4 AND i % 2 = 0) OR u IN (SELECT u FROM fl WHERE path = 'package.json')"),
]
_STATUS = f"""WITH {_E}, f AS ({" UNION ALL ".join(f"SELECT DISTINCT repo_id AS u, '{code}' AS code FROM ({ORACLE_SQL['rule_' + name]})" for code, name, _ in _APPLIES)}),
    a AS ({" UNION ALL ".join(f"SELECT u, '{code}' AS code, {test} AS applies FROM r" for code, _, test in _APPLIES)})
    SELECT u AS repo_id, code, CASE WHEN code = 'TURBO_PIPELINE_KEY' AND u % 2 = 1 THEN 'disabled' WHEN NOT applies THEN 'skipped' WHEN (u, code) IN (SELECT u, code FROM f) THEN 'failed' ELSE 'passed' END AS status FROM a"""


@_query(_STATUS)
def project_rule_statuses(spark, sf_dir):
    """The rules that have their own query above, through the runner, with a setting of some repositories."""
    sections = {k: settled(v) if k in ("files", "projects") else v for k, v in _sections(spark, sf_dir).items()}
    ran = [r for r in rules.PROJECT_RULES if r.code in {code for code, *_ in _APPLIES}]
    repos = _read(spark, sf_dir, "events").select(F.col("user_id").alias("repo_id")).distinct()
    settings = repos.where("repo_id % 2 = 1").select("repo_id", F.explode(F.array(F.struct(F.lit("TURBO_PIPELINE_KEY").alias("code"), F.lit("off").alias("setting")), F.struct(F.lit("ENV_EXAMPLE_REAL_SECRET").alias("code"), F.lit("off").alias("setting")))).alias("s")).select("repo_id", "s.*")
    ignores = spark.createDataFrame([("GITIGNORE_MISSING", "no such*")], "code string, pattern string")
    return run_rules(ran, sections, repos, settings, ignores)[1].select("repo_id", "code", "status")
