"""All rules through the runner, settings of repositories, unused variables and port mismatches."""

import pytest

from sparkquarry.operators import rules
from sparkquarry.operators.project_rules import ALL_RULES

SCHEMAS = {
    "files": ("path string", [("a", "package.json"), ("a", ".gitignore"), ("a", "src/x.test.ts"), ("a", "middleware.ts"), ("b", "readme")]),
    "projects": ("type string, declared string, has_manifest boolean, unlocked boolean, turbo long, git_root boolean", [("a", "cli", "yarn", True, False, 2, True)]),
    "warnings": ("kind string, file string, message string", [("a", "limit", None, "m")]), "example_values": ("name string, path string, credential string", [("a", "K", ".env.example", "npm-token")]),
    "locks": ("manager string, path string", [("a", "npm", "package-lock.json"), ("a", "pnpm", "pnpm-lock.yaml")]), "packages": ("dir string, role string, dependencies long", [("a", ".", "root", 1)]),
    "node_pins": ("path string, version string", [("a", ".nvmrc", "18.0.0")]), "engines": ("dir string, range string", [("a", ".", ">=20")]), "go_tools": ("path string, version string", []), "go_modules": ("dir string, go string", []),
    "workspaces": ("source string, patterns array<string>", []), "workspace_patterns": ("file string, pattern string", []), "turbo_configs": ("path string, has_pipeline boolean", [("a", "turbo.json", True)]), "compose_files": ("path string, has_version boolean", [("a", "compose.yml", True)]),
    "env_file_refs": ("compose_file string, service string, path string, required boolean", [("a", "compose.yml", "s", "node_modules/x.env", True), ("a", "compose.yml", "s", "gone.env", True)]), "ignored_dirs": ("dir string", []),
    "root_scripts": ("name string, command string", []), "tools": ("category string", [("a", "lint")]), "tasks": ("name string", []), "eslint_configs": ("dir string, path string, in_manifest boolean", []), "eslint": ("dir string, major long, opted_out boolean", []),
    "next_apps": ("dir string, major long", [("a", ".", 16), ("b", ".", 16)]), "definitions": ("name string, path string, kind string", [("a", "LOCAL", ".env", "local"), ("a", "OLD", ".env.example", "example"), ("a", "ARG", ".env.example", "example"), ("a", "IN_DIR", "svc/.env.example", "example")]),
    "env_files": ("path string, kind string, variables long, ignored boolean, tracked boolean, credential boolean", [("a", ".env", "local", 1, False, False, False), ("a", ".env.example", "example", 3, False, True, False)]),
    "bindings": ("project string, service string, file string, host_ip string, port int, protocol string, profiled boolean", [("a", ".", s, "compose.yml", None, 80, "tcp", False) for s in ("x", "y")]),
    "endpoints": ("name string, file string, scheme string, port int, local boolean", [("a", "DB", ".env", "Postgresql+asyncpg", 5433, True), ("a", "DB", ".env.test", "postgres", 5432, True), ("a", "FAR", ".env", "postgres", 1, False), ("a", "CACHE", ".env", "rediss", 1, True), ("a", "MY", ".env", "mysql", 1, True), ("a", "WEB", ".env", "http", 1, True)]),
    "publishers": ("service string, source string, technology string, host string", [("a", "db", "compose.yml", "postgresql", "5432"), ("a", "kv", "compose.yml", "valkey", "${P}"), ("a", "my", "x.yml", "mariadb", "3306"), ("a", "my", "x.yml", "mariadb", None)]),
    "node_scopes": ("path string, version string, major long, scope string", [("a", ".nvmrc", "18.0.0", 18, "."), ("a", "Dockerfile", "20.0.0", 20, ".")]), "node_eol": ("", []), "runtime_pins": ("runtime string, version string, path string", [("a", "node", "20.0.0", ".nvmrc")]),
    "locked": ("ecosystem string, name string, version string, lockfiles array<string>", [("a", "npm", "p", "1.0.0", ["l"])]), "go_requires": ("dir string, module string, indirect boolean", [("a", ".", "x/y", False)]), "go_local": ("module string", []), "go_sums": ("dir string", []),
    "build_args": ("name string", [("a", "ARG")]), "env_file_dirs": ("dir string", [("a", "svc")]),
}


@pytest.fixture(scope="module")
def sections(spark):
    s = {k: spark.createDataFrame(rows, "repo_id string" + (f", {cols}" if cols else "")) for k, (cols, rows) in SCHEMAS.items()}
    uses = spark.createDataFrame([("a", "USED", "src/a.ts", True, False), ("a", "NEXT_PUBLIC_SECRET", "src/a.ts", True, False)], "repo_id string, name string, path string, required boolean, test boolean")
    s |= {"variables": rules.merge_env(s["definitions"], uses), "platform": spark.createDataFrame([("CI",)], "name string"), "node_eol": spark.sql("SELECT 18L AS major, DATE '2025-04-30' AS eol"), "today": spark.sql("SELECT '2026-09-01'")}
    s |= {"security_fixes": spark.createDataFrame([("node", "20.1.0", "high")], "runtime string, fix string, severity string"), "advisories": spark.createDataFrame([("npm", "p", "1.0.0", "1.0.1")], "ecosystem string, name string, version string, fixed string")}
    return s


def test_every_rule_has_a_status(spark, sections):
    assert len(ALL_RULES) == 36 == len({r.code for r in ALL_RULES}) and ALL_RULES[-1].code == "CONFIG_PARSE_ERROR"
    repos = spark.createDataFrame([("a",), ("b",)], "repo_id string")
    settings = spark.createDataFrame([("a", "ENV_EXAMPLE_REAL_SECRET", "off"), ("a", "TRACKED_ENV_FILE", "error"), ("a", "TURBO_PIPELINE_KEY", "off"), ("b", "GITIGNORE_MISSING", "off")], "repo_id string, code string, setting string")
    ignores = spark.createDataFrame([("a", "ENV_PUBLIC_SECRET", "*"), ("a", "ENV_LOCAL_ONLY", "LO*")], "repo_id string, code string, pattern string")
    found, checks = rules.run_rules(ALL_RULES, sections, repos, settings, ignores)
    status = {(r.repo_id, r.code): r.status for r in checks.collect()}
    assert len(status) == 72
    of = lambda s: {code for (repo, code), x in status.items() if repo == "a" and x == s}
    assert of("disabled") == {"TURBO_PIPELINE_KEY"} and status["b", "GITIGNORE_MISSING"] == "disabled"
    assert of("failed") == {
        "ENV_EXAMPLE_REAL_SECRET", "NODE_VERSION_OUT_OF_RANGE", "COMPOSE_VERSION_OBSOLETE", "COMPOSE_ENV_FILE_MISSING", "GITIGNORE_NODE_MODULES", "SCRIPT_MISSING_TEST", "SCRIPT_MISSING_LINT", "NEXT_MIDDLEWARE_DEPRECATED", "ENV_UNDOCUMENTED",
        "ENV_UNUSED", "ENV_PUBLIC_SECRET", "ENV_FILE_NOT_IGNORED", "DOCKER_PORT_CONFLICT", "ENV_PORT_MISMATCH", "NODE_VERSION_CONFLICT", "RUNTIME_EOL", "RUNTIME_VULNERABLE", "DEPENDENCY_VULNERABLE", "MULTIPLE_LOCKFILES", "PACKAGE_MANAGER_MISMATCH", "GO_SUM_MISSING",
    }
    assert of("skipped") == {"GO_VERSION_CONFLICT", "WORKSPACE_DUPLICATE_CONFIG", "WORKSPACE_PATTERN_EMPTY", "SCRIPT_TEST_PLACEHOLDER", "ESLINT_LEGACY_CONFIG"}
    rows = {(r.code, r.subject): r for r in found.collect()}
    assert [s for c, s in rows if c == "COMPOSE_ENV_FILE_MISSING"] == ["gone.env"] and [s for c, s in rows if c == "ENV_UNUSED"] == ["OLD"]
    # a pattern of the repository hides no finding of a security rule
    assert rows["ENV_LOCAL_ONLY", "LOCAL"].ignored and not rows["ENV_PUBLIC_SECRET", "NEXT_PUBLIC_SECRET"].ignored
    mismatch = {s: sorted(r.files) for (c, s), r in rows.items() if c == "ENV_PORT_MISMATCH"}
    assert mismatch == {"DB": [".env", "compose.yml"], "MY": [".env", "x.yml"]}
    # without another file that parses or a warning of that kind the rule is skipped, and one repository has neither
    assert status["a", "CONFIG_PARSE_ERROR"] == "passed" and status["b", "CONFIG_PARSE_ERROR"] == "skipped" and status["b", "NEXT_MIDDLEWARE_DEPRECATED"] == "skipped"
