"""Rules over manifests, lockfiles, workspaces, containers, scripts and tools, as joins of small fact tables.

Every section is keyed by repo_id. A rule reads only the columns that its docstring names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.functions import globs, paths, versions
from sparkquarry.operators import rules
from sparkquarry.operators.hierarchy import owner_join
from sparkquarry.operators.rules import Rule, finding
from sparkquarry.sources.compose import known_missing

#: Directories above a file that a walk goes down, at most.
MOST_WALKED = 20
#: Files that are read as configuration: one that parses lets its rule pass.
CONFIG_FILE = r"(?:\.(?:json|jsonc|ya?ml)|(?:^|/)go\.mod)$"
#: Fixed value: the test script that npm writes into a new manifest.
NPM_PLACEHOLDER = "no test specified"
#: File names of the two conventions for code in front of Next.js routes.
MIDDLEWARE_FILES, PROXY_FILES = ["middleware.ts", "middleware.js"], ["proxy.ts", "proxy.js"]
#: Commands of linters.
LINT_COMMANDS = ["eslint", "biome", "oxlint", "stylelint", "golangci-lint", "next lint", "ruff check"]
ROOT_MANIFEST = "package.json"


def _with_file(s: dict[str, DataFrame], *names: str) -> DataFrame:
    return s["files"].where(F.col("path").isin(list(names))).select("repo_id").distinct()


def _root(path: Column) -> Column:
    return ~path.contains("/")


def manifest_invalid(s: dict[str, DataFrame]) -> DataFrame:
    """The root manifest does not parse: warnings (file, kind)."""
    w = s["warnings"].where((F.col("kind") == "parse") & (F.col("file") == ROOT_MANIFEST)).select("repo_id", "file").distinct()
    return finding(w, "PACKAGE_JSON_INVALID", "configuration", "error", F.col("file"), F.array("file"))


def config_parse_error(s: dict[str, DataFrame]) -> DataFrame:
    """One finding for each other file that does not parse; of warnings without a file one for each message."""
    w = s["warnings"].where((F.col("kind") == "parse") & ~F.col("file").eqNullSafe(ROOT_MANIFEST))
    w = w.groupBy("repo_id", F.coalesce("file", F.substring("message", 1, 200)).alias("subject")).agg(F.max("file").alias("file"))
    return finding(w, "CONFIG_PARSE_ERROR", "configuration", "warning", F.col("subject"), F.array_compact(F.array("file")))


def example_real_secret(s: dict[str, DataFrame]) -> DataFrame:
    """A credential's shape in an example file: example_values (name, path, credential)."""
    v = s["example_values"].where("credential IS NOT NULL").groupBy("repo_id", "name").agg(F.array_sort(F.collect_set("path")).alias("files"))
    return finding(v, "ENV_EXAMPLE_REAL_SECRET", "security", "error", F.col("name"), F.col("files"))


def example_missing(s: dict[str, DataFrame]) -> DataFrame:
    """No example file, but code needs variables or a local file exists; for libraries and tools without a local file it is a hint."""
    example = s["env_files"].where("kind = 'example'").select("repo_id").distinct()
    local = s["env_files"].where((F.col("kind") == "local") & (paths.base_name(F.col("path")) != ".envrc")).groupBy("repo_id").agg(F.min(F.struct(~_root(F.col("path")), "path"))["path"].alias("local"))
    needed = s["variables"].where("used AND NOT test_only AND NOT fallback").join(s["platform"], "name", "left_anti").groupBy("repo_id").agg(F.count("*").alias("needed"))
    rows = local.join(needed, "repo_id", "full_outer").join(example, "repo_id", "left_anti").join(s["projects"].select("repo_id", "type"), "repo_id", "left")
    directory = F.when(F.col("local").contains("/"), F.concat(paths.dir_of(F.col("local")), F.lit("/"))).otherwise("")
    hint = F.col("local").isNull() & F.coalesce(F.col("type").isin("library", "cli"), F.lit(False))
    return finding(rows, "ENV_EXAMPLE_MISSING", "environment", F.when(hint, "info").otherwise("warning"), F.concat(F.coalesce(directory, F.lit("")), F.lit(".env.example")), F.array_compact(F.array("local")))


def manager_undeclared(s: dict[str, DataFrame]) -> DataFrame:
    """A lockfile, but neither the manifest nor a tool file names a manager: locks (manager, path), projects (declared)."""
    locks = s["locks"].groupBy("repo_id").agg(F.array_sort(F.collect_set("path")).alias("locks"))
    rows = locks.join(s["projects"].where("declared IS NULL AND has_manifest"), "repo_id", "left_semi")
    return finding(rows, "PACKAGE_MANAGER_UNDECLARED", "package-manager", "info", F.lit(ROOT_MANIFEST), F.concat(F.array(F.lit(ROOT_MANIFEST)), "locks"))


def lockfile_missing(s: dict[str, DataFrame]) -> DataFrame:
    """Dependencies of the root or a workspace package and no lockfile, not on purpose: packages (role, dependencies), projects (unlocked)."""
    wanting = s["packages"].where("role IN ('root', 'workspace') AND dependencies > 0").select("repo_id").distinct()
    rooted = s["packages"].where("role = 'root'").select("repo_id").distinct()
    rows = wanting.join(rooted, "repo_id", "left_semi").join(s["locks"], "repo_id", "left_anti").join(s["projects"].where("unlocked"), "repo_id", "left_anti")
    return finding(rows, "LOCKFILE_MISSING", "package-manager", "info", F.lit(ROOT_MANIFEST), F.array(F.lit(ROOT_MANIFEST)))


def node_out_of_range(s: dict[str, DataFrame]) -> DataFrame:
    """Pins (path, version) that the engines (dir, range) of the deepest directory above them do not allow."""
    pins = owner_join(s["node_pins"], s["engines"], default=None).join(s["engines"].select("repo_id", F.col("dir").alias("owner"), "range"), ["repo_id", "owner"])
    off = pins.where(~versions.fits_range(F.col("version"), F.col("range"))).groupBy("repo_id", "path").agg(F.min("owner").alias("owner"))
    manifest = F.when(F.col("owner") == ".", ROOT_MANIFEST).otherwise(F.concat("owner", F.lit("/" + ROOT_MANIFEST)))
    return finding(off, "NODE_VERSION_OUT_OF_RANGE", "runtime", "warning", F.col("path"), F.array_sort(F.array("path", manifest)))


def go_version_conflict(s: dict[str, DataFrame]) -> DataFrame:
    """Go tools (path, version) older than the directive of the module (dir, go) that owns them; the only module owns all."""
    one = s["go_modules"].groupBy("repo_id").agg(F.when(F.count("*") == 1, F.min("dir")).alias("only"))
    tools = owner_join(s["go_tools"], s["go_modules"], default=None).join(one, "repo_id").withColumn("owner", F.coalesce("owner", "only"))
    rows = tools.join(s["go_modules"].select("repo_id", F.col("dir").alias("owner"), "go"), ["repo_id", "owner"])
    rows = rows.where(versions.is_go_older(F.col("version"), F.col("go"))).groupBy("repo_id", "path").agg(F.min("owner").alias("owner"))
    module = F.when(F.col("owner") == ".", "go.mod").otherwise(F.concat("owner", F.lit("/go.mod")))
    return finding(rows, "GO_VERSION_CONFLICT", "runtime", "warning", F.col("path"), F.array("path", module))


def workspace_duplicate(s: dict[str, DataFrame]) -> DataFrame:
    """Both declarations exist: workspaces (source, patterns). Without packages in pnpm's file it only matters where pnpm installs."""
    of = lambda source, name: s["workspaces"].where(F.col("source") == source).select("repo_id", F.col("patterns").alias(name))
    both = of("pnpm-workspace.yaml", "pnpm").join(of(ROOT_MANIFEST, "manifest"), "repo_id").join(s["projects"].select("repo_id", "declared"), "repo_id", "left")
    other = F.coalesce(F.col("declared").isin("npm", "yarn", "bun"), F.lit(False))
    files = F.array(F.lit(ROOT_MANIFEST), F.lit("pnpm-workspace.yaml"))
    return finding(both.where((F.size("pnpm") > 0) | ~other), "WORKSPACE_DUPLICATE_CONFIG", "workspace", "warning", F.lit("workspaces"), files)


def workspace_pattern_empty(s: dict[str, DataFrame]) -> DataFrame:
    """Patterns (file, pattern) that no package directory (dir) matches and that do not lead into an ignored directory."""
    pattern = F.trim("pattern")
    p = s["workspace_patterns"].select("repo_id", "file", pattern.alias("pattern")).where((F.col("pattern") != "") & ~F.col("pattern").startswith("!")).distinct()
    hit = p.join(s["packages"].select("repo_id", "dir").distinct(), "repo_id").where(F.regexp_like("dir", globs.glob_regex_of(F.col("pattern")))).select("repo_id", "pattern").distinct()
    p = p.join(hit, ["repo_id", "pattern"], "left_anti").where(~paths.is_ignored_dir(F.concat(paths.static_prefix(F.col("pattern")), F.lit("/x"))))
    return finding(p, "WORKSPACE_PATTERN_EMPTY", "workspace", "warning", F.substring("pattern", 1, 80), F.array("file"))


def turbo_pipeline(s: dict[str, DataFrame]) -> DataFrame:
    """Turborepo configs (path, has_pipeline) with the old key, from version 2 of the tool on (projects: turbo) or where it is not known."""
    c = s["turbo_configs"].where("has_pipeline").join(s["projects"].select("repo_id", "turbo"), "repo_id", "left").where("turbo IS NULL OR turbo >= 2")
    return finding(c, "TURBO_PIPELINE_KEY", "workspace", F.when(F.col("turbo").isNull(), "info").otherwise("warning"), F.col("path"), F.array("path"))


def compose_version(s: dict[str, DataFrame]) -> DataFrame:
    """Compose documents (path, has_version) with a version key at the top."""
    return finding(s["compose_files"].where("has_version"), "COMPOSE_VERSION_OBSOLETE", "docker", "info", F.col("path"), F.array("path"))


def compose_env_file_missing(s: dict[str, DataFrame]) -> DataFrame:
    """Required env files (path) of services that are certainly missing: env_file_refs (compose_file, service, path, required). ``listing``, if given, has
    ignored files and directories as well (path, ignored, directory); deeper paths than the walk's and those under hidden directories may be there."""
    listing = s["listing"] if "listing" in s else s["files"].select("repo_id", "path", F.lit(False).alias("ignored"), F.lit(False).alias("directory"))
    r = known_missing(s["env_file_refs"].where("NOT required <=> false"), listing, most_depth=MOST_WALKED)
    r = r.groupBy("repo_id", "path").agg(F.array_sort(F.collect_set("compose_file")).alias("files"))
    return finding(r, "COMPOSE_ENV_FILE_MISSING", "docker", "warning", F.col("path"), F.col("files"))


def gitignore_missing(s: dict[str, DataFrame]) -> DataFrame:
    """The top of a repository (projects: git_root) has no ignore file."""
    rows = s["projects"].where("git_root").select("repo_id").join(_with_file(s, ".gitignore"), "repo_id", "left_anti")
    return finding(rows, "GITIGNORE_MISSING", "git", "warning", F.lit(".gitignore"), F.array().cast("array<string>"))


def _modules_at_risk(s: dict[str, DataFrame]) -> DataFrame:
    """Repositories with a manifest and an ignore file whose packages lie in node_modules."""
    rows = _with_file(s, ROOT_MANIFEST).join(_with_file(s, ".gitignore"), "repo_id", "left_semi")
    return rows.join(_with_file(s, ".pnp.cjs", ".pnp.js", ".pnp.loader.mjs"), "repo_id", "left_anti")


def gitignore_node_modules(s: dict[str, DataFrame]) -> DataFrame:
    """The ignore file leaves node_modules in: ignored_dirs (dir)."""
    rows = _modules_at_risk(s).join(s["ignored_dirs"].where("dir IN ('node_modules', '.')"), "repo_id", "left_anti")
    return finding(rows, "GITIGNORE_NODE_MODULES", "git", "warning", F.lit("node_modules"), F.array(F.lit(".gitignore")))


def test_placeholder(s: dict[str, DataFrame]) -> DataFrame:
    """The root's test script is the one that npm writes and that fails: root_scripts (name, command)."""
    rows = s["root_scripts"].where((F.col("name") == "test") & F.col("command").contains(NPM_PLACEHOLDER) & F.col("command").rlike(r"exit\s+1"))
    return finding(rows, "SCRIPT_TEST_PLACEHOLDER", "scripts", "info", F.lit("test"), F.array(F.lit(ROOT_MANIFEST)))


def _test_setup(s: dict[str, DataFrame]) -> DataFrame:
    runners = s["tools"].where("category = 'test'").select("repo_id")
    return _with_file(s, ROOT_MANIFEST).join(runners.unionByName(s["files"].where(paths.is_test_file(F.col("path"))).select("repo_id")).distinct(), "repo_id", "left_semi")


def missing_test(s: dict[str, DataFrame]) -> DataFrame:
    """Runners (tools: category) or test files, but neither a test script nor a test task (tasks: name)."""
    have = s["root_scripts"].where("name = 'test' OR name LIKE 'test:%'").select("repo_id").unionByName(s["tasks"].where("name = 'test'").select("repo_id"))
    return finding(_test_setup(s).join(have, "repo_id", "left_anti"), "SCRIPT_MISSING_TEST", "scripts", "info", F.lit("test"), F.array(F.lit(ROOT_MANIFEST)))


def missing_lint(s: dict[str, DataFrame]) -> DataFrame:
    """A linter is set up, but no script or task runs it; without a manifest or task file there is no place for one."""
    linters = s["tools"].where("category = 'lint'").select("repo_id").distinct()
    command = F.col("command").rlike(r"(?:^|[\s;&|/])(?:" + "|".join(c.replace(" ", r"\s+") for c in LINT_COMMANDS) + r")(?:\s|$)")
    runs = s["root_scripts"].where(F.col("name").rlike("^lint(?::|$)") | command).select("repo_id").unionByName(s["tasks"].where("name = 'lint'").select("repo_id"))
    place = _with_file(s, ROOT_MANIFEST).withColumn("manifest", F.lit(True)).unionByName(s["tasks"].select("repo_id", F.lit(False).alias("manifest")))
    rows = linters.join(runs, "repo_id", "left_anti").join(place.groupBy("repo_id").agg(F.bool_or("manifest").alias("manifest")), "repo_id")
    return finding(rows, "SCRIPT_MISSING_LINT", "scripts", "info", F.lit("lint"), F.when(F.col("manifest"), F.array(F.lit(ROOT_MANIFEST))).otherwise(F.array().cast("array<string>")))


def eslint_legacy(s: dict[str, DataFrame]) -> DataFrame:
    """Legacy configs (dir, path, in_manifest) by the linter's major in that directory: eslint (dir, major, opted_out)."""
    c = s["eslint_configs"].join(s["eslint"], ["repo_id", "dir"], "left").where("major IS NULL OR major >= 9")
    hint = F.col("major").isNull() | ((F.col("major") == 9) & F.coalesce("opted_out", F.lit(False)))
    subject = F.when(F.col("in_manifest"), F.concat("path", F.lit("#eslintConfig"))).otherwise(F.col("path"))
    return finding(c, "ESLINT_LEGACY_CONFIG", "tooling", F.when(hint, "info").when(F.col("major") >= 10, "error").otherwise("warning"), subject, F.array("path"))


def next_middleware(s: dict[str, DataFrame]) -> DataFrame:
    """Apps (dir, major) from Next.js 16 on with a middleware file and no proxy file, in the directory or its src."""
    apps = s["next_apps"].where("major >= 16").select("repo_id", "dir")
    base = F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("dir").alias("at")), F.struct(F.lit(1).alias("rank"), F.when(F.col("dir") == ".", "src").otherwise(F.concat("dir", F.lit("/src"))).alias("at"))))
    files = s["files"].select("repo_id", "path", paths.dir_of(F.col("path")).alias("at"), paths.base_name(F.col("path")).alias("name")).where(F.col("name").isin(MIDDLEWARE_FILES + PROXY_FILES))
    found = apps.select("repo_id", "dir", base.alias("b")).select("repo_id", "dir", "b.rank", "b.at").join(files, ["repo_id", "at"])
    order = F.struct("rank", F.when(F.col("name") == MIDDLEWARE_FILES[0], 0).otherwise(1).alias("nth"), "path")
    rows = found.groupBy("repo_id", "dir").agg(F.bool_or(F.col("name").isin(PROXY_FILES)).alias("proxy"), F.min(F.when(F.col("name").isin(MIDDLEWARE_FILES), order))["path"].alias("path")).where("NOT proxy AND path IS NOT NULL")
    return finding(rows, "NEXT_MIDDLEWARE_DEPRECATED", "tooling", "info", F.col("path"), F.array("path"))


def _any(*names: str):
    """Repositories with a row in one of the sections."""
    return lambda s: s[names[0]].select("repo_id").unionByName(s[names[1]].select("repo_id")) if len(names) > 1 else s[names[0]].select("repo_id")


def _parsed(s: dict[str, DataFrame]) -> DataFrame:
    """Where something did not parse, or there is a file that did."""
    return s["warnings"].where("kind = 'parse'").select("repo_id").unionByName(s["files"].where(F.col("path").rlike(CONFIG_FILE)).select("repo_id"))


#: The rules, each with where it applies; parse errors come last, when all warnings are known.
PROJECT_RULES = [
    Rule("PACKAGE_JSON_INVALID", "configuration", lambda s: _with_file(s, ROOT_MANIFEST), manifest_invalid),
    Rule("ENV_EXAMPLE_REAL_SECRET", "security", _any("example_values"), example_real_secret),
    Rule("ENV_EXAMPLE_MISSING", "environment", lambda s: s["env_files"].select("repo_id").unionByName(s["variables"].where("used AND NOT test_only").select("repo_id")), example_missing),
    Rule("PACKAGE_MANAGER_UNDECLARED", "package-manager", lambda s: s["projects"].where("has_manifest").join(s["locks"].where(_root(F.col("path"))), "repo_id", "left_semi").select("repo_id"), manager_undeclared),
    Rule("LOCKFILE_MISSING", "package-manager", lambda s: s["packages"].where("role = 'root'").select("repo_id"), lockfile_missing),
    Rule("NODE_VERSION_OUT_OF_RANGE", "runtime", lambda s: s["node_pins"].join(s["engines"], "repo_id", "left_semi").select("repo_id"), node_out_of_range),
    Rule("GO_VERSION_CONFLICT", "runtime", lambda s: s["go_tools"].join(s["go_modules"], "repo_id", "left_semi").select("repo_id"), go_version_conflict),
    Rule("WORKSPACE_DUPLICATE_CONFIG", "workspace", lambda s: s["workspaces"].groupBy("repo_id").agg(F.count_distinct("source").alias("n")).where("n > 1"), workspace_duplicate),
    Rule("WORKSPACE_PATTERN_EMPTY", "workspace", _any("workspace_patterns"), workspace_pattern_empty),
    Rule("TURBO_PIPELINE_KEY", "workspace", _any("turbo_configs"), turbo_pipeline),
    Rule("COMPOSE_VERSION_OBSOLETE", "docker", _any("compose_files"), compose_version),
    Rule("COMPOSE_ENV_FILE_MISSING", "docker", _any("compose_files", "env_file_refs"), compose_env_file_missing),
    Rule("GITIGNORE_MISSING", "git", lambda s: s["projects"].where("git_root").select("repo_id"), gitignore_missing),
    Rule("GITIGNORE_NODE_MODULES", "git", _modules_at_risk, gitignore_node_modules),
    Rule("SCRIPT_TEST_PLACEHOLDER", "scripts", lambda s: s["root_scripts"].where("name = 'test'").select("repo_id"), test_placeholder),
    Rule("SCRIPT_MISSING_TEST", "scripts", _test_setup, missing_test),
    Rule("SCRIPT_MISSING_LINT", "scripts", lambda s: s["tools"].where("category = 'lint'").select("repo_id").join(_with_file(s, ROOT_MANIFEST).unionByName(s["tasks"].select("repo_id")), "repo_id", "left_semi"), missing_lint),
    Rule("ESLINT_LEGACY_CONFIG", "tooling", _any("eslint_configs"), eslint_legacy),
    Rule("NEXT_MIDDLEWARE_DEPRECATED", "tooling", lambda s: s["next_apps"].join(s["files"].where(paths.base_name(F.col("path")).isin(MIDDLEWARE_FILES)), "repo_id", "left_semi").select("repo_id"), next_middleware),
    Rule("CONFIG_PARSE_ERROR", "configuration", _parsed, config_parse_error),
]


def _node_conflicts(s: dict[str, DataFrame]) -> DataFrame:
    return rules.version_conflicts(s["node_scopes"])


def _vulnerable_runtimes(s: dict[str, DataFrame]) -> DataFrame:
    """Pins (runtime, version, path) behind security releases of their line: security_fixes (runtime, fix, severity)."""
    late = rules.missed_fixes(s["runtime_pins"], s["security_fixes"])
    rows = s["runtime_pins"].join(late, ["runtime", "version"]).groupBy("repo_id", "runtime", "version").agg(F.array_sort(F.collect_set("path")).alias("files"), F.max("worst").alias("worst"))
    return finding(rows, "RUNTIME_VULNERABLE", "security", F.when(F.col("worst") >= 2, "error").otherwise("warning"), F.concat_ws("@", "runtime", "version"), F.col("files"))


def _vulnerable_packages(s: dict[str, DataFrame]) -> DataFrame:
    """Locked packages (ecosystem, name, version, lockfiles) with advisories (ecosystem, name, version, fixed)."""
    keys = ["ecosystem", "name", "version"]
    rows = s["locked"].join(rules.fix_all(s["locked"].select(*keys).distinct(), s["advisories"]), keys)
    return finding(rows, "DEPENDENCY_VULNERABLE", "security", "warning", F.concat_ws("@", "name", "version"), F.col("lockfiles"))


#: All rules: those above, and those over variables, env files, published ports, pins and locked packages; parse errors stay last.
ALL_RULES = [
    *PROJECT_RULES[:-1],
    Rule("ENV_UNDOCUMENTED", "environment", lambda s: s["env_files"].where("kind = 'example'").select("repo_id"), rules.env_undocumented),
    Rule("ENV_LOCAL_ONLY", "environment", lambda s: s["env_files"].where("kind = 'local'").select("repo_id"), rules.env_local_only),
    Rule("ENV_UNUSED", "environment", lambda s: s["env_files"].where("kind = 'example'").select("repo_id"), rules.env_unused),
    Rule("ENV_MISSING_LOCAL", "environment", lambda s: s["env_files"].where("kind = 'local'").select("repo_id"), rules.env_missing_local),
    Rule("ENV_PUBLIC_SECRET", "security", _any("variables"), rules.env_public_secret),
    Rule("ENV_FILE_NOT_IGNORED", "security", _any("env_files"), rules.env_not_ignored),
    Rule("TRACKED_ENV_FILE", "security", _any("env_files"), rules.env_tracked),
    Rule("DOCKER_PORT_CONFLICT", "docker", _any("bindings"), lambda s: rules.port_conflicts(s["bindings"])),
    Rule("ENV_PORT_MISMATCH", "docker", lambda s: s["endpoints"].join(s["publishers"], "repo_id", "left_semi").select("repo_id"), lambda s: rules.endpoint_mismatch(s["endpoints"], s["publishers"])),
    Rule("NODE_VERSION_CONFLICT", "runtime", _any("node_scopes"), _node_conflicts),
    Rule("RUNTIME_EOL", "runtime", _any("node_scopes"), lambda s: rules.end_of_life(s["node_scopes"], s["node_eol"], s["today"].first()[0])),
    Rule("RUNTIME_VULNERABLE", "security", _any("runtime_pins"), _vulnerable_runtimes),
    Rule("DEPENDENCY_VULNERABLE", "security", _any("locked"), _vulnerable_packages),
    Rule("MULTIPLE_LOCKFILES", "package-manager", _any("locks"), lambda s: rules.multiple_lockfiles(s["locks"])),
    Rule("PACKAGE_MANAGER_MISMATCH", "package-manager", lambda s: s["projects"].where("has_manifest").join(s["locks"].where(_root(F.col("path"))), "repo_id", "left_semi").select("repo_id"), lambda s: rules.manager_mismatch(s["projects"].where("declared IS NOT NULL").select("repo_id", F.col("declared").alias("manager")), s["locks"])),
    Rule("GO_SUM_MISSING", "tooling", _any("go_requires"), lambda s: rules.missing_sums(s["go_requires"], s["go_local"], s["go_sums"])),
    PROJECT_RULES[-1],
]
