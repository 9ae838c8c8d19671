"""Selections, orders, addresses and JSON documents on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from sparkquarry import sinks
from sparkquarry.functions import addresses
from sparkquarry.operators import selection


def _rows(spark, columns, *rows):
    return spark.createDataFrame([("r", *r) if isinstance(r, tuple) else ("r", r) for r in rows], "repo_id string, " + columns)


def _each(spark, of, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", of(F.col("v")).alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


@pytest.mark.parametrize("raw,want", [
    ("/users/[id]", ("/users/:id", [])), ("/[...slug]", ("/*slug", [])), ("/a/[[...rest]]", ("/a/*rest", ["optional catch-all"])), ("/[[lang]]/x", ("/:lang/x", ["optional parameter"])), ("/users/{id:[0-9]{4}}", ("/users/:id", [])), ("/f/{path...}", ("/f/*path", [])),
    ("/x/{$}", ("/x", [])), ("/users{/:id}", ("/users/:id", ["optional segment"])), ("/:id(\\d+)?/y", ("/:id/y", ["optional parameter"])), ("//a///b/", ("/a/b", [])), ("", ("/", [])), ("files/*path", ("/files/*path", [])), ("/a:b", ("/a:b", [])), ("/{open", ("/{open", [])), ("/[x", ("/[x", [])),
])
def test_route_paths(raw, want):
    assert addresses.read_route(raw) == want


def test_patterns_and_names(spark):
    assert [r and tuple(r) for r in _each(spark, addresses.serve_mux_pattern, ["GET /a", "/b/{x}", "host/x", "ANY /c", "PATCH   /d", "LIST /e", "", None])] == [("GET", "/a"), ("ANY", "/b/{x}"), None, None, ("PATCH", "/d"), None, None, None]
    assert _each(spark, addresses.upper_snake, ["apiKey", "APIKey", "my-key.x", "URL", "v2Token"]) == ["API_KEY", "API_KEY", "MY_KEY_X", "URL", "V2_TOKEN"]
    assert _each(spark, lambda c: addresses.clip_command(c, 12), ["short", "one two three four", "say \"a b c d\" x", "x" * 20, "echo 'a' bcdef", None]) == ["short", "one two …", "say …", "…", "echo 'a' …", None]
    routes = spark.createDataFrame([("/[a]",), (None,)], "v string").select(addresses.route_path(F.col("v")).alias("p")).collect()
    assert [r.p.path for r in routes] == ["/:a", None]


def test_addresses(spark):
    urls = {
        "github:a/b": "https://github.com/a/b", "gist:1": "https://gist.github.com/1", "a/b": "https://github.com/a/b", "gitlab.com/g/p": "https://gitlab.com/g/p", "git+https://u:p@h.x/a.git": "https://h.x/a", "git@github.com:a/b.git": "https://github.com/a/b",
        "ssh://git@github.com:a/b.git": "https://github.com/a/b", "git://h.x/a/": "https://h.x/a", "https://h.x/a?t=1#f": "https://h.x/a", "ssh://git@h.x:22/a": "https://h.x:22/a", "not a url": None, "": None, None: None,
    }
    assert _each(spark, addresses.repository_url, list(urls)) == list(urls.values())
    hosts = {"https://u@GitHub.com:443/x": "github.com", "git@ssh.github.com:a/b": "ssh.github.com", "C:\\x": None, "/srv/x": None, "ssh://[::1]:22/x": "[::1]", "h:p": None}
    assert _each(spark, addresses.remote_host, list(hosts)) == list(hosts.values())
    assert _each(spark, addresses.remote_provider, ["git@github.com:a/b", "https://x.visualstudio.com/p", "https://www.gitlab.com/a", "https://other.org/x"]) == ["github", "azure", "gitlab", None]
    assert _each(spark, addresses.shown_remote, ["https://u:t@h/x?k=1", "git@h.x:a/b", "file:///home/me/repo.git", "/home/me/r", "D:\\a\\b", "tok en:pw@h/x"]) == ["https://h/x", "git@h.x:a/b", "file://…/repo.git", "…/r", "…/b", "h/x"]


def test_what_is_read(spark):
    files = _rows(spark, "path string", "a.ts", "b.ts", "web/c.vue", "dist/d.js", "e.d.ts", "f.py", ".env", "web/.env.local", "test/.env", "deploy/x.env", "a/b/c/d/.env", "svc/.env")
    packages = _rows(spark, "dir string", "web")
    got = {(r.path, r.package) for r in selection.source_files(files, packages).collect()}
    assert got == {("a.ts", "."), ("b.ts", "."), ("web/c.vue", "web")} and {r.path for r in selection.source_files(files, packages, most=1).collect()} == {"a.ts"}
    named = _rows(spark, "path string", "deploy/compose.yml", "test/compose.yml")
    assert {r.path for r in selection.env_files(files, packages, named).collect()} == {".env", "web/.env.local", "deploy/x.env"}
    assert _each(spark, selection.is_project_dockerfile, ["Dockerfile", "a/dev.Dockerfile", "Dockerfile.prod", "dockerfile.go", ".dockerignore", "Dockerfile.dockerignore", "tests/Dockerfile", "a/b/c/d/e/Dockerfile", "Containerfile"]) == [True, True, True, False, False, False, False, False, True]
    assert _each(spark, selection.is_config_package, ["@a/eslint-config", "tsconfig", "x-tsconfig", "prettier-config-y", "config-ts", "my-eslint-config", "eslint", "configure"]) == [True, True, True, True, True, True, False, False]
    assert _each(spark, lambda c: selection.is_no_app_source(c, F.lit("examples/api")), ["examples/api/src/a.ts", "examples/api/test/a.ts", "examples/api/a.spec.ts"]) == [False, True, True]
    assert {r.confidence for r in selection.by_confidence(_rows(spark, "confidence string", "low", "medium", "high")).collect()} == {"medium", "high"}


def test_counts_flags_and_matches(spark):
    refs = _rows(spark, "name string, ecosystem string, indirect boolean", ("a", "node", None), ("a", "node", False), ("b", "go", True))
    assert [tuple(r) for r in selection.direct_dependencies(refs).collect()] == [("r", "node", 1)]
    files = _rows(spark, "path string", "m/a_test.go", "m/b_test.go", "x/c_test.go", "testdata/d_test.go", "e.go")
    assert selection.test_counts(files).first().tests == 4
    signals = {tuple(r)[1:] for r in selection.go_test_signals(files, _rows(spark, "dir string", "m"), _rows(spark, "dir string", "x")).collect()}
    assert signals == {("m", "high", "2 *_test.go files in m"), ("x", "low", "1 *_test.go file in x")}
    state = selection.with_git_state(files, _rows(spark, "path string", "e.go"), _rows(spark, "path string", "x/c_test.go"))
    assert {(r.path, r.tracked, r.ignored) for r in state.where("tracked OR ignored").collect()} == {("e.go", True, False), ("x/c_test.go", False, True)} and selection.with_git_state(files, None, files).first().tracked is None
    functions = _rows(spark, "path string, name string", ("a/x.go", "F"), ("a/y.go", "G"), ("a/z.go", "G"))
    assert [(r.name, r.target) for r in selection.unique_functions(_rows(spark, "dir string, name string", ("a", "F"), ("a", "G"), ("b", "F")), functions).collect()] == [("F", "a/x.go")]
    sources = _rows(spark, "runtime string, file string, field string, raw string, ord int", ("node", "f", None, "1", 2), ("node", "f", None, "1", 1), ("go", "g", None, "1", 1))
    assert {(r.runtime, r.ord) for r in selection.distinct_sources(sources).collect()} == {("node", 1), ("go", 1)}
    evidence = _rows(spark, "runtime string, dir string", ("go", "m"), ("go", None), ("node", "."), ("php", "."))
    assert [(r.runtime, r["rank"]) for r in selection.project_runtimes(sources, evidence).orderBy(*selection.order_runtimes()).collect()] == [("node", 0), ("go", 1)]
    variables = _rows(spark, "name string, documented boolean, used boolean", ("A", True, False), ("B", True, False), ("C", True, True))
    assert [r.name for r in selection.unused_and_mentioned(variables, _rows(spark, "name string", "A", "C")).collect()] == ["A"]


def test_orders(spark):
    v = _rows(spark, "name string, used boolean, documented boolean, defined boolean, fallback boolean, test_only boolean", ("FINE", True, True, True, False, False), ("OLD", False, True, False, False, False), ("GONE", True, True, False, False, False), ("LOCAL", False, False, True, False, False), ("NEW", True, False, False, False, False), ("CI", True, False, True, False, False))
    assert [r.name for r in v.orderBy(*selection.order_variables(F.lit(True), ["CI"])).collect()] == ["NEW", "LOCAL", "GONE", "OLD", "CI", "FINE"]
    languages = _rows(spark, "name string, kind string, share double, files int", ("CSS", "style", 0.9, 9), ("Go", "code", 0.3, 3), ("C", "code", 0.3, 3))
    assert [r.name for r in languages.orderBy(*selection.order_languages()).collect()] == ["C", "Go", "CSS"]
    assert [r.name for r in _rows(spark, "name string", "a", "origin").orderBy(*selection.order_remotes()).collect()] == ["origin", "a"]
    services = _rows(spark, "name string, source string, included_from string", ("b", "compose.yml", None), ("a", "z/compose.yml", None), ("c", "z/compose.yml", "compose.yml"))
    assert [r.name for r in services.orderBy(*selection.order_services()).collect()] == ["b", "c", "a"]
    assert [r.id for r in _rows(spark, "kind string, name string, id string", ("t", "B", "1"), ("t", "a", "2"), ("l", "z", "3")).orderBy(*selection.order_tools()).collect()] == ["3", "2", "1"]
    assert [r.name for r in _rows(spark, "confidence string, name string", ("low", "a"), ("high", "b"), ("high", "B")).orderBy(*selection.order_databases()).collect()] == ["B", "b", "a"]
    assert [r.message for r in _rows(spark, "file string, message string, detail string", ("f", "1", None), (None, "2", "d"), (None, "2", None)).orderBy(*selection.order_warnings()).collect()] == ["2", "2", "1"]


def test_documents(spark, tmp_path):
    parts = {"project": _rows(spark, "name string", "p"), "git": _rows(spark, "branch string", "main")}
    lists = {"diagnostics": (_rows(spark, "code string, n int", ("B", 1), ("A", 2)), ["code"]), "routes": (_rows(spark, "path string", "/").limit(0), ["path"])}
    full = json.loads(sinks.documents(parts, lists, {"schemaVersion": "1"}).first().document)
    assert full == {"schemaVersion": "1", "project": {"name": "p"}, "git": {"branch": "main"}, "diagnostics": [{"code": "A", "n": 2}, {"code": "B", "n": 1}], "routes": []}
    found = sinks.findings_documents(parts, lists, {"schemaVersion": "1", "other": "x"})
    assert set(json.loads(found.first().document)) == {"schemaVersion", "project", "diagnostics"}
    sinks.write_documents(found, f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").count() == 1
    with pytest.raises(Exception, match="exist"):
        sinks.write_documents(found, f"{tmp_path}/out")
