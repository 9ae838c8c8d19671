"""Module graphs, catalogs, commands, Git config, CI values and page routes on literal rows."""

import json
import posixpath

import pytest
from pyspark.sql import functions as F

from sparkquarry.functions import commands
from sparkquarry.operators import modules
from sparkquarry.sources import ci, git_config, page_routes


def _paths(spark, *names, columns="repo_id string, path string"):
    return spark.createDataFrame([("r", *(n if isinstance(n, tuple) else (n,))) for n in names], columns)


def test_relative_imports(spark):
    files = _paths(spark, "src/a.ts", "src/b.js", "src/b.ts", "src/c.tsx", "src/d/index.ts", "src/d.js/index.js", "top.mts", "src/e.jsx.ts")
    asked = {"./a": "src/a.ts", "./b.js": "src/b.js", "./a.js": "src/a.ts", "./c.jsx": "src/c.tsx", "./d": "src/d/index.ts", "../top.mjs": "top.mts", "../../out": None, "./none": None, "..": None, "./e.jsx": "src/e.jsx.ts", "./d.js": "src/d.js/index.js", ".": None}
    imports = _paths(spark, *[("src/main.ts", s) for s in asked] + [("src/other.ts", "./a")], columns="repo_id string, path string, specifier string")
    rows = modules.resolve_imports(imports, files).collect()
    assert {r.specifier: r.target for r in rows if r.path == "src/main.ts"} == asked and len(rows) == len(asked) + 1


def test_imports_are_shuffled_once_and_find_the_first_trial(spark):
    ends = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".json", "/index.ts", "/index.cjs", "/index", ".js.ts", "/.ts"]
    names = [f"{d}{n}{e}" for d in ("", "src/") for n in ("a", "index", "b.c", "src") for e in ends]
    have = set(names[::3] + names[::7])
    files = _paths(spark, *sorted(have), *sorted(have)[:5])
    asked = [("src/main.ts", f"{up}{n}") for up in ("./", "../") for n in [*names, "", ".", "../x"]]
    got = modules.resolve_imports(_paths(spark, *asked, asked[0], columns="repo_id string, path string, specifier string"), files)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2

    def want(up, name):
        base = posixpath.normpath(posixpath.join("src", up, name))
        swapped = [base[: -len(e)] + t for e, to in modules.STANDS_FOR.items() if base.endswith(e) for t in to]
        tried = [base, *swapped, *(base + e for e in modules.ENDINGS), *(f"{base}/index{e}" for e in modules.ENDINGS)]
        return None if base == "." or base.startswith("..") else next((t for t in tried if t in have), None)

    rows = got.collect()
    assert len(rows) == len(asked) + 1 and sum(r.target is not None for r in rows) > 60
    for r in rows:
        up = "../" if r.specifier.startswith("../") else "./"
        assert r.target == want(up, r.specifier[len(up):]), r


def test_mounts_over_files_and_cycles(spark):
    files = _paths(spark, *(f"{n}.ts" for n in ("app", "a", "b", "c", "lone", "far")))
    mounts = _paths(spark, ("app.ts", "./a"), ("app.ts", "./gone"), ("a.ts", "./b.js"), ("b.ts", "./a"), ("b.ts", "./c"), ("lone.ts", "./far"), columns="repo_id string, path string, specifier string")
    found, edges = modules.mounted_files(_paths(spark, "app.ts"), mounts, files)
    assert {(r.path, r.level) for r in found.collect()} == {("app.ts", 0), ("a.ts", 1), ("b.ts", 2), ("c.ts", 3)}
    assert {(r.path, r.target) for r in edges.collect()} == {("app.ts", "a.ts"), ("a.ts", "b.ts"), ("b.ts", "a.ts"), ("b.ts", "c.ts")}
    assert modules.mounted_files(_paths(spark, "app.ts").limit(0), mounts, files)[0].count() == 0


def test_catalogs(spark):
    refs = _paths(spark, ("a", "catalog:"), ("a", "catalog: next "), ("b", "catalog:"), ("c", "^1"), ("a", "catalog:none"), ("a", None), columns="repo_id string, name string, range string")
    catalogs = _paths(spark, ("default", "a", "^2"), ("next", "a", "^3"), ("default", "b", ""), columns="repo_id string, catalog string, name string, range string")
    got = sorted((r.name, r.range or "") for r in modules.resolve_catalogs(refs, catalogs).collect())
    assert got == sorted([("a", "^2"), ("a", "^3"), ("b", "catalog:"), ("c", "^1"), ("a", "catalog:none"), ("a", "")])


@pytest.mark.parametrize("command,want", [
    ("tsc -p . && eslint .", [("tsc", "-p", "."), ("eslint", ".")]), ("NODE_ENV=test npx -y jest --ci|tee log", [("jest", "--ci"), ("tee", "log")]), ("cross-env A=1 B='x y' ./node_modules/.bin/vite build", [("vite", "build")]),
    ("dotenv -e .env -- next dev", [("next", "dev")]), ("dotenv -e .env", []), ("pnpm exec --silent tsc; yarn vitest; pnpm run build; npm x -- a", [("tsc",), ("vitest",), ("pnpm", "run", "build"), ("a",)]),
    ('echo "a && b" \'c;d\' e\\ f ""', [("echo", "a && b", "c;d", "e f", "")]), ("(cd x; go test)\nmake", [("cd", "x"), ("go", "test"), ("make",)]), ("A=1", []), ("", []), (None, []), ("echo 'open", [("echo", "open")]), ("a\\", [("a\\",)]),
])
def test_programs_of_commands(command, want):
    assert [(p[0], *p[1]) for p in map(commands.program_of, commands.split_command(command or "")) if p] == want


def test_script_matchers_and_arguments(spark):
    scripts = _paths(spark, (".", "build", "tsc -b && vite build -c v.ts"), (".", "test", "node --test --config=x.json"), ("web", "check", "tsc --noEmit --config -x"), (".", "none", None), columns="repo_id string, package string, name string, command string")
    matchers = spark.createDataFrame([("tsc", "tsc", "tsc", [], ["--noEmit"], None), ("types", "tsc --noEmit", "tsc", ["--noEmit"], [], None), ("node", "node --test", "node", ["--test"], [], "test"), ("vite", "vite build", "vite", ["build"], [], "other")], "id string, label string, bin string, needs array<string>, without array<string>, script string")
    assert {(r.package, r.script, r.id) for r in commands.script_signals(scripts, matchers).collect()} == {(".", "build", "tsc"), (".", "test", "node"), ("web", "check", "types")}
    each = scripts.select("name", F.explode(commands.parse_invocations(F.col("command"))).alias("i")).select("name", "i.bin", commands.config_argument(F.col("i.args")).alias("c"), commands.config_argument(F.col("i.args"), False).alias("long"))
    assert {(r.bin, r.c, r.long) for r in each.collect()} == {("tsc", None, None), ("vite", "v.ts", None), ("node", "x.json", "x.json")}
    ran = scripts.select("name", commands.runs(commands.parse_invocations(F.col("command")), "tsc", "--noEmit").alias("r")).collect()
    assert {r.name: r.r for r in ran} == {"build": False, "test": False, "check": True, "none": False}


def test_git_config(spark):
    text = (
        '[core]\n\tbare = false ; note\n[remote "Ori\\"gin"]\n  URL = "https://x/y.git" # c\n\turl = second\n\tfetch = +refs/heads/*:refs/a \\\n  more\\\\\n  pushUrl = https://p\n[remote.Old] url = a  "b  c"  d\n[branch "main"]\n\tflag\n'
        '[bad header\n\tkey = 1\n# [x]\n[a]\nno-such+key = 1\nk v\nt = "a\\tb\\n" ;x\n'
    )
    got = [(r.section, r.subsection, r.key, r.value) for r in git_config.parse_git_config(_paths(spark, ("c", text), ("n", None), ("e", ""), columns="repo_id string, path string, content string")).orderBy("line").collect()]
    assert got == [
        ("core", None, "bare", "false"), ("remote", 'Ori"gin', "url", "https://x/y.git"), ("remote", 'Ori"gin', "url", "second"), ("remote", 'Ori"gin', "fetch", "+refs/heads/*:refs/a   more\\"), ("remote", 'Ori"gin', "pushurl", "https://p"),
        ("remote", "old", "url", "a b  c d"), ("branch", "main", "flag", None), ("a", None, "t", "a\tb\n"),
    ]
    found = git_config.remotes(git_config.parse_git_config(_paths(spark, ("c", text), columns="repo_id string, path string, content string"))).collect()
    assert {(r.name, r.url, r.push_url) for r in found} == {('Ori"gin', "https://x/y.git", "https://p"), ("old", "a b  c d", None)}


@pytest.mark.parametrize("value,want", [
    ("plain", ["plain"]), ("${{ matrix.node }}", ["20", "22", "24"]), ("v${{matrix.node}}-${{ env.OS }}", ["v20-linux", "v22-linux", "v24-linux"]), ("${{ matrix.os.name }}", ["a", "b"]), ("${{ 'x' }}y", ["xy"]), ("${{ env.INNER }}", None),
    ("${{ secrets.X }}", None), ("${{ matrix.none }}", None), ("${{ matrix.node", None), ("${{ matrix.node }}" + "x" * 256, None), ("${{ matrix.flag }}", ["true", "1.5"]), ("${{ matrix.big }}${{ matrix.big }}", [f"{a}{b}" for a in "01234567" for b in "01234567"][:32]),
])
def test_matrix_values(value, want):
    matrix = {"node": [20, "22", 20], "os": [{"name": "a"}, {"name": "b"}, "c"], "include": [{"node": 24}, {"other": 1}, 5], "flag": [True, 1.5, "${{ x }}"], "big": list("01234567")}
    assert ci.expand(value, matrix, [{"OTHER": 1}, None, {"OS": "linux", "INNER": "${{ x }}"}, {"OS": "outer"}]) == want


def test_expressions_and_tasks_as_columns(spark):
    rows = spark.createDataFrame([("n${{ matrix.n }}", json.dumps({"n": [1, 2]}), None), (None, None, []), ("${{ env.A }}", None, ['{"A":"x"}'])], "v string, m string, e array<string>")
    assert [r.x for r in rows.select(ci.expand_expression(F.col("v"), F.col("m"), F.col("e")).alias("x")).collect()] == [["n1", "n2"], None, ["x"]]
    steps = _paths(spark, ("ci.yml", "j", "npm run build"), ("ci.yml", "j", "eslint . && vitest"), ("ci.yml", "k", "echo"), columns="repo_id string, path string, job string, text string")
    assert {r.job: r.tasks for r in ci.job_tasks(steps).collect()} == {"j": ["lint", "test", "build"], "k": []}


def _routes(found):
    return {(r.kind, r.method, r.path, r.file, r.note) for r in found.collect()}


def test_nuxt_routes(spark):
    names = [
        "app/pages/index.vue", "app/pages/products/[id].vue", "app/pages/(shop)/cart.vue", "app/pages/settings.vue", "app/pages/settings/index.vue", "app/pages/team.vue", "app/pages/team/[who].vue", "app/pages/-draft.vue", "app/pages/.x/y.vue",
        "server/api/users/[id].get.ts", "server/api/index.post.dev.ts", "server/routes/health.ts", "server/api/a.d.ts", "server/api/b.test.ts", "pages/old.vue", "server/api/c.vue",
    ]
    files = _paths(spark, *[(n, ".") for n in names], ("web/src/pages/a.vue", "web"), ("web/src/server/api/x.ts", "web"), ("web/pages/no.vue", "web"), ("lib/pages/b.vue", "lib"), columns="repo_id string, path string, package string")
    packages = _paths(spark, (".", None), ("web", "src"), columns="repo_id string, package string, src_dir string")
    assert _routes(page_routes.nuxt_routes(files, packages)) == {
        ("page", "GET", "/", names[0], None), ("page", "GET", "/products/[id]", names[1], None), ("page", "GET", "/cart", names[2], None), ("page", "GET", "/settings", names[4], None), ("page", "GET", "/team", names[5], "nested route parent"), ("page", "GET", "/team/[who]", names[6], None),
        ("api", "GET", "/api/users/[id]", names[9], None), ("api", "POST", "/api", names[10], "development only"), ("api", "ANY", "/health", names[11], None), ("page", "GET", "/a", "web/src/pages/a.vue", None), ("api", "ANY", "/api/x", "web/src/server/api/x.ts", None),
    }


def test_next_routes(spark):
    handler = "export async function GET() {}\nexport const POST = h, x = 1\nexport { del as DELETE, type T }\n// export function PUT() {}\nconst s = 'export function HEAD'\nexport const { PATCH, a: OPTIONS } = m\n"
    rows = [
        ("app/page.tsx", ".", None), ("app/(a)/shop/page.js", ".", None), ("app/_private/page.tsx", ".", None), ("app/x/(..)y/page.tsx", ".", None), ("app/%5Fz/page.mdx", ".", None), ("app/@side/shop/page.tsx", ".", None), ("app/@side/only/page.tsx", ".", None), ("app/api/r/route.ts", ".", handler),
        ("app/api/none/route.ts", ".", "const a = 1"), ("app/a.page.tsx", ".", None), ("pages/index.jsx", ".", None), ("pages/api/u/[id].ts", ".", None), ("pages/_app.tsx", ".", None), ("pages/b/index.tsx", ".", None), ("src/pages/no.tsx", ".", None), ("web/src/pages/in.tsx", "web", None), ("pages/c.test.tsx", ".", None),
    ]
    files = _paths(spark, *rows, columns="repo_id string, path string, package string, content string")
    got = _routes(page_routes.next_routes(files, _paths(spark, (".", None), ("web", "/base"), columns="repo_id string, package string, base_path string")))
    api = {("api", m, "/api/r", "app/api/r/route.ts", None) for m in ("GET", "POST", "DELETE", "PATCH", "OPTIONS")}
    assert got == api | {
        ("page", "GET", "/", "app/page.tsx", None), ("page", "GET", "/shop", "app/(a)/shop/page.js", None), ("page", "GET", "/_z", "app/%5Fz/page.mdx", None), ("page", "GET", "/only", "app/@side/only/page.tsx", None),
        ("api", "ANY", "/api/none", "app/api/none/route.ts", "no exported HTTP method handlers found"), ("page", "GET", "/", "pages/index.jsx", None), ("api", "ANY", "/api/u/[id]", "pages/api/u/[id].ts", None), ("page", "GET", "/b", "pages/b/index.tsx", None),
        ("page", "GET", "/base/in", "web/src/pages/in.tsx", None),
    }


def test_values_of_git():
    assert git_config.read_value('  a\\\\b "x ; y" # z') == "a\\b x ; y"
