"""Environment references, lockfiles and small formats on literal files."""

import json

from pyspark.sql import functions as F

from sparkquarry.sources import locks, references, small_formats as small

SCHEMA = "repo_id int, path string, content string"


def _files(spark, *rows):
    return spark.createDataFrame([(1, p, c) for p, c in rows], SCHEMA)


def _refs(spark, path, content):
    return {(r.family, r.name, r.required) for r in references.source_references(_files(spark, (path, content), ("x.ts", None), ("y.ts", ""), ("z.txt", "process.env.NO"))).collect()}


def test_javascript_references(spark):
    code = """
    // process.env.COMMENTED
    const url = "https://x/" + process.env.A /* process.env.GONE */ ?? 1;
    const b = process.env["my-var"], c = (import.meta.env.VITE_C) || 2, d = import.meta.env.MODE, e = process.env.hasOwnProperty('x');
    const f = Bun.env?.F, g = Deno.env.get('G') ?? '', both = process.env.TWICE ?? 1, again = process.env.TWICE;
    const { H, I: alias, J = 'x', ...rest }: Env = process.env
    """
    assert _refs(spark, "a.ts", code) == {
        ("object", "A", False), ("object", "my-var", True), ("object", "VITE_C", False), ("object", "F", True), ("object", "TWICE", True),
        ("deno", "G", False), ("destructured", "H", True), ("destructured", "I", True), ("destructured", "J", False),
    }


def test_bound_and_configured_references(spark):
    svelte = "import { env as e } from '$env/dynamic/private'\nimport { S, type T as U } from \"$env/static/public\"\nimport { getSecret, AST } from 'astro:env/server'\nuse(e.DYN, other.NOT, e['k.ey'] || 1)\n"
    assert _refs(spark, "a.svelte", svelte) == {("bound", "DYN", True), ("bound", "k.ey", False), ("static-import", "S", True), ("static-import", "T", True), ("static-import", "AST", True)}
    assert _refs(spark, "vite.config.ts", "const env = loadEnv(mode, cwd, '')\nconst { K, L = 1 } = loadEnv(m)\nx(env.M)") == {("bound", "K", True), ("bound", "L", False), ("bound", "M", True)}
    nest = "constructor(private configService: ConfigService) {}\na = this.configService.get<string>('N1'); b = config.get('N2', 3); c = configService.getOrThrow('N3'); d = map.get('N4')"
    assert _refs(spark, "n.ts", nest) == {("config-service", "N1", True), ("config-service", "N2", False), ("config-service", "N3", True)}
    schema = "const s = z.object({\n  DATABASE_URL: z.string(),\n  PORT: z.coerce.number().default(3000),\n  'OPT_X': z.string().optional(), lower: 1 })\nexport const e = s.parse(process.env)"
    assert _refs(spark, "e.ts", schema) == {("schema", "DATABASE_URL", True), ("schema", "PORT", False), ("schema", "OPT_X", False)}
    assert _refs(spark, "prisma.config.ts", "import { env } from 'prisma/config'\nu = env('PU'); v = x.env('NO')") == {("prisma-config", "PU", True)}


def test_go_prisma_compose_html_references(spark):
    go = 'a := os.Getenv("A"); b := cmp.Or(os.Getenv("B"), "x")\nc, ok := os.LookupEnv("C") // os.Getenv("NO")\nP string `env:"P,required" envDefault:"1"`\nQ string `envconfig:"Q"`\n'
    assert _refs(spark, "m.go", go) == {("go-call", "A", True), ("go-call", "B", False), ("go-call", "C", False), ("go-tag", "P", False), ("go-tag", "Q", True)}
    assert _refs(spark, "s.prisma", 'url = env("DB")\n// env("NO")') == {("prisma", "DB", True)}
    compose = "a: ${A:-x} ${B?must} $C x$D $lower $$E\n# ${NO}\nb: 'x # ${F}' # ${NO}\nc: ${A} ${G:+y}\nd: $apr1$H6"
    got = {(r.name, r.required) for r in references.compose_references(_files(spark, ("compose.yml", compose), ("b.yml", None))).collect()}
    assert got == {("A", True), ("B", True), ("C", True), ("F", True), ("G", False)}
    html = {r.name for r in references.html_references(_files(spark, ("web/index.html", "%VITE_T% %s% %MODE% %NODE_ENV% %OTHER%"), ("a.html", "%VITE_X%"))).collect()}
    assert html == {"VITE_T", "NODE_ENV"}


def test_lockfiles(spark):
    v1 = json.dumps({"dependencies": {"a": {"version": "1.0.0", "dependencies": {"b": {"version": "2.0.0"}, "git": {"version": "git+https://x"}}}, "odd": 3}})
    v3 = json.dumps({"packages": {"": {"version": "9.9.9"}, "node_modules/@a/b": {"version": "1.0.0"}, "node_modules/c/node_modules/d": {"version": "2.0.0-rc.1"}, "node_modules/w": {"link": True, "version": "1.0.0"}, "node_modules/al": {"name": "real", "version": "3.0.0"}}})
    pnpm = "lockfileVersion: 9\nimporters:\n  .:\n    x: 1\npackages:\n  /old/1.0.0_peer@2.0.0:\n    r: {}\n  '@s/n@2.1.0(p@1.0.0)':\n    r: {}\n  /@o/p/3.0.0: {}\nsnapshots:\n  z@9.0.0: {}\n"
    yarn = '# v1\n__metadata:\n  version: 8\n"@a/b@^1.0.0", "@a/b@^1.1.0", "al@npm:x@1":\n  version "1.2.0"\nc@~2:\n  version "2.0.1"\n"w@workspace:.":\n  version: 0.0.0-use.local\n'
    bun = '{ // c\n "packages": { "a": ["@x/a@1.0.0", "", {"dependencies": {}}, "sha"], "b": ["b@git+u"], },\n}'
    composer = json.dumps({"packages": [{"name": "v/p", "version": "v1.2.3"}], "packages-dev": [{"name": "v/d", "version": "dev-main"}, {"name": "v/e", "version": "2.0.0"}]})
    f = _files(spark, ("package-lock.json", v1), ("web/package-lock.json", v3), ("pnpm-lock.yaml", pnpm), ("yarn.lock", yarn), ("bun.lock", bun), ("composer.lock", composer), ("go.mod", "module m\nrequire x/y v1.0.0\nrequire z v0.0.0+incompatible\n"), ("a/b/c/yarn.lock", yarn), ("b/yarn.lock", yarn), ("c/package-lock.json", "{"), ("d/bun.lock", None))
    got = {(r.ecosystem, r.name, r.version): r.lockfiles for r in locks.locked_packages(f).collect()}
    assert set(got) == {
        ("npm", "a", "1.0.0"), ("npm", "b", "2.0.0"), ("npm", "@a/b", "1.0.0"), ("npm", "d", "2.0.0-rc.1"), ("npm", "real", "3.0.0"), ("npm", "old", "1.0.0"), ("npm", "@s/n", "2.1.0"), ("npm", "@o/p", "3.0.0"),
        ("npm", "@a/b", "1.2.0"), ("npm", "al", "1.2.0"), ("npm", "c", "2.0.1"), ("npm", "@x/a", "1.0.0"), ("Packagist", "v/p", "1.2.3"), ("Packagist", "v/e", "2.0.0"), ("Go", "x/y", "1.0.0"),
    }
    assert got["npm", "c", "2.0.1"] == ["b/yarn.lock", "yarn.lock"]


def test_version_files(spark):
    f = _files(spark, (".nvmrc", "# c\n\nv20.1.0 extra\n"), ("e", ""))
    assert [tuple(r) for r in small.parse_version_file(f).collect()] == [(1, ".nvmrc", "v20.1.0")]
    t = small.parse_tool_versions(_files(spark, (".tool-versions", "nodejs 20.1.0 18\n# x\ngolang 1.22 # y\nbad\n")))
    assert [(r.tool, r.version) for r in t.orderBy("line").collect()] == [("nodejs", "20.1.0"), ("golang", "1.22")]
    m = small.parse_mise_tools(_files(spark, (".mise.toml", 'tools.go = "1.22"\n[tools]\nnode = ["22", "20"] # c\n"core:python" = { version = "3.12" }\nbun = 1.1\nbad = x\n[env]\nnode = "9"\n')))
    assert [(r.tool, r.version) for r in m.orderBy("line").collect()] == [("go", "1.22"), ("node", "22"), ("python", "3.12"), ("bun", "1.1")]


def test_requirements_work_and_imports(spark):
    r = small.parse_requirements(_files(spark, ("requirements.txt", "Py_Test[x] >= 8, <9 ; python_version>'3'\n-r other\n# c\nflask\n")))
    assert [(x.name, x.spec) for x in r.orderBy("line").collect()] == [("py-test", ">=8,<9"), ("flask", None)]
    w = small.parse_go_work(_files(spark, ("go.work", "go 1.22\nuse ./a // c\nuse (\n\t./b\n\t\"./c\"\n)\nreplace x => y\n")))
    assert [x.dir for x in w.orderBy("line").collect()] == ["./a", "./b", "./c"]
    d = small.parse_deno_imports(_files(spark, ("deno.jsonc", '{"imports": {"a": "jsr:@std/path@^1/posix", "b": "npm:chalk", "c": "./x.ts", "d": "jsr:/@std/", /* n */ "e": "npm:/@s/n@2",}}')))
    assert {tuple(x)[2:] for x in d.collect()} == {("@std/path", "^1", "jsr"), ("chalk", "*", "npm"), ("@s/n", "2", "npm")}


def test_task_files(spark):
    make = "X := 1\nURL = http://x\n.PHONY: all\nall: build test\nbuild: dep ; @go build\ntest lint:\n\t# note\n\t@go test ./...\n%.o: %.c\n\tcc\ndefine D\nfake:\nendef\nbuild:\n\tother\nv: CFLAGS = 1\nempty:\nifeq (a,b)\nendif\ninclude x: y\n"
    got = {r.name: r.command for r in small.parse_makefile(_files(spark, ("Makefile", make))).collect()}
    assert got == {"all": "", "build": "go build", "test": "go test ./...", "lint": "go test ./...", "empty": ""}
    just = 'set shell := ["bash"]\nv := "a:b"\nbuild target="a:b": dep\n    # c\n    @cargo build\n_hidden:\n  x\n[private]\nsecret:\n  y\nbuild:\n  again\n@quiet:\nalias b := build\n'
    assert {r.name: r.command for r in small.parse_justfile(_files(spark, ("justfile", just))).collect()} == {"build": "cargo build", "quiet": ""}


def test_git_refs(spark):
    sha = "a" * 40
    h = small.parse_head(spark.createDataFrame([(1, "HEAD", "ref: refs/heads/m\n"), (2, "HEAD", sha), (3, "HEAD", "x"), (4, "HEAD", "ref: refs/heads/.invalid")], SCHEMA))
    assert {tuple(r) for r in h.collect()} == {(1, "refs/heads/m", "m", None), (2, None, None, sha), (4, "refs/heads/.invalid", None, None)}
    p = small.parse_packed_refs(_files(spark, ("packed-refs", f"# pack\n{sha} refs/heads/n\n^{'b' * 40}\n{'c' * 40} refs/heads/n\n")))
    assert [tuple(r) for r in p.collect()] == [(1, "refs/heads/n", sha)]
    refs = p.withColumn("target", F.lit(None).cast("string")).unionByName(spark.createDataFrame([(1, "refs/heads/m", None, "refs/heads/n")], "repo_id int, ref string, sha string, target string"))
    assert [r.sha for r in small.resolve_refs(h.where("repo_id = 1"), refs).collect()] == [sha]


def test_ignore_layers(spark):
    rules = small.parse_ignore_rules(_files(spark, (".gitignore", "# c\n*.log\n/dist/\nlogs/*\n!logs/keep.txt\nbuild/\n\\#odd\n"), ("pkg/.gitignore", "!*.log\nlocal.txt\n")))
    paths = ["a.log", "x/b.log", "pkg/c.log", "dist/a.js", "x/dist/a.js", "logs/keep.txt", "logs/other.txt", "x/build/y.log", "build", "pkg/deep/local.txt", "local.txt", "#odd", "src/a.ts"]
    got = {r.path for r in small.ignored_paths(_files(spark, *[(p, None) for p in paths]), rules).collect()}
    assert got == {"a.log", "x/b.log", "dist/a.js", "logs/other.txt", "x/build/y.log", "pkg/deep/local.txt", "#odd"}
