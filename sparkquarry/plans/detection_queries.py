"""Driver queries of the detection joins, environment references and lockfiles.

Names, files and sources are drawn from columns of the events by the same arithmetic on both sides; the SQL states the expected
finding of each draw, not the library's tables or patterns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.operators import detect, evidence, known
from sparkquarry.plans.project_queries import _pick
from sparkquarry.plans.queries import _query, _read
from sparkquarry.sources import locks, references, small_formats

#: name, type, ecosystem and indirect of the drawn dependencies
DRAWN = [
    ("nuxt", "dependencies", "node", False), ("react", "peer", "node", False), ("react", "dependencies", "node", False), ("left-pad", "dependencies", "node", False), ("express", "dev", "node", False),
    ("github.com/gin-gonic/gin", "go", "go", False), ("google.golang.org/grpc", "go", "go", True), ("pg", "dependencies", "node", False), ("ioredis", "dev", "node", False), ("github.com/jackc/pgx/v5", "go", "go", False),
    ("@vitest/ui", "dev", "node", False), ("vitest", "dev", "node", False), ("jsdom", "dependencies", "node", False), ("mongodb", "peer", "node", False),
]
TOOLS = [("vitest", "vitest", "exact"), ("@vitest/", "vitest", "prefix"), ("jsdom", "vitest", "weak"), ("left-pad", "padding", "exact"), ("left-", "padding", "prefix")]
CONFIG_PATHS = ["nuxt.config.ts", "apps/a/nuxt.config.mjs", "apps/a/.vitepress/config.js", "docs/.vitepress/config.ts", "svelte.config.js", "lib/svelte.config.js", "apps/a/deep/next.config.js", "apps/a/deep/angular.json", "eas.json", "electron-builder.yml", "README.md"]
IMAGES = ["docker.io/library/postgres:17-alpine", "bitnami/redis", "docker.elastic.co/elasticsearch/elasticsearch:9", "localhost:5000/team/api@sha256:00", "mysql/community-server:8", "${REG:-ghcr.io}/x/nginx:1", "node:22-alpine", "public.ecr.aws/docker/library/golang:1.25.1-bookworm", "node:iron-slim", "ghcr.io/x/node:20", "oven/bun", "denoland/deno:alpine-2.5.0"]
VARIABLES = ["REDIS_URL", "PGHOST", "DATABASE_URL", "MONGODB_URI", "MYREDIS_URL", "REDIS", "POSTGRESQL_HOST", "ELASTIC_KEY", "PGX"]
SCHEMES = [None, "postgresql+asyncpg", "HTTP", "mongodb+srv", None, "rediss", "mysql", None, None]


def _events(spark, sf_dir, modulus: int, n: int) -> DataFrame:
    e = _read(spark, sf_dir, "events").select(F.col("user_id").alias("repo_id"), F.col("event_id").alias("i"))
    return e.where(F.col("i") % modulus < n).withColumn("k", F.col("i") % modulus)


def _refs(spark, sf_dir) -> DataFrame:
    drawn = F.get(F.lit([list(map(str, d)) for d in DRAWN]), F.col("k").cast("int"))
    r = _events(spark, sf_dir, 61, len(DRAWN)).select("repo_id", F.when(F.col("i") % 2 == 0, ".").otherwise("apps/a").alias("package"), drawn.alias("d"), F.concat(F.lit("^"), (F.col("i") % 3 + 1).cast("string"), F.lit(".2.0")).alias("range"))
    file = F.concat(F.when(F.col("package") == ".", "").otherwise("apps/a/"), F.when(F.col("d")[2] == "go", "go.mod").otherwise("package.json"))
    return r.select("repo_id", "package", F.col("d")[0].alias("name"), F.col("d")[1].alias("type"), F.col("d")[2].alias("ecosystem"), (F.col("d")[3] == "True").alias("indirect"), "range", file.alias("file")).distinct()


_R = """r AS (SELECT DISTINCT user_id AS repo_id, event_id % 61 AS k, CASE WHEN event_id % 2 = 0 THEN '.' ELSE 'apps/a' END AS package, event_id % 3 + 1 || '.2.0' AS version,
    CASE WHEN event_id % 2 = 0 THEN '' ELSE 'apps/a/' END || CASE WHEN event_id % 61 IN (5, 6, 9) THEN 'go.mod' ELSE 'package.json' END AS file FROM events WHERE event_id % 61 < 14)"""


@_query(f"""WITH {_R} SELECT repo_id, package, version, CASE k WHEN 0 THEN 'nuxt' WHEN 1 THEN 'react' WHEN 2 THEN 'react' WHEN 4 THEN 'express' WHEN 5 THEN 'gin' ELSE 'grpc' END AS id,
    CASE k WHEN 1 THEN 'low' WHEN 4 THEN 'medium' WHEN 6 THEN 'low' ELSE 'high' END AS confidence,
    CASE k WHEN 0 THEN 'dependency nuxt' WHEN 1 THEN 'peer dependency react' WHEN 2 THEN 'dependency react' WHEN 4 THEN 'dev dependency express' WHEN 5 THEN 'dependency github.com/gin-gonic/gin'
        ELSE 'indirect dependency google.golang.org/grpc' END || '@^' || version || ' in ' || file AS evidence
    FROM r WHERE k IN (0, 1, 2, 4, 5, 6)""")
def detect_framework_dependencies(spark, sf_dir):
    return detect.dependency_signals(_refs(spark, sf_dir), known.framework_packages(spark)).select("repo_id", "id", "package", "version", "confidence", "evidence")


@_query(f"""WITH {_R} SELECT repo_id, package, version, CASE k WHEN 3 THEN 'padding' ELSE 'vitest' END AS id,
    CASE WHEN package = 'apps/a' AND repo_id % 2 = 0 THEN 'low' WHEN k = 12 THEN 'medium' ELSE 'high' END AS confidence FROM r WHERE k IN (3, 10, 11, 12)""")
def detect_tool_dependencies(spark, sf_dir):
    specs = known.table(spark, TOOLS, "name string, id string, how string")
    shared = _events(spark, sf_dir, 1, 1).where("repo_id % 2 = 0").select("repo_id", F.lit("apps/a").alias("package"))
    return detect.tool_signals(_refs(spark, sf_dir), specs, shared).select("repo_id", "id", "package", "version", "confidence")


def _located(spark, sf_dir) -> DataFrame:
    files = _events(spark, sf_dir, 67, len(CONFIG_PATHS)).select("repo_id", _pick(CONFIG_PATHS, F.col("k")).alias("path")).distinct()
    packages = _events(spark, sf_dir, 1, 1).select("repo_id", F.explode(F.array(F.lit("apps/a"), F.when(F.col("repo_id") % 2 == 0, "apps/a/deep"))).alias("dir")).where("dir IS NOT NULL").distinct()
    return detect.located_configs(files, packages, known.framework_configs(spark))


_L = """l AS (SELECT DISTINCT user_id AS repo_id, event_id % 67 AS k,
    ['nuxt.config.ts', 'apps/a/nuxt.config.mjs', 'apps/a/.vitepress/config.js', 'docs/.vitepress/config.ts', 'svelte.config.js', '', 'apps/a/deep/next.config.js', 'apps/a/deep/angular.json', 'eas.json', 'electron-builder.yml'][1 + event_id % 67] AS path,
    ['nuxt', 'nuxt', 'vitepress', 'vitepress', 'sveltekit', '', 'next', 'angular', 'expo', 'electron'][1 + event_id % 67] AS id,
    CASE WHEN event_id % 67 IN (1, 2) THEN 'apps/a' WHEN event_id % 67 IN (6, 7) THEN 'apps/a/deep' ELSE '.' END AS package
    FROM events WHERE event_id % 67 < 10 AND event_id % 67 <> 5 AND (event_id % 67 NOT IN (6, 7) OR user_id % 2 = 0))"""


@_query(f"WITH {_L} SELECT repo_id, id, path, package, k = 4 AS weak FROM l")
def detect_configs(spark, sf_dir):
    return _located(spark, sf_dir).select("repo_id", "id", "path", "package", "weak")


@_query(f"""WITH {_R}, {_L}, s AS (
        SELECT repo_id, CASE k WHEN 0 THEN 'nuxt' WHEN 4 THEN 'express' WHEN 5 THEN 'gin' WHEN 6 THEN 'grpc' ELSE 'react' END AS id, package, CASE k WHEN 1 THEN 0 WHEN 4 THEN 1 WHEN 6 THEN 0 ELSE 2 END AS c, version FROM r WHERE k IN (0, 1, 2, 4, 5, 6)
        UNION ALL SELECT repo_id, id, package, CASE WHEN id = 'nuxt' AND repo_id IN (SELECT repo_id FROM r WHERE k = 0) THEN 2 WHEN k = 4 THEN 0 ELSE 1 END, NULL FROM l),
    t AS (SELECT *, max(c) FILTER (version IS NOT NULL) OVER (PARTITION BY repo_id, id) AS top FROM s),
    v AS (SELECT repo_id, id, CASE WHEN count(DISTINCT version) > 1 THEN min(version) || '–' || max(version) END AS span FROM t WHERE c = top AND version IS NOT NULL GROUP BY ALL)
    SELECT repo_id, id, ['low', 'medium', 'high'][1 + max(c)] AS confidence, string_agg(DISTINCT package, ',' ORDER BY package) AS packages, any_value(span) AS span FROM t LEFT JOIN v USING (repo_id, id) GROUP BY repo_id, id""")
def detect_frameworks(spark, sf_dir):
    deps = detect.dependency_signals(_refs(spark, sf_dir), known.framework_packages(spark))
    signals = deps.unionByName(detect.config_signals(_located(spark, sf_dir), deps))
    found = evidence.merge_signals(signals, ["repo_id", "id"]).join(detect.version_span(signals, ["repo_id", "id"]), ["repo_id", "id"], "left")
    return found.select("repo_id", "id", "confidence", F.array_join("packages", ",").alias("packages"), "span")


@_query(f"""WITH {_R}, f AS (SELECT DISTINCT repo_id, package, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 3 ELSE 4 END AS n FROM r WHERE k IN (0, 1, 2, 4, 5, 6)),
    g AS (SELECT repo_id, package, string_agg(['nuxt', 'react', 'express', 'gin', 'grpc'][1 + n], ',' ORDER BY n) AS frameworks FROM f GROUP BY ALL)
    SELECT repo_id, package, frameworks, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY package <> '.') AS INTEGER) AS nth FROM g""")
def frameworks_by_package(spark, sf_dir):
    deps = detect.dependency_signals(_refs(spark, sf_dir), known.framework_packages(spark))
    each = detect.frameworks_by_package(evidence.merge_signals(deps, ["repo_id", "id"]).select("repo_id", "id", "packages"))
    return each.select("repo_id", "package", F.array_join("frameworks", ",").alias("frameworks"), "nth")


@_query(f"""WITH {_R} SELECT repo_id, CASE k WHEN 8 THEN 'redis' ELSE 'postgresql' END AS id, CASE k WHEN 8 THEN 'medium' ELSE 'high' END AS confidence,
    CASE k WHEN 7 THEN 'dependency pg' WHEN 8 THEN 'dev dependency ioredis' ELSE 'dependency github.com/jackc/pgx/v5' END || '@^' || version || ' in ' || file AS evidence FROM r WHERE k IN (7, 8, 9)""")
def detect_database_drivers(spark, sf_dir):
    return detect.driver_findings(_refs(spark, sf_dir), known.drivers(spark)).select("repo_id", "id", "confidence", "evidence")


@_query("""WITH e AS (SELECT DISTINCT user_id AS repo_id, event_id % 43 AS k, event_id % 2 = 0 AS url FROM events WHERE event_id % 43 < 9),
    x AS (SELECT repo_id, ['REDIS_URL', 'PGHOST', 'DATABASE_URL', 'MONGODB_URI', 'MYREDIS_URL', 'REDIS', 'POSTGRESQL_HOST', 'ELASTIC_KEY', 'PGX'][1 + k] AS name, k, url AND k IN (1, 3, 5, 6) AS by_url FROM e),
    y AS (SELECT repo_id, name, k, bool_or(by_url) AS by_url FROM x GROUP BY ALL)
    SELECT repo_id, CASE WHEN by_url THEN ['', 'postgresql', '', 'mongodb', '', 'redis', 'mysql'][1 + k] ELSE ['redis', 'postgresql', '', 'mongodb', '', 'redis', 'postgresql', 'elasticsearch'][1 + k] END AS id,
        CASE WHEN by_url THEN 'medium' ELSE 'low' END AS confidence,
        CASE WHEN by_url THEN name || ' holds a ' || ['', 'postgresql+asyncpg', '', 'mongodb+srv', '', 'rediss', 'mysql'][1 + k] || ':// URL in .env' ELSE 'environment variable ' || name END AS evidence
    FROM y WHERE by_url OR k IN (0, 1, 3, 5, 6, 7)""")
def detect_database_variables(spark, sf_dir):
    e = _events(spark, sf_dir, 43, len(VARIABLES)).select("repo_id", _pick(VARIABLES, F.col("k")).alias("name"), _pick(SCHEMES, F.col("k")).alias("scheme"), F.lit(".env").alias("file"), (F.col("i") % 2 == 0).alias("url"))
    endpoints = e.where("url AND scheme IS NOT NULL").select("repo_id", "name", "scheme", "file").distinct()
    return detect.variable_findings(e, endpoints).select("repo_id", "id", "confidence", "evidence")


def _images(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir, 59, len(IMAGES)).select("repo_id", _pick(IMAGES, F.col("k")).alias("image"), "k").distinct()


@_query("""SELECT DISTINCT user_id AS repo_id, event_id % 59 AS k, ['postgresql', 'redis', 'elasticsearch', NULL, 'mysql', 'nginx'][1 + event_id % 59] AS id,
    ['database', 'cache', 'search', NULL, 'database', 'proxy'][1 + event_id % 59] AS kind FROM events WHERE event_id % 59 < 12""")
def image_technologies(spark, sf_dir):
    return detect.image_technologies(_images(spark, sf_dir), known.images(spark)).select("repo_id", "k", "id", "kind")


@_query("""SELECT DISTINCT user_id AS repo_id, event_id % 59 AS k, ['node', 'go', 'node', '', 'bun', 'deno'][event_id % 59 - 5] AS runtime, ['22', '1.25.1', '20', '', NULL, '2.5.0'][event_id % 59 - 5] AS version,
    event_id % 59 IN (6, 7, 11) AS exact FROM events WHERE event_id % 59 IN (6, 7, 8, 10, 11)""")
def image_runtimes(spark, sf_dir):
    return detect.image_runtimes(_images(spark, sf_dir)).select("repo_id", "k", "runtime", "version", "exact")


SOURCES = [
    ("a.ts", "x = process.env.KEY_%s ?? 1; // process.env.NO"),
    ("a.ts", "const { A_%s, B: b = 2, ...rest } = import.meta.env"),
    ("b.svelte", "import { env as e } from '$env/dynamic/private'\ne.DYN_%s || other.NO"),
    ("c.ts", "ConfigService; config.getOrThrow('CFG_%s'); map.get('NO')"),
    ("d.ts", "z.object({ SCH_%s: z.string().default('x'), REQ: z.string() }).parse(process.env)"),
    ("m.go", 'v := cmp.Or(os.Getenv("GO_%s"), "1"); w := os.Getenv("PLAIN")'),
    ("s.prisma", 'url = env("DB_%s")'),
    ("t.go", 'P string `env:"TAG_%s,required"`'),
]


@_query("""WITH e AS (SELECT DISTINCT user_id AS repo_id, event_id % 53 AS k, event_id % 4 AS n FROM events WHERE event_id % 53 < 8)
    SELECT repo_id, ['object', 'destructured', 'bound', 'config-service', 'schema', 'go-call', 'prisma', 'go-tag'][1 + k] AS family,
        ['KEY_', 'A_', 'DYN_', 'CFG_', 'SCH_', 'GO_', 'DB_', 'TAG_'][1 + k] || 'N' || n AS name, k NOT IN (0, 2, 4, 5) AS required FROM e
    UNION ALL SELECT DISTINCT repo_id, 'destructured', 'B', false FROM e WHERE k = 1
    UNION ALL SELECT DISTINCT repo_id, 'schema', 'REQ', true FROM e WHERE k = 4
    UNION ALL SELECT DISTINCT repo_id, 'go-call', 'PLAIN', false FROM e WHERE k = 5""")
def source_references(spark, sf_dir):
    e = _events(spark, sf_dir, 53, len(SOURCES)).withColumn("n", F.concat(F.lit("N"), (F.col("i") % 4).cast("string")))
    content = F.replace(_pick([s for _, s in SOURCES], F.col("k")), F.lit("%s"), F.col("n"))
    files = e.select("repo_id", F.concat("n", F.lit("/"), _pick([p for p, _ in SOURCES], F.col("k"))).alias("path"), content.alias("content")).distinct()
    return references.source_references(files).groupBy("repo_id", "family", "name").agg(F.bool_or("required").alias("required"))


@_query("""WITH e AS (SELECT DISTINCT user_id AS repo_id, event_id % 5 AS n FROM events WHERE event_id % 29 = 0)
    SELECT repo_id, 'compose' AS family, 'IMG_' || n AS name, false AS required FROM e UNION ALL SELECT repo_id, 'compose', 'MUST_' || n, true FROM e UNION ALL SELECT DISTINCT repo_id, 'compose', 'BARE', true FROM e
    UNION ALL SELECT repo_id, 'html', 'VITE_T' || n, true FROM e""")
def file_references(spark, sf_dir):
    e = _events(spark, sf_dir, 29, 1).select("repo_id", (F.col("i") % 5).cast("string").alias("n")).distinct()
    compose = F.format_string("image: x:${IMG_%s:-1} # ${NO}\nenv: ${MUST_%s?} $BARE $$NOT no$THIS\n", "n", "n")
    html = F.concat(F.lit("<title>%VITE_T"), "n", F.lit("% %MODE% %s% %HOME%</title>"))
    files = lambda name, content: e.select("repo_id", F.concat("n", F.lit("/" + name)).alias("path"), content.alias("content"))
    both = references.compose_references(files("compose.yml", compose)).unionByName(references.html_references(files("index.html", html)))
    return both.groupBy("repo_id", "family", "name").agg(F.bool_or("required").alias("required"))


@_query("""WITH e AS (SELECT DISTINCT user_id AS repo_id, event_id % 4 AS n, event_id % 37 AS k FROM events WHERE event_id % 37 < 4)
    SELECT repo_id, ['npm', 'npm', 'Packagist', 'Go'][1 + k] AS ecosystem, ['@a/b', 'c', 'v/p', 'x/y'][1 + k] AS name, '1.' || n || '.0' AS version, n || ['/package-lock.json', '/yarn.lock', '/composer.lock', '/go.mod'][1 + k] AS lockfiles FROM e""")
def locked_packages(spark, sf_dir):
    e = _events(spark, sf_dir, 37, 4).select("repo_id", (F.col("i") % 4).cast("string").alias("n"), "k").distinct()
    bodies = ['{"packages": {"": {"version": "9.0.0"}, "node_modules/@a/b": {"version": "1.%s.0"}, "node_modules/l": {"version": "2.0.0", "link": true}}}', '"c@^1", "c@1":\n  version "1.%s.0"\n"w@workspace:.":\n  version: 0.0.0\n', '{"packages": [{"name": "v/p", "version": "v1.%s.0"}, {"name": "v/q", "version": "dev-main"}]}', "module m\nrequire x/y v1.%s.0\n"]
    content = F.replace(_pick(bodies, F.col("k")), F.lit("%s"), F.col("n"))
    files = e.select("repo_id", F.concat("n", F.lit("/"), _pick(["package-lock.json", "yarn.lock", "composer.lock", "go.mod"], F.col("k"))).alias("path"), content.alias("content"))
    return locks.locked_packages(files).select("repo_id", "ecosystem", "name", "version", F.array_join("lockfiles", ",").alias("lockfiles"))


@_query("""WITH e AS (SELECT DISTINCT user_id AS repo_id, event_id % 31 AS k FROM events WHERE event_id % 31 < 7)
    SELECT repo_id, ['a.log', 'pkg/b.log', 'dist/c.js', 'x/dist/d.js', 'pkg/e.txt', 'f.txt', 'x/build/g.js'][1 + k] AS path FROM e WHERE k IN (0, 2, 6) OR k = 1 AND repo_id % 2 = 1 OR k = 4 AND repo_id % 2 = 0""")
def ignored_paths(spark, sf_dir):
    listed = ["a.log", "pkg/b.log", "dist/c.js", "x/dist/d.js", "pkg/e.txt", "f.txt", "x/build/g.js"]
    files = _events(spark, sf_dir, 31, 7).select("repo_id", _pick(listed, F.col("k")).alias("path")).distinct()
    repos = _events(spark, sf_dir, 1, 1).select("repo_id").distinct()
    ignore = repos.select("repo_id", F.lit(".gitignore").alias("path"), F.lit("*.log\n/dist/\nbuild/\n").alias("content"))
    deep = repos.where("repo_id % 2 = 0").select("repo_id", F.lit("pkg/.gitignore").alias("path"), F.lit("!*.log\n*.txt\n").alias("content"))
    return small_formats.ignored_paths(files, small_formats.parse_ignore_rules(ignore.unionByName(deep)))


@_query("""WITH e AS (SELECT DISTINCT user_id AS repo_id, event_id % 3 AS n FROM events WHERE event_id % 23 = 0)
    SELECT repo_id, 'M' || n AS file, 'build' AS name, 'go build ./' || n AS command FROM e UNION ALL SELECT repo_id, 'M' || n, 'all', '' FROM e UNION ALL SELECT repo_id, 'J' || n, 'run', 'cargo run ' || n FROM e""")
def task_files(spark, sf_dir):
    e = _events(spark, sf_dir, 23, 1).select("repo_id", (F.col("i") % 3).cast("string").alias("n")).distinct()
    make = e.select("repo_id", F.concat(F.lit("M"), "n").alias("path"), F.concat(F.lit("X := 1\n.PHONY: all\nall: build\nbuild:\n\t# c\n\t@go build ./"), "n", F.lit("\n%.o: %.c\n\tcc\n")).alias("content"))
    just = e.select("repo_id", F.concat(F.lit("J"), "n").alias("path"), F.concat(F.lit("set shell := ['sh']\nrun a='x:y':\n  @cargo run "), "n", F.lit("\n_hidden:\n  x\n")).alias("content"))
    both = small_formats.parse_makefile(make).drop("line").unionByName(small_formats.parse_justfile(just).drop("line"))
    return both.withColumnRenamed("path", "file")


@_query("""WITH r AS (SELECT DISTINCT user_id AS repo_id FROM events), s AS (SELECT DISTINCT user_id AS repo_id, event_id % 5 AS n FROM events WHERE event_id % 19 = 0)
    SELECT repo_id, 'svc' AS package, 'net/http handlers in svc/h' || min(n) || '.go' AS evidence FROM s WHERE repo_id % 3 <> 0 GROUP BY repo_id""")
def detect_net_http(spark, sf_dir):
    repos = _events(spark, sf_dir, 1, 1).select("repo_id").distinct()
    body = 'package x\nimport (\n\t"net/http"\n)\nfunc f() { http.HandleFunc("/", g) }\n'
    found = _events(spark, sf_dir, 19, 1).select("repo_id", F.concat(F.lit("svc/h"), (F.col("i") % 5).cast("string"), F.lit(".go")).alias("path"), F.lit(body).alias("content")).distinct()
    test = repos.select("repo_id", F.lit("svc/a_test.go").alias("path"), F.lit(body).alias("content"))
    gin = repos.where("repo_id % 3 = 0").select("repo_id", F.lit("svc").alias("package"), F.lit("github.com/gin-gonic/gin").alias("name"), F.lit("go").alias("ecosystem"), F.lit(False).alias("indirect"))
    return detect.net_http_signals(found.unionByName(test), repos.select("repo_id", F.lit("svc").alias("dir")), gin).select("repo_id", "package", "evidence")
