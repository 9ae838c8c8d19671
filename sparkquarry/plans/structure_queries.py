"""Driver queries of Compose projects, module graphs, routes, commands, catalogs and small formats.

Every event is a small repository of its own, so all rows of the table are read; documents and facts come from columns of the event by the same
arithmetic on both sides, and the SQL states what they are to give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry import sinks
from sparkquarry.functions import addresses, commands
from sparkquarry.operators import evidence, modules, selection
from sparkquarry.plans.queries import _query, _read
from sparkquarry.sources import ci, compose, files as sources, git_config, page_routes

def _iu() -> tuple[Column, Column]:
    """An event's number and its user."""
    return F.col("i"), F.col("u")


def _events(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.col("user_id").alias("u"))


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _n(value: Column) -> Column:
    return value.cast("string")


def _files(events: DataFrame, column: str, *files) -> DataFrame:
    """One row for each (path, content, condition) of an event; repo_id is the event."""
    rows = F.array(*[F.when(test, F.struct(F.lit(path).alias("path"), content.alias(column))) for path, content, test in files])
    return events.select(F.col("i").alias("repo_id"), F.explode(F.array_compact(rows)).alias("f")).select("repo_id", "f.*")


def _compose(spark, sf_dir) -> DataFrame:
    i, u = _iu()
    top = _text(
        '{"include":["inc/compose.yml"],"services":{"web":{"extends":{"service":"base","file":"shared/common.yml"},"environment":["P=1"],"ports":["', _n(3000 + i % 7),
        ':80"]},"job":{"extends":"web","image":"job:', _n(i % 3), '"}}}',
    )
    inner = _text('{"include":["../compose.yml"],"services":{"db":{"image":"postgres:', _n(14 + i % 4), '","env_file":{"path":".env"}},"web":{"image":"dup"}}}')
    shared = _text('{"services":{"base":{"image":"img', _n(u % 5), '","environment":{"A":"x","P":"2"},"ports":[', _n(9000 + u % 3), '],"env_file":["base.env"],"depends_on":["gone"]}}}')
    return _files(_events(spark, sf_dir), "doc", ("compose.yml", top, F.lit(True)), ("inc/compose.yml", inner, i % 2 == 0), ("shared/common.yml", shared, i % 5 != 0))


@_query("""WITH e AS (SELECT event_id AS i, user_id AS u, event_id % 5 <> 0 AS has FROM events),
    own AS (SELECT i, '.' AS project, n.name, 'compose.yml' AS source, CASE WHEN n.name = 'job' THEN 'job:' || (i % 3) WHEN has THEN 'img' || (u % 5) END AS image,
        CASE WHEN has THEN (9000 + u % 3) || ',' ELSE '' END || (3000 + i % 7) || ':80' AS ports, CASE WHEN has THEN 'A,P' ELSE 'P' END AS environment, CASE WHEN has THEN 'shared/base.env' ELSE '' END AS env_files
        FROM e, (VALUES ('web'), ('job')) n(name)),
    inc AS (SELECT i, p.project, 'db' AS name, 'inc/compose.yml' AS source, 'postgres:' || (14 + i % 4) AS image, '' AS ports, '' AS environment, '.env' AS env_files FROM e, (VALUES ('.'), ('inc')) p(project) WHERE i % 2 = 0),
    dup AS (SELECT i, 'inc' AS project, 'web' AS name, 'inc/compose.yml' AS source, 'dup' AS image, '' AS ports, '' AS environment, '' AS env_files FROM e WHERE i % 2 = 0),
    back AS (SELECT i, 'inc' AS project, 'job' AS name, source, image, ports, environment, env_files FROM own WHERE name = 'job' AND i % 2 = 0)
    SELECT i AS repo_id, project, name, source, image, ports, environment, env_files FROM (FROM own UNION ALL FROM inc UNION ALL FROM dup UNION ALL FROM back)""")
def compose_services(spark, sf_dir):
    _, services = compose.resolve(_compose(spark, sf_dir))
    found = compose.merge_services(compose.parse_services(services))
    return found.select(
        "repo_id", "project", "name", "source", "image", F.array_join(F.transform("ports", lambda p: p["raw"]), ",").alias("ports"),
        F.array_join("environment", ",").alias("environment"), F.array_join("env_files", ",").alias("env_files"),
    )


@_query("""WITH e AS (SELECT event_id AS i, event_id % 9 AS k, 1 + event_id % 60000 AS p FROM events)
    SELECT i AS repo_id, CASE k WHEN 1 THEN p || '' WHEN 2 THEN p || '-' || (p + 2) WHEN 3 THEN '${PORT:-' || p || '}' WHEN 5 THEN p || '' WHEN 6 THEN p || '' END AS host,
        CASE WHEN k IN (0, 7) THEN p || '' WHEN k IN (1, 3) THEN '80' WHEN k = 2 THEN p || '-' || (p + 2) WHEN k IN (4, 5) THEN '6001' WHEN k = 6 THEN '53' END AS container,
        CASE WHEN k IN (6, 7) THEN 'udp' WHEN k < 8 THEN 'tcp' END AS protocol, CASE k WHEN 4 THEN '127.0.0.1' WHEN 5 THEN '::1' WHEN 6 THEN '::1' END AS host_ip,
        CASE k WHEN 0 THEN p || '' WHEN 1 THEN p || ':80' WHEN 2 THEN p || '-' || (p + 2) || ':' || p || '-' || (p + 2) WHEN 3 THEN '${PORT:-' || p || '}:80' WHEN 4 THEN '127.0.0.1::6001'
            WHEN 5 THEN '[::1]:' || p || ':6001' WHEN 6 THEN '[::1]:' || p || ':53/udp' WHEN 7 THEN p || '/UDP' END AS raw
    FROM e""")
def compose_ports(spark, sf_dir):
    i, _ = _iu()
    p, q = _n(1 + i % 60000), _n(3 + i % 60000)
    forms = [
        p, _text('"', p, ':80"'), _text('"', p, "-", q, ":", p, "-", q, '"'), _text('"${PORT:-', p, '}:80"'), F.lit('"127.0.0.1::6001"'), _text('"[::1]:', p, ':6001"'),
        _text('{"target":53,"published":"', p, '","host_ip":"::1","protocol":"UDP"}'), _text('"', p, '/UDP"'), _text('"web:', p, '"'),
    ]
    rows = _events(spark, sf_dir).select(i.alias("repo_id"), F.get(F.array(*forms), (i % 9).cast("int")).alias("entry"))
    return rows.select("repo_id", compose.port_of(F.col("entry")).alias("p")).select("repo_id", "p.*")


@_query("""WITH e AS (SELECT event_id AS i, user_id AS u FROM events),
    r AS (SELECT i, path FROM e, (VALUES (0, 'shared/base.env'), (1, '.env'), (2, 'hid/deep/x.env'), (3, 'node_modules/a/x.env'), (4, 'a/b/c/d.env')) t(k, path) WHERE k <> 1 OR i % 2 = 0)
    SELECT i AS repo_id, path FROM r WHERE path = 'shared/base.env' AND i % 3 <> 0 OR path = '.env' AND i % 4 <> 0 OR path = 'hid/deep/x.env' AND i % 7 <> 0""")
def compose_env_known_missing(spark, sf_dir):
    i, _ = _iu()
    listed = F.array(*[F.struct(F.lit(p).alias("path"), t.alias("wanted")) for p, t in (("shared/base.env", F.lit(True)), (".env", i % 2 == 0), ("hid/deep/x.env", F.lit(True)), ("node_modules/a/x.env", F.lit(True)), ("a/b/c/d.env", F.lit(True)))])
    references = _events(spark, sf_dir).select(i.alias("repo_id"), F.explode(listed).alias("r")).where("r.wanted").select("repo_id", "r.path")
    files = _files(
        _events(spark, sf_dir), "kind", ("shared/base.env", F.lit("file"), i % 3 == 0), (".env", F.lit("file hidden"), i % 4 == 0), ("hid", F.lit("directory hidden"), i % 7 == 0), ("shared", F.lit("directory"), F.lit(True)),
    ).select("repo_id", "path", F.col("kind").endswith("hidden").alias("ignored"), F.col("kind").startswith("directory").alias("directory"))
    return compose.known_missing(references, files, most_depth=2)


@_query("""WITH e AS (SELECT event_id AS i FROM events), s AS (SELECT i, name, CASE name WHEN 'a' THEN 'api/Dockerfile' WHEN 'b' THEN 'x/dev.Dockerfile' ELSE 'Dockerfile' END AS wanted FROM e, (VALUES ('a'), ('b'), ('c')) n(name)),
    f AS (SELECT i, path FROM e, (VALUES ('api/Dockerfile', 2), ('x/dev.Dockerfile', 3), ('other/Dockerfile', 1)) d(path, m) WHERE i % m = 0)
    SELECT s.i AS repo_id, name, path FROM s LEFT JOIN f ON s.i = f.i AND wanted = path UNION ALL SELECT i, NULL, path FROM f WHERE path = 'other/Dockerfile'""")
def compose_dockerfiles(spark, sf_dir):
    i, _ = _iu()
    built = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("source"), F.lit(b).alias("build"), F.lit(d).cast("string").alias("dockerfile")) for n, s, b, d in (("a", "compose.yml", "./api", None), ("b", "x/compose.yml", ".", "dev.Dockerfile"), ("c", "compose.yml", ".", None))])
    services = _events(spark, sf_dir).select(i.alias("repo_id"), F.explode(built).alias("s")).select("repo_id", "s.*")
    files = _files(_events(spark, sf_dir), "kind", ("api/Dockerfile", F.lit(""), i % 2 == 0), ("x/dev.Dockerfile", F.lit(""), i % 3 == 0), ("other/Dockerfile", F.lit(""), F.lit(True))).drop("kind")
    found, unused = compose.service_dockerfiles(services, files)
    return found.select("repo_id", "name", "path").unionByName(unused.select("repo_id", F.lit(None).cast("string").alias("name"), "path"))


@_query("""WITH e AS (SELECT event_id AS i FROM events), n AS (SELECT i, name, line FROM e, (VALUES ('A', 1, 1), ('KEY', 2, 1), ('ABCDEF', 3, 5), ('D', 5, 1), ('LAST', 6, 1)) t(name, line, m) WHERE i % m = 0)
    SELECT i AS repo_id, name, name = 'ABCDEF' OR name = 'D' AND i % 3 = 0 AS empty, CASE WHEN name = 'A' THEN i % 60000 END AS port FROM n""")
def dotenv_names(spark, sf_dir):
    i, _ = _iu()
    foot = F.when(i % 5 == 0, "").otherwise("-----END PRIVATE KEY-----")  # a head without a foot hides nothing
    body = _text("A=redis://h:", _n(i % 60000), '\nKEY="-----BEGIN PRIVATE KEY-----\nABCDEF=\n', foot, '"\nD=', F.when(i % 3 == 0, "").otherwise("x"), "\nLAST='two\nlines=1'\n")
    body = F.when(i % 5 == 0, F.replace(body, F.lit('"'), F.lit(""))).otherwise(body)
    return sources.parse_dotenv(_files(_events(spark, sf_dir), "content", (".env", body, F.lit(True)))).select("repo_id", "name", "empty", "port")


@_query("""WITH e AS (SELECT event_id AS i, user_id AS u FROM events) SELECT i AS repo_id, n AS nth, CASE n WHEN 1 THEN 'node:' || (18 + i % 5) || '-slim' WHEN 2 THEN 'base' ELSE 'x/' || CASE WHEN u % 2 = 0 THEN 'own' ELSE 'dflt' END || ':$LATE' END AS image,
    CASE n WHEN 1 THEN 'base' WHEN 2 THEN 'app' ELSE '' END AS name, n = 2 AS from_stage FROM e, (VALUES (1), (2), (3)) t(n)""")
def docker_stages(spark, sf_dir):
    from pyspark.sql import Window

    i, u = _iu()
    text = _text(
        "# escape=`\nARG V=", _n(18 + i % 5), "\nARG TAG=${V}-slim NAME=", F.when(u % 2 == 0, '"own"').otherwise(""), "\nFROM --platform=$P `\n  # note\n  node:$TAG AS base\nARG LATE=1\nRUN <<EOT\nFROM nowhere\nEOT\n",
        "FROM base AS App\nCOPY <<-'A' <<B /x\nFROM a\nA\nFROM b\nB\nFROM x/${NAME:-dflt}:$LATE\n",
    )
    stages = sources.docker_stages(sources.parse_dockerfile(_files(_events(spark, sf_dir), "content", ("Dockerfile", text, F.lit(True)))))
    return stages.select("repo_id", F.row_number().over(Window.partitionBy("repo_id").orderBy("ord")).alias("nth"), "image", "name", "from_stage")


@_query("""SELECT event_id AS repo_id, 'example.com/m' || (user_id % 9) AS module, CASE WHEN event_id % 4 = 0 THEN 'v1.' || (event_id % 11) || '.0' END AS required FROM events WHERE event_id % 3 <> 0""")
def gomod_modules(spark, sf_dir):
    i, u = _iu()
    text = _text(F.when(i % 3 != 0, _text("module example.com/m", _n(u % 9), "\n")).otherwise("// module none\n"), "go 1.22\n", F.when(i % 4 == 0, _text("require (\n\tx/y v1.", _n(i % 11), ".0 // indirect\n)\n")).otherwise(""))
    rows = sources.parse_gomod(_files(_events(spark, sf_dir), "content", ("go.mod", text, F.lit(True))))
    of = lambda directive, name: F.max(F.when(F.col("directive") == directive, F.col(name)))
    return rows.groupBy("repo_id").agg(of("module", "module").alias("module"), of("require", "version").alias("required"))


@_query("""SELECT event_id AS repo_id, 'pkg' || (user_id % 7) AS name, event_id % 2 = 0 AS private, CASE event_id % 3 WHEN 0 THEN 'packages/*' WHEN 1 THEN 'apps/*,libs/*' END AS workspaces, 'build=vite' AS scripts,
    CASE WHEN event_id % 4 > 0 THEN 'react=^' || (event_id % 4) ELSE '' END AS dependencies FROM events""")
def manifest_fields(spark, sf_dir):
    i, u = _iu()
    spaces = F.when(i % 3 == 0, ',"workspaces":["packages/*",5]').when(i % 3 == 1, ',"workspaces":{"packages":["apps/*","libs/*"],"nohoist":[]}').otherwise("")
    text = _text(
        '{"name":"pkg', _n(u % 7), '","private":', F.when(i % 2 == 0, "true").otherwise("false"), spaces, ',"scripts":{"build":"vite","n":5,"o":{}},"dependencies":{', F.when(i % 4 > 0, _text('"react":"^', _n(i % 4), '"')).otherwise(""), "}}",
    )
    m = _files(_events(spark, sf_dir), "content", ("package.json", text, F.lit(True))).select("repo_id", sources.parse_manifest(F.col("content")).alias("m"))
    pairs = lambda c: F.array_join(F.transform(F.map_entries(F.col(f"m.{c}")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias(c)
    return m.select("repo_id", "m.name", "m.private", F.array_join("m.workspaces", ",").alias("workspaces"), pairs("scripts"), pairs("dependencies"))


@_query("""WITH e AS (SELECT event_id AS i FROM events), t AS (SELECT * FROM (VALUES ('./a', 2, 'src/a.ts'), ('./b.js', 1, 'src/b.ts'), ('./d', 3, 'src/d/index.ts'), ('../top', 1, 'top.mts'), ('../../out', 1, NULL), ('./none', 1, NULL)) v(specifier, m, target))
    SELECT i AS repo_id, specifier, CASE WHEN specifier = './b.js' AND i % 5 = 0 THEN 'src/b.js' WHEN i % m = 0 THEN target END AS target FROM e, t""")
def relative_imports(spark, sf_dir):
    i, _ = _iu()
    asked = F.explode(F.lit(["./a", "./b.js", "./d", "../top", "../../out", "./none"])).alias("specifier")
    imports = _events(spark, sf_dir).select(i.alias("repo_id"), F.lit("src/main.ts").alias("path"), asked)
    files = _files(_events(spark, sf_dir), "kind", *[(p, F.lit(""), t) for p, t in (("src/a.ts", i % 2 == 0), ("src/b.ts", F.lit(True)), ("src/b.js", i % 5 == 0), ("src/d/index.ts", i % 3 == 0), ("top.mts", F.lit(True)))])
    return modules.resolve_imports(imports, files).select("repo_id", "specifier", "target")


@_query("""WITH RECURSIVE n AS (SELECT event_id AS i, event_id // 16 AS repo, event_id % 16 AS k FROM events),
    edge AS (SELECT a.repo, a.k, b.k AS t FROM n a JOIN n b ON a.repo = b.repo AND (b.k = (a.k * 3 + a.repo) % 16 OR b.k = (a.k + 5) % 16 AND a.k % 4 = 0)),
    reach AS (SELECT repo, k, 0 AS level FROM n WHERE k = repo % 16 UNION SELECT e.repo, e.t, level + 1 FROM reach r JOIN edge e ON r.repo = e.repo AND r.k = e.k WHERE level < 16)
    SELECT repo AS repo_id, 'm' || k || '.ts' AS path, CAST(min(level) AS INTEGER) AS level FROM reach GROUP BY ALL""")
def mounted_modules(spark, sf_dir):
    i, _ = _iu()
    repo, k = F.floor(i / 16), i % 16
    name = lambda n: F.concat(F.lit("m"), _n(n))
    nodes = _events(spark, sf_dir).select(repo.alias("repo_id"), k.alias("k"))
    files = nodes.select("repo_id", F.concat(name(F.col("k")), F.lit(".ts")).alias("path"))
    targets = F.explode(F.array_compact(F.array((F.col("k") * 3 + F.col("repo_id")) % 16, F.when(F.col("k") % 4 == 0, (F.col("k") + 5) % 16)))).alias("t")
    mounts = nodes.select("repo_id", "k", targets).select("repo_id", F.concat(name(F.col("k")), F.lit(".ts")).alias("path"), F.concat(F.lit("./"), name(F.col("t"))).alias("specifier"))
    users = nodes.where("k = repo_id % 16").select("repo_id", F.concat(name(F.col("k")), F.lit(".ts")).alias("path"))
    return modules.mounted_files(users, mounts, files)[0].select("repo_id", "path", "level")


@_query("""SELECT event_id AS repo_id, name, CASE WHEN name = 'c' THEN '^' || (user_id % 9) WHEN name = 'a' AND event_id % 2 = 0 THEN '^2.' || (event_id % 7) WHEN name = 'b' AND event_id % 3 = 0 THEN '~3.' || (user_id % 5)
    WHEN name = 'a' THEN 'catalog:' ELSE 'catalog: next' END AS range FROM events, (VALUES ('a'), ('b'), ('c')) n(name)""")
def catalog_ranges(spark, sf_dir):
    i, u = _iu()
    entry = lambda *v: F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(k) for k, x in zip(("catalog", "name", "range"), v, strict=True)])
    rows = F.array(entry("", "a", "catalog:"), entry("", "b", "catalog: next"), entry("", "c", _text("^", _n(u % 9))))
    refs = _events(spark, sf_dir).select(i.alias("repo_id"), F.explode(rows).alias("r")).select("repo_id", "r.name", "r.range")
    have = F.array_compact(F.array(F.when(i % 2 == 0, entry("default", "a", _text("^2.", _n(i % 7)))), F.when(i % 3 == 0, entry("next", "b", _text("~3.", _n(u % 5)))), entry("next", "a", "no")))
    catalogs = _events(spark, sf_dir).select(i.alias("repo_id"), F.explode(have).alias("c")).select("repo_id", "c.*")
    return modules.resolve_catalogs(refs, catalogs)


MATCHERS = [
    ("typescript", "tsc", "tsc", [], ["--noEmit"], None), ("types", "tsc --noEmit", "tsc", ["--noEmit"], [], None), ("vite", "vite build", "vite", ["build"], [], None), ("node-test", "node --test", "node", ["--test"], [], "test"),
    ("jest", "jest", "jest", [], [], None),
]


@_query("""WITH e AS (SELECT event_id AS i, event_id % 6 AS k FROM events)
    SELECT i AS repo_id, 'test' AS script, id FROM e, (VALUES (0, 'typescript'), (0, 'vite'), (1, 'types'), (2, 'jest'), (3, 'node-test'), (4, 'jest'), (4, 'vite')) v(n, id) WHERE k = n""")
def script_tools(spark, sf_dir):
    i, _ = _iu()
    lines = ["tsc -b && vite build", "npx -y tsc --noEmit --config t.json", "NODE_ENV=test cross-env A='x && tsc' jest", "node --test 'tsc;jest'", "dotenv -e .env -- jest | pnpm exec vite build", 'echo "vite build"']
    scripts = _events(spark, sf_dir).select(i.alias("repo_id"), F.lit(".").alias("package"), F.lit("test").alias("name"), F.get(F.lit(lines), (i % 6).cast("int")).alias("command"))
    matchers = spark.createDataFrame(MATCHERS, "id string, label string, bin string, needs array<string>, without array<string>, script string")
    return commands.script_signals(scripts, matchers).select("repo_id", "script", "id")


@_query("""SELECT event_id AS repo_id, CASE event_id % 4 WHEN 0 THEN (18 + user_id % 3) || ',' || (22 + user_id % 3) WHEN 1 THEN 'v' || (18 + user_id % 3) || '-linux,v' || (22 + user_id % 3) || '-linux' WHEN 2 THEN 'x' || (user_id % 7) END AS found FROM events""")
def matrix_expressions(spark, sf_dir):
    i, u = _iu()
    values = F.array(F.lit("${{ matrix.node }}"), F.lit("v${{ matrix.node }}-${{ env.OS }}"), _text("x${{ '", _n(u % 7), "' }}"), F.lit("${{ secrets.T }}"))
    matrix = _text('{"node":[', _n(18 + u % 3), '],"include":[{"node":"', _n(22 + u % 3), '"}]}')
    rows = _events(spark, sf_dir).select(i.alias("repo_id"), F.get(values, (i % 4).cast("int")).alias("v"), matrix.alias("m"), F.array(F.lit("{}"), F.lit('{"OS":"linux"}')).alias("e"))
    return rows.select("repo_id", F.array_join(ci.expand_expression(F.col("v"), F.col("m"), F.col("e")), ",").alias("found"))


@_query("""SELECT event_id AS repo_id, CASE WHEN event_id % 3 = 0 THEN 'lint,' ELSE '' END || 'test' || CASE WHEN event_id % 2 = 0 THEN ',build' ELSE '' END AS tasks FROM events""")
def ci_job_tasks(spark, sf_dir):
    i, _ = _iu()
    texts = F.array_compact(F.array(F.when(i % 2 == 0, F.lit("npm run build")), F.lit("npm ci && npx vitest"), F.when(i % 3 == 0, F.lit("eslint .")), F.lit("npm test")))
    steps = _events(spark, sf_dir).select(i.alias("repo_id"), F.lit("ci.yml").alias("path"), F.lit("j").alias("job"), F.explode(texts).alias("text"))
    return ci.job_tasks(steps).select("repo_id", F.array_join("tasks", ",").alias("tasks"))


@_query("""WITH e AS (SELECT event_id AS i, user_id AS u FROM events) SELECT i AS repo_id, 'origin' AS name, 'https://h/u' || (u % 11) || '/r.git' AS url, CASE WHEN i % 2 = 0 THEN 'git@h:p' || (i % 5) END AS push_url FROM e
    UNION ALL SELECT i, 'Fork "x"', 'b', NULL FROM e WHERE i % 3 = 0""")
def git_remotes(spark, sf_dir):
    i, u = _iu()
    text = _text(
        '[core]\n\tbare = false\n[remote "origin"]\n\turl = "https://h/u', _n(u % 11), '/r.git" # main\n\turl = second\n', F.when(i % 2 == 0, _text("\tpushurl = git@h:\\\np", _n(i % 5), "\n")).otherwise(""),
        F.when(i % 3 == 0, F.lit('[remote "Fork \\"x\\""]\n url = b ; c\n')).otherwise(F.lit('[remote "x\n url = b\n')),
    )
    return git_config.remotes(git_config.parse_git_config(_files(_events(spark, sf_dir), "content", (".git/config", text, F.lit(True)))))


_PAGES_OF = "WITH e AS (SELECT event_id AS i FROM events), "


@_query(_PAGES_OF + """r AS (SELECT i, t.* FROM e, (VALUES ('page', 'GET', '/', 'app/pages/index.vue', NULL, 1, 0), ('page', 'GET', '/p/[id]', 'app/pages/(g)/p/[id].vue', NULL, 1, 0), ('page', 'GET', '/set', 'app/pages/set.vue', 'nested route parent', 2, 0),
        ('page', 'GET', '/set', 'app/pages/set/index.vue', NULL, 2, 1), ('page', 'GET', '/set/x', 'app/pages/set/x.vue', NULL, 1, 0), ('api', 'GET', '/api/u/[id]', 'server/api/u/[id].get.ts', NULL, 1, 0), ('api', 'POST', '/h', 'server/routes/h.post.dev.ts', 'development only', 3, 0))
        t(kind, method, path, file, note, m, k) WHERE CASE m WHEN 2 THEN i % 2 = k WHEN 3 THEN i % 3 = 0 ELSE true END)
    SELECT i AS repo_id, kind, method, path, file, note FROM r""")
def nuxt_file_routes(spark, sf_dir):
    i, _ = _iu()
    names = [("app/pages/index.vue", F.lit(True)), ("app/pages/(g)/p/[id].vue", F.lit(True)), ("app/pages/set.vue", F.lit(True)), ("app/pages/set/index.vue", i % 2 == 1), ("app/pages/set/x.vue", F.lit(True)), ("app/pages/-no.vue", F.lit(True)), ("pages/old.vue", F.lit(True)), ("server/api/u/[id].get.ts", F.lit(True)), ("server/routes/h.post.dev.ts", i % 3 == 0), ("server/api/a.test.ts", F.lit(True))]
    files = _files(_events(spark, sf_dir), "package", *[(p, F.lit("."), t) for p, t in names])
    packages = _events(spark, sf_dir).select(i.alias("repo_id"), F.lit(".").alias("package"), F.lit(None).cast("string").alias("src_dir"))
    return evidence.finalise_routes(page_routes.nuxt_routes(files, packages)).select("repo_id", "kind", "method", "path", "file", "note")


@_query(_PAGES_OF + """r AS (SELECT i, t.* FROM e, (VALUES ('page', 'GET', '/', 'app/page.tsx', 1), ('page', 'GET', '/shop', 'app/(a)/shop/page.tsx', 2), ('page', 'GET', '/shop', 'app/@s/shop/page.tsx', 3), ('api', 'GET', '/api/r', 'app/api/r/route.ts', 1), ('api', 'POST', '/api/r', 'app/api/r/route.ts', 4),
        ('page', 'GET', '/b', 'pages/b/index.tsx', 1), ('api', 'ANY', '/api/u', 'pages/api/u.ts', 1)) t(kind, method, path, file, m) WHERE CASE m WHEN 2 THEN i % 2 = 0 WHEN 3 THEN i % 2 = 1 WHEN 4 THEN i % 5 = 0 ELSE true END)
    SELECT i AS repo_id, kind, method, CASE WHEN i % 3 > 0 THEN path WHEN path = '/' THEN '/base' ELSE '/base' || path END AS path, file FROM r""")
def next_file_routes(spark, sf_dir):
    i, _ = _iu()
    body = _text("export async function GET() {}\n", F.when(i % 5 == 0, F.lit("const h = 1\nexport { h as POST }\n")).otherwise(F.lit("// export const POST = 1\n")))
    names = [("app/page.tsx", F.lit(True)), ("app/(a)/shop/page.tsx", i % 2 == 0), ("app/@s/shop/page.tsx", F.lit(True)), ("app/_x/page.tsx", F.lit(True)), ("app/api/r/route.ts", F.lit(True)), ("pages/b/index.tsx", F.lit(True)), ("pages/api/u.ts", F.lit(True)), ("pages/_app.tsx", F.lit(True)), ("src/app/page.tsx", F.lit(True))]
    files = _files(_events(spark, sf_dir), "content", *[(p, body if p.endswith("route.ts") else F.lit(""), t) for p, t in names]).withColumn("package", F.lit("."))
    packages = _events(spark, sf_dir).select(i.alias("repo_id"), F.lit(".").alias("package"), F.when(i % 3 == 0, "/base").alias("base_path"))
    return evidence.finalise_routes(page_routes.next_routes(files, packages)).select("repo_id", "kind", "method", "path", "file")


@_query("""SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN '/u' || (user_id % 9) || '/:id' WHEN 1 THEN '/*rest' || (user_id % 9) WHEN 2 THEN '/a/:p' || (user_id % 9) WHEN 3 THEN '/b' || (user_id % 9) || '/:x' WHEN 4 THEN '/:k/e' ELSE '/c/*f' END AS path,
    CASE event_id % 6 WHEN 1 THEN 'optional catch-all' WHEN 3 THEN 'optional segment' WHEN 4 THEN 'optional parameter' ELSE '' END AS notes FROM events""")
def route_paths(spark, sf_dir):
    i, u = _iu()
    n = _n(u % 9)
    forms = F.array(_text("//u", n, "/[id]/"), _text("[[...rest", n, "]]"), _text("/a/{p", n, ":[a-z]{2}}"), _text("/b", n, "{/:x}"), F.lit("/:k(\\d+)?/e"), F.lit("/c/{f...}"))
    rows = _events(spark, sf_dir).select(i.alias("id"), addresses.route_path(F.get(forms, (i % 6).cast("int"))).alias("r"))
    return rows.select("id", "r.path", F.array_join("r.notes", ",").alias("notes"))


@_query("""SELECT event_id AS id, CASE event_id % 6 WHEN 5 THEN NULL WHEN 0 THEN 'https://github.com/u' || (user_id % 9) || '/r' WHEN 1 THEN 'https://gitlab.com/u' || (user_id % 9) || '/r' ELSE 'https://h.org/u' || (user_id % 9) || '/r' END AS url,
    CASE event_id % 6 WHEN 2 THEN 'h.org' WHEN 3 THEN 'h.org' WHEN 4 THEN 'h.org' WHEN 1 THEN NULL END AS host FROM events""")
def repository_addresses(spark, sf_dir):
    i, u = _iu()
    own = _text("u", _n(u % 9), "/r")
    forms = F.array(own, _text("gitlab.com/", own), _text("git@h.org:", own, ".git"), _text("ssh://me:pw@h.org/", own, ".git"), _text("git+https://h.org/", own, "/?q=1#x"), _text("/srv/", own))
    rows = _events(spark, sf_dir).select(i.alias("id"), F.get(forms, (i % 6).cast("int")).alias("v"))
    return rows.select("id", addresses.repository_url(F.col("v")).alias("url"), addresses.remote_host(F.regexp_replace("v", r"^git\+", "")).alias("host"))


@_query("""WITH e AS (SELECT event_id AS i FROM events) SELECT i AS repo_id, path, package FROM e, (VALUES ('a.ts', '.', 1), ('web/b.vue', 'web', 2), ('web/c.go', '.', 3)) t(path, package, m)
    WHERE CASE m WHEN 2 THEN i % 2 = 0 WHEN 3 THEN i % 2 = 1 ELSE true END""")
def selected_sources(spark, sf_dir):
    i, _ = _iu()
    names = [("a.ts", F.lit(True)), ("web/b.vue", i % 2 == 0), ("web/c.go", i % 2 == 1), ("dist/d.js", F.lit(True)), ("e.d.ts", F.lit(True)), ("f.py", F.lit(True)), ("web/package.json", i % 2 == 0)]
    files = _files(_events(spark, sf_dir), "kind", *[(p, F.lit(""), t) for p, t in names])
    packages = files.where("path = 'web/package.json'").select("repo_id", F.lit("web").alias("dir"))
    return selection.source_files(files, packages).select("repo_id", "path", "package")


@_query("""SELECT event_id AS repo_id, path FROM events, (VALUES ('.env', 1), ('web/.env.local', 2), ('deploy/x.env', 3)) t(path, m) WHERE event_id % m = 0""")
def selected_env_files(spark, sf_dir):
    i, _ = _iu()
    names = [".env", "web/.env.local", "deploy/x.env", "test/.env", "a/b/c/d/.env", "README.md"]
    files = _files(_events(spark, sf_dir), "kind", *[(p, F.lit(""), i % m == 0) for p, m in zip(names, (1, 1, 1, 1, 1, 1), strict=True)])
    dirs = _events(spark, sf_dir).where(i % 2 == 0).select(i.alias("repo_id"), F.lit("web").alias("dir"))
    named = _events(spark, sf_dir).select(i.alias("repo_id"), F.explode(F.array_compact(F.array(F.when(i % 3 == 0, "deploy/compose.yml"), F.lit("test/compose.yml")))).alias("path"))
    return selection.env_files(files, dirs, named)


@_query("""WITH e AS (SELECT event_id AS i, user_id AS u FROM events) SELECT i AS repo_id, 'svc' AS package, 'high' AS confidence, (1 + CAST(i % 2 = 0 AS INTEGER)) || ' *_test.go file' || CASE WHEN i % 2 = 0 THEN 's' ELSE '' END || ' in svc' AS evidence FROM e WHERE i % 3 > 0
    UNION ALL SELECT i, '.', 'low', (CASE WHEN i % 3 = 0 THEN 2 + CAST(i % 2 = 0 AS INTEGER) ELSE 1 END) || ' *_test.go file' || CASE WHEN i % 3 = 0 THEN 's' ELSE '' END FROM e""")
def go_tests(spark, sf_dir):
    i, _ = _iu()
    files = _files(_events(spark, sf_dir), "kind", ("svc/a_test.go", F.lit(""), F.lit(True)), ("svc/b/c_test.go", F.lit(""), i % 2 == 0), ("top_test.go", F.lit(""), F.lit(True)), ("testdata/x_test.go", F.lit(""), F.lit(True)))
    modules_ = _events(spark, sf_dir).where(i % 3 > 0).select(i.alias("repo_id"), F.lit("svc").alias("dir"))
    return selection.go_test_signals(files, modules_, files.select("repo_id", F.lit(".").alias("dir")).distinct())


@_query("""SELECT user_id AS repo_id, '{"schemaVersion":"1","project":{"events":' || count(*) || '},"diagnostics":[' ||
    coalesce(string_agg('{"code":"E' || (event_id % 7) || '","subject":"s' || event_id || '"}', ',' ORDER BY 'E' || (event_id % 7), 's' || event_id) FILTER (event_id % 5 = 0), '') || ']}' AS document FROM events GROUP BY user_id""")
def project_documents(spark, sf_dir):
    events = _events(spark, sf_dir).select(F.col("u").alias("repo_id"), "i")
    found = events.where("i % 5 = 0").select("repo_id", F.concat(F.lit("E"), _n(F.col("i") % 7)).alias("code"), F.concat(F.lit("s"), _n(F.col("i"))).alias("subject"))
    return sinks.findings_documents({"project": events.groupBy("repo_id").agg(F.count("*").alias("events"))}, {"diagnostics": (found, ["code", "subject"]), "routes": (found, ["code"])}, {"schemaVersion": "1", "note": "left out"})
