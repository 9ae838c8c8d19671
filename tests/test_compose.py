"""Compose documents: includes, extends, ports, services, env files and Dockerfiles."""

import json

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkquarry.sources import compose


@pytest.fixture(scope="module")
def documents(spark):
    docs = {
        "compose.yaml": {
            "include": ["db/compose.yaml", {"path": ["./cache/compose.yaml", "missing.yaml", "${X}.yaml"]}],
            "services": {
                "web": {"extends": {"service": "base", "file": "shared/common.yml"}, "environment": ["PORT=1", "OWN"], "ports": ["3000:3000"], "build": {"dockerfile": "web.Dockerfile"}, "depends_on": ["db"]},
                "worker": {"extends": "web", "image": "me/worker", "profiles": ["jobs"], "env_file": "worker.env"},
                "loop_a": {"extends": "loop_b", "image": "a"}, "loop_b": {"extends": "loop_a", "image": "b", "ports": [1]}, "odd": "no service", "lost": {"extends": "nowhere", "image": "x"},
            },
        },
        "compose.override.yaml": {"services": {"web": {"ports": ["3000:3000", "9229:9229"], "healthcheck": {"test": ["CMD", "x"]}}, "db": {"volumes": ["data:/var"]}}},
        "compose.prod.yaml": {"services": {"web": {"image": "me/web:prod"}}},
        "db/compose.yaml": {"include": ["../compose.yaml", "../cache/compose.yaml"], "services": {"db": {"image": "postgres:17", "env_file": [".env", {"path": "opt.env", "required": False}]}, "web": {"image": "dup"}}},
        "cache/compose.yaml": {"services": {"cache": {"image": "redis", "healthcheck": {"test": "NONE"}}}},
        "shared/common.yml": {"services": {"base": {"extends": {"service": "root", "file": "deep/root.yml"}, "build": ".", "environment": {"PORT": 2, "A": "x"}, "env_file": ["base.env"], "depends_on": ["gone"], "ports": [8080]}}},
        "shared/deep/root.yml": {"services": {"root": {"build": {"context": "ctx", "args": {"K": 1}}, "environment": ["A=y", "Z"], "ports": [{"target": 70}], "expose": [5, "6"]}}},
        "test/compose.yaml": {"services": {"t": {"image": "no"}}},
        "a/b/c/compose.yaml": {"services": {"deep": {"image": "no"}}},
        "other/compose.yml": {"services": ["not", "a", "mapping"]},
    }
    rows = [("r", p, json.dumps(d)) for p, d in docs.items()] + [("r", "tools/compose.yml", "services: [unparsed"), ("s", "compose.yml", '{"services":{"web":{"image":"s"}}}'), ("s", "docker/compose.yml", None)]
    return spark.createDataFrame(rows, "repo_id string, path string, doc string")


def test_names_of_files(spark):
    names = ["compose.yaml", "docker/docker-compose.override.yml", "compose.prod.yaml", "my-compose.yml", "compose..yml", "deploy/local/docker-compose.yml", "deep/er/than/two/compose.yaml", "examples/demo/compose.yaml"]
    rows = spark.createDataFrame([(n,) for n in names], "path string").select("path", compose.role_of(F.col("path")).alias("r"), compose.is_project_file(F.col("path")).alias("own"), compose.project_of(F.col("path")).alias("p")).collect()
    assert [(r.r, r.own) for r in rows] == [("base", True), ("override", True), ("variant", True), (None, False), (None, False), ("base", True), ("base", False), ("base", False)]
    assert [r.p for r in rows[:3]] == [".", "docker", "compose.prod.yaml"]


def test_includes_end_at_cycles_and_missing_files(documents):
    files, _ = compose.resolve(documents)
    got = {(r.repo_id, r.top, r.file): r.level for r in files.collect()}
    assert got[("r", "compose.yaml", "db/compose.yaml")] == 1 and got[("r", "compose.yaml", "cache/compose.yaml")] == 1 and got[("r", "db/compose.yaml", "compose.yaml")] == 1
    assert not any("missing" in f or "test/" in t or t.startswith("a/b/c") for _, t, f in got)
    assert sum(level == 0 for level in got.values()) == 9


def test_extends(documents):
    _, services = compose.resolve(documents)
    own = {r.name: json.loads(r.definition) for r in services.where("file = 'compose.yaml' AND included_from IS NULL").collect()}
    web = own["web"]
    assert web == {
        # a build that is a mapping takes the place of a text
        "build": {"dockerfile": "web.Dockerfile"}, "environment": {"A": "x", "OWN": None, "PORT": "1", "Z": None}, "ports": [{"target": 70}, 8080, "3000:3000"],
        "expose": [5, "6"], "env_file": ["shared/base.env"], "depends_on": ["db"],
    }
    worker = own["worker"]
    assert worker["image"] == "me/worker" and worker["env_file"] == ["shared/base.env", "worker.env"] and "depends_on" not in worker and worker["environment"] == web["environment"]
    assert own["loop_a"] == {"image": "a", "ports": [1]} and set(own["lost"]) == {"image"} and "odd" not in own


def test_a_chain_ends_after_most_levels_and_files(spark):
    chain = {"services": {f"s{i}": {"extends": f"s{i + 1}", "expose": [i]} for i in range(30)} | {"s30": {"expose": [30]}}}
    wide = {"include": [f"inc/{i:02}.yml" for i in range(70)], "services": {"x": {"extends": {"file": "zz.yml", "service": "y"}, "image": "i"}}}
    rows = [("r", "compose.yml", json.dumps(chain)), ("w", "compose.yml", json.dumps(wide)), ("w", "zz.yml", '{"services":{"y":{"expose":[1]}}}')] + [("w", f"inc/{i:02}.yml", "{}") for i in range(70)]
    files, services = compose.resolve(spark.createDataFrame(rows, "repo_id string, path string, doc string"))
    got = {(r.repo_id, r.name): json.loads(r.definition) for r in services.collect()}
    assert got["r", "s0"]["expose"] == list(range(16, -1, -1)) and got["r", "s25"]["expose"] == [30, 29, 28, 27, 26, 25]
    assert files.where("repo_id = 'w' AND level > 0").count() == 64 and set(got["w", "x"]) == {"image"}
    few = compose.resolve(spark.createDataFrame(rows[1:], "repo_id string, path string, doc string"), most_files=71)[1]
    assert set(json.loads(few.where("name = 'x'").first().definition)) == {"image", "expose"}


def test_env_files(documents, spark):
    _, services = compose.resolve(documents)
    refs = compose.env_file_references(services.where("included_from IS NULL"))
    got = {(r.compose_file, r.service, r.path, r.required) for r in refs.collect()}
    assert got == {("compose.yaml", "web", "shared/base.env", True), ("compose.yaml", "worker", "shared/base.env", True), ("compose.yaml", "worker", "worker.env", True), ("db/compose.yaml", "db", "db/.env", True), ("db/compose.yaml", "db", "db/opt.env", False)}
    odd = spark.createDataFrame([("deploy/compose.yaml", '["${E}","/etc/app.env","C:\\\\app.env","~/home.env",42,null,"../shared.env"]'), ("compose.yaml", '"../shared.env"')], "file string, v string")
    odd = odd.select(F.lit("r").alias("repo_id"), "file", F.lit("s").alias("name"), F.concat(F.lit('{"env_file":'), "v", F.lit("}")).alias("definition"))
    assert [r.path for r in compose.env_file_references(odd).collect()] == ["shared.env"]
    files = [(".env", False, False), ("hid", True, True), ("hid/x.env", True, False), ("seen", False, True)]
    files = spark.createDataFrame([("r", *f) for f in files], "repo_id string, path string, ignored boolean, directory boolean")
    want = [".env", "hid/x.env", "hid/y.env", "seen/y.env", "node_modules/a/.env", "a/b/c/d.env", "b.env"]
    refs = spark.createDataFrame([("r", w) for w in want], "repo_id string, path string")
    assert sorted(r.path for r in compose.known_missing(refs, files, most_depth=2).collect()) == ["b.env", "seen/y.env"]


@pytest.mark.parametrize("entry,want", [
    ('"3000"', (None, "3000", "tcp", None, "3000")), ("3000", (None, "3000", "tcp", None, "3000")), ('" 8080:80 "', ("8080", "80", "tcp", None, "8080:80")),
    ('"127.0.0.1:5432:5432"', ("5432", "5432", "tcp", "127.0.0.1", "127.0.0.1:5432:5432")), ('"[::1]:6001:6001"', ("6001", "6001", "tcp", "::1", "[::1]:6001:6001")),
    ('"53/UDP"', (None, "53", "udp", None, "53/UDP")), ('"8000-8002:8000-8002"', ("8000-8002", "8000-8002", "tcp", None, "8000-8002:8000-8002")),
    ('"${HOST_IP}:${PORT:-${OTHER:-1}}:80"', ("${PORT:-${OTHER:-1}}", "80", "tcp", "${HOST_IP}", "${HOST_IP}:${PORT:-${OTHER:-1}}:80")),
    ('"127.0.0.1::5000"', (None, "5000", "tcp", "127.0.0.1", "127.0.0.1::5000")), ('{"target":9229,"published":"9230","protocol":"tcp"}', ("9230", "9229", "tcp", None, "9230:9229")),
    ('{"target":80,"published":"8000-8001","host_ip":"::1","protocol":"UDP"}', ("8000-8001", "80", "udp", "::1", "[::1]:8000-8001:80/udp")), ('{"target":80,"host_ip":"1.2.3.4"}', (None, "80", "tcp", "1.2.3.4", "1.2.3.4::80")),
    ('"${API_TOKEN:-abcdef}:80"', ("${API_TOKEN:-***}", "80", "tcp", None, "${API_TOKEN:-***}:80")), ('"' + "${A:-" * 30_000 + ':80"', None),
    *[(x, None) for x in ("null", "true", '""', '"  "', '"abc"', '"web:80"', "-1", "1.5", "[]", "{}", '{"published":80}', '{"target":"x"}', '{"target":80,"protocol":"tcp; rm"}', None, "not json", '"1:2:{3"')],
])
def test_ports(entry, want):
    got = compose._ports(pd.Series([entry]))
    row = tuple(got.iloc[0])
    assert row == (want or (None,) * 5)


def test_services_of_projects(documents):
    _, resolved = compose.resolve(documents)
    parsed = compose.parse_services(resolved)
    got = {(r.project, r.name): r for r in compose.merge_services(parsed).where("repo_id = 'r'").collect()}
    web = got[".", "web"]
    assert (web.source, web.included_from, web.image, web.build, web.dockerfile, web.healthcheck) == ("compose.yaml", None, None, ".", "web.Dockerfile", True)
    assert [p.raw for p in web.ports] == ["70", "8080", "3000:3000", "9229:9229"] and web.environment == ["A", "OWN", "PORT", "Z"] and web.expose == ["5", "6"] and web.depends_on == ["db"]
    # what an include brings in merges with the project's own override, not with another include of that name
    db = got[".", "db"]
    assert (db.source, db.included_from, db.image, db.volumes) == ("db/compose.yaml", "compose.yaml", "postgres:17", ["data:/var"]) or (db.source, db.image) == ("compose.override.yaml", None)
    assert got["compose.prod.yaml", "web"].image == "me/web:prod" and got["db", "web"].image == "dup" and not got[".", "cache"].healthcheck
    bindings = {(r.service, r.port) for r in compose.port_bindings(compose.merge_services(parsed)).where("repo_id = 'r' AND project = '.'").collect()}
    assert bindings == {("web", 3000), ("web", 9229), ("worker", 3000)}


def test_dockerfiles_of_services(spark):
    services = spark.createDataFrame([("r", "a", "compose.yml", "api", None), ("r", "b", "x/compose.yml", ".", "dev.Dockerfile"), ("r", "c", "compose.yml", "https://x/y.git", None), ("r", "d", "compose.yml", None, None)], "repo_id string, name string, source string, build string, dockerfile string")
    files = spark.createDataFrame([("r", p) for p in ("api/Dockerfile", "x/dev.Dockerfile", "Dockerfile")], "repo_id string, path string")
    found, unused = compose.service_dockerfiles(services, files)
    assert {r.name: r.path for r in found.collect()} == {"a": "api/Dockerfile", "b": "x/dev.Dockerfile", "c": None, "d": None} and [r.path for r in unused.collect()] == ["Dockerfile"]


def test_each_document_is_read_once_and_equal_definitions_too(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(doc):
        reads.add(1)
        return doc

    docs = {"compose.yaml": {"include": ["a.yaml"], "services": {"x": {"extends": "y"}, "y": {"extends": {"service": "z", "file": "c.yaml"}}}}, "a.yaml": {"include": ["b.yaml"]}, "b.yaml": {"services": {"w": {"image": "i"}}}, "c.yaml": {"services": {"z": {"image": "z"}}}}
    rows = spark.createDataFrame([(f"r{i}", p, json.dumps(d)) for i in range(25) for p, d in docs.items()], "repo_id string, path string, doc string")
    files, services = compose.resolve(rows.withColumn("doc", F.udf(seen, "string")("doc")))
    assert files.count() == 75 and services.count() == 75 and reads.value == 100
    assert {json.loads(r.definition)["image"] for r in services.where("name <> 'w'").collect()} == {"z"}
    calls = []
    got = compose._once(pa.array(["a", "b", None, "a", "a"]), lambda v: calls.append(v) or {"n": [v]}, pa.struct([("n", pa.list_(pa.string()))]))
    assert got.to_pylist() == [{"n": ["a"]}, {"n": ["b"]}, None, {"n": ["a"]}, {"n": ["a"]}] and calls == ["a", "b"]


def test_dockerfiles_are_not_broadcast_by_estimates(spark):
    # a generator's rows are not in the estimate of its size
    services = spark.range(2).select(F.col("id").alias("repo_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("name"), F.lit("compose.yml").alias("source"), F.lit(".").alias("build"), F.lit(None).cast("string").alias("dockerfile"))
    files = spark.range(2).select(F.col("id").alias("repo_id"), F.explode(F.array(F.lit("Dockerfile"), F.lit("x/Dockerfile"))).alias("path"))
    found, unused = compose.service_dockerfiles(services, files)
    for df in (found, unused):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.repo_id, r.name, r.path) for r in found.collect()} == {(i, n, "Dockerfile") for i in (0, 1) for n in "ab"} and [r.path for r in unused.collect()] == ["x/Dockerfile"] * 2
