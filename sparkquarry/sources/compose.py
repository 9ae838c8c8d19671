"""Compose projects from a table of parsed documents: includes, extends, services and ports.

``documents``: (repo_id, path, doc), doc being the document as JSON text (a Compose file that is JSON, or what a YAML reader made of one); a doc that
is no JSON is a file without services. Results follow by joins: includes to a fixed point, extends one level a round, services of a project folded
in file order. Small Python helpers merge the definitions of one chain and read one definition; nothing is gathered on the driver.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.functions import json_values as jv
from sparkquarry.functions import paths, text
from sparkquarry.operators.fixpoint import closure, settled

#: Directories above a project's Compose file, files read by reference, and steps of extends, at most.
MOST_DEPTH, MOST_FILES, MOST_LEVELS = 2, 64, 16
#: What a service does not take over, what is merged by name, and what is joined as a list.
NOT_INHERITED = ["extends", "depends_on", "links", "volumes_from"]
BY_NAME = ["environment", "labels", "annotations", "healthcheck", "sysctls", "ulimits", "storage_opt"]
AS_LIST = [
    "ports", "expose", "env_file", "volumes", "devices", "cap_add", "cap_drop", "configs", "secrets", "security_opt", "dns", "dns_search",
    "tmpfs", "external_links", "extra_hosts", "device_cgroup_rules",
]


# files ---------------------------------------------------------------------------------------------

def role_of(path: Column) -> Column:
    """base, override or variant by the file's name; null for other files."""
    stem = F.regexp_extract(paths.base_name(path), r"^(?:docker-)?(compose(?:\.[\w.-]+)?)\.ya?ml$", 1)
    return F.when(stem == "compose", "base").when(stem == "compose.override", "override").when(stem != "", "variant")


def project_of(path: Column) -> Column:
    """What runs together: a directory's base and override files; a variant for itself."""
    return F.when(role_of(path) == "variant", path).otherwise(paths.dir_of(path))


def file_order(path: Column) -> Column:
    """Sorts root first, then by directory, role and name."""
    rank = F.when(role_of(path) == "base", 0).when(role_of(path) == "override", 1).otherwise(2)
    folder = paths.dir_of(path)
    return F.struct((folder != ".").alias("below"), folder.alias("dir"), rank.alias("rank"), paths.base_name(path).alias("name"))


def is_project_file(path: Column) -> Column:
    return role_of(path).isNotNull() & (paths.depth_of(path) <= MOST_DEPTH) & ~paths.is_under(path)


def _static(raw: Column) -> Column:
    """Paths that are known without running anything and lie under the file's directory or beside it."""
    return ~(raw.rlike(r"[$~]") | raw.contains("://") | raw.rlike(r"^\s*(?:[/\\]|[a-zA-Z]:)") | (F.trim(raw) == ""))


def reference(path: Column, raw: Column) -> Column:
    """A path in a Compose file as seen from the root; null where it can't be known or leaves the project."""
    found = paths.join_path(paths.dir_of(path), F.translate(F.trim(raw), "\\", "/"))
    return F.when(_static(raw), paths.let(found, lambda f: F.when(f != ".", f)))


# merging -------------------------------------------------------------------------------------------

def _is_static(raw: str) -> bool:
    return bool(raw.strip()) and not re.search(r"[$~]|://", raw) and not re.match(r"\s*(?:[/\\]|[a-zA-Z]:)", raw)


def _listed(value) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def _named(value) -> dict:
    """A mapping, or a list of NAME=value and NAME, by name."""
    if isinstance(value, dict):
        return value
    pairs = (x.partition("=") for x in _listed(value) if isinstance(x, str))
    return {name: rest if sign else None for name, sign, rest in pairs}


def merge_definitions(base: dict, own: dict) -> dict:
    """What a service gets from the one that it extends."""
    out = {k: v for k, v in base.items() if k not in NOT_INHERITED}
    for key, value in own.items():
        had = out.get(key)
        if key in BY_NAME and key in out or key == "build" and isinstance(had, dict) and isinstance(value, dict):
            out[key] = _named(had) | _named(value)
        elif key in AS_LIST and key in out:
            seen = {json.dumps(x, sort_keys=True): x for x in reversed(_listed(had) + _listed(value))}
            out[key] = list(reversed(seen.values()))
        elif key != "extends":
            out[key] = value
    return out


def moved(definition: dict, from_file: str, to_file: str) -> dict:
    """``build`` and ``env_file`` paths of a service as a file of another directory would write them."""
    here, there = posixpath.dirname(from_file), posixpath.dirname(to_file)
    if here == there:
        return definition

    def path(raw: str) -> str:
        return posixpath.relpath(posixpath.join(here, raw.strip().replace("\\", "/")), there or ".") if _is_static(raw) else raw

    def part(value, name: str, missing: str | None = None):
        if isinstance(value, str):
            return path(value)
        own = value.get(name, missing) if isinstance(value, dict) else None
        return value | {name: path(own)} if isinstance(own, str) else value

    out = dict(definition)
    if "build" in out:
        out["build"] = part(out["build"], "context", ".")
    if "env_file" in out:
        out["env_file"] = [part(x, "path") for x in _listed(out["env_file"])]
    return out


def _once(values: pa.Array, one: Callable[[str], object], kind: pa.DataType) -> pa.Array:
    """``one`` of every value; for values that are equal it is worked out once a batch."""
    found = values.dictionary_encode()
    return pa.array([one(v) for v in found.dictionary.to_pylist()], kind).take(found.indices)


def _fold(chains: pa.Array) -> pa.Array:
    """Definitions on top of those that they extend; a chain is {file, definition, steps: [{base_file, definition}]} as JSON text, the nearest step first."""

    def one(chain: str) -> str:
        chain, out = json.loads(chain), {}
        for s in reversed(chain.get("steps") or []):
            out = merge_definitions(out, moved(json.loads(s["definition"]), s["base_file"], chain["file"]))
        return json.dumps(merge_definitions(out, json.loads(chain["definition"])), sort_keys=True)

    return _once(chains, one, pa.string())


# resolution ----------------------------------------------------------------------------------------

def _base(file: Column, how: Column) -> Column:
    """(base_file, base_name) of the service that a value of ``extends`` names; null for none."""
    none = F.lit(None).cast("struct<base_file: string, base_name: string>")
    inner = jv.kind_of(how) == "OBJECT"
    name = F.when(inner, F.try_variant_get(how, "$.service", "string")).when(jv.kind_of(how) == "STRING", F.try_variant_get(how, "$", "string"))
    other = F.when(inner, F.try_variant_get(how, "$.file", "string"))
    found = paths.let(other, lambda o: F.when(o.isNull(), file).otherwise(reference(file, o)))
    return paths.let(F.struct(found.alias("base_file"), name.alias("base_name")), lambda b: F.when((b["base_name"] != "") & b["base_file"].isNotNull(), b).otherwise(none))


def _services(file: Column, doc: Column) -> Column:
    """Array of (name, definition, base) of every service that is an object; base as in ``_base``."""

    def one(entry: Column) -> Column:
        # a definition is text as JSON writes it, so the member has its name as it is
        base = lambda d: F.when(d.contains('"extends"'), paths.let(F.try_variant_get(entry["value"], "$.extends", "variant"), lambda how: _base(file, how)))
        return paths.let(F.to_json(entry["value"]), lambda d: F.struct(entry["key"].alias("name"), d.alias("definition"), base(d).alias("base")))

    entries = F.map_entries(F.try_variant_get(F.try_parse_json(doc), "$.services", "map<string,variant>"))
    return F.filter(F.transform(entries, one), lambda s: jv.is_object(s["definition"]))


def _targets(file: Column, doc: Column) -> Column:
    """Array of the files that ``include`` names, in one expression: a filter on the way would work the texts out again."""

    def texts(entry: Column) -> Column:
        own = F.when(jv.kind_of(entry) == "OBJECT", F.try_variant_get(entry, "$.path", "variant")).otherwise(entry)
        inner = paths.let(own, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)))
        return F.transform(inner, lambda v: F.when(jv.kind_of(v) == "STRING", F.try_variant_get(v, "$", "string")))

    entries = F.try_variant_get(F.try_parse_json(doc), "$.include", "array<variant>")
    found = F.array_compact(F.transform(F.flatten(F.transform(entries, texts)), lambda raw: reference(file, raw)))
    return F.when(doc.contains("include") | doc.contains("\\u"), found)  # the others need no parsing


def services_of(documents: DataFrame) -> DataFrame:
    """(repo_id, file, name, definition) of every service that is an object, as it is written; a definition is JSON text."""
    every = documents.select("repo_id", F.col("path").alias("file"), F.explode(_services(F.col("path"), F.col("doc"))).alias("s"))
    return every.select("repo_id", "file", "s.name", "s.definition")


def includes_of(documents: DataFrame) -> DataFrame:
    """(repo_id, source, target) of every file that ``include`` names, in short or long form."""
    return documents.select("repo_id", F.col("path").alias("source"), F.explode(_targets(F.col("path"), F.col("doc"))).alias("target")).distinct()


def resolve(documents: DataFrame, *, most_files: int = MOST_FILES, most_levels: int = MOST_LEVELS) -> tuple[DataFrame, DataFrame]:
    """(files, services).

    files: (repo_id, top, file, level): each project file as its own ``top`` at level 0, and what it includes, a file once a top and at its least level.
    services: (repo_id, file, included_from, level, name, definition) with ``extends`` applied; included_from is the top that brought a file in, null in its own.
    At most ``most_files`` files a repository are read by reference: those of includes by level and path, then those of extends. A chain of
    extends ends after ``most_levels`` steps, at a service that it has been at, and where file or service is missing.
    """
    # each document is read and parsed once, by as many tasks as there are and not as its table has files
    documents = documents.select("repo_id", "path", "doc").repartition("repo_id", "path")
    read = F.col("path"), F.col("doc")
    documents = settled(documents.select("repo_id", "path", _targets(*read).alias("targets"), _services(*read).alias("services")))
    own = documents.where(is_project_file(F.col("path"))).select("repo_id", F.col("path").alias("top"), F.col("path").alias("node"))
    names = documents.select("repo_id", F.col("path").alias("target"))
    includes = documents.select("repo_id", F.col("path").alias("source"), F.explode("targets").alias("target"))
    reached = closure(own, includes.join(names.hint("merge"), ["repo_id", "target"], "left_semi"), ["repo_id", "top"]).withColumnRenamed("node", "file")
    tops = reached.where("level = 0").select("repo_id", "file")
    read = reached.where("level > 0").groupBy("repo_id", "file").agg(F.min("level").alias("first")).join(tops.hint("merge"), ["repo_id", "file"], "left_anti")
    by = Window.partitionBy("repo_id").orderBy("first", "file")
    late = read.withColumn("nth", F.row_number().over(by)).where(F.col("nth") > most_files).select("repo_id", "file")
    files = settled(reached.join(late.hint("merge"), ["repo_id", "file"], "left_anti"))

    every = documents.select("repo_id", F.col("path").alias("file"), F.explode("services").alias("s"))
    every = every.select("repo_id", "file", "s.name", "s.definition", "s.base.base_file", "s.base.base_name")
    here = files.select("repo_id", "file").distinct()
    found = settled(every.join(here.hint("merge"), ["repo_id", "file"], "left_semi"))
    key = F.struct(F.col("base_file").alias("file"), F.col("base_name").alias("name"))
    written = every.select(
        "repo_id", F.col("file").alias("base_file"), F.col("name").alias("base_name"), "definition", F.struct("base_file", "base_name").alias("next"),
    )
    at = found.where("base_file IS NOT NULL").select("repo_id", "file", "name", "base_file", "base_name", F.array(F.struct("file", "name")).alias("seen"))
    chain = None
    for level in range(1, most_levels + 1):
        at = at.where(~F.array_contains("seen", key))
        if at.isEmpty():
            break
        at = settled(at.join(written.hint("merge"), ["repo_id", "base_file", "base_name"]))
        some = at.select("repo_id", "file", "name", F.lit(level).alias("level"), "base_file", "definition")
        chain = some if chain is None else chain.unionByName(some)
        at = at.where("next.base_file IS NOT NULL").select(
            "repo_id", "file", "name", F.col("next.base_file").alias("base_file"), F.col("next.base_name").alias("base_name"), F.array_append("seen", key).alias("seen"),
        )
    found = found.select("repo_id", "file", "name", "definition")
    if chain is None:
        found = found.withColumn("steps", F.array().cast("array<struct<base_file: string, definition: string>>"))
    else:
        # files that only extends names count against the budget behind those of includes
        as_base = lambda t: t.select("repo_id", F.col("file").alias("base_file")).hint("merge")
        more = chain.groupBy("repo_id", "base_file").agg(F.min("level").alias("first"))
        more = more.join(as_base(here), ["repo_id", "base_file"], "left_anti").join(as_base(tops), ["repo_id", "base_file"], "left_anti")
        spent = files.where("level > 0").join(tops.hint("merge"), ["repo_id", "file"], "left_anti").groupBy("repo_id").agg(F.count_distinct("file").alias("spent"))
        late = more.withColumn("nth", F.row_number().over(Window.partitionBy("repo_id").orderBy("first", "base_file"))).join(spent.hint("merge"), "repo_id", "left")
        late = late.where(F.col("nth") + F.coalesce("spent", F.lit(0)) > most_files).select("repo_id", "base_file", F.lit(True).alias("late"))
        chain = chain.join(late.hint("merge"), ["repo_id", "base_file"], "left").withColumn("late", F.coalesce("late", F.lit(False)))
        chain = chain.groupBy("repo_id", "file", "name").agg(F.sort_array(F.collect_list(F.struct("level", "base_file", "definition", "late"))).alias("all"))
        first = F.array_position(F.transform("all", lambda s: s["late"]), True).cast("int")
        kept = F.when(first > 0, F.slice("all", 1, F.greatest(first - 1, F.lit(0)))).otherwise(F.col("all"))
        steps = F.transform(kept, lambda s: F.struct(s["base_file"].alias("base_file"), s["definition"].alias("definition")))
        found = found.join(chain.select("repo_id", "file", "name", steps.alias("steps")).hint("merge"), ["repo_id", "file", "name"], "left")
    found = found.select("repo_id", "file", "name", F.arrow_udf(_fold, "string")(F.to_json(F.struct("file", "definition", "steps"))).alias("definition"))
    services = settled(files.join(found.hint("merge"), ["repo_id", "file"]))
    return files, services.select("repo_id", "file", F.when(F.col("level") > 0, F.col("top")).alias("included_from"), "level", "name", "definition")


def env_file_references(services: DataFrame) -> DataFrame:
    """(repo_id, compose_file, service, path, required) of every env_file entry whose path is known."""
    rows = services.select("repo_id", F.col("file").alias("compose_file"), F.col("name").alias("service"), jv.at(F.col("definition"), "$.env_file").alias("value"))
    rows = rows.select("repo_id", "compose_file", "service", F.explode(F.coalesce(jv.items(F.col("value")), F.array("value"))).alias("entry"))
    inner = jv.is_object(F.col("entry"))
    rows = rows.select(
        "repo_id", "compose_file", "service", F.when(inner, F.get_json_object("entry", "$.path")).otherwise(jv.string_of(F.col("entry"))).alias("raw"),
        (~F.coalesce(inner & (F.get_json_object("entry", "$.required") == "false"), F.lit(False))).alias("required"),
    )
    return rows.select("repo_id", "compose_file", "service", reference(F.col("compose_file"), F.col("raw")).alias("path"), "required").where("path IS NOT NULL")


# ports ---------------------------------------------------------------------------------------------

#: Longest entry that is read: no port is longer.
MOST_PORT = 500
_PORT_FIELDS = ["host", "container", "protocol", "host_ip", "raw"]
_PORT = f"struct<{', '.join(f'{f}: string' for f in _PORT_FIELDS)}>"
_SECRET_FALLBACK = re.compile(r"(\$\{[A-Za-z0-9_]*(?:secret|token|password|passwd|apikey|api_key|private_key|credential)[A-Za-z0-9_]*:?[-?+=])[^}]+(?=\})", re.I)


def _hidden(value: str | None) -> str | None:
    """No credential and no fallback of a variable with a sensitive name is shown."""
    if value is None:
        return None
    value = _SECRET_FALLBACK.sub(r"\1***", value)
    for _, pattern in text.CREDENTIALS:
        value = re.sub(pattern, text.REDACTED, value)
    return "".join(c if c.isprintable() else " " for c in value)


def _port_value(value) -> str | None:
    """A port, a range or something with a variable, as written; null for anything else."""
    if isinstance(value, int) and not isinstance(value, bool) and value >= 0:
        return str(value)
    value = value.strip() if isinstance(value, str) else ""
    return str(int(value)) if value.isdecimal() else value if re.fullmatch(r"\d+-\d+", value) or "$" in value else None


def _cut(spec: str) -> list[str]:
    """The pieces between colons that no brace and no bracket holds."""
    pieces, depth = [""], 0
    for c in spec:
        depth = max(0, depth + (c in "{[") - (c in "}]"))
        if c == ":" and not depth:
            pieces.append("")
        else:
            pieces[-1] += c
    return [p.strip() for p in pieces]


def parse_port(entry) -> dict | None:
    """A Compose port entry; None if it is none.

    Short form ``[IP:][HOST:]CONTAINER[/PROTOCOL]`` with ranges, ``${..}`` and bracketed IPv6; numbers; long form (target, published, host_ip,
    protocol), whose ``raw`` is the short form of the same.
    """
    if isinstance(entry, dict):
        container, host = _port_value(entry.get("target")), _port_value(entry.get("published"))
        text_of = lambda k: entry[k].strip() if isinstance(entry.get(k), str) else ""
        protocol, ip = text_of("protocol").lower() or "tcp", text_of("host_ip")
        if container is None or not re.fullmatch("[a-z]+", protocol):
            return None
        front = ([f"[{ip}]" if ":" in ip else ip] if ip else []) + ([host or ""] if ip or host else [])
        raw = ":".join([*front, container]) + ("" if protocol == "tcp" else f"/{protocol}")
    else:
        raw = str(entry) if isinstance(entry, int) and not isinstance(entry, bool) else entry.strip() if isinstance(entry, str) else ""
        if not raw or len(raw) > MOST_PORT:
            return None
        spec, _, protocol = raw.rpartition("/")
        if not (spec and re.fullmatch("[A-Za-z]+", protocol)):
            spec, protocol = raw, "tcp"
        *ips, host, last = ["", *_cut(spec)]
        container, protocol, ip = _port_value(last), protocol.lower(), ":".join(ips).lstrip(":")
        ip = ip[1:-1] if ip.startswith("[") and ip.endswith("]") else ip
        if container is None or host and _port_value(host) is None:
            return None
        host = _port_value(host)
    return {"host": _hidden(host), "container": _hidden(container), "protocol": protocol, "host_ip": _hidden(ip) or None, "raw": _hidden(raw)}


def _ports(entries: pd.Series) -> pd.DataFrame:
    def one(entry):
        try:
            return parse_port(json.loads(entry)) or {}
        except (TypeError, ValueError):
            return {}

    return pd.DataFrame([one(e) for e in entries], columns=_PORT_FIELDS, dtype="object").where(lambda x: x.notna(), None)


def port_of(entry: Column) -> Column:
    """``parse_port`` of a JSON value; all fields are null where it is none."""
    return F.pandas_udf(_ports, _PORT)(entry)


# services ------------------------------------------------------------------------------------------

_SERVICE = [
    "image string", "build string", "dockerfile string", f"ports array<{_PORT}>", "expose array<string>", "depends_on array<string>", "volumes array<string>",
    "environment array<string>", "env_files array<string>", "profiles array<string>", "healthcheck boolean",
]
_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), f"array<{_PORT}>": pa.list_(pa.struct([(f, pa.string()) for f in _PORT_FIELDS]))}


def read_service(definition: dict) -> dict:
    """The fields of a service; no value of its environment is among them."""
    word = lambda v: (v.strip() or None) if isinstance(v, str) else None
    words = lambda v: [w for w in (str(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else word(x) for x in _listed(v)) if w]
    once = lambda v: list(dict.fromkeys(v))
    build, health, needs = (definition.get(k) for k in ("build", "healthcheck", "depends_on"))
    inner = lambda x, k: word(x.get(k)) if isinstance(x, dict) else None

    def volume(x):
        if isinstance(x, dict):
            return inner(x, "target") and ":".join(filter(None, [inner(x, "source"), inner(x, "target")]))
        return word(x)

    test = health.get("test") if isinstance(health, dict) else None
    return {
        "image": _hidden(word(definition.get("image"))), "build": _hidden(inner(build, "context") or "." if isinstance(build, dict) else word(build)), "dockerfile": _hidden(inner(build, "dockerfile")),
        "ports": [p for p in map(parse_port, _listed(definition.get("ports"))) if p], "expose": once(words(definition.get("expose"))),
        "depends_on": sorted(set(needs if isinstance(needs, dict) else filter(None, map(word, _listed(needs))))),
        "volumes": once(_hidden(v) for v in map(volume, _listed(definition.get("volumes"))) if v),
        "environment": sorted({n.strip() for n in _named(definition.get("environment")) if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.-]*", n.strip())}),
        "env_files": [_hidden(f) for f in (word(x) or inner(x, "path") for x in _listed(definition.get("env_file"))) if f],
        "profiles": sorted(set(words(definition.get("profiles")))),
        "healthcheck": isinstance(health, dict) and health.get("disable") is not True and (test[:1] if isinstance(test, list) else [test]) != ["NONE"],
    }


def _read(definitions: pa.Array) -> pa.Array:
    fields = (f.split(" ", 1) for f in _SERVICE)
    return _once(definitions, lambda d: read_service(json.loads(d)), pa.struct([(name, _ARROW[kind]) for name, kind in fields]))


def parse_services(services: DataFrame) -> DataFrame:
    """Resolved services with their fields and project."""
    rows = services.withColumns({"project": project_of(F.coalesce("included_from", "file")), "s": F.arrow_udf(_read, ", ".join(_SERVICE))("definition")})
    return rows.select("repo_id", "project", "name", "file", "included_from", "level", "s.*")


def merge_services(services: DataFrame) -> DataFrame:
    """One row a service of a project, folded in file order: the first image, build and Dockerfile, all list entries once, a health check of any. A service
    that comes in through ``include`` under a name that the project has is left out, as Compose refuses it."""
    order = lambda x: F.struct(file_order(F.coalesce(x["included_from"], x["file"])).alias("top"), x["level"].alias("level"), file_order(x["file"]).alias("own"))
    lists = ["ports", "expose", "depends_on", "volumes", "environment", "env_files", "profiles"]
    one = F.struct("level", "file", "included_from", "image", "build", "dockerfile", *lists, "healthcheck")
    rows = services.groupBy("repo_id", "project", "name").agg(F.collect_list(one).alias("all"))
    in_order = lambda all: F.transform(F.sort_array(F.transform(all, lambda x: F.struct(order(x).alias("order"), x.alias("x")))), lambda s: s["x"])
    rows = rows.withColumn("all", F.when(F.size("all") > 1, in_order(F.col("all"))).otherwise(F.col("all")))
    rows = rows.withColumn("all", F.filter("all", lambda x, i: (i == 0) | x["included_from"].isNull()))
    first = lambda name: F.get(F.array_compact(F.transform("all", lambda x: x[name])), F.lit(0)).alias(name)
    union = lambda name: F.array_distinct(F.flatten(F.transform("all", lambda x: x[name])))
    ports = paths.let(union("ports"), lambda all: F.filter(all, lambda p, i: ~F.exists(F.slice(all, 1, i), lambda x: x["raw"] == p["raw"])))
    return rows.select(
        "repo_id", "project", "name", F.get("all", F.lit(0))["file"].alias("source"), F.get("all", F.lit(0))["included_from"].alias("included_from"),
        first("image"), first("build"), first("dockerfile"), ports.alias("ports"),
        *[(F.array_sort(union(c)) if c in ("depends_on", "environment", "profiles") else union(c)).alias(c) for c in lists[1:]],
        F.exists("all", lambda x: x["healthcheck"]).alias("healthcheck"),
    )


def port_bindings(services: DataFrame) -> DataFrame:
    """Literal host ports of merged services, as ``rules.port_conflicts`` takes them."""
    rows = services.select("repo_id", "project", F.col("name").alias("service"), F.col("source").alias("file"), (F.size("profiles") > 0).alias("profiled"), F.explode("ports").alias("p"))
    return rows.where(F.col("p.host").rlike(r"^\d{1,9}$")).select("repo_id", "project", "service", "file", "profiled", F.col("p.host_ip").alias("host_ip"), F.col("p.host").cast("int").alias("port"), F.col("p.protocol").alias("protocol"))


def service_dockerfiles(services: DataFrame, dockerfiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(services with the ``path`` of the Dockerfile that they build, null if it is not known; Dockerfiles that no service builds).

    The file lies in the build context, seen from the Compose file's directory, under ``dockerfile`` or the name Dockerfile.
    """
    context = F.when(F.col("build") == ".", paths.dir_of(F.col("source"))).otherwise(reference(F.col("source"), F.col("build")))
    wanted = paths.let(context, lambda c: F.when(c.isNotNull(), paths.join_path(c, F.coalesce("dockerfile", F.lit("Dockerfile")))))
    built = services.withColumn("wanted", wanted)
    # hints: a side is often taken for far smaller than it is, and broadcast
    have = dockerfiles.select("repo_id", F.col("path").alias("wanted")).distinct().withColumn("there", F.lit(True))
    found = built.join(have.hint("merge"), ["repo_id", "wanted"], "left").withColumn("path", F.when(F.col("there"), F.col("wanted"))).drop("wanted", "there")
    used = services.select("repo_id", F.explode(F.array_compact(F.array(wanted))).alias("path"))  # a filter would work the paths out again
    return found, dockerfiles.join(used.hint("merge"), ["repo_id", "path"], "left_anti")


def known_missing(references: DataFrame, files: DataFrame, *, most_depth: int) -> DataFrame:
    """References (repo_id, path) whose file is certainly not there: no file of that path, ignored ones included, not deeper than the walk went, and under
    no directory that the walk leaves out or an ignore rule hides. ``files``: (repo_id, path, ignored, directory)."""
    absent = references.where((paths.depth_of(F.col("path")) <= most_depth) & ~paths.is_ignored_dir(F.col("path"))).join(files.where("NOT directory").select("repo_id", "path"), ["repo_id", "path"], "left_anti")
    hidden = files.where("directory AND ignored").select("repo_id", F.col("path").alias("above"))
    above = absent.select("repo_id", "path", F.explode(paths.ancestors(paths.dir_of(F.col("path")))).alias("a")).select("repo_id", "path", F.col("a.dir").alias("above"))
    under = above.join(hidden, ["repo_id", "above"], "left_semi").select("repo_id", "path").distinct()
    return absent.join(under, ["repo_id", "path"], "left_anti")
