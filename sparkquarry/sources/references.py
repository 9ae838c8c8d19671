"""Environment variables that sources read, as rows: repo_id, path, name, required and family.

files: repo_id, path, content. Code is cut into tokens; each token that can begin a read becomes a row with the tokens on both sides, and a family
is a condition on these. A read is required where no default follows it. One file yields one row a name and family,
required if some read of it is; unknown extensions, null and empty contents yield none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.functions import code_tokens as ct
from sparkquarry.functions import paths, text
from sparkquarry.operators.fixpoint import settled

JS = [".js", ".mjs", ".cjs", ".jsx", ".ts", ".mts", ".cts", ".tsx", ".vue", ".svelte", ".astro"]
#: Variables that Vite and Astro set themselves.
BUILT_IN = ["MODE", "DEV", "PROD", "SSR", "BASE_URL", "SITE", "ASSETS_PREFIX"]
#: What holds the environment, the name ``env`` last.
OBJECTS = [("process", "env"), ("import", "meta", "env"), ("Bun", "env")]
#: Modules that export variables by name, and one that exports all of them as ``env``.
STATIC_MODULES = ["$env/static/private", "$env/static/public", "astro:env/client", "astro:env/server"]
DYNAMIC_MODULES = ["$env/dynamic/private", "$env/dynamic/public"]
#: Functions that check the whole environment against a schema.
VALIDATORS = ["parse", "safeParse", "parseAsync", "safeParseAsync", "validate", "validateSync", "validateAsync", "assert", "cleanEnv", "createEnv", "envsafe", "parseEnv"]
#: Words that a text must hold to be read at all.
HINTS = ["process", "import.meta", "Bun", "Deno", "$env/", "astro:env", "loadEnv", "ConfigService", "prisma/config", "Getenv", "LookupEnv", "env"]
_NAME, _KEY, _CAPITALS = r"^[A-Za-z_]\w*$", r"^[A-Za-z_][\w.-]*$", r"^[A-Z][A-Z0-9_]*[A-Z0-9]$"
_REFS = "array<struct<family: string, name: string, required: boolean>>"


def _ref(family: str, name: Column, required: Column) -> Column:
    return F.struct(F.lit(family).alias("family"), name.alias("name"), required.alias("required"))


def _one(when: Column, family: str, name: Column, required: Column) -> Column:
    return F.when(when, F.array(_ref(family, name, required))).otherwise(F.array()).cast(_REFS)


def _defaulted(after: Column) -> Column:
    """Whether a default stands behind a read, perhaps behind closing parentheses."""
    sign = F.get(F.filter(F.slice(after, F.lit(1), F.lit(6)), lambda t: t != ")"), F.lit(0))
    return F.coalesce(sign.isin("??", "||"), F.lit(False))


def _member(after: Column) -> tuple[Column, Column]:
    """Name and what follows it, of the member that is read: ``.NAME``, ``?.NAME``, ``["name"]`` or ``?.["name"]``; a call is no read."""
    after = F.when(ct.starts(after, "?.", "["), ct.rest(after, 1)).otherwise(after)
    key, n = ct.quoted(ct.rest(after, 1))
    in_brackets = ct.starts(after, "[") & key.rlike(_KEY) & F.get(after, n + 1).eqNullSafe("]")
    by_dot = ct.get(after, 0).isin(".", "?.") & ct.get(after, 1).rlike(_NAME) & ~ct.get(after, 2).eqNullSafe("(")
    return F.when(in_brackets, key).when(by_dot, ct.get(after, 1)), F.when(in_brackets, ct.rest(after, n + 2)).otherwise(ct.rest(after, 2))


def _argument(after: Column) -> tuple[Column, Column]:
    """The text that is a call's only or first argument, and what follows it; type arguments are skipped."""
    types = F.when(ct.starts(after, "<"), F.array_position(after, ">").cast("int")).otherwise(0)
    call = ct.rest(after, types)
    name, n = ct.quoted(ct.rest(call, 1))
    return F.when(ct.starts(call, "("), name), ct.rest(call, n + 1)


def _listed(body: Column) -> Column:
    """Entries between commas, each an array of tokens."""
    # a sign that no token is keeps the tokens of an entry apart
    return F.transform(F.split(F.array_join(F.transform(body, lambda t: F.when(t == ",", "\u0002").otherwise(t)), "\u0001"), "\u0002"), lambda e: F.filter(F.split(e, "\u0001"), lambda t: (t != "") & (t != "type")))


def _destructured(family: str, body: Column) -> Column:
    """References of a pattern such as ``{ A, B: b, C = 1 }``; what takes the rest is none."""
    name = lambda e: F.coalesce(ct.content(ct.get(e, 0)), ct.get(e, 0))
    good = lambda e: name(e).rlike(_KEY) & (ct.get(e, 1).isNull() | ct.get(e, 1).isin(":", "="))
    return F.transform(F.filter(_listed(body), good), lambda e: _ref(family, name(e), ~F.array_contains(e, "="))).cast(_REFS)


def _pattern_before(front: Column) -> Column:
    """The body of the pattern that is given a value: ``front`` runs backwards from the sign =; a type may stand between."""
    typed = F.array_position(front, "}").cast("int")
    between = F.slice(front, F.lit(1), typed - 1)
    fine = (typed == 1) | (typed > 1) & F.element_at(between, -1).eqNullSafe(":") & ~F.exists(between, lambda t: t.isin(";", "{", "="))
    body = ct.until(F.when(fine, ct.rest(front, typed)), "{")
    return F.reverse(F.when(~F.array_contains(body, "}"), body))


def _rows(each: DataFrame) -> DataFrame:
    return each.where("name <> ''").groupBy("repo_id", "path", "family", "name").agg(F.bool_or("required").alias("required"))


def _anchored(files: DataFrame, words: Column) -> DataFrame:
    """A row for each token among ``words``: the token, those before it (backwards) and those behind it."""
    tokens = F.col("tokens")
    # exploded whole, so that what follows reads columns and repeats no slices
    each = F.transform(ct.places(tokens, words), lambda at: F.struct(F.get(tokens, at).alias("token"), ct.before(tokens, at).alias("front"), ct.behind(tokens, at).alias("after")))
    return files.select("*", F.explode(each).alias("a")).select(*files.columns, "a.token", "a.front", "a.after")


def _js(files: DataFrame) -> DataFrame:
    """References of scripts."""
    files = files.withColumn("tokens", F.filter("tokens", lambda t: t != "\n"))
    holds = lambda word: F.array_contains("tokens", word)
    files = files.withColumns({"nest": holds("ConfigService"), "prisma": holds("'prisma/config'") | holds('"prisma/config"')})
    front, after, token = F.col("front"), F.col("after"), F.col("token")
    rows = _anchored(files, F.array(*map(F.lit, ["env", "get", "getOrThrow", "import", "loadEnv"])))

    back = F.transform(front, lambda t: F.when(t == "?.", ".").otherwise(t))
    whole = F.lit(False)
    for o in OBJECTS:
        whole = whole | ct.starts(back, *[x for name in reversed(o[:-1]) for x in (".", name)])
    rows = rows.withColumn("whole", (token == "env") & whole)
    rows = rows.withColumn("outer", F.when(F.col("whole"), ct.rest(front, F.when(ct.get(front, 1) == "meta", 4).otherwise(2))))
    name, then = _member(after)
    alone = F.col("whole") & ~F.coalesce(ct.get(after, 0).isin(".", "?.", "["), F.lit(False))
    taken = F.when(alone & ct.starts(F.col("outer"), "="), _pattern_before(ct.rest(F.col("outer"), 1)))
    vite = ct.get(front, 1).eqNullSafe("meta")
    unless_set = lambda refs: F.filter(refs, lambda r: ~(vite & r["name"].isin(BUILT_IN)))
    argument, rest = _argument(after)
    receiver = ct.starts(front, ".") & F.lower(ct.get(front, 1)).contains("config")
    closed = ct.get(rest, 0).isin(",", ")")
    module_body = F.when(ct.starts(after, "{"), ct.until(ct.rest(after, 1), "}"))
    tail = ct.rest(after, F.size(module_body) + 2)
    module = F.when(ct.starts(tail, "from"), ct.content(ct.get(tail, 1)))
    imported = F.filter(_listed(module_body), lambda e: ct.get(e, 0).rlike(ct.WORD))
    static = F.when((token == "import") & module.isin(STATIC_MODULES), F.transform(F.filter(imported, lambda e: ct.get(e, 0) != "getSecret"), lambda e: _ref("static-import", ct.get(e, 0), F.lit(True))))
    given = ct.rest(front, F.when(ct.starts(front, "await"), 1).otherwise(0))
    loads = (token == "loadEnv") & ct.starts(after, "(") & ct.starts(given, "=")
    loaded = F.when(loads, _destructured("bound", _pattern_before(ct.rest(given, 1))))
    rows = rows.select(
        "repo_id", "path", "tokens", "front", "after", "token", alone.alias("alone"),
        F.concat(*[F.coalesce(x.cast(_REFS), F.array().cast(_REFS)) for x in (
            unless_set(_one(F.col("whole"), "object", name, ~_defaulted(then))), unless_set(F.when(taken.isNotNull(), _destructured("destructured", taken))),
            _one((token == "get") & ct.starts(front, ".", "env", ".", "Deno") & argument.rlike(_NAME) & (ct.get(rest, 0) == ")"), "deno", argument, ~_defaulted(ct.rest(rest, 1))),
            static, loaded,
            _one(F.col("nest") & token.isin("get", "getOrThrow") & receiver & closed & argument.rlike(r"^[A-Z][A-Z0-9_]*$"), "config-service", argument, (token == "getOrThrow") | (ct.get(rest, 0) == ")")),
            _one(F.col("prisma") & (token == "env") & ~ct.get(front, 0).eqNullSafe(".") & argument.rlike(_NAME) & (ct.get(rest, 0) == ")"), "prisma-config", argument, F.lit(True)),
        )]).alias("refs"),
        F.when((token == "import") & module.isin(DYNAMIC_MODULES), F.transform(F.filter(imported, lambda e: ct.get(e, 0) == "env"), lambda e: F.element_at(e, -1)))
        .when(loads & ct.get(given, 1).rlike(ct.WORD), F.array(F.when(ct.get(given, 2).isin("const", "let", "var") | ct.get(given, 2).eqNullSafe(":"), ct.get(given, 1)))).alias("locals"),
    )
    found = rows.select("repo_id", "path", F.explode("refs").alias("r")).select("repo_id", "path", "r.*")

    # names that stand for the environment in their file
    local = rows.select("repo_id", "path", F.explode("locals").alias("local")).where("local IS NOT NULL").groupBy("repo_id", "path").agg(F.collect_set("local").alias("locals"))
    own = _anchored(files.select("repo_id", "path", "tokens").join(local, ["repo_id", "path"]), F.col("locals")).where(~ct.get(front, 0).isin(".", "?.") | (F.size("front") == 0))
    name, then = _member(after)
    bound = own.select("repo_id", "path", F.lit("bound").alias("family"), name.alias("name"), (~_defaulted(then)).alias("required"))
    return found.unionByName(bound).unionByName(_schemas(files, rows))


def _schemas(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Capital keys of the files that hand the whole environment to a validator; what follows up to the next such key tells of a default."""
    outer = ct.rest(F.col("front"), F.when(ct.get(F.col("front"), 1) == "meta", 4).otherwise(2))
    second = F.when(ct.starts(outer, ","), ct.rest(outer, F.array_position(outer, "(").cast("int") - 1)).otherwise(outer)  # behind a schema
    call = ct.rest(second, 1)
    callee = F.when(ct.starts(call, ">"), F.get(call, F.array_position(call, "<").cast("int"))).otherwise(ct.get(call, 0))
    checked = ct.starts(second, "(") & callee.isin(VALIDATORS)
    named = ct.starts(outer, ":") & F.lower(ct.get(outer, 1)).contains("runtimeenv")
    whole = rows.where(F.col("alone") & (checked | named)).select("repo_id", "path")
    t3 = files.where(F.exists("tokens", lambda t: ct.content(t).startswith("@t3-oss/env")) & F.array_contains("tokens", "createEnv")).select("repo_id", "path")
    own = files.select("repo_id", "path", "tokens").join(whole.unionByName(t3).distinct(), ["repo_id", "path"], "left_semi")
    key = lambda t: F.coalesce(ct.content(t), t).rlike(_CAPITALS)
    own = _anchored(own, F.array_distinct(F.filter("tokens", key)))
    after = F.when(ct.starts(F.col("after"), "?"), ct.rest(F.col("after"), 1)).otherwise(F.col("after"))
    own = own.select("repo_id", "path", F.coalesce(ct.content(F.col("token")), F.col("token")).alias("name"), "front", after.alias("after"))
    own = own.where(ct.starts(F.col("after"), ":") & (ct.get(F.col("front"), 0).isin("{", ",")))
    follows = lambda t, i: key(t) & F.get("after", i + 1).eqNullSafe(":") & F.get("after", i - 1).isin("{", ",")
    next_key = F.array_position(F.transform("after", lambda t, i: F.coalesce((i > 0) & follows(t, i), F.lit(False))), True).cast("int")
    entry = F.when(next_key > 0, F.slice("after", F.lit(1), next_key - 1)).otherwise(F.col("after"))
    own = own.withColumn("entry", entry)
    default = F.exists(F.transform("entry", lambda t, i: F.struct(t.alias("t"), F.get("entry", i - 1).alias("last"), F.get("entry", i + 1).alias("next"))), lambda x: (x["last"].eqNullSafe(".") & x["t"].isin("default", "optional") & x["next"].eqNullSafe("(")) | (x["t"].isin("default", "devDefault") & x["next"].eqNullSafe(":")))
    return own.select("repo_id", "path", F.lit("schema").alias("family"), "name", (~default).alias("required"))


def _go(files: DataFrame) -> DataFrame:
    """Getenv is required unless ``cmp.Or`` stands before it on its line, LookupEnv never is; tags of fields tell a default on their line."""
    rows = _anchored(files, F.array(*map(F.lit, ["Getenv", "LookupEnv", "env", "envconfig"])))
    front, after, token = F.col("front"), F.col("after"), F.col("token")
    line = F.concat(F.reverse(F.coalesce(ct.until(front, "\n"), front)), F.array(F.lit("")), F.coalesce(ct.until(after, "\n"), after))
    rows = rows.withColumn("line", line)
    argument, rest = _argument(after)
    ahead = F.coalesce(ct.until(front, "\n"), front)
    either = F.exists(F.transform(ahead, lambda t, i: F.struct(t.alias("t"), F.get(ahead, i + 1).alias("dot"), F.get(ahead, i + 2).alias("of"))), lambda x: (x["t"] == "Or") & (x["dot"] == ".") & (x["of"] == "cmp"))
    call = _one(ct.starts(front, ".", "os") & argument.rlike(_NAME) & (ct.get(rest, 0) == ")"), "go-call", argument, (token == "Getenv") & ~F.coalesce(either, F.lit(False)))
    value = F.substring_index(F.when(ct.starts(after, ":"), ct.content(ct.get(after, 1))), ",", 1)
    default = F.exists(F.transform("line", lambda t, i: F.struct(t.alias("t"), F.get("line", i + 1).alias("next"), F.get("line", i + 2).alias("value"))), lambda x: x["t"].isin("envDefault", "default") & (x["next"] == ":") & x["value"].startswith('"'))
    tag = _one(token.isin("env", "envconfig") & ~ct.get(front, 0).eqNullSafe("-") & value.rlike(_NAME), "go-tag", value, ~F.coalesce(default, F.lit(False)))
    return rows.select("repo_id", "path", F.explode(F.concat(call, tag)).alias("r")).select("repo_id", "path", "r.*")


def _prisma(files: DataFrame) -> DataFrame:
    argument, rest = _argument(F.col("after"))
    rows = _anchored(files, F.array(F.lit("env"))).where(argument.rlike(_NAME) & (ct.get(rest, 0) == ")"))
    return rows.select("repo_id", "path", F.lit("prisma").alias("family"), argument.alias("name"), F.lit(True).alias("required"))


def source_references(files: DataFrame) -> DataFrame:
    """References of code: what process, Bun, Deno, Vite, SvelteKit, Astro, Nest, Prisma, schemas and Go read."""
    ext = paths.ext_of(F.col("path"))
    hinted = F.lit(False)
    for hint in HINTS:
        hinted = hinted | F.col("content").contains(hint)
    own = files.where(ext.isin([*JS, ".go", ".prisma"]) & hinted).select("repo_id", "path", ext.alias("ext"), ct.tokens(F.col("content")).alias("tokens"))
    own = settled(own)  # each family reads the tokens, which are dear
    of = lambda *exts: own.where(F.col("ext").isin(list(exts))).drop("ext")
    return _rows(_js(of(*JS)).unionByName(_go(of(".go"))).unionByName(_prisma(of(".prisma"))))


def compose_references(files: DataFrame) -> DataFrame:
    """Variables that Compose puts in: braces always, a bare name only in capitals and not within a word; two dollars are one."""
    lines = F.filter(F.split("content", r"\r?\n"), lambda l: l.contains("$") & ~F.ltrim(l).startswith("#"))
    quoted = r""""(?:[^"\\]++|\\.)*+"|'[^']*+'"""
    # a comment begins a line or follows a blank, outside quotes
    bare = lambda l: F.replace(F.regexp_replace(l, rf"({quoted})|(?<=[ \t])#.*$", "$1"), F.lit("$$"), F.lit("_"))
    rows = files.where(F.col("content").contains("$")).select("repo_id", "path", F.explode(F.transform(lines, bare)).alias("line"))
    rows = rows.select("repo_id", "path", F.split("line", r"\$").alias("parts"))
    # what follows a dollar, and what stands before it
    rows = rows.select("repo_id", "path", F.explode(F.transform("parts", lambda p, k: F.struct(F.get("parts", k - 1).alias("last"), p.alias("part")))).alias("p")).where("p.last IS NOT NULL")
    part, inner = F.col("p.part"), F.substring("p.part", 2, 1 << 20)
    braced = part.startswith("{")
    name = F.when(braced, F.regexp_extract(inner, r"^[A-Za-z_]\w*", 0)).when(~F.col("p.last").rlike(r"\w$"), F.regexp_extract(part, r"^[A-Z_][A-Z0-9_]*+(?![a-z])", 0))
    sign = F.substring(F.regexp_replace(F.regexp_replace(inner, r"^\w+", ""), "^:", ""), 1, 1)
    rows = rows.select("repo_id", "path", F.lit("compose").alias("family"), name.alias("name"), ~(braced & sign.isin("-", "+")).alias("required"))
    return _rows(rows.toDF("repo_id", "path", "family", "name", "required"))


def html_references(files: DataFrame) -> DataFrame:
    """Names between percent signs of an index.html that bundlers show: public ones and NODE_ENV."""
    names = F.regexp_extract_all("content", F.lit("%([A-Z_][A-Z0-9_]*)%"), F.lit(1))
    rows = files.where((paths.base_name(F.col("path")) == "index.html") & F.col("content").contains("%")).select("repo_id", "path", F.lit("html").alias("family"), F.explode(names).alias("name"), F.lit(True).alias("required"))
    return _rows(rows.where((text.is_public_name(F.col("name")) | (F.col("name") == "NODE_ENV")) & ~F.col("name").isin(BUILT_IN)))
