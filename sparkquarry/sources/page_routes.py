"""Routes that follow from the names of files: Nuxt and Next, as path expressions.

files: (repo_id, path, package): every listed file with the directory of the package that owns it. Routes: repo_id, package, framework, kind, method, path,
file, confidence and note, as ``evidence.finalise_routes`` takes them (with a null line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.functions import code_tokens as ct
from sparkquarry.functions import paths

#: Endings of server files and pages, methods in names, marks of environments, and files of the pages router that are no pages.
NUXT_SERVER, NUXT_PAGES = [".ts", ".js", ".mjs", ".mts"], [".vue", ".tsx", ".jsx"]
METHODS = ["get", "post", "put", "patch", "delete", "head", "options"]
MARKS = {"dev": "development only", "prod": "production only", "prerender": "prerender only"}
NEXT_PAGES, NEXT_HANDLERS, NEXT_ROUTER = ["tsx", "jsx", "ts", "js", "mdx"], ["ts", "js", "tsx", "jsx"], [".js", ".jsx", ".ts", ".tsx", ".mdx"]
NEXT_SPECIAL = ["_app", "_document", "_error", "_middleware"]
NESTED = "nested route parent"


def _inside(path: Column, folder: Column) -> Column:
    """The path as seen from a directory that it lies in; null elsewhere."""
    front = F.when(folder == ".", "").otherwise(F.concat(folder, F.lit("/")))
    return F.when(path.startswith(front), F.substr(path, F.length(front) + 1))


def _at(package: Column, folder: Column | str) -> Column:
    folder = F.lit(folder) if isinstance(folder, str) else folder
    return F.when(package == ".", folder).otherwise(F.concat_ws("/", package, folder))


def _own(files: DataFrame, packages: DataFrame) -> DataFrame:
    """The files of packages, without tests. Several files share a package, so the package side is the small one."""
    return files.join(packages, ["repo_id", "package"]).where(~paths.is_test_file(F.col("path")))


def _stem(path: Column) -> Column:
    ext = paths.ext_of(path)
    return F.substr(path, F.lit(1), F.length(path) - F.length(ext))


def _is_group(segment: Column) -> Column:
    return segment.startswith("(") & segment.endswith(")")


def _shown(segments: Column) -> Column:
    """A path of segments without groups and without ``index`` at its end."""
    kept = F.filter(segments, lambda s: ~_is_group(s))
    last = F.element_at(F.concat(F.array(F.lit("")), kept), -1)
    return F.concat(F.lit("/"), F.array_join(F.when(last == "index", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept), "/"))


def _routes(rows: DataFrame, framework: str) -> DataFrame:
    return rows.select("repo_id", "package", F.lit(framework).alias("framework"), "kind", "method", "route", "path", "confidence", "note").toDF(
        "repo_id", "package", "framework", "kind", "method", "path", "file", "confidence", "note"
    ).withColumn("line", F.lit(None).cast("int"))


def nuxt_routes(files: DataFrame, packages: DataFrame) -> DataFrame:
    """``packages``: (repo_id, package, src_dir) of Nuxt; src_dir is null unless the config sets it.

    Pages lie in ``app/pages`` where a package has it, else in ``pages``, and server routes in ``server``; below src_dir if that is set. A page beside a
    directory of its name is the parent of nested routes: it is left out where that directory has a page of its own for the same path.
    """
    own = _own(files, packages)
    here = Window.partitionBy("repo_id", "package")
    has = lambda folder: F.max(_inside(F.col("path"), _at(F.col("package"), folder)).isNotNull()).over(here)
    src = F.when(F.col("src_dir").isNull() | (F.col("src_dir") == "."), None).otherwise(F.col("src_dir"))
    own = own.withColumn("src", src).withColumns({"new": has("app/pages"), "inner": has(F.concat_ws("/", "src", F.lit("server")))})
    pages = F.when(F.col("src").isNotNull(), F.concat("src", F.lit("/pages"))).when(F.col("src_dir").isNull() & F.col("new"), "app/pages").otherwise("pages")
    server = F.when(F.col("src").isNotNull() & F.col("inner"), F.concat("src", F.lit("/server"))).otherwise("server")
    own = own.withColumns({"page": _inside(F.col("path"), _at(F.col("package"), pages)), "api": _inside(F.col("path"), _at(F.col("package"), F.concat(server, F.lit("/api")))), "plain": _inside(F.col("path"), _at(F.col("package"), F.concat(server, F.lit("/routes"))))})
    hidden = lambda segments: F.exists(segments, lambda s: s.startswith(".") | s.startswith("-"))

    calls = own.withColumn("inside", F.coalesce("api", "plain")).where(F.col("inside").isNotNull() & paths.ext_of(F.col("inside")).isin(NUXT_SERVER) & ~F.col("inside").endswith(".d.ts"))
    calls = calls.withColumn("segments", F.split(_stem(F.col("inside")), "/")).where(~hidden(F.col("segments")))
    # name[.method][.mark]
    parts = F.split(F.element_at("segments", -1), "[.]")
    calls = calls.withColumn("parts", parts).withColumn("mark", F.when((F.size("parts") > 1) & F.element_at("parts", -1).isin(list(MARKS)), F.element_at("parts", -1)))
    calls = calls.withColumn("parts", F.when(F.col("mark").isNotNull(), F.slice("parts", F.lit(1), F.size("parts") - 1)).otherwise(F.col("parts")))
    verb = F.lower(F.element_at("parts", -1))
    calls = calls.withColumn("verb", F.when((F.size("parts") > 1) & verb.isin(METHODS), F.upper(verb)))
    name = F.array_join(F.when(F.col("verb").isNotNull(), F.slice("parts", F.lit(1), F.size("parts") - 1)).otherwise(F.col("parts")), ".")
    front = F.when(F.col("api").isNotNull(), F.array(F.lit("api"))).otherwise(F.array().cast("array<string>"))
    whole = F.concat(front, F.slice("segments", F.lit(1), F.size("segments") - 1), F.array(name))
    note = F.try_element_at(F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair]), F.col("mark"))
    calls = calls.withColumns({"kind": F.lit("api"), "method": F.coalesce("verb", F.lit("ANY")), "route": _shown(whole), "confidence": F.lit("high"), "note": note})

    shown = own.where(F.col("page").isNotNull() & paths.ext_of(F.col("page")).isin(NUXT_PAGES)).withColumn("stem", _stem(F.col("page"))).withColumn("segments", F.split("stem", "/")).where(~hidden(F.col("segments")))
    above = shown.select("repo_id", "package", F.explode(paths.ancestors(paths.dir_of(F.col("stem")))).alias("a")).select("repo_id", "package", F.col("a.dir").alias("stem"), F.lit(True).alias("parent")).distinct()
    index = shown.where(F.element_at("segments", -1) == "index").select("repo_id", "package", paths.dir_of(F.col("stem")).alias("stem"), F.lit(True).alias("own_index")).distinct()
    keys = ["repo_id", "package", "stem"]
    shown = shown.join(above, keys, "left").join(index, keys, "left").where("parent IS NULL OR own_index IS NULL")
    shown = shown.withColumns({"kind": F.lit("page"), "method": F.lit("GET"), "route": _shown(F.col("segments")), "confidence": F.lit("high"), "note": F.when(F.col("parent"), NESTED)})
    return _routes(calls, "nuxt").unionByName(_routes(shown, "nuxt"))


def handler_methods(content: Column) -> Column:
    """HTTP methods that a route handler exports: functions, constants, patterns and lists of names; each once."""
    tokens = F.filter(ct.tokens(content), lambda t: t != "\n")
    after = F.transform(ct.places(tokens, F.array(F.lit("export"))), lambda at: ct.behind(tokens, at))

    def names(a: Column) -> Column:
        a = F.when(ct.starts(a, "async"), ct.rest(a, 1)).otherwise(a)
        word = ct.get(a, 0)
        of_function = F.array(F.when(ct.get(a, 1) == "*", ct.get(a, 2)).otherwise(ct.get(a, 1)))
        braced = F.when(word == "{", ct.rest(a, 1)).when(ct.get(a, 1) == "{", ct.rest(a, 2))
        # of ``A as B`` and ``A: B`` the last name counts
        listed = F.transform(F.split(F.array_join(ct.until(braced, "}"), " "), ","), lambda e: F.element_at(F.split(F.trim(e), "[ :]+"), -1))
        bound = F.when(ct.get(a, 1) == "{", listed).otherwise(F.array(ct.get(a, 1)))
        return F.when(word == "function", of_function).when(word.isin("const", "let", "var"), bound).when(word == "{", listed)

    found = F.flatten(F.filter(F.transform(after, names), lambda x: x.isNotNull()))
    return F.array_distinct(F.filter(found, lambda n: n.isin([m.upper() for m in METHODS])))


def next_routes(files: DataFrame, packages: DataFrame) -> DataFrame:
    """``packages``: (repo_id, package, base_path) of Next; base_path is null or empty unless the config sets it. ``files`` have a ``content`` as well.

    The app router (``app``, ``src/app``) has pages and handlers, one route for each method that a handler exports; the pages router (``pages``, ``src/pages``)
    has pages and what lies under ``api``. The directories under ``src`` count only where the package has neither app nor pages. Private directories
    and intercepting routes are none; a page of a slot counts only where no other page has its path.
    """
    own = _own(files, packages)
    here = Window.partitionBy("repo_id", "package")
    has = lambda folder: F.max(_inside(F.col("path"), _at(F.col("package"), folder)).isNotNull()).over(here)
    own = own.withColumn("top", has("app") | has("pages"))
    folder = lambda name: _at(F.col("package"), F.when(F.col("top"), name).otherwise(f"src/{name}"))
    own = own.withColumns({"app": _inside(F.col("path"), folder("app")), "pages": _inside(F.col("path"), folder("pages"))})
    based = lambda route: F.concat(F.when(F.coalesce("base_path", F.lit("")) == "", "").otherwise(F.concat(F.lit("/"), F.trim("base_path", F.lit("/")))), F.when((route == "/") & (F.coalesce("base_path", F.lit("")) != ""), "").otherwise(route))

    app = own.where("app IS NOT NULL").withColumn("segments", F.slice(F.split("app", "/"), F.lit(1), F.size(F.split("app", "/")) - 1))
    name, end = F.substring_index(paths.base_name(F.col("app")), ".", 1), F.substring_index(paths.base_name(F.col("app")), ".", -1)
    plain = F.size(F.split(paths.base_name(F.col("app")), "[.]")) == 2
    app = app.withColumn("what", F.when(plain & (name == "page") & end.isin(NEXT_PAGES), "page").when(plain & (name == "route") & end.isin(NEXT_HANDLERS), "api")).where("what IS NOT NULL")
    app = app.where(~F.exists("segments", lambda s: s.startswith("_") | s.rlike(r"^\([.]{1,3}\)")))
    kept = F.transform(F.filter("segments", lambda s: ~_is_group(s) & ~s.startswith("@")), lambda s: F.regexp_replace(s, "(?i)^%5F", "_"))
    app = app.withColumns({"route": F.concat(F.lit("/"), F.array_join(kept, "/")), "slot": F.exists("segments", lambda s: s.startswith("@"))})
    served = app.where("what = 'page' AND NOT slot").select("repo_id", "package", "route", F.lit(True).alias("served")).distinct()
    page = app.where("what = 'page'").join(served, ["repo_id", "package", "route"], "left").where("NOT slot OR served IS NULL")
    page = page.withColumns({"kind": F.lit("page"), "method": F.lit("GET"), "confidence": F.lit("high"), "note": F.lit(None).cast("string")})
    handler = app.where("what = 'api'").withColumn("methods", F.coalesce(handler_methods(F.col("content")), F.array().cast("array<string>")))
    handler = handler.withColumn("method", F.explode_outer("methods"))
    unknown = F.col("method").isNull()
    handler = handler.withColumns({"kind": F.lit("api"), "confidence": F.when(unknown, "low").otherwise("high"), "note": F.when(unknown, "no exported HTTP method handlers found"), "method": F.coalesce("method", F.lit("ANY"))})

    router = own.where(F.col("pages").isNotNull() & paths.ext_of(F.col("pages")).isin(NEXT_ROUTER) & ~F.col("pages").endswith(".d.ts"))
    router = router.withColumn("segments", F.split(_stem(F.col("pages")), "/")).where(~F.element_at("segments", -1).isin([*NEXT_SPECIAL, ""]))
    cut = F.when(F.element_at("segments", -1) == "index", F.slice("segments", F.lit(1), F.size("segments") - 1)).otherwise(F.col("segments"))
    kind = F.when(F.get(cut, F.lit(0)).eqNullSafe("api"), "api").otherwise("page")
    router = router.withColumns({"route": F.concat(F.lit("/"), F.array_join(cut, "/")), "kind": kind, "confidence": F.lit("high"), "note": F.lit(None).cast("string")}).withColumn("method", F.when(F.col("kind") == "api", "ANY").otherwise("GET"))
    columns = ["repo_id", "package", "path", "kind", "method", "route", "confidence", "note", "base_path"]
    every = page.select(*columns).unionByName(handler.select(*columns)).unionByName(router.select(*columns))
    return _routes(every.withColumn("route", based(F.col("route"))), "next")
