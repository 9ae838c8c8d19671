"""Relative POSIX paths as column expressions; ``.`` is the top directory.

Every function takes and returns columns, is null for a null path and runs inside code generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directory names that give the paths under them a role.
ROLE_SEGMENTS = {
    "test": ["test", "tests", "__tests__", "spec", "specs", "__mocks__", "e2e", "cypress"],
    "fixture": ["fixture", "fixtures", "__fixtures__", "testdata", "mocks"],
    "example": ["example", "examples", "sample", "samples", "demo", "demos"],
    "template": ["template", "templates", "boilerplate", "scaffold", "scaffolds"],
    "playground": ["playground", "playgrounds", "sandbox", "sandboxes"],
    "benchmark": ["bench", "benchmark", "benchmarks"],
    "docs": ["docs", "doc", "documentation", "website"],
}
NON_PROJECT_ROLES = [r for r in ROLE_SEGMENTS if r != "docs"]
#: Directories that no listing enters.
ALWAYS_IGNORED_DIRS = [
    ".git", ".hg", ".svn", ".jj", "node_modules", "bower_components", "jspm_packages", "vendor", ".pnpm-store", ".yarn", ".next",
    ".nuxt", ".output", ".svelte-kit", ".astro", ".angular", ".turbo", ".nx", ".cache", ".parcel-cache", ".vercel", ".netlify",
    ".wrangler", ".expo", ".docusaurus", ".terraform", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache",
    ".ruff_cache", ".tox", ".gradle", ".idea", "coverage", ".nyc_output", ".direnv", ".devenv",
]


def segments(path: Column) -> Column:
    return F.split(path, "/")


def dir_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit("."))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ext_of(path: Column) -> Column:
    """Lower-case extension with its dot; none for names that only begin with a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]*)$", 1))


def depth_of(path: Column) -> Column:
    """Directories above a file: 0 at the top."""
    return F.size(segments(path)) - 1


def dir_segments(path: Column) -> Column:
    """The directory names of a path, without the file name."""
    parts = segments(path)
    return F.slice(parts, 1, F.size(parts) - 1)


def ancestors(directory: Column) -> Column:
    """Array of (dir, depth): the directory itself, those above it, and ``.`` at depth 0."""
    parts = F.filter(segments(directory), lambda s: (s != "") & (s != "."))
    at = lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("dir"), i.alias("depth"))
    top = F.array(F.struct(F.lit(".").alias("dir"), F.lit(0).alias("depth")))
    return F.when(F.size(parts) > 0, F.concat(top, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), at))).when(directory.isNotNull(), top)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize(path: Column) -> Column:
    """Collapses ``.`` and ``..``; null for absolute paths and those that leave the top."""

    def step(done: Column, part: Column) -> Column:
        return (
            F.when(F.array_contains(done, ".."), done)
            .when(part.isin("", "."), done)
            .when((part == "..") & (F.size(done) == 0), F.array(F.lit("..")))
            .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(part)))
        )

    def whole(done: Column) -> Column:
        return F.when(~F.array_contains(done, ".."), F.when(F.size(done) == 0, F.lit(".")).otherwise(F.array_join(done, "/")))

    def one(p: Column) -> Column:
        walked = F.aggregate(segments(p), F.array().cast("array<string>"), step, whole)
        return F.when(~p.rlike(r"(?:^|/)\.{0,2}(?:/|$)"), p).when(~p.startswith("/"), walked)

    return let(path, one)


def join_path(directory: Column, path: Column) -> Column:
    joined = lambda d, p: F.when((d == ".") & p.isNotNull() & ~p.startswith("/"), p).otherwise(F.concat_ws("/", d, p))
    return let(directory, lambda d: let(path, lambda p: normalize(joined(d, p))))


def is_within(path: Column, directory: Column) -> Column:
    return (directory == ".") | (path == directory) | path.startswith(F.concat(directory, F.lit("/")))


def rebase(path: Column, directory: Column) -> Column:
    """The path as seen from ``directory``; steps up with ``..`` where it lies elsewhere."""
    here = F.filter(segments(directory), lambda s: (s != "") & (s != "."))
    there = F.filter(segments(path), lambda s: (s != "") & (s != "."))
    shared = F.size(
        F.filter(
            F.sequence(F.lit(1), F.greatest(F.least(F.size(here), F.size(there)), F.lit(1))),
            lambda i: (F.size(here) >= i) & (F.size(there) >= i) & (F.slice(here, 1, i) == F.slice(there, 1, i)),
        )
    )
    parts = F.concat(F.array_repeat(F.lit(".."), F.size(here) - shared), F.slice(there, shared + 1, F.greatest(F.size(there) - shared, F.lit(0))))
    return F.when(F.size(parts) == 0, F.lit(".")).otherwise(F.array_join(parts, "/"))


def static_prefix(pattern: Column) -> Column:
    """The leading segments of a glob that hold no wildcard."""
    parts = segments(pattern)
    wild = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: F.get(parts, i - 1).rlike(r"[*?{}\[\]!]"))
    upto = F.when(F.size(wild) > 0, F.get(wild, F.lit(0)) - 1).otherwise(F.size(parts))
    found = F.array_join(F.slice(parts, 1, upto), "/")
    return F.when(found == "", F.lit(".")).otherwise(found)


def path_roles(path: Column) -> Column:
    """Sorted roles of the directories that a path lies in."""
    names = F.transform(dir_segments(path), lambda s: F.lower(s))
    roles = [F.when(F.arrays_overlap(names, F.array(*map(F.lit, found))), F.lit(role)) for role, found in ROLE_SEGMENTS.items()]
    return F.array_sort(F.array_compact(F.array(*roles)))


def is_under(path: Column, roles: list[str] | None = None) -> Column:
    found = [s for r in roles or NON_PROJECT_ROLES for s in ROLE_SEGMENTS[r]]
    return F.exists(dir_segments(path), lambda s: F.lower(s).isin(found))


def is_ignored_dir(path: Column) -> Column:
    return F.exists(dir_segments(path), lambda s: s.isin(ALWAYS_IGNORED_DIRS))


#: Endings of names of tests, and directories of generated or vendored code.
TEST_MARKS = ["test", "tests", "spec", "e2e-spec", "e2e"]
GENERATED_DIRS = ["dist", "build", "out", "public", "static", "lib-cov", "storybook-static", "generated"]
_SCRIPT_ENDS = [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".mts", ".cts", ".vue", ".svelte"]


def is_test_file(path: Column) -> Column:
    """By the last mark of a script's name, by the habits of other languages, or by a directory of tests."""
    name, ext = base_name(path), ext_of(path)
    stem = F.substr(name, F.lit(1), F.length(name) - F.length(ext))
    mark = F.element_at(F.split(stem, "[.]"), -1)
    marked = ext.isin(_SCRIPT_ENDS) & stem.contains(".") & mark.isin(TEST_MARKS)
    python = (ext == ".py") & (stem.startswith("test_") | stem.endswith("_test"))
    return marked | python | name.endswith("_test.go") | name.endswith("_spec.rb") | F.array_contains(dir_segments(path), "__tests__")


def is_generated(path: Column) -> Column:
    """Declarations, minified scripts, generated Go code, and what lies in a build directory."""
    name = base_name(path)
    ends = [".d.ts", ".d.mts", ".d.cts", ".min.js", ".min.cjs", ".min.mjs", ".pb.go", "_gen.go"]
    found = F.exists(dir_segments(path), lambda s: s.isin(GENERATED_DIRS))
    for end in ends:
        found = found | name.endswith(end)
    return found
