"""Versions: natural order as arrays of integers, release lines, ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of long-term releases of Node and their majors.
NODE_CODENAMES = {
    "argon": "4", "boron": "6", "carbon": "8", "dubnium": "10", "erbium": "12", "fermium": "14", "gallium": "16", "hydrogen": "18",
    "iron": "20", "jod": "22", "krypton": "24",
}
#: End of life by major of Node.
NODE_EOL = {
    10: "2021-04-30", 12: "2022-04-30", 14: "2023-04-30", 16: "2023-09-11", 18: "2025-04-30", 20: "2026-04-30", 22: "2027-04-30", 24: "2028-04-30",
}


def version_key(version: Column) -> Column:
    """Major, minor, patch as ints (absent parts 0); arrays compare part by part. Null if it has no number."""
    parts = F.transform(F.regexp_extract_all(F.regexp_extract(version, r"^v?(\d+(?:\.\d+){0,2})", 1), F.lit(r"(\d+)"), 1), lambda x: x.cast("int"))
    return F.when(F.size(parts) > 0, F.slice(F.concat(parts, F.array(F.lit(0), F.lit(0), F.lit(0))), 1, 3))


def major_of(version: Column) -> Column:
    found = F.regexp_extract(version, r"(\d+)", 1)
    return F.when(found != "", found.try_cast("int"))


#: Characters of a range that is kept as it is written, at most.
MAX_RANGE = 100
#: Words that an early release carries.
EARLY = ["rc", "beta", "alpha", "pre", "canary"]
#: Marks that ranges are written with, beside words and blanks.
RANGE_MARKS = ".*+~^<>=|-"


def _with(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _cut(value: Column, then) -> Column:
    """``then(release, what follows it)`` of a version with or without ``v``; the release is null unless it is one to three numbers."""

    def parts(number: Column) -> Column:
        release = F.regexp_extract(number, r"^\d+(?:\.\d+)*", 0)
        fine = (release != "") & (F.size(F.split(release, "[.]")) <= 3)
        return F.struct(F.when(fine, release).alias("release"), F.substr(number, F.length(release) + 1).alias("rest"))

    return _with(_with(F.regexp_replace(value, "^[vV]", ""), parts), lambda x: then(x["release"], x["rest"]))


def _is_tagged(rest: Column) -> Column:
    """Whether all that follows a release are its tags: ``-word`` and ``+word``."""
    return (rest == "") | rest.startswith("-") & ~rest.rlike("^-[+]|^-$|[+]$|[+].*[+]|[^0-9A-Za-z.+-]") | rest.startswith("+") & (F.length(rest) > 1) & ~rest.rlike("^.+[+]|[^0-9A-Za-z.+-]")


def _reads_like_range(value: Column) -> Column:
    return value.rlike(r"\d") & (F.translate(F.regexp_replace(value, r"[\w\s]", ""), RANGE_MARKS, "") == "")


def clean_version(declared: Column) -> Column:
    """The one version that a declaration names, a range as it is written, or null for tags, protocols and wildcards."""

    def aliased(value: Column) -> Column:
        # behind npm: stands another package, whose range counts
        package = F.substr(value, F.lit(6))
        name = F.concat(F.substring(package, 1, 1), F.substring_index(F.substr(package, F.lit(2)), "@", 1))
        target = F.trim(F.substr(package, F.length(name) + 2))
        return F.when(value.startswith("npm:") & (target != ""), target).otherwise(value)

    def cleaned(value: Column) -> Column:
        first = F.substring(value, 1, 1)
        is_range = _reads_like_range(value) & ~value.contains("_") & (~first.rlike("[A-Za-z]") | value.rlike(r"^v\d")) & (F.length(value) <= MAX_RANGE)
        alone = lambda bare: _cut(bare, lambda release, rest: F.when(release.isNotNull() & _is_tagged(rest), F.regexp_replace(bare, "^v", "")))
        return F.coalesce(_with(F.regexp_replace(value, "^[~^=]", ""), alone), F.when(is_range, value))

    return _with(_with(F.trim(declared), aliased), cleaned)


def exact_version(text: Column) -> Column:
    return _with(text, lambda t: _cut(t, lambda release, rest: F.when((F.size(F.split(release, "[.]")) == 3) & _is_tagged(rest) & t.rlike(r"^\d"), t)))


def normalized(raw: Column) -> Column:
    """Struct (version, kind): exact, range (kept as written) or alias (of no version, but for codenames)."""
    out = lambda v, k: F.struct(v.cast("string").alias("version"), F.lit(k).alias("kind"))
    names = F.create_map(*[F.lit(x) for pair in NODE_CODENAMES.items() for x in pair])

    def bare(value: Column) -> Column:
        quoted = (F.length(value) > 1) & F.substring(value, 1, 1).isin("'", '"') & F.substring(value, -1, 1).isin("'", '"')
        return F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)

    def exact(release: Column, rest: Column) -> Column:
        wild = F.regexp_replace(F.lower(rest), r"[.][x*]", "") == ""
        early = lambda tag: F.exists(F.lit(EARLY), lambda word: tag.startswith(word)) & ~tag.rlike("[^0-9a-z.]")
        is_early = _with(F.regexp_replace(F.lower(rest), "^-", ""), early)
        return F.when(release.isNotNull() & wild, release).when(release.isNotNull() & is_early, F.concat(release, rest))

    def judged(value: Column) -> Column:
        code = F.try_element_at(names, F.regexp_replace(F.lower(value), "^lts/", ""))
        is_range = (F.translate(F.substring(F.lower(value), 1, 1), "<>=^~v0123456789", "") == "") & _reads_like_range(value)
        return _with(_cut(value, exact), lambda found: F.when(found.isNotNull(), out(found, "exact")).when(is_range, out(value, "range")).otherwise(out(code, "alias")))

    return _with(_with(F.trim(raw), bare), judged)


def release_line(runtime: Column, version: Column) -> Column:
    """The major for Node, major.minor for others."""
    parts = F.split(version, r"\.")
    return F.array_join(F.slice(parts, 1, F.when(runtime == "node", 1).otherwise(2)), ".")


def fits_range(version: Column, declared: Column) -> Column:
    """Whether a version can satisfy an npm range; a partial version ("22", "22.1") fits if any of its
    releases does. Comparators, carets, tildes, wildcards, hyphen ranges and ``||`` are read as
    intervals of keys; null where either side cannot be read. An early release ("24.0.0-rc.1") lies before its release, and fits wherever the
    interval holds it; early releases of one release are not told apart.
    """
    early, done = F.array(F.lit(0)), F.array(F.lit(1))  # the last part of a key
    top = F.array(F.lit(2**31 - 1), F.lit(0), F.lit(0), F.lit(0))
    after = lambda key, part: F.concat(_bump(key, part), early)

    def judged(given: Column) -> Column:
        whole, tag = F.regexp_extract(given, r"^v?(\d+(?:\.\d+){0,2})(?:-[0-9A-Za-z.-]+)?(?:\+.*)?$", 1), given.rlike(r"^[^+]*-")
        n, key = F.size(F.split(whole, r"\.")), version_key(whole)
        low = F.concat(key, F.when(tag & (n == 3), early).otherwise(done))
        high = F.when(n == 1, after(key, 0)).when(n == 2, after(key, 1)).when(tag, F.concat(key, done)).otherwise(after(key, 2))
        return F.when(whole != "", F.struct(low.alias("low"), high.alias("high")))

    spaced = F.regexp_replace(F.regexp_replace(F.trim(declared), r"(\S+)\s+-\s+(\S+)", ">=$1 <=$2"), r"([<>=^~])\s+", "$1")
    readable = r"^(?:(?:[\^~]|>=?|<=?|=)?v?(?:\d+|[xX*])(?:\.(?:\d+|[xX*])){0,2}(?:-[0-9A-Za-z.-]+)?(?:\s+|$))+$"

    def interval(term: Column) -> Column:
        op = F.regexp_extract(term, r"^([\^~]|>=?|<=?|=)?", 1)
        number = F.regexp_extract(term, r"(\d+(?:\.\d+){0,2})", 1)
        given = F.when(term.rlike(r"^\D*[xX*]"), 0).otherwise(F.size(F.split(number, r"\.")))
        key = F.coalesce(version_key(number), F.array(F.lit(0), F.lit(0), F.lit(0)))
        return F.struct(op.alias("op"), given.alias("given"), key.alias("key"), (term.contains("-") & (given == 3)).alias("tag"))

    def ends(t: Column) -> Column:
        op, given, key, tag = t["op"], t["given"], t["key"], t["tag"]
        own = F.concat(key, F.when((given == 3) & ~tag, done).otherwise(early))
        beyond = F.when(given == 0, top).when(given == 1, after(key, 0)).when(given == 2, after(key, 1)).when(tag, F.concat(key, done)).otherwise(after(key, 2))
        caret = F.when((F.get(key, F.lit(0)) > 0) | (given == 1), after(key, 0)).when((F.get(key, F.lit(1)) > 0) | (given == 2), after(key, 1)).otherwise(after(key, 2))
        zero = F.array(F.lit(0), F.lit(0), F.lit(0), F.lit(0))
        lower = F.when(op.isin("<", "<="), zero).when(op == ">", beyond).otherwise(own)
        upper = (
            F.when((given == 0) & (op != "<"), top).when(op == "^", caret).when(op == "~", F.when(given == 1, after(key, 0)).otherwise(after(key, 1)))
            .when(op.isin(">", ">="), top).when(op == "<", own).otherwise(beyond)
        )
        return F.struct(lower.alias("lower"), upper.alias("upper"))

    def fits(v: Column, clauses: Column) -> Column:
        def clause_fits(clause: Column) -> Column:
            terms = F.transform(F.transform(F.filter(F.split(F.trim(clause), r"\s+"), lambda t: t != ""), interval), ends)
            lower = F.aggregate(terms, v["low"], lambda a, t: F.when(t["lower"] > a, t["lower"]).otherwise(a))
            upper = F.aggregate(terms, v["high"], lambda a, t: F.when(t["upper"] < a, t["upper"]).otherwise(a))
            return lower < upper

        ok = F.forall(clauses, lambda c: (F.trim(c) == "") | F.trim(c).rlike(readable))
        return F.when(v.isNotNull() & ok, F.exists(clauses, clause_fits))

    both = F.struct(_with(F.trim(version), judged).alias("v"), F.split(spaced, r"\s*\|\|\s*").alias("clauses"))
    return _with(both, lambda x: fits(x["v"], x["clauses"]))


def _bump(key: Column, part: int) -> Column:
    """The least key above all versions that agree with ``key`` up to ``part``."""
    return F.array(*[F.get(key, F.lit(i)) + (1 if i == part else 0) if i <= part else F.lit(0) for i in range(3)])


def is_go_older(toolchain: Column, directive: Column) -> Column:
    """Whether a Go toolchain is older than a directive; patches count only where the toolchain pins one."""
    a, b = version_key(F.regexp_replace(toolchain, "^go", "")), version_key(F.regexp_replace(directive, "^go", ""))
    pinned = toolchain.rlike(r"^(?:go)?\d+\.\d+\.\d+")
    return F.when(pinned, a < b).otherwise(F.slice(a, 1, 2) < F.slice(b, 1, 2))
