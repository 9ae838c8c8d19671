"""Paths of routes and addresses of repositories."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Short forms of hosts, and hosts that need no scheme.
SHORT_HOSTS = {"github": "https://github.com/", "gitlab": "https://gitlab.com/", "bitbucket": "https://bitbucket.org/", "gist": "https://gist.github.com/"}
KNOWN_HOSTS = ["github.com", "gitlab.com", "bitbucket.org"]
#: Hosts of providers.
PROVIDERS = {
    "github.com": "github", "ssh.github.com": "github", "gitlab.com": "gitlab", "altssh.gitlab.com": "gitlab", "bitbucket.org": "bitbucket", "altssh.bitbucket.org": "bitbucket",
    "dev.azure.com": "azure", "ssh.dev.azure.com": "azure", "codeberg.org": "codeberg",
}
HTTP_METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]


# routes --------------------------------------------------------------------------------------------

_BRACKETS = re.compile(r"\[(\[)?(\.\.\.)?([^\[\]/.]+)\]\]?")


def _closing(raw: str, at: int) -> int:
    """Where the bracket that opens at ``at`` closes; -1 if it does not."""
    opens, depth = raw[at], 0
    closes = {"{": "}", "(": ")"}[opens]
    for i in range(at, len(raw)):
        depth += (raw[i] == opens) - (raw[i] == closes)
        if not depth:
            return i
    return -1


def read_route(raw: str) -> tuple[str, list[str]]:
    """(path, notes) of a route in any of the styles ``[x]``, ``{x}``, ``:x`` and ``*x``: parameters as ``:x``, what takes the rest as ``*x``; one slash
    between segments and none at the end."""
    out, notes, at = "", [], 0
    while at < len(raw):
        c, name = raw[at], re.compile(r"[A-Za-z_]\w*").match(raw, at + 1)
        segment = _BRACKETS.match(raw, at) if c == "[" else None
        end = _closing(raw, at) if c == "{" else -1
        if segment and bool(segment[1]) == segment[0].endswith("]]"):
            out += ("*" if segment[2] else ":") + segment[3]
            notes += [f"optional {'catch-all' if segment[2] else 'parameter'}"] if segment[1] else []
            at = segment.end()
        elif end != -1:
            inner = raw[at + 1 : end]
            word, colon, _ = inner.partition(":")
            if inner.endswith("...") and inner[:-3].isidentifier():
                out += "*" + inner[:-3]
            elif re.fullmatch(r"[A-Za-z_][\w-]*", word) and (colon or word == inner):
                out += ":" + word
            elif inner != "$":
                out += read_route(inner)[0]
                notes.append("optional segment")
            at = end + 1
        elif c == ":" and name:
            out, at = out + ":" + name[0], name.end()
            close = _closing(raw, at) if raw[at : at + 1] in ("(", "{") and raw[at : at + 1] else -1
            at = close + 1 if close != -1 else at
            if raw[at : at + 1] == "?":
                notes, at = [*notes, "optional parameter"], at + 1
        else:
            out, at = out + c, at + 1
    path = "/" + "/".join(s for s in out.split("/") if s)
    return path, list(dict.fromkeys(notes))


def route_path(raw: Column) -> Column:
    """``read_route`` as (path, notes); null for null."""

    def read(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if v is None else read_route(v) for v in values], columns=["path", "notes"])

    return F.pandas_udf(read, "path string, notes array<string>")(raw)


def serve_mux_pattern(pattern: Column) -> Column:
    """(method, path) of a pattern of Go's mux; null for patterns with a host or an unknown method."""
    words = F.split(F.trim(pattern), r"\s+", 2)
    method = F.when(F.size(words) == 2, F.get(words, F.lit(0))).otherwise("ANY")
    path = F.element_at(words, -1)
    return F.when(path.startswith("/") & ((method == "ANY") & (F.size(words) == 1) | method.isin(HTTP_METHODS)), F.struct(method.alias("method"), path.alias("path")))


def upper_snake(key: Column) -> Column:
    """A camel case key as the name of its variable: ``APIKey`` is ``API_KEY``."""
    parted = F.regexp_replace(F.regexp_replace(key, "(?<=[a-z0-9])(?=[A-Z])", "_"), "(?<=[A-Z])(?=[A-Z][a-z])", "_")
    return F.upper(F.regexp_replace(parted, "[^A-Za-z0-9]+", "_"))


# repositories ----------------------------------------------------------------------------------------

def _without_user(url: Column) -> Column:
    """An address without user, query and fragment."""
    plain = F.regexp_replace(url, r"[?#].*$", "")
    return F.regexp_replace(plain, r"(?i)^([a-z][a-z0-9+.-]*://)[^/@]*@", "$1")


def repository_url(value: Column) -> Column:
    """A manifest's repository as an address for a browser, without credentials; null for what is none. Short forms (``github:a/b``, ``a/b``), scp paths
    and ssh addresses are turned into https."""
    v = F.regexp_replace(F.trim(value), r"^git\+", "")
    short, rest = F.substring_index(v, ":", 1), F.regexp_replace(F.substr(v, F.length(F.substring_index(v, ":", 1)) + 2), "^/+", "")
    host = F.try_element_at(F.create_map(*[F.lit(x) for pair in SHORT_HOSTS.items() for x in pair]), short)
    schemed = v.rlike(r"(?i)^[a-z][a-z0-9+.-]*://")
    bare = F.lower(F.regexp_replace(F.substring_index(v, "/", 1), r"(?i)^www\.", ""))
    scp = F.regexp_replace(v, r"^[^@/\s:]+@", "")
    scp_host = F.substring_index(scp, ":", 1)
    inner = _without_user(F.regexp_replace(v, r"(?i)^(?:ssh|git)://", "https://"))
    # a path behind the colon of an ssh address, no port
    pathed = F.regexp_replace(inner, r"^(https?://[^/:]+):(?!\d*(?:/|$))", "$1/")
    full = (
        F.when(host.isNotNull() & (rest != "") & ~schemed, F.concat(host, rest)).when(schemed, pathed).when(v.rlike(r"^[\w-]+/[\w.-]+$"), F.concat(F.lit("https://github.com/"), v))
        .when(bare.isin(KNOWN_HOSTS) & v.contains("/"), F.concat(F.lit("https://"), v)).when(scp.contains(":") & scp_host.rlike(r"^[^/\s]+\.[^/\s]+$"), F.concat(F.lit("https://"), scp_host, F.lit("/"), F.substr(scp, F.length(scp_host) + 2)))
    )
    full = F.regexp_replace(F.regexp_replace(_without_user(full), "/+$", ""), r"\.git$", "")
    return F.when(full.rlike(r"(?i)^https?://[^\s/]+"), full)


def remote_host(url: Column) -> Column:
    """The host of a remote in small letters: of an address with a scheme, or of the scp form; null for local paths."""
    v = F.trim(url)
    authority = F.substring_index(F.regexp_extract(v, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), "@", -1)
    named = F.when(authority.startswith("["), F.concat(F.substring_index(authority, "]", 1), F.lit("]"))).otherwise(F.regexp_replace(authority, r":\d*$", ""))
    scp = F.substring_index(F.regexp_replace(v, r"^[^@/\\]+@", ""), ":", 1)
    is_scp = F.regexp_replace(v, r"^[^@/\\]+@", "").rlike(r"^[^:/\\]{2,}:(?!//)")
    found = F.when(v.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), named).when(is_scp, scp)
    return F.when(found != "", F.lower(found))


def remote_provider(url: Column) -> Column:
    host = F.regexp_replace(remote_host(url), r"^www\.", "")
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in PROVIDERS.items() for x in pair]), host)
    return F.coalesce(known, F.when(host.endswith(".visualstudio.com"), "azure"))


def shown_remote(url: Column) -> Column:
    """A remote that may be shown: no credentials, query or fragment; of a local path only the last part."""
    v = F.trim(url)
    is_file = v.rlike("(?i)^file://")
    last = F.element_at(F.filter(F.split(F.regexp_replace(v, r"[?#].*$", ""), r"[\\/]+"), lambda s: s != ""), -1)
    plain = _without_user(v)
    user = F.regexp_extract(plain, r"^([^/@]+)@", 1)
    odd = (user != "") & ~plain.contains("://") & ~user.rlike(r"^[A-Za-z0-9._-]{1,32}$")
    shown = F.when(odd, F.substr(plain, F.length(user) + 2)).otherwise(plain)
    return F.when(is_file, F.concat(F.lit("file://…/"), last)).when(v.rlike(r"^(?:/|\\\\|[a-zA-Z]:[\\/])"), F.concat(F.lit("…/"), last)).otherwise(shown)


def clip_command(command: Column, most: int = 80) -> Column:
    """A command of at most ``most`` characters, cut before a word, without a quote that is left open, and with ``…`` where something is gone."""
    cut = F.regexp_replace(F.substring(command, 1, most), r"\s\S*$|^\S*$", "")

    def closed(quote: str):
        def of(text: Column) -> Column:
            odd = (F.length(text) - F.length(F.replace(text, F.lit(quote), F.lit("")))) % 2 == 1
            return F.when(odd, F.substring_index(text, quote, -1)).otherwise(F.lit(None).cast("string"))

        return of

    for quote in "\"'":
        open_ = closed(quote)(cut)
        cut = F.when(open_.isNotNull(), F.substr(cut, F.lit(1), F.length(cut) - F.length(open_) - 1)).otherwise(cut)
    cut = F.rtrim(cut)
    return F.when(F.length(command) <= most, command).when(cut == "", "…").otherwise(F.concat(cut, F.lit(" …")))
