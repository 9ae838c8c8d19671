"""Shell commands of scripts as the programs that they run.

``parse_invocations`` gives an array of (bin, args); what follows are column expressions over it and a join with a table of matchers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Programs that run the command behind their own flags, managers and their words that run a package's program.
WRAPPERS = {"npx", "pnpx", "bunx", "cross-env", "cross-env-shell", "env", "c8", "nyc", "time", "nohup"}
MANAGERS, RUN_WORDS, DOTENV = {"npm", "pnpm", "yarn", "bun"}, {"exec", "dlx", "x"}, {"dotenv", "dotenv-cli"}
INVOCATIONS = "array<struct<bin: string, args: array<string>>>"


def split_command(command: str) -> list[list[str]]:
    """Words of each simple command. Quotes and backslashes keep their meaning; ``& | ; ( )`` and line ends part commands."""
    commands, words, word = [], [], None
    quote, chars = "", iter(command)
    for c in chars:
        if quote and c == quote:
            quote = ""
        elif c == "\\" and quote != "'":
            word = (word or "") + next(chars, "\\")
        elif quote:
            word += c
        elif c in "\"'":
            quote, word = c, word or ""
        elif c in " \t\r&|;()\n":
            if word is not None:
                words.append(word)
                word = None
            if c not in " \t\r" and words:
                commands.append(words)
                words = []
        else:
            word = (word or "") + c
    words += [word] if word is not None else []
    return commands + ([words] if words else [])


def program_of(words: list[str]) -> tuple[str, list[str]] | None:
    """Program and arguments of a simple command, without assignments in front and the programs that only run others."""
    rest = words
    while rest:
        name = rest[0].rsplit("/", 1)[-1]
        sign = rest[0].find("=")
        if sign > 0 and rest[0][:sign].isidentifier() and rest[0].isascii():
            rest = rest[1:]
            continue
        if name in DOTENV:
            rest = rest[rest.index("--") + 1 :] if "--" in rest else []
            continue
        second = rest[1] if len(rest) > 1 else ""
        if name in WRAPPERS or name in MANAGERS and second in RUN_WORDS:
            rest = rest[1 if name in WRAPPERS else 2 :]
            while rest and rest[0].startswith("-"):
                rest = rest[1:]
            continue
        if name in ("pnpm", "yarn") and second and second != "run" and not second.startswith("-"):
            rest = rest[1:]
            continue
        return name, rest[1:]
    return None


def parse_invocations(command: Column) -> Column:
    """Every program that a script runs, in order; empty for null."""

    def read(commands: pd.Series) -> pd.Series:
        return pd.Series([[{"bin": p[0], "args": p[1]} for p in map(program_of, split_command(c or "")) if p] for c in commands], dtype="object")

    return F.pandas_udf(read, INVOCATIONS)(command)


def config_argument(args: Column, short: bool = True) -> Column:
    """The value of the first ``--config FILE``, ``--config=FILE`` or ``-c FILE``; null if another flag stands in its place."""
    flags = ["--config", "-c"] if short else ["--config"]
    at = F.array_position(F.transform(args, lambda a: a.isin(flags) | a.startswith("--config=")), True).cast("int")
    flag, value = F.get(args, at - 1), F.get(args, at)
    joined = F.when(flag.startswith("--config="), F.substr(flag, F.lit(10)))
    return F.when(at > 0, F.coalesce(joined, F.when(~value.startswith("-"), value)))


def runs(invocations: Column, program: str, *args: str) -> Column:
    """Whether a script runs a program with all of these arguments."""
    return F.exists(invocations, lambda i: (i["bin"] == program) & (F.size(F.array_intersect(i["args"], F.lit(list(args)).cast("array<string>"))) == len(set(args))))


def script_signals(scripts: DataFrame, matchers: DataFrame) -> DataFrame:
    """Tools that scripts run: (repo_id, package, script, id, label).

    ``scripts``: (repo_id, package, name, command); ``matchers``: (id, label, bin, needs, without, script): a program with all arguments of ``needs``
    and none of ``without`` (arrays), in a script of that name (null: any). The join is by program.
    """
    each = scripts.select("repo_id", "package", F.col("name").alias("script"), F.explode(parse_invocations(F.col("command"))).alias("i")).select("repo_id", "package", "script", "i.*")
    m = matchers.select("id", "label", "bin", "needs", "without", F.col("script").alias("only"))
    fits = (F.size(F.array_except("needs", "args")) == 0) & ~F.arrays_overlap("without", "args") & (F.col("only").isNull() | (F.col("only") == F.col("script")))
    return each.join(m, "bin").where(fits).select("repo_id", "package", "script", "id", "label").distinct()
