"""Values of CI workflows: expressions over matrices, and what jobs do."""

from __future__ import annotations

import itertools
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.functions import text

#: Results of one expression, and characters of a value that is expanded, at most.
MOST_RESULTS, MOST_LENGTH = 32, 256


def _plain(value) -> list[str]:
    """A literal as a list of one, anything else as none."""
    if isinstance(value, bool):
        return [str(value).lower()]
    if isinstance(value, (int, float)):
        return [f"{value:g}" if isinstance(value, float) else str(value)]
    return [value] if isinstance(value, str) and "${{" not in value else []


def _below(value, names: list[str]):
    for name in names:
        value = value.get(name) if isinstance(value, dict) else None
    return value


def matrix_values(matrix, key: str) -> list[str]:
    """The different literals of a matrix key: its list, then the entries of ``include``."""
    first, *names = key.split(".")
    matrix = matrix if isinstance(matrix, dict) else {}
    more = [e[first] for e in matrix.get("include") or [] if isinstance(e, dict) and first in e] if isinstance(matrix.get("include"), list) else []
    listed = matrix.get(first) if isinstance(matrix.get(first), list) else []
    return list(dict.fromkeys(v for x in [*listed, *more] for v in _plain(_below(x, names))))


def expand(value: str, matrix, env: list) -> list[str] | None:
    """All literals that a value with ``${{ matrix.k }}``, ``${{ env.NAME }}`` and ``${{ 'text' }}`` can be, the last expression changing fastest,
    MOST_RESULTS at most; None if one of them is not known. ``env``: maps, the innermost first."""
    if "${{" not in value:
        return [value]
    if len(value) > MOST_LENGTH:
        return None
    start, *parts = value.split("${{")
    options = [[start]]
    for part in parts:
        inner, sign, tail = part.partition("}}")
        inner = inner.strip()
        if not sign or "}" in inner:
            return None
        if inner.startswith("matrix."):
            found = matrix_values(matrix, inner[7:])
        elif inner.startswith("env."):
            found = next((_plain(m[inner[4:]]) for m in env if isinstance(m, dict) and inner[4:] in m), [])
        else:
            found = [inner[1:-1]] if len(inner) > 1 and inner[0] == inner[-1] == "'" and "'" not in inner[1:-1] else []
        if not found:
            return None
        options += [found, [tail]]
    every = dict.fromkeys(map("".join, itertools.islice(itertools.product(*options), 64 * MOST_RESULTS)))
    return list(every)[:MOST_RESULTS]


def expand_expression(value: Column, matrix: Column, env: Column) -> Column:
    """``expand`` of a column; ``matrix``: JSON text, ``env``: array of JSON texts. Null for null."""

    def read(values: pd.Series, matrices: pd.Series, envs: pd.Series) -> pd.Series:
        load = lambda t: json.loads(t) if t else None
        return pd.Series([None if v is None else expand(v, load(m), [load(e) for e in (s if s is not None else [])]) for v, m, s in zip(values, matrices, envs, strict=True)], dtype="object")

    return F.pandas_udf(read, "array<string>")(value, matrix, env)


def job_tasks(steps: DataFrame) -> DataFrame:
    """(repo_id, path, job, tasks): what the texts of a job's steps (names, commands, actions) do, in canonical order, each once."""
    each = steps.select("repo_id", "path", "job", F.explode_outer(text.infer_tasks(F.col("text"))).alias("task"))
    found = each.groupBy("repo_id", "path", "job").agg(F.collect_set("task").alias("found"))
    order = list(dict.fromkeys(task for task, _ in text.TASK_WORDS))
    return found.select("repo_id", "path", "job", F.filter(F.lit(order), lambda t: F.array_contains("found", t)).alias("tasks"))
