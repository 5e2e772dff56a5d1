"""Column selection by name pattern and renaming by rule.

A selector is a function from the list of column names to the chosen ones, so a
specification can be written before any table exists.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

Selector = Callable[[list[str]], list[str]]


def begins(prefix: str) -> Selector:
    return lambda names: [n for n in names if n.startswith(prefix)]


def ends_in(suffix: str) -> Selector:
    return lambda names: [n for n in names if n.endswith(suffix)]


def having(text: str) -> Selector:
    return lambda names: [n for n in names if text in n]


def everything() -> Selector:
    return lambda names: list(names)


def any_of(*wanted: str) -> Selector:
    return lambda names: [w for w in wanted if w in names]


def all_of(*wanted: str) -> Selector:
    def pick(names: list[str]) -> list[str]:
        missing = [w for w in wanted if w not in names]
        if missing:
            raise KeyError(f"no such column: {missing}")
        return list(wanted)

    return pick


def chosen(names: list[str], keep: Iterable[Selector], drop: Iterable[Selector] = ()) -> list[str]:
    """Names picked by ``keep`` in order of first mention, without those in ``drop``."""
    unwanted = {n for s in drop for n in s(names)}
    picked = dict.fromkeys(n for s in keep for n in s(names))
    return [n for n in picked if n not in unwanted]


def pick(df: DataFrame, keep: Iterable[Selector], drop: Iterable[Selector] = (), first=()) -> DataFrame:
    return df.select(*first, *[f"`{n}`" for n in chosen(df.columns, keep, drop) if n not in first])


def without(df: DataFrame, *drop: Selector) -> DataFrame:
    return df.drop(*chosen(df.columns, drop))


def union_of_specs(names: list[str], specs: dict[str, list[Selector]]) -> list[str]:
    """Every column that any specification uses, in order of first mention."""
    return chosen(names, [s for spec in specs.values() for s in spec])


def snake_case(name: str) -> str:
    parts = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    parts = re.sub(r"([A-Za-z])([0-9])", r"\1 \2", parts)
    parts = re.sub(r"([0-9])([A-Za-z])", r"\1 \2", parts)
    return "_".join(re.findall(r"[A-Za-z0-9]+", parts)).lower()


def renamed(df: DataFrame, rule: Callable[[str], str], only: Iterable[Selector] = ()) -> DataFrame:
    """Apply ``rule`` to all names, or to the names picked by ``only``."""
    only = list(only)
    touched = set(chosen(df.columns, only)) if only else set(df.columns)
    return df.toDF(*[rule(n) if n in touched else n for n in df.columns])


def replacing(pattern: str, by: str) -> Callable[[str], str]:
    """Rename rule: replace the first match of ``pattern``."""
    return lambda name: re.sub(pattern, by, name, count=1)
